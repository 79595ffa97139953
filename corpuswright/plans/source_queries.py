"""Scans, sinks and format queries; files are written to and read from scratch folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.operators.storage import new_path
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import table
from corpuswright.sources import files, registry


_ROUND = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"


def _round(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    path = f"{new_path(spark, 'round')}.{kind}"
    files.write(rows, path, kind)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return files.read(spark, path, "jsonl" if kind == "json" else kind, None if kind in ("parquet", "orc") else schema)


for _kind in ("parquet", "orc", "json", "csv", "tsv"):
    register(_ROUND, name=f"sink_round_trip_{_kind}")(lambda spark, sf_dir, kind=_kind: _round(spark, sf_dir, kind))


@register("SELECT item_id, text AS value FROM benchmark")
def sink_round_trip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with newlines escaped to one line each, with their id in front."""
    b = table(spark, sf_dir, "benchmark").select(F.concat_ws("\t", "item_id", F.replace("text", F.lit("\n"), F.lit("\\n"))).alias("value"))
    path = new_path(spark, "lines") + ".txt"
    files.write(b, path)
    back = files.read(spark, path)
    return back.select(F.substring_index("value", "\t", 1).cast("long").alias("item_id"), F.replace(F.expr("substring(value, instr(value, '\t') + 1)"), F.lit("\\n"), F.lit("\n")).alias("value"))


@register("SELECT doc_id AS prompt, source AS response, lang AS system, CAST(NULL AS VARCHAR) AS tools FROM documents")
def registry_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    (spec,) = registry.load_specs({"docs": {"table": "documents", "columns": {"prompt": "doc_id", "response": "source", "system": "lang"}}}, ["docs"])
    return registry.to_canonical(table(spark, sf_dir, spec.location), spec).select("prompt", "response", "system", "tools")


@register("WITH d AS (SELECT c_name, c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) SELECT c_name AS prompt, CAST(c_custkey AS VARCHAR) AS response, count(*) AS times FROM (SELECT c_name, c_custkey FROM d, range(10) r(t) WHERE t < 200 // n UNION ALL SELECT c_name, c_custkey FROM d WHERE k < 200 % n) GROUP BY ALL")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of one kind of files found through the registry, and a number of samples of it."""
    path = new_path(spark, "dataset")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").write.parquet(path)
    (spec,) = registry.load_specs({"c": {"file": path, "num_samples": 200, "columns": {"prompt": "c_name", "response": "c_custkey"}}})
    return registry.scan(spark, spec, order="c_custkey").groupBy("prompt", F.col("response").cast("string").alias("response")).agg(F.count("*").alias("times"))


@register("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'url' ELSE 'text' END AS kind FROM pages")
def value_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.kind_of_value(F.regexp_replace("url", r"\.html.*$", "")).alias("kind"))


@register("""SELECT l_orderkey AS image_id, l_returnflag AS label, l_quantity / 100 AS cx, l_tax AS w FROM lineitem""")
def yolo_label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", "l_returnflag", F.col("l_quantity") / 100, F.lit("0.5"), "l_tax", F.lit("0.25"))
    text = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.array_join(F.collect_list(line), "\n"), F.lit("\nbad line\n")).alias("t"))
    return text.select(F.col("l_orderkey").alias("image_id"), F.explode(files.yolo_lines(F.col("t"))).alias("y")).select("image_id", "y.label", "y.cx", "y.w")


@register("SELECT o_orderkey, o_orderpriority AS key, 'customer ' || o_custkey AS value FROM orders")
def key_value_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.lit(None), F.lit("  "), F.col("o_orderpriority"), F.concat(F.lit(": customer   "), "o_custkey"), F.lit(" ;"))
    return table(spark, sf_dir, "orders").select("o_orderkey", files.key_value(cells).alias("kv")).select("o_orderkey", "kv.key", "kv.value")


@register("SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, max(CASE WHEN role = 'assistant' THEN turn END) IS NOT NULL AS replied FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def transcript_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as marked transcripts and cut into turns again."""
    mark = F.when(F.col("role") == "user", "\n\nHuman: ").otherwise("\n\nAssistant: ")
    t = table(spark, sf_dir, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(mark, "text").alias("t")))).alias("x"))
    turns = files.transcript_turns(F.array_join(F.transform("x", lambda x: x["t"]), ""))
    return t.select("conv_id", F.size(turns).alias("turns"), F.exists(turns, lambda x: x["role"] == "assistant").alias("replied"))


@register("""SELECT o_orderkey, 'What of ' || o_orderkey || '?' AS instruction, 'good ' || o_orderpriority AS chosen, 'bad' AS rejected, CASE WHEN o_orderkey % 2 = 0 THEN 'first|yes' ELSE '' END AS history FROM orders""")
def transcript_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transcripts that differ in the last reply, with or without an earlier exchange."""
    k = F.col("o_orderkey")
    head = F.concat(F.when(k % 2 == 0, "\n\nHuman: first \n\nAssistant: yes").otherwise(""), F.lit("\n\nHuman: What of "), k, F.lit("?\n\nAssistant: "))
    pair = files.transcript_pair(F.concat(head, F.lit("good "), "o_orderpriority", F.lit(" \n")), F.concat(head, F.lit(" bad")))
    shown = F.array_join(F.transform("p.history", lambda h: F.concat_ws("|", h["query"], h["response"])), ";")
    return table(spark, sf_dir, "orders").select("o_orderkey", pair.alias("p")).select("o_orderkey", "p.instruction", "p.chosen", "p.rejected", shown.alias("history"))


@register("SELECT c_name, ntile(4) OVER (ORDER BY c_name) AS shard FROM customer")
def shard_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in order, dealt to ranges of which the first have one more."""
    from corpuswright.operators.ordering import rank_all

    c = table(spark, sf_dir, "customer").select("c_name")
    small, more = divmod(c.count(), 4)
    k = F.col("k")
    part = F.when(k < more * (small + 1), F.floor(k / (small + 1))).otherwise(more + F.floor((k - more * (small + 1)) / max(small, 1)))
    return rank_all(c, ["c_name"], "k").select("c_name", (part + 1).cast("long").alias("shard"))


@register("WITH a AS (SELECT p_partkey AS idx, CASE WHEN p_partkey % 3 = 0 AND p_partkey > 3 THEN CAST(p_partkey - 1 AS VARCHAR) ELSE repeat(p_name, 20) END AS image FROM part) SELECT a.idx, coalesce(b.image, CASE WHEN length(a.image) > 64 THEN a.image END) AS image FROM a LEFT JOIN a b ON length(a.image) <= 64 AND a.image = CAST(b.idx AS VARCHAR) AND length(b.image) > 64")
def benchmark_image_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_partkey") > 3), (F.col("p_partkey") - 1).cast("string")).otherwise(F.repeat("p_name", F.lit(20)))
    return files.image_aliases(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), image.alias("image")), "idx", "image")


@register("SELECT row_number() OVER (ORDER BY d, original_index) - 1 AS idx, d AS \"SUB_DATASET\", original_index, name FROM (SELECT 'customer' AS d, c_custkey AS original_index, c_name AS name FROM customer UNION ALL SELECT 'orders', o_orderkey, o_orderpriority FROM orders)")
def composite_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("name"))
    return files.composite({"customer": a, "orders": b}, "idx").select("idx", "SUB_DATASET", "original_index", "name")


@register("SELECT o_orderkey AS idx, o_orderpriority AS name FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_name), c_name FROM customer")
def append_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("name"))
    return files.append_rows(a, table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "idx", "name")


@register("SELECT o_custkey, max(o_orderdate) AS run, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS path FROM orders GROUP BY o_custkey")
def previous_run_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return o.select("o_custkey", F.col("m.o_orderdate").alias("run"), F.col("m.o_orderkey").alias("path"))


@register("WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) SELECT k AS name, json_extract_string(props, '$.' || k) AS v, count(*) AS n FROM k GROUP BY ALL")
def json_payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of every payload with its values' counts."""
    values = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select(F.explode(values).alias("name", "v")).groupBy("name", "v").agg(F.count("*").alias("n"))
