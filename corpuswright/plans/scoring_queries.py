"""Row scores, payload extraction, padding and file listings over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.functions import answers as A
from corpuswright.functions import conversation as C
from corpuswright.functions import scoring as S
from corpuswright.operators import ordering as O
from corpuswright.operators import rows as R
from corpuswright.operators.storage import new_path
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import PRED, pred, table
from corpuswright.plans.text_queries import REPLY, reply
from corpuswright.sources import files

O_ORDERS = "SELECT o_orderkey, o_orderkey % 7 AS k, o_orderpriority AS p FROM orders"


@register("SELECT o_orderkey, line FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS line FROM orders) WHERE line BETWEEN 100 AND 299")
def line_range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A physical range of lines, the feature itself."""
    return files.line_range(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 299)


@register("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
 SELECT doc_id, count(*) AS times FROM (SELECT doc_id FROM d, range(100) r(t) WHERE t < 300 // n UNION ALL SELECT doc_id FROM d WHERE k < 300 % n) GROUP BY doc_id""")
def sample_with_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 300 rows, whole copies first."""
    return O.sample_exact(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 300).groupBy("doc_id").agg(F.count("*").alias("times"))


@register("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table, as the head limit has it."""
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(50)


@register("SELECT n_name, CASE n_name WHEN 'JAPAN' THEN 1 WHEN 'CHINA' THEN 2 WHEN 'FRANCE' THEN 1073741824 ELSE 3 END AS place FROM nation")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row of a report with a fixed order and a total."""
    return table(spark, sf_dir, "nation").select("n_name", R.report_place(F.col("n_name"), ["JAPAN", "CHINA"], "FRANCE").cast("int").alias("place"))


@register("""WITH c AS (SELECT conv_id, list(CAST(length(text) % 5 AS INTEGER) ORDER BY turn) AS p, list(CASE WHEN turn % 3 = 0 THEN -100 ELSE CAST(length(text) % 4 AS INTEGER) END ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
 x AS (SELECT conv_id, list_filter(list_zip(p[1:len(p) - 1], t[2:]), lambda z: z[2] <> -100) AS z FROM c) SELECT conv_id, len(list_filter(z, lambda q: q[1] = q[2])) / nullif(CAST(len(z) AS DOUBLE), 0) AS accuracy FROM x""")
def token_accuracy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = F.length("text") % 5, F.when(F.col("turn") % 3 == 0, -100).otherwise(F.length("text") % 4)
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", p.alias("p"), t.alias("t")))).alias("x"))
    return c.select("conv_id", S.token_accuracy(F.transform("x", lambda x: x["p"]), F.transform("x", lambda x: x["t"])).alias("accuracy"))


@register(f"""WITH {PRED}, x AS (SELECT doc_id, answer || ', ' || prediction || '-BC' AS t FROM pred), o AS (SELECT doc_id, regexp_replace(upper(t), '[^ABCD]', '', 'g') AS o FROM x)
 SELECT doc_id, CASE WHEN length(o) = 4 AND len(list_distinct(string_split(o, ''))) = 4 THEN o END AS answer FROM o""")
def ordering_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred(spark, sf_dir).select("doc_id", S.order_answer(F.concat("answer", F.lit(", "), "prediction", F.lit("-BC"))).alias("answer"))


@register(f"""WITH {REPLY}, x AS (SELECT doc_id, ' ' || trim(text) || ' ' AS t, lang FROM reply), s AS (SELECT doc_id, [{{'l': 'A', 'o': 'zzz'}}, {{'l': 'B', 'o': lang}}, {{'l': 'C', 'o': 'so'}}] AS o, t FROM x),
 p AS (SELECT doc_id, t, unnest(o) AS o FROM s), q AS (SELECT doc_id, o.l AS l, list_min(list_filter([instr(t, '(' || o.l || ')'), instr(t, ' ' || o.l || ' '), instr(t, ' ' || o.l || '.'), instr(t, ' ' || o.l || ','), instr(t, ' ' || o.l || ')'), instr(lower(t), lower(o.o))], lambda i: i > 0)) AS spot FROM p)
 SELECT doc_id, arg_min(l, {{'s': spot, 'l': l}}) FILTER (spot IS NOT NULL) AS letter FROM q GROUP BY doc_id""")
def single_choice_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = {"A": F.lit("zzz"), "B": F.col("lang"), "C": F.lit("so")}
    return reply(spark, sf_dir).select("doc_id", S.single_choice(F.col("text"), options).alias("letter"))


@register(r"""WITH t AS (SELECT event_id, event_type || CASE event_id % 4 WHEN 0 THEN ' is True' WHEN 1 THEN ': F' WHEN 2 THEN ' true or false' ELSE '' END AS t FROM events), h AS (SELECT event_id, list_distinct(list_transform(regexp_extract_all(lower(t), '\b(true|false|t|f)\b'), lambda x: upper(x[1]))) AS h FROM t)
 SELECT event_id, CASE WHEN len(h) = 1 THEN h[1] END AS verdict FROM h""")
def true_false_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    tail = F.when(k == 0, " is True").when(k == 1, ": F").when(k == 2, " true or false").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", S.true_false(F.concat("event_type", tail)).alias("verdict"))


@register(r"""SELECT p_partkey, trim(translate(regexp_replace(lower(trim(t)), '\s*\([^)]*\)', '', 'g'), '"''$%', '')) AS clean FROM (SELECT p_partkey, ' "' || p_name || ' (' || p_type || ')" $' || p_size || '% ' AS t FROM part)""")
def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit(' "'), "p_name", F.lit(" ("), "p_type", F.lit(')" $'), "p_size", F.lit("% "))
    return table(spark, sf_dir, "part").select("p_partkey", S.clean_answer(t).alias("clean"))


_ANLS = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1 WHEN 1 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE) <= 0.5 THEN 0 ELSE 1 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE) END"


@register(f"""WITH x AS (SELECT p_partkey AS id, p_size AS n, lower(p_name) AS p, lower(p_type) AS a, lower(p_brand) AS b FROM part) SELECT id,
 CASE id % 4 WHEN 0 THEN CASE WHEN n = n + id % 3 THEN 1.0::DOUBLE ELSE 0 END WHEN 1 THEN CASE WHEN abs(n - n / 100.0) <= 0.01 * n / 100.0 OR abs(n * (1 + (id % 3) / 100.0::DOUBLE) - n) <= 0.01::DOUBLE * n OR abs(n - n * 100) <= n THEN 1.0 ELSE 0 END
 WHEN 2 THEN least({_ANLS.format("least(b, p)", "least(b, a)")}, {_ANLS.format("greatest(b, p)", "greatest(b, a)")}) ELSE {_ANLS.format("p", "a")} END AS score FROM x""")
def typed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, floats, lists and strings, each by its own rule."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    kind = F.when(k == 0, "Int").when(k == 1, "Float").when(k == 2, "List").otherwise("Str")
    more = F.col("p_partkey") % 3
    said = F.when(k == 0, (n + more).cast("string")).when(k == 1, (n * (1 + more / F.lit(100.0))).cast("string")).when(k == 2, F.concat(F.lit("["), "p_name", F.lit(", "), "p_brand", F.lit("]"))).otherwise(F.col("p_name"))
    want = F.when(k < 2, n.cast("string")).when(k == 2, F.concat(F.lit("["), "p_type", F.lit(", "), "p_brand", F.lit("]"))).otherwise(F.col("p_type"))
    return p.select(F.col("p_partkey").alias("id"), S.typed_score(said, want, kind).alias("score"))


@register("""WITH x AS (SELECT p_partkey, lower(trim(p_name)) AS p, [lower(trim(p_type)), lower(trim(split_part(p_name, ' ', 1))), lower(p_name || ' a b c x')] AS a FROM part) SELECT p_partkey, list_max(list_transform(a, lambda t: CASE WHEN len(string_split_regex(t, '\\s+')) < 5 THEN CASE WHEN contains(p, t) THEN 1.0::DOUBLE ELSE 0 END
 WHEN 1 - levenshtein(p, t) / CAST(greatest(length(p), length(t), 1) AS DOUBLE) >= 0.5 THEN 1 - levenshtein(p, t) / CAST(greatest(length(p), length(t), 1) AS DOUBLE) ELSE 0 END)) AS score FROM x""")
def ocr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array("p_type", F.split("p_name", " ")[0], F.concat("p_name", F.lit(" a b c x")))
    return table(spark, sf_dir, "part").select("p_partkey", S.ocr_score(F.col("p_name"), a).alias("score"))


@register("""SELECT o_orderkey, CASE WHEN contains('about ' || (k + 3) || ' cats', CAST(k + 4 AS VARCHAR)) THEN 1.0::DOUBLE WHEN 1 - abs(k + 3 - (k + 4)) / CAST(k + 4 AS DOUBLE) > 0.5 THEN 1 - 1 / CAST(k + 4 AS DOUBLE) ELSE 0 END AS score FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders)""")
def counting_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    return table(spark, sf_dir, "orders").select("o_orderkey", S.counting_score(F.concat(F.lit("about "), k + 3, F.lit(" cats")), (k + 4).cast("string")).alias("score"))


@register("SELECT p_partkey, CAST(p_size * 1000 + p_size % 9 * 100 + p_size AS BIGINT) AS number, CASE WHEN p_size <= 10 THEN CAST(p_size AS INTEGER) END AS first FROM part")
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in words and read again."""
    n = F.col("p_size").cast("int")
    small = (*A.NUMBER_WORDS, *S.TEENS)
    words = F.array(*map(F.lit, small))
    tens = F.array(*map(F.lit, ("", "", *S.TENS)))
    two = lambda v: F.when(v < 20, F.get(words, v)).otherwise(F.concat(F.get(tens, F.floor(v / 10).cast("int")), F.when(v % 10 > 0, F.concat(F.lit("-"), F.get(words, v % 10))).otherwise("")))
    hundred = F.when(n % 9 > 0, F.concat(F.get(words, n % 9), F.lit(" hundred and "))).otherwise("")
    text = F.concat(two(n), F.lit(" thousand "), hundred, two(n))
    return table(spark, sf_dir, "part").select("p_partkey", S.words_to_number(text).alias("number"), A.number_word(F.when(n <= 10, F.concat(F.lit("so "), F.get(words, n), F.lit(" of"))).otherwise("none")).alias("first"))


@register("""SELECT c_custkey, 'bal ' || c_acctbal AS complaint, CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS VARCHAR) END AS age, '{"name":"' || c_name || '"' || CASE WHEN c_nationkey > 3 THEN ',"nation":"' || c_nationkey || '"' ELSE '' END || '}' AS json FROM customer""")
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string"))
    fields = F.create_map(F.lit("Chief Complaint:"), F.concat(F.lit("bal "), "c_acctbal"), F.lit("Age of patient"), nation)
    json = S.pairs_to_json(["name", "nation"], [F.col("c_name"), F.coalesce(nation, F.lit(" "))])
    return table(spark, sf_dir, "customer").select("c_custkey", S.field_by_keyword(fields, "complaint").alias("complaint"), S.field_by_keyword(fields, "age").alias("age"), json.alias("json"))


@register("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a|' || o_orderkey WHEN 1 THEN o_orderpriority ELSE 'x|y' END AS cell, CASE WHEN o_orderkey % 2 = 0 THEN '[' || o_orderkey || ']|["b"]' END AS lists FROM orders""")
def list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written in cells, and two fenced lists in a reply."""
    k = F.col("o_orderkey")
    cell = F.when(k % 3 == 0, F.concat(F.lit("['a', '"), k, F.lit("']"))).when(k % 3 == 1, F.col("o_orderpriority")).otherwise('["x", "y"]')
    text = F.concat(F.lit("so ```json\n["), k, F.lit("]\n```"), F.when(k % 2 == 0, ' and ```json\n["b"]\n``` end').otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(S.list_cell(cell), "|").alias("cell"), F.array_join(S.fenced_lists(text), "|").alias("lists"))


@register("""SELECT event_id, event_type AS name, '{"id": ' || user_id || ', "kind": "' || event_type || '"}' AS arguments, '> Tool Name: ' || event_type || chr(10) || 'Tool Description: does' || chr(10) || 'Tool Args:' || chr(10) || '  - a (int): ' || user_id AS tool FROM events""")
def tagged_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<function="), "event_type", F.lit(">\n<parameter=id>"), "user_id", F.lit("</parameter>\n<parameter=kind>\n"), "event_type", F.lit("\n</parameter></function>"))
    call = F.get(C.tagged_calls(text), F.lit(0))
    tools = F.array(F.struct(F.col("event_type").alias("name"), F.lit("does").alias("description"), F.create_map(F.lit("a"), F.struct(F.lit("int").alias("type"), F.col("user_id").cast("string").alias("description"))).alias("params")))
    return table(spark, sf_dir, "events").select("event_id", call["name"].alias("name"), call["arguments"].alias("arguments"), C.tool_text(tools).alias("tool"))


@register(r"""WITH x AS (SELECT p_partkey AS id, lower(p_name) AS p, lower(split_part(p_type, ' ', 1)) AS a, p_size AS n FROM part) SELECT id, contains(p, a) OR contains(p, lower(substr(p, 2, 3))) AS phrase,
 CASE WHEN id % 3 = 0 THEN '\frac{' || n || '}{2}' ELSE CAST(n AS VARCHAR) END AS boxed, id % 3 <> 0 AND 0 <= 0.01 AS near, id % 2 = 0 OR contains(p, a) AS letter FROM x""")
def phrase_and_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n, k, first = F.col("p_size"), F.col("p_partkey"), F.split("p_type", " ")[0]
    text = F.concat(F.lit(r"so \boxed{"), F.when(k % 3 == 0, F.concat(F.lit(r"\frac{"), n, F.lit("}{2}"))).otherwise(n.cast("string")), F.lit("} end"))
    same = S.letter_or_text_match(F.concat(F.when(k % 2 == 0, "B").otherwise("#"), F.lit("  "), F.col("p_name")), F.concat(F.lit("B.  "), first))
    return p.select(k.alias("id"), S.any_phrase(F.col("p_name"), F.array(first, F.substring("p_name", 2, 3))).alias("phrase"), S.boxed(text).alias("boxed"), S.general_numeric(text, n.cast("string")).alias("near"), same.alias("letter"))


_Q = "l_quantity, l_linenumber AS n, l_partkey % 10 AS x"
_B = "[0.0, 0.0, 10.0, 10.0]"


@register("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 10 AS x, l_suppkey % 10 AS y FROM lineitem), i AS (SELECT *, greatest(10.0::DOUBLE - x, 0) * greatest(10.0::DOUBLE - y, 0) AS inter FROM b), u AS (SELECT *, inter / (200.0::DOUBLE - inter) AS iou FROM i)
 SELECT l_orderkey, l_linenumber, iou / 2 AS listed, iou / 2 AS ordered, iou / 2 AS mapped, x <= 10 AND y <= 10 AS inside, exp(-10 * sqrt(x * x + y * y) / 100.0::DOUBLE / sqrt(2)) AS points, 1::BIGINT AS guarded FROM u""")
def box_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, sequences and maps of boxes, a tagged point in boxes, ordered points."""
    x, y = (F.col(c).cast("double") for c in ("x", "y"))
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 10).alias("x"), (F.col("l_suppkey") % 10).alias("y"))
    lit = lambda *v: F.array(*[F.lit(float(i)) for i in v])
    mine, far, target = F.array(x, y, x + 10, y + 10), lit(500, 500, 510, 510), lit(0, 0, 10, 10)
    point = lambda a, c: F.struct(a.alias("x"), c.alias("y"))
    return b.select(
        "l_orderkey", "l_linenumber", S.box_list_score(F.array(mine, far), F.array(target)).alias("listed"), S.box_sequence_score(F.array(mine, far), F.array(target)).alias("ordered"),
        S.map_box_score(F.create_map(F.lit("a"), mine, F.lit("b"), far), F.create_map(F.lit("a"), target)).alias("mapped"),
        S.point_in_boxes(F.concat(F.lit("at <point>"), "x", F.lit(", "), "y", F.lit("</point>")), F.array(target)).alias("inside"),
        S.keypoint_score(F.array(point(x / 100, y / 100)), F.array(point(F.lit(0.0), F.lit(0.0)))).alias("points"), F.size(S.box_guard(F.array(mine, F.array(x, y)))).cast("long").alias("guarded"),
    )


@register("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 10 AS DOUBLE) AS x, CAST(l_suppkey % 10 AS DOUBLE) AS y FROM lineitem), i AS (SELECT *, greatest(10.0::DOUBLE - x, 0) * greatest(10.0::DOUBLE - y, 0) AS inter FROM x)
 SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE inter / (200.0::DOUBLE - inter) END AS iou, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4)) END AS distance FROM i""")
def tagged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and points that a reply gives in tags; replies without count 0 or null."""
    x, y = (F.col("l_partkey") % 10).cast("double"), (F.col("l_suppkey") % 10).cast("double")
    box = F.concat(F.lit("<box>"), F.concat_ws(", ", x, y, x + 10, y + 10), F.lit("</box> or so"))
    text = F.when(F.col("l_linenumber") % 4 == 0, "none").otherwise(box)
    spot = F.when(F.col("l_linenumber") % 4 == 0, "none").otherwise(F.concat(F.lit("<point>"), x, F.lit(","), y, F.lit("</point>")))
    target = F.array(*[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.tagged_box_score(text, target).alias("iou"), S.tagged_point_distance(spot, F.lit(3.0), F.lit(4.0)).alias("distance"))


@register(f"""WITH {PRED}, m AS (SELECT doc_id, (['exact', 'exact_lower', 'simple', 'none'])[doc_id % 4 + 1] AS m, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang || CASE WHEN doc_id % 5 = 0 THEN '.' ELSE '' END END AS p, lang AS a FROM pred)
 SELECT doc_id, CASE m WHEN 'exact' THEN CASE WHEN p = a THEN 1.0::DOUBLE ELSE 0 END WHEN 'exact_lower' THEN CASE WHEN lower(p) = lower(a) THEN 1 ELSE 0 END WHEN 'simple' THEN CASE WHEN lower(replace(p, '.', '')) = lower(a) THEN 1 ELSE 0 END END AS score FROM m""")
def metric_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row names its own metric; an unknown name gives null."""
    k = F.col("doc_id")
    name = F.get(F.array(*map(F.lit, ("exact", "exact_lower", "simple", "none"))), (k % 4).cast("int"))
    said = F.when(k % 3 == 0, F.upper("lang")).otherwise(F.concat("lang", F.when(k % 5 == 0, ".").otherwise("")))
    return pred(spark, sf_dir).select("doc_id", S.score_by(name, said, F.col("lang")).alias("score"))


@register("""SELECT c_custkey, 'A=' || c_name || CASE WHEN c_nationkey > 5 THEN '|B=' || c_nationkey ELSE '' END AS choices FROM customer""")
def choice_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("A"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("B"))
    return c.select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(S.options_map(["A", "B"]))), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("choices"))


@register("""WITH n AS (SELECT conv_id, list(CAST(least(length(text), 2) AS INTEGER) ORDER BY turn)[1:3] AS n FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, flatten(list_transform(n, lambda x, i: list_transform(range(x), lambda q: i))) AS s FROM n), p AS (SELECT conv_id, list_resize(s, 8, 0) AS p FROM s)
 SELECT conv_id, array_to_string(p, '') AS segments, array_to_string(list_transform(p, lambda a, i: array_to_string(list_transform(p, lambda b, j: CASE WHEN a = b AND a <> 0 AND j <= i THEN 1 ELSE 0 END), '')), '|') AS mask FROM p""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments padded to one length and the mask of which places see which."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(C.ordered_turns(), lambda x: F.least(F.length(x["content"]), F.lit(2))).alias("n"))
    t = t.select("conv_id", C.packed_segments(F.slice("n", 1, 3), 8).alias("p"))
    line = lambda x: F.array_join(x.cast("array<string>"), "")
    return t.select("conv_id", line(F.col("p")).alias("segments"), F.array_join(F.transform(C.block_mask(F.col("p")), line), "|").alias("mask"))


@register("""WITH RECURSIVE n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST(length(text) % 30 AS BIGINT) AS a, CAST(length(text) % 17 AS BIGINT) AS b FROM conversations),
 w AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0::BIGINT AS used, '' AS kept FROM n UNION ALL SELECT conv_id, i, used + na + nb, kept || na || '+' || nb || ' ' FROM (SELECT *, least(greatest(room - nb, 0), a) AS na FROM (SELECT *, least(CASE WHEN 2 * b < room THEN room WHEN 2 * a < room THEN room - a ELSE CAST(trunc(room * (b / CAST(greatest(a + b, 1) AS DOUBLE))) AS BIGINT) END, b) AS nb
 FROM (SELECT n.conv_id, n.i, a, b, used, kept, 60 - used AS room FROM w JOIN n ON n.conv_id = w.conv_id AND n.i = w.i + 1) WHERE room > 0)))
 SELECT conv_id, trim(arg_max(kept, i)) AS kept FROM w GROUP BY conv_id""")
def budgeted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(C.ordered_turns().alias("t"))
    sizes = F.transform("t", lambda x: F.struct((F.length(x["content"]) % 30).alias("source"), (F.length(x["content"]) % 17).alias("target")))
    return n.select("conv_id", F.array_join(F.transform(R.budget_turns(sizes, 60), lambda x: F.concat_ws("+", x["source"], x["target"])), " ").alias("kept"))


@register("SELECT event_type AS folder, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder tree by included and excluded text; their rows counted by folder."""
    path = new_path(spark, "tree")
    table(spark, sf_dir, "events").select("event_id", "event_type").write.partitionBy("event_type").parquet(path)
    found = files.listing(spark, path, include=[".parquet"], exclude=["event_type=error"])
    folders = found.select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("folder")).distinct()
    return spark.read.parquet(path).join(folders, F.col("event_type") == F.col("folder")).groupBy("folder").agg(F.count("*").alias("n"))


@register("SELECT r_name AS line, CAST(length(string_agg(r_name, chr(10)) OVER ()) + 1 AS BIGINT) AS bytes FROM region")
def media_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as base64 cells, decoded again."""
    path = new_path(spark, "media")
    table(spark, sf_dir, "region").select("r_name").coalesce(1).write.text(path)
    cells = files.binary_base64(spark, path + "/*.txt").select(F.unbase64("base64").alias("b"))
    return cells.select(F.explode(F.split(F.rtrim(F.regexp_replace(F.col("b").cast("string"), "\n$", "")), "\n")).alias("line"), F.length("b").cast("long").alias("bytes"))


@register("SELECT c_custkey, c_name FROM customer")
def column_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named columns go; names that are absent count for nothing."""
    return R.without_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), ["c_acctbal", "C_Nationkey", "nothing"])


@register("SELECT o_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS annotation_id, o_orderpriority AS file, CASE l_returnflag WHEN 'A' THEN 'caries' WHEN 'N' THEN 'filling' ELSE 'unknown' END AS category FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def annotation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, annotations and category names; a category without a name is unknown."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("file"))
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("annotation_id"), F.col("l_returnflag").alias("category_id"))
    names = spark.createDataFrame([("A", "caries"), ("N", "filling")], "category_id string, category string")
    return R.annotated(images, marks, names).select("image_id", "annotation_id", "file", "category")
