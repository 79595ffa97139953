"""Joins, windows, sampling and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuswright.operators import mixing as X
from corpuswright.operators import ordering as O
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import PRED, pred, table


@register("""SELECT d.doc_id, d.source || ',' || d.lang AS category, l.quality AS hit, 'label' AS basis FROM documents d JOIN labels l USING (doc_id)""")
def prediction_answer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents met with the answer key; documents without a label drop out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", "source", "lang").alias("category"))
    key = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("hit"), F.lit("label").alias("basis"))
    return rows.join(key, "doc_id").select("doc_id", "category", "hit", "basis")


@register(f"""WITH {PRED}, g AS (SELECT doc_id % 200 AS g_index, bool_and(hit = 1) AS ok, count(*) AS n FROM pred GROUP BY ALL)
 SELECT p.doc_id, CAST(ok AS INTEGER) AS hit, n FROM pred p JOIN g ON p.doc_id = g.g_index""")
def circular_group_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir)
    g = rows.groupBy((F.col("doc_id") % 200).alias("g_index")).agg(F.bool_and(F.col("hit") == 1).alias("ok"), F.count("*").alias("n"))
    return rows.select("doc_id").join(g, F.col("doc_id") == F.col("g_index")).select("doc_id", F.col("ok").cast("int").alias("hit"), "n")


@register(f"""WITH {PRED}, r AS (SELECT doc_id // 3 AS idx, doc_id % 3 AS rot, hit FROM pred), j AS (SELECT a.idx, a.hit * b.hit * c.hit AS hit_all, CASE WHEN a.hit + b.hit + c.hit = 0 THEN 1 ELSE 0 END AS miss_all
 FROM r a JOIN r b USING (idx) JOIN r c USING (idx) WHERE a.rot = 0 AND b.rot = 1 AND c.rot = 2) SELECT CAST(sum(hit_all) AS BIGINT) AS hit_all, CAST(sum(miss_all) AS BIGINT) AS miss_all, count(*) AS total FROM j""")
def nway_rotation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k result files by index: one grouping pass instead of k - 1 joins."""
    r = pred(spark, sf_dir).groupBy(F.expr("doc_id div 3").alias("idx")).agg(F.countDistinct(F.col("doc_id") % 3).alias("n"), F.min("hit").alias("lo"), F.max("hit").alias("hi")).filter("n = 3")
    return r.agg(F.sum("lo").alias("hit_all"), F.sum(1 - F.col("hi")).alias("miss_all"), F.count("*").alias("total"))


@register("""WITH s AS (SELECT l_orderkey AS id, min(l_extendedprice) FILTER (l_linenumber = 1) AS step1, min(l_extendedprice) FILTER (l_linenumber = 2) AS step2, min(l_extendedprice) FILTER (l_linenumber = 3) AS step3 FROM lineitem GROUP BY ALL)
 SELECT o_orderkey AS id, step1, step2, step3 FROM orders LEFT JOIN s ON o_orderkey = id""")
def step_pivot_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("step"), "l_linenumber").alias("step"), "l_extendedprice")
    steps = line.groupBy("id").pivot("step", ["step1", "step2", "step3"]).agg(F.min("l_extendedprice"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(steps, "id", "left")


@register("""WITH c AS (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS m FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
 SELECT r_name, round(avg(m), 6) AS macro, count(*) AS leaves FROM region JOIN c ON n_regionkey = r_regionkey GROUP BY r_name""")
def tree_rollup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by leaf, then means of means by root."""
    leaf = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("m"))
    nodes = table(spark, sf_dir, "nation").join(leaf, "n_nationkey", "left")
    return nodes.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.round(F.avg("m"), 6).alias("macro"), F.count("*").alias("leaves"))


@register("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@register("""WITH a AS (SELECT source AS path, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT source AS path, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
 SELECT coalesce(a.path, b.path) AS path, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS only_left, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS only_right FROM a FULL JOIN b ON a.path = b.path""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the labelled documents lack of all documents, by source."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"))
    return O.multiset_diff(d, d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"), ["path"])


@register("""WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
 SELECT conv_id, turn, coalesce(lag(text) OVER w, last_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def kto_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mismatch(table(spark, sf_dir, "conversations").filter("role = 'assistant'"), "conv_id", "turn", "text").select("conv_id", "turn", "other")


@register("SELECT coalesce(e.name, s.name) AS name, CASE WHEN e.bal < 0 OR e.bal IS NULL THEN s.bal ELSE e.bal END AS bal FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer) e RIGHT JOIN (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier) s ON e.k = s.k")
def expert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("en"), F.col("c_acctbal").alias("eb"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("sn"), F.col("s_acctbal").alias("sb"))
    return s.join(e, "k", "left").select(F.coalesce("en", "sn").alias("name"), F.when((F.col("eb") < 0) | F.col("eb").isNull(), F.col("sb")).otherwise(F.col("eb")).alias("bal"))


@register(f"""WITH {PRED}, k AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || doc_id), doc_id) AS n FROM pred) SELECT doc_id, category FROM k WHERE n <= 2""")
def per_category_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.per_group(pred(spark, sf_dir), "category", [O.draw("doc_id"), F.col("doc_id")], 2).select("doc_id", "category")


@register(f"""WITH {PRED}, k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM pred WHERE answer <> 'D') SELECT doc_id, lang FROM k WHERE n <= CASE lang WHEN 'en' THEN 20 WHEN 'fr' THEN 5 ELSE 2147483647 END""")
def per_category_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.per_group(pred(spark, sf_dir).filter("answer <> 'D'"), "lang", [F.col("doc_id")], {"en": 20, "fr": 5}).select("doc_id", "lang")


@register(f"""WITH {PRED}, k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY lang) AS t FROM pred)
 SELECT doc_id, lang, CASE WHEN n <= floor(t * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM k""")
def fraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.split_fraction(pred(spark, sf_dir), "lang", "doc_id", 0.15).select("doc_id", "lang", "split")


@register(f"""WITH {PRED}, k AS (SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= CAST(floor((SELECT count(*) FROM pred) * 0.1::DOUBLE) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM pred) GROUP BY ALL) SELECT split, n FROM k""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an exact stratified split."""
    return O.stratified_split(pred(spark, sf_dir), "lang", "doc_id", 0.1).groupBy("split").agg(F.count("*").alias("n"))


@register("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS rank FROM documents")
def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full shuffle: every row's rank in hash order, ranked in parallel by hash range."""
    d = table(spark, sf_dir, "documents").select("doc_id").withColumn("h", O.draw("doc_id", seed=7))
    return O.rank_all(d, ["h", "doc_id"]).select("doc_id", "rank")


@register("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, k % 4 AS stride, CAST(floor(k / (n / 4)) AS BIGINT) AS part FROM r".replace("CAST(floor(k / (n / 4)) AS BIGINT)", "ntile(4) OVER (ORDER BY doc_id)"))
def shard_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strided shards and contiguous ranges, the first n % k of which have one more."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    small, more = divmod(n, 4)
    r = O.rank_all(d, ["doc_id"], "k")
    part = F.when(F.col("k") < more * (small + 1), F.floor(F.col("k") / (small + 1))).otherwise(more + F.floor((F.col("k") - more * (small + 1)) / max(small, 1)))
    return r.select("doc_id", (F.col("k") % 4).alias("stride"), (part + 1).cast("long").alias("part"))


_A, _B = "SELECT o_orderkey AS key, o_orderpriority AS name, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders", "SELECT c_custkey AS key, c_name AS name, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer"


def _two(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"))
    return [a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))]


@register(f"WITH a AS ({_A}), b AS ({_B}), x AS (SELECT key, name, 0 AS source, k AS turn FROM a UNION ALL SELECT key, name, 1, k FROM b) SELECT * FROM x WHERE turn < (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)))")
def mix_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.interleave(_two(spark, sf_dir), "key")


@register(f"WITH a AS ({_A}), b AS ({_B}), n AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b) SELECT key, name, 0 AS source, k AS turn FROM a UNION ALL SELECT key, name, 1, k + t * n.b FROM b, n, (SELECT unnest(range(0, 1000)) AS t) WHERE k + t * n.b < n.a")
def mix_interleave_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.interleave(_two(spark, sf_dir), "key", stop="all")


def _mixed(stop: str) -> str:
    """SQL of a mix of orders (0.7) and customers (0.3) by the md5 of the position."""
    end = "min" if stop == "first" else "max"
    return f"""WITH a AS ({_A}), b AS ({_B}), n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
 d AS (SELECT t AS position, CASE WHEN ('0x' || substr(md5('42:' || t), 1, 7))::BIGINT < 187904819 THEN 0 ELSE 1 END AS source FROM range((SELECT na + nb FROM n) * 20) r(t)), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS turn FROM d),
 e AS (SELECT {end}(position) AS stop FROM k, n WHERE turn = CASE source WHEN 0 THEN na ELSE nb END - 1)
 SELECT coalesce(a.key, b.key) AS key, coalesce(a.name, b.name) AS name, source, position FROM k CROSS JOIN n CROSS JOIN e LEFT JOIN a ON source = 0 AND a.k = turn % na LEFT JOIN b ON source = 1 AND b.k = turn % nb WHERE position <= stop"""


@register(_mixed("first"))
def mix_by_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.interleave_by_probability(_two(spark, sf_dir), "key", [0.7, 0.3])


@register(_mixed("all"))
def mix_by_probability_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.interleave_by_probability(_two(spark, sf_dir), "key", [0.7, 0.3], stop="all")


@register("SELECT 'customer' AS origin, c_name AS name, c_acctbal AS bal, CAST(NULL AS BIGINT) AS n_size FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_name, p_retailprice, p_size FROM part")
def mix_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    c = table(spark, sf_dir, "part").select(F.lit("part").alias("origin"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("bal"), F.col("p_size").cast("long").alias("n_size"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@register("""WITH l AS (SELECT doc_id, n_chars AS s, n_chars * (doc_id % 5) AS t FROM documents), k AS (SELECT *, least(CASE WHEN t * 2 < 1000 THEN 1000 WHEN s * 2 < 1000 THEN 1000 - s ELSE CAST(trunc(1000 * (CAST(t AS DOUBLE) / (s + t))) AS INTEGER) END, t) AS nt FROM l)
 SELECT doc_id, least(greatest(1000 - nt, 0), s) AS source_len, nt AS target_len FROM k""")
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("n_chars"), F.col("n_chars") * (F.col("doc_id") % 5)
    a, b = O.sequence_budget(s, t, 1000)
    return table(spark, sf_dir, "documents").select("doc_id", a.cast("long").alias("source_len"), b.cast("long").alias("target_len"))


@register("""WITH l AS (SELECT source, doc_id, n_chars AS n, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS e, CAST(sum(n_chars) OVER (PARTITION BY source) AS BIGINT) AS t FROM documents),
 b AS (SELECT *, e - n AS s, unnest(range((e - n) // 4096, (e - 1) // 4096 + 1)) AS block FROM l WHERE n > 0)
 SELECT source, doc_id, block, greatest(s - block * 4096, 0) AS at, least(e - block * 4096, 4096) - greatest(s - block * 4096, 0) AS taken FROM b WHERE (block + 1) * 4096 <= t""")
def block_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.block_pack(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), 4096)


@register("""WITH RECURSIVE b AS (SELECT doc_id // 1000 AS batch, list({'n': n_chars, 'i': doc_id} ORDER BY n_chars, doc_id) FILTER (n_chars <= 4096) AS free FROM documents GROUP BY ALL),
 w AS (SELECT batch, free, 4096::BIGINT AS room, 0::BIGINT AS pack, NULL::BIGINT AS doc_id, NULL::BIGINT AS n_chars FROM b UNION ALL
 SELECT batch, CASE WHEN k > 0 THEN list_concat(free[1:k - 1], free[k + 1:]) ELSE free END, CASE WHEN k > 0 THEN room - free[k].n ELSE 4096 END, CASE WHEN k > 0 THEN pack ELSE pack + 1 END, CASE WHEN k > 0 THEN free[k].i END, CASE WHEN k > 0 THEN free[k].n END
 FROM (SELECT *, len(list_filter(free, lambda x: x.n <= room)) AS k FROM w WHERE len(free) > 0))
 SELECT batch, doc_id, n_chars, pack FROM w WHERE doc_id IS NOT NULL""")
def knapsack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 1000").alias("batch"), "doc_id", "n_chars")
    return O.knapsack_pack(rows, "batch", "doc_id", "n_chars", 4096)


@register(f"""WITH {PRED}, q AS (SELECT doc_id, answer, 'a' || doc_id AS A, 'b' AS B, 'c' AS C, 'd' AS D FROM pred), r AS (SELECT *, unnest([0,1,2,3]) AS rotation, [A, B, C, D] AS o FROM q)
 SELECT doc_id, rotation, o[rotation % 4 + 1] AS "A", o[(1 + rotation) % 4 + 1] AS "B", o[(2 + rotation) % 4 + 1] AS "C", o[(3 + rotation) % 4 + 1] AS "D", chr(CAST(65 + (ascii(answer) - 65 - rotation + 4) % 4 AS INTEGER)) AS answer FROM r""")
def circular_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = pred(spark, sf_dir).select("doc_id", "answer", F.concat(F.lit("a"), "doc_id").alias("A"), F.lit("b").alias("B"), F.lit("c").alias("C"), F.lit("d").alias("D"))
    return O.rotate_choices(q, ["A", "B", "C", "D"], "answer")


@register("WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) SELECT doc_id, CASE WHEN k = 1 THEN lang ELSE lang || '_' || substr(sha1(lang || ':' || doc_id), 1, 8) END AS uid FROM k")
def uid_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.dedupe_names(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "uid")


@register("SELECT user_id, f AS frame FROM (SELECT user_id, unnest(list_transform(range(8), lambda i: CAST(floor(i * (count - 1) / 7) AS INTEGER))) AS f FROM (SELECT user_id, count(*) AS count FROM events GROUP BY ALL))")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(O.uniform_frames(F.col("n"), 8)).alias("frame"))


@register("SELECT l_orderkey AS image_id, first(l_returnflag ORDER BY (l_returnflag = 'R') DESC, l_returnflag) AS label FROM lineitem GROUP BY ALL")
def prioritised_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("label")).distinct()
    return O.prefer([(0, rows.filter("label = 'R'")), (1, rows.filter("label = 'A'")), (2, rows.filter("label = 'N'"))], "image_id")


@register("""WITH v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT user_id, v, 1.8::DOUBLE * (1 / (1 + exp(-0.05::DOUBLE * n)) - 0.5) AS w FROM v)
 SELECT user_id, round(list_reduce(v, lambda a, b: a * w + b * (1 - w)), 6) AS smoothed FROM w""")
def ema_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"), F.count("*").alias("n"))
    return v.select("user_id", F.round(O.ema_last(F.col("v"), F.col("n")), 6).alias("smoothed"))


@register("SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority)))[1] AS first, len(list_distinct(list(o_orderstatus))) AS kinds FROM orders GROUP BY ALL")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("first"), F.countDistinct("o_orderstatus").alias("kinds"))


@register("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY TRY_CAST(regexp_extract(o_orderpriority, '[0-9]+') AS INTEGER) NULLS LAST, o_orderkey LIMIT 100")
def stage_order_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred by the number in the stage's name (a top-k report)."""
    number = F.coalesce(F.regexp_extract("o_orderpriority", "[0-9]+", 0).try_cast("int"), F.lit(10**9))
    return table(spark, sf_dir, "orders").orderBy(number, "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@register("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
 SELECT e.user_id, e.event_id, max(p.k) AS purchases_before FROM r e LEFT JOIN (SELECT user_id, event_id, k FROM r WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.k <= e.k GROUP BY ALL""")
def best_fit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: the largest earlier position of a kind, by a running maximum instead of a join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w).cast("long"))
    upto = F.max(F.when(F.col("event_type") == "purchase", F.col("k"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return e.select("user_id", "event_id", upto.alias("purchases_before"))
