"""Report queries over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.operators import reports as R
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import PRED, pred, table

KEYWORDS = ("src1", "src2", "en", "fr", "none")
_KEY_LIST = "['src1','src2','en','fr','none']"


@register(f"""WITH {PRED} SELECT category, count(*) AS total, 100 * avg(hit) AS acc FROM
 (SELECT unnest(list_append(list_filter({_KEY_LIST}, lambda k: contains(category, k)), 'Overall')) AS category, hit FROM pred) GROUP BY category""")
def overlap_category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlapping_report(pred(spark, sf_dir), "category", "hit", KEYWORDS)


@register(f"""WITH {PRED}, r AS (SELECT unnest(list_append(list_filter({_KEY_LIST}, lambda k: contains(category, k)), 'Overall')) AS category, hit FROM pred),
 k AS (SELECT unnest(list_append({_KEY_LIST}, 'Overall')) AS category)
 SELECT k.category, count(hit) AS total, coalesce(100 * avg(hit), 0) AS acc FROM k LEFT JOIN r ON k.category = r.category GROUP BY k.category""")
def overlap_category_report_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlapping_report(pred(spark, sf_dir), "category", "hit", KEYWORDS, fixed=True)


@register(f"""WITH {PRED} SELECT 'lang,source' AS level, lang || ',' || source AS "group", avg(hit) AS mean, count(*) AS total FROM pred GROUP BY lang, source
 UNION ALL SELECT 'lang', lang, avg(hit), count(*) FROM pred GROUP BY lang UNION ALL SELECT 'Overall', 'Overall', avg(hit), count(*) FROM pred""")
def split_ability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grouped_report(pred(spark, sf_dir), "hit", [["lang", "source"], ["lang"], []])


@register(f"WITH {PRED} SELECT lang, avg(m) AS macro, count(*) AS groups FROM (SELECT lang, source, avg(hit) AS m FROM pred GROUP BY lang, source) GROUP BY lang")
def macro_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.macro_mean(pred(spark, sf_dir), ["lang", "source"], ["lang"], "hit")


@register(f"WITH {PRED} SELECT avg(m) AS macro, count(*) AS groups FROM (SELECT source, avg(hit) AS m FROM pred GROUP BY source)")
def source_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.macro_mean(pred(spark, sf_dir), ["source"], [], "hit")


@register(f"""WITH {PRED}, p AS (SELECT source, coalesce(avg(hit) FILTER (lang = 'en'), 0) AS en, coalesce(avg(hit) FILTER (lang = 'fr'), 0) AS fr,
 coalesce(avg(hit) FILTER (lang = 'de'), 0) AS de, coalesce(avg(hit) FILTER (lang = 'es'), 0) AS es FROM pred GROUP BY source)
 SELECT source, en, fr, de, es, (0.0::DOUBLE + en + fr + de + es) / 4 AS "Avg" FROM p""")
def leaderboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pivot_with_average(pred(spark, sf_dir), "source", "lang", ["en", "fr", "de", "es"], "hit")


@register(f"""WITH {PRED}, g AS (SELECT lang, doc_id // 2 AS pair, bool_and(hit = 1) AS ok, count(*) AS n, sum(hit) AS hits FROM pred GROUP BY ALL)
 SELECT lang, avg(CASE WHEN ok AND n >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS group_acc, CAST(sum(hits) AS DOUBLE) / sum(n) AS row_acc, count(*) AS groups FROM g GROUP BY lang""")
def pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).withColumn("pair", F.expr("doc_id div 2"))
    return R.all_right(rows, ["pair"], "hit", by=["lang"], least=2)


@register(f"""WITH {PRED}, g AS (SELECT lang, quality, doc_id % 50 AS qid, bool_and(hit = 1) AS ok, count(*) AS n, sum(hit) AS hits FROM pred GROUP BY ALL)
 SELECT lang, quality, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS group_acc, CAST(sum(hits) AS DOUBLE) / sum(n) AS row_acc, count(*) AS groups FROM g GROUP BY lang, quality""")
def worst_case_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).withColumn("qid", F.col("doc_id") % 50)
    return R.all_right(rows, ["qid"], "hit", by=["lang", "quality"])


@register(f"""WITH {PRED}, g AS (SELECT lang, doc_id // 2 AS pair, avg(hit) AS m, min(hit) AS a FROM pred GROUP BY ALL)
 SELECT lang, 100 * avg(m) AS acc, 100 * avg(a) AS acc_plus, 100 * avg(m) + 100 * avg(a) AS score FROM g GROUP BY lang""")
def paired_image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paired_score(pred(spark, sf_dir).withColumn("pair", F.expr("doc_id div 2")), "lang", "pair", "hit")


_BINARY = """avg(CASE WHEN a = p THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
 CASE WHEN count_if(p) > 0 THEN count_if(a AND p) / CAST(count_if(p) AS DOUBLE) ELSE 0 END AS precision,
 CASE WHEN count_if(a) > 0 THEN count_if(a AND p) / CAST(count_if(a) AS DOUBLE) ELSE 0 END AS recall,
 CASE WHEN count_if(a OR p) > 0 THEN 2 * count_if(a AND p) / CAST(2 * count_if(a AND p) + count_if(a <> p) AS DOUBLE) ELSE 0 END AS f1"""


@register(f"""WITH {PRED}, x AS (SELECT unnest(list_append(string_split(category, ','), 'Overall')) AS category, quality = 1 AS a, hit = 1 AS p FROM pred)
 SELECT category, {_BINARY}, count(*) AS total FROM x GROUP BY category""")
def exploded_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).select("category", (F.col("quality") == 1).alias("a"), (F.col("hit") == 1).alias("p"))
    return R.exploded_f1(rows, "category", "a", "p")


@register(f"WITH {PRED}, x AS (SELECT lang, quality = 1 AS a, hit = 1 AS p FROM pred) SELECT lang, {_BINARY} FROM x GROUP BY lang")
def binary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = F.col("quality") == 1, F.col("hit") == 1
    return pred(spark, sf_dir).groupBy("lang").agg(*R.binary_scores(a, p))


@register(f"""WITH {PRED}, k AS (SELECT DISTINCT lang FROM pred WHERE lang <> 'en'), x AS (SELECT lang AS against, quality = 1 AS a, hit = 1 AS p FROM pred WHERE lang <> 'en'
 UNION ALL SELECT k.lang, quality = 1, hit = 1 FROM pred, k WHERE pred.lang = 'en') SELECT against, {_BINARY}, count(*) AS total FROM x GROUP BY against""")
def control_group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_controls(pred(spark, sf_dir), "lang", "en")
    return rows.groupBy("against").agg(*R.binary_scores(F.col("quality") == 1, F.col("hit") == 1), F.count("*").alias("total"))


@register("""WITH m AS (SELECT * FROM (VALUES ('en', 'germanic'), ('de', 'germanic'), ('fr', 'romance')) t(lang, family)), """ + PRED + """
 SELECT coalesce(family, 'other') AS family, avg(hit) AS acc, count(*) AS total FROM pred LEFT JOIN m USING (lang) GROUP BY ALL""")
def mapped_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = F.create_map(*[F.lit(x) for x in ("en", "germanic", "de", "germanic", "fr", "romance")])
    return pred(spark, sf_dir).groupBy(F.coalesce(families[F.col("lang")], F.lit("other")).alias("family")).agg(F.avg("hit").alias("acc"), F.count("*").alias("total"))


@register(f"""WITH {PRED}, b AS (SELECT doc_id // 4 AS block, max(CASE WHEN doc_id % 4 = 0 THEN hit END) AS a, max(CASE WHEN doc_id % 4 = 1 THEN hit END) AS b,
 max(CASE WHEN doc_id % 4 = 2 THEN hit END) AS c, max(CASE WHEN doc_id % 4 = 3 THEN hit END) AS d FROM pred GROUP BY ALL),
 f AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d FROM b)
 SELECT avg((a + b + c + d) / 4) AS acc, avg((a * b + c * d) / 2) AS q_acc, avg((a * c + b * d) / 2) AS i_acc, avg(CAST(a * b * c * d AS DOUBLE)) AS g_acc, count(*) AS blocks FROM f""")
def block_group_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions on two images: single, by question, by image and whole-block accuracy."""
    cells = pred(spark, sf_dir).select(F.expr("doc_id div 4").alias("block"), (F.col("doc_id") % 4).alias("cell"), "hit")
    wide = cells.groupBy("block").pivot("cell", [0, 1, 2, 3]).agg(F.max("hit")).fillna(0)
    a, b, c, d = (F.col(f"`{k}`") for k in range(4))
    return wide.agg(F.avg((a + b + c + d) / 4).alias("acc"), F.avg((a * b + c * d) / 2).alias("q_acc"), F.avg((a * c + b * d) / 2).alias("i_acc"), F.avg(a * b * c * d).alias("g_acc"), F.count("*").alias("blocks"))


@register(f"""WITH {PRED}, x AS (SELECT CASE WHEN n_chars <= 500 THEN 'short' WHEN n_chars <= 2000 THEN 'medium' WHEN n_chars <= 10000 THEN 'long' ELSE 'huge' END AS bucket,
 CASE WHEN toxic = 1 THEN -1 ELSE hit END AS s FROM pred), k AS (SELECT unnest(['short','medium','long','huge']) AS bucket)
 SELECT k.bucket, coalesce(round(avg(s), 4), 0) AS mean, count(s) AS total FROM k LEFT JOIN (SELECT * FROM x WHERE s <> -1) y ON k.bucket = y.bucket GROUP BY k.bucket""")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).withColumn("s", F.when(F.col("toxic") == 1, -1).otherwise(F.col("hit")))
    return R.bucket_report(rows, "n_chars", "s", [500, 2000, 10000], ["short", "medium", "long", "huge"])


@register(f"""WITH {PRED}, t AS (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5]) AS threshold) SELECT threshold,
 round(avg(CASE WHEN doc_id % 7 / 7.0::DOUBLE > threshold THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at,
 round(avg(CASE WHEN doc_id % 7 / 7.0::DOUBLE > threshold AND hit = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy_at FROM pred, t GROUP BY threshold""")
def conditional_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).withColumn("iou", (F.col("doc_id") % 7) / F.lit(7.0))
    return R.over_thresholds(rows, "iou", [0.1, 0.2, 0.3, 0.4, 0.5], F.col("hit") == 1)


@register("""WITH p AS (SELECT part.p_brand AS page, p_name, p_type FROM part), d AS (SELECT page, sum(levenshtein(p_name, p_type)) AS dist, sum(greatest(length(p_name), length(p_type))) AS len FROM p GROUP BY page)
 SELECT avg(CAST(dist AS DOUBLE) / CAST(len AS DOUBLE)) AS distance, count(*) AS pages FROM d""")
def weighted_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), F.levenshtein("p_name", "p_type").alias("d"), F.greatest(F.length("p_name"), F.length("p_type")).alias("n"))
    return R.weighted_distance(p, "page", "d", "n")


@register("""WITH x AS (SELECT p_brand AS page, unnest(['ALL', 'size: ' || (p_size % 3), 'type: ' || p_type]) AS attribute, levenshtein(p_name, p_type) AS d, greatest(length(p_name), length(p_type)) AS n FROM part),
 g AS (SELECT page, attribute, CAST(sum(d) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS d FROM x GROUP BY ALL) SELECT attribute, avg(d) AS distance, count(*) AS pages FROM g GROUP BY attribute""")
def attribute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    labels = F.array(F.lit("ALL"), F.concat(F.lit("size: "), F.col("p_size") % 3), F.concat(F.lit("type: "), "p_type"))
    p = p.select(F.col("p_brand").alias("page"), F.explode(labels).alias("attribute"), F.levenshtein("p_name", "p_type").alias("d"), F.greatest(F.length("p_name"), F.length("p_type")).alias("n"))
    return R.weighted_distance(p, "page", "d", "n", by=["attribute"])


@register("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS u, list(text ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
 t AS (SELECT conv_id, string_split(lower(u[1]), ' ') AS p, string_split(lower(a[1]), ' ') AS w FROM c WHERE u IS NOT NULL AND a IS NOT NULL),
 x AS (SELECT conv_id, token, count(*) AS p, 0 AS a FROM (SELECT conv_id, unnest(p) AS token FROM t) GROUP BY ALL UNION ALL SELECT conv_id, token, 0, count(*) FROM (SELECT conv_id, unnest(w) AS token FROM t) GROUP BY ALL),
 b AS (SELECT conv_id, token, sum(p) AS p, sum(a) AS a FROM x GROUP BY ALL)
 SELECT conv_id, CAST(sum(least(p, a)) AS BIGINT) AS matched, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(a) AS BIGINT) AS wanted, 2 * CAST(sum(least(p, a)) AS DOUBLE) / CAST(sum(p) + sum(a) AS DOUBLE) AS f1 FROM b GROUP BY conv_id""")
def multiset_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first("user").alias("u"), first("assistant").alias("a")).dropna()
    return R.token_f1(c, ["conv_id"], F.split(F.lower("u"), " "), F.split(F.lower("a"), " "))


@register(f"""WITH {PRED}, s AS (SELECT lang, CASE WHEN toxic = 1 THEN -1.0::DOUBLE ELSE hit END AS s, n_chars AS w FROM pred)
 SELECT lang, coalesce(sum(s * w) FILTER (s >= 0) / sum(w) FILTER (s >= 0), -1) AS weighted, coalesce(CAST(min(s) FILTER (s >= 0) AS DOUBLE), -1) AS least FROM s GROUP BY lang""")
def weighted_mean_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).withColumn("s", F.when(F.col("toxic") == 1, F.lit(-1.0)).otherwise(F.col("hit").cast("double")))
    return rows.groupBy("lang").agg(R.weighted_mean(F.col("s"), F.col("n_chars")).alias("weighted"), R.least_score(F.col("s")).alias("least"))


@register(f"""WITH {PRED}, v AS (SELECT lang, CASE WHEN doc_id % 2 = 1 THEN -1 ELSE 1 END * CASE answer WHEN 'A' THEN 2.0::DOUBLE WHEN 'B' THEN 1 WHEN 'C' THEN 0 WHEN 'D' THEN -1 END AS r FROM pred)
 SELECT lang, avg(r) AS reward, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, count_if(r > 0)::BIGINT AS wins, count_if(r = 0)::BIGINT AS ties, count_if(r < 0)::BIGINT AS losses, count_if(r IS NULL)::BIGINT AS unparsed FROM v GROUP BY lang""")
def pairwise_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).withColumn("rev", F.col("doc_id") % 2 == 1)
    return R.pairwise_reward(rows, "answer", "rev", {"A": 2, "B": 1, "C": 0, "D": -1}, by=["lang"])


@register(f"""WITH {PRED} SELECT lang, 100 * avg(hit) / avg(quality + 1) AS relative, avg(hit) / 9 * 100 AS normalised FROM pred GROUP BY lang""")
def relative_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred(spark, sf_dir).groupBy("lang").agg((100 * F.avg("hit") / F.avg(F.col("quality") + 1)).alias("relative"), (F.avg("hit") / 9 * 100).alias("normalised"))


@register(f"""WITH {PRED} SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT source) AS n_sources, avg(n_chars) AS mean_chars, max(n_chars) AS max_chars, min(doc_id) AS min_id, max(doc_id) AS max_id,
 arg_max(doc_id, (n_chars, -doc_id)) AS longest FROM pred""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("k"), "doc_id"))["doc_id"]
    return pred(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.avg("n_chars").alias("mean_chars"), F.max("n_chars").alias("max_chars"), F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), longest.alias("longest"))


@register("""WITH b AS (SELECT CAST(floor(n_chars / 1000) * 1000 AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY ALL)
 SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS running, 100.0::DOUBLE * sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS percent FROM b""")
def length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cumulative(table(spark, sf_dir, "documents"), F.col("n_chars"), 1000)


@register("SELECT role, count(*) AS turns, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words, avg(len(string_split(text, ' '))) AS mean_words FROM conversations GROUP BY role")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", " "))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(n).alias("words"), F.avg(n).alias("mean_words"))


@register("""WITH x AS (SELECT l_orderkey AS id, l_returnflag AS step, max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS ok FROM lineitem GROUP BY ALL),
 p AS (SELECT id, max(ok) FILTER (step = 'A') AS s1, max(ok) FILTER (step = 'N') AS s2, max(ok) FILTER (step = 'R') AS multi FROM x GROUP BY id)
 SELECT count_if(multi = 0 AND (s1 = 0 OR s2 = 0))::BIGINT AS lacks_knowledge, count_if(multi = 0 AND s1 = 1 AND s2 = 1)::BIGINT AS lacks_generalisation, count_if(multi = 1 AND s1 = 1 AND s2 = 1)::BIGINT AS mastered,
 count_if(multi = 1 AND (s1 = 0 OR s2 = 0))::BIGINT AS rote, count(*) AS total FROM p WHERE s1 IS NOT NULL AND s2 IS NOT NULL AND multi IS NOT NULL""")
def step_pivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step problems: single steps against the whole, in four cells."""
    rows = table(spark, sf_dir, "lineitem").withColumn("ok", F.when(F.col("l_discount") > 0.05, 1).otherwise(0))
    wide = rows.groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("ok")).dropna()
    steps, multi = (F.col("A") == 1) & (F.col("N") == 1), F.col("R") == 1
    return wide.agg(F.count_if(~multi & ~steps).alias("lacks_knowledge"), F.count_if(~multi & steps).alias("lacks_generalisation"), F.count_if(multi & steps).alias("mastered"), F.count_if(multi & ~steps).alias("rote"), F.count("*").alias("total"))


@register(f"""WITH {PRED}, x AS (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'Not answerable' ELSE answer END AS a, CASE WHEN doc_id % 5 = 0 THEN 'Not answerable' ELSE prediction END AS p FROM pred),
 y AS (SELECT a <> 'Not answerable' AS wanted, p <> 'Not answerable' AS given, CASE WHEN a = p THEN 1.0::DOUBLE ELSE 0 END AS s FROM x), z AS (SELECT avg(s) FILTER (wanted) AS r, avg(s) FILTER (given) AS p FROM y)
 SELECT r AS recall, p AS precision, CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END AS f1 FROM z""")
def answerability_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("Not answerable")
    rows = pred(spark, sf_dir).select(F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.col("answer")).alias("a"), F.when(F.col("doc_id") % 5 == 0, none).otherwise(F.col("prediction")).alias("p"))
    s = F.when(F.col("a") == F.col("p"), 1.0).otherwise(0.0)
    both = rows.agg(F.avg(F.when(F.col("a") != none, s)).alias("recall"), F.avg(F.when(F.col("p") != none, s)).alias("precision"))
    return both.withColumn("f1", R.ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


@register(f"""WITH {PRED} SELECT lang, count_if(contains(prediction, 'A'))::BIGINT AS failures, round(100.0::DOUBLE * count_if(contains(prediction, 'A')) / count(*), 2) AS percent FROM pred GROUP BY lang""")
def failure_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(F.contains("prediction", F.lit("A")))
    return pred(spark, sf_dir).groupBy("lang").agg(bad.alias("failures"), F.round(100.0 * bad / F.count("*"), 2).alias("percent"))


@register(f"WITH {PRED} SELECT doc_id % 5 AS cycle, lang, avg(hit) AS acc FROM pred GROUP BY ALL UNION ALL SELECT NULL, lang, avg(acc) FROM (SELECT doc_id % 5 AS cycle, lang, avg(hit) AS acc FROM pred GROUP BY ALL) GROUP BY lang")
def cycle_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = pred(spark, sf_dir).groupBy((F.col("doc_id") % 5).alias("cycle"), "lang").agg(F.avg("hit").alias("acc"))
    return cells.unionByName(cells.groupBy("lang").agg(F.avg("acc").alias("acc")).withColumn("cycle", F.lit(None).cast("long")))


@register("SELECT l_orderkey AS image_id, to_json(list_sort(list_distinct(list(l_returnflag)))) AS labels, len(list_distinct(list(l_linestatus))) AS n_status FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def condition_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"))
    g = g.agg(F.to_json(F.sort_array(F.collect_set("l_returnflag"))).alias("labels"), F.countDistinct("l_linestatus").alias("n_status"), F.count("*").alias("n"))
    return g.filter("n > 1").drop("n")
