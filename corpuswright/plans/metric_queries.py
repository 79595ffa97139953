"""Metrics that need loops, constraint checks and judge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.functions import answers as A
from corpuswright.functions import metrics as M
from corpuswright.functions import scoring as S
from corpuswright.operators import judge as J
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import PRED, pred, table
from corpuswright.plans.text_queries import REPLY, reply


def _grams(source: str, words: str, top: int, joint: str = " ") -> str:
    """SQL of (id, n, gram, c) of a table's word lists."""
    return f"SELECT id, n, gram, count(*) AS c FROM (SELECT id, n, unnest(list_transform(range(1, len({words}) - n + 2), lambda i: array_to_string({words}[i:i + n - 1], '{joint}'))) AS gram FROM {source}, range(1, {top} + 1) r(n)) GROUP BY ALL"


_ROWS = "SELECT p_partkey AS id, p_name || ' ' || p_type AS p, p_type || ' ' || p_name AS a FROM part"


@register(f"""WITH RECURSIVE t AS ({_ROWS}), w AS (SELECT id, list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '') AS p, list_filter(string_split_regex(a, '\\s+'), lambda x: x <> '') AS a, string_split(p, '') AS pc, string_split(a, '') AS ac FROM t),
 gp AS ({_grams("w", "p", 2)}), ga AS ({_grams("w", "a", 2)}), m AS (SELECT id, n, CAST(sum(least(gp.c, ga.c)) AS BIGINT) AS m FROM gp JOIN ga USING (id, n, gram) GROUP BY ALL),
 l AS (SELECT id, 0::BIGINT AS i, list_transform(range(len(a) + 1), lambda x: 0::BIGINT) AS d FROM w UNION ALL
 SELECT l.id, i + 1, list_transform(range(len(a) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN w.a[k] = w.p[l.i + 1] THEN l.d[k] + 1 ELSE l.d[k + 1] END)) END) FROM l JOIN w ON w.id = l.id AND l.i < len(w.p)),
 lcs AS (SELECT id, arg_max(d, i)[-1] AS n FROM l GROUP BY id),
 cp AS ({_grams("w", "pc", 4, "")}), ca AS ({_grams("w", "ac", 4, "")}), b AS (SELECT id, n, len(pc) - n + 1 AS all_, len(pc) AS lp, len(ac) AS la FROM w, range(1, 5) r(n)),
 bm AS (SELECT b.*, coalesce(s.m, 0) AS m FROM b LEFT JOIN (SELECT id, n, sum(least(cp.c, ca.c)) AS m FROM cp JOIN ca USING (id, n, gram) GROUP BY ALL) s USING (id, n)),
 bk AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS k FROM bm),
 bleu AS (SELECT id, CASE WHEN max(CASE WHEN n = 1 THEN m END) = 0 OR min(all_) <= 0 THEN 0 ELSE (CASE WHEN max(lp) > max(la) THEN 1 ELSE exp(1 - max(la) / CAST(max(lp) AS DOUBLE)) END) * exp(sum(ln(CASE WHEN m = 0 THEN 1 / (pow(2, k) * all_) ELSE m / CAST(all_ AS DOUBLE) END)) / 4) END AS s FROM bk GROUP BY id)
 SELECT w.id AS p_partkey, round(100 * 2 * coalesce(m1.m, 0) / CAST(len(p) + len(a) AS DOUBLE), 4) AS rouge_1, round(CASE WHEN coalesce(m2.m, 0) = 0 THEN 0 ELSE 100 * 2 * m2.m / CAST(len(p) + len(a) - 2 AS DOUBLE) END, 4) AS rouge_2, round(100 * 2 * lcs.n / CAST(len(p) + len(a) AS DOUBLE), 4) AS rouge_l, round(100 * bleu.s, 4) AS bleu_4
 FROM w LEFT JOIN m m1 ON m1.id = w.id AND m1.n = 1 LEFT JOIN m m2 ON m2.id = w.id AND m2.n = 2 JOIN lcs ON lcs.id = w.id JOIN bleu ON bleu.id = w.id""")
def rouge_bleu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", M.text_scores(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_name")).alias("s"))
    return p.select("p_partkey", "s.*")


@register(f"""WITH w AS (SELECT p_partkey AS id, p_brand, list_filter(string_split_regex(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name, '\\s+'), lambda x: x <> '') AS p, list_filter(string_split_regex(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_type, '\\s+'), lambda x: x <> '') AS a FROM part),
 gp AS ({_grams("w", "p", 4)}), ga AS ({_grams("w", "a", 4)}), m AS (SELECT id, n, sum(least(gp.c, ga.c)) AS m FROM gp JOIN ga USING (id, n, gram) GROUP BY ALL),
 c AS (SELECT p_brand, n, sum(coalesce(m, 0)) AS m, sum(greatest(len(p) - n + 1, 0)) AS t, sum(len(p)) AS lp, sum(len(a)) AS la FROM w CROSS JOIN range(1, 5) r(n) LEFT JOIN m USING (id, n) GROUP BY ALL)
 SELECT p_brand, CASE WHEN min(m) > 0 THEN (CASE WHEN max(lp) > max(la) THEN 1.0 ELSE exp(1 - max(la) / CAST(max(lp) AS DOUBLE)) END) * exp(sum(ln(CASE WHEN m > 0 THEN m / CAST(t AS DOUBLE) ELSE 1 END)) / 4) ELSE 0.0 END AS bleu FROM c GROUP BY p_brand""")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name").alias("p"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_type").alias("a"))
    return M.corpus_bleu(p, ["p_brand"], "p", "a")


@register("""WITH w AS (SELECT conv_id, list_filter(string_split_regex(lower(string_agg(text, ' ' ORDER BY turn)), '\\s+'), lambda x: x <> '') AS w FROM conversations GROUP BY conv_id),
 g AS (SELECT conv_id, w[i] || ' ' || w[i+1] AS gram FROM (SELECT conv_id, w, unnest(range(1, len(w))) AS i FROM w)), t AS (SELECT conv_id, gram, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT gram, count(*) AS df FROM t GROUP BY gram)
 SELECT conv_id, gram, tf, round(tf * ln((SELECT count(DISTINCT conv_id)::DOUBLE FROM conversations) / df), 6) AS weight FROM t JOIN d USING (gram)""")
def cider_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    return M.cider_terms(c, "conv_id", F.col("t"), 2).withColumn("weight", F.round("weight", 6))


_CAPTIONS = "SELECT p_partkey AS id, lower(p_name || ' ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END) AS p, lower(p_type || ' ' || p_name || ' made') AS a FROM part"


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), p.alias("p"), F.concat_ws(" ", "p_type", "p_name", F.lit("made")).alias("a"))


@register(f"""WITH t AS ({_CAPTIONS}), w AS (SELECT id, list_filter(string_split(p, ' '), lambda x: x <> '') AS p, list_filter(string_split(a, ' '), lambda x: x <> '') AS a FROM t), gp AS ({_grams("w", "p", 4)}), ga AS ({_grams("w", "a", 4)}),
 df AS (SELECT n, gram, count(*) AS df FROM ga GROUP BY ALL), c AS (SELECT id, n, gram, coalesce(gp.c, 0) AS p, coalesce(ga.c, 0) AS a FROM gp FULL JOIN ga USING (id, n, gram)),
 x AS (SELECT id, n, p, a, ln((SELECT count(*) FROM part)::DOUBLE) - ln(greatest(coalesce(df, 0), 1)) AS w FROM c LEFT JOIN df USING (n, gram)),
 s AS (SELECT id, n, sum(least(p, a) * w * a * w) AS d, sqrt(sum(p * w * p * w)) AS np, sqrt(sum(a * w * a * w)) AS na FROM x GROUP BY ALL)
 SELECT id, round(10 * sum(CASE WHEN np > 0 AND na > 0 THEN d / (np * na) ELSE 0 END * exp(-(len(w.p) - len(w.a)) * (len(w.p) - len(w.a)) / 72.0::DOUBLE)) / 4, 8) AS cider FROM s JOIN w USING (id) GROUP BY id""")
def cider_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.cider(_captions(spark, sf_dir), "id", F.col("p"), F.col("a"))
    return got.withColumn("cider", F.round("cider", 8))


@register(f"""WITH t AS ({_CAPTIONS}), w AS (SELECT id, string_split(p, ' ') AS p, string_split(a, ' ') AS a FROM t), gp AS ({_grams("w", "p", 4)}), ga AS ({_grams("w", "a", 4)}), m AS (SELECT id, sum(least(gp.c, ga.c)) AS m FROM gp JOIN ga USING (id, n, gram) GROUP BY id)
 SELECT id, coalesce(m, 0) / greatest((SELECT sum(c) FROM gp WHERE gp.id = w.id), (SELECT sum(c) FROM ga WHERE ga.id = w.id)) AS gleu FROM w LEFT JOIN m USING (id)""")
def gleu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captions(spark, sf_dir).select("id", M.gleu_score(F.lower("p"), F.lower("a")).alias("gleu"))


@register("""SELECT p_partkey, p_name AS text, 1.0::DOUBLE AS ratio, 1.0::DOUBLE AS jaccard, true AS equal FROM part""")
def best_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of a longer text that is a name; tests hold near runs to their definition."""
    m = M.best_run_match("p_name", F.concat_ws(" ", "p_type", "p_name", "p_brand", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.text", "m.ratio", "m.jaccard", "m.equal")


@register("""SELECT event_id, '{"id": ' || user_id || ', "t": "' || event_type || '"}' AS first, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n FROM events""")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects within prose, broken ones before them and others after."""
    text = F.concat(F.lit('so {broken {"id":'), "user_id", F.lit(', "t":"'), "event_type", F.lit('"} and '), F.when(F.col("event_id") % 3 == 0, '{"more": {"x": 1}} end').otherwise("{ end"))
    e = table(spark, sf_dir, "events").select("event_id", M.embedded_objects(text).alias("o"))
    return e.select("event_id", F.col("o")[0].alias("first"), F.size("o").alias("n"))


@register("""WITH t AS (SELECT p_partkey, lower(p_name) AS p, lower(p_name[1] || p_name[3] || p_name[2] || p_name[4:] || repeat('x', p_size % 4)) AS a FROM part), s AS (SELECT p_partkey, 1 - damerau_levenshtein(p, a) / CAST(greatest(length(p), length(a)) AS DOUBLE) AS s FROM t)
 SELECT p_partkey, CASE WHEN s >= 0.9 THEN s ELSE 0 END AS score FROM s""")
def near_string_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with two letters swapped, an article in front and some letters behind."""
    n = F.col("p_name")
    other = F.concat(F.lit("The "), F.substring(n, 1, 1), F.substring(n, 3, 1), F.substring(n, 2, 1), F.substring(n, 4, 10_000), F.repeat(F.lit("x"), (F.col("p_size") % 4).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", M.near_string_score("p_name", other).alias("score"))


@register("""SELECT p_partkey, 1 - (CASE WHEN p_type = p_brand THEN 0 ELSE 1 END + 2 * (p_size % 3)) / CAST(7 + 2 * (p_size % 3) AS DOUBLE) AS score, 1 - (p_size % 3) / CAST(5 + p_size % 3 AS DOUBLE) AS structure FROM part""")
def tree_similarity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with one cell changed and none to two added; with and without the cells' text."""
    row = lambda a, b, more: F.concat(F.lit("<table><tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td>"), more, F.lit("</tr></table>"))
    p = table(spark, sf_dir, "part")
    more = F.repeat(F.lit("<td>new</td>"), (F.col("p_size") % 3).cast("int"))
    pair = (row("p_name", "p_type", F.lit("")), row("p_name", "p_brand", more))
    return p.select("p_partkey", M.tree_score(*pair).alias("score"), M.structure_score(*pair).alias("structure"))


@register("""WITH s AS (SELECT p_brand, greatest(0, 1 - (levenshtein(p_name, p_type) + levenshtein(CAST(p_size AS VARCHAR), CAST(p_size + p_partkey % 2 AS VARCHAR))) / CAST(2 + length(p_type) + length(CAST(p_size + p_partkey % 2 AS VARCHAR)) AS DOUBLE)) AS s FROM part)
 SELECT p_brand, sum(s) / (count(*) + 1e-6) AS accuracy FROM s GROUP BY p_brand""")
def record_tree_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two fields against ones with another name and size, averaged by brand."""
    record = lambda name, size: F.to_json(F.struct(size.alias("count"), name.alias("menu")))
    size = F.col("p_size")
    s = table(spark, sf_dir, "part").select("p_brand", M.record_score(record(F.col("p_name"), size), record(F.col("p_type"), size + F.col("p_partkey") % 2)).alias("s"))
    return s.groupBy("p_brand").agg((F.sum("s") / (F.count("*") + 1e-6)).alias("accuracy"))


@register("""SELECT o_orderkey, k < 2 AS fewer, k <> 1 AS any_of, k = 2 AS twice, k < 2 AS one_group, k = 2 AS second, k = 1 AS only_first, k = 3 AS acrostic, o_orderkey % 8 = 3 AS alliterating FROM (SELECT o_orderkey, o_orderkey % 4 AS k FROM orders)""")
def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints on phrases, sentences and lines, on four kinds of text."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    lines = F.when(F.col("o_orderkey") % 8 == 3, "cats creep\nall\ntwo the table").otherwise("cats and\nall\ntwo the table")
    text = F.when(k == 0, "The **cat** sleeps.").when(k == 1, "A dog barks! Concatenation.").when(k == 2, "The cat sits. The Cat and dog.").otherwise(lines)
    c = lambda name, x: S.CONSTRAINTS[name](text, x)
    return o.select(
        "o_orderkey", c("fewer_words", 6).alias("fewer"), c("contains_any", ["cat", "cats"]).alias("any_of"), c("contains_times", (["cat"], 2)).alias("twice"), c("contains_one_group", [["cat"], ["dog"]]).alias("one_group"),
        c("in_sentence", (["cat"], 2)).alias("second"), c("only_in_sentence", (["dog"], 1)).alias("only_first"), c("acrostic", "cat").alias("acrostic"), c("alliterating_acrostic", "cat").alias("alliterating"),
    )


@register(f"""WITH {REPLY} SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) <= 6 AS few_words, starts_with(text, 'The') AS begins, ends_with(text, '.') AS ends,
 len(regexp_extract_all(text, '[.!?](\\s|$)')) >= 1 AS has_sentence, NOT regexp_matches(text, '[0-9]') AS no_number FROM reply""")
def instruction_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints on a reply, as column predicates."""
    t = F.col("text")
    return reply(spark, sf_dir).select(
        "doc_id", (F.size(A.words(t)) <= 6).alias("few_words"), F.startswith(t, F.lit("The")).alias("begins"), F.endswith(t, F.lit(".")).alias("ends"),
        (F.regexp_count(t, F.lit(r"[.!?](\s|$)")) >= 1).alias("has_sentence"), (~t.rlike("[0-9]")).alias("no_number"),
    )


@register(f"""WITH {PRED} SELECT lang, source, CASE WHEN count(*) = sum(hit) THEN 1.0::DOUBLE ELSE 0 END AS all_right, greatest(0, 1 - abs(CAST(sum(hit) AS DOUBLE) - count(*)) / count(*)) AS closeness FROM pred GROUP BY ALL""")
def numeric_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pred(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    return m.select("lang", "source", F.when(F.col("n") == F.col("h"), 1.0).otherwise(0.0).alias("all_right"), A.relative_closeness(F.col("h").cast("double"), F.col("n").cast("double")).alias("closeness"))


@register(f"""WITH {PRED}, n AS (SELECT source, lang, count(*) AS n FROM pred GROUP BY ALL) SELECT source, CASE WHEN count_if(lang = 'fr' OR lang = 'de') = 0 THEN 1.0::DOUBLE ELSE 0 END AS equal, count_if(lang IN ('en', 'es')) / CAST(count(*) AS DOUBLE) AS precision, count_if(lang IN ('en', 'es')) / nullif(CAST(count_if(lang <> 'de') AS DOUBLE), 0) AS recall,
 count_if(lang <> 'fr') / CAST(count(*) AS DOUBLE) AS sets FROM n GROUP BY source""")
def map_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language against ones in which French differs and German is absent; lists of letters
    against them in another order, where French has one more."""
    n = pred(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))
    of = lambda v: F.map_from_entries(F.collect_list(F.struct("lang", v)))
    other = F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("lang") != "de", F.struct("lang", F.when(F.col("lang") == "fr", F.col("n") + 1).otherwise(F.col("n")))))))
    two, three = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"), F.lit("c"))
    m = n.groupBy("source").agg(of(F.col("n")).alias("p"), other.alias("t"), of(two).alias("ps"), of(F.when(F.col("lang") == "fr", three).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("a")))).alias("ts"))
    p, t = F.col("p"), F.col("t")
    return m.select("source", A.map_equal(p, t).alias("equal"), A.map_precision(p, t).alias("precision"), A.map_recall(p, t).alias("recall"), A.map_of_sets_equal(F.col("ps"), F.col("ts")).alias("sets"))


@register(f"""WITH {PRED}, k AS (SELECT source, map_from_entries(list((lang, CAST(n AS VARCHAR)))) AS p, map_from_entries(list((lang, CAST(CASE WHEN lang = 'fr' THEN n + 1 ELSE n END AS VARCHAR)))) AS t, count(*) AS keys, count_if(lang <> 'fr') AS same FROM (SELECT source, lang, count(*) AS n FROM pred GROUP BY ALL) GROUP BY source)
 SELECT source, CAST(keys AS INTEGER) AS keys, CAST(same AS DOUBLE) / keys AS jaccard FROM k""")
def map_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pred(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))
    entries = lambda v: F.map_from_entries(F.collect_list(F.struct("lang", v)))
    m = n.groupBy("source").agg(entries(F.col("n")).alias("p"), entries(F.when(F.col("lang") == "fr", F.col("n") + 1).otherwise(F.col("n"))).alias("t"))
    return m.select("source", F.size("p").alias("keys"), A.map_jaccard(F.col("p"), F.col("t")).alias("jaccard"))


@register(f"""WITH {REPLY}, h AS (SELECT doc_id, ('0x' || substr(md5('Score: ' || text), 1, 7))::BIGINT % 13 AS h FROM reply)
 SELECT doc_id, CASE WHEN h <= 10 THEN h / 10.0::DOUBLE ELSE 0 END AS score, CASE h WHEN 11 THEN 'no score in ''no idea''; no score in ''no idea''; ok' WHEN 12 THEN 'no score in ''no idea''; ok' ELSE 'ok' END AS log FROM h""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reply(spark, sf_dir).select("doc_id", "text")
    return J.judged(rows, F.concat(F.lit("Score: "), "text")).select("doc_id", "score", "log")


@register(f"""WITH {REPLY}, h AS (SELECT *, ('0x' || substr(md5(text), 1, 7))::BIGINT % 13 AS h FROM reply)
 SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 3) THEN prediction WHEN doc_id % 6 = 4 THEN 'Z' WHEN h <= 10 THEN printf('score: %.1f', h / 10.0::DOUBLE) ELSE 'no idea' END AS answer, CASE WHEN doc_id % 6 IN (0, 1, 3, 4) THEN 'rule' ELSE 'judge' END AS basis FROM h""")
def rule_then_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = J.rule_then_judge(reply(spark, sf_dir), A.choice_letter(F.col("text")), F.col("text"))
    return got.select("doc_id", "answer", "basis")


@register(f"WITH {PRED} SELECT doc_id, hit, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'known' END AS state FROM pred")
def keyed_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).select("doc_id", "hit")
    done = rows.filter("doc_id % 4 <> 0").withColumn("state", F.lit("known"))
    return J.with_memory(rows, done, "doc_id", lambda fresh: fresh.withColumn("state", F.lit("new")))


@register(f"""WITH {PRED} SELECT doc_id, 'Question: ' || category || chr(10) || 'Options:' || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'Answer:' AS prompt FROM pred""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array_join(F.transform(F.array(F.struct(F.lit("A").alias("k"), F.col("lang").alias("v")), F.struct(F.lit("B").alias("k"), F.col("source").alias("v"))), lambda x: F.concat_ws(". ", x["k"], x["v"])), "\n")
    return pred(spark, sf_dir).select("doc_id", F.concat(F.lit("Question: "), "category", F.lit("\nOptions:\n"), options, F.lit("\nAnswer:")).alias("prompt"))
