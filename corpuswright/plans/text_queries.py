"""Text queries: segmentation, filters, extraction, row metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.functions import answers as A
from corpuswright.functions.binding import runs_of
from corpuswright.operators.storage import stored
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import PRED, pred, table

_SEP, _BLANK = A.SEPARATORS, " " * len(A.SEPARATORS)

#: Replies made of scored rows: plain letters, sentences, refusals, several letters.
REPLY = f"""{PRED}, reply AS (SELECT doc_id, lang, answer, prediction, hit, n_chars, CASE doc_id % 6 WHEN 0 THEN prediction WHEN 1 THEN 'The answer is (' || prediction || ').' WHEN 2 THEN 'A or B, I think ' || prediction
 WHEN 3 THEN '<think>maybe ' || answer || '</think> so ' || prediction || '!' WHEN 4 THEN 'Cannot determine the answer' ELSE 'It is the ' || lang || ' text; Yes, no doubt' END AS text FROM pred)"""


def reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("doc_id") % 6, F.col("prediction")
    text = F.when(k == 0, p).when(k == 1, F.concat(F.lit("The answer is ("), p, F.lit(")."))).when(k == 2, F.concat(F.lit("A or B, I think "), p))
    text = text.when(k == 3, F.concat(F.lit("<think>maybe "), "answer", F.lit("</think> so "), p, F.lit("!"))).when(k == 4, F.lit("Cannot determine the answer"))
    text = text.otherwise(F.concat(F.lit("It is the "), "lang", F.lit(" text; Yes, no doubt")))
    return pred(spark, sf_dir).select("doc_id", "lang", "answer", "prediction", "hit", "n_chars", text.alias("text"))


@register(f"""WITH {REPLY}, t AS (SELECT *, list_filter(string_split(translate(text, '{_SEP}', '{_BLANK}'), ' '), lambda x: x <> '') AS w FROM reply),
 f AS (SELECT *, list_filter(['A','B','C','D'], lambda c: list_contains(w, c)) AS found FROM t)
 SELECT doc_id, CASE WHEN contains(text, 'Cannot determine the answer') THEN 'Z' WHEN len(found) = 1 AND list_position(list_reverse(w), found[1]) <= 5 THEN found[1] END AS letter FROM f""")
def choice_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply(spark, sf_dir).select("doc_id", A.choice_letter(F.col("text")).alias("letter"))


@register(f"""WITH {REPLY}, o AS (SELECT doc_id, text, ['text','answer','think','zzz'] AS opts FROM reply), h AS (SELECT doc_id, text, list_filter([1,2,3,4], lambda i: contains(lower(text), opts[i])) AS hits FROM o)
 SELECT doc_id, CASE WHEN length(text) <= 36 AND len(hits) = 1 THEN ['A','B','C','D'][hits[1]] END AS letter FROM h""")
def choice_text_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = {k: F.lit(v) for k, v in zip("ABCD", ("text", "answer", "think", "zzz"))}
    return reply(spark, sf_dir).select("doc_id", A.choice_text(F.col("text"), options).alias("letter"))


@register(f"""WITH {REPLY}, t AS (SELECT doc_id, list_filter(string_split(lower(translate(text, '{_SEP}', '{_BLANK}')), ' '), lambda x: x <> '') AS w FROM reply)
 SELECT doc_id, CASE WHEN list_contains(w, 'yes') AND NOT list_contains(w, 'no') THEN 'Yes' WHEN list_contains(w, 'no') AND NOT list_contains(w, 'yes') THEN 'No' ELSE 'Unknown' END AS verdict FROM t""")
def yes_no_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply(spark, sf_dir).select("doc_id", A.yes_no(F.col("text")).alias("verdict"))


@register(f"""WITH {PRED}, s AS (SELECT source, lang, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(answer || prediction || source), '.'), lambda c: c >= 'A' AND c <= 'Z'))), '') AS p,
 array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(prediction || 'src'), '.'), lambda c: c >= 'A' AND c <= 'Z'))), '') AS a FROM pred)
 SELECT lang, avg(CASE WHEN a = p THEN 1.0::DOUBLE ELSE 0 END) AS acc, count(*) AS total FROM s GROUP BY lang""")
def exact_set_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred(spark, sf_dir).select("lang", A.letter_set(F.concat("answer", "prediction", "source")).alias("p"), A.letter_set(F.concat("prediction", F.lit("src"))).alias("a"))
    return rows.groupBy("lang").agg(F.avg(F.when(F.col("a") == F.col("p"), 1.0).otherwise(0.0)).alias("acc"), F.count("*").alias("total"))


@register(f"""WITH {REPLY} SELECT doc_id, trim(string_split(text, '</think>')[-1]) AS prediction, CASE WHEN len(string_split(text, '</think>')) = 2 THEN trim(regexp_extract(text, '(?s)<think>(.*?)</think>', 1)) ELSE '' END AS thought FROM reply""")
def thinking_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply(spark, sf_dir).select("doc_id", A.after_thinking(F.col("text")).alias("prediction"), A.thinking(F.col("text")).alias("thought"))


_ANLS = "CASE WHEN greatest(length(p), length(a)) = 0 THEN 1 ELSE 1 - levenshtein(p, a) / CAST(greatest(length(p), length(a)) AS DOUBLE) END"


@register(f"""WITH n AS (SELECT p_partkey, lower(p_name) AS p, lower(p_type) AS a FROM part), s AS (SELECT p_partkey, {_ANLS} AS s FROM n)
 SELECT p_partkey, CASE WHEN s <= 0.5 THEN 0 ELSE s END AS anls FROM s""")
def anls_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", A.anls(F.col("p_name"), F.col("p_type")).alias("anls"))


@register("""WITH x AS (SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice * (1 + (o_orderkey % 11) / 100.0::DOUBLE) END AS p FROM orders)
 SELECT count_if(a <> 0 AND abs(p - a) / abs(a) <= 0.05)::BIGINT AS matches, count(*) AS total FROM x""")
def relaxed_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_totalprice")
    p = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise(a * (1 + (F.col("o_orderkey") % 11) / F.lit(100.0)))
    return table(spark, sf_dir, "orders").agg(F.count_if(A.relaxed_match(p.cast("string"), a.cast("string"))).alias("matches"), F.count("*").alias("total"))


@register("""WITH b AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') AS p, list_filter(string_split(lower(p_type || ' ' || p_name), ' '), lambda x: x <> '') AS a FROM part),
 s AS (SELECT p_partkey, len(list_filter(p, lambda x: list_contains(a, x))) / CAST(greatest(len(p), 1) AS DOUBLE) AS pr, len(list_filter(a, lambda x: list_contains(p, x))) / CAST(greatest(len(a), 1) AS DOUBLE) AS rc FROM b)
 SELECT p_partkey, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM s""")
def bow_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", A.bag_f1(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")).alias("f1"))


@register("""SELECT doc_id, pos - 1 AS pos, line FROM (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) AS pos FROM documents)""")
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@register(r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)figure[^:]*:|\.(png|jpe?g|gif)|<img|data:image|@')), chr(10)) AS kept FROM documents""")
def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"(?i)figure[^:]*:|\.(png|jpe?g|gif)|<img|data:image|@"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(kept, "\n").alias("kept"))


@register("SELECT lang, count(*) AS total FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[À-ÿ]') AND NOT regexp_matches(coalesce(source, ''), '[À-ÿ]') GROUP BY lang")
def script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a character of the script in any text column, counted."""
    docs = table(spark, sf_dir, "documents")
    for c in ("text", "source"):
        docs = docs.filter(~F.coalesce(F.col(c).rlike("[À-ÿ]"), F.lit(False)))
    return docs.groupBy("lang").agg(F.count("*").alias("total"))


_STRIP_TAGS = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n]+', ' ', 'g')"


@register(f"SELECT page_id, trim({_STRIP_TAGS}) AS text FROM pages")
def html_strip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"[ \t\n]+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(text).alias("text"))


@register("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \n]+'), lambda x: x <> '') AS w FROM documents), i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \n]+'), lambda x: x <> '') AS w FROM benchmark),
 dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w)), ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i))
 SELECT item_id, count(DISTINCT doc_id) AS docs, count(*) AS shared FROM dg JOIN ig USING (g) GROUP BY item_id""")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared five-word sequences of documents and benchmark items. The items' sequences are sent to the
    documents if they are few, so that only shared ones are shuffled."""

    def grams(t: DataFrame, key: str) -> DataFrame:
        return t.select(key, F.explode(F.array_distinct(runs_of(A.words(F.lower("text")), 5))).alias("g"))

    items = stored(grams(table(spark, sf_dir, "benchmark"), "item_id"), "item-grams")
    wanted = items.select("g").distinct()
    wanted = F.broadcast(wanted) if items.count() <= 1_000_000 else wanted
    met = grams(table(spark, sf_dir, "documents"), "doc_id").join(wanted, "g", "left_semi").join(items, "g")
    return met.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("shared"))


@register("SELECT md5(source || '||' || lang) AS section, count(*) AS n FROM documents GROUP BY ALL")
def section_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.concat_ws("||", "source", "lang")).alias("section")).agg(F.count("*").alias("n"))


@register(r"""WITH n AS (SELECT event_id, list_transform(regexp_extract_all(props, '-?\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE)) AS v FROM events)
 SELECT event_id, CAST(len(v) AS INTEGER) AS n, CASE WHEN len(list_filter(v, lambda x: abs(x) > 50)) > 0 THEN 'unstable' ELSE 'stable' END AS state FROM n""")
def number_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.numbers(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.size(v).alias("n"), F.when(F.exists(v, lambda x: F.abs(x) > 50), "unstable").otherwise("stable").alias("state"))


@register(f"""WITH {PRED}, a AS (SELECT lang, source, list_sort(list_distinct(list(answer))) AS t, list_sort(list_distinct(list(prediction))) AS p FROM pred GROUP BY ALL), s AS (SELECT *, list_intersect(p, t) AS i, list_distinct(list_concat(p, t)) AS u FROM a)
 SELECT lang, source, len(i) / CAST(len(u) AS DOUBLE) AS jaccard, len(i) / CAST(len(p) AS DOUBLE) AS precision, p = t AS equal FROM s""")
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pred(spark, sf_dir).groupBy("lang", "source").agg(F.collect_set("answer").alias("t"), F.collect_set("prediction").alias("p"))
    t, p = F.col("t"), F.col("p")
    return g.select("lang", "source", A.jaccard(p, t).alias("jaccard"), A.set_precision(p, t).alias("precision"), A.set_equal(p, t).alias("equal"))


@register("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, r, list_transform(r, lambda x: CASE WHEN x = 'system' THEN 'user' ELSE x END) AS t FROM c),
 e AS (SELECT conv_id, r, list_transform(list_zip(r, t), lambda z: z[1] = z[2]) AS same FROM s)
 SELECT conv_id, len(list_filter(same, lambda x: x)) / CAST(len(r) AS DOUBLE) AS accuracy, coalesce(nullif(list_position(same, false), 0) - 1, len(r)) / CAST(len(r) AS DOUBLE) AS prefix FROM e""")
def sequence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    t = F.transform("r", lambda x: F.when(x == "system", "user").otherwise(x))
    return c.select("conv_id", A.sequence_accuracy(F.col("r"), t).alias("accuracy"), A.prefix_ratio(F.col("r"), t).alias("prefix"))


@register("SELECT e.label, avg(list_cosine_similarity(e.embedding, c.embedding) >= 0.2) AS share, count(*) AS total FROM (SELECT label, embedding FROM embeddings) e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) c USING (label) GROUP BY e.label".replace("avg(list_cosine_similarity(e.embedding, c.embedding) >= 0.2)", "avg(CASE WHEN list_cosine_similarity(e.embedding, c.embedding) >= 0.2 THEN 1.0::DOUBLE ELSE 0 END)"))
def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of vectors close to their label's first vector."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot("embedding", "c") / F.sqrt(dot("embedding", "embedding") * dot("c", "c"))
    return e.join(first, "label").groupBy("label").agg(F.avg(F.when(cos >= 0.2, 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("total"))


@register(f"""WITH {REPLY} SELECT doc_id, lower(translate(text, ' -.' || chr(10) || chr(9), '')) AS simple, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key,
 coalesce(TRY_CAST(regexp_extract(lang || ' ' || (doc_id % 12) || ' x', '[0-9]+') AS INTEGER), -1) AS number FROM reply""")
def text_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    number = A.number_word(F.concat(F.col("lang"), F.lit(" "), F.col("doc_id") % 12, F.lit(" x")))
    return reply(spark, sf_dir).select("doc_id", A.simple_string(t).alias("simple"), A.key_normal(t).alias("key"), F.coalesce(number, F.lit(-1)).alias("number"))


@register(f"""WITH {REPLY}, j AS (SELECT doc_id, '```json' || chr(10) || '{{"answer": "' || answer || '", "n": ' || n_chars || '}}' || chr(10) || '```' AS raw FROM reply)
 SELECT doc_id, json_extract_string(substr(raw, 9, length(raw) - 12), '$.answer') AS answer, CAST(json_extract_string(substr(raw, 9, length(raw) - 12), '$.n') AS BIGINT) AS n FROM j""")
def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('```json\n{"answer": "'), "answer", F.lit('", "n": '), "n_chars", F.lit("}\n```"))
    parsed = F.from_json(A.json_payload(raw), "answer string, n long")
    return reply(spark, sf_dir).select("doc_id", parsed["answer"].alias("answer"), parsed["n"].alias("n"))


@register(f"""WITH {PRED}, q AS (SELECT doc_id, source || ' is it ' || lang || ' or caries and bone' AS q FROM pred)
 SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(q, 'src1') THEN 'one' END, CASE WHEN regexp_matches(q, 'fr|de') THEN 'foreign' END, CASE WHEN regexp_matches(q, 'xyz') THEN 'never' END], lambda x: x IS NOT NULL), ',') AS raw,
 coalesce(nullif(array_to_string(list_filter([CASE WHEN regexp_matches(q, 'src1') THEN 'one' END, CASE WHEN regexp_matches(q, 'fr|de') THEN 'foreign' END], lambda x: x IS NOT NULL), ','), ''), 'other') AS category FROM q""")
def question_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat("source", F.lit(" is it "), "lang", F.lit(" or caries and bone"))
    rules = [("one", "src1"), ("foreign", "fr|de"), ("never", "xyz")]
    raw = F.array_join(F.array_compact(F.array(*[F.when(q.rlike(p), F.lit(n)) for n, p in rules])), ",")
    return pred(spark, sf_dir).select("doc_id", raw.alias("raw"), F.when(raw == "", "other").otherwise(raw).alias("category"))


@register(f"""WITH {PRED} SELECT DISTINCT category, upper(source[1]) || source[2:] || ',' || upper(lang[1]) || lang[2:] || CASE WHEN lang IN ('en','de') THEN ',Germanic' ELSE '' END AS n FROM pred""")
def category_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("category", ",")
    more = F.when(F.arrays_overlap(parts, F.array(F.lit("en"), F.lit("de"))), F.array_append(parts, "germanic")).otherwise(parts)
    return pred(spark, sf_dir).select("category", F.array_join(F.transform(more, lambda x: F.initcap(x)), ",").alias("n")).distinct()


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '1:own ' || o_orderkey || ':a' || o_orderkey || ';2:Why?:' || o_orderpriority END AS pairs FROM orders""")
def payload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of pairs by level under alias keys; every fifth lacks an answer."""
    k = F.col("o_orderkey")
    second = F.when(k % 5 == 0, '{"level": 2, "answer": " "}').otherwise(F.concat(F.lit('{"Level": "2", "A": "'), "o_orderpriority", F.lit('"}')))
    listed = F.concat(F.lit('[{"level": 1, "answer": "old"}, {"level": "x"}, {"level": 1, "Q": "own '), k, F.lit('", "answer": "a'), k, F.lit('"}, '), second, F.lit("]"))
    payload = F.when(k % 2 == 0, listed).otherwise(F.concat(F.lit('{"items": '), listed, F.lit("}")))
    pairs = F.transform(A.validated_pairs(payload, {1: "What?", 2: "Why?"}), lambda p: F.concat_ws(":", p["level"], p["question"], p["answer"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(pairs, ";").alias("pairs"))
