"""Projection and report queries on derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuswright.functions import conversation as C
from corpuswright.operators import reports as P
from corpuswright.operators import rows as R
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import BOXES, PRED, boxes, pred, table


@register("""SELECT conv_id, coalesce(string_agg(CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END || ': ' || text, chr(10) ORDER BY turn) FILTER (role IN ('user', 'assistant')), '') AS turns FROM conversations GROUP BY conv_id""")
def role_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns under new names; roles without one are dropped."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(C.ordered_turns().alias("t"))
    new = R.rename_roles(F.col("t"), {"user": "human", "assistant": "gpt"})
    return t.select("conv_id", F.array_join(F.transform(new, lambda x: F.concat_ws(": ", x["from"], x["value"])), "\n").alias("turns"))


@register("SELECT doc_id, '[{\"from\":\"human\",\"value\":\"<image> ' || source || '\"},{\"from\":\"gpt\",\"value\":\"' || lang || '\"}]' AS conversations FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def qa_to_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer of valid rows as a two-turn conversation."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")
    return d.select("doc_id", F.to_json(R.turns_of(("human", F.concat(F.lit("<image> "), "source")), ("gpt", F.col("lang")))).alias("conversations"))


@register(f"""WITH {PRED} SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND quality = 1 THEN prediction || '|' WHEN doc_id % 3 = 0 THEN '|' || prediction WHEN doc_id % 3 = 1 THEN answer || '|' || prediction ELSE prediction END AS responses FROM pred""")
def preference_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a, p = F.col("doc_id") % 3, F.col("answer"), F.col("prediction")
    liked = F.when(k == 0, F.col("quality") == 1)
    pair = R.preference_pair(p, F.when(k == 1, a), F.when(k == 1, p), liked, ranking=True)
    return pred(spark, sf_dir).select("doc_id", F.array_join(pair, "|").alias("responses"))


@register(f"WITH {PRED} SELECT row_number() OVER (ORDER BY doc_id) AS idx, doc_id FROM pred WHERE (contains(category, 'src1') OR contains(category, 'fr')) AND NOT contains(lower(source), 'src11')")
def keyword_filter_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuswright.operators.ordering import rank_all

    kept = pred(spark, sf_dir).filter(R.any_keyword(F.col("category"), ["src1", "fr"]) & R.lacks(F.col("source"), "SRC11")).select("doc_id")
    return rank_all(kept, ["doc_id"], "idx").select((F.col("idx") + 1).alias("idx"), "doc_id")


@register("SELECT CASE source WHEN 'src1' THEN 'one' WHEN 'src2' THEN 'two' ELSE source END AS category, replace(CASE WHEN contains(lang, 'e') THEN lang || ' and jaw,x' ELSE lang END, 'jaw,', '') AS tag, count(*) AS n FROM documents GROUP BY ALL")
def category_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.contains("lang", F.lit("e")), F.concat("lang", F.lit(" and jaw,x"))).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").groupBy(R.remap(F.col("source"), {"src1": "one", "src2": "two"}).alias("category"), F.replace(raw, F.lit("jaw,"), F.lit("")).alias("tag")).agg(F.count("*").alias("n"))


@register("WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', chr(10) || '---' || chr(10)), chr(10) || '---' || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS s FROM documents) SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(s[1]) AS first FROM s")
def dash_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.segments(F.replace("text", F.lit(". "), F.lit("\n---\n")))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.get("s", F.lit(0))).alias("first"))


@register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(The|Th)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l)
 SELECT doc_id, CAST(section AS BIGINT) AS section, md5(string_agg(line, chr(10) ORDER BY pos)) AS body, count(*) AS n_lines FROM m GROUP BY doc_id, section""")
def chapter_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return R.sections(lines, "doc_id", "pos", "line", "^(The|Th)").select("doc_id", "section", F.md5("line").alias("body"), "n_lines")


@register("""WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), w AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS now, 0::BIGINT AS n, NULL::BIGINT AS longest FROM p UNION ALL
 SELECT doc_id, i + 1, CASE WHEN now = 0 THEN l WHEN now + l + 2 <= 2000 THEN now + 2 + l ELSE l END, CASE WHEN now = 0 OR now + l + 2 <= 2000 THEN n ELSE n + 1 END, CASE WHEN now = 0 OR now + l + 2 <= 2000 THEN longest ELSE greatest(coalesce(longest, 0), now) END
 FROM (SELECT w.*, length(p.p[i + 1]) AS l FROM w JOIN p USING (doc_id) WHERE i < len(p.p)))
 SELECT doc_id, CAST(n + CASE WHEN now > 0 THEN 1 ELSE 0 END AS INTEGER) AS n, CAST(CASE WHEN now > 0 THEN greatest(coalesce(longest, 0), now) ELSE longest END AS INTEGER) AS longest FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1""")
def paragraph_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", R.pack_paragraphs(F.split("text", "\n"), 2000).alias("packs"))
    return d.select("doc_id", F.size("packs").alias("n"), F.array_max(F.transform("packs", lambda x: F.length(x))).alias("longest"))


@register("SELECT image_id, '<p><box>[' || CAST(floor(x1 * 0.5) AS INTEGER) || ',' || CAST(floor(y1 * 2) AS INTEGER) || ',' || CAST(floor(x2 * 0.5) AS INTEGER) || ',' || CAST(floor(y2 * 2) AS INTEGER) || ']</box> end' AS text FROM (SELECT l_orderkey AS image_id, l_partkey % 100 AS x1, l_suppkey % 100 AS y1, l_partkey % 100 + l_quantity AS x2, l_suppkey % 100 + l_quantity * 2 AS y2 FROM lineitem)")
def box_rescale_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    text = F.concat(F.lit("<p><box>["), F.concat_ws(",", *[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")]), F.lit("]</box> end"))
    return b.select("image_id", R.rescale_boxes(text, F.lit(0.5), F.lit(2.0)).alias("text"))


@register(f"""WITH {BOXES}, c AS (SELECT image_id, label, count(*) AS n, array_to_string(list_sort(list(CAST(CAST((x1 + x2) AS BIGINT) AS VARCHAR))), ';') AS centres FROM boxes GROUP BY ALL) SELECT image_id, array_to_string(list(label || '=' || n || ':' || centres ORDER BY label), ' ') AS summary, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY image_id""")
def annotation_denormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per image: the count of each label with its boxes' centres (doubled, whole)."""
    c = boxes(spark, sf_dir).groupBy("image_id", "label").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list((F.col("x1") + F.col("x2")).cast("long").cast("string"))), ";").alias("centres"))
    line = F.concat("label", F.lit("="), "n", F.lit(":"), "centres")
    return c.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", line.alias("t")))), lambda x: x["t"]), " ").alias("summary"), F.sum("n").alias("total"))


@register(f"""WITH {BOXES}, s AS (SELECT image_id, det_id, 'A ' || label || ' region of width ' || CAST(CAST(x2 - x1 AS BIGINT) AS VARCHAR) AS sentence FROM boxes), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY image_id, sentence ORDER BY det_id) = 1)
 SELECT image_id, string_agg(sentence, '. ' ORDER BY det_id) AS caption, count(*) AS n FROM f GROUP BY image_id""")
def grounded_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = boxes(spark, sf_dir).select("image_id", "det_id", F.concat(F.lit("A "), "label", F.lit(" region of width "), (F.col("x2") - F.col("x1")).cast("long")).alias("sentence"))
    first = s.groupBy("image_id", "sentence").agg(F.min("det_id").alias("det_id"))
    return first.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("det_id", "sentence"))), lambda x: x["sentence"]), ". ").alias("caption"), F.count("*").alias("n"))


@register("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS a, CASE WHEN p_partkey % 2 = 0 THEN 'Other Answers' ELSE p_brand END AS b FROM part")
def open_to_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open questions become two-option ones: a null option A is the answer."""
    option = F.when(F.col("p_partkey") % 2 == 1, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(option, "p_name").alias("a"), F.when(option.isNull(), "Other Answers").otherwise(F.col("p_brand")).alias("b"))


@register("SELECT p_partkey, CAST(round_even(p_retailprice / 2, 0) AS BIGINT) AS half, CAST(round_even(p_size / 4.0::DOUBLE, 0) AS BIGINT) AS quarter FROM part")
def box_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-even rounding to whole numbers."""
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(F.col("p_retailprice") / 2).cast("long").alias("half"), F.bround(F.col("p_size") / F.lit(4.0)).cast("long").alias("quarter"))


@register("""WITH w AS (SELECT o_orderkey, o_orderkey % 7 AS r, unnest(range(0, 33)) AS v FROM orders), d AS (SELECT o_orderkey, r, list(v ORDER BY md5(o_orderkey || ':' || v), v)[1:3] AS wrong FROM w WHERE v <> r GROUP BY ALL),
 m AS (SELECT o_orderkey, r, list_transform(list_sort(list_transform(list_append(wrong, r), lambda x: {'h': md5(o_orderkey || '/' || x), 'v': x})), lambda y: y.v) AS options FROM d)
 SELECT o_orderkey, array_to_string(options, ',') AS options, chr(CAST(64 + list_position(options, r) AS INTEGER)) AS answer FROM m""")
def count_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting questions with three wrong counts, mixed by hash."""
    key, right = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 7).cast("int")
    m = R.multiple_choice(right, R.distractors(right, 0, 32, 3, key), key)
    return table(spark, sf_dir, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.array_join(F.col("m.options").cast("array<string>"), ",").alias("options"), F.col("m.answer").alias("answer"))


@register("""WITH k AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents),
 s AS (SELECT d.doc_id, string_agg(k.source, '|' ORDER BY k.k) AS shots FROM documents d JOIN k ON k.lang = d.lang AND k.doc_id <> d.doc_id AND k.k <= 4
  AND k.k <= 3 + (SELECT count(*) FROM k o WHERE o.doc_id = d.doc_id AND o.k <= 3) GROUP BY d.doc_id)
 SELECT doc_id, coalesce(shots, '') || '|' || source AS prompt FROM documents LEFT JOIN s USING (doc_id)""")
def few_shot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three others of its language in front, drawn from the whole table."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    got = R.few_shot(d, d, "lang", "doc_id", "source", 3)
    return got.select("doc_id", F.concat(F.array_join(F.coalesce("shots", F.array()), "|"), F.lit("|"), "source").alias("prompt"))


@register("SELECT c_custkey, (['How?', 'What is it?', 'Describe it.'])[CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 7))::BIGINT % 3 + 1 AS INTEGER)] AS question FROM customer")
def template_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.pick_template(["How?", "What is it?", "Describe it."], F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.alias("question"))


@register(f"""WITH {PRED}, m AS (SELECT lang, avg(hit) AS a, avg(quality) AS b, avg(CASE WHEN toxic = 1 THEN hit END) AS c FROM pred GROUP BY lang) SELECT lang, printf('%.2f', a) || ' & ' || printf('%.2f', b) || ' & ' || coalesce(printf('%.2f', c), 'NaN') AS latex FROM m""")
def latex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pred(spark, sf_dir).groupBy("lang").agg(F.avg("hit").alias("a"), F.avg("quality").alias("b"), F.avg(F.when(F.col("toxic") == 1, F.col("hit"))).alias("c"))
    return m.select("lang", R.latex_row([F.col(c) for c in "abc"]).alias("latex"))


@register(f"""WITH {PRED}, k AS (SELECT lang, doc_id // 4 AS grp, count(*) AS n, count_if(hit = 1) AS h FROM pred GROUP BY ALL) SELECT lang, count(*) AS groups, sum(CASE WHEN n = 4 AND h = 4 THEN 1 ELSE 0 END)::BIGINT AS consistent, CAST(sum(CASE WHEN n = 4 AND h = 4 THEN 1 ELSE 0 END) AS DOUBLE) / (sum(n) / 4.0::DOUBLE) AS score FROM k GROUP BY lang""")
def document_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = pred(spark, sf_dir).groupBy("lang", F.expr("doc_id div 4").alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("hit") == 1).alias("h"))
    full = F.sum(F.when((F.col("n") == 4) & (F.col("h") == 4), 1).otherwise(0))
    return k.groupBy("lang").agg(F.count("*").alias("groups"), full.alias("consistent"), (full / (F.sum("n") / F.lit(4.0))).alias("score"))


@register(f"""WITH {PRED}, v AS (SELECT doc_id // 2 AS q, lang, CASE WHEN doc_id % 2 = 1 THEN -1 ELSE 1 END * (ascii(answer) - ascii(prediction)) AS r FROM pred), m AS (SELECT q, lang, avg(r) AS r FROM v GROUP BY ALL)
 SELECT lang, avg(r) AS reward, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, count(*) AS n FROM m GROUP BY lang""")
def dual_order_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both orders of a pair merged: swapped verdicts are negated, then averaged."""
    rows = pred(spark, sf_dir)
    v = R.dual_order(rows, F.ascii("answer") - F.ascii("prediction"), F.col("doc_id") % 2 == 1)
    m = rows.groupBy(F.expr("doc_id div 2").alias("q"), "lang").agg(F.avg(v).alias("r"))
    return m.groupBy("lang").agg(F.avg("r").alias("reward"), P.share(F.col("r") > 0).alias("win_rate"), F.count("*").alias("n"))


@register(f"""WITH {PRED}, e AS (SELECT unnest(list_distinct([substr(source, 1, 4), lang])) AS skill, hit FROM pred), g AS (SELECT skill, count(*) AS total, sum(hit) AS ok FROM e GROUP BY skill)
 SELECT skill, total, round(CAST(ok AS DOUBLE) / total * 100, 1) AS success FROM g""")
def skill_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pred(spark, sf_dir).select(F.explode(F.array_distinct(F.array(F.substring("source", 1, 4), F.col("lang")))).alias("skill"), "hit")
    return e.groupBy("skill").agg(F.count("*").alias("total"), F.round(F.sum("hit") / F.count("*") * 100, 1).alias("success"))


@register("""WITH m AS (SELECT l_orderkey AS id, max(l_tax) AS hi, 1 - min(l_discount) AS lo, avg(l_discount) AS mid FROM lineitem GROUP BY ALL) SELECT id, CASE id % 3 WHEN 0 THEN round(mid, 9) WHEN 1 THEN greatest(round(lo, 9), 0.5) ELSE hi END AS reduced FROM m""")
def hit_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match lists to one value by kind: mean, floor of the complement, or largest."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.avg("l_discount").alias("mid"), (1 - F.min("l_discount")).alias("lo"), F.max("l_tax").alias("hi"))
    k = F.col("id") % 3
    return m.select("id", F.when(k == 0, F.round("mid", 9)).when(k == 1, F.greatest(F.round("lo", 9), F.lit(0.5))).otherwise(F.col("hi")).alias("reduced"))


@register("""SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY coalesce(TRY_CAST(regexp_extract(o_orderpriority, '[0-9]+') AS INTEGER), 1000000000), o_orderpriority, o_orderkey), ',') AS stages FROM orders GROUP BY o_custkey""")
def patient_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a patient in order: by number, name, key."""
    number = F.coalesce(F.regexp_extract("o_orderpriority", "[0-9]+", 0).try_cast("int"), F.lit(10**9))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(number.alias("n"), "o_orderpriority", "o_orderkey"))).alias("s"))
    return o.select("o_custkey", F.array_join(F.transform("s", lambda x: x["o_orderkey"].cast("string")), ",").alias("stages"))


@register("""WITH f AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM events),
 g AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id, block ORDER BY event_id) AS head FROM f) SELECT user_id, CAST(max(block) AS BIGINT) AS blocks, count(*) AS n FROM g GROUP BY user_id""")
def block_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running blocks: a row of one kind begins a block that the following rows continue."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    f = table(spark, sf_dir, "events").withColumn("block", F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).over(w))
    return f.groupBy("user_id").agg(F.max("block").alias("blocks"), F.count("*").alias("n"))


@register("""WITH p AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS n, label FROM embeddings) SELECT label, count(*) AS total, round(avg(n), 4) AS mean_square FROM p GROUP BY label""")
def mean_squared_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("total"), F.round(F.avg(n), 4).alias("mean_square"))


@register("""SELECT c_custkey, round(exp(-(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(s - c) / 2), 2) + cos(radians(c)) * cos(radians(s)) * pow(sin(radians(l) / 2), 2)))) / 100), 6) AS closeness FROM (SELECT c_custkey, CAST(c_custkey % 60 AS DOUBLE) AS c, CAST(c_nationkey AS DOUBLE) AS s, (c_custkey % 7) / 10.0::DOUBLE AS l FROM customer)""")
def geo_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = R.haversine_km((F.col("c_custkey") % 60).cast("double"), F.lit(0.0), F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 7) / F.lit(10.0))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.exp(-km / 100), 6).alias("closeness"))


@register("""WITH g AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_returnflag))) AS t, list_sort(list_distinct(list(CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE l_returnflag END))) AS p FROM lineitem GROUP BY ALL)
 SELECT id, array_to_string(list_filter(t, lambda x: list_contains(p, x)), ',') AS found, array_to_string(list_filter(t, lambda x: NOT list_contains(p, x)), ',') AS missed FROM g""")
def found_and_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise(F.col("l_returnflag"))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("t"), F.collect_set(p).alias("p"))
    return g.select("id", F.array_join(F.array_intersect("t", "p"), ",").alias("found"), F.array_join(F.array_except("t", "p"), ",").alias("missed"))


@register("SELECT page_id, CASE WHEN length(url) > 0 THEN substr(url, 1, CAST(floor(length(url) / 2) AS INTEGER)) END AS a, substr(url, CAST(floor(length(url) / 2) AS INTEGER) + 1) AS b FROM pages")
def midpoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a newline are cut in the middle."""
    return table(spark, sf_dir, "pages").select("page_id", R.split_at_middle(F.col("url")).alias("s")).select("page_id", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))


@register("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN r[-1] = 'assistant' THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || t[-1] ELSE t[-1] END AS last FROM c""")
def reasoning_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(C.ordered_turns().alias("t"))
    return c.select("conv_id", F.element_at(R.without_history_thoughts(F.col("t")), -1)["content"].alias("last"))


@register("""WITH s AS (SELECT DISTINCT source, CASE WHEN regexp_matches(source, '^src1[0-9]$') THEN 'teens' WHEN regexp_matches(source, '^src[0-4]$') THEN 'low' ELSE source END AS name FROM documents) SELECT name, count(*) AS n FROM s GROUP BY name""")
def equivalence_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("source").distinct()
    return s.groupBy(R.canonical(F.col("source"), {"^src1[0-9]$": "teens", "^src[0-4]$": "low"}).alias("name")).agg(F.count("*").alias("n"))


@register("""WITH x AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), y AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), j AS (SELECT x.v AS a, y.v AS b FROM x JOIN y USING (k)) SELECT avg(CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS n FROM j""")
def reward_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    y = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return R.pairwise_attach(x, y, ["k"], "v").agg(R.reward_accuracy(F.col("a"), F.col("b")).alias("accuracy"), F.count("*").alias("n"))


@register("""SELECT l_orderkey AS id, round(exp(avg(l_discount + l_tax)), 6) AS perplexity FROM lineitem GROUP BY l_orderkey""")
def perplexity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_discount") + F.col("l_tax")).alias("x"))
    return g.select("id", F.round(R.perplexity(F.col("x")), 6).alias("perplexity"))


@register("""SELECT o_orderkey, 'success' AS status, o_orderpriority AS answer FROM orders WHERE o_orderstatus <> 'F'""")
def status_gated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").otherwise("")
    one = F.struct(status.alias("status"), F.lit("which?").alias("question"), F.col("o_orderpriority").alias("answer"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(R.answered(F.create_map(F.lit("stage"), one))).alias("e"))
    return o.select("o_orderkey", F.lit("success").alias("status"), F.col("e.value.answer").alias("answer"))


@register("""WITH t AS (SELECT page_id, 'Teeth: [' || page_id || '] Bones: [x' || page_id % 3 || '] Teeth: [z' || page_id % 5 || ']' AS c FROM pages) SELECT page_id, '[z' || page_id % 5 || ']' AS teeth, '[x' || page_id % 3 || ']' AS bones FROM t""")
def caption_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caption's sections as fields; of equal names the last counts."""
    p = F.col("page_id")
    text = F.concat(F.lit("Teeth: ["), p, F.lit("] Bones: [x"), p % 3, F.lit("] Teeth: [z"), p % 5, F.lit("]"))
    s = table(spark, sf_dir, "pages").select("page_id", R.caption_sections(text).alias("s"))
    return s.select("page_id", F.col("s")["Teeth"].alias("teeth"), F.col("s")["Bones"].alias("bones"))


@register(f"""WITH {PRED}, c AS (SELECT lang, CASE WHEN len(regexp_extract_all(answer || prediction, '[A-D]')) > 1 AND answer <> prediction THEN 0 ELSE 1 END AS hit FROM pred) SELECT lang, avg(CAST(hit AS DOUBLE)) AS acc, count(*) AS total FROM c GROUP BY lang""")
def group_choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that name several different options are wrong."""
    several = F.size(F.array_distinct(F.regexp_extract_all(F.concat("answer", "prediction"), F.lit("[A-D]"), F.lit(0)))) > 1
    return pred(spark, sf_dir).groupBy("lang").agg(F.avg(F.when(several, 0.0).otherwise(1.0)).alias("acc"), F.count("*").alias("total"))


@register(f"""WITH {PRED}, s AS (SELECT source, CASE WHEN source < 'src14' THEN avg(hit) ELSE CAST(max(hit) AS DOUBLE) END AS s FROM pred GROUP BY source) SELECT CASE WHEN source < 'src14' THEN 'mean' ELSE 'max' END AS kind, round(avg(s), 9) AS score, count(*) AS sources FROM s GROUP BY ALL""")
def mixed_metric_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources scored by their own rule, then averaged by rule."""
    s = pred(spark, sf_dir).groupBy("source").agg(F.when(F.col("source") < "src14", F.avg("hit")).otherwise(F.max("hit").cast("double")).alias("s"))
    return s.groupBy(F.when(F.col("source") < "src14", "mean").otherwise("max").alias("kind")).agg(F.round(F.avg("s"), 9).alias("score"), F.count("*").alias("sources"))


@register(f"""WITH {PRED} SELECT source, array_to_string(list(CAST(hit AS VARCHAR) ORDER BY doc_id), '') AS marks, avg(hit) AS acc FROM pred GROUP BY source UNION ALL SELECT 'Average', '', avg(hit) FROM pred""")
def subject_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and wrong in order for each subject, and the micro average."""
    rows = pred(spark, sf_dir)
    marks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "hit"))), lambda x: x["hit"].cast("string")), "")
    each = rows.groupBy("source").agg(marks.alias("marks"), F.avg("hit").alias("acc"))
    return each.unionByName(rows.agg(F.avg("hit").alias("acc")).select(F.lit("Average").alias("source"), F.lit("").alias("marks"), "acc"))


@register("SELECT o_orderstatus AS status, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 4) AS percent FROM orders GROUP BY ALL")
def pipeline_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    counts = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the few statuses
    return counts.select("status", "n", F.round(100.0 * F.col("n") / total, 4).alias("percent"))


@register(f"""WITH {BOXES}, k AS (SELECT image_id, label, CASE WHEN x2 <= x1 THEN -1 WHEN 40 BETWEEN x1 AND x2 AND 60 BETWEEN y1 AND y2 THEN 1 ELSE 0 END AS r FROM boxes) SELECT label, CAST(sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS BIGINT) AS inside, CAST(sum(CASE WHEN r = 0 THEN 1 ELSE 0 END) AS BIGINT) AS outside, CAST(sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) AS BIGINT) AS malformed FROM k GROUP BY label""")
def click_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks against boxes: inside, outside, malformed."""
    from corpuswright.functions import geometry as G

    r = F.when(F.col("x2") <= F.col("x1"), -1).when(G.contains_point(G.box(), F.lit(40), F.lit(60)), 1).otherwise(0)
    n = lambda v: F.count_if(F.col("r") == v)
    return boxes(spark, sf_dir).withColumn("r", r).groupBy("label").agg(n(1).alias("inside"), n(0).alias("outside"), n(-1).alias("malformed"))


@register(f"""WITH {BOXES}, c AS (SELECT image_id, count(*) AS got, count(DISTINCT label) AS want, avg(CASE WHEN score > 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS loc FROM boxes GROUP BY image_id) SELECT image_id, round(sqrt(loc * greatest(0, 1 - abs(got - want) / CAST(want AS DOUBLE))), 9) AS score FROM c""")
def cluster_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of localisation accuracy times the count's closeness."""
    c = boxes(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("got"), F.countDistinct("label").alias("want"), P.share(F.col("score") > 0.5).alias("loc"))
    penalty = F.greatest(F.lit(0.0), 1 - F.abs(F.col("got") - F.col("want")) / F.col("want"))
    return c.select("image_id", F.round(F.sqrt(F.col("loc") * penalty), 9).alias("score"))


@register("SELECT c_custkey, '[\"' || c_mktsegment || '\",\"' || c_name || '\"]' AS call FROM customer")
def schema_call_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as JSON text, as in a rendered call."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.array("c_mktsegment", "c_name")).alias("call"))


@register("SELECT event_id, strftime(ts, '%y%m%d%H%M%S') AS stamp, strftime(ts, '%y%m%d') AS day FROM events")
def run_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyMMddHHmmss").alias("stamp"), F.date_format("ts", "yyMMdd").alias("day"))


@register("WITH p AS (SELECT user_id, count(*) AS done, (epoch(max(ts)) - epoch(min(ts))) / count(*) AS per FROM events GROUP BY user_id) SELECT user_id, done, round(per * (500 - done), 3) AS remaining FROM p")
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time left at the average pace so far, of 500 steps."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("done"), ((F.max(t) - F.min(t)) / F.count("*")).alias("per"))
    return p.select("user_id", "done", F.round(F.col("per") * (500 - F.col("done")), 3).alias("remaining"))


@register("SELECT doc_id, source || '/' || lang AS tag, contains(source, '1') OR contains(source, '2') AS listed, TRY_CAST(substr(source, 4) AS INTEGER) IS NOT NULL AS numbered FROM documents")
def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang").alias("tag"), R.any_keyword(F.col("source"), ["1", "2"]).alias("listed"), F.substring("source", 4, 9).try_cast("int").isNotNull().alias("numbered"))


@register("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS caption, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages WHERE contains(html, '<title>')")
def caption_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a caption tag: its body and the number of paragraphs."""
    p = table(spark, sf_dir, "pages").filter(F.contains("html", F.lit("<title>")))
    return p.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("caption"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@register("SELECT conv_id, list(turn ORDER BY turn)[1] AS first_turn, CASE WHEN conv_id % 3 = 0 THEN 'media/' || conv_id || '.png' ELSE CAST(conv_id AS VARCHAR) || '.png' END AS image FROM conversations GROUP BY conv_id")
def media_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media paths get their folder only if the file is listed there (here: a semi join)."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn")).withColumn("image", F.concat(F.col("conv_id"), F.lit(".png")))
    listed = c.filter("conv_id % 3 = 0").select(F.col("image").alias("there"))
    return c.join(listed, F.col("image") == F.col("there"), "left").select("conv_id", "first_turn", F.when(F.col("there").isNotNull(), F.concat(F.lit("media/"), "image")).otherwise(F.col("image")).alias("image"))
