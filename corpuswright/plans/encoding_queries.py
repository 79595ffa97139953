"""Templates, tool calls and training rows of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.functions import conversation as C
from corpuswright.functions import encoding as E
from corpuswright.functions import tool_calls as T
from corpuswright.functions.templates import TEMPLATES, Template, fill
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import table


def lengths(text: Column) -> Column:
    """An encoder that SQL has too: the length of each word."""
    return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.length(w))


_IDS = "list_transform(list_filter(string_split({}, ' '), lambda w: w <> ''), lambda w: length(w))"
_ALL = "list_transform(range({}), lambda i: -100)"


def shown(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


@register("SELECT c_custkey, 'Dear ' || c_name || ', nation ' || c_nationkey || ' {{name}} {{other}}' AS text FROM customer")
def slot_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named places; a second place of a name and unknown names stay."""
    text = fill("Dear {{name}}, nation {{nation}} {{name}} {{other}}", name=F.col("c_name"), nation=F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


_TURNS = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) FILTER (role <> 'system') AS t, coalesce(max(text) FILTER (role = 'system'), '') AS s FROM conversations GROUP BY conv_id"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(C.ordered_turns().alias("all"))
    return t.select("conv_id", F.filter("all", lambda x: x["role"] != "system").alias("t"), F.coalesce(F.get(F.filter("all", lambda x: x["role"] == "system"), F.lit(0))["content"], F.lit("")).alias("s"))


@register(f"""WITH t AS ({_TURNS}), x AS (SELECT conv_id, CASE WHEN s = '' THEN '' ELSE '<|im_start|>system' || chr(10) || s || '<|im_end|>' || chr(10) END AS lead, list_transform(t, lambda x: CASE x.role WHEN 'user' THEN '<|im_start|>user' || chr(10) || x.content || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE x.content || '<|im_end|>' || chr(10) END) AS p FROM t)
 SELECT conv_id, CASE WHEN len(p) = 0 THEN '' ELSE lead || array_to_string(p, '') END AS rendered FROM x""")
def template_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", TEMPLATES["chatml"].render(F.col("t"), F.col("s")).alias("rendered"))


@register(f"""WITH t AS ({_TURNS}), x AS (SELECT conv_id, CASE WHEN s = '' THEN '' ELSE s || chr(10) || chr(10) END AS lead, list_transform(t, lambda x, i: CASE x.role WHEN 'user' THEN '[INST] ' || CASE WHEN i = 1 THEN '@@' ELSE '' END || x.content || '[/INST]' ELSE ' ' || CASE WHEN i = 1 THEN '@@' ELSE '' END || x.content || '</s>' END) AS p FROM t)
 SELECT conv_id, CASE WHEN len(p) = 0 THEN '' ELSE replace('<s>' || array_to_string(p, ''), '@@', lead) END AS rendered FROM x""")
def template_mistral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system message within the first turn."""
    return _turns(spark, sf_dir).select("conv_id", TEMPLATES["mistral"].render(F.col("t"), F.col("s")).alias("rendered"))


def _dialect(name: str, text: str, broken: str) -> None:
    """A query that reads calls written in a dialect by hand; every fifth text is broken."""
    want = f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type || ':' || '{{"id": ' || user_id || ', "on": "' || event_type || '"}}' END AS calls, CASE WHEN event_id % 5 = 0 THEN {broken} END AS plain FROM events"""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events").withColumn("good", F.expr(text)).withColumn("bad", F.expr(broken.replace("chr(10)", "'\n'")))
        e = e.withColumn("text", F.when(F.col("event_id") % 5 == 0, F.col("bad")).otherwise(F.col("good"))).withColumn("found", T.calls(F.col("text"), name))
        joined = F.array_join(F.transform("found", lambda c: F.concat_ws(":", c["name"], c["arguments"])), ";")
        return e.select("event_id", F.when(F.col("found").isNotNull(), joined).alias("calls"), F.when(F.col("found").isNull(), F.col("text")).alias("plain"))

    query.__name__ = f"tool_dialect_{name}"
    register(want)(query)


_ARGS = "concat('{\"id\":', user_id, ', \"on\" : \"', event_type, '\"}')"
_dialect("actions", f"concat('Action: ', event_type, '\\n', 'Action Input: ', {_ARGS}, '\\n')", "'Action: ' || event_type || chr(10) || 'Action Input: {broken'")
_dialect("name_line", f"concat(event_type, '\\n', {_ARGS})", "event_type || ' ' || user_id")
_dialect("parameters", f"concat('{{\"name\": \"', event_type, '\", \"parameters\": ', {_ARGS}, '}}')", "'{\"name\": \"' || event_type || '\"}'")
_dialect("arguments", f"concat('[{{\"name\": \"', event_type, '\", \"arguments\": ', {_ARGS}, '}}]')", "'[{\"name\": \"' || event_type || '\", ]'")
_dialect("tagged", f"concat('<tool_call>\\n{{\"name\": \"', event_type, '\", \"arguments\": ', {_ARGS}, '}}\\n</tool_call>')", "'<tool_call>' || event_type || '</tool_call>'")


@register("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE '<think>' || event_type || '</think>' || '<tool_call>' || chr(10) || '{"name": "' || event_type || '", "arguments": {"id": ' || user_id || '}}' || chr(10) || '</tool_call><|im_end|>' || chr(10) END AS slot FROM events""")
def function_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function messages (JSON behind a thought) in a template's slot."""
    good = F.concat(F.lit("<think>"), "event_type", F.lit('</think>{"name": "'), "event_type", F.lit('", "arguments": {"id":'), "user_id", F.lit("}}"))
    content = F.when(F.col("event_id") % 4 == 0, F.lit('{"name": broken')).otherwise(good)
    return table(spark, sf_dir, "events").select("event_id", T.function_slot(content, "{{content}}<|im_end|>\n", "tagged").alias("slot"))


_PLAIN = Template("U {{content}} ", "A {{content}} ", "S {{content}} ")
_TEXTS = f"SELECT conv_id, list_transform(t, lambda x, i: CASE WHEN i = 1 AND s <> '' THEN 'S ' || s || ' ' ELSE '' END || CASE x.role WHEN 'user' THEN 'U ' ELSE 'A ' END || x.content || ' ') AS x, t FROM ({_TURNS})"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", _PLAIN.texts(F.col("t"), F.col("s")).alias("x"), "t")


_CUT = 40


@register(f"""WITH RECURSIVE x AS ({_TEXTS}), p AS (SELECT conv_id, i, {_IDS.format("x[2 * i + 1]")} AS a, {_IDS.format("x[2 * i + 2]")} AS b FROM (SELECT conv_id, x, unnest(range(len(x) // 2)) AS i FROM x)),
 w AS (SELECT conv_id, -1::BIGINT AS i, 0::BIGINT AS used, []::BIGINT[] AS ids, []::BIGINT[] AS labels FROM x UNION ALL
 SELECT conv_id, i, used + na + nb, list_concat(ids, a[1:na], b[1:nb]), list_concat(labels, {_ALL.format("na")}, b[1:nb]) FROM (SELECT *, least(greatest(room - nb, 0), len(a)) AS na FROM (SELECT *, least(CASE WHEN 2 * len(b) < room THEN room WHEN 2 * len(a) < room THEN room - len(a)
 ELSE CAST(trunc(room * (len(b) / CAST(len(a) + len(b) AS DOUBLE))) AS BIGINT) END, len(b)) AS nb FROM (SELECT p.*, {_CUT} - used AS room, used, ids, labels FROM w JOIN p ON p.conv_id = w.conv_id AND p.i = w.i + 1) WHERE room > 0)))
 SELECT conv_id, array_to_string(arg_max(ids, i), ',') AS input_ids, array_to_string(arg_max(labels, i), ',') AS labels FROM w GROUP BY conv_id""")
def supervised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns share a cutoff; prompts are masked."""
    got = _texts(spark, sf_dir).select("conv_id", E.supervised(F.col("x"), lengths, _CUT).alias("r"))
    return got.select("conv_id", shown(F.col("r.input_ids")).alias("input_ids"), shown(F.col("r.labels")).alias("labels"))


_ANSWERS = "SELECT doc_id, source || ' is ' || lang || ' of ' || n_chars AS p, CASE WHEN doc_id % 7 = 0 THEN repeat('long ', 30) ELSE 'one ' || doc_id END AS a, CASE WHEN doc_id % 5 = 0 THEN repeat('other ', 20) ELSE 'no' END AS b FROM documents"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", F.lit(" is "), "lang", F.lit(" of "), "n_chars").alias("p"), F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("long "), F.lit(30))).otherwise(F.concat(F.lit("one "), "doc_id")).alias("a"),
        F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("other "), F.lit(20))).otherwise("no").alias("b"),
    )


def _budget(p: str, n: str, cut: int) -> str:
    """SQL of the two kept lengths: target, then source in terms of it."""
    return f"least(CASE WHEN 2 * {n} < {cut} THEN {cut} WHEN 2 * {p} < {cut} THEN {cut} - {p} ELSE CAST(trunc({cut} * ({n} / CAST({p} + {n} AS DOUBLE))) AS BIGINT) END, {n})"


@register(f"""WITH i AS (SELECT doc_id, {_IDS.format("p")} AS p, {_IDS.format("a")} AS c, {_IDS.format("b")} AS r FROM ({_ANSWERS})), n AS (SELECT *, {_budget("len(p)", "greatest(len(c), len(r))", 16)} AS nb FROM i), m AS (SELECT *, least(greatest(16 - nb, 0), len(p)) AS na FROM n)
 SELECT doc_id, array_to_string(list_concat(p[1:na], c[1:nb]), ',') AS chosen, array_to_string(list_concat({_ALL.format("na")}, c[1:nb]), ',') AS chosen_labels, array_to_string(list_concat(p[1:na], r[1:nb]), ',') AS rejected, array_to_string(list_concat({_ALL.format("na")}, r[1:nb]), ',') AS rejected_labels FROM m""")
def pairwise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _answers(spark, sf_dir).select("doc_id", E.pairwise(F.col("p"), F.col("a"), F.col("b"), lengths, 16).alias("r"))
    return r.select("doc_id", *[shown(F.col(f"r.{a}")).alias(b) for a, b in (("chosen_input_ids", "chosen"), ("chosen_labels", "chosen_labels"), ("rejected_input_ids", "rejected"), ("rejected_labels", "rejected_labels"))])


@register(f"""WITH x AS (SELECT doc_id, p, CASE WHEN doc_id % 3 = 0 THEN b ELSE a END AS g, doc_id % 3 <> 0 AS tag, CASE WHEN doc_id % 2 = 0 THEN a ELSE b END AS k FROM ({_ANSWERS})), i AS (SELECT doc_id, tag, {_IDS.format("p")} AS p, {_IDS.format("g")} AS g, {_IDS.format("k")} AS k FROM x),
 n AS (SELECT *, {_budget("len(p)", "len(g)", 12)} AS nb, {_budget("len(p)", "len(k)", 12)} AS kb FROM i)
 SELECT doc_id, array_to_string(list_concat(p[1:least(greatest(12 - nb, 0), len(p))], g[1:nb]), ',') AS input_ids, array_to_string(list_concat({_ALL.format("least(greatest(12 - nb, 0), len(p))")}, g[1:nb]), ',') AS labels,
 array_to_string(list_concat(p[1:least(greatest(12 - kb, 0), len(p))], k[1:kb]), ',') AS kl_input_ids, tag AS kto_tag FROM n""")
def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    none = F.lit("")
    liked, even = F.col("doc_id") % 3 != 0, F.col("doc_id") % 2 == 0
    r = E.feedback(F.col("p"), F.when(liked, F.col("a")).otherwise(none), F.when(liked, none).otherwise(F.col("b")), F.when(even, F.col("a")).otherwise(none), F.when(even, none).otherwise(F.col("b")), lengths, 12)
    got = a.select("doc_id", r.alias("r"))
    return got.select("doc_id", shown(F.col("r.input_ids")).alias("input_ids"), shown(F.col("r.labels")).alias("labels"), shown(F.col("r.kl_input_ids")).alias("kl_input_ids"), F.col("r.kto_tag").alias("kto_tag"))


@register(f"""WITH i AS (SELECT doc_id, {_IDS.format("p")} AS p, coalesce({_IDS.format("CASE WHEN doc_id % 2 = 0 THEN a END")}, []) AS a FROM ({_ANSWERS})), n AS (SELECT *, {_budget("len(p)", "len(a)", 10)} AS nb FROM i)
 SELECT doc_id, array_to_string(p[1:least(greatest(10 - nb, 0), len(p))], ',') AS input_ids, array_to_string(a[1:nb], ',') AS labels FROM n""")
def unsupervised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.unsupervised(F.col("p"), F.when(F.col("doc_id") % 2 == 0, F.col("a")), lengths, 10)
    return _answers(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", shown(F.col("r.input_ids")).alias("input_ids"), shown(F.col("r.labels")).alias("labels"))


@register(f"WITH t AS ({_TURNS}) SELECT conv_id, CAST(len(t) - 1 AS INTEGER) % 2 = 1 AND conv_id % 3 = 1 AS supervised, CAST(len(t) - 1 AS INTEGER) % 2 = 1 AND conv_id % 3 >= 2 AS paired FROM t")
def example_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows each encoder keeps: an odd prompt, and one answer or at least two."""
    t = _turns(spark, sf_dir).withColumn("prompt", F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))))
    answers = F.array_repeat(F.lit("x"), (F.col("conv_id") % 3).cast("int"))
    return t.select("conv_id", E.keeps_supervised(F.col("prompt"), answers).alias("supervised"), E.keeps_pairs(F.col("prompt"), answers).alias("paired"))
