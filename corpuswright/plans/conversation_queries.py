"""Queries over `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuswright.functions import conversation as C
from corpuswright.plans.catalogue import register
from corpuswright.plans.frames import BROKEN, broken, table


@register("""
WITH t AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS all_turns FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN all_turns[1].role = 'system' THEN all_turns[1].content ELSE '' END AS system,
  CASE WHEN all_turns[1].role = 'system' THEN all_turns[2:] ELSE all_turns END AS turns FROM t),
v AS (SELECT *, coalesce(list_bool_and(list_transform(turns, lambda x, i: CASE WHEN i % 2 = 1 THEN x.role IN ('user','human','observation')
  ELSE x.role IN ('assistant','gpt','function_call','function') END)), true) AND len(turns) > 0 AND len(turns) % 2 = 0 AS valid FROM s)
SELECT conv_id, valid, system,
  CASE WHEN valid THEN array_to_string(list_transform(turns[:-2], lambda x: x.role || ': ' || x.content), chr(10)) ELSE '' END AS prompt,
  CASE WHEN valid THEN turns[-1].content ELSE '' END AS response, CAST(len(turns) AS INTEGER) AS n_turns FROM v""")
def align_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns to the canonical row: system, prompt turns, response; broken rows are kept empty."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(C.ordered_turns().alias("all_turns"))
    t = t.select("conv_id", C.system_of(F.col("all_turns")).alias("system"), C.without_system(F.col("all_turns")).alias("turns"))
    t = t.withColumn("valid", C.is_complete(F.col("turns")))
    shown = F.transform(F.slice("turns", F.lit(1), F.greatest(F.size("turns") - 1, F.lit(0))), lambda x: F.concat(x["role"], F.lit(": "), x["content"]))
    return t.select(
        "conv_id", "valid", "system", F.when(F.col("valid"), F.array_join(shown, "\n")).otherwise("").alias("prompt"),
        F.when(F.col("valid"), F.element_at("turns", -1)["content"]).otherwise("").alias("response"), F.size("turns").alias("n_turns"),
    )


@register(f"""WITH {BROKEN}, o AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM broken WHERE role IN ('user', 'assistant')),
 r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM o WHERE seen = 1), k AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM r WHERE b IS NULL OR b <> role)
 SELECT conv_id, turn, role, text FROM k WHERE NOT (role = 'user' AND nx IS NULL)""")
def alternation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repair_alternation(broken(spark, sf_dir)).select("conv_id", "turn", "role", "text")


@register(f"""WITH {BROKEN}, l AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM broken) SELECT conv_id, CAST(sum(CASE WHEN b = role THEN 1 ELSE 0 END) AS BIGINT) AS breaks, sum(CASE WHEN b = role THEN 1 ELSE 0 END) = 0 AS valid FROM l GROUP BY conv_id""")
def role_alternation_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = broken(spark, sf_dir).withColumn("b", F.lag("role").over(w)).groupBy("conv_id").agg(F.count_if(F.col("b") == F.col("role")).alias("breaks"))
    return t.withColumn("valid", F.col("breaks") == 0)


@register(f"""WITH RECURSIVE {BROKEN}, n AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM broken),
 w AS (SELECT conv_id, k, 1 AS round, [role] AS seen FROM n WHERE k = 1 UNION ALL SELECT n.conv_id, n.k, CASE WHEN list_contains(seen, role) THEN round + 1 ELSE round END, CASE WHEN list_contains(seen, role) THEN [role] ELSE list_append(seen, role) END
 FROM w JOIN n ON n.conv_id = w.conv_id AND n.k = w.k + 1) SELECT conv_id, CAST(k - 1 AS INTEGER) AS pos, round FROM w""")
def round_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = broken(spark, sf_dir).groupBy("conv_id").agg(F.transform(C.ordered_turns(), lambda x: x["role"]).alias("roles"))
    return t.select("conv_id", F.posexplode(C.round_numbers(F.col("roles"))).alias("pos", "round"))


@register("SELECT conv_id, CAST(count_if(role = 'user') AS BIGINT) AS questions, CAST(count_if(role = 'assistant') AS BIGINT) AS replies, CAST(least(count_if(role = 'user'), count_if(role = 'assistant')) AS BIGINT) AS pairs FROM conversations GROUP BY conv_id")
def qa_pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = F.count_if(F.col("role") == "user"), F.count_if(F.col("role") == "assistant")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(q.alias("questions"), a.alias("replies"), F.least(q, a).alias("pairs"))


@register("""WITH t AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_transform(t, lambda x: CASE WHEN starts_with(x, 'user') THEN '<u>' || substr(x, 6) || '</u>'
 WHEN starts_with(x, 'assistant') THEN '<a>' || substr(x, 11) || '</a>' ELSE substr(x, 8) END), '') AS rendered FROM t""")
def template_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(C.ordered_turns().alias("turns"))
    return t.select("conv_id", C.render(F.col("turns"), {"user": ("<u>", "</u>"), "assistant": ("<a>", "</a>")}).alias("rendered"))


@register("""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<image>' || text ELSE text END AS text, CAST((conv_id + turn) % 3 AS INTEGER) AS n FROM conversations WHERE role = 'user'),
 c AS (SELECT *, CAST((length(text) - length(replace(text, '<image>', ''))) / 7 AS INTEGER) AS have FROM x)
 SELECT conv_id, turn, have, have = n AS valid, repeat('<image>', greatest(n - have, 0)) || text AS fixed FROM c""")
def placeholder_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter("role = 'user'")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<image>"), "text")).otherwise(F.col("text"))
    images = F.array_repeat(F.lit("i"), ((F.col("conv_id") + F.col("turn")) % 3).cast("int"))
    n = C.placeholder_count(text)
    return t.select("conv_id", "turn", n.alias("have"), (n == F.size(images)).alias("valid"), C.with_placeholders(text, images).alias("fixed"))


@register("""WITH x AS (SELECT event_id, 'so <tool_call>' || chr(10) || '{"name": "' || event_type || '", "arguments": {"id": ' || user_id || '}}' || chr(10) || '</tool_call> done' AS t FROM events)
 SELECT event_id, json_extract_string(regexp_extract(t, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1), '$.name') AS name, json_extract_string(regexp_extract(t, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1), '$.arguments.id') AS id FROM x""")
def tool_call_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('so <tool_call>\n{"name": "'), "event_type", F.lit('", "arguments": {"id": '), "user_id", F.lit("}}\n</tool_call> done"))
    call = F.get(C.tool_calls(text), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", call["name"].alias("name"), F.get_json_object(call["arguments"], "$.id").alias("id"))


@register("""WITH l AS (SELECT conv_id, len(string_split(text, ' ')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'system'), s AS (SELECT conv_id, sum(n) FILTER (k % 2 = 1) AS src, sum(n) FILTER (k % 2 = 0) AS tgt FROM l GROUP BY ALL)
 SELECT conv_id, CAST(src + coalesce(tgt, 0) AS BIGINT) AS ids, CAST(coalesce(tgt, 0) AS BIGINT) AS trained, coalesce(tgt, 0) / CAST(src + coalesce(tgt, 0) AS DOUBLE) AS valid_share FROM s""")
def supervised_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level ids with the prompt masked: sizes and the share of trained ids."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").filter("role <> 'system'").withColumn("k", F.row_number().over(w))
    words = F.transform(F.split("text", " "), lambda x: F.pmod(F.crc32(F.encode(x, "utf-8")), F.lit(49_000)).cast("int"))
    side = lambda r: F.coalesce(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") % 2 == r, F.struct("turn", words.alias("ids"))))), lambda x: x["ids"])), F.array().cast("array<int>"))
    t = t.groupBy("conv_id").agg(side(1).alias("source"), side(0).alias("target"))
    ids, _, labels = C.labelled(F.col("source"), F.col("target"))
    kept = F.size(F.filter(labels, lambda x: x != -100))
    return t.select("conv_id", F.size(ids).cast("long").alias("ids"), kept.cast("long").alias("trained"), (kept / F.size(ids)).alias("valid_share"))


@register("""WITH t AS (SELECT conv_id, list(len(text) ORDER BY turn) AS n FROM conversations GROUP BY ALL) SELECT conv_id, array_to_string(flatten(list_transform(n[1:4], lambda x, i: list_transform(range(least(x, 3)), lambda _: i))), '') AS segments FROM t""")
def packed_segment_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(C.ordered_turns(), lambda x: F.least(F.length(x["content"]), F.lit(3))).alias("n"))
    segments = F.filter(C.packed_segments(F.slice("n", 1, 4), 12), lambda x: x != 0)
    return t.select("conv_id", F.array_join(segments.cast("array<string>"), "").alias("segments"))


@register("""SELECT doc_id, 'user' AS first_role, coalesce(nullif(lang, ''), '') || chr(10) || source AS prompt, CAST(1 AS INTEGER) AS n FROM documents""")
def instruction_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.instruction_turns(F.col("lang"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", turns[0]["role"].alias("first_role"), turns[0]["content"].alias("prompt"), F.size(turns).alias("n"))


@register("""SELECT user_id, 'a<s>' || repeat('<p>', CAST(user_id % 4 AS INTEGER)) || '</s>b<s>' || repeat('<p>', 2) || '</s>c<image>' AS expanded FROM (SELECT DISTINCT user_id FROM events)""")
def placeholder_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array((F.col("user_id") % 4).cast("int"), F.lit(2))
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", C.expand_placeholders(F.lit("a<image>b<image>c<image>"), sizes).alias("expanded"))
