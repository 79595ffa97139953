"""Row projections: conversions, categories, segmentation, boxes in text, question building."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswright.functions.binding import bind


def turns_of(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("from"), c.alias("value")) for r, c in pairs])


def rename_roles(turns: Column, names: Mapping[str, str]) -> Column:
    """Turns with renamed roles; roles without a name are dropped."""
    pairs = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    kept = F.filter(turns, lambda t: t["role"].isin(*names))
    return F.transform(kept, lambda t: F.struct(F.try_element_at(pairs, t["role"]).alias("from"), t["content"].alias("value")))


def preference_pair(response: Column, chosen: Column, rejected: Column, liked: Column, ranking: bool) -> Column:
    """The responses of a row: a feedback tag gives [response, ""] or ["", response], ranking
    [chosen, rejected], else the response alone; no response gives none."""
    fed = F.when(liked, F.array(response, F.lit(""))).when(~liked, F.array(F.lit(""), response))
    plain = F.when(response.isNotNull(), F.array(response)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(fed, F.when(chosen.isNotNull() & rejected.isNotNull(), F.array(chosen, rejected)) if ranking else F.lit(None).cast("array<string>"), plain)


def any_keyword(category: Column, keywords: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(category, k))


def lacks(text: Column, phrase: str) -> Column:
    """Whether a text lacks a phrase, cases alike; null lacks everything."""
    return ~F.coalesce(F.contains(F.lower(text), F.lit(phrase.lower())), F.lit(False))


def remap(value: Column, table: Mapping[str, str]) -> Column:
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(pairs, value), value)


def pick_template(templates: Sequence[str], *keys: Column) -> Column:
    """One of the templates by a hash of the keys: the same on every run."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 7), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, templates)), (number % len(templates) + 1).cast("int"))


def segments(text: Column, rule: str = r"(?m)^[ \t]*-{3,}[ \t]*$") -> Column:
    """Trimmed non-empty parts between rule lines."""
    trimmed = F.transform(F.split(text, rule), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def sections(lines: DataFrame, key: str, order: str, text: str, heading: str) -> DataFrame:
    """Sections of a document given as lines: a heading begins one; lines before the first
    heading are section 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.sum(F.when(F.col(text).rlike(heading), 1).otherwise(0)).over(w))
    body = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return marked.groupBy(key, "section").agg(F.array_join(body, "\n").alias(text), F.count("*").alias("n_lines"))


def pack_paragraphs(parts: Column, longest: int, joint: int = 2) -> Column:
    """Parts joined greedily as long as a pack stays within `longest`, counting `joint` for
    each join; a longer part is a pack of its own."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    gap = "\n" * joint

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["now"]) + F.length(p) + joint <= longest
        return (
            F.when(s["now"] == "", F.struct(p.alias("now"), s["out"].alias("out")))
            .when(fits, F.struct(F.concat(s["now"], F.lit(gap), p).alias("now"), s["out"].alias("out")))
            .otherwise(F.struct(p.alias("now"), F.array_append(s["out"], s["now"]).alias("out")))
        )

    return F.aggregate(parts, start, step, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.array_append(s["out"], s["now"])))


def split_at_middle(text: Column) -> Column:
    """Two parts at the newline nearest the middle, the first of equals; at the middle
    where there is no newline."""
    # The nearest newline is the last of the first half or the first of the second.
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    back = F.locate("\n", F.reverse(F.substring(text, F.lit(1), half)))
    left = F.when(back > 0, half - back + 1)
    right = F.nullif(F.call_function("locate", F.lit("\n"), text, half + 1), F.lit(0))

    def cut(b: Column) -> Column:
        return F.array(F.substring(b["t"], F.lit(1), b["end"]), F.substring(b["t"], b["next"], b["n"]))

    best = F.when(right.isNull() | (F.abs(left * 2 - n) <= F.abs(right * 2 - n)), left).otherwise(right)
    place = bind(best, lambda at: F.struct(text.alias("t"), n.alias("n"), F.coalesce(at - 1, half).alias("end"), (F.coalesce(at, half) + 1).alias("next")))
    return bind(place, cut)


def rescale_boxes(text: Column, sx: Column, sy: Column) -> Column:
    """Boxes in text, <box>[x1,y1,x2,y2]</box>, scaled and cut to whole numbers."""
    pattern = r"<box>\[(\d+),(\d+),(\d+),(\d+)\]</box>"
    outside = F.split(text, pattern)
    boxes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    num = lambda b, i: F.regexp_extract(b, pattern, i).cast("double")
    new = F.transform(boxes, lambda b: F.concat(F.lit("<box>["), F.concat_ws(",", *[(num(b, i) * (sx if i % 2 else sy)).cast("int") for i in (1, 2, 3, 4)]), F.lit("]</box>")))
    return F.array_join(F.transform(outside, lambda s, i: F.concat(s, F.coalesce(F.get(new, i), F.lit("")))), "")


def first_of_each(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__k", k).filter("__k = 1").drop("__k")


def distractors(right: Column, low: int, high: int, n: int, *keys: Column) -> Column:
    """n distinct wrong whole numbers in [low, high], drawn by hash."""
    wrong = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda v: v != right)
    drawn = F.array_sort(F.transform(wrong, lambda v: F.struct(F.md5(F.concat_ws(":", *keys, v.cast("string"))).alias("h"), v.alias("v"))))
    return F.transform(F.slice(drawn, 1, n), lambda x: x["v"])


def multiple_choice(right: Column, wrong: Column, *keys: Column) -> Column:
    """Options in hash order and the letter of the right one."""
    mixed = F.transform(F.array_sort(F.transform(F.array_append(wrong, right), lambda v: F.struct(F.md5(F.concat_ws("/", *keys, v.cast("string"))).alias("h"), v.alias("v")))), lambda x: x["v"])
    return F.struct(mixed.alias("options"), F.char(F.array_position(mixed, right) + 64).alias("answer"))


def few_shot(rows: DataFrame, pool: DataFrame, by: str, key: str, text: str, n: int) -> DataFrame:
    """Each row with the first n pool texts of its group by hash, its own left out. The pool is
    ranked within a group once, and only its first n + 1 go on; a row takes the group's
    list, not a sample of its own."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key))
    ranked = pool.withColumn("__k", k).filter(F.col("__k") <= n + 1)
    shots = ranked.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("__k", F.col(key).alias("id"), F.col(text).alias("t")))).alias("__shots"))
    others = F.filter("__shots", lambda x: ~x["id"].eqNullSafe(F.col(key)))
    return rows.join(shots, by, "left").withColumn("shots", F.transform(F.slice(others, 1, n), lambda x: x["t"])).drop("__shots")


def dual_order(rows: DataFrame, verdict: Column, swapped: Column) -> Column:
    """Verdict as seen from the first answer: swapped rows count the other way round."""
    return F.when(swapped, -verdict).otherwise(verdict)


def latex_row(values: Sequence[Column]) -> Column:
    """Cells with two decimals joined as a table row; null is NaN."""
    return F.array_join(F.array(*[F.when(v.isNotNull(), F.format_string("%.2f", v.cast("double"))).otherwise("NaN") for v in values]), " & ")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(a))


def answered(qa: Column, include_failed: bool = False) -> Column:
    """Entries of a map name -> (status, question, answer) with both texts; entries that
    failed are left out unless wanted, a blank status counts as success."""
    done = lambda v: F.coalesce(F.trim(v["status"]), F.lit("")).isin("", "success")
    full = lambda v: (F.coalesce(F.trim(v["question"]), F.lit("")) != "") & (F.coalesce(F.trim(v["answer"]), F.lit("")) != "")
    return F.filter(F.map_entries(qa), lambda e: full(e["value"]) & (F.lit(include_failed) | done(e["value"])))


def prune_map(lesions: Column) -> Column:
    """Lesions with their box and score alone; entries without a box go."""
    return F.map_filter(F.transform_values(lesions, lambda k, v: F.struct(v["bbox"].alias("bbox"), v["score"].alias("score"))), lambda k, v: v["bbox"].isNotNull())


def caption_sections(text: Column, heading: str = r"([A-Za-z ]+): (\[[^\]]*\])") -> Column:
    """Sections `Name: [..]` of a caption as a map; of equal names the last wins."""
    found = F.regexp_extract_all(text, F.lit(heading), F.lit(0))
    entries = F.transform(found, lambda m: F.struct(F.trim(F.regexp_extract(m, heading, 1)).alias("k"), F.regexp_extract(m, heading, 2).alias("v")))
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))))
    # Sorted by name and place, an entry is the last of its name if the next has another.
    last = bind(placed, lambda p: F.filter(p, lambda e, i: ~F.coalesce(F.get(p, i + 1)["k"] == e["k"], F.lit(False))))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def case_sections(text: Column, start: str = r"(?m)^# CASE", stop: str = r"(?m)^# Reference") -> Column:
    """Blocks that begin with a case heading, cut at the references."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s){start}.*?(?=\n# CASE|\z)"), F.lit(0))
    return F.transform(blocks, lambda b: F.regexp_replace(F.split(b, stop, 2)[0], r"\s+$", ""))


def reports_in_order(report: DataFrame, name: str, fixed: Sequence[str], last: str = "Overall") -> DataFrame:
    """Rows in the fixed order, then unknown names sorted, then the total. An order for
    display, so for small reports."""
    return report.orderBy(report_place(F.col(name), fixed, last), name)


def report_place(name: Column, fixed: Sequence[str], last: str = "Overall") -> Column:
    """Where a row stands: its place in the fixed order, then all others, then the total."""
    place = F.array_position(F.array(*map(F.lit, fixed)), name)
    return F.when(name == last, F.lit(2**30)).when(place > 0, place).otherwise(F.lit(len(fixed) + 1))


def without_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.drop(*names)


def annotated(images: DataFrame, annotations: DataFrame, categories: DataFrame, most: int = 100_000) -> DataFrame:
    """Annotations with their image's columns and their category's name; categories are sent round
    if they are at most `most`. A category that has no name is unknown."""
    few = categories.limit(most + 1).count() <= most
    named = annotations.join(F.broadcast(categories) if few else categories, "category_id", "left")
    return images.join(named, "image_id").withColumn("category", F.coalesce("category", F.lit("unknown")))


def canonical(label: Column, same: Mapping[str, str]) -> Column:
    """Equivalent labels under one name, by pattern; the first pattern that matches counts."""
    out = label
    for pattern, name in reversed(list(same.items())):
        out = F.when(label.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def pairwise_attach(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The values of two systems beside each other, by key."""
    return left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), list(keys))


def budget_turns(lengths: Column, cutoff: int, newest_first: bool = False) -> Column:
    """For turns as (source, target) lengths: how much of each is kept while the budget lasts;
    turns after its end are left out. With `newest_first` the latest turns are kept."""
    order = F.reverse(lengths) if newest_first else lengths
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<source:int,target:int>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        room = F.lit(cutoff) - s["used"]
        a, b = t["source"].cast("int"), t["target"].cast("int")
        share = F.when(b * 2 < room, room).when(a * 2 < room, room - a).otherwise((room * (b / F.greatest(a + b, F.lit(1)))).cast("int"))
        kept_b = F.least(share, b)
        kept_a = F.least(F.greatest(room - kept_b, F.lit(0)), a)
        new = F.struct(kept_a.cast("int").alias("source"), kept_b.cast("int").alias("target"))
        return F.when(room <= 0, s).otherwise(F.struct((s["used"] + kept_a + kept_b).cast("int").alias("used"), F.array_append(s["out"], new).alias("out")))

    return F.aggregate(order, start, step, lambda s: F.reverse(s["out"]) if newest_first else s["out"])


def without_history_thoughts(turns: Column, empty: str = "<think>\n\n</think>\n\n") -> Column:
    """Model turns of a reasoning template: thoughts go from all but the last turn, and the
    last gets an empty one where it has none."""
    bare = lambda t: F.regexp_replace(t, r"(?s)<think>.*?</think>\s*", "")
    n = F.size(turns)
    ours = lambda t: t["role"] == "assistant"

    def one(t: Column, i: Column) -> Column:
        last = F.when(F.contains(t["content"], F.lit("<think>")), t["content"]).otherwise(F.concat(F.lit(empty), t["content"]))
        return F.struct(t["role"].alias("role"), F.when(ours(t) & (i == n - 1), last).when(ours(t), bare(t["content"])).otherwise(t["content"]).alias("content"))

    return F.transform(turns, one)


def reward_accuracy(chosen: Column, rejected: Column) -> Column:
    """Aggregate: share of pairs whose chosen answer has the larger reward."""
    return F.avg(F.when(chosen > rejected, 1.0).otherwise(0.0))


def perplexity(losses: Column) -> Column:
    """Exponential of the mean of an array of losses."""
    return F.exp(F.aggregate(losses, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(losses), F.lit(0)))
