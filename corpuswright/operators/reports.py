"""Score reports: overlapping groups, macro and micro means, consistency, pairwise rewards.

All take a DataFrame of scored rows and column names and return a long or wide report; they
are plain aggregations, so the map side combines before each shuffle, and groups that overlap
are made by exploding labels, never by joining rows with a list of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """Aggregate: the share of rows for which the condition holds (null counts as not)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """top / bottom as a double; `empty` where bottom is zero."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(empty))


def overlapping_report(rows: DataFrame, category: str, score: str, keywords: Sequence[str], fixed: bool = False) -> DataFrame:
    """category, total, acc (percent): a row counts for every keyword that its category
    contains and for Overall. With `fixed`, keywords without rows are reported as 0."""
    labels = F.array_append(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col(category), k)), "Overall")
    out = rows.select(F.explode(labels).alias("category"), F.col(score).alias("s")).groupBy("category").agg(F.count("*").alias("total"), (100 * F.avg("s")).alias("acc"))
    if fixed:
        every = rows.sparkSession.createDataFrame([(k,) for k in [*keywords, "Overall"]], "category string")
        out = every.join(out, "category", "left").select("category", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("acc", F.lit(0.0)).alias("acc"))
    return out


def grouped_report(rows: DataFrame, score: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Means over several groupings at once in long form: level (the grouping's columns),
    group, mean, total. One pass by grouping sets."""
    names = sorted({c for s in sets for c in s})
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(
        F.avg(score).alias("mean"), F.count("*").alias("total"), *[F.grouping(c).alias(f"__{c}") for c in names]
    )
    used = lambda c, value: F.when(F.col(f"__{c}") == 0, value)
    level = F.array_join(F.array_compact(F.array(*[used(c, F.lit(c)) for c in names])), ",")
    group = F.array_join(F.array_compact(F.array(*[used(c, F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in names])), ",")
    return grouped.select(F.when(level == "", "Overall").otherwise(level).alias("level"), F.when(level == "", "Overall").otherwise(group).alias("group"), "mean", "total")


def macro_mean(rows: DataFrame, inner: Sequence[str], outer: Sequence[str], score: str, name: str = "macro") -> DataFrame:
    """Unweighted mean over the inner groups' means, by the outer columns."""
    return rows.groupBy(*inner).agg(F.avg(score).alias("m")).groupBy(*outer).agg(F.avg("m").alias(name), F.count("*").alias("groups"))


def pivot_with_average(rows: DataFrame, index: str, column: str, values: Sequence[str], score: str) -> DataFrame:
    """index x column means with 0 for empty cells and a row mean `Avg`. The columns' values
    are given, so no extra pass looks for them."""
    wide = rows.groupBy(index).pivot(column, list(values)).agg(F.avg(score)).fillna(0.0, list(values))
    total = F.lit(0.0)
    for v in values:
        total = total + F.col(f"`{v}`")
    return wide.withColumn("Avg", total / len(values))


def all_right(rows: DataFrame, key: Sequence[str], hit: str, by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Share of key groups whose rows are all hits and number at least `least`; smaller
    groups count as wrong. With the plain mean of hits."""
    groups = rows.groupBy(*key, *[c for c in by if c not in key]).agg(F.bool_and(F.col(hit) == 1).alias("ok"), F.count("*").alias("n"), F.sum(hit).alias("hits"))
    return groups.groupBy(*by).agg(share(F.col("ok") & (F.col("n") >= least)).alias("group_acc"), (F.sum("hits") / F.sum("n")).alias("row_acc"), F.count("*").alias("groups"))


def paired_score(rows: DataFrame, category: str, pair: str, hit: str) -> DataFrame:
    """acc + acc_plus in percent: single answers and pairs with both right."""
    pairs = rows.groupBy(category, pair).agg(F.avg(hit).alias("m"), F.min(hit).alias("all_hit"))
    return pairs.groupBy(category).agg((100 * F.avg("m")).alias("acc"), (100 * F.avg("all_hit")).alias("acc_plus")).withColumn("score", F.col("acc") + F.col("acc_plus"))


def binary_scores(answer: Column, prediction: Column) -> list[Column]:
    """Aggregates accuracy, precision, recall and f1 for boolean columns; a zero
    denominator gives 0."""
    tp, fp, fn = (F.count_if(c) for c in (answer & prediction, ~answer & prediction, answer & ~prediction))
    return [share(answer == prediction).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def exploded_f1(rows: DataFrame, categories: str, answer: str, prediction: str) -> DataFrame:
    """Binary scores by each member of a comma list; Overall is over the exploded rows."""
    label = F.explode(F.array_append(F.split(categories, ","), "Overall"))
    return rows.select(label.alias("category"), answer, prediction).groupBy("category").agg(*binary_scores(F.col(answer), F.col(prediction)), F.count("*").alias("total"))


def with_controls(rows: DataFrame, kind: str, control: str) -> DataFrame:
    """Each other kind's rows with all control rows beside them. The kinds are exploded onto
    the control rows, so rows are never joined with rows."""
    kinds = rows.filter(F.col(kind) != control).agg(F.collect_set(kind).alias("kinds"))  # one value for each kind
    names = sorted(kinds.first()["kinds"])
    controls = rows.filter(F.col(kind) == control).withColumn("against", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    return rows.filter(F.col(kind) != control).withColumn("against", F.col(kind)).unionByName(controls)


def buckets(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed buckets: the first label up to and with the first edge, and so on."""
    out = F.lit(labels[-1]) if len(labels) > len(edges) else F.lit(None).cast("string")
    for e, name in reversed(list(zip(edges, labels))):
        out = F.when(value <= e, F.lit(name)).otherwise(out)
    return out


def bucket_report(rows: DataFrame, value: str, score: str, edges: Sequence[float], labels: Sequence[str], digits: int = 4) -> DataFrame:
    """Mean by bucket, rounded; scores of -1 are left out and empty buckets are 0."""
    means = rows.filter(F.col(score) != -1).groupBy(buckets(F.col(value), edges, labels).alias("bucket")).agg(F.round(F.avg(score), digits).alias("m"), F.count("*").alias("c"))
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], "bucket string")
    return every.join(means, "bucket", "left").select("bucket", F.coalesce("m", F.lit(0.0)).alias("mean"), F.coalesce("c", F.lit(0)).alias("total"))


def over_thresholds(rows: DataFrame, value: str, thresholds: Sequence[float], hit: Column, digits: int = 4) -> DataFrame:
    """For each threshold: share of rows above it, and share that is above it and a hit."""
    each = rows.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), F.col(value).alias("v"), hit.alias("h"))
    above = F.col("v") > F.col("threshold")
    return each.groupBy("threshold").agg(F.round(share(above), digits).alias("recall_at"), F.round(share(above & F.col("h")), digits).alias("accuracy_at"))


def weighted_distance(rows: DataFrame, page: str, distance: str, length: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over pages of sum(distance) / sum(length)."""
    pages = rows.groupBy(page, *by).agg(ratio(F.sum(distance), F.sum(length)).alias("d"))
    return pages.groupBy(*by).agg(F.avg("d").alias("distance"), F.count("*").alias("pages"))


def bag_counts(tokens: Column, of: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias(of))


def token_f1(rows: DataFrame, keys: Sequence[str], prediction: Column, answer: Column) -> DataFrame:
    """Multiset token overlap for each key: matched, predicted, wanted and f1. Both bags
    are counted in one pass (signed rows), without a join."""
    each = rows.select(*keys, F.explode(F.concat(F.transform(prediction, lambda t: F.struct(t.alias("token"), F.lit(1).alias("p"), F.lit(0).alias("a"))), F.transform(answer, lambda t: F.struct(t.alias("token"), F.lit(0).alias("p"), F.lit(1).alias("a"))))).alias("x"))
    bags = each.groupBy(*keys, "x.token").agg(F.sum("x.p").alias("p"), F.sum("x.a").alias("a"))
    out = bags.groupBy(*keys).agg(F.sum(F.least("p", "a")).alias("matched"), F.sum("p").alias("predicted"), F.sum("a").alias("wanted"))
    return out.withColumn("f1", ratio(2 * F.col("matched"), F.col("predicted") + F.col("wanted")))


def weighted_mean(score: Column, weight: Column) -> Column:
    """Aggregate: weighted mean of the non-negative scores; -1 if there is none."""
    ok = score >= 0
    return F.when(F.sum(F.when(ok, weight)) > 0, F.sum(F.when(ok, score * weight)) / F.sum(F.when(ok, weight))).otherwise(F.lit(-1.0))


def least_score(score: Column) -> Column:
    """Aggregate: least non-negative score; -1 if there is none."""
    return F.coalesce(F.min(F.when(score >= 0, score)).cast("double"), F.lit(-1.0))


def pairwise_reward(rows: DataFrame, verdict: str, reversed_: str, values: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Verdicts to rewards, negated for reversed rows: reward, win rate and counts."""
    value = F.lit(None).cast("double")
    for k, v in values.items():
        value = F.when(F.col(verdict) == k, F.lit(float(v))).otherwise(value)
    signed = rows.withColumn("__r", F.when(F.col(reversed_), -value).otherwise(value))
    r = F.col("__r")
    return signed.groupBy(*by).agg(F.avg(r).alias("reward"), share(r > 0).alias("win_rate"), F.count_if(r > 0).alias("wins"), F.count_if(r == 0).alias("ties"), F.count_if(r < 0).alias("losses"), F.count_if(r.isNull()).alias("unparsed"))


def cumulative(rows: DataFrame, value: Column, width: int) -> DataFrame:
    """Counts by floor(value / width) * width with the running count and percent. The window
    runs over bins, whose number is bounded by the range of the value over the width."""
    bins = rows.groupBy((F.floor(value / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    up_to = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return bins.select("bin", "n", F.sum("n").over(up_to).alias("running"), (100.0 * F.sum("n").over(up_to) / F.sum("n").over(whole)).alias("percent"))
