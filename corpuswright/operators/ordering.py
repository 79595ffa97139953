"""Order-dependent operators: packing, budgets, rotation, sampling, splitting, mixing.

Draws are by a seeded hash of the key, so they give the same rows on every run and cluster,
and exact counts come from ranks. Ranks and running sums, over a whole table or within groups of
any size, are taken in two steps (within range partitions, plus the partitions' offsets), never by a
window that holds a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswright.operators.grouped import by_runs
from corpuswright.operators.storage import stored


def draw(*keys: str | Column, seed: int = 42) -> Column:
    """A hash to order rows by: the md5 of seed and keys, equal in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys]))


def prefix(rows: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), value: Column | None = None, before: str = "before", total: str | None = None) -> DataFrame:
    """Adds `before`, the sum of `value` (1 by default: a rank from 0) over the rows of the same `by`
    that come earlier in the order, and `total`, their whole sum, if asked for.

    No group is brought into one task, whatever its size: rows are range-partitioned by group and
    order and stored; sums are taken within a partition, and the sums of each group's partitions, one row
    for each, give the offsets. `order` should end in a unique key; ties go either way.
    """
    at, part, amount = (_unused(rows, n) for n in ("__at", "__part", "__amount"))
    keys = [*[F.col(b) for b in by], *[F.col(o) if isinstance(o, str) else o for o in order]]
    laid = rows.withColumn(amount, (F.lit(1) if value is None else F.coalesce(value, F.lit(0))).cast("long"))
    laid = laid.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    laid = stored(laid, "laid").withColumn(part, F.shiftright(at, 33))
    sums = laid.groupBy(part, *by).agg(F.sum(amount).alias("__sum"))
    if by:
        earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(F.col(part).alias("__p"), *[F.col(b).alias(f"__by{k}") for k, b in enumerate(by)], F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"), F.sum("__sum").over(Window.partitionBy(*by)).alias("__whole"))
    else:  # a row for each range partition
        own, done, out = sorted((r[0], r[1]) for r in sums.collect()), 0, []
        for p, n in own:
            out.append((p, done))
            done += n
        offsets = rows.sparkSession.createDataFrame(out, "__p long, __offset long").withColumn("__whole", F.lit(done).cast("long"))
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(part, *by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = laid.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    met = F.col(part) == F.col("__p")
    for k, b in enumerate(by):
        met = met & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    more = [F.col("__whole").alias(total)] if total else []
    return summed.join(offsets, met).select(*rows.columns, (F.col("__inside") + F.col("__offset")).alias(before), *more)


def _unused(rows: DataFrame, name: str) -> str:
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rank_all(rows: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Adds a gapless rank from 0 over the whole table in the given order."""
    return prefix(rows, order, before=name)


def sample_exact(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows: all of them in turn as often as they fit, then the first by hash."""
    total = rows.count()
    if total == 0:
        return rows.limit(0)
    times, rest = divmod(n, total)
    drawn = rank_all(rows, [draw(key, seed=seed), key], "__rank").filter(F.col("__rank") < rest).drop("__rank")
    return drawn if not times else rows.withColumn("__t", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__t").unionByName(drawn)


def per_group(rows: DataFrame, by: str, order: Sequence[Column], n: int | Mapping[str, int], default: int | None = None) -> DataFrame:
    """The first n rows of each group; with a mapping, groups it lacks have `default` or no cap.
    A small n is a top-k that Spark limits before the shuffle."""
    if isinstance(n, int) and n <= 1000:
        k = F.row_number().over(Window.partitionBy(by).orderBy(*order))
        return rows.withColumn("__k", k).filter(F.col("__k") <= n).drop("__k")
    if isinstance(n, int):
        cap: Column = F.lit(n)
    else:
        pairs = [x for g, c in n.items() for x in (F.lit(g), F.lit(c))]
        cap = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(by)), F.lit(default if default is not None else 2**62))
    return prefix(rows, order, [by], before="__k").filter(F.col("__k") < cap).drop("__k")


def split_fraction(rows: DataFrame, by: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds `split`: the first floor(share * group) rows of each group by hash are test."""
    ranked = prefix(rows, [draw(key, seed=seed), key], [by], before="__k", total="__n")
    return ranked.withColumn("split", F.when(F.col("__k") < F.floor(F.col("__n") * F.lit(share)), "test").otherwise("train")).drop("__k", "__n")


def allocate(sizes: Mapping[str, int], share: float) -> dict[str, int]:
    """Half-even rounding of share * size, then one more or less on the largest group until the
    sum is exact."""
    total = int(share * sum(sizes.values()))
    out = {k: round(v * share) for k, v in sizes.items()}
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    while order and sum(out.values()) != total:
        for k in order:
            gap = total - sum(out.values())
            if gap > 0 and out[k] < sizes[k] or gap < 0 and out[k] > 0:
                out[k] += 1 if gap > 0 else -1
                break
        else:
            break
    return out


def stratified_split(rows: DataFrame, by: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds `split` with an exact total of test rows; the groups' sizes are one row for each
    group on the driver."""
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    quota = allocate({k: v for k, v in sizes.items() if k is not None}, share)
    pairs = [x for g, c in quota.items() for x in (F.lit(g), F.lit(c))]
    cap = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(by)), F.lit(0)) if pairs else F.lit(0)
    ranked = prefix(rows, [draw(key, seed=seed), key], [by], before="__k")
    return ranked.withColumn("split", F.when(F.col("__k") < cap, "test").otherwise("train")).drop("__k")


def interleave(sources: Sequence[DataFrame], key: str, stop: str = "first") -> DataFrame:
    """Rows of several sources in turn, in the order of `key`: with columns source and turn.
    `first` stops when the shortest ends, `all` repeats shorter ones until the longest ends."""
    counts = [s.count() for s in sources]
    n = min(counts) if stop == "first" else max(counts)
    out: DataFrame | None = None
    for i, (s, count) in enumerate(zip(sources, counts)):
        r = rank_all(s, [F.col(key)], "turn")
        if stop == "first":
            r = r.filter(F.col("turn") < n)
        elif count:
            r = r.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // count)))).withColumn("turn", F.col("turn") + F.col("__c") * count).drop("__c").filter(F.col("turn") < n)
        r = r.withColumn("source", F.lit(i))
        out = r if out is None else out.unionByName(r)
    assert out is not None
    return out


def sequence_budget(source: Column, target: Column, cutoff: int) -> tuple[Column, Column]:
    """Lengths that source and target may keep within the cutoff: the longer side is cut, in
    proportion where both are long."""
    share = F.when(target * 2 < cutoff, F.lit(cutoff)).when(source * 2 < cutoff, cutoff - source).otherwise((cutoff * (target / (source + target))).cast("int"))
    kept = F.least(share, target)
    return F.least(F.greatest(cutoff - kept, F.lit(0)), source), kept


def rotate_choices(rows: DataFrame, options: Sequence[str], answer: str) -> DataFrame:
    """k rotations of each k-option row: option columns move round and the answer with them."""
    k = len(options)
    each = rows.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    old = F.array(*[F.col(o) for o in options])
    names = F.array(*[F.lit(o) for o in options])
    moved = [F.get(old, F.pmod(F.lit(i) + F.col("rotation"), F.lit(k))).alias(o) for i, o in enumerate(options)]
    at = F.array_position(names, F.col(answer)) - 1
    new = F.get(names, F.pmod(at - F.col("rotation"), F.lit(k)).cast("int")).alias(answer)
    return each.select(*[c for c in each.columns if c not in (*options, answer)], *moved, new)


def knapsack_pack(rows: DataFrame, group: str, key: str, length: str, capacity: int) -> DataFrame:
    """Greedy packing in each group: again and again the longest row that fits. Adds pack;
    rows over the capacity are left out. A group is one packing batch, so its size is a
    parameter of whoever assigns groups."""
    from bisect import bisect_right, insort

    g, i, n = (rows.columns.index(c) for c in (group, key, length))

    def run(batch: list[tuple]) -> list[tuple]:
        left: list[tuple] = []
        for r in batch:
            if r[n] <= capacity:
                insort(left, (r[n], r[i]))
        out, pack = [], 0
        while left:
            room = capacity
            while (at := bisect_right(left, (room, float("inf")))) and left[at - 1][0] <= room:
                size, k = left.pop(at - 1)
                room -= size
                out.append((batch[0][g], k, size, pack))
            pack += 1
        return out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return by_runs(rows, [group], [key], run, f"{group} {kinds[group]}, {key} {kinds[key]}, {length} {kinds[length]}, pack long")


def block_pack(rows: DataFrame, by: str, order: str, length: Column, block: int) -> DataFrame:
    """Rows of a group laid end to end and cut into blocks: for each block a row reaches into,
    where it lies. The last, partial block is dropped."""
    laid = prefix(rows.withColumn("__n", length), [order], [by], F.col("__n"), "__start", "__all")
    laid = laid.filter("__n > 0").withColumn("__end", F.col("__start") + F.col("__n"))
    first, last = F.floor(F.col("__start") / block), F.floor((F.col("__end") - 1) / block)
    each = laid.withColumn("block", F.explode(F.sequence(first, last))).filter((F.col("block") + 1) * block <= F.col("__all"))
    at = F.greatest(F.col("__start") - F.col("block") * block, F.lit(0))
    upto = F.least(F.col("__end") - F.col("block") * block, F.lit(block))
    return each.select(by, order, "block", at.cast("long").alias("at"), (upto - at).cast("long").alias("taken"))


def mismatch(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each row with the value of the row before it in its group; the first takes the last."""
    w = Window.partitionBy(by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("other", F.coalesce(F.lag(value).over(w), F.last(value).over(whole)))


def ema_last(values: Column, count: Column) -> Column:
    """The last value of `ema`, without the array of all before it."""
    weight = 1.8 * (1 / (1 + F.exp(-0.05 * count)) - 0.5)
    new = lambda s, x: F.when(s.isNull(), x.cast("double")).otherwise(s * weight + x * (1 - weight))
    return F.aggregate(values, F.lit(None).cast("double"), new)


def ema(values: Column, count: Column) -> Column:
    """Exponential smoothing of an array, seeded with its first value; the weight grows with
    the number of values. The array grows by copies, so for short series."""
    weight = 1.8 * (1 / (1 + F.exp(-0.05 * count)) - 0.5)
    fold = F.aggregate(values, F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out")),
                       lambda s, x: _step(s, x, weight))
    return fold["out"]


def _step(s: Column, x: Column, weight: Column) -> Column:
    new = F.when(s["last"].isNull(), x.cast("double")).otherwise(s["last"] * weight + x * (1 - weight))
    return F.struct(new.alias("last"), F.array_append(s["out"], new).alias("out"))


def dedupe_names(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Adds uid: the first of equal names stays plain, later ones get part of a hash."""
    ranked = prefix(rows, [order], [base], before="__k")
    later = F.concat_ws("_", base, F.substring(F.sha1(F.concat_ws(":", base, F.col(order).cast("string"))), 1, 8))
    return ranked.withColumn("uid", F.when(F.col("__k") == 0, F.col(base)).otherwise(later)).drop("__k")


def uniform_frames(total: Column, k: int) -> Column:
    """k frame numbers spread evenly over [0, total), cut to whole numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (total - 1) / F.lit(max(1, k - 1))).cast("int"))


def prefer(rows: Sequence[tuple[int, DataFrame]], key: str) -> DataFrame:
    """Union by priority: of rows with equal keys, that of the smallest number stays."""
    both: DataFrame | None = None
    for p, r in rows:
        r = r.withColumn("__p", F.lit(p))
        both = r if both is None else both.unionByName(r, allowMissingColumns=True)
    assert both is not None
    k = F.row_number().over(Window.partitionBy(key).orderBy("__p"))
    return both.withColumn("__k", k).filter("__k = 1").drop("__k", "__p")


def multiset_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each key is missing on either side, counted in one pass over both."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    out = both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return out.select(*keys, F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("only_left"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("only_right"))
