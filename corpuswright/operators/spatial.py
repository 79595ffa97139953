"""Spatial and interval joins and the box operators that depend on order.

Boxes of one image are compared through grid cells: each box is exploded into the cells it
touches, boxes meet by equality on (image, cell), and a pair counts only in the cell that
holds the upper left corner of its intersection. So neither an image with very many boxes nor
a frame without image ids becomes a join of everything with everything.
"""

from __future__ import annotations

from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuswright.functions import geometry as G
from corpuswright.operators.grouped import by_runs, schema_of

COLUMNS = ("x1", "y1", "x2", "y2")


def _cells(boxes: DataFrame, cell: float) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    return boxes.withColumn("__cx", F.explode(span("x1", "x2"))).withColumn("__cy", F.explode(span("y1", "y2")))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 64.0) -> DataFrame:
    """All overlapping pairs of boxes with equal keys: columns l_*, r_* and iou. Each pair
    comes once."""
    a = _cells(left.filter("x1 <= x2 AND y1 <= y2"), cell)
    b = _cells(right.filter("x1 <= x2 AND y1 <= y2"), cell)
    a = a.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], "__cx", "__cy", *[F.col(k).alias(f"__{k}") for k in keys])
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], "__cx", "__cy", *[F.col(k).alias(f"__{k}") for k in keys])
    met = a.join(b, [f"__{k}" for k in keys] + ["__cx", "__cy"])
    la, rb = G.box("l_"), G.box("r_")
    home = (F.floor(F.greatest(la[0], rb[0]) / cell) == F.col("__cx")) & (F.floor(F.greatest(la[1], rb[1]) / cell) == F.col("__cy"))
    return met.filter(G.overlaps(la, rb) & home).withColumn("iou", G.iou(la, rb)).drop("__cx", "__cy", *[f"__{k}" for k in keys])


def best_match(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, least: float = 0.0, cell: float = 64.0) -> DataFrame:
    """Each left row with the right box of the largest IoU over `least` (null if none); ties
    go to the smaller right id."""
    pairs = overlap_pairs(left, right, keys, cell).filter(F.col("iou") > least)
    best = pairs.groupBy(*[F.col(f"l_{k}").alias(k) for k in keys], F.col(f"l_{left_id}").alias(left_id)).agg(F.min(F.struct((-F.col("iou")).alias("n"), F.col(f"r_{right_id}").alias("id"))).alias("b"))
    best = best.select(*keys, left_id, F.col("b.id").alias(f"best_{right_id}"), (-F.col("b.n")).alias("best_iou"))
    return left.join(best, [*keys, left_id], "left")


def best_of_few(left: DataFrame, right: DataFrame, keys: list[str], right_id: str, least: float = 0.0) -> DataFrame:
    """As `best_match`, row by row, where a key has few right boxes, such as an image's quadrants: they come to
    each left row as one array, so that no pair is shuffled."""
    lists = right.filter("x1 <= x2 AND y1 <= y2").groupBy(*keys).agg(F.collect_list(F.struct(*COLUMNS, F.col(right_id).alias("id"))).alias("__few"))
    # There is a list for each key, which an estimate by file sizes knows nothing of: it is never broadcast.
    met = left.join(lists.hint("merge"), keys, "left") if keys else left.crossJoin(lists)
    a, proper = G.box(), F.expr("x1 <= x2 AND y1 <= y2")
    at = lambda q: tuple(q[c] for c in COLUMNS)
    some = F.filter("__few", lambda q: proper & G.overlaps(a, at(q)))
    some = F.transform(some, lambda q: F.struct((-G.iou(a, at(q))).alias("n"), q["id"].alias("id")))
    best = met.withColumn("__best", F.array_min(F.filter(some, lambda q: q["n"] < -least)))
    return best.select(*left.columns, F.col("__best.id").alias(f"best_{right_id}"), (-F.col("__best.n")).alias("best_iou"))


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def suppress(boxes: DataFrame, keys: list[str], score: str = "score", order: str = "det_id", limit: float = 0.5) -> DataFrame:
    """Greedy suppression within a key: by falling score, a box stays if its IoU with all that
    stayed is at most the limit. Sequential by nature; a key is one image's boxes."""
    at = itemgetter(*(boxes.columns.index(c) for c in COLUMNS))

    def run(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in rows:
            if all(_iou(at(r), at(k)) <= limit for k in kept):
                kept.append(r)
        return kept

    return by_runs(boxes, keys, [F.desc(score), order], run, schema_of(boxes))


def merge_close(boxes: DataFrame, keys: list[str], order: str = "det_id", dx: float = 12.5, dy: float = 20.0, pad: float = 3.0) -> DataFrame:
    """Clusters by the first seed whose centre lies within dx and dy; a cluster is the padded
    hull of its boxes, numbered by its seed."""
    narrow = boxes.select(*keys, order, *COLUMNS)
    n = len(keys)

    def run(rows: list[tuple]) -> list[tuple]:
        seeds: list[list] = []
        for r in rows:
            x1, y1, x2, y2 = r[n + 1 :]
            cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
            near = next((s for s in seeds if abs(s[0] - cx) < dx and abs(s[1] - cy) < dy), None)
            if near is None:
                seeds.append([cx, cy, r[n], x1, y1, x2, y2, 1])
            else:
                near[3:] = [min(near[3], x1), min(near[4], y1), max(near[5], x2), max(near[6], y2), near[7] + 1]
        return [(*rows[0][:n], s[2], s[3] - pad, s[4] - pad, s[5] + pad, s[6] + pad, s[7]) for s in seeds]

    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", seed {kinds[order]}, x1 double, y1 double, x2 double, y2 double, members long"
    return by_runs(narrow, keys, [order], run, schema)


def greedy_matches(pairs: DataFrame, keys: list[str], left: str, right: str, weight: str) -> DataFrame:
    """One-to-one matching that takes the best pair left again and again; ties by ids."""
    i, j = pairs.columns.index(left), pairs.columns.index(right)

    def run(rows: list[tuple]) -> list[tuple]:
        a, b, kept = set(), set(), []
        for r in rows:
            if r[i] not in a and r[j] not in b:
                a.add(r[i])
                b.add(r[j])
                kept.append(r)
        return kept

    return by_runs(pairs, keys, [F.desc(weight), left, right], run, schema_of(pairs))


def hungarian(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Least-cost assignment (rows, columns) by shortest augmenting paths with potentials."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if n > m:
        return sorted((i, j) for j, i in hungarian([[cost[i][j] for i in range(n)] for j in range(m)]))
    inf = float("inf")
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [inf] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0], i0, delta, j1 = True, match[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def optimal_matches(pairs: DataFrame, keys: list[str], left: str, right: str, cost: str) -> DataFrame:
    """Least-cost one-to-one matching within a key over the given pairs; missing pairs cost
    more than all others together."""
    i, j, c = (pairs.columns.index(x) for x in (left, right, cost))

    def run(rows: list[tuple]) -> list[tuple]:
        table = {(r[i], r[j]): r for r in reversed(rows)}
        a, b = sorted({x for x, _ in table}), sorted({y for _, y in table})
        high = sum(abs(r[c]) for r in table.values()) + 1.0
        chosen = hungarian([[table[x, y][c] if (x, y) in table else high for y in b] for x in a])
        return [table[a[x], b[y]] for x, y in chosen if (a[x], b[y]) in table]

    return by_runs(pairs, keys, [left, right], run, schema_of(pairs))


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Union of intervals within a key; touching ones merge. Gaps and islands by window."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, start, end, F.when(F.col(start) <= before, 0).otherwise(1).alias("__new"))
    island = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("__island")


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Overlapping intervals (s, e) of equal keys: l_*, r_*; each pair once, in the bucket
    where its overlap begins. Intervals meet by equality on time buckets of `width`."""
    cut = lambda t: t.withColumn("__b", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    a = cut(left).select(*[F.col(c).alias(f"l_{c}") for c in left.columns], "__b", *[F.col(k).alias(f"__{k}") for k in keys])
    b = cut(right).select(*[F.col(c).alias(f"r_{c}") for c in right.columns], "__b", *[F.col(k).alias(f"__{k}") for k in keys])
    met = a.join(b, [f"__{k}" for k in keys] + ["__b"])
    first = F.floor(F.greatest("l_s", "r_s") / width) == F.col("__b")
    return met.filter((F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e")) & first).drop("__b", *[f"__{k}" for k in keys])

