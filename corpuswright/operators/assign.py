"""Findings assigned to what they lie on, and what happens where findings of one image conflict.

Which box a finding overlaps most comes from the cell join of `spatial`, its quadrant from the few of its image. Rules that depend on the order of
findings run within one image, whose findings are few by nature.
"""

from __future__ import annotations

from collections.abc import Mapping
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions import geometry as G
from corpuswright.operators.grouped import by_runs, schema_of
from corpuswright.operators.spatial import COLUMNS, best_match, best_of_few

Box = tuple[float, float, float, float]


def iou(a: Box, b: Box) -> float:
    """Overlap over union; 0 for boxes that only touch."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def best_per_target(findings: DataFrame, targets: DataFrame, keys: list[str], finding_id: str, target_id: str, label: str, score: str, unknown: str = "unknown") -> DataFrame:
    """keys, target (text; `unknown` for a finding that overlaps none), label and the best score of each."""
    placed = best_match(findings, targets, keys, finding_id, target_id)
    target = F.coalesce(F.col(f"best_{target_id}").cast("string"), F.lit(unknown)).alias("target")
    return placed.groupBy(*keys, target, label).agg(F.max(score).alias(score))


def reassigned(findings: DataFrame, targets: DataFrame, keys: list[str], finding_id: str, target_id: str, least: float = 0.5) -> DataFrame:
    """Findings of unknown place with the target they overlap by more than `least`; others stay
    without one."""
    return best_match(findings, targets, keys, finding_id, target_id, least)


def routed(label: Column, routes: Mapping[str, str], otherwise: str = "tooth") -> Column:
    """Which list a finding goes to, by its class."""
    out = F.lit(otherwise)
    for name, route in routes.items():
        out = F.when(label == name, route).otherwise(out)
    return out


def keep_higher(rows: DataFrame, keys: list[str], order: str, score: str = "score") -> DataFrame:
    """A list that grows in order: a finding that overlaps one of the list takes its place if its
    score is higher and is dropped otherwise; one that overlaps none is appended."""
    at, s = itemgetter(*(rows.columns.index(c) for c in COLUMNS)), rows.columns.index(score)

    def run(own: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in own:
            met = next((i for i, k in enumerate(kept) if iou(at(k), at(r)) > 0), None)
            if met is None:
                kept.append(r)
            elif r[s] > kept[met][s]:
                kept[met] = r
        return kept

    return by_runs(rows, keys, [order], run, schema_of(rows))


def strong_over_weak(rows: DataFrame, keys: list[str], order: str, strong: Column, weak: Column, score: str = "score") -> DataFrame:
    """In order: a strong finding that overlaps a strong one leaves that one with the higher score; else it
    removes the weak ones that it overlaps and stays. A weak finding that overlaps a strong one is
    dropped. Findings that are neither stay."""
    side = F.when(strong, 2).when(weak, 1).otherwise(0)
    marked = rows.withColumn("__side", side)
    at, s, m = itemgetter(*(marked.columns.index(c) for c in COLUMNS)), marked.columns.index(score), marked.columns.index("__side")

    def run(own: list[tuple]) -> list[tuple]:
        kept: list[list] = []
        for r in map(list, own):
            over = [k for k in kept if k[m] == 2 and iou(at(k), at(r)) > 0]
            if r[m] and over:
                if r[m] == 2:
                    over[0][s] = max(over[0][s], r[s])
                continue
            if r[m] == 2:
                kept = [k for k in kept if k[m] != 1 or iou(at(k), at(r)) <= 0]
            kept.append(r)
        return [tuple(k) for k in kept]

    return by_runs(marked, keys, [order], run, schema_of(marked)).drop("__side")


def merge_near_equal(rows: DataFrame, keys: list[str], order: str, conditions: str, score: str = "score", limit: float = 0.95) -> DataFrame:
    """Pairs in order whose boxes are nearly equal leave the one with the higher score (the earlier of
    equals), which takes over the other's conditions (a map to scores; the higher counts). What a
    row took over goes on with it."""
    at, s, c = itemgetter(*(rows.columns.index(x) for x in COLUMNS)), rows.columns.index(score), rows.columns.index(conditions)

    def run(own: list[tuple]) -> list[tuple]:
        left = [list(r) for r in own]
        gone = [False] * len(left)
        for i in range(len(left)):
            for j in range(i + 1, len(left)):
                if gone[i]:
                    break
                if gone[j] or iou(at(left[i]), at(left[j])) <= limit:
                    continue
                win, lose = (i, j) if left[i][s] >= left[j][s] else (j, i)
                merged = dict(left[win][c] or {})
                for k, v in dict(left[lose][c] or {}).items():
                    merged[k] = max(v, merged.get(k, v))
                left[win][c], gone[lose] = list(merged.items()), True
        return [tuple(r) for r, g in zip(left, gone) if not g]

    return by_runs(rows, keys, [order], run, schema_of(rows))


def quadrant(findings: DataFrame, quadrants: DataFrame, keys: list[str], finding_id: str, name: str, width: Column, height: Column) -> DataFrame:
    """Adds side: the quadrant overlapped most, and for a finding that overlaps none that of its
    centre."""
    placed = best_of_few(findings, quadrants, keys, name)
    x, y = G.centre(G.box())
    upper = F.when(x < width / 2, "upper right").otherwise("upper left")
    lower = F.when(x > width / 2, "lower left").otherwise("lower right")
    return placed.withColumn("side", F.coalesce(F.col(f"best_{name}"), F.when(y < height / 2, upper).otherwise(lower)))
