"""Shards of nearly equal bytes by a K-d tree over metadata, in DataFrame operations only.

Each node is split at the weighted (by bytes) median of its widest dimension until every
leaf holds its share. Medians are exact to `tolerance`: a split's 60-bit key is searched from
its top bits down by distributed histograms of 4096 bins for each node, so what reaches the
driver is bounded by nodes times bins, whatever the number of rows. A key has the dimension's
coordinate on top, the text's hash below it and the row's hash last: equal coordinates (a hot
source or language) are cut by text, so equal texts with equal metadata stay together
wherever the law allows it, and a group of copies larger than a shard is cut by row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_one, materialise

COORD, TEXT, ROW = 20, 28, 12
KEY = COORD + TEXT + ROW
STEP = 12  # bits of a histogram
STORE_EVERY = 5  # levels after which the node of a row is stored, so that its expression stays short


@dataclass
class Node:
    first: int  # its leaves: first, first + 1, ...
    leaves: int
    dim: int = 0
    cut: int = 0  # keys below go left
    parts: tuple[Node, Node] | None = None

    def split(self) -> tuple[Node, Node]:
        left = self.leaves // 2
        self.parts = Node(self.first, left), Node(self.first + left, self.leaves - left)
        return self.parts


def ranks(docs: DataFrame, column: str, value: str, rank: str) -> DataFrame:
    """A stored table of the distinct non-null strings of a column with their rank from 0 in byte
    order. They are sorted by range partition and numbered within; the partitions' counts, a row
    each, give the offsets."""
    distinct = docs.select(F.col(column).alias(value)).filter(F.col(value).isNotNull()).distinct()
    sorted_, _ = materialise(distinct.repartitionByRange(value).sortWithinPartitions(value).withColumn("at", F.monotonically_increasing_id()), "sorted-values")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    offsets = sorted_.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = sorted_.withColumn("part", part).join(F.broadcast(offsets), "part").select(value, (inside + F.col("offset")).cast("double").alias(rank))
    return materialise(ranked, "ranks")[0]


def slim_rows(docs: DataFrame, dims: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, size, text_crc32, a row number, hashes and raw coordinates: numbers as they are,
    strings by their rank among all distinct values. Null for null."""
    kinds = {f.name: f.dataType for f in docs.schema}
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    strings = [k for k, d in enumerate(dims) if d != "__size" and isinstance(kinds[d], T.StringType)]
    raw = [F.log2(size) if d == "__size" else F.col(d) if k in strings else F.col(d).cast("double") for k, d in enumerate(dims)]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.encode(text, "utf-8"), F.lit(b""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("text_hash"), *[r.alias(f"value{k}" if k in strings else f"raw{k}") for k, r in enumerate(raw)],
    )
    for k in strings:
        rows = join_one(rows, ranks(docs, dims[k], f"value{k}", f"raw{k}"), f"value{k}").drop(f"value{k}")
    return rows


def _walk(roots: list[Node], keys: list[Column], at_end: Callable[[Node], Column]) -> Column:
    """The value that at_end gives for the node a row has come to so far; the size of the
    expression follows the number of nodes below the stored ones."""

    def below(n: Node) -> Column:
        return F.when(keys[n.dim] < F.lit(n.cut), below(n.parts[0])).otherwise(below(n.parts[1])) if n.parts else at_end(n)

    out = below(roots[-1])
    for r in roots[:-1]:
        out = F.when(F.col("base") == r.first, below(r)).otherwise(out)
    return out


def _find_cuts(rows: DataFrame, roots: list[Node], level: list[Node], keys: list[Column], weights: dict[int, int], tolerance: int) -> None:
    """Sets each splitting node's cut: the key below which its left part's bytes lie."""
    todo = [n for n in level if n.leaves > 1]
    table = rows.select(_walk(roots, keys, lambda n: F.lit(n.first)).alias("node"), _walk(roots, keys, lambda n: keys[n.dim]).alias("key"), "size")
    state = {n.first: [0, weights[n.first] * (n.leaves // 2) // n.leaves] for n in todo}  # prefix, bytes wanted to its right
    done: dict[int, int] = {}
    for shift in range(KEY - STEP, -1, -STEP):
        open_ = [n.first for n in todo if n.first not in done]
        if not open_:
            break
        inside = F.lit(False)
        for f in open_:
            inside = inside | ((F.col("node") == f) & (F.shiftright("key", shift + STEP) == F.lit(state[f][0])))
        bins = table.filter(inside).groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("w"))
        got: dict[int, list] = {}
        for r in bins.collect():  # at most nodes x 4096
            got.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for f in open_:
            want = state[f][1]
            for b, w in sorted(got.get(f, [])):
                if want < w:
                    break
                want -= w
            else:
                done[f] = (b + 1) << shift if got.get(f) else state[f][0] << (shift + STEP)
                continue
            if w <= tolerance or not shift:
                done[f] = (b + (2 * want > w)) << shift
            else:
                state[f] = [b, want]
    for n in todo:
        n.cut = done[n.first]


def kd_shards(docs: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("source", "lang", "__size"), tolerance: float = 0.001, per_bucket: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) for each row.

    `dims` are columns of docs (those it lacks are left out) or "__size", the text's bytes. A
    null coordinate is the smallest, a null text has size 1. A split is settled when what
    lies between it and the median is at most `tolerance` of a shard's share, or one row.
    Repeated rows are rows. An empty table gives an empty result.
    """
    dims = [d for d in dims if d == "__size" or d in docs.columns] or ["__size"]
    rows, _ = materialise(slim_rows(docs, dims, id_col, text_col), "shard-rows")
    ends = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), *[f(f"raw{k}") for k in range(len(dims)) for f in (F.min, F.max)]).first()
    count, total, spans = ends[0], ends[1], ends[2:]
    tail = F.pmod(F.col("text_hash"), F.lit(1 << TEXT)) * F.lit(1 << ROW) + F.pmod(F.xxhash64("row"), F.lit(1 << ROW))
    keys = []
    for k in range(len(dims)):
        lo, hi = spans[2 * k] or 0.0, spans[2 * k + 1] or 0.0
        scaled = (F.col(f"raw{k}") - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(float((1 << COORD) - 2)) + 1
        keys.append(F.coalesce(F.floor(scaled), F.lit(0)).cast("long") * F.lit(1 << (TEXT + ROW)) + tail)
    keyed = rows.select("doc_id", "size", "text_crc32", "row", *[x.alias(f"key{k}") for k, x in enumerate(keys)]).withColumn("base", F.lit(0))
    keyed, _ = materialise(keyed, "shard-keys")  # the passes below compare stored keys
    keys = [F.col(f"key{k}") for k in range(len(dims))]
    roots = level = [Node(0, shards)]
    depth = 0
    while count and any(n.leaves > 1 for n in level):
        if depth and depth % STORE_EVERY == 0:
            keyed, _ = materialise(keyed.withColumn("base", _walk(roots, keys, lambda n: F.lit(n.first))), "shard-nodes")
            roots = level
        node = _walk(roots, keys, lambda n: F.lit(n.first))
        sides = [f(F.shiftright(x, TEXT + ROW)).alias(f"{f.__name__}{k}") for k, x in enumerate(keys) for f in (F.min, F.max)]
        stats = {r["node"]: r for r in keyed.groupBy(node.alias("node")).agg(F.sum("size").alias("w"), *sides).collect()}  # a row for each node
        for n in level:
            if r := stats.get(n.first):
                n.dim = max(range(len(dims)), key=lambda k: (r[f"max{k}"] - r[f"min{k}"], -k))
        weights = {n.first: stats[n.first]["w"] if n.first in stats else 0 for n in level}
        _find_cuts(keyed, roots, level, keys, weights, int(tolerance * total / shards))
        level = [m for n in level for m in (n.split() if n.leaves > 1 else (n,))]
        depth += 1
    placed = keyed.select("doc_id", "size", "text_crc32", "row", _walk(roots, keys, lambda n: F.lit(n.first)).cast("int").alias("shard"))
    return number_slots(placed, max(1, -(-count // (shards * per_bucket))))


def number_slots(placed: DataFrame, width: int) -> DataFrame:
    """Numbers each shard's rows from 0 without bringing a shard into one task: rows are
    numbered in `width` hash buckets of a shard, whose counts give the buckets' offsets."""
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(width)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")
    numbered = dealt.withColumn("n", F.row_number().over(inside) - 1).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("n") + F.col("offset")).cast("long").alias("slot"))


def report(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """The shards as the contract's row: law `bytes`, no grown shard."""
    return kd_shards(docs, shards, **options).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
