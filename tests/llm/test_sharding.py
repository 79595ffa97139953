import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from corpuswright.llm import queries, sharding


def check(got, rows, shards=16, spread=None):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if spread:
        assert max(sizes.values()) - min(sizes[k] for k in range(shards)) <= spread
    return sizes


def test_query(spark, sf, rows):
    got = queries.op5_sharding(spark, sf).collect()
    largest = max(len(r.text.encode()) for r in rows)
    check(got, rows, spread=3 * largest)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_odd_rows(odd, empty):
    got = sharding.report(odd).collect()
    check(got, odd.collect())
    assert sharding.report(empty).collect() == []


@pytest.mark.parametrize("shards", [1, 3, 7, 64])
def test_any_number_of_shards_and_hot_groups(spark, shards):
    """A third of the rows are copies and a half share a source; shards stay equal."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 20)).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"),
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.lit(None).cast("string").alias("lang"),
    )
    got = sharding.kd_shards(docs, shards, per_bucket=100).collect()
    sizes = check(got, docs.collect(), shards)
    assert len(sizes) == shards and max(sizes.values()) <= 1.02 * sum(sizes.values()) / shards + 101


def test_leaves_follow_metadata(spark):
    """With one wide dimension the leaves are ranges of it, and equal texts stay together."""
    docs = spark.range(4000).selectExpr("id doc_id", "concat('t', lpad(id div 4, 4, '0')) text", "cast(id div 1000 as double) v")
    got = sharding.kd_shards(docs, 4, dims=("v",)).collect()
    assert all(r.shard == r.doc_id // 1000 for r in got)
    by_text = defaultdict(set)
    for r in sharding.kd_shards(docs, 16, dims=("v",)).collect():
        by_text[r.doc_id // 4].add(r.shard)
    assert sum(len(s) > 1 for s in by_text.values()) <= 16


def test_main_path_has_no_python(spark, sf):
    plan = queries.op5_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_tree(rows, shards, dims=("source", "lang", "size")):
    """{row number: shard} by sorting each node's rows, straight from the definition."""
    ranks = {d: {v: float(k) for k, v in enumerate(sorted({r[d] for r in rows if r[d] is not None}, key=lambda x: x.encode()))} for d in dims if d != "size"}
    signed = lambda x: x - (1 << 64) * (x >> 63)
    points = []
    for n, r in enumerate(rows):
        text_hash = signed(xxhash.xxh64_intdigest((r["text"] or "").encode(), 42)) if r["text"] is not None else 42
        tail = (text_hash % (1 << 28) << 12) + signed(xxhash.xxh64_intdigest(struct.pack("<q", n), 42)) % (1 << 12)
        size = len((r["text"] or "").encode()) + 1
        points.append((n, size, [math.log(size) / math.log(2) if d == "size" else ranks[d].get(r[d]) for d in dims], tail))
    keys = {}
    for k in range(len(dims)):
        known = [p[2][k] for p in points if p[2][k] is not None]
        lo, hi = (min(known), max(known)) if known else (0.0, 0.0)
        for n, _, raw, tail in points:
            at = 0 if raw[k] is None else math.floor((raw[k] - lo) / ((hi - lo) or 1.0) * float((1 << 20) - 2) + 1)
            keys[n, k] = (at << 40) + tail
    out = {}

    def split(own, first, leaves):
        if leaves == 1 or not own:
            out.update({p[0]: first for p in own})
            return
        width = lambda k: max(keys[p[0], k] >> 40 for p in own) - min(keys[p[0], k] >> 40 for p in own)
        dim = max(range(len(dims)), key=lambda k: (width(k), -k))
        left = leaves // 2
        want = sum(p[1] for p in own) * left // leaves
        weights = Counter()
        for p in own:
            weights[keys[p[0], dim]] += p[1]
        for key, w in sorted(weights.items()):
            if want < w:
                cut = key + (2 * want > w)
                break
            want -= w
        split([p for p in own if keys[p[0], dim] < cut], first, left)
        split([p for p in own if keys[p[0], dim] >= cut], first + left, leaves - left)

    split(points, 0, shards)
    return out


@pytest.mark.parametrize("shards", [16, 5])
def test_query_is_the_tree(spark, sf, rows, shards):
    """The whole table against a tree built by sorting, with exact medians."""
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    want = slow_tree([r.asDict() for r in rows], shards)
    got = {r.doc_id: r.shard for r in sharding.kd_shards(one, shards, tolerance=0).collect()}
    assert len(got) == len(rows) and got == {rows[n].doc_id: s for n, s in want.items()}


def test_strings_that_differ_late(spark):
    """Strings are ranked whole: those of one long prefix are as far apart as any."""
    docs = spark.range(1600).selectExpr("id doc_id", "concat('t', id) text", "concat('the-same-long-prefix-', lpad(id % 16, 2, '0')) source", "cast(null as string) lang")
    got = sharding.kd_shards(docs, 16, dims=("source",), tolerance=0).collect()
    assert len({(r.shard, r.doc_id % 16) for r in got}) <= 16 + 15  # leaves follow the sources


def test_ranks_of_many_values(spark):
    table = spark.range(5000).selectExpr("if(id % 7 = 0, null, concat('v', id * 7919 % 5000)) v")
    got = {r.x: r.k for r in sharding.ranks(table, "v", "x", "k").collect()}
    assert got == {v: float(k) for k, v in enumerate(sorted(r.v for r in table.collect() if r.v is not None))}
