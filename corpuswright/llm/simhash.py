"""SimHash near-duplicate groups found by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit halves. Two fingerprints that differ in at most
three bits differ in at most one bit in one of the halves, so they agree on that half with
one bit deleted. Each distinct fingerprint is indexed under every half with every single bit
wildcarded (64 keys); equal keys are joined and verified on all 64 bits.

Copies share a fingerprint and count once, so a group of exact copies costs one node. A key
shared by many fingerprints is never expanded into all its pairs: each bucket gives the
edges of a spanning forest of its links. Buckets over `hot` members are cut again by the same
rule on the other half (its two 16-bit quarters, one bit wildcarded). The members of such an
inner bucket differ in at most 18 known bits, so there are at most 2**18 of them, however
large the corpus is, and neighbours are found by probing these bits.

Near copies whose fingerprints lie further apart are found by `similar_links`: texts whose
sets of five-word shingles have a Jaccard similarity of `SIMILAR` or more. Texts that share
one of `BANDS` keys, each made of `ROWS` minima of hashes, are compared by their whole sets.
A pair at exactly 0.8 shares no key once in 38,000 times, closer ones less often. Keys of many
texts are first compared in parts; `_open_links` then finds every link that the parts left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_text, join_by_count, map_slices, materialise, remove, slices, small_batches

BITS, SEED, NEAR = 64, 42, 3
HOT = 16_384
SIMILAR, SIMILAR_WORDS, BANDS, ROWS = 0.8, 5, 20, 4
PART = 512  # texts of one key that are compared at once
ROWS_A_TASK, MOST_TASKS = 8192, 20_000  # of fingerprints when their variants are made


def shingle_hashes(text: str | None, words: int = 3, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's word shingles in their order; a shorter text is one shingle."""
    tokens = (text or "").encode().lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    n = max(1, len(tokens) - words + 1)
    if n == 1:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i : n + i] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band: equal where `rows` minima of the hashes, each in its own order, agree."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    by, least = _odd(bands * rows, SEED), np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(hashes), 4096):
        mixed = hashes[lo : lo + 4096, None] * by
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(0))
    keys = (least * _odd(bands * rows, SEED + 1)).reshape(bands, rows).sum(1, dtype=np.uint64)
    return ((keys ^ keys >> np.uint64(31)) * _odd(bands, SEED + 2) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """SimHash of a text's word shingles; 0 where there is no word."""
    hashes = shingle_hashes(text, words, seed)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_hash: bool = False, bands: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and text_hash and bands (the keys of
    `band_keys`, none for a text without words) if asked for."""
    narrow = id_text(docs, id_col, text_col)
    if keep_hash:
        narrow = narrow.withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            fps = np.fromiter(map(fingerprint, part.column(1).to_pylist()), np.uint64, part.num_rows)
            more = [pa.array([band_keys(shingle_hashes(t, SIMILAR_WORDS)) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))] * bands
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), *part.columns[2:], *more], ["doc_id", "fp", *part.schema.names[2:], *["bands"] * bands])

    return narrow.mapInArrow(run, "doc_id long, fp long" + ", text_hash long" * keep_hash + ", bands array<long>" * bands)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64))


def spanning_edges(fps: np.ndarray, near: int = NEAR, probe_over: int = 20_000) -> np.ndarray:
    """Edges (positions, n x 2) of a spanning forest of the links among distinct fingerprints.

    A breadth-first search that compares each reached member with those not reached yet, so
    a dense group costs little more than one comparison a member. Where more than
    `probe_over` are left and all differ in at most 18 known bits (an inner bucket), the
    neighbours are looked up instead.
    """
    order = np.argsort(fps)
    fps = fps[order]
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(BITS) if free >> b & 1]
    patterns = None
    if len(fps) > probe_over and len(bits) <= 18:
        patterns = np.array([sum(1 << b for b in some) for k in range(1, near + 1) for some in combinations(bits, k)], np.uint64)
    left, open_, edges, seen = np.arange(len(fps)), [], [], np.zeros(len(fps), bool)
    while True:
        if not open_:
            left = left[~seen[left]]
            if not len(left):
                break
            open_.append(int(left[0]))
            seen[left[0]] = True
            left = left[1:]
        at = open_.pop()
        if patterns is not None and len(left) > probe_over:
            other = fps[at] ^ patterns
            to = np.searchsorted(fps, other)
            to[to == len(fps)] = 0
            got = to[(fps[to] == other) & ~seen[to]]
            seen[got] = True
            if len(got):
                left = left[~seen[left]]
        else:
            close = popcount(fps[left] ^ fps[at]) <= near
            got = left[close]
            seen[got] = True
            left = left[~close]
        edges += [(at, x) for x in got.tolist()]
        open_ += got.tolist()
    return order[np.array(edges, np.int64).reshape(-1, 2)]


def _variants(fp, shift: int, width: int, tag: int):
    """Keys of the field of `width` bits at `shift`: each bit cleared in turn, with the
    bit's number and the field's tag above. The field and the key fit in a long."""
    field = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.transform(
        F.array(*[F.lit(b) for b in range(width)]),
        lambda b: field.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), b))) + (F.lit(tag * width) + b).cast("long") * F.lit(1 << width).cast("long"),
    )


def _edges(grouped: DataFrame) -> DataFrame:
    """Edges from rows with an array `members` of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            two = first[sizes == 2]
            a, b = values[two], values[two + 1]
            near = popcount((a ^ b).view(np.uint64)) <= NEAR
            out = [np.stack((a[near], b[near]), 1)]
            for lo, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = values[lo : lo + n]
                out.append(own[spanning_edges(own.view(np.uint64))])
            found = np.concatenate(out)
            found.sort(axis=1)
            found = np.unique(found, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["parent", "child"])

    return grouped.select("members").mapInArrow(run, "parent long, child long").distinct()


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (parent < child) that connect whatever links of at most three bits connect,
    for a stored table of distinct fingerprints `fp`. Buckets of over `hot` members take
    the inner index."""
    fp = F.col("fp")
    # Each row becomes 64, so a stored file's few rows are dealt to many tasks first.
    tasks = min(MOST_TASKS, distinct.count() // ROWS_A_TASK + 1)
    keys = distinct.repartition(tasks, "fp").select("fp", F.explode(F.concat(_variants(fp, 0, 32, 0), _variants(fp, 32, 32, 1))).alias("key"))
    shared, path = materialise(keys.groupBy("key").count().filter("count > 1"), "buckets")
    few, many = shared.filter(F.col("count") <= hot).select("key"), shared.filter(F.col("count") > hot).select("key")
    edges = _edges(keys.join(few, "key").groupBy("key").agg(F.collect_list("fp").alias("members")))
    if many.limit(1).count():
        half = F.when(F.shiftrightunsigned(F.col("key"), 32) < 32, F.shiftrightunsigned(fp, 32)).otherwise(fp)
        inner = keys.join(many, "key").withColumn("half", half)
        inner = inner.select("fp", "key", F.explode(F.concat(_variants(F.col("half"), 0, 16, 0), _variants(F.col("half"), 16, 16, 1))).alias("inner"))
        edges = edges.union(_edges(inner.groupBy("key", "inner").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1))).distinct()
    return edges


def similar_forest(sets: list[np.ndarray], least: float = SIMILAR) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges (positions) of a spanning forest of the links among sets (sorted, distinct) of a
    Jaccard similarity of `least` or more, and the first position of each of its trees."""
    left, edges, firsts = list(range(len(sets))), [], []
    while left:
        firsts.append(left[0])
        open_, left = [left[0]], left[1:]
        while open_ and left:
            at = open_.pop()
            own = sets[at]
            sizes = np.array([len(sets[x]) for x in left])
            fits = np.minimum(sizes, len(own)) / np.maximum(sizes, len(own)) >= least
            got = set()
            for x in np.array(left)[fits].tolist():
                both = np.concatenate((own, sets[x]))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if common / (len(both) - common) >= least:
                    got.add(x)
            edges += [(at, x) for x in sorted(got)]
            open_ += sorted(got)
            left = [x for x in left if x not in got]
    return edges, firsts


def _similar(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """parent, child (fingerprints, parent < child) of the links within each (key, part) of
    members; and a row with key, h for the text of smallest id of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key, group):
            group.sort(key=lambda m: m[:2])
            edges, firsts = similar_forest([m[3] for m in group], least)
            linked = sorted({(min(a, b), max(a, b)) for a, b in ((group[x][2], group[y][2]) for x, y in edges) if a != b})
            cols = [[a for a, _ in linked] + [None] * len(firsts), [b for _, b in linked] + [None] * len(firsts), [None] * len(linked) + [key] * len(firsts), [None] * len(linked) + [group[x][1] for x in firsts]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["parent", "child", "key", "h"])

        now, group = None, []
        for batch in batches:
            for key, part, first, h, fp, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != now:
                    if group:
                        yield close(now[0], group)
                    now, group = (key, part), []
                group.append((first, h, fp, np.frombuffer(words, np.uint64)))
        if group:
            yield close(now[0], group)

    dealt = members.join(sets, "h").repartition("key", "part").sortWithinPartitions("key", "part")
    return small_batches(dealt.select("key", "part", "first", "h", "fp", "words")).mapInArrow(run, "parent long, child long, key long, h long")


def crossing_links(roots: list[int], sets: list[np.ndarray], sides: list[bool], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Pairs (positions) of sets of a Jaccard similarity of `least` or more that connect whatever such
    pairs connect, given that equal roots are connected. If both sides occur, only pairs across count."""
    up = {r: r for r in roots}

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    order = sorted(range(len(sets)), key=lambda x: len(sets[x]))
    sizes = np.array([len(sets[x]) for x in order])
    firsts = np.cumsum(sizes) - sizes
    values, codes = np.unique(np.concatenate([sets[x] for x in order]), return_inverse=True)
    mark, across, edges, trees = np.zeros(len(values), bool), len(set(sides)) > 1, [], len(up)
    ends = np.searchsorted(sizes, sizes / least + 1e-6, "right")
    for at, x in enumerate(order):
        lo, hi = at + 1, int(ends[at])
        if trees == 1:
            break
        if hi <= lo:
            continue
        own = codes[firsts[at] : firsts[at] + sizes[at]]
        mark[own] = True
        stop = firsts[hi - 1] + sizes[hi - 1]
        both = np.add.reduceat(mark[codes[firsts[lo] : stop]].astype(np.int64), firsts[lo:hi] - firsts[lo])
        mark[own] = False
        for y in (np.flatnonzero(both / (sizes[lo:hi] + sizes[at] - both) >= least) + lo).tolist():
            y = order[y]
            a, b = find(roots[x]), find(roots[y])
            if a != b and not (across and sides[x] == sides[y]):
                up[a] = b
                trees -= 1
                edges.append((x, y))
    return edges


def _open_links(hot: DataFrame, near: DataFrame, sets: DataFrame, least: float, part: int, store: Callable[[DataFrame, str], DataFrame], paths: list[str]) -> DataFrame | None:
    """parent, child: with the edges `near`, what connects all texts of a similarity of `least` or more among those
    that share a key of `hot` (key, h, fp). Exact, whatever the size of a key; None where `near` is all.

    Keys whose texts are connected need nothing. Of the others, two similar texts share one of their
    rarest shingles, as many as they may differ in and one more. Texts that share such a shingle are compared:
    over `part` of them in cells of about `part`, each cell with each, unless both lie in one component."""
    named, old = components(near)
    paths += old
    roots = named.select(F.col("child").alias("fp"), F.col("parent").alias("root"))
    placed = store(hot.select("key", "h", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    mixed = lambda t, *by: t.groupBy(*by).agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    texts = store(placed.join(mixed(placed, "key").select("key"), "key", "left_semi").select("h", "fp", "root").distinct(), "open")
    if not texts.limit(1).count():
        return None

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, words in zip(batch.column(0), batch.column(1)):
                own = np.frombuffer(words.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), h.as_py())), pa.array(own)], ["h", "g"])

    grams = store(small_batches(texts.join(sets, "h").select("h", "words")).mapInArrow(explode, "h long, g long"), "grams")
    ranked = join_by_count(grams, grams.groupBy("g").count(), "g", "count", "inner")
    own = ranked.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("count", "g"))).alias("all"))
    take = F.size("all") - F.ceil(F.size("all") * least - 1e-6).cast("int") + 1
    rare = own.select("h", F.explode(F.slice("all", F.lit(1), take)).alias("x")).select("h", F.col("x.g").alias("g"))
    rare = store(rare.join(texts, "h"), "rare")

    buckets = store(mixed(rare, "g").select("g", "n"), "rare-buckets")
    met = rare.join(buckets, "g")
    few = met.filter(F.col("n") <= part).groupBy("g").agg(F.sort_array(F.collect_list("h")).alias("ids"))
    few = met.join(few.groupBy("ids").agg(F.min("g").alias("g")).select("g"), "g", "left_semi").withColumn("cell", F.lit(0).cast("long"))
    many = met.filter(F.col("n") > part)
    of_root = many.groupBy("g", "root").agg(F.count("*").alias("m"))
    cut = lambda by, n: F.pmod(F.xxhash64(by), F.floor((F.col(n) - 1) / part) + 1)
    many = many.join(of_root, ["g", "root"]).withColumn("cell", cut("root", "n") * F.lit(1 << 32) + cut("h", "m")).drop("m")
    cells = store(few.unionByName(many).select("g", "cell", "h", "fp", "root"), "cells")
    kinds = cells.groupBy("g", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    a, b = (kinds.select("g", *[F.col(c).alias(f"{x}_{c}") for c in ("cell", "lo", "hi")]) for x in "ab")
    blocks = store(a.join(b, "g").filter((F.col("a_cell") <= F.col("b_cell")) & (F.least("a_lo", "b_lo") < F.greatest("a_hi", "b_hi"))).select("g", "a_cell", "b_cell"), "blocks")
    sides = blocks.withColumn("cell", F.explode(F.array_distinct(F.array("a_cell", "b_cell"))))
    rows = cells.join(sides, ["g", "cell"]).join(sets, "h").select("g", "a_cell", "b_cell", (F.col("cell") == F.col("a_cell")).alias("side"), "fp", "root", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group):
            fps, roots, sides, words = zip(*group)
            linked = sorted({(min(fps[x], fps[y]), max(fps[x], fps[y])) for x, y in crossing_links(roots, words, sides, least)})
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in linked], pa.int64()) for i in (0, 1)], ["parent", "child"])

        now, group = None, []
        for batch in batches:
            for g, a, b, side, fp, root, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, a, b) != now:
                    if group:
                        yield close(group)
                    now, group = (g, a, b), []
                group.append((fp, root, side, np.frombuffer(words, np.uint64)))
        if group:
            yield close(group)

    by = ["g", "a_cell", "b_cell"]
    return small_batches(rows.repartition(*by).sortWithinPartitions(*by)).mapInArrow(run, "parent long, child long").distinct()


def similar_links(docs: DataFrame, rows: DataFrame, text_col: str = "text", least: float = SIMILAR, part: int = PART) -> tuple[DataFrame, list[str]]:
    """(edges of fingerprints parent < child, scratch paths): they connect whatever links of texts that share a
    key and have a similarity of `least` or more connect. `rows` is the stored table of fingerprints with text_hash and bands.

    Copies of a text count once. Keys of over `part` texts are dealt to several groups, so no task compares
    a large group as one; the smallest ids of the groups' trees meet then, dealt likewise, which connects
    dense groups, and `_open_links` finds the links that are left.
    """
    paths = []

    def store(df: DataFrame, tag: str) -> DataFrame:
        table, path = materialise(df, tag)
        paths.append(path)
        return table

    nodes = rows.filter(F.size("bands") > 0).groupBy(F.col("text_hash").alias("h")).agg(F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    keys = store(nodes.select("h", "first", "fp", F.explode("bands").alias("key")), "bands")
    shared = keys.groupBy("key").count().filter("count > 1")
    dealt = F.pmod(F.xxhash64("h"), F.floor((F.col("count") - 1) / part) + 1)
    members = store(keys.join(shared, "key").select("key", "h", "first", "fp", "count", dealt.alias("part")), "members")
    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).join(members.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, SIMILAR_WORDS)).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["h", "words"])

    sets = store(map_slices(texts.select("h", "text"), "text", words, "h long, words binary"), "sets")
    # Near copies share most of their keys: of keys with the same texts one is compared.
    few = members.filter(F.col("count") <= part).groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("ids"))
    single = few.groupBy("ids").agg(F.min("key").alias("key")).select("key")
    once = store(members.join(single, "key", "left_semi").union(members.filter(F.col("count") > part)), "once")
    found = store(_similar(once, sets, least), "similar")
    hot = members.filter(F.col("count") > part).drop("part")
    trees = found.filter("key IS NOT NULL").select("key", "h")
    counts = trees.groupBy("key").count()
    again = hot.drop("count").join(trees, ["key", "h"]).join(counts, "key").withColumn("part", dealt)
    edges = store(found.union(_similar(again, sets, least)).filter("parent IS NOT NULL").select("parent", "child").distinct(), "similar-edges")
    if hot.limit(1).count():
        rest = _open_links(hot, edges, sets, least, part, store, paths)
        if rest is not None:
            edges = store(edges.union(rest).distinct(), "all-similar-edges")
    return edges, paths


def _least(edges: DataFrame, by: str, other: str, most: int) -> DataFrame:
    """edges with `least`, the smallest neighbour by `by`. One node may hold most edges: it is
    joined back by its count, which is at most `most`."""
    least = edges.groupBy(by).agg(F.min(other).alias("least"), F.count("*").alias("degree"))
    return join_by_count(edges, least, by, "degree", "inner", most=most).drop("degree")


def components(edges: DataFrame, rounds: int = 40) -> tuple[DataFrame, list[str]]:
    """(child, parent) with parent the smallest node of the child's component, for edges
    parent < child. Alternates large-star and small-star, each step halving the depth, and
    stores the edges after each round; stops when a round changes nothing."""
    now, path = materialise(edges.select("parent", "child"), "edges")
    paths, mark = [path], None
    for _ in range(rounds):
        got = now.agg(F.count("*"), F.sum(F.xxhash64("parent", "child").cast("decimal(38,0)"))).first()
        if got == mark or not got[0]:
            return now, paths
        mark = got
        both = now.union(now.select(F.col("child").alias("parent"), F.col("parent").alias("child"))).toDF("u", "v")
        large = _least(both, "u", "v", 2 * got[0]).filter("v > u").select(F.least("least", "u").alias("parent"), F.col("v").alias("child")).distinct()
        least = _least(large, "child", "parent", 2 * got[0])
        small = least.select(F.col("least").alias("parent"), "child").union(least.select(F.col("least").alias("parent"), F.col("parent").alias("child"))).filter("parent < child").distinct()
        now, path = materialise(small, "edges")
        paths.append(path)
    raise RuntimeError("components did not settle")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, similar: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, components): doc_id, fp, text_hash for each row of docs, and fp, copies (rows that
    have it), root, component_id for each distinct fingerprint.

    A null or wordless text has fingerprint zero and links like any other; null ids are
    never a component's name unless all of its ids are null. Repeated rows are rows. With
    `similar`, the edges of `similar_links` link as well.
    """
    spark = docs.sparkSession
    rows, _ = materialise(fingerprints(docs, id_col, text_col, keep_hash=True, bands=similar), "fingerprints")
    distinct, _ = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "distinct")
    edges, more = links(distinct.select("fp"), hot), []
    if similar:
        wider, more = similar_links(docs, rows, text_col)
        edges = edges.union(wider).distinct()
    found, old = components(edges)
    named = distinct.join(found.select(F.col("child").alias("fp"), F.col("parent").alias("root")), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    # Roots hold an arbitrary number of members, fingerprints one of copies: both are joined by count.
    roots = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    result, _ = materialise(join_by_count(named.select("fp", "root", "copies"), roots, "root", "members", "inner", most=distinct.count()), "components")
    remove(spark, *old, *more)
    return rows, result


def _with_names(rows: DataFrame, named: DataFrame) -> DataFrame:
    return join_by_count(rows, named, "fp", "copies", "inner", most=named.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    rows, named = groups(docs, id_col, text_col, hot)
    return _with_names(rows, named).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, similar: bool = False) -> DataFrame:
    """docs with one row of each component: that of the smallest id (among rows that repeat
    an id, that of the smallest text hash; of rows equal in both, any one). All columns stay
    as they are."""
    rows, named = groups(docs, id_col, text_col, hot, similar)
    keep = _with_names(rows, named).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    names = fresh(docs.columns, "__id", "__null", "__hash")
    keys = lambda i, h: [x.alias(n) for x, n in zip((F.coalesce(i, F.lit(0)), i.isNull(), h), names)]
    keep = keep.select(*keys(F.col("kept.doc_id"), F.col("kept.text_hash")))
    own = docs.select("*", *keys(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))))
    return own.join(keep, names, "left_semi").dropDuplicates(names).select(*docs.columns)
