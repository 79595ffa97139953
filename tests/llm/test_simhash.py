import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuswright.llm import queries, simhash


def slow_fingerprint(text):
    words, now = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] * bool(now)
            now = ""
        else:
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    """[(doc_id, fingerprint, component_id)] by comparing all fingerprints."""
    fps = [slow_fingerprint(r.text) for r in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            ids[root(i)] = min(r.doc_id, ids.get(root(i), r.doc_id))
    return sorted([(r.doc_id, f"{fps[i]:016x}", ids.get(root(i))) for i, r in enumerate(rows)], key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query(spark, sf, rows):
    assert rows_of(queries.op10_simhash(spark, sf)) == slow_groups(rows)


def test_odd_rows(odd, empty):
    assert rows_of(simhash.near_duplicates(odd)) == slow_groups(odd.collect())
    assert rows_of(simhash.near_duplicates(empty)) == []
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    want = {(d, f) for d, f, c in slow_groups(odd.collect()) if d == c}
    assert {(r.doc_id, f"{slow_fingerprint(r.text):016x}") for r in kept.collect()} == want and kept.count() == len(want)
    assert simhash.deduplicate(empty).collect() == []


def dense(seed, n, bits):
    """Fingerprints around a few centres that differ in random bits."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, bits)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64).view(np.int64)


def parts(nodes, edges):
    up = {int(x): int(x) for x in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        up[root(int(a))] = root(int(b))
    groups = {}
    for x in up:
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def slow_edges(fps):
    u = fps.view(np.uint64)
    return [(fps[i], fps[j]) for i in range(len(fps)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= 3]


@pytest.mark.parametrize("bits", [2, 5])
@pytest.mark.parametrize("hot", [simhash.HOT, 4])
def test_links_and_components(spark, bits, hot):
    """Both the plain buckets and, with a small `hot`, the inner index."""
    fps = dense(bits, 300, bits)
    table = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    edges = simhash.links(table, hot=hot).collect()
    want = parts(fps, slow_edges(fps))
    assert parts(fps, [(r.parent, r.child) for r in edges]) == want
    found, _ = simhash.components(spark.createDataFrame([(r.parent, r.child) for r in edges], "parent long, child long"))
    top = {r.child: r.parent for r in found.collect()}
    assert {frozenset(g) for g in want} == {frozenset(x for x in map(int, fps) if top.get(x, x) == k) for k in {top.get(x, x) for x in map(int, fps)}}
    assert all(top.get(x, x) == min(g) for g in want for x in g)


def test_probing_equals_comparing():
    rng = random.Random(3)
    fps = np.unique(np.array([rng.getrandbits(18) for _ in range(500)], np.uint64))
    rows = fps.view(np.int64)
    one = simhash.spanning_edges(fps.copy(), probe_over=0)
    two = simhash.spanning_edges(fps.copy())
    assert parts(rows, rows[one]) == parts(rows, rows[two]) == parts(rows, slow_edges(rows))


def test_long_chain(spark):
    edges = spark.range(400).selectExpr("id parent", "id + 1 child")
    found, _ = simhash.components(edges)
    assert {(r.parent, r.child) for r in found.collect()} == {(0, k) for k in range(1, 401)}


def five_word_sets(rows):
    tokens = [[w.decode() for w in (r.text or "").encode().lower().split()] for r in rows]
    return [{" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in tokens]


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) > 0


@pytest.mark.parametrize("part", [simhash.PART, 4])
def test_similar_texts_keep_one(spark, part, monkeypatch):
    """Copies with a changed word or two, in a chain and in a dense group: of no two of them
    both stay, though many fingerprints differ in more than three bits."""
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (*simhash.similar_links.__defaults__[:-1], part))
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(30)]
    for base in range(10):
        for n in (1, 1, 2):
            words = texts[base].split()
            for at in rng.sample(range(120), n):
                words[at] = "changed"
            texts.append(" ".join(words))
    for _ in range(30):  # a chain: each differs from the one before
        words = texts[-1].split()
        words[rng.randrange(120)] = f"x{rng.randrange(99)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, kept = docs.collect(), {r.doc_id for r in simhash.deduplicate(docs, similar=True).collect()}
    sets = five_word_sets(rows)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    assert not [p for p in near if kept.issuperset(p)] and set(range(30)) <= kept
    far = [(i, j) for i, j in near if (slow_fingerprint(rows[i].text) ^ slow_fingerprint(rows[j].text)).bit_count() > 3]
    before = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert [p for p in far if before.issuperset(p)]


@pytest.mark.parametrize("part", [simhash.PART, 9, 3])
def test_no_link_of_a_large_key_is_lost(spark, part):
    """All texts share one key: chains whose links join no smallest ids, a dense group and texts that are
    like no other. Components are those of all pairs."""
    rng = random.Random(8)
    long = [[f"c{n}w{i}" for i in range(400)] for n in range(3)]
    texts = [" ".join(words[at : at + 120]) for words in long for at in range(0, 240, 10)]
    texts += [" ".join(f"u{rng.randrange(9000)}" for _ in range(100)) for _ in range(20)]
    dense = [f"d{i}" for i in range(120)]
    for _ in range(20):
        at = rng.randrange(120)
        texts.append(" ".join([*dense[:at], f"x{rng.randrange(99)}", *dense[at + 1 :]]))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").localCheckpoint()
    rows = simhash.fingerprints(docs, keep_hash=True).withColumn("bands", F.array(F.lit(7).cast("long"))).localCheckpoint()
    edges, _ = simhash.similar_links(docs, rows, part=part)
    fps = {r.doc_id: r.fp for r in rows.collect()}
    assert len(set(fps.values())) == len(texts)
    sets = five_word_sets(docs.collect())
    near = [(fps[i], fps[j]) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    found = [tuple(e) for e in edges.collect()]
    assert {tuple(sorted(e)) for e in near} >= set(found)

    def names(pairs):
        up = {f: f for f in fps.values()}
        for _ in up:
            before = dict(up)
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
            if up == before:
                return up

    assert names(found) == names(near)


def test_pipeline_links_similar_texts(spark, odd, empty):
    import corpus_pipeline

    words = [f"v{i}" for i in range(120)]
    words_b = [*words[:60], "changed", *words[61:]]
    docs = spark.createDataFrame([(2, " ".join(words_b)), (1, " ".join(words)), (3, "other words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert corpus_pipeline.near_dedup(spark, odd, "").columns == odd.columns
    assert simhash.similar_forest([np.arange(n, dtype=np.uint64) for n in (10, 9, 7, 3)]) == ([(0, 1)], [0, 2, 3])
