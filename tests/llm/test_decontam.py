import hashlib
import pickle
import re
import subprocess
import sys
import tempfile

import numpy as np
import pytest

from corpuswright.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    grams = {}
    for r in items:
        w = words(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(r.item_id)
    sizes = {len(g) for g in grams}
    for r in docs:
        w, hit, found = words(r.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        ids = sorted(str(x) for x in found if x is not None)
        yield r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_query(spark, sf, rows, benchmark):
    got = rows_of(queries.op9_decontamination(spark, sf))
    assert got == sorted(slow(rows, benchmark.collect()), key=str)
    assert any(r[5] for r in got)


def test_large_benchmark_is_joined(documents, benchmark):
    """Beyond the broadcast's bound the windows are joined, with equal results."""
    one = decontam.scan(documents, benchmark)
    two = decontam.scan(documents, benchmark, broadcast_bytes=1)
    assert rows_of(one) == rows_of(two)


ITEMS = [(1, "The quick brown"), (2, "FOX jumps, over!"), (3, ""), (4, None), (None, "naïve"), (5, "the quick brown fox jumps over the lazy dog again and"), (1, "straße 日本語")]


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_odd_rows(spark, odd, empty, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows_of(decontam.report(odd, items, broadcast_bytes=limit))
    assert got == sorted(slow(odd.collect(), items.collect()), key=str)
    assert decontam.report(empty, items, broadcast_bytes=limit).collect() == []
    none = decontam.report(odd, items.limit(0)).collect()
    assert len(none) == odd.count() and not any(r.contaminated for r in none)


def test_clean(odd, spark, documents, benchmark):
    kept = decontam.clean(documents, benchmark)
    bad = {r.doc_id for r in decontam.report(documents, benchmark).filter("contaminated").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect()} - bad
    cut = decontam.clean(documents, benchmark, action="cut")
    assert cut.count() == documents.count()
    # What is cut may bring words together; a second pass finds nothing of ten words or more.
    assert decontam.report(cut, benchmark).filter("contaminated").count() <= len(bad) // 10
    assert decontam.clean(odd, benchmark).columns == odd.columns
    by_join = decontam.clean(documents, benchmark, broadcast_bytes=1)
    assert {r.doc_id for r in by_join.collect()} == {r.doc_id for r in kept.collect()} and by_join.columns == documents.columns
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    assert texts(decontam.clean(documents, benchmark, action="cut", broadcast_bytes=1)) == texts(cut)
    with pytest.raises(ValueError):
        decontam.clean(documents, benchmark, action="keep")


def test_cut():
    text = "One, two THREE (four) five."
    assert decontam.cut(text, np.array([0, 1, 1, 0, 0], bool)) == "One,  (four) five."


def test_clean_of_odd_rows_by_join(spark, odd, empty):
    """Row numbers, not ids or texts, lead hits back: repeated rows and nulls keep their own fate."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for action in ("drop", "cut"):
        one, two = (decontam.clean(odd, items, action=action, broadcast_bytes=n) for n in (1 << 20, 1))
        assert one.columns == two.columns == odd.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        assert decontam.clean(empty, items, action=action, broadcast_bytes=1).collect() == []
        assert decontam.clean(odd, items.limit(0), action=action, broadcast_bytes=0).count() == odd.count()


def test_windows_of_one_hash(monkeypatch):
    """Texts that share a hash are told apart byte by byte."""
    whole = decontam.Words.hashes
    monkeypatch.setattr(decontam.Words, "hashes", lambda self, *a: ((n, h & np.uint64(3)) for n, h in whole(self, *a)))
    items = [(k, f"w{k} " * 3 + f"x{k % 4} y z") for k in range(40)] + [(99, "w1 w1 w1 x1 y z")]
    got = decontam.WindowSet(items, 4)
    assert got.odd
    for text in [items[3][1], "a " * 20 + items[7][1] + " b", items[1][1], "nothing of it here at all", ""]:
        want = {i for i, t in items if set(decontam.windows_of(decontam.words_of(t), 4)) & set(decontam.windows_of(decontam.words_of(text), 4))}
        hit, found = got.scan(text)
        assert found == want and hit.any() == bool(want)


def test_long_text_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    item = " ".join(f"w{k}" for k in rng.integers(0, 50, 300))
    text = " ".join(f"w{k}" for k in rng.integers(0, 50, 5000)) + " " + item + " tail"
    whole = decontam.WindowSet([(1, item), (2, "w1 w2 w3")]).scan(text)
    monkeypatch.setattr(decontam, "BLOCK", 7)
    parts = decontam.WindowSet([(1, item), (2, "w1 w2 w3")]).scan(text)
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1] and whole[0].sum() >= 300


def test_memory_at_the_bound():
    """A benchmark as large as may be broadcast takes no more than the bound in the arrays, and under
    300 MB beyond Python itself while it is read."""
    code = """
import pickle, resource, sys
import numpy as np
from corpuswright.llm import decontam
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = pickle.load(open(sys.argv[1], 'rb'))
hit, found = got.scan('w1 ' * 100000)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    rng = np.random.default_rng(0)
    items = [(k, " ".join(f"word{x}" for x in rng.integers(0, 100_000, 2000))) for k in range(900)]
    size, words = sum(len(t) for _, t in items), 900 * 2000
    assert 0.8 * decontam.BROADCAST_BYTES < size + 56 * words + 64 * 900 < decontam.BROADCAST_BYTES
    with tempfile.NamedTemporaryFile() as f:
        pickle.dump(decontam.WindowSet(items), f)
        f.flush()
        assert f.tell() < decontam.BROADCAST_BYTES
        assert int(subprocess.run([sys.executable, "-c", code, f.name], capture_output=True, text=True, check=True).stdout) < 300
