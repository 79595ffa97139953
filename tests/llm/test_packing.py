import random
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuswright.llm import packing, queries

PATH = queries.vocabulary_path()
FULL = Tokenizer.from_file(PATH)
CACHE = packing.TokenCache(PATH)


def ids_of(text):
    return FULL.encode(text or "", add_special_tokens=False).ids + [1]


def cached(texts):
    ids, ends = CACHE.encode(pa.array(texts, pa.string()))
    starts = [0, *ends[:-1].tolist()]
    return [ids[a:b].tolist() for a, b in zip(starts, ends.tolist())]


ODD_TEXT = ["", " ", "It's THE dog's!!", "İstanbul ΣΑΣ ß", "á H̱ e", "<|endoftext|> x", "<|ENDOFTEXT|>y", "x\x1cy\x85z\xa0w", "½²3 ª µ", "\U0001f600\U0001f600 日本", "we'll they'd can't 'S", "a" * 3000]


def test_cache_equals_tokenizer(rows):
    texts = ODD_TEXT + [r.text for r in rows]
    assert cached(texts) == [ids_of(t) for t in texts]
    for t in ODD_TEXT:
        assert cached([t]) == [ids_of(t)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_cache_on_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert cached(texts) == [ids_of(t) for t in texts]


def test_cache_does_not_depend_on_what_it_met_before():
    """One cache meets each letter alone, then with each mark behind it; strings of letters that
    change when composed or lowered follow in random order."""
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not 0xAC00 < c < 0xD7A3 and not 0x3400 <= c < 0x9FFF and not 0x20000 <= c < 0x323B0]
    changed = [c for c in letters if len(unicodedata.normalize("NFC", c).lower()) > 1 or not unicodedata.normalize("NFC", c).lower().isalpha()]
    assert "\u0130" in changed and "\u0958" in changed
    cache, rng = packing.TokenCache(PATH, limit=500_000), random.Random(5)
    stems = letters + ["".join(rng.choice(changed + letters[:300]) for _ in range(rng.randint(1, 4))) for _ in range(20_000)]
    strings = stems + [s + m for s in stems for m in (".,;:!?" if s in changed or len(s) > 1 else rng.choice(".,;:!?"))]
    assert len(strings) > 100_000
    wrong = 0
    for lo in range(0, len(strings), 10_000):
        part = strings[lo : lo + 10_000]
        ids, sizes = cache.encode_words(part)
        ends = np.cumsum(sizes)
        want = [e.ids for e in FULL.encode_batch(part, add_special_tokens=False)]
        wrong += sum(ids[e - n : e].tolist() != w for e, n, w in zip(ends.tolist(), sizes.tolist(), want))
    assert wrong == 0


def test_cache_forgets_beyond_its_limit():
    small = packing.TokenCache(PATH, limit=6)
    for k in range(30):
        text = f"common word{'abcdefghij'[k % 10] * (k + 1)} other{'xyz'[k % 3] * k} it's, {'third' * (k % 5)}"
        ids, _ = small.encode(pa.array([text]))
        assert ids.tolist() == ids_of(text)
    assert len(small.known) <= 20 and "common" in small.known


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_best_subset(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9)))
    room = rng.randint(0, 60)
    use = packing.fullest(dict(counts), sorted(counts, reverse=True), room)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    assert all(use[x] <= counts[x] for x in use)
    assert sum(x * k for x, k in use.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    histogram = Counter(min(100, int(rng.expovariate(0.05)) + 1) for _ in range(2000))
    plan, used = packing.plan_bins(histogram, 100), Counter()
    for bins, use in plan:
        assert sum(x * k for x, k in use.items()) <= 100
        used.update({x: k * bins for x, k in use.items()})
    assert used == histogram
    assert sum(b for b, _ in plan) <= -(-sum(x * k for x, k in histogram.items()) // 100) + 1


def check(pieces, texts):
    """Pieces rebuild the documents, sequences are gapless and within capacity."""
    want = Counter()
    for doc_id, text in texts:
        ids = ids_of(text)
        for k in range(0, len(ids), 4096):
            cut = ids[k : k + 4096]
            want[(doc_id, k // 4096, k, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    at = Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert not at or max(at.values()) <= 4096
    return at


def test_query(spark, sf, rows):
    got = queries.op3_packing(spark, sf).collect()
    at = check(got, [(r.doc_id, r.text) for r in rows])
    assert len(at) <= -(-sum(at.values()) // 4096) + 1


def test_odd_rows(odd, empty):
    check(packing.pack_documents(odd, PATH).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack_documents(empty, PATH).collect() == []


def test_ranks_over_many_buckets(spark):
    table = spark.range(1000).selectExpr("id", "1L + id % 3 length")
    got = packing.pack(table, capacity=8, per_bucket=10).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 1000
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 8)


def test_one_row_repeated_fills_many_buckets(spark):
    """Copies of a row are dealt by their row number, and clashing names are left alone."""
    table = spark.range(3000).selectExpr("1L doc_id", "5L length", "7 __row", "8 __bucket", "9 __Rank")
    got = packing.pack(table, capacity=16, per_bucket=100)
    assert got.columns == [*table.columns, "sequence_id", "offset"]
    got = got.collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000 and len({r.sequence_id for r in got}) == 1000
    assert {(r["__row"], r["__bucket"], r["__Rank"]) for r in got} == {(7, 8, 9)}


@pytest.mark.parametrize("seed", range(3))
def test_every_piece_finds_its_run(spark, seed):
    """Many runs to a length: places are gapless and as few sequences as the plan has."""
    rng = random.Random(seed)
    lengths = [min(60, int(rng.expovariate(0.08)) + 1) for _ in range(4000)]
    got = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long"), capacity=64, per_bucket=50).collect()
    assert Counter(r.length for r in got) == Counter(lengths)
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 64 and len(at) == sum(b for b, _ in packing.plan_bins(Counter(lengths), 64))
