import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpuswright.llm import queries, rules

SPACE = " \t\n\x0b\x0c\r"


def slow(text):
    text = text or ""
    words = [w for w in re.split("[" + SPACE + "]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    dup = sum(lines[i] in lines[:i] for i in range(len(lines)))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_query(spark, sf, rows):
    got = {r.doc_id: r for r in queries.op8_rules(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want, row = slow(r.text), got[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.kept and row.base_failed)


@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeated_words(words):
    assert rules.repeated_words(words) == slow(" ".join(words))[4]


def test_odd_rows(odd, empty):
    book = rules.ledger(odd).collect()
    want = Counter((r.doc_id, *slow(r.text)) for r in odd.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book) == want
    assert rules.ledger(empty).collect() == []
    kept = rules.keep(odd)
    assert kept.columns == odd.columns
    passed = Counter(r.doc_id for r in rules.ledger(odd).filter(rules.passes("v2")).collect())
    assert Counter(r.doc_id for r in kept.collect()) == passed
    assert rules.keep(empty).collect() == []


@pytest.mark.parametrize("policy", list(rules.POLICIES))
def test_ablation(documents, policy):
    book = rules.ledger(documents).cache()
    masks = [r.failed for r in book.collect()]
    names = rules.POLICIES[policy]
    whole = rules.mask(names)
    for r in rules.ablation(book, policy).collect():
        bit = rules.mask((r.rule,))
        assert r.n_failed == sum(bool(m & bit) for m in masks)
        assert r.n_failed_alone == sum((m & whole) == bit for m in masks)
        assert r.n_passed == sum(not m & whole for m in masks)


def test_junk_goes_and_clean_stays(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rules.ledger(docs).withColumn("kept", rules.passes("v2")).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
    long_enough = rules.ledger(docs).filter("n_words >= 20").withColumn("kept", rules.passes("v2")).join(labels, "doc_id").filter("quality = 1")
    assert long_enough.filter("kept").count() >= 0.98 * long_enough.count()


def test_bits_and_versions_are_permanent(spark):
    """What a stored ledger's bits mean, and which rules each version enforces."""
    assert [r.name for r in rules.RULES[:8]] == ["few_words", "repeated_windows", "symbol_share", "duplicate_lines", "upper_case", "long_words", "stutter", "half_duplicate_lines"]
    assert {v: rules.mask(rules.POLICIES[v]) for v in ("base", "v1", "v2")} == {"base": 0b11, "v1": 0b111111, "v2": 0b11110111}
    text = "\n".join(["a b c d e f g h i j k l m n o p q r s t"] + ["x y"] * 2 + ["z w"] * 2 + ["u v"])
    (row,) = rules.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_lines, row.n_dup_lines, row.failed) == (6, 2, 0b1000)  # a third: fails v1, passes v2
