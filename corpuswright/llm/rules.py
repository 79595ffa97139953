"""Quality rules as a bitmask ledger.

Every document is measured once. Each rule then becomes one bit of `failed`, and the ledger
(measurements and bits) is the only thing that later steps need: a policy is a version with a
mask of the rules it enforces, so changing a policy or asking what a rule costs never reads
a text again. An ablation is a bitwise aggregation over the distinct failure masks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_text, map_slices

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


Measured = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` of the measurements is true."""

    name: str
    fails: Callable[[Measured], Column]


#: In bit order. Append only: a stored ledger's bits keep their meaning, so a changed threshold is
#: a new rule. All sums are whole numbers.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbol_share", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("upper_case", lambda m: 2 * m("n_upper_words") > m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 40 * m("n_words")),
    Rule("stutter", lambda m: 5 * m("n_stutter") > m("n_words")),
    Rule("half_duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
)
BASE_RULES = ("few_words", "repeated_windows")

#: Versions of the policy: the rules each enforces. A version never changes.
POLICIES = {
    "base": BASE_RULES,
    "v1": ("few_words", "repeated_windows", "symbol_share", "duplicate_lines", "upper_case", "long_words"),
    "v2": ("few_words", "repeated_windows", "symbol_share", "half_duplicate_lines", "upper_case", "long_words", "stutter"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_stutter")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found at least twice in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    if (rows[left] != rows[right]).any():  # two windows share a hash: compare windows themselves
        seen: dict[bytes, list[int]] = {}
        for i in range(n):
            seen.setdefault(rows[i].tobytes(), []).append(i)
        twice = np.array(sorted(i for at in seen.values() if len(at) > 1 for i in at), np.int64)
    else:
        twice = np.union1d(left, right)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; a null text has none of anything."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
        repeated_words(words), sum(len(w) > 1 for w in words if w.isupper()), sum(map(eq, words, words[1:])),
    )


def _book(texts: pa.Array) -> list[pa.Array]:
    rows = np.array([measure(t) for t in texts.to_pylist()], np.int64)
    return [pa.array(rows[:, k].copy()) for k in range(len(MEASURES))]


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of MEASURES for each row of docs, from whole texts."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), *_book(part.column(1))], ["doc_id", *MEASURES])

    return map_slices(id_text(docs, id_col, text_col), "text", run, SCHEMA)


def failure_bits(measured: Measured, rules: tuple[Rule, ...] = RULES) -> Column:
    """A long with bit k set where rule k fails."""
    bits = [F.when(r.fails(measured), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and `failed`, a long with bit k set where rule k fails. An empty table
    gives an empty ledger."""
    return measurements(docs, id_col, text_col).withColumn("failed", failure_bits(F.col, rules))


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def passes(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES, failed: Column | None = None) -> Column:
    """Whether a ledger row passes a policy (a version's name, or rule names)."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(names, rules)).cast("long")) == 0


def ablation(book: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail it alone (what leaving it out
    would bring back), and pass the policy. The ledger is grouped by failure mask first, so
    at most 2**len(rules) rows take part in the rest."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = F.lit(mask(names, rules)).cast("long")
    masks = book.groupBy(F.col("failed").bitwiseAND(whole).alias("bits")).count()
    parts = [F.struct(F.lit(n).alias("rule"), F.lit(mask((n,), rules)).cast("long").alias("bit")) for n in names]
    each = masks.select("bits", "count", F.explode(F.array(*parts)).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(hit).alias("n_failed"), total(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"), total(F.col("bits") == 0).alias("n_passed")
    )


def keep(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """docs without the rows whose failure bits meet the policy's mask. The measurements travel
    with their row, so repeated and null ids are no special case and nothing is shuffled."""
    names, at = docs.columns, docs.columns.index(text_col)
    (extra,) = fresh(names, "__book")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        book = pa.StructArray.from_arrays(_book(part.column(at)), list(MEASURES))
        return pa.RecordBatch.from_arrays([*part.columns, book], [*names, extra])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    judged = map_slices(docs, text_col, run, f"{schema}, {extra} struct<{', '.join(f'{m}: bigint' for m in MEASURES)}>")
    failed = failure_bits(lambda m: F.col(extra)[m])
    return judged.filter(passes(policy, failed=failed)).select(*names)
