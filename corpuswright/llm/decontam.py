"""Benchmark decontamination by a broadcast set of normalised n-grams.

Benchmark items become windows of `window` words (a shorter item is one window). The set is a
few flat arrays, made once on the driver and sent to every executor if its measured size is within
`broadcast_bytes`; a larger benchmark is joined to the documents' windows by a shuffle on the
window's text. Either way a hit is verified byte by byte, never by its hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_text, materialise, slices, small_batches

WINDOW = 10
BROADCAST_BYTES = 128 << 20

# Bytes of words: 0-9, a-z and all of non-ASCII; A-Z become a-z, all else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = 50_000  # words of a document that are hashed at once
_FACTOR, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)  # odd: has an inverse modulo 2**64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    n = min(window, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


class Words:
    """A text's words with one blank between them, and where each lies."""

    def __init__(self, text: str | None):
        self.raw = b" ".join(words_of(text))
        self.flat = np.frombuffer(self.raw, np.uint8)
        gaps = np.nonzero(self.flat == 32)[0]
        self.n = len(gaps) + 1 if len(self.flat) else 0
        self.starts = np.concatenate(([0], gaps + 1))[: self.n]
        self.ends = np.concatenate((gaps, [len(self.flat)]))[: self.n]

    def hashes(self, sizes: list[int], lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each size, the hashes of the runs of so many words that begin at words lo to hi.

        A run is the sum of its bytes times powers of a factor, the difference of two sums from
        the first word's start; dividing by its first power makes it independent of the
        place. Work and memory follow the bytes of these words alone."""
        base, last = int(self.starts[lo]), int(self.ends[min(self.n, hi + max(sizes) - 1) - 1])
        up, down = _powers(last - base + 1)
        sums = np.zeros(last - base + 1, np.uint64)
        np.cumsum(self.flat[base:last].astype(np.uint64) * up[: last - base], out=sums[1:])
        for n in sizes:
            first = self.starts[lo : min(hi, self.n - n + 1)] - base
            end = self.ends[lo + n - 1 : lo + n - 1 + len(first)] - base
            mixed = (sums[end] - sums[first]) * down[first]
            mixed = (mixed ^ mixed >> np.uint64(32)) * _MIX
            yield n, mixed ^ mixed >> np.uint64(29)


_KNOWN_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the factor and of its inverse; those that most blocks need are kept."""
    if not _KNOWN_POWERS or len(_KNOWN_POWERS[0]) < n:
        made = []
        for by in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 18), by, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        if n > 1 << 21:
            return made[0], made[1]
        _KNOWN_POWERS[:] = made
    return _KNOWN_POWERS[0], _KNOWN_POWERS[1]


class WindowSet:
    """Windows of all items in flat arrays: finds where they occur in a document.

    Of window k (in order of length and hash) `hashes[k]` is the hash, `at[k]` and `end[k]` its place in `blob`,
    and `items[first[k] : first[k + 1]]` its items' numbers. Windows of n words are those of
    `lengths[n]`, a range. Windows of equal text are one.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        blob, base, parts = [], 0, []
        self.ids = [item for item, _ in items]
        for number, (_, text) in enumerate(items):
            own = Words(text)
            if not own.n:
                continue
            n = min(window, own.n)
            k = own.n - n + 1
            made = [h for lo in range(0, k, BLOCK) for _, h in own.hashes([n], lo, min(k, lo + BLOCK))]
            parts.append((np.full(k, n, np.int8), np.concatenate(made), base + own.starts[:k], base + own.ends[n - 1 :], np.full(k, number, np.int32)))
            blob.append(own.raw)
            base += len(own.raw)
        self.blob = b"".join(blob)
        size, hashes, at, end, item = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.int8, np.uint64, np.int64, np.int64, np.int32))
        order = np.lexsort((item, hashes, size))
        size, hashes, at, end, item = (x[order] for x in (size, hashes, at, end, item))
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (size[1:] != size[:-1])
        # Windows of one hash are one window, but for texts that differ: these few are set apart.
        again = np.nonzero(~new)[0]
        leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        odd = [k for k in again.tolist() if self._text(at, end, k) != self._text(at, end, leader[k])]
        self.odd: dict[int, dict[bytes, set]] = {}
        for k in odd:
            self.odd.setdefault(int(hashes[k]), {}).setdefault(self._text(at, end, k), set()).add(int(item[k]))
        keep = np.ones(len(new), bool)
        keep[odd] = False
        size, hashes, at, end, item, new = (x[keep] for x in (size, hashes, at, end, item, new))
        own = np.nonzero(new)[0]
        self.first = np.concatenate((own, [len(new)]))
        self.items, self.hashes, self.at, self.end = item, hashes[own], at[own], end[own]
        sizes = size[own]
        self.lengths = {int(n): (int(np.searchsorted(sizes, n, "left")), int(np.searchsorted(sizes, n, "right"))) for n in np.unique(sizes)}
        self.maybe = np.zeros(1 << max(16, int(len(own)).bit_length() + 3), bool)  # by a hash's low bits
        self.maybe[(self.hashes & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def _text(self, at: np.ndarray, end: np.ndarray, k: int) -> bytes:
        return self.blob[int(at[k]) : int(end[k])]

    def scan(self, text: str | None) -> tuple[np.ndarray, set]:
        """Which words of the text lie in an occurring window, and the items with such windows."""
        words = Words(text)
        hit, found = np.zeros(words.n, bool), set()
        sizes = [n for n in self.lengths if n <= words.n]
        for lo in range(0, words.n if sizes else 0, BLOCK):
            for n, mixed in words.hashes(sizes, lo, min(words.n, lo + BLOCK)):
                first, last = self.lengths[n]
                some = np.nonzero(self.maybe[(mixed & np.uint64(len(self.maybe) - 1)).astype(np.int64)])[0]
                place = np.minimum(np.searchsorted(self.hashes[first:last], mixed[some]), last - first - 1) + first
                same = self.hashes[place] == mixed[some]
                for i, k in zip(some[same].tolist(), place[same].tolist()):
                    own = words.raw[words.starts[lo + i] : words.ends[lo + i + n - 1]]
                    if own == self._text(self.at, self.end, k):
                        got = self.items[self.first[k] : self.first[k + 1]].tolist()
                    else:
                        got = self.odd.get(int(mixed[i]), {}).get(own)
                    if got is not None:
                        hit[lo + i : lo + i + n] = True
                        found.update(self.ids[x] for x in got)
        return hit, found


def _listed(found: set) -> list[str]:
    """Ids as strings in order; an item whose id is null is not listed."""
    return sorted(str(x) for x in found if x is not None)


HIT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<first: bigint, end: bigint>>"


def _row(hit: np.ndarray, found: set) -> tuple:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    spans = [{"first": a, "end": b} for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist())]
    listed = _listed(found)
    return len(hit), int(hit.sum()), len(listed), listed, spans


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), spans]
    return pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans"])


def _shared(items: DataFrame, window: int, limit: int):
    """A broadcast WindowSet of the items, or None where it could take over `limit` bytes. A
    window begins at a word; it takes 40 bytes at most in the arrays and 16 in the table of
    low bits, and its text lies in the blob once."""
    words = F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    size, many, rows = items.agg(F.sum(F.octet_length("text")), F.sum(words), F.count("*")).first()
    if (size or 0) + 56 * (many or 0) + 64 * rows > limit:
        return None
    rows = sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return items.sparkSession.sparkContext.broadcast(WindowSet(rows, window))


def _narrow_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, item_ids (as strings, sorted)
    and spans (word ranges that are hit). Null or wordless texts have no words and no hits;
    wordless items have no window; items with a null id mark words but are not listed;
    repeated items count once. An empty benchmark hits nothing.
    """
    narrow = id_text(docs, id_col, text_col)
    items = _narrow_items(benchmark, item_col, item_text_col)
    shared = _shared(items, window, broadcast_bytes)
    if shared is None:
        numbered, _ = materialise(narrow.withColumn("row", F.monotonically_increasing_id()), "rows")
        return _scan_by_join(numbered, items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value  # read once by a worker process and kept for its further tasks
        for part in slices(batches, 1):
            yield _batch(part.column(0), [_row(*grams.scan(text)) for text in part.column(1).to_pylist()])

    return narrow.mapInArrow(run, HIT_SCHEMA)


def _grams(table: DataFrame, keep: str, sizes: list[int] | None, window: int) -> DataFrame:
    """(keep, at, n, gram): windows as text, with their first word's place. sizes: of a
    document, the lengths looked for; None: of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            for row, text in zip(part.column(0), part.column(1).to_pylist()):
                words = words_of(text)
                for n in sizes or [min(window, len(words))] * bool(words):
                    many = max(0, len(words) - n + 1)
                    for lo in range(0, many, 100_000):
                        at = range(lo, min(many, lo + 100_000))
                        yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([n] * len(at), pa.int32()), pa.array([b" ".join(words[i : i + n]).decode() for i in at], pa.string())], [keep, "at", "n", "gram"])

    return table.mapInArrow(run, f"{keep} long, at long, n int, gram string")


def _hits_by_join(numbered: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """row, hits (first word, words) and items of the stored rows (row, text) that have hits, for a
    benchmark too large to send round: windows meet by equality on their text. Items are first
    gathered by window, so a window that many documents share costs one row on that side.
    None for a benchmark without words."""
    grams, _ = materialise(_grams(items, "item", None, window).groupBy("gram", "n").agg(F.sort_array(F.collect_set("item")).alias("items")), "grams")
    sizes = [r[0] for r in grams.select("n").distinct().collect()]  # at most `window` values
    if not sizes:
        return None
    met = _grams(numbered.select("row", "text"), "row", sizes, window).join(grams, ["gram", "n"])
    return met.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def _hit_words(text: str | None, hits: list | None) -> np.ndarray:
    hit = np.zeros(len(words_of(text)), bool)
    for h in hits or ():
        hit[h["at"] : h["at"] + h["n"]] = True
    return hit


def _scan_by_join(numbered: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The scan of a stored table (row, doc_id, text) by a join."""
    hits = _hits_by_join(numbered, items, window)
    if hits is None:
        return scan(numbered, items.limit(0), window, item_col="item")
    both = numbered.join(hits, "row", "left").select("doc_id", "text", "hits", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = [_row(_hit_words(text, hits), set(own or ())) for text, hits, own in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))]
            yield _batch(part.column(0), rows)

    return both.mapInArrow(run, HIT_SCHEMA)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The scan as one digest row for each document."""
    got = scan(docs, benchmark, **options)
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, action: str = "drop", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without contamination, all columns as they are: `drop` leaves out documents with a
    hit, `cut` takes the hit spans out of their text. For a benchmark within
    `broadcast_bytes` nothing is shuffled; with a larger one docs are stored with a row number, hits are
    found by the join, and come back to their row by it."""
    if action not in ("drop", "cut"):
        raise ValueError("action is drop or cut")
    items = _narrow_items(benchmark, item_col, item_text_col)
    shared = _shared(items, window, broadcast_bytes)
    at, schema = docs.columns.index(text_col), docs.schema
    if shared is None:
        return _clean_by_join(docs, items, action, window, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for part in slices(batches, at):
            texts = part.column(at).to_pylist()
            hits = [grams.scan(t)[0] for t in texts]
            if action == "drop":
                yield part.filter(pa.array([not h.any() for h in hits], pa.bool_()))
            else:
                new = pa.array([cut(t, h) if h.any() else t for t, h in zip(texts, hits)], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    return small_batches(docs).mapInArrow(run, schema)


def _clean_by_join(docs: DataFrame, items: DataFrame, action: str, window: int, text_col: str) -> DataFrame:
    names = docs.columns
    row, spans = fresh(names, "__row", "__hits")
    stored, _ = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    hits = _hits_by_join(small_batches(stored).select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")), items, window)
    if hits is None:
        return stored.select(*names)
    if action == "drop":
        return stored.join(hits.select(F.col("row").alias(row)), row, "left_anti").select(*names)
    at = names.index(text_col)
    both = stored.join(hits.select(F.col("row").alias(row), F.col("hits").alias(spans)), row, "left").select(*names, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            kind = part.schema.field(at)
            new = [cut(t, _hit_words(t, h)) if h else t for t, h in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist())]
            yield part.set_column(at, kind, pa.array(new, kind.type)).select(names)

    return small_batches(both).mapInArrow(run, docs.schema)


def cut(text: str, hit: np.ndarray) -> str:
    """The text without the words that are hit; separators before them go with them."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    first, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    keep = np.ones(len(raw), bool)
    for k in np.nonzero(hit)[0]:
        keep[(end[k - 1] if k and hit[k - 1] else first[k]) : end[k]] = False
    return bytes(np.frombuffer(raw, np.uint8)[keep]).decode()
