"""Best-fit packing of tokenised documents into fixed-length sequences.

Three parts, each usable on its own:

* `TokenCache` / `tokenise`: exact token ids, cut into pieces of at most `capacity`.
* `plan_bins`: minimum bin slack over the histogram of piece lengths.
* `pack`: gives every piece a sequence and an offset.

The histogram has at most `capacity` entries however large the corpus is, so it is the only
thing that reaches the driver. Bins with the same combination of lengths are made together,
as often as the counts allow, so the plan's size follows the number of distinct lengths,
not the number of pieces. Pieces get their rank among equals without a one-task window:
ranks are numbered within hash buckets of a stored row number, and buckets get offsets.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, id_text, materialise, slices

CAPACITY = 4096
END_ID = 1

# The whole vocabulary of the fast path: printable ASCII and the Latin-1 letters, digits
# and signs. Words with anything else are given to the tokenizer as they are.
_PLAIN = re.compile(r"[!-~\xa1-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = bytes(1 if 65 <= c <= 90 or 97 <= c <= 122 else 2 if c in b".,;:!?" else 0 for c in range(256))  # letters, marks
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


class TokenCache:
    """Token ids of white-space-free words, remembered per process.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of
    its words one after another. A plain word is cut into the parts the tokenizer would
    cut it into; each distinct part is encoded once per process by the tokenizer's own model.
    Other words are encoded whole by the tokenizer itself. `limit` bounds the memory: beyond
    it only what was met most often stays, half as much at most.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # Tasks are what runs in parallel: threads of the tokenizer's own would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)  # for parts that are normalised and split already
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int32)
        self.lens = np.zeros(1 << 16, np.int32)
        self.met = np.zeros(1 << 16, np.int32)  # slices that had the word
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _forget(self) -> None:
        n = len(self.known)
        often = np.argsort(-self.met[:n], kind="stable")[: self.limit // 2]
        keep = np.sort(often[self.met[often] > 1])
        lens = self.lens[keep]
        flat, words = self.flat[ragged(self.starts[keep], lens)], list(self.known)
        met = self.met[keep] // 2
        self.clear()
        self._grow(len(keep), len(flat))
        self.known = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.starts[: len(keep)], self.lens[: len(keep)], self.met[: len(keep)] = np.cumsum(lens) - lens, lens, met
        self.flat[: len(flat)], self.used = flat, len(flat)

    def _grow(self, words: int, ids: int) -> None:
        while words > len(self.starts):
            self.starts, self.lens, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lens, self.met))
        while ids > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))

    def _learn(self, by: object, new: list[str]) -> None:
        """Adds words or parts that are not known yet."""
        n, end = len(self.known), len(self.known) + len(new)
        for lo in range(0, len(new), 20_000):
            ids = [e.ids for e in by.encode_batch_fast(new[lo : lo + 20_000], add_special_tokens=False)]
            at, lens = n + lo, np.fromiter(map(len, ids), np.int32, len(ids))
            total = int(lens.sum())
            self._grow(at + len(ids), self.used + total)
            self.starts[at : at + len(ids)] = self.used + np.cumsum(lens) - lens
            self.lens[at : at + len(ids)] = lens
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.used += total
        self.known.update(zip(new, range(n, end)))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and the number of each word's ids."""
        if len(self.known) > self.limit:
            self._forget()
        get = self.known.get
        found = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
        composed: dict[int, list[str]] = {}
        odd: list[int] = []
        for k in np.nonzero(found < 0)[0].tolist():
            w = words[k]
            if "<|" in w or not _PLAIN.fullmatch(w):
                odd.append(k)
            else:
                composed[k] = _PIECES.findall(w.lower())
        if odd:
            self._learn(self.full, list(dict.fromkeys(words[k] for k in odd)))
            found[odd] = [get(words[k]) for k in odd]
        new = {p: None for parts in composed.values() for p in parts if p not in self.known}
        if new:
            self._learn(self.bare, list(new))
        counts = np.ones(len(words), np.int32)
        parts = np.fromiter(composed, np.int64, len(composed))
        counts[parts] = np.fromiter(map(len, composed.values()), np.int32, len(composed))
        first = np.cumsum(counts) - counts
        at = np.empty(int(counts.sum()), np.int32)
        at[ragged(first[parts], counts[parts])] = np.fromiter(map(get, chain.from_iterable(composed.values())), np.int32)
        whole = found >= 0
        at[first[whole]] = found[whole]
        self.met[at] += 1  # once for each distinct place
        lens = self.lens[at]
        return self.flat[ragged(self.starts[at], lens)], np.add.reduceat(lens, first) if len(words) else lens

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each closed by end_id, and the end of each text."""
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        plain = raw.tobytes()
        if b"<|" not in plain:  # no special token is spelled out
            # ASCII letters may be lowered first where no combining mark can follow them; this only
            # saves work on words that differ in case. A token ends between an ASCII letter and
            # one of these marks, so a blank there changes no id and leaves fewer distinct words.
            if len(raw) and raw.max() < 0xCC:
                raw = np.frombuffer(plain.translate(_LOWER), np.uint8)
            kind = np.frombuffer(plain.translate(_KIND), np.uint8)
            cuts = np.nonzero((kind[:-1] == 1) & (kind[1:] == 2))[0] + 1
            offsets = at - at[0]
            texts = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer((offsets + np.searchsorted(cuts, offsets)).astype(np.int32)), pa.py_buffer(np.insert(raw, cuts, 32))])
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        flat, sizes = self.encode_words(coded.dictionary.to_pylist())
        # The end id is one more word, behind each text's last.
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes), [len(flat) + 1])).astype(np.int32), pa.array(np.append(flat, np.uint32(end_id))))
        word = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int32)
        word = np.insert(word, bounds[1:] - bounds[0], len(sizes))
        taken = lists.take(pa.array(word))
        ends = taken.offsets.to_numpy()[bounds[1:] - bounds[0] + np.arange(1, n + 1)].astype(np.int64)
        return taken.flatten().to_numpy(), ends


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lens)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    out += np.repeat((starts - (ends - lens)).astype(np.int32), lens)
    return out


_CACHES: dict[str, TokenCache] = {}

PIECE_SCHEMA = "doc_id long, piece int, start long, length long"


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 and, with
    `keep_ids`, the ids themselves (little-endian unsigned 32-bit). A null text counts as empty and gives the end id alone; documents
    of more than `capacity` ids are cut at its multiples; repeated rows give repeated pieces.
    `vocabulary` is a tokenizer file that every machine has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _CACHES.get(vocabulary) or _CACHES.setdefault(vocabulary, TokenCache(vocabulary))
        for part in slices(batches, 1):
            ids, ends = cache.encode(pc.fill_null(part.column(1), ""))
            sizes = np.diff(ends, prepend=0)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            bounds = np.concatenate(([0], np.cumsum(length))) * 4
            raw = ids.astype("<u4").tobytes()
            view = memoryview(raw)
            crc = pa.array([zlib.crc32(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64())
            cut = [pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])] * keep_ids
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), crc, *cut], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECE_SCHEMA + ", ids_crc32 long" + ", ids binary" * keep_ids)


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum <= room: {length: times}.

    Subset sums are the bits of an integer. Lengths are taken from the largest down and
    the search ends at the first that reaches `room` exactly. Of a length with k pieces,
    the powers of two that add up to k are shifted in, so k costs log k steps.
    """
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in order:
        if length > room:
            continue
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    total, use = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            use[length] = use.get(length, 0) + take
            total -= length * take
    return use


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack: [(bins, {length: times in each bin})].

    Each bin starts with the longest piece left; the fullest combination of what is left
    fills the rest and is removed. The same combination is used again while the counts last.
    """
    counts = {length: n for length, n in histogram.items() if n > 0}
    assert all(0 < length <= capacity for length in counts), "pieces are longer than a sequence"
    order, plan = sorted(counts, reverse=True), []
    while order:
        first = order[0]
        counts[first] -= 1
        use = fullest(counts, [x for x in order if counts[x]], capacity - first)
        counts[first] += 1
        use[first] = use.get(first, 0) + 1
        bins = min(counts[length] // times for length, times in use.items())
        for length, times in use.items():
            counts[length] -= bins * times
        plan.append((bins, use))
        order = [x for x in order if counts[x]]
    return plan


def _slots(spark: SparkSession, plan: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """The plan as rows: pieces of a length with rank in [first, last) go to these bins. The
    ranks of a length are cut into as many equal parts of `step` as it has runs, and a run
    is a row in each part it reaches, so there are at most two rows for each run and a piece
    looks through a few runs only."""
    runs, done, base = {}, {}, 0
    for bins, use in plan:
        offset = 0
        for length in sorted(use, reverse=True):
            first = done.get(length, 0)
            runs.setdefault(length, []).append((first, first + bins * use[length], use[length], base, offset))
            done[length] = first + bins * use[length]
            offset += length * use[length]
        base += bins
    rows = []
    for length, own in runs.items():
        step = -(-done[length] // len(own))
        rows += [(length, part, step, *r) for r in own for part in range(r[0] // step, (r[1] - 1) // step + 1)]
    return spark.createDataFrame(rows, "slot_length long, part long, step long, first long, last long, times long, base long, at long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to `pieces` (any columns, with a long `length` of 1 to
    `capacity`). The pieces are stored with a row number, so repeated rows get places of their
    own and lie in different buckets. An empty table gives an empty result."""
    spark, payload = pieces.sparkSession, pieces.columns
    row, bucket, rank = fresh(payload, "__row", "__bucket", "__rank")
    pieces, _ = materialise(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if not histogram:
        return pieces.select(*payload, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    slots = _slots(spark, plan_bins(histogram, capacity))
    # Rank among pieces of equal length: hash buckets of bounded size, then their offsets.
    width = max(1, -(-max(histogram.values()) // per_bucket))
    keyed = pieces.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(width)))
    before = Window.partitionBy("__l").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(F.col("length").alias("__l"), F.col(bucket).alias("__b")).count()
    sums = sums.select("__l", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", bucket).orderBy(row)
    ranked = keyed.withColumn(rank, F.row_number().over(inside) - 1)
    ranked = ranked.join(sums, (ranked["length"] == sums["__l"]) & (ranked[bucket] == sums["__b"])).withColumn(rank, F.col(rank) + F.col("__before"))
    # `slots` is bounded by the number of lengths, so each piece finds its run among the few of
    # its part by broadcast equality joins.
    steps = slots.select(F.col("slot_length").alias("__sl"), F.col("step").alias("__step")).distinct()
    runs = slots.groupBy(F.col("slot_length").alias("__rl"), F.col("part").alias("__part")).agg(F.collect_list(F.struct("first", "last", "times", "base", "at")).alias("__runs"))
    placed = ranked.join(F.broadcast(steps), ranked["length"] == steps["__sl"])
    placed = placed.join(F.broadcast(runs), (placed["length"] == runs["__rl"]) & (F.floor(F.col(rank) / F.col("__step")) == runs["__part"]))
    run = F.filter("__runs", lambda r: (r["first"] <= F.col(rank)) & (F.col(rank) < r["last"]))[0]
    placed = placed.withColumn("__run", run).withColumn("__k", F.col(rank) - F.col("__run.first"))
    return placed.select(
        *payload,
        (F.col("__run.base") + F.floor(F.col("__k") / F.col("__run.times"))).cast("long").alias("sequence_id"),
        (F.col("__run.at") + F.pmod(F.col("__k"), F.col("__run.times")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with ids_crc32 and their places; the ids themselves come
    from `tokenise` when a writer needs them, and are not shuffled here."""
    return pack(tokenise(docs, vocabulary, capacity, id_col, text_col, keep_ids=False), capacity)
