"""Document quality by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are embedded, `filters` learned filters of `width` bytes slide over
them by `stride`, and each filter keeps its largest answer over the whole document; a small
hidden layer combines these maxima into one probability. Long documents are read in chunks
that overlap by `width - stride` bytes, so every window of the document is seen once and
memory does not follow the document's length. The network's input is text only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_slices

CHUNK = 1 << 16


@dataclass
class ByteCNN:
    width: int = 24
    stride: int = 4
    dims: int = 4
    filters: int = 32
    hidden: int = 16
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            draw = lambda *shape, fan: (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
            self.weights = {
                "embed": draw(256, self.dims, fan=self.dims),
                "conv": draw(self.width * self.dims, self.filters, fan=self.width),
                "conv_bias": np.zeros(self.filters, np.float32),
                "hidden": draw(self.filters, self.hidden, fan=self.filters),
                "hidden_bias": np.zeros(self.hidden, np.float32),
                "out": draw(self.hidden, 1, fan=self.hidden),
                "out_bias": np.zeros(1, np.float32),
            }

    def windows(self, raw: np.ndarray) -> np.ndarray:
        """(windows, width) bytes of a chunk; zero bytes fill up the last window."""
        n = max(1, -(-max(0, len(raw) - self.width) // self.stride) + 1)
        full = (n - 1) * self.stride + self.width
        if full > len(raw):
            raw = np.concatenate((raw, np.zeros(full - len(raw), np.uint8)))
        return np.lib.stride_tricks.sliding_window_view(raw, self.width)[:: self.stride]

    def chunks(self, raw: np.ndarray):
        """Overlapping chunks that hold each window of the document exactly once."""
        step = CHUNK // self.stride * self.stride
        for lo in range(0, max(1, len(raw) - (self.width - self.stride)), step):
            yield lo, raw[lo : lo + step + self.width - self.stride]

    def pooled(self, raw: np.ndarray, places: bool = False):
        """Each filter's largest answer over the document; with `places`, the winning windows."""
        w = self.weights
        best = np.full(self.filters, -np.inf, np.float32)
        bytes_ = np.zeros((self.filters, self.width), np.uint8)
        for _, chunk in self.chunks(raw):
            rows = self.windows(chunk)
            if places:
                answers = w["embed"][rows].reshape(len(rows), -1) @ w["conv"]
                at = answers.argmax(0)
                top = answers[at, np.arange(self.filters)]
                bytes_[top > best] = rows[at][top > best]
            else:
                # Embedded once; windows are views that step over the embedded bytes.
                flat = chunk if len(chunk) >= (len(rows) - 1) * self.stride + self.width else np.concatenate((chunk, np.zeros((len(rows) - 1) * self.stride + self.width - len(chunk), np.uint8)))
                e = w["embed"][flat].reshape(-1)
                views = np.lib.stride_tricks.as_strided(e, (len(rows), self.width * self.dims), (self.stride * self.dims * 4, 4))
                top = (views @ w["conv"]).max(0)
            best = np.maximum(best, top)
        return (best, bytes_) if places else best

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        a = np.tanh(pooled + w["conv_bias"])
        h = np.tanh(a @ w["hidden"] + w["hidden_bias"])
        return a, h, 1 / (1 + np.exp(-np.clip((h @ w["out"] + w["out_bias"])[:, 0].astype(np.float64), -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities; null and empty texts are one window of zero bytes."""
        pooled = np.stack([self.pooled(np.frombuffer((t or "").encode(), np.uint8)) for t in texts]) if texts else np.zeros((0, self.filters), np.float32)
        return self.head(pooled)[2]

    def fit(self, texts: list[str | None], labels: list[int], epochs: int = 10, least_steps: int = 500, batch: int = 32, rate: float = 4e-3) -> ByteCNN:
        """Adam on cross-entropy with both classes weighted equally. The gradient of a
        maximum flows to the winning window alone, so a step keeps only these windows."""
        rng = np.random.default_rng(self.seed)
        raws = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
        y = np.asarray(labels, np.float64)
        share = np.array([max(1, (y == k).sum()) for k in (0, 1)]) / max(1, len(y))
        weight = np.where(y == 1, 0.5 / share[1], 0.5 / share[0])
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.weights.items()}
        each = -(-len(raws) // batch)
        epochs = max(epochs, -(-least_steps // each))  # small samples are seen more often
        step, total = 0, epochs * each
        for _ in range(epochs):
            order = rng.permutation(len(raws))
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                grads = self._gradients([raws[i] for i in at], y[at], weight[at])
                step += 1
                lr = rate * min(1, step / 20) * (1 - step / (total + 1))
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.99 * v2[k] + 0.01 * g * g
                    self.weights[k] = (self.weights[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, raws: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(raws)
        won = [self.pooled(r, places=True) for r in raws]
        pooled, rows = np.stack([p for p, _ in won]), np.stack([b for _, b in won])  # n x F, n x F x width
        a, h, p = self.head(pooled)
        d_out = ((p - y) * weight / n).astype(np.float32)[:, None]
        d_h = d_out @ w["out"].T * (1 - h * h)
        d_a = d_h @ w["hidden"].T * (1 - a * a)  # n x F
        e = w["embed"][rows]  # n x F x width x dims
        flat = e.reshape(n, self.filters, -1)
        d_e = d_a[:, :, None] * w["conv"].T[None]
        d_embed = np.zeros_like(w["embed"])
        np.add.at(d_embed, rows.reshape(-1), d_e.reshape(-1, self.dims))
        return {
            "embed": d_embed, "conv": np.einsum("nf,nfk->kf", d_a, flat), "conv_bias": d_a.sum(0), "hidden": a.T @ d_h,
            "hidden_bias": d_h.sum(0), "out": h.T @ d_out, "out_bias": d_out.sum(0),
        }


def fold(id_col: str, folds: int = 5):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(folds))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_bytes: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """At most `per_class` labelled texts of each class outside fold 0, of at most
    `max_bytes` bytes each, the first by a hash of the id: the documented bound of what reaches the
    driver is 2 * per_class * max_bytes. Labels of null or repeated ids are left out if they
    contradict each other."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    known = known.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other")).filter("label = other").drop("other")
    known = known.filter(fold("doc_id") != 0)
    # Ids are drawn among those whose text fits, by sizes alone; only then are texts read.
    texts = id_text(docs, id_col, text_col).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    drawn = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    drawn = drawn[0].union(drawn[1])
    rows = texts.join(F.broadcast(drawn), "doc_id").select("label", F.xxhash64("doc_id").alias("h"), "doc_id", "text")
    first = [rows.filter(F.col("label") == k).orderBy("h", "doc_id", "text").limit(per_class) for k in (0, 1)]
    got = first[0].union(first[1]).collect()
    got.sort(key=lambda r: (r["h"], r["doc_id"], r["text"] or ""))
    return [r["text"] for r in got], [r["label"] for r in got]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_bytes: int = 16_384, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> ByteCNN:
    """A network fitted on the bounded sample; with no labels of a class, the untrained one
    with that class's prior (score 1 without label 0, else 0; 0.5 with neither)."""
    texts, y = training_sample(docs, labels, per_class, max_bytes, id_col, text_col, label_col)
    model = ByteCNN(**options)
    if len(set(y)) < 2:
        model.weights["out"] = np.zeros_like(model.weights["out"])
        model.weights["out_bias"] = np.full(1, {(): 0, (0,): -30, (1,): 30}[tuple(set(y))], np.float32)
        return model
    return model.fit(texts, y)


def score(docs: DataFrame, model: ByteCNN, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, from its whole text. The
    model is a few kB and travels with the task. A null id is in no fold: held_out is null."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()))], ["doc_id", "score"])

    scored = map_slices(id_text(docs, id_col, text_col), "text", run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
