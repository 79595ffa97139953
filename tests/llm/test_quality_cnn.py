import zlib

import numpy as np

from corpuswright.llm import quality_cnn, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == {r.doc_id for r in docs}
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(got[i].score, q) for i, q in labels.items() if i in got and got[i].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.85


def test_labels_of_the_held_out_fold_are_not_used(spark, documents):
    labels = documents.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    flipped = labels.withColumn("quality", quality_cnn.F.when(quality_cnn.fold("doc_id") == 0, 1 - quality_cnn.F.col("quality")).otherwise(quality_cnn.F.col("quality")))
    one, two = (quality_cnn.training_sample(documents, x, 50, 16_384, "doc_id", "text", "quality") for x in (labels, flipped))
    assert one == two and 0 < len(one[0]) <= 100


def test_chunks_cover_every_window_once(monkeypatch):
    """Pooling over chunks equals pooling over the whole document, at any length."""
    model = quality_cnn.ByteCNN()
    rng = np.random.default_rng(0)
    for n in (0, 1, 23, 24, 25, 100, 1000, 4096, 5001):
        raw = rng.integers(0, 256, n).astype(np.uint8)
        whole = model.pooled(raw)
        monkeypatch.setattr(quality_cnn, "CHUNK", 256)
        parts, seen = model.pooled(raw), model.pooled(raw, places=True)[0]
        monkeypatch.undo()
        assert np.allclose(whole, parts, atol=1e-5) and np.allclose(whole, seen, atol=1e-5)
        rows = np.concatenate([model.windows(c) for _, c in model.chunks(raw)])
        assert np.array_equal(rows, model.windows(raw))


def slow_score(weights, text, width, stride):
    """The network's answer by plain loops over the document's windows."""
    raw = list((text or "").encode())
    best = [-float("inf")] * weights["conv"].shape[1]
    at = 0
    while True:
        window = raw[at : at + width] + [0] * (width - len(raw[at : at + width]))
        x = np.concatenate([weights["embed"][b] for b in window]).astype(np.float64)
        best = np.maximum(best, x @ weights["conv"])
        if at + width >= len(raw):
            break
        at += stride
    a = np.tanh(best + weights["conv_bias"])
    h = np.tanh(a @ weights["hidden"] + weights["hidden_bias"])
    return 1 / (1 + np.exp(-float((h @ weights["out"] + weights["out_bias"])[0])))


def test_query_by_plain_loops(spark, sf, rows):
    """The registered query's scores, from a network trained again, window by window."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_cnn.train(docs, labels)
    got = {r.doc_id: r.score for r in queries.op2_quality(spark, sf).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:: max(1, len(rows) // 60)]:
        assert abs(got[r.doc_id] - slow_score(model.weights, r.text, model.width, model.stride)) < 1e-3


def test_sample_is_full_though_long_texts_are_labelled(spark):
    docs = spark.range(200).selectExpr("id doc_id", "repeat('x', if(id % 4 = 0, 10, 50000)) text")
    labels = spark.range(200).selectExpr("id doc_id", "cast(id div 4 % 2 as int) quality")
    texts, y = quality_cnn.training_sample(docs, labels, 15, 1000, "doc_id", "text", "quality")
    assert y.count(0) == y.count(1) == 15 and max(map(len, texts)) == 10


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 1), (4, 0), (4, 1), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality_cnn.train(odd, labels)
    got = quality_cnn.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_cnn.score(empty, model).collect() == []
    none = quality_cnn.train(odd, labels.limit(0))
    assert {r.score for r in quality_cnn.score(odd, none).collect()} == {0.5}


def test_gradient():
    """The gradient agrees with finite differences."""
    model = quality_cnn.ByteCNN(filters=3, hidden=2)
    raws = [np.frombuffer(t, np.uint8) for t in (b"hello world, this is a text of some length", b"another!!")]
    y, w = np.array([1.0, 0.0]), np.array([1.0, 1.0])

    def loss():
        p = model.head(np.stack([model.pooled(r) for r in raws]))[2]
        return -np.mean(w * (y * np.log(p) + (1 - y) * np.log(1 - p)))

    grads = model._gradients(raws, y, w)
    for name in ("conv", "hidden", "out", "conv_bias", "embed"):
        g, v = grads[name], model.weights[name]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        v[at] += 1e-2
        up = loss()
        v[at] -= 2e-2
        down = loss()
        v[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4, name
