import unicodedata
import zlib

import numpy as np

from brindle.llm import langid


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in langid.query(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    right = total = 0
    for d in docs:
        r = rows[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.held_out:
            total += 1
            right += r.lang_pred == d.lang
    assert right / total > 0.97


def test_tables_equal_convolution():
    draw = np.random.default_rng(1)
    net = langid.ByteCnn(["a", "b"], [draw.normal(0, 1, (k, 256, langid.FILTERS)).astype(np.float32) for k in langid.WIDTHS], draw.normal(0, 0.1, (24, 2)).astype(np.float32), np.zeros(2, np.float32))
    x = draw.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    hidden = []
    for w in net.filters:
        response = np.stack([sum(w[k][x[:, t + k]] for k in range(len(w))) for t in range(langid.WINDOW - len(w) + 1)])
        hidden.append(np.maximum(response.max(0), 0))
    z = np.concatenate(hidden, 1) @ net.dense
    expect = z - np.log(np.exp(z).sum(1, keepdims=True))
    np.testing.assert_allclose(net.log_probabilities(x), expect, atol=1e-3)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 $$", None, "x"), (6, "½ ²", "en", "x"), (7, "Ⅷ ৴ 12", None, "x"), (None, "the cat", "en", "x"), (5, "le chat " * 3000, "fr", "x"), (5, "le chat", "fr", "x")], "doc_id long, text string, lang string, score string")
    rows = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "und"), (7, "und")} <= rows
    nothing = docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang = 'x'")
    assert langid.fit(nothing) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0


def test_prediction_equals_brute_force():
    """Cutting, padding, byte weights and the mean over windows, one text and window at a time."""
    draw = np.random.default_rng(2)
    net = langid.ByteCnn(["a", "b", "c"], [draw.normal(0, 1, (k, 256, langid.FILTERS)).astype(np.float32) for k in langid.WIDTHS], draw.normal(0, 0.3, (24, 3)).astype(np.float32), draw.normal(0, 1, 3).astype(np.float32))
    texts = ["x", "ÀÉ words " * 40, None, "", "½", "Some Text", "z" * langid.WINDOW, "long one " * 20_000]
    labels, scores = net.predict(texts)
    for text, label, score in zip(texts, labels, scores, strict=True):
        if not text or not any(unicodedata.category(c).startswith("L") for c in text):
            assert (label, score) == ("und", 0.0)
            continue
        data, total = text.lower().encode(), 0
        for at in range(0, len(data), langid.WINDOW):
            window = data[at : at + langid.WINDOW]
            total = total + len(window) * net.log_probabilities(np.frombuffer(window.ljust(langid.WINDOW), np.uint8)[None])[0].astype(np.float64)
        p = np.exp(total / len(data))
        assert label == net.languages[int(p.argmax())]
        assert abs(score - p.max() / p.sum()) < 1e-4
