"""Language identification with a byte convolutional network trained in numpy.

Texts are lower-cased, encoded as UTF-8 and cut into windows of ``WINDOW`` bytes, the last one
padded, so that every byte of a text is seen.  Filters of several widths slide over the one-hot
bytes; each filter's largest response in a window goes to a softmax.  A convolution over one-hot
bytes is a sum of table rows, so inference adds looked-up rows for all windows of a batch at once.
A text's score per language is the byte-weighted mean of its windows' log probabilities.

Training reads a bounded sample: about ``TRAIN_DOCS`` eligible documents by the hash of their id,
at most ``TRAIN_WINDOWS`` windows of each, which executors cut out.  Its size does not grow with the
corpus or its texts; prediction covers all.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; with
no labelled rows every text does.  Of languages that tie the first by name is taken.  Repeated rows
give repeated results; a null ``doc_id`` is not held out, so such rows may train.  Very long texts
are read to their end, a few thousand windows at a time.  Only ``doc_id`` and ``text`` (and ``lang``
for training) are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share, slices, table

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS, BATCH = 3000, 4, 6, 64
#: Windows convolved at once: their responses stay in a core's cache.
CHUNK = 8192


def has_letter(text: str) -> bool:
    """True if there is a character of a letter category; numerals such as a half are none."""
    return any(map(str.isalpha, text))


def windows_of(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW)


class ByteCnn:
    def __init__(self, languages: list[str], filters: list[np.ndarray], dense: np.ndarray, bias: np.ndarray):
        self.languages, self.filters, self.dense, self.bias = languages, filters, dense, bias
        self._pairs: list | None = None

    @classmethod
    def train(cls, windows: list[bytes], langs: list[str], seed: int = 7) -> ByteCnn | None:
        """From windows joined per text, and each text's language; None if there is nothing to learn."""
        languages = sorted(set(langs))
        if not languages:
            return None
        draw = np.random.default_rng(seed)
        xs = [windows_of(w) for w in windows]
        ys = [languages.index(lang) for w, lang in zip(xs, langs, strict=True) for _ in range(len(w))]
        x, y = np.concatenate(xs), np.array(ys)
        net = cls(languages, [draw.normal(0, 0.1, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS], draw.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
        params = [*net.filters, net.dense, net.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        steps = max(EPOCHS, min(1500, EPOCHS * len(x) // BATCH))
        while step < steps:
            order = draw.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                grads = net._gradients(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
                for p, g, (m, v) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + 1e-5 * p
        return net

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        pooled, places = [], []
        for w in self.filters:
            length = WINDOW - len(w) + 1
            response = sum(w[k][x[:, k : k + length]] for k in range(len(w)))
            places.append(response.argmax(1))
            pooled.append(response.max(1))
        hidden = np.maximum(np.concatenate(pooled, 1), 0)
        p = self._softmax(hidden @ self.dense + self.bias)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.dense.T) * (hidden > 0)
        grads = []
        for i, w in enumerate(self.filters):
            g, b = np.zeros_like(w), back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(len(w)):
                np.add.at(g[k], (x[np.arange(n)[:, None], places[i] + k], np.arange(FILTERS)[None]), b)
            grads.append(g)
        return [*grads, hidden.T @ p, p.sum(0)]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """Per width, what is added for each place: (offset, by byte pair, table)."""
        if self._pairs is None:
            self._pairs = []
            for w in self.filters:
                parts = [(k, True, (w[k][None] + w[k + 1][:, None]).reshape(65536, FILTERS)) for k in range(0, len(w) - 1, 2)]
                self._pairs.append(parts + ([(len(w) - 1, False, w[-1])] if len(w) % 2 else []))
        return self._pairs

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), CHUNK):
            x = np.ascontiguousarray(windows[at : at + CHUNK].T)
            pairs = x[:-1] + x[1:].astype(np.uint16) * np.uint16(256)
            hidden = np.zeros((x.shape[1], len(WIDTHS) * FILTERS), np.float32)
            for i, parts in enumerate(self._tables()):
                best = np.zeros((x.shape[1], FILTERS), np.float32)
                for t in range(WINDOW - WIDTHS[i] + 1):
                    rows = [(tab.take((pairs if by_pair else x)[t + k], axis=0)) for k, by_pair, tab in parts]
                    for more in rows[1:]:
                        rows[0] += more
                    np.maximum(best, rows[0], out=best)
                hidden[:, i * FILTERS : (i + 1) * FILTERS] = best
            out[at : at + CHUNK] = np.log(self._softmax(hidden @ self.dense + self.bias) + 1e-9)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        lettered = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not lettered:
            return labels, scores
        data = [texts[i].lower().encode() for i in lettered]
        counts = np.array([max(1, -(-len(d) // WINDOW)) for d in data])
        windows = np.frombuffer(b"".join(d.ljust(n * WINDOW, b" ") for d, n in zip(data, counts.tolist(), strict=True)), np.uint8).reshape(-1, WINDOW)
        starts = np.cumsum(counts) - counts
        weight = np.full(len(windows), WINDOW, np.float32)
        weight[starts + counts - 1] = [len(d) - (n - 1) * WINDOW for d, n in zip(data, counts.tolist(), strict=True)]
        total = np.add.reduceat(self.log_probabilities(windows) * weight[:, None], starts, axis=0)
        p = self._softmax(total / np.add.reduceat(weight, starts)[:, None])
        for i, k, s in zip(lettered, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
            labels[i], scores[i] = self.languages[k], min(1.0, float(s))
        return labels, scores


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1


def some_windows(text: str) -> bytes:
    """At most ``TRAIN_WINDOWS`` windows of a text, joined; which ones depends on its length alone."""
    w = windows_of(text.lower().encode())
    if len(w) > TRAIN_WINDOWS:
        w = w[np.sort(np.random.default_rng(len(w)).choice(len(w) - 1, TRAIN_WINDOWS, replace=False))]
    return w.tobytes()


def fit(docs: DataFrame) -> ByteCnn | None:
    """Trains on a bounded sample of the labelled documents outside the held-out fold."""
    eligible = F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    total = docs.where(eligible).count()
    sample = docs.where(eligible & hash_share(F.col("doc_id"), TRAIN_DOCS, total)).select("text", "lang").where(F.length("text") > 0)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([some_windows(t.as_py()) for t in batch.column(0)], pa.binary()), batch.column(1)], ["windows", "lang"])

    rows = sample.mapInArrow(cut_out, "windows binary, lang string").limit(2 * TRAIN_DOCS).collect()
    rows = sorted((bytes(r.windows), r.lang) for r in rows)
    return ByteCnn.train([w for w, _ in rows], [lang for _, lang in rows])


def predict(docs: DataFrame, net: ByteCnn | None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``doc_id`` (or the columns ``keep``); no shuffle."""
    keep = keep or ["doc_id"]
    chosen = docs.select(F.col("text").alias("__text"), *keep)
    schema = chosen.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    names = [*keep, "lang_pred", "score"]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 0):
            texts = batch.column(0).to_pylist()
            labels, scores = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names)

    return chosen.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
