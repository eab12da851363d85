from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from brindle.llm import langid
from brindle.llm.common import SLICE_BYTES, SLICE_ROWS, slices


def test_slices_keep_every_row():
    texts = ["", None, "é" * SLICE_BYTES, "a", None] + ["b" * 5000] * 1500 + ["", "c"] * 1000
    batches = [pa.RecordBatch.from_pydict({"id": pa.array(range(len(part)), pa.int64()), "text": pa.array(part, pa.string())}) for part in (texts, [], ["x"])]
    found = list(slices(batches, 1))
    assert [t for b in found for t in b.column(1).to_pylist()] == [*texts, "x"]
    assert [i for b in found for i in b.column(0).to_pylist()] == [*range(len(texts)), 0]
    for b in found:
        size = sum(len((t or "").encode()) for t in b.column(1).to_pylist())
        assert 0 < len(b) <= SLICE_ROWS
        assert size <= SLICE_BYTES or len(b) == 1


def test_workers_unpack_a_slice(spark, monkeypatch):
    class Counting:
        def predict(self, texts):
            return [str(sum(map(len, texts)))] * len(texts), [float(len(texts))] * len(texts)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda context, value: SimpleNamespace(value=value))
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
    rows = langid.predict(docs, Counting()).collect()
    assert [r.doc_id for r in rows] == list(range(3000))
    assert max(r.score for r in rows) <= SLICE_ROWS
    assert max(int(r.lang_pred) for r in rows) <= SLICE_BYTES
