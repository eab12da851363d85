"""Helpers that several training-data operators share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import utils as errors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only a session that runs on this machine alone may go without that setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if configured is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(configured or "file://" + tempfile.mkdtemp(prefix="shared-"))
        current = context.getCheckpointDir()
    return configured or current


#: Folders made by this driver, in order.
_made: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    _made.append(os.path.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}"))
    return _made[-1]


def folders_made() -> int:
    """How many there are so far: a mark for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: str | None = None) -> None:
    """Deletes the folders made since a mark, but for one, once what reads them is written."""
    for folder in _made[since:]:
        if folder != keep:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made[since:] = [f for f in _made[since:] if f == keep]


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder: cuts lineage and outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of text of an Arrow batch that a Python worker unpacks at a time.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in slices of bounded text in this column, or of one row.

    A worker keeps what it once took, also while it waits between stages, so what it unpacks
    should follow from these bounds and not from the batch that Spark hands over.  After the last
    row Arrow's pool, which holds on to freed batches, gives them back.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            full = np.searchsorted(ends, SLICE_BYTES + (ends[at - 1] if at else 0), "right")
            stop = max(at + 1, min(at + SLICE_ROWS, int(full)))
            yield batch.slice(at, stop - at)
            at = stop
        del batch
    pa.default_memory_pool().release_unused()


WHITE = "\t\n\x0b\x0c\r"


def words_of(text):
    """The words ``[^\\x20\\x09-\\x0D]+`` of a string column as an array; null text has none."""
    clean = F.coalesce(text.cast("string"), F.lit(""))
    for c in WHITE:
        clean = F.replace(clean, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(clean, " ", -1), "")


def hash_share(key, wanted: int, total: int):
    """A condition that about ``wanted`` of ``total`` different keys meet, the same on every run."""
    return F.lit(True) if total <= wanted else F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 32)) < int(wanted / total * (1 << 32))


def once(value):
    """The same value, evaluated where it stands.

    The optimizer would push a later filter through the projection and copy the expression into
    every place that mentions its column, inside array functions once per element.  It does not
    move expressions past one that it takes for non-deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def built_fast(build):
    """Decorates a function that builds large expressions: without PySpark's record of call sites.

    PySpark notes for every column function where it was called, for messages of errors, by
    several calls to the JVM each; an expression of thousands of them would take half a minute.
    """

    @functools.wraps(build)
    def run(*args, **kwargs):
        before = getattr(errors, "_enable_debugging_cache", None)
        errors._enable_debugging_cache = False
        try:
            return build(*args, **kwargs)
        finally:
            errors._enable_debugging_cache = before

    return run
