"""Table sources and sinks: Parquet scans, the derived stock table, CSV series, layout-aware writes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``.

    Only a session that runs on this machine alone may go without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
    return os.path.join(base, f"{kind}-{uuid.uuid4().hex}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete tables in a folder, those that writing has finished."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    inside = [f.getPath() for f in system.listStatus(where) if f.isDirectory()]
    return sorted(p.getName() for p in inside if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet scan; filters and columns chosen later are pushed into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock per part and supplier, derived from the lines: times ordered and quantity."""
    return stock_of(table(spark, sf_dir, "lineitem"))


def stock_of(lines: DataFrame) -> DataFrame:
    """Stock of the parts and suppliers of some lines."""
    return lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("s_order_cnt"), F.sum("l_quantity").alias("s_quantity"))


def csv_series(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """An external series from CSV with a stated schema (inference would read the data twice)."""
    return spark.read.csv(path, schema=schema, header=header)


def write_ranges(df: DataFrame, path: str, key: str, partitions: int, sort_by: list[str] | None = None) -> None:
    """A range-partitioned layout, rows sorted so that row groups have tight minima and maxima."""
    df.repartitionByRange(partitions, key).sortWithinPartitions(*(sort_by or [key])).write.mode("overwrite").parquet(path)


def rewrite(spark: SparkSession, source: str, target: str, key: str, partitions: int) -> DataFrame:
    """Reads a stored table and relocates it into another range layout."""
    write_ranges(spark.read.parquet(source), target, key, partitions)
    return spark.read.parquet(target)
