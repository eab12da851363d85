"""Inserts, updates and deletes on immutable tables: each gives the new table.

A change set is small beside its table, but that is for the planner to find out; joins carry no
hints.  Rows of a change set that share a key would be ambiguous: the one of highest version wins,
or without a version the greatest by its other columns in order (nulls first).  A row without a key
is no row: it stays out of what is inserted and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import amount
from ..sources.tables import table


def one_each(new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """One row per key, none without: an arg-max with partial aggregation."""
    named = new.where(F.col(key).isNotNull())
    first = [version] if version else []
    rest = [c for c in new.columns if c != key and c not in first]
    return named.groupBy(key).agg(F.max(F.struct(*first, *rest)).alias("__one")).select(*[key if c == key else F.col(f"__one.{c}").alias(c) for c in new.columns])


def insert(df: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Appends rows of new keys; a row whose key is present is a conflict and stays out."""
    return df.unionByName(one_each(new, key, version).join(df.select(key), key, "left_anti"))


def conflicts(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(df.select(key), key, "left_semi")


def update(df: DataFrame, cells: DataFrame, key: str, column: str, version: str | None = None) -> DataFrame:
    """Replaces cells of present keys, null included; keys that are not there change nothing."""
    wanted = [key, column, *([version] if version else [])]
    given = one_each(cells.select(*wanted), key, version).select(key, F.col(column).alias("__new"), F.lit(True).alias("__given"))
    return df.join(given, key, "left").withColumn(column, F.when(F.col("__given"), F.col("__new")).otherwise(F.col(column))).select(*df.columns)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def upsert(df: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    one = one_each(new, key, version)
    return df.join(one.select(key), key, "left_anti").unionByName(one)


def latest(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The change of highest version per key; an arg-max with partial aggregation."""
    rest = [c for c in changes.columns if c not in (key, version)]
    return changes.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("__last")).select(key, "__last.*")


# --- registered queries ---------------------------------------------------------------------------


def _new(spark: SparkSession) -> DataFrame:
    """New suppliers, each twice, and one without a key."""
    names = F.explode(F.array(F.lit("new "), F.lit("mew "))).alias("name")
    twice = spark.range(6).select(F.when(F.col("id") < 5, F.col("id") * 1000).alias("s_suppkey"), "id", names)
    return twice.select("s_suppkey", F.concat("name", F.col("id").cast("string")).alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(0.5).alias("s_acctbal"))


def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), _new(spark), "s_suppkey")


def update_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    cells = supplier.where("s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") * 2).alias("s_acctbal"), F.lit(2).alias("version"))
    earlier = cells.select("s_suppkey", F.lit(9e9).alias("s_acctbal"), F.lit(1).alias("version"))
    return update(supplier, cells.unionByName(earlier), "s_suppkey", "s_acctbal", "version")


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), _new(spark).withColumn("s_suppkey", F.col("s_suppkey") / 100).withColumn("s_suppkey", F.col("s_suppkey").cast("long")), "s_suppkey")


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return delete(supplier, spark.range(0, 50, 2).select(F.col("id").alias("s_suppkey")), "s_suppkey")


def read_modify_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds each customer's order total to the balance, in one pass over the orders."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(amount("o_totalprice").alias("c_add"))
    return customer.join(spent, "c_custkey", "left").select("c_custkey", (F.col("c_acctbal") + F.coalesce("c_add", F.lit(0.0))).alias("c_acctbal"))


def apply_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays a change stream: the last write per user wins, errors delete."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return latest(events, "user_id", "event_id").where("event_type != 'error'").select("user_id", "event_id", "event_type", "value")


QUERIES = {"insert_rows": insert_rows, "update_cells": update_cells, "upsert_rows": upsert_rows, "delete_rows": delete_rows, "read_modify_write": read_modify_write, "apply_latest_version": apply_latest}
ORACLE_SQL = {
    "insert_rows": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT i * 1000, 'new ' || i, 1, 0.5 FROM (SELECT unnest(range(0, 5)) AS i) WHERE i * 1000 NOT IN (SELECT s_suppkey FROM supplier)",
    "update_cells": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN s_acctbal * 2 WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier",
    "upsert_rows": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT unnest(range(0, 5)) * 10) UNION ALL SELECT i * 10, 'new ' || i, 1, 0.5 FROM (SELECT unnest(range(0, 5)) AS i)",
    "delete_rows": "SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_suppkey % 2 = 0 AND s_suppkey BETWEEN 0 AND 49)",
    "read_modify_write": "SELECT c_custkey, c_acctbal + coalesce((SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_custkey = c_custkey), 0) AS c_acctbal FROM customer",
    "apply_latest_version": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type != 'error'",
}
