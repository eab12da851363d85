"""Range scans, lookups and selectivity scans over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import when_at
from ..functions.predicates import Chain, Compare, between, ranges
from ..sources.tables import table


def scan(df: DataFrame, key: str, low: object, high: object, columns: list[str], chain: Chain | None = None) -> DataFrame:
    """Rows of a closed key range that meet a predicate chain, some columns of them."""
    chosen = df.where(F.col(key).between(low, high))
    return (chosen.where(chain.build()) if chain else chosen).select(*columns)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def lookup_nullable(keys: DataFrame, df: DataFrame, key: str, column: str) -> DataFrame:
    """For each asked key whether it is there, and its value or null."""
    return keys.join(df.select(key, column, F.lit(True).alias("found")), key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"), column)


def selective(df: DataFrame, column: str, low: str, high: str, share: float) -> DataFrame:
    """Rows whose string is at most the one that lies so far between two bounds."""
    width = 4
    number = lambda s: int.from_bytes(s.encode().ljust(width, b"\0")[:width], "big")
    limit = round(number(low) + share * (number(high) - number(low))).to_bytes(width, "big").decode("latin-1").rstrip("\0")
    return df.where(F.col(column) <= F.lit(limit))


# --- registered queries ---------------------------------------------------------------------------


def key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "orders"), "o_orderkey", 100, 2000, ["o_orderkey", "o_custkey", "o_totalprice"])


def multi_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(ranges("o_orderkey", [(1, 50), (40, 90), (1000, 1100)])).select("o_orderkey", "o_orderstatus")


def predicate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that meet each comparison on whole numbers, fractions, strings and times, in one scan."""
    lines = table(spark, sf_dir, "lineitem")
    values = {"l_orderkey": 500, "l_linenumber": 4, "l_quantity": 25.0, "l_returnflag": "N", "l_shipdate": when_at("1998-01-01")}
    tests = [(c, op, Compare(c, op, v)) for c, v in values.items() for op in ("=", "!=", "<", ">", "<=", ">=")]
    counts = lines.agg(*[F.count(F.when(t.build(), 1)).alias(f"c{i}") for i, (_, _, t) in enumerate(tests)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(op).alias("comparison"), F.col(f"c{i}").alias("n_rows")) for i, (c, op, _) in enumerate(tests)]))
    return counts.select(rows.alias("r")).select("r.*")


CHAINS = {
    "and": Chain([Compare("l_quantity", ">=", 10.0), Compare("l_returnflag", "=", "N")]),
    "or": Chain([], [Compare("l_quantity", "<", 3.0), Compare("l_returnflag", "=", "R")]),
    "and_and_or": Chain([Compare("l_quantity", ">=", 10.0)], [Compare("l_returnflag", "=", "R"), Compare("l_linenumber", "=", 1)]),
    "and_or_or": Chain([Compare("l_quantity", ">=", 49.0)], [Compare("l_returnflag", "=", "R"), Compare("l_linenumber", "=", 1)], joined_by_and=False),
    "empty": Chain(),
}


def predicate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").agg(*[F.count(F.when(c.build(), 1)).alias(k) for k, c in CHAINS.items()])
    return counts.unpivot([], list(CHAINS), "chain", "n_rows")


def prefix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(between("p_type", "P", "Q")).select("p_partkey", "p_type")


def column_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate").groupBy("o_orderpriority").agg(F.count("*").alias("n_rows"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(table(spark, sf_dir, "customer"), "c_custkey", 42).select("c_custkey", "c_name", "c_acctbal")


def nullable_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.range(-2, 5).select(F.col("id").alias("c_custkey"))
    return lookup_nullable(keys, table(spark, sf_dir, "customer"), "c_custkey", "c_name")


def selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer")
    return selective(names, "c_mktsegment", "A", "Z", 0.3).select("c_custkey", "c_mktsegment")


QUERIES = {"scan_key_range": key_range, "scan_multi_range": multi_range, "predicate_matrix": predicate_matrix, "predicate_chains": predicate_chains, "scan_prefix": prefix_range, "column_comparison": column_comparison, "point_lookup": point_lookup, "nullable_lookup": nullable_lookup, "selectivity_scan": selectivity}

_VALUES = {"l_orderkey": "500", "l_linenumber": "4", "l_quantity": "25.0", "l_returnflag": "'N'", "l_shipdate": "TIMESTAMP '1998-01-01'"}
ORACLE_SQL = {
    "scan_key_range": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 2000",
    "scan_multi_range": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 1 AND 90 OR o_orderkey BETWEEN 1000 AND 1100",
    "predicate_matrix": " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{op}' AS comparison, count(*) AS n_rows FROM lineitem WHERE {c} {op} {v}" for c, v in _VALUES.items() for op in ("=", "!=", "<", ">", "<=", ">=")),
    "predicate_chains": "SELECT 'and' AS chain, count(*) AS n_rows FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'N' UNION ALL SELECT 'or', count(*) FROM lineitem WHERE l_quantity < 3 OR l_returnflag = 'R' UNION ALL SELECT 'and_and_or', count(*) FROM lineitem WHERE l_quantity >= 10 AND (l_returnflag = 'R' OR l_linenumber = 1) UNION ALL SELECT 'and_or_or', count(*) FROM lineitem WHERE l_quantity >= 49 OR l_returnflag = 'R' OR l_linenumber = 1 UNION ALL SELECT 'empty', count(*) FROM lineitem",
    "scan_prefix": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'P%'",
    "column_comparison": "SELECT o_orderpriority, count(*) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY o_orderpriority",
    "point_lookup": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42",
    "nullable_lookup": "SELECT k AS c_custkey, c_custkey IS NOT NULL AS found, c_name FROM (SELECT unnest(range(-2, 5)) AS k) LEFT JOIN customer ON c_custkey = k",
    "selectivity_scan": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <= 'H' || chr(127)",
}
