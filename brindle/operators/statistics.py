"""Column statistics, value counts and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.measures import amount
from ..functions.predicates import Chain, Compare
from ..sources.tables import stock_of, table


def numeric_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, maximum, sum, mean and count of several columns from one scan."""
    parts = []
    for c in columns:
        parts += [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"), amount(c).alias(f"{c}__sum"), F.count(c).alias(f"{c}__count")]
    one = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__min").alias("minimum"), F.col(f"{c}__max").alias("maximum"), F.col(f"{c}__sum").alias("total"), (F.col(f"{c}__sum") / F.col(f"{c}__count")).alias("mean"), F.col(f"{c}__count").alias("n_values")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows"))


def widths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean width of each column's text form, from one scan."""
    one = df.agg(*[F.avg(F.octet_length(F.col(c).cast("string"))).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "mean_width")


def selectivities(df: DataFrame, chains: dict[str, Chain]) -> DataFrame:
    """Of each named predicate chain the share of rows that meet it, all from one scan."""
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(chain.build()).alias(name) for name, chain in chains.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("chain"), F.col(name).alias("n_rows"), F.try_divide(F.col(name), F.col("__n")).alias("selectivity")) for name in chains])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def hash_sample(df: DataFrame, key: str, per: str, count: int) -> DataFrame:
    """A reservoir that is the same on every run: per group the ``count`` rows of lowest key digest.

    A rank with a limit: each task keeps ``count`` rows of a group before rows are dealt.
    """
    digest = F.md5(F.col(key).cast("string"))
    placed = F.row_number().over(W.partitionBy(per).orderBy(digest, key))
    return df.select(per, key, placed.alias("__place")).where(F.col("__place") <= count).drop("__place")


def outcomes(runs: DataFrame, operation: str, outcome: str, latency: str) -> DataFrame:
    """Counts and latencies of operations by outcome, in a form that can be merged again."""
    return runs.groupBy(operation, outcome).agg(F.count("*").alias("n"), amount(latency).alias("total"), F.min(latency).alias("least"), F.max(latency).alias("most"))


def merged_outcomes(parts: DataFrame, operation: str, outcome: str) -> DataFrame:
    """One row per operation and outcome from those of several clients, with the mean latency."""
    merged = parts.groupBy(operation, outcome).agg(F.sum("n").cast("long").alias("n"), amount("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return merged.withColumn("mean", F.col("total") / F.col("n"))


def weighted_choice(number: Column, weights: dict[str, int]) -> Column:
    """The operation that a number draws: each as often as its weight."""
    at, total, out = 0, sum(weights.values()), F.lit(None).cast("string")
    place = F.pmod(number, F.lit(total))
    for name, weight in reversed(weights.items()):
        at += weight
        out = F.when(place >= total - at, F.when(place < total - at + weight, name).otherwise(out)).otherwise(out)
    return out


def site_statistics(sites: DataFrame, site: str, table_name: str, width: Column, write: Column) -> DataFrame:
    """What a planner polls of each site: rows, reads, writes, mean row width and share of the load."""
    one = sites.groupBy(site, table_name).agg(F.count("*").alias("n_rows"), F.count_if(write).alias("writes"), F.sum(width).alias("__bytes"))
    total = one.agg(F.sum("n_rows").alias("__all"))
    return one.join(F.broadcast(total)).select(site, table_name, "n_rows", "writes", (F.col("__bytes") / F.col("n_rows")).alias("mean_width"), (F.col("n_rows") / F.col("__all")).alias("load"))


def decayed_counts(df: DataFrame, group: str, time: str, half_life_s: float) -> DataFrame:
    """Access counts in which an access weighs half as much after each half-life."""
    end = df.agg(F.max(time).alias("__end"))
    age = (F.unix_micros(F.col("__end").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 1e6
    return df.join(F.broadcast(end)).groupBy(group).agg(F.round(F.sum(F.pow(F.lit(0.5), F.floor(age / half_life_s)).cast("decimal(28,18)")).cast("double"), 6).alias("weight"))


def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric_statistics(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def counts_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(table(spark, sf_dir, "lineitem"), "l_returnflag")


def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widths(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


def stock_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different items of the last orders whose stock is low."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    last = orders.agg((F.max("o_orderkey") - 20).alias("after"))
    recent = lines.join(F.broadcast(last), F.col("l_orderkey") > F.col("after")).select("l_partkey", "l_suppkey").distinct()
    # Only lines of the recent orders' items are aggregated, not the stock of everything.
    wanted = lines.join(recent, ["l_partkey", "l_suppkey"], "left_semi")
    return stock_of(wanted).where("s_quantity < 60").agg(F.countDistinct("l_partkey").alias("low_items"))


def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_orderkey").between(100, 119)).select("l_partkey").distinct()


def sampled_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_sample(table(spark, sf_dir, "events"), "event_id", "event_type", 5)


def access_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decayed_counts(table(spark, sf_dir, "events"), "event_type", "ts", 86400.0)


def chain_selectivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with null cells take part: they meet no comparison."""
    lines = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"), "l_discount")
    chains = {"few": Chain([Compare("quantity", "<", 10.0)]), "few_or_cheap": Chain([Compare("quantity", "<", 10.0)], [Compare("l_discount", ">", 0.08)], False), "both": Chain([Compare("quantity", ">=", 10.0), Compare("l_discount", "<=", 0.02)])}
    return selectivities(lines, chains)


def operation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of two clients, merged."""
    events = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 7 == 0, "abort").otherwise("commit").alias("outcome"), "value", "event_id")
    clients = [outcomes(events.where(F.col("event_id") % 2 == k), "event_type", "outcome", "value") for k in (0, 1)]
    return merged_outcomes(clients[0].unionByName(clients[1]), "event_type", "outcome")


MIX = {"new_order": 45, "payment": 45, "stock_level": 10}


def operation_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each operation of a mix is drawn by a linear congruential sequence."""
    draws = spark.range(10_000).select(weighted_choice((F.col("id") * 7919 + 104_729) % 1_000_003, MIX).alias("operation"))
    return draws.groupBy("operation").agg(F.count("*").alias("n"))


def polled_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("site", F.col("user_id") % 3)
    return site_statistics(events, "site", "event_type", F.octet_length("props") + 8, F.col("event_type") == "purchase")


QUERIES = {"column_statistics": column_statistics, "value_counts": counts_of_values, "column_widths": column_widths, "stock_level": stock_level, "recent_items": recent_items, "sampled_accesses": sampled_accesses, "access_decay": access_decay, "chain_selectivities": chain_selectivities, "operation_outcomes": operation_outcomes, "operation_mix": operation_mix, "site_statistics": polled_sites}
_STATS = "SELECT '{0}' AS column_name, CAST(min({0}) AS DOUBLE) AS minimum, CAST(max({0}) AS DOUBLE) AS maximum, CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / count({0}) AS mean, count({0}) AS n_values FROM lineitem"
ORACLE_SQL = {
    "column_statistics": " UNION ALL ".join(_STATS.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "value_counts": "SELECT l_returnflag, count(*) AS n_rows FROM lineitem GROUP BY l_returnflag",
    "column_widths": " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(octet_length(encode(CAST({c} AS VARCHAR)))) AS mean_width FROM customer" for c in ("c_custkey", "c_name", "c_mktsegment")),
    "stock_level": "SELECT count(DISTINCT st.l_partkey) AS low_items FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey > (SELECT max(o_orderkey) - 20 FROM orders)) r JOIN (SELECT l_partkey, l_suppkey, sum(l_quantity) AS s_quantity FROM lineitem GROUP BY l_partkey, l_suppkey) st ON st.l_partkey = r.l_partkey AND st.l_suppkey = r.l_suppkey WHERE st.s_quantity < 60",
    "recent_items": "SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 119",
    "sampled_accesses": "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn FROM events) WHERE rn <= 5",
    "chain_selectivities": "WITH l AS (SELECT CASE WHEN l_linenumber != 3 THEN l_quantity END AS q, l_discount AS d FROM lineitem), c AS (SELECT 'few' AS chain, count(*) FILTER (q < 10) AS n_rows, count(*) AS n FROM l UNION ALL SELECT 'few_or_cheap', count(*) FILTER (coalesce(q < 10, FALSE) OR d > 0.08), count(*) FROM l UNION ALL SELECT 'both', count(*) FILTER (q >= 10 AND d <= 0.02), count(*) FROM l) SELECT chain, n_rows, n_rows / n AS selectivity FROM c",
    "operation_outcomes": "SELECT event_type, CASE WHEN user_id % 7 = 0 THEN 'abort' ELSE 'commit' END AS outcome, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(value) AS least, max(value) AS most, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM events GROUP BY ALL",
    "operation_mix": "SELECT CASE WHEN p < 45 THEN 'new_order' WHEN p < 90 THEN 'payment' ELSE 'stock_level' END AS operation, count(*) AS n FROM (SELECT ((i * 7919 + 104729) % 1000003) % 100 AS p FROM (SELECT unnest(range(10000)) AS i)) GROUP BY 1",
    "site_statistics": "SELECT user_id % 3 AS site, event_type, count(*) AS n_rows, count(*) FILTER (event_type = 'purchase') AS writes, avg(strlen(props) + 8) AS mean_width, count(*) / (SELECT count(*) FROM events) AS load FROM events GROUP BY 1, 2",
    "access_decay": "SELECT event_type, round(CAST(sum(CAST(pow(0.5, floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1e6 / 86400.0)) AS DECIMAL(28,18))) AS DOUBLE), 6) AS weight FROM events GROUP BY event_type",
}
