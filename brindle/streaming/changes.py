"""Structured Streaming: applying change streams and counting arrivals in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import latest
from ..sources.tables import folders, remove

CHANGE = T.StructType([T.StructField("key", T.LongType()), T.StructField("op", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("version", T.LongType()), T.StructField("ts", T.TimestampType())])


def file_source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: T.StructType, offsets: str = "earliest") -> DataFrame:
    """Changes as JSON values of a topic, from given offsets on (needs the Kafka package)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("c")).select("c.*")


def kafka_sink(changes: DataFrame, servers: str, topic: str, checkpoint: str):
    """Writes changes to a topic, keyed so that those of a key stay in order."""
    out = changes.select(F.col("key").cast("string").alias("key"), F.to_json(F.struct(*changes.columns)).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def subscribe(changes: DataFrame, low: int, high: int) -> DataFrame:
    """Only changes of a key range."""
    return changes.where(F.col("key").between(low, high))


class Replica:
    """The state that a change stream leads to: a Parquet table and deltas that wait to be folded in.

    A micro-batch writes its last change per key, and nothing else; every ``fold`` batches state
    and deltas become the next table, and what that replaces is removed.  What is there is read off
    the folder, where a table counts once it is complete, so a replica that is opened again goes on
    where the last one stopped.  A change older than the state's is stale and ignored, so batches
    may come out of order or twice; deletes stay as tombstones, else an older write could come back.
    """

    def __init__(self, spark: SparkSession, path: str, fold: int = 8):
        self.spark, self.path, self.fold = spark, path, fold

    def _numbers(self) -> tuple[int, list[int]]:
        """The newest table's batch, or -1, and those of the deltas after it."""
        there = [name.split("-") for name in folders(self.spark, self.path) if name.count("-") == 1]
        base = max((int(n) for kind, n in there if kind == "state"), default=-1)
        return base, sorted(int(n) for kind, n in there if kind == "delta" and int(n) > base)

    def state(self) -> DataFrame:
        schema = T.StructType([f for f in CHANGE if f.name != "ts"])
        base, deltas = self._numbers()
        paths = [f"{self.path}/state-{base}"] * (base >= 0) + [f"{self.path}/delta-{n}" for n in deltas]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return latest(self.spark.read.schema(schema).parquet(*paths), "key", "version").select("key", "op", "value", "version")

    def rows(self) -> DataFrame:
        return self.state().where("op != 'delete'").select("key", "value", "version")

    def apply(self, changes: DataFrame, batch: int) -> None:
        base, deltas = self._numbers()
        if batch <= base:  # a batch again that is folded in
            return
        new = latest(changes.select("key", "op", "value", "version"), "key", "version")
        new.select("key", "op", "value", "version").write.mode("overwrite").parquet(f"{self.path}/delta-{batch}")
        if len(deltas) + 1 >= self.fold:
            self.state().write.mode("overwrite").parquet(f"{self.path}/state-{batch}")
            for old in [f"state-{base}"] * (base >= 0) + [f"delta-{n}" for n in {*deltas, batch}]:
                remove(self.spark, f"{self.path}/{old}")

    def follow(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def wait_for(self, version: int) -> bool:
        """Whether the state has come to a version: what a reader that needs it asks."""
        got = self.state().agg(F.max("version")).first()[0]
        return got is not None and got >= version


def windowed_counts(events: DataFrame, key: str, time: str, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Arrivals per id and window; rows later than the watermark are dropped from streams."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("cnt")).select(key, F.col("w.start").alias("bucket"), "cnt")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("cnt")).select(key, F.col("w.start").alias("first"), "cnt")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session windows of a stream, over the whole table at once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions(events, "user_id", "ts", "6 hours").select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), "cnt")


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return windowed_counts(events, "event_type", "ts", "2 days", "1 day", "1 day").select("event_type", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "cnt")


def replica_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replaying the events as changes of versions leads to: errors delete."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = events.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("op"), "value", F.col("event_id").alias("version"))
    return latest(changes, "key", "version").where("op != 'delete'").select("key", "value", "version")


QUERIES = {"session_windows": user_sessions, "sliding_windows": sliding_counts, "replica_state": replica_state}
ORACLE_SQL = {
    "session_windows": "SELECT user_id, min(ts) AS first, count(*) AS cnt FROM (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s",
    "sliding_windows": "SELECT event_type, bucket, count(*) AS cnt FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS bucket FROM events) GROUP BY event_type, bucket",
    "replica_state": "SELECT user_id AS key, value, event_id AS version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type != 'error'",
}
