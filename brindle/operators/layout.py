"""Physical design: range layouts, cracked ranges, storage tiers, and an advisor.

A layout is a Parquet table range-partitioned and sorted by a key; range queries then skip row
groups by their minima and maxima.  Cracking refines boundaries where queries are expected.  Data
are immutable, so inserts and deletes gather as delta files that a merge folds in later.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import folders, rewrite, shared_folder, table, write_ranges

# --- ranges ---------------------------------------------------------------------------------------


def range_of(key: Column, bounds: list) -> Column:
    """Number of the range that a key falls in; bounds are the ranges' inclusive starts but the first.

    A search by halves: as many comparisons as the number of bounds has bits, whatever it is.
    """

    def of(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key >= F.lit(bounds[mid]), of(mid + 1, high)).otherwise(of(low, mid))

    bounds = sorted(bounds)
    return of(0, len(bounds))


def split_bounds(bounds: list, at: object) -> list:
    """One range becomes two (splitting a partition)."""
    return sorted({*bounds, at})


def merge_bounds(bounds: list, at: object) -> list:
    """Two neighbouring ranges become one (merging partitions)."""
    return [b for b in bounds if b != at]


def column_groups(df: DataFrame, key: str, groups: list[list[str]]) -> list[DataFrame]:
    """A vertical split: each group of columns with the key."""
    return [df.select(key, *[c for c in g if c != key]) for g in groups]


def join_groups(parts: list[DataFrame], key: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key)
    return out


TIERS = {"memory": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY, "memory_2": StorageLevel.MEMORY_AND_DISK_2, "disk_2": StorageLevel.DISK_ONLY_2}


def change_tier(df: DataFrame, tier: str | None) -> DataFrame:
    """Keeps a table in memory or on disk (with a replica for ``_2``), or evicts it."""
    df.unpersist()
    return df if tier is None else df.persist(TIERS[tier])


# --- cracking -------------------------------------------------------------------------------------


@dataclass
class Cracked:
    """A table stored by pieces of a key's range, with delta files that wait to be merged.

    A piece is a folder; a crack writes the two parts of one piece and leaves the others alone.
    Pieces, boundaries and deltas are read off a catalog that is itself written as numbered
    versions, so a table that is opened again is as it was left, and a crack that dies half way
    changes nothing.
    """

    spark: SparkSession
    path: str
    key: str
    bounds: list = field(default_factory=list)

    def _catalogs(self) -> list[int]:
        return sorted(int(f.removeprefix("catalog-")) for f in folders(self.spark, self.path) if f.startswith("catalog-"))

    def _catalog(self) -> dict:
        rows = self.spark.read.text(f"{self.path}/catalog-{self._catalogs()[-1]}").collect()
        return json.loads(rows[0].value)

    def _commit(self, catalog: dict) -> None:
        """The next version of the catalog; a folder counts once it is complete."""
        number = max(self._catalogs(), default=0) + 1
        self.spark.createDataFrame([(json.dumps(catalog),)], "value string").coalesce(1).write.text(f"{self.path}/catalog-{number}")
        self.bounds = catalog["bounds"]

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def store(self, df: DataFrame) -> None:
        """Writes the pieces from one pass over the rows: sorted, so that row groups have tight bounds."""
        ranged = df.withColumn("__piece", range_of(F.col(self.key), self.bounds))
        whole = f"whole-{uuid.uuid4().hex}"
        ranged.repartitionByRange("__piece", self.key).sortWithinPartitions("__piece", self.key).write.partitionBy("__piece").parquet(f"{self.path}/{whole}")
        pieces = [f"{whole}/__piece={i}" for i in range(len(self.bounds) + 1)]
        there = {r[0] for r in self.spark.read.parquet(f"{self.path}/{whole}").select("__piece").distinct().collect()}
        self._commit({"bounds": sorted(self.bounds), "pieces": [p if i in there else None for i, p in enumerate(pieces)], "inserts": [], "deletes": [], "schema": df.schema.json()})

    def insert(self, df: DataFrame) -> None:
        catalog = self._catalog()
        self._commit(catalog | {"inserts": [*catalog["inserts"], self._write(df, "in")]})

    def delete(self, keys: DataFrame) -> None:
        """Removes all rows of the keys that are there now, pending ones too."""
        catalog = self._catalog()
        name = self._write(keys.select(self.key).distinct(), "out")
        self._commit(catalog | {"deletes": [*catalog["deletes"], [name, len(catalog["inserts"])]]})

    def _pieces(self, catalog: dict, low: object, high: object) -> list[str]:
        first, last = (sum(b <= x for b in catalog["bounds"]) for x in (low, high))
        return [p for p in catalog["pieces"][first : last + 1] if p]

    def view(self, low: object, high: object) -> DataFrame:
        """Rows of a half-open range: only the pieces that it meets are listed and read."""
        catalog = self._catalog()
        return self._with_deltas(catalog, self._pieces(catalog, low, high), (F.col(self.key) >= F.lit(low)) & (F.col(self.key) < F.lit(high)))

    def current(self) -> DataFrame:
        """Base and pending inserts without pending deletes."""
        catalog = self._catalog()
        return self._with_deltas(catalog, [p for p in catalog["pieces"] if p], F.lit(True))

    def _with_deltas(self, catalog: dict, pieces: list[str], inside: Column) -> DataFrame:
        schema = StructType.fromJson(json.loads(catalog["schema"]))
        df, done = self._read(pieces, schema).where(inside), 0
        for name, after in [*catalog["deletes"], [None, len(catalog["inserts"])]]:
            if after > done:
                df = df.unionByName(self._read(catalog["inserts"][done:after], schema).where(inside))
                done = after
            if name:
                df = df.join(self.spark.read.parquet(f"{self.path}/{name}").where(inside), self.key, "left_anti")
        return df

    def count(self, low: object, high: object) -> DataFrame:
        return self.view(low, high).agg(F.count("*").alias("n_rows"))

    def merge(self) -> None:
        """Folds pending changes in: every piece is written anew."""
        self.bounds = self._catalog()["bounds"]
        self.store(self.current())

    def crack(self, *at: object) -> None:
        """Adds boundaries; of each only the piece that it falls in is rewritten."""
        for b in at:
            catalog = self._catalog()
            if b in catalog["bounds"]:
                continue
            number = sum(x <= b for x in catalog["bounds"])
            old, new = catalog["pieces"][number], [None, None]
            if old:
                rows = self._read([old], StructType.fromJson(json.loads(catalog["schema"])))
                parts = [rows.where(F.col(self.key) < F.lit(b)), rows.where(F.col(self.key) >= F.lit(b))]
                new = [self._write(p.sortWithinPartitions(self.key), "piece") for p in parts]
            self._commit(catalog | {"bounds": split_bounds(catalog["bounds"], b), "pieces": [*catalog["pieces"][:number], *new, *catalog["pieces"][number + 1 :]]})

    def crack_while_idle(self, predicted: list, idle: bool) -> int:
        """Cracks at predicted boundaries if nothing else is to do; returns how many were new."""
        new = [b for b in predicted if b not in self._catalog()["bounds"]] if idle else []
        self.crack(*new)
        return len(new)


#: Patterns of range queries: where the n-th of ``count`` queries begins, as a share of the key range.
PATTERNS = {
    "sequential": lambda i, n: i / n,
    "reverse": lambda i, n: 1 - (i + 1) / n,
    "random": lambda i, n: F.pmod(i * 7919 + 13, F.lit(10_007)) / 10_007,
    "skew": lambda i, n: F.when(i % 10 < 8, F.pmod(i * 7919, F.lit(997)) / 9970).otherwise(F.pmod(i * 104_729, F.lit(997)) / 997),
    "zoom_in": lambda i, n: F.when(i % 2 == 0, i / (2 * n)).otherwise(1 - i / (2 * n)),
    "zoom_out": lambda i, n: F.when(i % 2 == 0, 0.5 - i / (2 * n)).otherwise(0.5 + i / (2 * n)),
    "periodic": lambda i, n: (i % 10) / 10,
    "periodic_shifted": lambda i, n: F.pmod(i % 10 + F.floor(i / 10), F.lit(10)) / 10,
    "sequential_over_random": lambda i, n: F.when(i % 2 == 0, i / n).otherwise(F.pmod(i * 7919, F.lit(997)) / 997),
    "jumps": lambda i, n: F.pmod(i * 31, F.lit(100)) / 100,
    "half_random": lambda i, n: 0.5 + F.pmod(i * 7919, F.lit(997)) / 1994,
    "same": lambda i, n: i * 0 + 0.25,
    "two_spots": lambda i, n: F.when(i % 2 == 0, 0.1).otherwise(0.8),
    "converge": lambda i, n: 0.5 + F.when(i % 2 == 0, 1).otherwise(-1) * (n - i) / (2 * n),
    "blocks": lambda i, n: F.floor(i * 4 / n) / 4 + F.pmod(i * 13, F.lit(25)) / 100,
    "alternate_ends": lambda i, n: F.when(i % 2 == 0, i / n).otherwise(1 - i / n),
    "mixed": lambda i, n: F.when(i * 3 < n, i / n).when(i * 3 < 2 * n, F.pmod(i * 7919, F.lit(997)) / 997).otherwise((i % 10) / 10),
}


def workload(spark: SparkSession, pattern: str, count: int, low: int, high: int, width: int) -> DataFrame:
    """Range queries ``number, lo, hi`` of a pattern, closed-open and inside the key range."""
    share = PATTERNS[pattern](F.col("id"), count)
    begin = F.lit(low) + F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (high - low - width))
    return spark.range(count).select(F.col("id").alias("number"), begin.cast("long").alias("lo"), (begin + width).cast("long").alias("hi"))


def predicted_bounds(queries: DataFrame, low: str, high: str, width: int, most: int, threshold: int) -> list[int]:
    """Boundaries for ranges that many queries are expected to ask for.

    Queries are counted per bucket with partial aggregation; only ``most`` buckets reach the
    driver.
    """
    hot = queries.select(F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))).alias("bucket")).groupBy("bucket").count().where(F.col("count") >= threshold)
    rows = hot.orderBy(F.desc("count"), "bucket").limit(most).collect()
    return sorted({b * width for r in rows for b in (r.bucket, r.bucket + 1)})


# --- advisor --------------------------------------------------------------------------------------

#: Relative costs: of a row by layout for scans, point reads and writes, and of changing a layout.
LAYOUT_COSTS = {"row": (1.0, 0.2, 0.5, 1.0), "column": (0.35, 0.6, 1.2, 1.0), "sorted_column": (0.15, 0.3, 2.0, 1.5), "multi_column": (0.5, 0.4, 0.9, 1.0), "sorted_multi_column": (0.25, 0.25, 1.6, 1.5)}


def candidate_actions(parts: DataFrame) -> DataFrame:
    """Parts (``part, layout, n_rows``) with every other layout that each could have."""
    rows = F.array(*[F.struct(F.lit(k).alias("to_layout"), *[F.lit(v).alias(n) for n, v in zip(("scan_c", "read_c", "write_c", "change_c"), c, strict=True)]) for k, c in LAYOUT_COSTS.items()])
    return parts.select("*", F.explode(rows).alias("c")).select("*", "c.*").drop("c").where("to_layout != layout")


def _now(column: str) -> Column:
    out = F.lit(None).cast("double")
    for k, c in LAYOUT_COSTS.items():
        out = F.when(F.col("layout") == k, F.lit(c[("scan_c", "read_c", "write_c").index(column)])).otherwise(out)
    return out


def advise(parts: DataFrame, accesses: DataFrame, weight: str = "weight") -> DataFrame:
    """Scores every change of layout: expected benefit of upcoming accesses less its cost.

    ``accesses`` has ``part, kind (scan, read, write), weight``: how many are expected to come.
    """
    expected = accesses.groupBy("part").agg(*[F.sum(F.when(F.col("kind") == k, F.col(weight)).otherwise(0.0)).alias(f"n_{k}") for k in ("scan", "read", "write")])
    actions = candidate_actions(parts).join(expected, "part", "left").na.fill(0.0, ["n_scan", "n_read", "n_write"])
    saved = (_now("scan_c") - F.col("scan_c")) * F.col("n_scan") * F.col("n_rows") + (_now("read_c") - F.col("read_c")) * F.col("n_read") + (_now("write_c") - F.col("write_c")) * F.col("n_write")
    return actions.select("part", "layout", "to_layout", saved.alias("benefit"), (F.col("change_c") * F.col("n_rows")).alias("cost"), (saved - F.col("change_c") * F.col("n_rows")).alias("score"))


def wait_at(x: Column) -> Column:
    """The wait that a load beyond the mean adds, bounded and of its sign: ``x / (1 + |x|)``."""
    return x / (1 + F.abs(x))


def load_imbalance(sites: DataFrame, wait=wait_at) -> DataFrame:
    """Per site ``wait(x) - wait(0)`` at ``x = (mean - load) * load / mean``; zero where nothing is loaded."""
    mean = sites.agg(F.avg("load").alias("mean"))
    x = F.coalesce(F.try_divide((F.col("mean") - F.col("load")) * F.col("load"), F.col("mean")), F.lit(0.0))
    return sites.join(F.broadcast(mean)).select("site", "load", (wait(x) - wait(F.lit(0.0))).alias("imbalance"))


def storage_imbalance(sites: DataFrame) -> DataFrame:
    """Per site by which share its bytes are over its capacity, or over the mean use if that is more."""
    use = F.col("bytes") / F.col("capacity")
    mean = sites.agg(F.avg(use).alias("mean"))
    return sites.join(F.broadcast(mean)).select("site", F.greatest(use - 1, use - F.col("mean"), F.lit(0.0)).alias("imbalance"))


def plan_scores(actions: DataFrame, load: DataFrame, storage: DataFrame, w_load: float = 1.0, w_storage: float = 0.5) -> DataFrame:
    """Of actions ``part, site, action, benefit, cost`` the benefit less cost and weighted imbalances."""
    both = load.select("site", F.col("imbalance").alias("__l")).join(storage.select("site", F.col("imbalance").alias("__s")), "site")
    return actions.join(both, "site", "left").select("part", "site", "action", (F.col("benefit") - F.col("cost") - w_load * F.coalesce("__l", F.lit(0.0)) - w_storage * F.coalesce("__s", F.lit(0.0))).alias("score"))


def physical_actions(parts: DataFrame, split_at: float = 1.5, merge_at: float = 0.5, hot_at: float = 1.2) -> DataFrame:
    """Every action that a part is a candidate for, from ``part, writes, reads, tier``.

    Parts of far more writes than the mean are split, of far fewer with a like neighbour merged; parts
    that are read much are replicated, and brought to memory; those hardly read go to disk.
    """
    mean = parts.agg(F.avg("writes").alias("__w"), F.avg("reads").alias("__r"))
    known = parts.join(F.broadcast(mean))
    cold = F.col("writes") <= merge_at * F.col("__w")
    likes = known.where(cold).select((F.col("part") - 1).alias("part"), F.lit(True).alias("__next"))
    joined = known.join(likes, "part", "left")
    rules = {"split": F.col("writes") >= split_at * F.col("__w"), "merge": cold & F.col("__next"), "add_replica": F.col("reads") >= hot_at * F.col("__r"), "to_memory": (F.col("tier") == "disk") & (F.col("reads") >= F.col("__r")), "to_disk": (F.col("tier") == "memory") & (F.col("reads") < merge_at * F.col("__r"))}
    chosen = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda a: a.isNotNull())
    return joined.select("part", F.explode(chosen).alias("action"))


def split_candidates(parts: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Parts with far more writes than the mean part."""
    mean = parts.agg(F.avg("writes").alias("mean"))
    return parts.join(F.broadcast(mean), F.col("writes") >= ratio * F.col("mean")).select("part", "writes")


def merge_candidates(parts: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Neighbouring parts that both have far fewer writes than the mean part."""
    mean = parts.agg(F.avg("writes").alias("mean"))
    cold = parts.join(F.broadcast(mean), F.col("writes") <= ratio * F.col("mean")).select("part")
    return cold.join(cold.select((F.col("part") - 1).alias("part"), F.col("part").alias("next")), "part")


def fit_costs(runs: DataFrame, features: list[str], target: str) -> list[float]:
    """Weights of a linear latency model from past runs; the sums of products are one small row."""
    from .forecast import normal_equations, solve

    one = runs.withColumn("__all", F.lit(0))
    return solve(normal_equations(one, "__all", features, target), "__all", len(features), ridge=1e-6).first().weights


def distributed_latency(sites: DataFrame) -> DataFrame:
    """A scan over several sites is as slow as its slowest, and a little slower the more they differ."""
    return sites.groupBy("plan").agg((F.max("latency") + 0.1 * (F.max("latency") - F.min("latency"))).alias("latency"))


# --- registered queries ---------------------------------------------------------------------------


def _cracked(spark: SparkSession, sf_dir: str) -> Cracked:
    """The lines by order, cracked on the way, with changes before and after cracks."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    cracked = Cracked(spark, shared_folder(spark, "cracked"), "l_orderkey", [1500])
    cracked.store(lines)
    cracked.crack(500, 4000)
    cracked.insert(lines.where("l_orderkey BETWEEN 600 AND 610").withColumn("l_quantity", F.lit(99.0)))
    cracked.delete(spark.range(700, 720).select(F.col("id").alias("l_orderkey")))
    cracked.crack(12000)
    return cracked


def range_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per piece of a cracked table with pending changes."""
    cracked = _cracked(spark, sf_dir)
    return cracked.current().groupBy(range_of(F.col("l_orderkey"), cracked.bounds).cast("long").alias("piece")).agg(F.count("*").alias("n_rows"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


def range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cracked(spark, sf_dir).view(450, 800)


def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a cracked table after its changes were folded in and predicted ranges cracked."""
    cracked = _cracked(spark, sf_dir)
    cracked.merge()
    queries = workload(spark, "periodic", 40, 0, 10_000, 100)
    cracked.crack_while_idle(predicted_bounds(queries, "lo", "hi", 100, 3, 2), idle=True)
    return cracked.count(700, 900)


def query_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pattern of queries how many there are and where they lie."""
    every = None
    for name in PATTERNS:
        one = workload(spark, name, 200, 0, 10_000, 50).withColumn("pattern", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("pattern").agg(F.count("*").alias("n"), F.min((F.col("lo") >= 0) & (F.col("hi") <= 10_000)).alias("inside"), F.count_if(F.col("hi") - F.col("lo") == 50).alias("wide"))


def relocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table persisted in one range layout, and rewritten into another."""
    folder = shared_folder(spark, "layouts")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    write_ranges(orders, f"{folder}/a", "o_orderkey", 4)
    return rewrite(spark, f"{folder}/a", f"{folder}/b", "o_custkey", 3).where(F.col("o_custkey").between(100, 300))


def split_and_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per range after a range was split and two others merged."""
    bounds = merge_bounds(split_bounds([4000, 8000, 12000], 2000), 8000)
    orders = change_tier(table(spark, sf_dir, "orders").select("o_orderkey"), None)
    return orders.groupBy(range_of(F.col("o_orderkey"), bounds).cast("long").alias("piece")).agg(F.count("*").alias("n_rows"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy((F.col("user_id") % 4).alias("site")).agg(F.count_if(F.col("event_type") == "purchase").cast("double").alias("load"), F.count("*").cast("double").alias("bytes")).withColumn("capacity", F.lit(2500.0))


def imbalances(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    both = load_imbalance(sites).join(storage_imbalance(sites).withColumnRenamed("imbalance", "storage"), "site")
    return both.select("site", F.round("imbalance", 9).alias("load_term"), F.round("storage", 9).alias("storage_term"))


def part_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    parts = events.groupBy(F.floor(F.col("user_id") / 3).alias("part")).agg(F.count_if(F.col("event_type") == "purchase").alias("writes"), F.count_if(F.col("event_type") == "view").alias("reads"))
    return physical_actions(parts.withColumn("tier", F.when(F.col("part") % 2 == 0, "disk").otherwise("memory")), 1.2, 0.85, 1.2)


def vertical_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return join_groups(column_groups(customer, "c_custkey", [["c_name"], ["c_acctbal", "c_mktsegment"]]), "c_custkey")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.floor(F.col("o_orderkey") / 3000).cast("long").alias("part")).agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).cast("long").alias("writes")).withColumn("layout", F.lit("row"))


def layout_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "scan").when(F.col("event_type") == "purchase", "write").otherwise("read")
    accesses = events.select(F.pmod("user_id", F.lit(5)).alias("part"), kind.alias("kind"), F.lit(1.0).alias("weight"))
    return advise(_parts(spark, sf_dir), accesses).select("part", "to_layout", F.round("benefit", 4).alias("benefit"), F.round("cost", 4).alias("cost"))


def hot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("part")).agg(F.count("*").alias("writes"))
    return split_candidates(users, 1.1)


def cold_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("part")).agg(F.count("*").alias("writes"))
    return merge_candidates(users, 0.95)


QUERIES = {"crack_pieces": range_view, "crack_rows": range_rows, "crack_count": range_count, "query_patterns": query_patterns, "relocated_layout": relocated, "split_and_merged": split_and_merged, "imbalances": imbalances, "part_actions": part_actions, "vertical_split": vertical_split, "layout_advice": layout_advice, "split_candidates": hot_parts, "merge_candidates": cold_neighbours}
_COSTS = ", ".join(f"('{k}', {c[0]}, {c[1]}, {c[2]}, {c[3]})" for k, c in LAYOUT_COSTS.items() if k != "row")
_WRITES = "(SELECT user_id AS part, count(*) AS writes FROM events GROUP BY user_id)"
_CRACKED = "(SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT BETWEEN 700 AND 719 UNION ALL SELECT l_orderkey, l_linenumber, 99.0 FROM lineitem WHERE l_orderkey BETWEEN 600 AND 610)"
ORACLE_SQL = {
    "crack_pieces": f"SELECT CASE WHEN l_orderkey >= 12000 THEN 4 WHEN l_orderkey >= 4000 THEN 3 WHEN l_orderkey >= 1500 THEN 2 WHEN l_orderkey >= 500 THEN 1 ELSE 0 END::BIGINT AS piece, count(*) AS n_rows, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM {_CRACKED} GROUP BY 1",
    "crack_rows": f"SELECT l_orderkey, l_linenumber, l_quantity FROM {_CRACKED} WHERE l_orderkey >= 450 AND l_orderkey < 800",
    "crack_count": f"SELECT count(*) AS n_rows FROM {_CRACKED} WHERE l_orderkey >= 700 AND l_orderkey < 900",
    "query_patterns": f"SELECT pattern, 200::BIGINT AS n, TRUE AS inside, 200::BIGINT AS wide FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in PATTERNS)}) v(pattern)",
    "relocated_layout": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 100 AND 300",
    "split_and_merged": "SELECT CASE WHEN o_orderkey >= 12000 THEN 3 WHEN o_orderkey >= 4000 THEN 2 WHEN o_orderkey >= 2000 THEN 1 ELSE 0 END::BIGINT AS piece, count(*) AS n_rows FROM orders GROUP BY 1",
    "imbalances": "WITH s AS (SELECT user_id % 4 AS site, count(*) FILTER (event_type = 'purchase') * 1.0::DOUBLE AS l, count(*) / 2500.0::DOUBLE AS u FROM events GROUP BY 1), m AS (SELECT avg(l) AS ml, avg(u) AS mu FROM s), x AS (SELECT site, (ml - l) * l / ml AS x, u, mu FROM s, m) SELECT site, round(x / (1 + abs(x)), 9) AS load_term, round(greatest(u - 1, u - mu, 0), 9) AS storage_term FROM x",
    "part_actions": "WITH p AS (SELECT user_id // 3 AS part, count(*) FILTER (event_type = 'purchase') AS w, count(*) FILTER (event_type = 'view') AS r FROM events GROUP BY 1), k AS (SELECT *, avg(w) OVER () AS aw, avg(r) OVER () AS ar FROM p) SELECT part, 'split' AS action FROM k WHERE w >= 1.2 * aw UNION ALL SELECT a.part, 'merge' FROM k a JOIN k b ON b.part = a.part + 1 WHERE a.w <= 0.85 * a.aw AND b.w <= 0.85 * b.aw UNION ALL SELECT part, 'add_replica' FROM k WHERE r >= 1.2 * ar UNION ALL SELECT part, 'to_memory' FROM k WHERE part % 2 = 0 AND r >= ar UNION ALL SELECT part, 'to_disk' FROM k WHERE part % 2 = 1 AND r < 0.85 * ar",
    "vertical_split": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "layout_advice": f"WITH p AS (SELECT o_orderkey // 3000 AS part, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT user_id % 5 AS part, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'purchase') AS w, count(*) FILTER (event_type NOT IN ('view', 'purchase')) AS r FROM events GROUP BY 1), c(k, sc, rc, wc, ch) AS (VALUES {_COSTS}) SELECT p.part, k AS to_layout, round(CAST((1.0 - sc) * coalesce(s, 0) * n + (0.2 - rc) * coalesce(r, 0) + (0.5 - wc) * coalesce(w, 0) AS DOUBLE), 4) AS benefit, round(CAST(ch * n AS DOUBLE), 4) AS cost FROM p CROSS JOIN c LEFT JOIN a ON a.part = p.part",
    "split_candidates": f"SELECT part, writes FROM {_WRITES} WHERE writes >= 1.1 * (SELECT avg(writes) FROM {_WRITES})",
    "merge_candidates": f"WITH c AS (SELECT part FROM {_WRITES} WHERE writes <= 0.95 * (SELECT avg(writes) FROM {_WRITES})) SELECT a.part, b.part AS next FROM c a JOIN c b ON b.part = a.part + 1",
}
