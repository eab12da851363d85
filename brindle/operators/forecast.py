"""Forecasts of arrivals: periodic, autoregressive on lags, ensemble, schedules, and what to expect.

Arrivals are counts per id and slot.  A dense spine of slots makes lags right where slots are
empty; it is generated per id between its own first and last slot, so its size is slots times ids.
Model fits are linear least squares over few features: their normal equations are sums, which
Spark aggregates with partial results, and the small systems of a batch of ids are solved at once.
Models are fitted to slots before a cut and asked about slots from the cut on; where a lag of an
asked slot lies beyond the cut itself, what arrived there is used, as when time goes on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, table

NEVER = float("inf")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def arrivals(events: DataFrame, key: str, time: str, slot_s: int) -> DataFrame:
    """Counts per id and tumbling slot; ``slot`` is the number of slots since the epoch."""
    return events.groupBy(key, F.floor(micros(time) / (slot_s * 1_000_000)).cast("long").alias("slot")).agg(F.count("*").alias("cnt"))


def dense(counts: DataFrame, key: str) -> DataFrame:
    """Adds the empty slots between each id's first and last."""
    bounds = counts.groupBy(key).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    spine = bounds.select(key, F.explode(F.sequence("lo", "hi")).alias("slot"))
    return spine.join(counts, [key, "slot"], "left").select(key, "slot", F.coalesce("cnt", F.lit(0)).alias("cnt"))


# --- periodic -------------------------------------------------------------------------------------


def simple_periods(observed: DataFrame, key: str, time: str, schedules: DataFrame | None = None) -> DataFrame:
    """Last arrival and period per id: the last gap, or the id's explicit schedule.

    The two last arrivals come from arg-max aggregates over arrival order; no window sorts an id's
    whole history.
    """
    last = observed.groupBy(key).agg(F.max(F.struct("seq", time)).alias("l"))
    prior = observed.join(last.select(key, F.col("l.seq").alias("ls")), key).where("seq < ls").groupBy(key).agg(F.max(F.struct("seq", time)).alias("p"))
    both = last.join(prior, key, "left").select(key, F.col(f"l.{time}").alias("last"), F.abs(F.col(f"l.{time}") - F.col(f"p.{time}")).alias("gap"))
    if schedules is None:
        return both
    return both.join(schedules.select(key, F.col("period").alias("__p")), key, "left").select(key, "last", F.coalesce("__p", "gap").alias("gap"))


def next_arrival(periods: DataFrame, key: str) -> DataFrame:
    return periods.select(key, (F.col("last") + F.col("gap")).alias("next"))


def predicted_ids(periods: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Ids whose next arrival lies in a closed interval."""
    return next_arrival(periods, key).where(F.col("next").between(low, high)).select(key)


def estimated_count(periods: DataFrame, key: str, time: int) -> DataFrame:
    """One for ids of which a whole number of periods ends at a time, else zero."""
    whole = (F.lit(time) - F.col("last")) % F.col("gap") == 0
    return periods.select(key, F.when((F.col("gap") > 0) & whole, 1).otherwise(0).alias("cnt"))


# --- autoregressive on lags -----------------------------------------------------------------------


def lag_features(series: DataFrame, key: str, period: int, periods: int, recent: int) -> DataFrame:
    """Features of each slot: values whole periods back, and how recent slots deviate from theirs.

    The lag of k periods is k times the period in slots.
    """
    w = W.partitionBy(key).orderBy("slot")
    back = [F.lag("cnt", k * period).over(w).alias(f"p{k}") for k in range(1, periods + 1)]
    near = [F.lag("cnt", j).over(w).alias(f"r{j}") for j in range(1, recent + 1)]
    theirs = [F.lag("cnt", j + k * period).over(w).alias(f"d{j}_{k}") for j in range(1, recent + 1) for k in range(1, periods + 1)]
    wide = series.select(key, "slot", "cnt", *back, *near, *theirs)
    off = [(F.col(f"r{j}") - reduce(lambda a, b: a + b, (F.col(f"d{j}_{k}") for k in range(1, periods + 1))) / periods).alias(f"t{j}") for j in range(1, recent + 1)]
    return wide.select(key, "slot", "cnt", *[f"p{k}" for k in range(1, periods + 1)], *off).where(f"t{recent} IS NOT NULL")


def normal_equations(rows: DataFrame, key: str, features: list[str], target: str) -> DataFrame:
    """Sums of products per id: all that a least-squares fit needs, whatever the rows' number."""
    xs = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    sums = [F.sum(xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))] + [F.sum(xs[i] * F.col(target)).alias(f"b{i}") for i in range(len(xs))]
    return rows.groupBy(key).agg(*sums)


def solve(equations: DataFrame, key: str, size: int, ridge: float = 1e-3) -> DataFrame:
    """Weights per id: ``size`` features and the constant first."""
    m = size + 1

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            column = lambda name: pdf[name].to_numpy(np.float64)
            a = np.stack([np.stack([column(f"a{min(i, j)}_{max(i, j)}") for j in range(m)], -1) for i in range(m)], 1) + ridge * np.eye(m)
            b = np.stack([column(f"b{i}") for i in range(m)], -1)
            yield pd.DataFrame({key: pdf[key], "weights": list(np.linalg.solve(a, b[..., None])[..., 0])})

    kind = equations.schema[key].dataType.simpleString()
    return equations.mapInPandas(run, f"{key} {kind}, weights array<double>")


def dot(weights: str, features: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.get(weights, i + 1) * F.col(f) for i, f in enumerate(features)), F.get(weights, 0))


def fit_and_ask(rows: DataFrame, key: str, features: list[str], cut: int | None, ridge: float) -> DataFrame:
    """Estimates of the slots from the cut on by models fitted before it; without a cut, of all."""
    before, after = (rows, rows) if cut is None else (rows.where(F.col("slot") < cut), rows.where(F.col("slot") >= cut))
    weights = solve(normal_equations(before, key, features, "cnt"), key, len(features), ridge)
    return after.join(weights, key).select(key, "slot", "cnt", dot("weights", features).alias("estimate"))


def lag_names(periods: int, recent: int) -> list[str]:
    return [f"p{k}" for k in range(1, periods + 1)] + [f"t{j}" for j in range(1, recent + 1)]


def fit_lags(series: DataFrame, key: str, period: int, periods: int = 2, recent: int = 2, cut: int | None = None) -> DataFrame:
    """One-step estimates of slots that have their lags, with what arrived."""
    return fit_and_ask(lag_features(series, key, period, periods, recent), key, lag_names(periods, recent), cut, 1e-3)


def kernel_features(series: DataFrame, key: str, width: int, centres: int = 8, gamma: float = 0.5, cut: int | None = None) -> tuple[DataFrame, list[str]]:
    """Likeness of the last ``width`` slots to centres that lie evenly up to an id's largest count."""
    w = W.partitionBy(key).orderBy("slot")
    known = series if cut is None else series.where(F.col("slot") < cut)
    top = known.groupBy(key).agg(F.greatest(F.max("cnt"), F.lit(1)).alias("top"))
    rows = series.select(key, "slot", "cnt", *[F.lag("cnt", j).over(w).alias(f"r{j}") for j in range(1, width + 1)]).where(f"r{width} IS NOT NULL").join(top, key)
    far = lambda c: reduce(lambda a, b: a + b, (F.pow(F.col(f"r{j}") / F.col("top") - c / (centres - 1), 2) for j in range(1, width + 1)))
    names = [f"k{c}" for c in range(centres)]
    return rows.select("*", *[F.exp(-far(c) / gamma).alias(f"k{c}") for c in range(centres)]), names


def fit_kernel(series: DataFrame, key: str, width: int, centres: int = 8, gamma: float = 0.5, cut: int | None = None) -> DataFrame:
    """Kernel ridge on the last ``width`` slots with fixed centres, in place of online kernel fits.

    With fixed centres the kernel features are plain expressions and the fit is again sums.
    """
    rows, names = kernel_features(series, key, width, centres, gamma, cut)
    return fit_and_ask(rows, key, names, cut, 1e-2)


def fit_hidden(series: DataFrame, key: str, period: int, units: int = 6, seed: int = 3, cut: int | None = None) -> DataFrame:
    """A layer of hidden units on the lags, drawn once, under a fitted output: sums again, no descent."""
    names = lag_names(2, 2)
    draw = np.random.default_rng(seed).normal(0, 1, (units, len(names) + 1))
    rows = lag_features(series, key, period, 2, 2)
    unit = lambda row: F.tanh(reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(n) / 10 for w, n in zip(row[1:], names, strict=True)), F.lit(float(row[0]))))
    hidden = rows.select(key, "slot", "cnt", *names, *[unit(row).alias(f"h{i}") for i, row in enumerate(draw)])
    return fit_and_ask(hidden, key, [*names, *[f"h{i}" for i in range(units)]], cut, 1e-2)


def line_forecast(series: DataFrame, key: str, cut: int, ahead: int) -> DataFrame:
    """Estimates for ``ahead`` slots from the cut on by a straight line through those before it."""
    fit = series.where(F.col("slot") < cut).groupBy(key).agg(F.regr_slope(F.col("cnt").cast("double"), (F.col("slot") - cut).cast("double")).alias("slope"), F.regr_intercept(F.col("cnt").cast("double"), (F.col("slot") - cut).cast("double")).alias("level"))
    return fit.select(key, "slope", "level", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1))).alias("x")).select(key, (F.lit(cut) + F.col("x")).cast("long").alias("slot"), (F.col("level") + F.col("slope") * F.col("x")).alias("estimate"))


def linear_trend(series: DataFrame, key: str, recent: int) -> DataFrame:
    """Per id a straight line through its last slots, and the estimate for the next slot."""
    last = series.groupBy(key).agg(F.max("slot").alias("last"))
    rows = series.join(last, key).where(F.col("slot") > F.col("last") - recent).select(key, "last", (F.col("slot") - F.col("last")).cast("double").alias("x"), F.col("cnt").cast("double").alias("y"))
    fit = rows.groupBy(key, "last").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("level"), F.avg("y").alias("mean"))
    return fit.select(key, (F.col("last") + 1).alias("slot"), F.coalesce(F.col("level") + F.col("slope"), F.col("mean")).alias("estimate"))


def ensemble(linear: Column, recurrent: Column, outlier: Column, threshold: float = 1.5) -> Column:
    """The mean of two models, or the outlier model where it is well above that."""
    hybrid = (linear + recurrent) / 2
    return F.when(outlier > threshold * hybrid, outlier).otherwise(hybrid)


def gaussian_schedule(time: Column, base: int, period: int, window: int, low: float, high: float, sigma: float, mean: float = 0.0) -> Column:
    """A bump of height ``high`` around each scheduled time, ``low`` outside half the window."""
    phase = F.pmod(time - base, F.lit(period))
    off = F.when(phase > period / 2, phase - period).otherwise(phase) - mean
    return F.when(F.abs(off) <= window / 2, low + (high - low) * F.exp(-off * off / (2 * sigma * sigma))).otherwise(F.lit(low))


def expected_ids(estimates: DataFrame, key: str, low: int, high: int, threshold: float) -> DataFrame:
    return estimates.where(F.col("slot").between(low, high) & (F.col("estimate") >= threshold)).select(key).distinct()


def first_expected(estimates: DataFrame, key: str, threshold: float) -> DataFrame:
    """Each id's first slot that reaches the threshold, or never."""
    return estimates.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("estimate") >= threshold, F.col("slot"))).cast("double"), F.lit(NEVER)).alias("next_slot"))


# --- registered queries ---------------------------------------------------------------------------


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("cnt"))


def simple_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last arrival of each user and the gap before it."""
    # The two last arrivals per user by aggregates with partial results; no sort of all events.
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("e"))
    last = events.groupBy("user_id").agg(F.max("e").alias("l"))
    prior = events.join(last, "user_id").where("e < l").groupBy("user_id").agg(F.max("e").alias("p"))
    return last.join(prior, "user_id", "left").select("user_id", F.col("l.ts").alias("last_ts"), (micros("l.ts") - micros("p.ts")).alias("gap_us"))


def periodic_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users expected within two days at the end of the events."""
    events = table(spark, sf_dir, "events").select("user_id", F.floor(micros("ts") / 1_000_000).cast("long").alias("t"), F.col("event_id").alias("seq"))
    return predicted_ids(simple_periods(events, "user_id", "t"), "user_id", 1_706_400_000, 1_706_572_800)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(arrivals(table(spark, sf_dir, "events"), "event_type", "ts", 3600), "event_type")


def dense_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir)


#: Models are fitted to the hours before this day and asked about those from then on.
CUT = 1_706_140_800 // 3600


def lag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag_features(_hourly(spark, sf_dir), "event_type", 24, 2, 2)


def lag_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lag model is solved from: sums of products over the hours before the cut."""
    rows = lag_features(_hourly(spark, sf_dir), "event_type", 24, 2, 2).where(F.col("slot") < CUT)
    sums = normal_equations(rows, "event_type", lag_names(2, 2), "cnt")
    return sums.select("event_type", *[F.round(c, 6).alias(c) for c in sums.columns[1:]])


def lag_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven periods and thirty recent hours, fitted before the cut, asked after it."""
    return fit_lags(_hourly(spark, sf_dir), "event_type", 24, 7, 30, CUT)


def kernel_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the kernel model is solved from, with three centres."""
    rows, names = kernel_features(_hourly(spark, sf_dir), "event_type", 3, 3, cut=CUT)
    sums = normal_equations(rows.where(F.col("slot") < CUT), "event_type", names, "cnt")
    return sums.select("event_type", *[F.round(c, 6).alias(c) for c in sums.columns[1:]])


def kernel_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_kernel(_hourly(spark, sf_dir), "event_type", 3, cut=CUT)


def hidden_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_hidden(_hourly(spark, sf_dir), "event_type", 24, cut=CUT)


def line_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_forecast(_hourly(spark, sf_dir), "event_type", CUT, 48).select("event_type", "slot", F.round("estimate", 6).alias("estimate"))


def expected_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events of which two an hour or more are estimated in some hours after the cut."""
    return expected_ids(line_forecast(_hourly(spark, sf_dir), "event_type", CUT, 48), "event_type", CUT + 5, CUT + 20, 2.0)


def arrival_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hour after the cut for which an estimate reaches a threshold, or never."""
    return first_expected(line_forecast(_hourly(spark, sf_dir), "event_type", CUT, 48), "event_type", 2.7)


def part_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals to expect of each part of a table's keys on the day after the last, by a line through its days.

    A query's range of keys fans out to the parts that it meets.
    """
    asked = table(spark, sf_dir, "events").select("ts", F.explode(F.sequence(F.floor(F.col("user_id") / 25), F.floor((F.col("user_id") + 9) / 25))).alias("part"))
    daily = dense(arrivals(asked, "part", "ts", 86_400), "part")
    return linear_trend(daily, "part", 14).select("part", "slot", F.round("estimate", 6).alias("estimate"))


def trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear_trend(_hourly(spark, sf_dir), "event_type", 48).select("event_type", "slot", F.round("estimate", 6).alias("estimate"))


def ensemble_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag model and kernel model together, a daily schedule as outlier model, asked after the cut."""
    folder = shared_folder(spark, "series")
    # Both models and their fits read the dense series: it is made once.
    _hourly(spark, sf_dir).write.parquet(folder)
    series = spark.read.parquet(folder)
    both = fit_lags(series, "event_type", 24, cut=CUT).join(fit_kernel(series, "event_type", 3, cut=CUT).select("event_type", "slot", F.col("estimate").alias("kernel")), ["event_type", "slot"])
    bump = gaussian_schedule(F.col("slot"), 0, 24, 6, 0.0, 5.0, 1.0)
    return both.select("event_type", "slot", "cnt", ensemble(F.col("estimate"), F.col("kernel"), bump).alias("estimate"))


def schedule_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = spark.range(0, 700).select(F.col("id").alias("t"))
    return times.select("t", F.round(gaussian_schedule(F.col("t"), 37, 150, 64, 2.0, 82.0, 12.0), 6).alias("y"))


def next_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hour in which each kind of event came often."""
    return first_expected(_hourly(spark, sf_dir).withColumnRenamed("cnt", "estimate"), "event_type", 12.0)


def bucketed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals per range of keys: what each part of a table will see, by day."""
    events = table(spark, sf_dir, "events").withColumn("part", F.floor(F.col("user_id") / 25).cast("long"))
    return arrivals(events, "part", "ts", 86_400)


QUERIES = {
    "arrivals_tumbling": tumbling, "simple_next_arrival": simple_next, "periodic_predictions": periodic_predictions, "arrivals_dense": dense_arrivals, "lag_features": lag_rows, "lag_equations": lag_equations, "lag_forecast": lag_forecast, "kernel_equations": kernel_equations, "hidden_forecast": hidden_forecast, "line_estimates": line_estimates, "expected_ahead": expected_ahead, "arrival_ahead": arrival_ahead, "part_forecast": part_forecast, "kernel_forecast": kernel_forecast, "trend_forecast": trend_forecast,
    "ensemble_forecast": ensemble_forecast, "schedule_curve": schedule_curve, "next_expected": next_expected, "bucketed_arrivals": bucketed_arrivals,
}

_COUNTS = "SELECT event_type, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS slot, count(*) AS cnt FROM events GROUP BY 1, 2"
_DENSE = f"(WITH c AS ({_COUNTS}), b AS (SELECT event_type, min(slot) AS lo, max(slot) AS hi FROM c GROUP BY event_type), s AS (SELECT event_type, unnest(range(lo, hi + 1)) AS slot FROM b) SELECT s.event_type, s.slot, coalesce(c.cnt, 0) AS cnt FROM s LEFT JOIN c ON c.event_type = s.event_type AND c.slot = s.slot)"
_CUT = 1_706_140_800 // 3600
_LAGS = f"SELECT event_type, slot, cnt, 1.0::DOUBLE AS x0, lag(cnt, 24) OVER w AS x1, lag(cnt, 48) OVER w AS x2, lag(cnt, 1) OVER w - (lag(cnt, 25) OVER w + lag(cnt, 49) OVER w) / 2 AS x3, lag(cnt, 2) OVER w - (lag(cnt, 26) OVER w + lag(cnt, 50) OVER w) / 2 AS x4 FROM {_DENSE} WINDOW w AS (PARTITION BY event_type ORDER BY slot)"
_FAR = lambda c: " + ".join(f"pow(r{j} / top - {c / 2}, 2)" for j in (1, 2, 3))
_KERNEL = f"WITH d AS {_DENSE}, t AS (SELECT event_type, greatest(max(cnt), 1) AS top FROM d WHERE slot < {_CUT} GROUP BY event_type), r AS (SELECT event_type, slot, cnt, lag(cnt, 1) OVER w AS r1, lag(cnt, 2) OVER w AS r2, lag(cnt, 3) OVER w AS r3 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY slot)) SELECT r.event_type, slot, cnt, 1.0::DOUBLE AS x0, {', '.join(f'exp(-({_FAR(c)}) / 0.5) AS x{c + 1}' for c in range(3))} FROM r JOIN t ON t.event_type = r.event_type WHERE r3 IS NOT NULL"
_SUMS = lambda n: ", ".join([f"round(CAST(sum(x{i} * x{j}) AS DOUBLE), 6) AS a{i}_{j}" for i in range(n) for j in range(i, n)] + [f"round(CAST(sum(x{i} * cnt) AS DOUBLE), 6) AS b{i}" for i in range(n)])
_LINE = f"(WITH d AS {_DENSE}, f AS (SELECT event_type, regr_slope(cnt, slot - {_CUT}) AS m, regr_intercept(cnt, slot - {_CUT}) AS l FROM d WHERE slot < {_CUT} GROUP BY event_type) SELECT event_type, CAST({_CUT} + x AS BIGINT) AS slot, l + m * x AS estimate FROM f, (SELECT unnest(range(48)) AS x))"
_L = lambda k: f"lag(cnt, {k}) OVER w"
ORACLE_SQL = {
    "arrivals_tumbling": "SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS cnt FROM events GROUP BY event_type, date_trunc('hour', ts)",
    "simple_next_arrival": "SELECT user_id, last_ts, gap_us FROM (SELECT user_id, ts AS last_ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) t WHERE rn = 1",
    "arrivals_dense": f"SELECT * FROM {_DENSE}",
    "lag_features": f"SELECT * FROM (SELECT event_type, slot, cnt, {_L(24)} AS p1, {_L(48)} AS p2, {_L(1)} - ({_L(25)} + {_L(49)}) / 2 AS t1, {_L(2)} - ({_L(26)} + {_L(50)}) / 2 AS t2 FROM {_DENSE} WINDOW w AS (PARTITION BY event_type ORDER BY slot)) WHERE t2 IS NOT NULL",
    "lag_equations": f"SELECT event_type, {_SUMS(5)} FROM ({_LAGS}) WHERE x4 IS NOT NULL AND slot < {_CUT} GROUP BY event_type",
    "kernel_equations": f"SELECT event_type, {_SUMS(4)} FROM ({_KERNEL}) WHERE slot < {_CUT} GROUP BY event_type",
    "line_estimates": f"SELECT event_type, slot, round(estimate, 6) AS estimate FROM {_LINE}",
    "expected_ahead": f"SELECT DISTINCT event_type FROM {_LINE} WHERE slot BETWEEN {_CUT + 5} AND {_CUT + 20} AND estimate >= 2.0",
    "arrival_ahead": f"SELECT event_type, coalesce(CAST(min(CASE WHEN estimate >= 2.7 THEN slot END) AS DOUBLE), CAST('inf' AS DOUBLE)) AS next_slot FROM {_LINE} GROUP BY event_type",
    "part_forecast": "WITH a AS (SELECT unnest(range(user_id // 25, (user_id + 9) // 25 + 1)) AS part, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS slot FROM events), c AS (SELECT part, slot, count(*) AS cnt FROM a GROUP BY 1, 2), b AS (SELECT part, min(slot) AS lo, max(slot) AS hi FROM c GROUP BY part), s AS (SELECT part, hi, unnest(range(lo, hi + 1)) AS slot FROM b), r AS (SELECT s.part, hi, CAST(s.slot - hi AS DOUBLE) AS x, CAST(coalesce(cnt, 0) AS DOUBLE) AS y FROM s LEFT JOIN c ON c.part = s.part AND c.slot = s.slot WHERE s.slot > hi - 14) SELECT part, hi + 1 AS slot, round(coalesce(regr_intercept(y, x) + regr_slope(y, x), avg(y)), 6) AS estimate FROM r GROUP BY part, hi",
    "trend_forecast": f"WITH s AS {_DENSE}, r AS (SELECT s.event_type, l, CAST(slot - l AS DOUBLE) AS x, CAST(cnt AS DOUBLE) AS y FROM s JOIN (SELECT event_type, max(slot) AS l FROM s GROUP BY event_type) m ON m.event_type = s.event_type WHERE slot > l - 48) SELECT event_type, l + 1 AS slot, round(coalesce(regr_intercept(y, x) + regr_slope(y, x), avg(y)), 6) AS estimate FROM r GROUP BY event_type, l",
    "schedule_curve": "SELECT t, round(CASE WHEN abs(o) <= 32 THEN 2 + 80 * exp(-o * o / 288.0) ELSE 2 END, 6) AS y FROM (SELECT t, CASE WHEN p > 75 THEN p - 150 ELSE p END AS o FROM (SELECT t, (t - 37 + 150) % 150 AS p FROM (SELECT unnest(range(0, 700)) AS t)))",
    "next_expected": f"SELECT event_type, coalesce(CAST(min(CASE WHEN cnt >= 12 THEN slot END) AS DOUBLE), CAST('inf' AS DOUBLE)) AS next_slot FROM {_DENSE} GROUP BY event_type",
    "periodic_predictions": "WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events), p AS (SELECT a.user_id, a.t AS last, abs(a.t - b.t) AS gap FROM e a JOIN e b ON a.user_id = b.user_id AND a.rn = 1 AND b.rn = 2) SELECT user_id FROM p WHERE last + gap BETWEEN 1706400000 AND 1706572800",
    "bucketed_arrivals": "SELECT CAST(user_id // 25 AS BIGINT) AS part, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS slot, count(*) AS cnt FROM events GROUP BY 1, 2",
}
