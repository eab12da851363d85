import pytest
from pyspark.sql import functions as F

from brindle.operators import layout
from brindle.sources import tables


def test_cracked_table(spark, tmp_path):
    c = layout.Cracked(spark, f"file://{tmp_path}/c", "v", [30, 60])
    c.store(spark.range(100).select(F.col("id").alias("v"), (F.col("id") * 2).alias("w")))
    keys = lambda df: sorted(r.v for r in df.collect())
    assert keys(c.view(25, 35)) == list(range(25, 35))
    c.insert(spark.createDataFrame([(200, 1), (33, 5)], "v long, w long"))
    c.delete(spark.createDataFrame([(10,), (31,)], "v long"))
    c.insert(spark.createDataFrame([(31, 7)], "v long, w long"))
    assert keys(c.view(30, 34)) == [30, 31, 32, 33, 33]
    assert c.current().count() == 101
    before = c._catalog()["pieces"]
    c.crack(45, 80)
    after = c._catalog()["pieces"]
    assert c.bounds == [30, 45, 60, 80] and len(after) == 5 and after[0] == before[0] and before[1] not in after
    assert keys(c.view(30, 34)) == [30, 31, 32, 33, 33]
    again = layout.Cracked(spark, f"file://{tmp_path}/c", "v")  # opened anew, as it was left
    assert keys(again.view(46, 50)) == [46, 47, 48, 49]
    read = again.view(46, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v)" in read and read.count("piece-") <= 2 and "whole-" not in read
    again.merge()
    assert again._catalog()["inserts"] == again._catalog()["deletes"] == []
    assert keys(again.view(500, 600)) == [] and keys(again.view(200, 201)) == [200]
    assert again.crack_while_idle([45, 50], idle=False) == 0 and again.crack_while_idle([45, 50], idle=True) == 1


def test_ranges_of_many_bounds(spark):
    bounds = list(range(0, 30_000, 10))
    rows = spark.createDataFrame([(-5,), (0,), (9,), (15_555,), (99_999,)], "v long").select(layout.range_of(F.col("v"), bounds).alias("r")).collect()
    assert [r.r for r in rows] == [0, 1, 1, 1556, 3000]


def test_predicted_bounds(spark):
    queries = spark.createDataFrame([(10, 20)] * 5 + [(95, 105)] * 2 + [(50, 51)], "lo long, hi long")
    assert layout.predicted_bounds(queries, "lo", "hi", 10, 2, 2) == [10, 20, 90, 100]


def test_layout_round_trip(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    tables.write_ranges(df, f"file://{tmp_path}/a", "id", 4)
    out = tables.rewrite(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b", "x", 3)
    assert out.count() == 1000 and out.agg(F.sum("id")).first()[0] == 499500


@pytest.mark.parametrize("tier", ["memory", "disk", "disk_2"])
def test_tiers(spark, tier):
    df = layout.change_tier(spark.range(10), tier)
    assert df.count() == 10
    assert df.storageLevel == layout.TIERS[tier]
    assert not layout.change_tier(df, None).is_cached


def test_advice(spark):
    parts = spark.createDataFrame([(1, "row", 100), (2, "row", 100)], "part long, layout string, n_rows long")
    accesses = spark.createDataFrame([(1, "scan", 50.0), (2, "write", 9.0)], "part long, kind string, weight double")
    best = {r.part: r.to_layout for r in layout.advise(parts, accesses).where("score > 0").groupBy("part").agg(F.max_by("to_layout", "score").alias("to_layout")).collect()}
    assert best == {1: "sorted_column"}
    even = layout.load_imbalance(spark.createDataFrame([(1, 5.0), (2, 5.0)], "site long, load double")).collect()
    assert all(r.imbalance == 0 for r in even)
    odd = {r.site: r.imbalance for r in layout.load_imbalance(spark.createDataFrame([(1, 8.0), (2, 2.0)], "site long, load double")).collect()}
    assert odd[1] < 0 < odd[2]
    scores = layout.plan_scores(spark.createDataFrame([(1, 1, "split", 5.0, 1.0)], "part long, site long, action string, benefit double, cost double"), spark.createDataFrame([(1, 0.5)], "site long, imbalance double"), spark.createDataFrame([(1, 1.0)], "site long, imbalance double"))
    assert scores.first().score == 3.0
    runs = spark.createDataFrame([(float(i), float(i % 3), 2.0 + 3 * i + 0.5 * (i % 3)) for i in range(50)], "rows double, width double, s double")
    assert [round(w, 2) for w in layout.fit_costs(runs, ["rows", "width"], "s")] == [2.0, 3.0, 0.5]
    slow = layout.distributed_latency(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "plan string, latency double")).first()
    assert abs(slow.latency - 2.1) < 1e-9


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("t,v\n1,2.5\n2,\n")
    assert [(r.t, r.v) for r in tables.csv_series(spark, f"file://{tmp_path}/s.csv", "t long, v double").collect()] == [(1, 2.5), (2, None)]
