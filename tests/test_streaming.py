from datetime import datetime, timedelta

from brindle.streaming import changes


def batch(spark, path, rows):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(k, op, v, n, t + timedelta(minutes=m)) for k, op, v, n, m in rows], changes.CHANGE).coalesce(1).write.mode("append").parquet(path)


def test_replica_applies_in_version_order(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    batch(spark, src, [(1, "insert", 1.0, 1, 0), (2, "insert", 2.0, 2, 0), (1, "write", 9.0, 5, 1)])
    batch(spark, src, [(1, "write", 3.0, 3, 2), (2, "delete", None, 6, 2), (3, "insert", 7.0, 4, 2)])
    batch(spark, src, [(2, "write", 8.0, 4, 3), (3, "write", 7.5, 8, 3), (3, "write", 7.5, 8, 3)])
    replica = changes.Replica(spark, f"file://{tmp_path}/state")
    stream = changes.subscribe(changes.file_source(spark, src, changes.CHANGE), 0, 100)
    replica.follow(stream, f"file://{tmp_path}/cp").awaitTermination(120)
    assert {(r.key, r.value, r.version) for r in replica.rows().collect()} == {(1, 9.0, 5), (3, 7.5, 8)}
    assert replica.wait_for(8) and not replica.wait_for(9)


def test_windows_drop_late_rows(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in ([(1, "a", 0.0, 0, 0), (1, "a", 0.0, 0, 30), (1, "a", 0.0, 0, 90)], [(1, "a", 0.0, 0, 600)], [(1, "a", 0.0, 0, 10), (1, "a", 0.0, 0, 900)], [(1, "a", 0.0, 0, 1800)]):
        batch(spark, src, rows)
        counts = changes.windowed_counts(changes.file_source(spark, src, changes.CHANGE), "key", "ts")
        query = counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
    found = {(r.bucket.hour, r.cnt) for r in spark.read.parquet(out).collect()}
    assert found >= {(0, 2), (1, 1), (10, 1)} and (0, 3) not in found


def test_replica_goes_on_after_a_restart(spark, tmp_path):
    def change(*rows):
        return spark.createDataFrame(list(rows), "key long, op string, value double, version long")

    path = f"file://{tmp_path}/state"
    changes.Replica(spark, path).apply(change((1, "write", 1.0, 1)), 0)
    changes.Replica(spark, path).apply(change((2, "write", 2.0, 2)), 1)
    changes.Replica(spark, path).apply(change((2, "write", 2.0, 2)), 1)  # a batch that comes again
    got = lambda: {(r.key, r.value) for r in changes.Replica(spark, path).rows().collect()}
    assert got() == {(1, 1.0), (2, 2.0)}
    for n in range(2, 12):
        changes.Replica(spark, path, fold=3).apply(change((n % 4, "write", float(n), 10 + n), (9, "delete", None, 10 + n)), n)
    assert got() == {(0, 8.0), (1, 9.0), (2, 10.0), (3, 11.0)}
    assert len(list((tmp_path / "state").iterdir())) <= 4
