import datetime as dt

from pyspark.sql import functions as F

from attune.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def write(spark, path, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n}")


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def test_sessions_stream_equals_batch(spark, tmp_path):
    schema = "k STRING, ts TIMESTAMP"
    rows = [("a", T0 + dt.timedelta(minutes=m)) for m in (0, 10, 200, 205, 900)] + [("b", T0)]
    write(spark, str(tmp_path / "in"), rows, schema, 0)
    batch = {tuple(r) for r in jobs.sessions(spark.createDataFrame(rows, schema), "ts", "k", "1 hour", "1 day").collect()}
    stream = jobs.run_to_table(jobs.sessions(source(spark, str(tmp_path / "in"), schema), "ts", "k", "1 hour", "1 minute"), "s", "append", str(tmp_path / "run"))
    closed = {(r["k"], r["start"], r["n"]) for r in stream.collect()}
    assert closed <= batch and len(batch - closed) <= 1  # the newest session stays open at the end


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    schema = "ts TIMESTAMP"
    path = str(tmp_path / "in")
    write(spark, path, [(T0,), (T0 + dt.timedelta(hours=10),)], schema, 0)
    s = jobs.tumbling(source(spark, path, schema), "ts", "1 hour", "1 hour")
    run = str(tmp_path / "run")
    jobs.run_to_table(s, "w", "append", run)
    write(spark, path, [(T0 + dt.timedelta(minutes=5),), (T0 + dt.timedelta(hours=20),)], schema, 1)
    got = {(r["start"], r["n"]) for r in jobs.run_to_table(jobs.tumbling(source(spark, path, schema), "ts", "1 hour", "1 hour"), "w", "append", run).collect()}
    assert (T0, 1) in got and (T0, 2) not in got


def test_first_and_last_by_id(spark, tmp_path):
    schema = "id INT, v STRING, ts TIMESTAMP"
    path = str(tmp_path / "in")
    write(spark, path, [(1, "x", T0), (1, "y", T0 + dt.timedelta(minutes=1)), (2, "z", T0)], schema, 0)
    first = jobs.run_to_table(jobs.first_by_id(source(spark, path, schema), "id", "ts", "1 day"), "f", "append", str(tmp_path / "f"))
    assert first.count() == 2
    last = jobs.newest(jobs.run_to_table(jobs.last_by_id(source(spark, path, schema), "id", "ts"), "l", "update", str(tmp_path / "l")), ["id"])
    assert {r["id"]: r["v"] for r in last.collect()} == {1: "y", 2: "z"}


def test_online_elo_equals_batch_fold(spark, tmp_path):
    from attune.operators import pairs

    schema = "g STRING, a STRING, b STRING, result INT, seq BIGINT"
    rows = [("g", "ab"[i % 2], "cd"[i % 3 % 2], i % 3, i) for i in range(60)]
    path = str(tmp_path / "in")
    write(spark, path, rows[:30], schema, 0)
    run = str(tmp_path / "run")
    jobs.run_to_table(jobs.online_elo(source(spark, path, schema), "g"), "e", "update", run)
    write(spark, path, rows[30:], schema, 1)
    got = jobs.newest(jobs.run_to_table(jobs.online_elo(source(spark, path, schema), "g"), "e", "update", run), ["g", "model"])
    want = pairs.elo(spark.createDataFrame(rows, schema), ["g"], ["seq"])
    assert {r["model"]: round(r["rating"], 9) for r in got.collect()} == {r["model"]: round(r["rating"], 9) for r in want.collect()}


def test_heartbeat_stream_reports_a_silent_worker(spark, tmp_path):
    schema = "w STRING, ts TIMESTAMP"
    path, run = str(tmp_path / "in"), str(tmp_path / "run")
    write(spark, path, [("a", T0), ("b", T0)], schema, 0)
    jobs.run_to_table(jobs.heartbeats(source(spark, path, schema), "w", "ts", 90, "10 seconds"), "h", "append", run)
    write(spark, path, [("b", T0 + dt.timedelta(minutes=30))], schema, 1)
    jobs.run_to_table(jobs.heartbeats(source(spark, path, schema), "w", "ts", 90, "10 seconds"), "h", "append", run)
    write(spark, path, [("b", T0 + dt.timedelta(minutes=31))], schema, 2)
    got = jobs.run_to_table(jobs.heartbeats(source(spark, path, schema), "w", "ts", 90, "10 seconds"), "h", "append", run)
    assert "a" in {r["w"] for r in got.collect()}
    stale = jobs.stale(jobs.last_seen(spark.createDataFrame([("a", T0), ("b", T0 + dt.timedelta(minutes=5))], schema), "w", "ts"), "w", 90)
    assert [r["w"] for r in stale.collect()] == ["a"]
