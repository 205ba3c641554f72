"""Streaming queries: run to the end of the available data and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attune.plans.base import battles
from attune.plans.registry import query, table
from attune.streaming import jobs


def _events(spark, d, parts=4):
    """The events as a folder of files, read as a stream file by file; files may come in any order, so the
    queries wait longer than the data spans before a window closes."""
    from attune.plans.scalars import _round_trip

    e = table(spark, d, "events")
    holder = {}

    def write(x, path):
        holder["path"] = path
        x.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.parquet(path)

    return _round_trip(spark, e, write, lambda p: jobs.read_stream(spark, p, e.schema, 1))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stm_log_tail(spark, d):
    """Counts kept up to date over new files instead of rereading all."""
    s = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return jobs.newest(jobs.run_to_table(s, "tail", "update"), ["event_type"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def stm_hourly_tumbling(spark, d):
    s = jobs.tumbling(_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "60 days")
    return jobs.newest(jobs.run_to_table(s, "hourly", "update"), ["start"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT s AS start, count(*) AS n FROM (SELECT ts, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS s FROM events) GROUP BY 1")
def stm_sliding(spark, d):
    s = jobs.sliding(_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "24 hours", "6 hours", "60 days")
    return jobs.newest(jobs.run_to_table(s, "sliding", "update"), ["start"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stm_session(spark, d):
    """Sessions that end after an hour without an event, kept up to date by a stream."""
    s = jobs.sessions(_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "1 hour", "60 days")
    done = jobs.final(jobs.run_to_table(s, "sessions", "complete"))
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 90 SECOND")
def stm_heartbeat(spark, d):
    """Users without an event for 90 s before the end, from a stream that keeps the last event of each."""
    last = jobs.newest(jobs.run_to_table(jobs.last_seen(_events(spark, d), "user_id", "ts"), "heartbeat", "update"), ["user_id"])
    return jobs.stale(last, "user_id", 90)


@query()
def stm_online_elo(spark, d):
    """Ratings per item group, updated as battles arrive; equal to the batch fold (tests)."""
    from attune.plans.scalars import _round_trip

    b = battles(spark, d).select((F.col("idx") % 8).alias("shard"), "a", "b", "result", F.unix_micros(F.col("rated_at").cast("timestamp")).alias("seq"))
    stream = _round_trip(spark, b, lambda x, p: x.repartitionByRange(2, "seq").sortWithinPartitions("seq").write.parquet(p), lambda p: jobs.read_stream(spark, p, b.schema, 100))
    return jobs.newest(jobs.run_to_table(jobs.online_elo(stream, "shard"), "elo", "update"), ["shard", "model"])


@query("SELECT event_id, event_type, value FROM events")
def stm_dedup(spark, d):
    """The newest row per id of a stream in which every row comes twice."""
    s = _events(spark, d).select("event_id", "event_type", "value", "ts")
    twice = s.unionByName(s)
    out = jobs.newest(jobs.run_to_table(jobs.last_by_id(twice, "event_id", "ts"), "dedup", "update"), ["event_id"])
    return out.select("event_id", "event_type", "value")
