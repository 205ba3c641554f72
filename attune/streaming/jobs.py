"""Structured Streaming forms of the log views. Every job has a batch twin with the same result on closed data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attune.storage import checkpoint_dir


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder; bounded per trigger so that a backlog does not become one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(df: DataFrame, ts: str, width: str, late: str, keys: list[str] | None = None) -> DataFrame:
    """Rows per window; windows close ``late`` after the newest event."""
    marked = df.withWatermark(ts, late) if df.isStreaming else df
    g = marked.groupBy(F.window(ts, width), *(keys or [])).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), *(keys or []), "n")


def sliding(df: DataFrame, ts: str, width: str, slide: str, late: str) -> DataFrame:
    """Rows per sliding window."""
    marked = df.withWatermark(ts, late) if df.isStreaming else df
    return marked.groupBy(F.window(ts, width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: rows less than ``gap`` apart."""
    marked = df.withWatermark(ts, late) if df.isStreaming else df
    g = marked.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), "n")


def first_by_id(df: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first row per id; state is kept for ``late`` only."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def last_seen(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The last heartbeat of every key so far (update mode)."""
    return df.groupBy(key).agg(F.max(ts).alias("last"))


def stale(last: DataFrame, key: str, seconds: int) -> DataFrame:
    """Keys whose last heartbeat (key, last) is more than ``seconds`` before the newest of all."""
    return last.join(F.broadcast(last.agg(F.max("last").alias("now")))).where(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) > seconds * 1_000_000).select(key, "last")


def heartbeats(df: DataFrame, key: str, ts: str, seconds: int, late: str) -> DataFrame:
    """Stream of (key, last) of workers without a heartbeat for ``seconds`` of event time."""
    kind = df.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last": [pd.Timestamp(last, unit="us")]})
            return
        newest = max(int(pd.Timestamp(f[ts].max()).value // 1_000) for f in frames)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1_000 + seconds * 1_000, state.getCurrentWatermarkMs() + 1))

    return df.withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, last TIMESTAMP", "last LONG", "append", "EventTimeTimeout")


def online_elo(df: DataFrame, group: str, k: float = 4.0) -> DataFrame:
    """Ratings per group after every batch (update mode): group, model, rating.

    Battles (group, a, b, result, seq) are folded in the order of ``seq`` inside a batch; batches follow one
    another, so files must arrive in order. The group is the unit of parallelism and of state.
    """
    kind = df.schema[group].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names, values = state.get if state.exists else ([], [])
        r = dict(zip(names, values, strict=True))
        rows = pd.concat(list(frames)).sort_values("seq")
        for a, b, z in zip(rows["a"], rows["b"], rows["result"], strict=True):
            x, y = r.get(a, 1000.0), r.get(b, 1000.0)
            e = 1 / (1 + 10 ** ((y - x) / 400))
            s = 1.0 if z == 1 else 0.0 if z == 2 else 0.5
            r[a], r[b] = x + k * (s - e), y + k * (1 - s - (1 - e))
        state.update((list(r), list(r.values())))
        yield pd.DataFrame({group: [key[0]] * len(r), "model": list(r), "rating": list(r.values())})

    return df.groupBy(group).applyInPandasWithState(run, f"`{group}` {kind}, model STRING, rating DOUBLE", "names ARRAY<STRING>, ratings ARRAY<DOUBLE>", "update", "NoTimeout")


def last_by_id(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest row per id so far (update mode): later batches replace earlier output of the same id."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(key, "_r.*")


def run_to_table(stream: DataFrame, name: str, mode: str, path: str | None = None) -> DataFrame:
    """Run over everything available, then stop; the result as a table in shared storage."""
    import uuid

    spark = stream.sparkSession
    root = path or f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    out = f"{root}/out"

    def save(batch: DataFrame, n: int) -> None:
        # a rerun of a batch overwrites its own folder, so the sink is idempotent
        batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/_b={n}")

    q = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.schema(_with_batch(stream)).option("recursiveFileLookup", True).parquet(out)
    return done


def _with_batch(stream: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])


def final(done: DataFrame) -> DataFrame:
    """The output of the last batch of a complete-mode run."""
    top = done.agg(F.max("_batch").alias("_top"))
    return done.join(F.broadcast(top), F.col("_batch") == F.col("_top"), "left_semi").drop("_batch")


def newest(done: DataFrame, keys: list[str]) -> DataFrame:
    """The last output per key of an update-mode run."""
    cols = [c for c in done.columns if c not in keys and c != "_batch"]
    return done.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_r")).select(*keys, "_r.*")
