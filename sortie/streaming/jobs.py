"""Runs in flight as streams: checkpoints, staleness, first-seen events, running tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import fresh_folder

LONGEST_RUN = "72 hours"


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    """Stream over immutable segments: a growing log is shipped as new files, never re-read."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", str(per_batch))
    return reader.parquet(folder)


def complete_prefix(content: Column) -> Column:
    """Text up to and including its last newline; a partial last record goes."""
    from_end = F.instr(F.reverse(content), "\n")
    return F.when(from_end > 0, F.substring(content, F.lit(1), F.length(content) - from_end + 1)).otherwise("")


def complete_records(segments: DataFrame) -> DataFrame:
    """(…, content) to one row per complete line, in order."""
    rest = [c for c in segments.columns if c != "content"]
    whole = F.regexp_replace(complete_prefix(F.col("content")), r"\n\z", "")
    kept = segments.where(F.col("content").contains("\n"))
    return kept.select(*rest, F.posexplode(F.split(whole, "\n", -1)).alias("pos", "line"))


def tumbling(
    stream: DataFrame, interval_s: int, keys: Sequence[str], settle_s: int = fixed.SETTLE_SECONDS, time: str = "event_time"
) -> DataFrame:
    """Counts per fixed interval, given out once the settle delay has passed."""
    if not 60 <= interval_s <= 86_400:
        raise ValueError("interval must be 60 to 86400 seconds")
    w = F.window(time, f"{interval_s} seconds")
    return (
        stream.withWatermark(time, f"{settle_s} seconds").groupBy(w, *keys)
        .agg(F.count(F.lit(1)).alias("events"), F.max("elapsed_seconds").alias("as_of_seconds"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "events", "as_of_seconds")
    )


def checkpoints(
    stream: DataFrame, interval_s: int, keys: Sequence[str], settle_s: int = fixed.SETTLE_SECONDS
) -> DataFrame:
    """Checkpoint n of a run ends at its start + n·interval, whenever the run began.

    Needs event_time and started_epoch. The watermark runs on checkpoint ends,
    which lie up to one interval ahead of the events, hence the longer delay.
    """
    at = F.unix_micros("event_time") / F.lit(1e6)
    number = F.floor((at - F.col("started_epoch")) / interval_s) + 1
    ends = stream.withColumn("checkpoint", number).withColumn(
        "due", F.timestamp_seconds(F.col("started_epoch") + number * interval_s)
    )
    return (
        ends.withWatermark("due", f"{interval_s + settle_s} seconds").groupBy("due", *keys, "checkpoint")
        .agg(F.count(F.lit(1)).alias("events"), F.max("elapsed_seconds").alias("as_of_seconds"))
    )


def stale_sessions(stream: DataFrame, keys: Sequence[str], gap_s: int = fixed.STALE_SECONDS, settle_s: int = fixed.SETTLE_SECONDS) -> DataFrame:
    """A row per spell of activity, given out when the gap has passed without a sign of life."""
    return (
        stream.withWatermark("event_time", f"{settle_s} seconds")
        .groupBy(F.session_window("event_time", f"{gap_s} seconds").alias("s"), *keys)
        .agg(F.count(F.lit(1)).alias("signs"))
        .select(*keys, F.col("s.start").alias("first_sign"), F.col("s.end").alias("stale_at"), "signs")
    )


def first_seen(stream: DataFrame, keys: Sequence[str], horizon: str = LONGEST_RUN) -> DataFrame:
    """Each key once. State lives for the horizon, so it must not be shorter than a run."""
    return stream.withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def running_first_times(stream: DataFrame) -> DataFrame:
    """Earliest time per event so far, for update mode: the same table as the batch operator."""
    return stream.groupBy("tool", "tool_label", "run_id", "instance_id", "event").agg(
        F.min("elapsed_seconds").alias("elapsed_seconds")
    )


# --- running a stream to its end -----------------------------------------------------------


def drain_append(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Run an append-mode query over what is available; its result as a table.

    With ``out`` the query goes on from where an earlier one into that folder ended.
    """
    spark = df.sparkSession
    out = out or fresh_folder(spark, name)
    query = (
        df.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def drain_update(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run an update-mode query over what is available; the latest row per key."""
    spark = df.sparkSession
    out = fresh_folder(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        df.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    rows = spark.read.parquet(out)
    top = F.max_by(F.struct(*rest), F.col("_batch"))
    return rows.groupBy(*keys).agg(top.alias("_t")).select(*keys, "_t.*")


def _commits(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{target}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish_once(target: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: publish only key sets that no earlier batch has published.

    ``keys`` are all grouping columns, the checkpoint first. A batch's rows go to a
    folder of their own; then its keys are committed. Only the commit log is looked at,
    from the batch's first checkpoint on, never the published rows. A batch that dies
    before its commit leaves rows that nobody reads, and its retry writes them again;
    of two batches that commit one key at a time, `published` shows the lower attempt.
    """
    keys = list(keys)

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark, attempt = batch.sparkSession, f"{batch_id:012d}-{uuid.uuid4().hex}"
        done, fresh = _commits(spark, target), batch
        first = batch.agg(F.min(keys[0]).alias("first")).first()["first"]
        if done is not None and first is not None:
            fresh = batch.join(done.where(F.col(keys[0]) >= F.lit(first)).select(*keys).distinct(), keys, "left_anti").select(*batch.columns)
        path = f"{target}/rows/attempt={attempt}"
        fresh.write.parquet(path)
        written = spark.read.schema(batch.schema).parquet(path)
        written.select(*keys).distinct().withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{target}/commits")

    return publish


def published(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """The published rows: of each key set those of the first attempt that committed it."""
    keys = list(keys)
    rows = spark.read.parquet(f"{target}/rows")
    winners = spark.read.parquet(f"{target}/commits").groupBy(*keys).agg(F.min("attempt").alias("attempt"))
    return rows.join(winners, [*keys, "attempt"], "left_semi").drop("attempt")


# --- runs that never report ----------------------------------------------------------------


def silent_runs(
    starts: DataFrame, signs: DataFrame, keys: Sequence[str], gap_s: int = fixed.STALE_SECONDS, settle_s: int = fixed.SETTLE_SECONDS
) -> DataFrame:
    """Runs without a sign of life in the ``gap_s`` seconds after they are due, each once.

    ``starts`` has the keys and `due_at` (a run's start, or its deadline), ``signs`` the
    keys and `event_time`. A row comes when the watermark has passed the gap, so state
    is kept for a gap and the settle delay. Session windows can't see such runs: they
    have no row that opens a session.
    """
    due = starts.select(*[F.col(k).alias(f"_due_{k}") for k in keys], "due_at").withWatermark("due_at", f"{settle_s} seconds")
    alive = signs.select(*keys, "event_time").withWatermark("event_time", f"{settle_s} seconds")
    gap = F.lit(timedelta(seconds=gap_s))
    same = reduce(lambda a, b: a & b, [F.col(f"_due_{k}") == F.col(k) for k in keys])
    inside = (F.col("event_time") >= F.col("due_at")) & (F.col("event_time") <= F.col("due_at") + gap)
    silent = due.join(alive, same & inside, "left_outer").where(F.col("event_time").isNull())
    return silent.select(*[F.col(f"_due_{k}").alias(k) for k in keys], "due_at", (F.col("due_at") + gap).alias("silent_at"))
