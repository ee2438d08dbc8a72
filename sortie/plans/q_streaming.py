"""Streaming queries: the events table arrives as a file stream and is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_folder
from ..sources import sinks
from ..streaming import growing, jobs
from .registry import query
from .views import base_events, table, v_events, v_lines, v_samples, with_views

ORIGIN = 1_704_067_200  # 2024-01-01


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    raw = jobs.file_stream(spark, d, schema, "events.parquet")
    k = F.get_json_object("props", "$.k")
    return raw.select(
        F.lit("r1").alias("run_id"), F.concat(F.lit("i-"), F.col("user_id").cast("string")).alias("instance_id"),
        F.col("event_type").alias("tool"), F.concat("event_type", F.lit("-v1")).alias("tool_label"), F.concat(F.lit("inv_"), k).alias("event"),
        F.col("ts").cast("timestamp").alias("event_time"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN * 1_000_000) / F.lit(1e6)).alias("elapsed_seconds"),
        F.lit(ORIGIN + 1800).cast("bigint").alias("started_epoch"),
    )


_B = "sb AS (SELECT *, 'i-' || user_id AS instance_id, event_type AS tool, (us - 1704067200000000) / 1e6 AS elapsed_seconds FROM b_events)"


@query(
    "ST2 ST3",
    with_views(
        "b_events",
        """SELECT make_timestamp(w * 21600000000) AS start, make_timestamp((w + 1) * 21600000000) AS "end", tool, events, as_of_seconds FROM (
             SELECT us // 21600000000 AS w, tool, count(*) AS events, max(elapsed_seconds) AS as_of_seconds FROM sb GROUP BY ALL)
           WHERE (w + 1) * 21600000000 <= (SELECT max(us) FROM sb) - 300000000""",
        _B,
    ),
)
def stream_windows(spark, d):
    return jobs.drain_append(jobs.tumbling(_stream(spark, d), 21600, ["tool"]), "windows")


@query(
    "ST2 ST3",
    with_views(
        "b_events",
        """SELECT make_timestamp((1704069000 + n * 14400) * 1000000) AS due, tool, n AS checkpoint, events, as_of_seconds FROM (
             SELECT CAST(floor((us / 1e6 - 1704069000) / 14400) AS BIGINT) + 1 AS n, tool, count(*) AS events, max(elapsed_seconds) AS as_of_seconds FROM sb GROUP BY ALL)
           WHERE n <= (SELECT max(CAST(floor((us / 1e6 - 1704069000) / 14400) AS BIGINT) + 1) FROM sb) - 14700 / 14400.0""",
        _B,
    ),
)
def stream_checkpoints(spark, d):
    return jobs.drain_append(jobs.checkpoints(_stream(spark, d), 14400, ["tool"]), "checkpoints")


@query(
    "ST7",
    with_views(
        "b_events",
        """SELECT instance_id, make_timestamp(min(us)) AS first_sign, make_timestamp(max(us) + 28800000000) AS stale_at, count(*) AS signs FROM (
             SELECT *, sum(CASE WHEN us - p < 28800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY instance_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g
             FROM (SELECT *, lag(us) OVER (PARTITION BY instance_id ORDER BY us) AS p FROM sb)) GROUP BY instance_id, g
           HAVING max(us) + 28800000000 <= (SELECT max(us) FROM sb) - 300000000""",
        _B,
    ),
)
def stream_staleness(spark, d):
    return jobs.drain_append(jobs.stale_sessions(_stream(spark, d), ["instance_id"], 28800), "sessions")


@query("ST8", with_views("b_events", "SELECT DISTINCT 'r1' AS run_id, instance_id, tool, 'inv_' || k AS event FROM sb", _B))
def stream_first_seen(spark, d):
    return jobs.drain_append(jobs.first_seen(_stream(spark, d), ["run_id", "instance_id", "tool", "event"], "40 days"), "first-seen")


@query("ST9", with_views("b_events", "SELECT tool, tool || '-v1' AS tool_label, 'r1' AS run_id, instance_id, 'inv_' || k AS event, min(elapsed_seconds) AS elapsed_seconds FROM sb GROUP BY ALL", _B))
def stream_first_times(spark, d):
    keys = ["tool", "tool_label", "run_id", "instance_id", "event"]
    return jobs.drain_update(jobs.running_first_times(_stream(spark, d)), "running", keys)


_WINDOWS = """SELECT make_timestamp(w * 21600000000) AS start, make_timestamp((w + 1) * 21600000000) AS "end", tool, events, as_of_seconds FROM (
             SELECT us // 21600000000 AS w, tool, count(*) AS events, max(elapsed_seconds) AS as_of_seconds FROM sb GROUP BY ALL)
           WHERE (w + 1) * 21600000000 <= (SELECT max(us) FROM sb) - 300000000"""


@query("ST4", with_views("b_events", _WINDOWS, _B))
def published_once(spark, d):
    """The closed windows of some tools, then all of them, then all again: the target shows each once."""
    target, keys = fresh_folder(spark, "published"), ["start", "tool"]
    closed = jobs.drain_append(jobs.tumbling(_stream(spark, d), 21600, ["tool"]), "windows")
    publish = jobs.publish_once(target, keys)
    publish(closed.where(F.col("tool") < "error"), 0)
    publish(closed, 1)
    publish(closed, 2)
    return jobs.published(spark, target, keys)


_DUE = """due AS (SELECT 'i-' || o_custkey AS instance_id, 1704067200000000 + (o_orderkey * 613) % 2592000 * 1000000 + 500 AS us FROM orders)"""


@query(
    "ST7 R6",
    with_views(
        "b_events",
        """SELECT instance_id, make_timestamp(us) AS due_at, make_timestamp(us + 28800000000) AS silent_at FROM due d
           WHERE us + 28800000000 < least((SELECT max(us) FROM due), (SELECT max(us) FROM sb)) - 300000000
             AND NOT EXISTS (SELECT 1 FROM sb WHERE sb.instance_id = d.instance_id AND sb.us BETWEEN d.us AND d.us + 28800000000)""",
        _B + ", " + _DUE,
    ),
)
def stream_silent_runs(spark, d):
    """Orders play run starts of an instance; an instance without an event in the eight hours after is silent."""
    orders = jobs.file_stream(spark, d, table(spark, d, "orders").schema, "orders.parquet")
    second = F.lit(ORIGIN) + F.col("o_orderkey") * 613 % 2_592_000
    starts = orders.select(F.concat(F.lit("i-"), F.col("o_custkey").cast("string")).alias("instance_id"), F.timestamp_micros(second * 1_000_000 + 500).alias("due_at"))
    return jobs.drain_append(jobs.silent_runs(starts, _stream(spark, d), ["instance_id"], 28800), "silent")


@query(
    "ST1",
    """SELECT doc_id, CAST(length(text) - CASE WHEN contains(text, chr(10)) THEN instr(reverse(text), chr(10)) - 1 ELSE length(text) END AS BIGINT) AS kept_chars,
         right(text, 1) <> chr(10) AS partial_removed FROM documents""",
)
def complete_prefixes(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", F.length(jobs.complete_prefix(F.col("text"))).cast("bigint").alias("kept_chars"), (~F.col("text").endswith("\n")).alias("partial_removed")
    )


@query(
    "ST1 S1",
    """SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos, len(string_split(text, chr(10))) AS n FROM documents) WHERE pos < n - 1""",
)
def complete_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return jobs.complete_records(docs)


@query(
    "A36",
    with_views(
        "v_events v_samples",
        """SELECT run_id, 'events' AS counter, count(*) AS rows FROM v_events GROUP BY run_id UNION ALL SELECT run_id, 'samples', count(*) FROM v_samples GROUP BY run_id
           UNION ALL SELECT run_id, 'log_files', count(DISTINCT (instance_id, tool)) FROM v_events GROUP BY run_id UNION ALL SELECT 'r1', 'selectors', count(DISTINCT md5(event)) FROM v_events""",
    ),
)
def run_counters(spark, d):
    ev = v_events(spark, d)
    logs = v_lines(spark, d).select("run_id", "log_path").distinct()
    calls = ev.select("run_id", F.md5("event").alias("selector")).distinct()
    return sinks.run_counters(events=ev, samples=v_samples(spark, d), log_files=logs, selectors=calls)


@query("S11", with_views("b_events", "SELECT event_type AS tool, event, count(*) AS rows FROM b_events GROUP BY ALL"))
def written_table(spark, d):
    """Counts written per tool as partitions and read back."""
    path = fresh_folder(spark, "table")
    counts = base_events(spark, d).groupBy(F.col("event_type").alias("tool"), "event").agg(F.count(F.lit(1)).alias("rows"))
    sinks.write_table(counts, path, ("tool",))
    return spark.read.parquet(path)


_ROUNDS = 3


def _round_of(us):
    """Thirds of the month: when a line is written."""
    return F.least(F.greatest(F.floor((us / F.lit(1e6) - ORIGIN) / 864_000), F.lit(0)), F.lit(_ROUNDS - 1))


def _append_round(spark, d, root: str, number: int) -> None:
    """Appends a round's lines to each instance's log; each round ends inside a line that the next one completes."""
    lines = v_lines(spark, d).select("log_path", F.concat_ws(" ", "stamp", "event", F.col("event_id").cast("string")).alias("line"), "pos", _round_of(F.col("us")).alias("round"))
    ends = lines.select("log_path").distinct().select("log_path", F.lit(None).cast("string").alias("line"), F.lit(None).cast(lines.schema["pos"].dataType).alias("pos"))
    due = lines.where(F.col("round") == number).select("log_path", "line", "pos").unionByName(ends)
    dealt = due.repartition("log_path").sortWithinPartitions("log_path", F.col("pos").asc_nulls_last()).select("log_path", "line")
    growing.append_lines(dealt, root, first=f"round {number} begins\n" if number else "", last="before ")


@query(
    "S1 ST1",
    with_views(
        "v_events",
        """SELECT instance_id, tool, line, count(*) AS copies FROM (
             SELECT instance_id, tool, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') || ' ' || event || ' ' || event_id AS line FROM v_events
             UNION ALL SELECT instance_id, tool, 'before round ' || r || ' begins' FROM (SELECT DISTINCT instance_id, tool FROM v_events), (SELECT unnest([1, 2]) AS r))
           GROUP BY ALL""",
    ),
)
def growing_log_lines(spark, d):
    """Logs written in three rounds, read between them; each round leaves a line unfinished, the last one for good."""
    root = fresh_folder(spark, "growing")
    for number in range(_ROUNDS):
        _append_round(spark, d, root, number)
        seen = jobs.drain_append(growing.growing_lines(spark, root, "r1", listings=f"{root}-listings"), "growing-lines", f"{root}-seen")
    instance = F.substring_index("log_path", "/", 1).alias("instance_id")
    return seen.groupBy(instance, F.regexp_extract("log_path", r"([a-z]+)\.log$", 1).alias("tool"), "line").agg(F.count(F.lit(1)).alias("copies"))
