"""Round trips: logs written from the events table, read back by the extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads, scalars as S
from ..operators import extract, signals
from ..operators.ordered import scan
from ..session import fresh_folder
from ..sources.logs import tails
from ..streaming import jobs, reconcile
from .registry import ENTRIES, query
from .views import table, v_events, v_lines, with_views

_OUT = ("instance_id", "tool", "event", "elapsed_seconds", "source")
_DAY0 = 1_704_067_200  # epoch seconds of the first day of the events table


def _as_lines(spark, d, line, tool=None):
    rows = v_lines(spark, d).withColumn("sec", F.floor(F.col("us") / 1_000_000) - _DAY0).withColumn("line", line)
    if tool is not None:
        rows = rows.withColumn("tool", F.lit(tool))
    return rows.select(*extract.FILE, *extract.ORDER, "line")


def _kind(n):
    return F.col("k") % n


_W = "WINDOW w AS (PARTITION BY instance_id, tool ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "L2",
    with_views(
        "v_events",
        """SELECT instance_id, tool, event, min(us / 1e6 - t0 / 1e6) AS elapsed_seconds, 'falsified' AS source
           FROM (SELECT *, min(us) OVER (PARTITION BY instance_id, tool) AS t0 FROM v_events) GROUP BY ALL""",
    ),
)
def falsified_round_trip(spark, d):
    line = F.concat(F.lit("["), F.col("stamp"), F.lit("] Test "), F.col("event"), F.lit(" falsified!"))
    return extract.timestamp_events(_as_lines(spark, d, line), bang=False).select(*_OUT)


@query(
    "L2 P12 P13",
    with_views(
        "v_events",
        """SELECT instance_id, tool, name AS event, arg_min(t1 / 1e6 - t0 / 1e6, us::HUGEINT * 1000000 + event_id) AS elapsed_seconds, arg_min(src, us::HUGEINT * 1000000 + event_id) AS source
           FROM ln WHERE name IS NOT NULL AND t1 IS NOT NULL GROUP BY ALL""",
        f"""ln AS (SELECT *, max(CASE WHEN k % 5 <> 2 THEN us END) OVER w AS t1, min(CASE WHEN k % 5 <> 2 THEN us END) OVER w AS t0,
          CASE WHEN k % 5 = 4 THEN 'assertion_failed' WHEN k % 5 <> 3 THEN event END AS name,
          CASE k % 5 WHEN 0 THEN 'falsified' WHEN 1 THEN 'bang' WHEN 2 THEN 'failed' ELSE 'panic' END AS src FROM v_events {_W})""",
    ),
)
def text_log_round_trip(spark, d):
    stamp = F.concat(F.lit("["), F.col("stamp"), F.lit("] "))
    line = (
        F.when(_kind(5) == 0, F.concat(F.lit("\x1b[31m"), stamp, F.lit("Test "), F.col("event"), F.lit(" falsified!\x1b[0m")))
        .when(_kind(5) == 1, F.concat(stamp, F.lit("worker !!! "), F.col("event"), F.lit(") and more")))
        .when(_kind(5) == 2, F.concat(F.col("event"), F.lit("(uint256,address): failed!")))
        .when(_kind(5) == 3, F.concat(stamp, F.lit("status: fine")))
        .otherwise(F.concat(stamp, F.lit("panic: assertion failed")))
    )
    return extract.timestamp_events(_as_lines(spark, d, line), failed=True).select(*_OUT)


_HMS = "((us // 1000000) - 1704067200)"


@query(
    "L3 P1",
    with_views(
        "v_events",
        """SELECT instance_id, tool, name AS event, CAST(arg_min(now, us::HUGEINT * 1000000 + event_id) AS DOUBLE) AS elapsed_seconds, arg_min(src, us::HUGEINT * 1000000 + event_id) AS source
           FROM (SELECT *, CASE k % 4 WHEN 1 THEN known WHEN 2 THEN coalesce(known, event) WHEN 3 THEN known END AS name,
             CASE k % 4 WHEN 1 THEN 'medusa-failed' WHEN 2 THEN 'medusa-bang' ELSE 'medusa-panic' END AS src FROM ln) WHERE name IS NOT NULL AND now IS NOT NULL GROUP BY ALL""",
        f"""ln AS (SELECT *, max(CASE WHEN k % 4 = 0 THEN {_HMS} END) OVER w AS now,
          last_value(CASE WHEN k % 4 = 1 THEN 'Suite.' || event || '(uint256)' END IGNORE NULLS) OVER w AS known FROM v_events {_W})""",
    ),
)
def elapsed_log_round_trip(spark, d):
    s = F.col("sec")
    clock = F.concat(
        F.lit("fuzz: elapsed: "), F.floor(s / 3600).cast("string"), F.lit("h"), (F.floor(s / 60) % 60).cast("string"),
        F.lit("m"), (s % 60).cast("string"), F.lit("s, calls: 1"),
    )
    line = (
        F.when(_kind(4) == 0, clock)
        .when(_kind(4) == 1, F.concat(F.lit("> [FAILED] Assertion Test: Suite."), F.col("event"), F.lit("(uint256)")))
        .when(_kind(4) == 2, F.concat(F.lit("trace !!! "), F.col("event"), F.lit("\" rest")))
        .otherwise(F.lit("panic: assertion failed"))
    )
    return extract.elapsed_events(_as_lines(spark, d, line)).select(*_OUT)


def _json_line():
    ts = F.concat(F.lit('{"timestamp": '), (F.col("sec") + _DAY0).cast("string"))
    e = F.col("event")
    return (
        F.when(_kind(6) == 0, F.concat(ts, F.lit(', "event": "failure", "target": "T", "invariant": "Ctr:'), e, F.lit('"}')))
        .when(_kind(6) == 1, F.concat(ts, F.lit(', "event": "failure", "failure_type": "handler_assertion", "selector": "0xF24A44C9"}')))
        .when(
            _kind(6) == 2,
            F.concat(
                ts, F.lit(', "metrics": {"unique_failures": '), F.floor(F.col("sec") / 172800).cast("string"),
                F.lit(', "broken_assertions": '), (F.col("k") % 4).cast("string"), F.lit("}}"),
            ),
        )
        .when(_kind(6) == 3, F.concat(F.lit("[FAIL: assertion failed] src/a.sol:Ctr::late_"), e))
        .when(_kind(6) == 4, F.concat(F.lit("[FAIL: reverted] "), e, F.lit("() (runs: 1)")))
        .otherwise(F.concat(ts, F.lit(', "type": "invariant_failure", "invariant": "'), e, F.lit('"}')))
    )


_JSON = f"""ln AS (SELECT *, {_HMS} AS sec, k % 6 AS g, CASE k % 6 WHEN 1 THEN 'assert_canary_ASSERTION_CANARY' WHEN 2 THEN NULL WHEN 3 THEN 'late_' || event ELSE event END AS name,
    CASE k % 6 WHEN 0 THEN 'foundry-failure-event' WHEN 1 THEN 'foundry-handler-selector' WHEN 3 THEN 'foundry-handler-summary' WHEN 4 THEN 'foundry-text-failure' WHEN 5 THEN 'foundry-invariant-failure' END AS src,
    CASE WHEN k % 6 = 2 THEN {_HMS} // 172800 + k % 4 END AS expected FROM v_events),
  tm AS (SELECT *, coalesce(max(CASE WHEN g NOT IN (3, 4) THEN sec END) OVER w - min(CASE WHEN g NOT IN (3, 4) THEN sec END) OVER w, 0) AS els FROM ln {_W}),
  nm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, tool, name ORDER BY us, event_id) AS occ FROM tm) WHERE (name IS NOT NULL AND occ = 1) OR expected IS NOT NULL),
  n1 AS (SELECT *, count(name) OVER w AS n FROM nm {_W}),
  n2 AS (SELECT *, greatest(coalesce(max(expected - n) OVER w, 0), 0) AS s, count(*) FILTER (g = 3) OVER w AS i FROM n1 {_W}),
  n3 AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY instance_id, tool ORDER BY us, event_id), 0) AS sb FROM n2),
  an AS (SELECT instance_id, tool, els, unnest(range(sb + 1, s + 1)) AS number FROM n3 WHERE expected IS NOT NULL AND s > sb),
  lt AS (SELECT *, i + least(0, min(sb - i) OVER w) AS m FROM n3 WHERE g = 3 {_W}),
  lm AS (SELECT *, CASE WHEN m > coalesce(lag(m) OVER (PARTITION BY instance_id, tool ORDER BY us, event_id), 0) THEN m END AS number FROM lt)"""


@query(
    "L4 L5 L6 L7 P14",
    with_views(
        "v_events",
        """SELECT instance_id, tool, name AS event, CAST(els AS DOUBLE) AS elapsed_seconds, src AS source FROM nm WHERE name IS NOT NULL AND g <> 3
           UNION ALL SELECT coalesce(an.instance_id, lm.instance_id), coalesce(an.tool, lm.tool), coalesce(lm.name, 'foundry_handler_bug_' || an.number), CAST(coalesce(an.els, lm.els) AS DOUBLE),
             CASE WHEN lm.name IS NULL THEN 'foundry-broken-handler-metric' ELSE 'foundry-handler-summary' END
             FROM an FULL JOIN (SELECT * FROM lm WHERE number IS NOT NULL) lm ON an.instance_id = lm.instance_id AND an.tool = lm.tool AND an.number = lm.number
           UNION ALL SELECT instance_id, tool, name, CAST(els AS DOUBLE), 'foundry-handler-summary' FROM lm WHERE number IS NULL""",
        _JSON,
    ),
)
def json_log_round_trip(spark, d):
    return extract.json_events(_as_lines(spark, d, _json_line())).select(*_OUT)


@query("L5 L6 ST8", ENTRIES["json_log_round_trip"].sql)
def live_reconciliation(spark, d):
    """The same logs as they grow: three parts of the month arrive one after the other, in a stream with state."""
    folder, out = fresh_folder(spark, "live-lines"), fresh_folder(spark, "live-updates")
    # places that sort as text, whole numbers padded
    place = F.concat(*[F.lpad(F.col(f"pos.{c}").cast("string"), 20, "0") for c in ("a", "b")])
    lines = _as_lines(spark, d, _json_line()).withColumn("pos", place)
    days = F.col("block") - _DAY0 // 86_400
    schema = lines.schema
    for low, high in ((-10_000, 9), (9, 17), (17, 10_000)):
        lines.where((days >= low) & (days < high)).write.mode("append").parquet(folder)
        updates = jobs.drain_append(reconcile.live_failures(jobs.file_stream(spark, folder, schema)), "live", out)
    return reconcile.settled(updates).select(*_OUT)



@query("L1")
def dispatched_events(spark, d):
    """Every parser at once: logs of five tool families in one table."""
    names = {"view": "foundry", "click": "medusa", "error": "echidna", "purchase": "recon-fuzzer"}
    stamp = F.concat(F.lit("["), F.col("stamp"), F.lit("] "))
    falsified = F.concat(stamp, F.lit("Test "), F.col("event"), F.lit(" falsified!"))
    medusa = F.when(_kind(2) == 0, F.concat(F.lit("elapsed: "), F.col("sec").cast("string"), F.lit("s"))).otherwise(
        F.concat(F.lit("[FAILED] Property Test: "), F.col("event"))
    )
    line = F.when(F.col("tool") == "view", _json_line()).when(F.col("tool") == "click", medusa).otherwise(falsified)
    rows = _as_lines(spark, d, line)
    tool = F.col("tool")
    renamed = F.coalesce(*[F.when(tool == a, F.lit(b)) for a, b in names.items()], tool)
    return extract.extract_events(rows.withColumn("tool", renamed)).select(*_OUT)


@query(
    "L8",
    with_views(
        "v_events",
        """SELECT instance_id, tool, CAST(e AS DOUBLE) AS elapsed_seconds, tx AS tx_per_second, round(gas, 6) AS gas_per_second, CASE WHEN tx IS NOT NULL THEN 'json-rate' ELSE 'json-cumulative' END AS source FROM (
             SELECT *, lag((e, round(tx, 12), round(gas, 12))) OVER (PARTITION BY instance_id, tool ORDER BY us, event_id) AS p FROM (
               SELECT *, CASE WHEN k % 3 <> 0 THEN value END AS tx, CASE WHEN e > 0 THEN k * 1000 / e END AS gas FROM (
                 SELECT *, us // 1000000 - min(us // 1000000) OVER (PARTITION BY instance_id, tool) AS e FROM v_events)) WHERE tx IS NOT NULL OR gas IS NOT NULL)
           WHERE p IS NULL OR p IS DISTINCT FROM (e, round(tx, 12), round(gas, 12))""",
    ),
)
def json_throughput(spark, d):
    rate = F.when(_kind(3) != 0, F.concat(F.lit('"tps": '), F.col("value").cast("string"))).otherwise(F.lit('"note": "x"'))
    line = F.concat(
        F.lit('{"timestamp": '), (F.col("sec") + _DAY0).cast("string"), F.lit(', "metrics": {'), rate,
        F.lit('}, "total_gas": '), (F.col("k") * 1000).cast("string"), F.lit("}"),
    )
    out = signals.throughput_samples(_as_lines(spark, d, line))
    return out.select("instance_id", "tool", "elapsed_seconds", "tx_per_second", F.round("gas_per_second", 6).alias("gas_per_second"), "source")


@query(
    "L8 P2",
    with_views(
        "v_events",
        """SELECT instance_id, tool, round(e, 6) AS elapsed_seconds, round(tx, 6) AS tx_per_second, gas AS gas_per_second, CASE WHEN tx IS NULL THEN 'text-rate' ELSE 'text-interval' END AS source FROM (
             SELECT *, CASE WHEN e > pe THEN (event_id - pn) / (e - pe) END AS tx, CAST(k AS DOUBLE) AS gas FROM (
               SELECT *, lag(e) OVER v AS pe, lag(event_id) OVER v AS pn FROM (
                 SELECT *, us / 1e6 - min(us) OVER (PARTITION BY instance_id, tool) / 1e6 AS e FROM v_events) WINDOW v AS (PARTITION BY instance_id, tool ORDER BY us, event_id)))""",
    ),
)
def text_throughput(spark, d):
    line = F.concat(
        F.lit("["), F.col("stamp"), F.lit("] [status] tests: 4/14, fuzzing: "), F.col("event_id").cast("string"),
        F.lit("/99999999, corpus: 9, gas/s: "), F.col("k").cast("string"),
    )
    out = signals.throughput_samples(_as_lines(spark, d, line))
    return out.select(
        "instance_id", "tool", F.round("elapsed_seconds", 6).alias("elapsed_seconds"),
        F.round("tx_per_second", 6).alias("tx_per_second"), "gas_per_second", "source",
    )


@query(
    "L9 P6 P7 P10 P11",
    with_views(
        "v_events",
        f"""SELECT instance_id, tool, CAST(e AS DOUBLE) AS elapsed_seconds, CAST(k AS DOUBLE) AS seq_per_second, CAST(event_id % 90 AS DOUBLE) AS coverage_proxy, CAST(user_id AS DOUBLE) AS corpus_size,
             CASE WHEN j THEN CAST(k + 1 AS DOUBLE) END AS favored_items, k / 200.0::DOUBLE AS failure_rate, CASE WHEN j THEN 'json-metrics:cov' ELSE 'text-metrics:cov' END AS source FROM (
             SELECT *, lag((e, event_id % 90, k, j)) OVER (PARTITION BY instance_id, tool0 ORDER BY us, event_id) AS p FROM (
               SELECT *, CASE WHEN j THEN {_HMS} - min(CASE WHEN j THEN {_HMS} END) OVER (PARTITION BY instance_id, tool0) ELSE {_HMS} END AS e FROM (
                 SELECT * REPLACE ('echidna' AS tool), tool AS tool0, k % 2 = 0 AS j FROM v_events)))
           WHERE p IS NULL OR p IS DISTINCT FROM (e, event_id % 90, k, j)""",
    ),
)
def progress_metrics(spark, d):
    k, cov, size = F.col("k").cast("string"), (F.col("event_id") % 90).cast("string"), F.col("user_id").cast("string")
    text = F.concat(
        F.lit("fuzz: elapsed: "), F.col("sec").cast("string"), F.lit("s, seq/s: "), k, F.lit(", cov: "), cov,
        F.lit(", corpus: "), size, F.lit(", failures: "), k, F.lit("/200"),
    )
    payload = F.concat(
        F.lit('{"timestamp": '), (F.col("sec") + _DAY0).cast("string"), F.lit(', "worker": {"Seq per second": '), k,
        F.lit(', "cov": '), cov, F.lit(', "corpus-count": "'), size, F.lit('", "favored_items": '), (F.col("k") + 1).cast("string"),
        F.lit('}, "failed_current": '), k, F.lit(', "failed_total": 200, "list": [1, 2], "flag": true}'),
    )
    line = F.when(_kind(2) == 0, payload).otherwise(text)
    out = signals.progress_samples(_as_lines(spark, d, line, "echidna"), coverage=True)
    return out.select("instance_id", "tool", "elapsed_seconds", *signals.PROGRESS, "source")


@query(
    "W3",
    with_views(
        "v_events",
        f"""SELECT event_id, first_value(CASE WHEN k % 3 = 0 THEN k END IGNORE NULLS) OVER w AS first_k, last_value(CASE WHEN k % 3 = 0 THEN k END IGNORE NULLS) OVER w AS last_k,
            lag(value) OVER (PARTITION BY instance_id, tool ORDER BY us, event_id) AS prev_value, max(value) OVER w AS peak, count(*) FILTER (k % 7 = 0) OVER w AS sevens FROM v_events {_W}""",
    ),
)
def carried_values(spark, d):
    third = F.when(F.col("k") % 3 == 0, F.col("k"))
    out = scan(
        v_events(spark, d).withColumn("day", F.floor(F.col("us") / 86_400_000_000)),
        ["instance_id", "tool"],
        ["us", "event_id"],
        {
            "first_k": ("first", third), "last_k": ("last", third), "prev_value": ("prev", F.col("value")),
            "peak": ("max", F.col("value")), "sevens": ("sum", (F.col("k") % 7 == 0).cast("bigint")),
        },
        "day",
    )
    return out.select("event_id", "first_k", "last_k", "prev_value", "peak", "sevens")


@query(
    "P7 P6",
    with_views("b_events", "SELECT event_id, CAST(k AS DOUBLE) AS k, 'k' AS key FROM b_events"),
)
def flat_payload(spark, d):
    ev = table(spark, d, "events").withColumn("m", payloads.flatten_numbers("props"))
    return ev.select("event_id", S.pick_metric(F.col("m"), ["missing", "k"]).alias("k"), F.col("m")[0]["key"].alias("key"))


_TAIL = """ln AS (SELECT doc_id, line, pos, count(*) OVER (PARTITION BY doc_id) AS lines, CAST(sum(length(line)) OVER (PARTITION BY doc_id) AS BIGINT) AS chars FROM
   (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))"""


@query("S13", with_views("", "SELECT doc_id, CAST(lines - pos AS INTEGER) AS from_end, line, lines, chars FROM ln WHERE lines - pos <= 3", _TAIL))
def last_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return tails(docs.withColumn("block", F.floor(F.col("pos") / 1000)), 3, ["doc_id"])
