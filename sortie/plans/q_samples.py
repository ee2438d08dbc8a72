"""Queries on metric samples and host metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curves, samples as O
from .registry import query
from .views import HORIZON_HOURS, STEP_MIN, table, v_events, v_samples, with_views

_VALUES = ("tx_per_second", "gas_per_second")


def _hours(spark, d):
    return v_samples(spark, d).withColumn("time_hours", F.col("elapsed_seconds") / 3600.0)


def _q(col, name):
    return ", ".join(f"round(quantile_cont({col}, {q}), 6) AS {name}_p{int(q * 100)}" for q in (0.25, 0.5, 0.75))


def _round6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(
    "A4 A5 V2",
    with_views(
        "v_samples",
        f"""SELECT tool, count(*) AS runs, count(tx) AS tx_per_second_n, {_q('tx', 'tx_per_second')}, count(gas) AS gas_per_second_n, {_q('gas', 'gas_per_second')}
        FROM (SELECT tool, run_id, instance_id, arg_max(tx_per_second, elapsed_seconds) FILTER (tx_per_second IS NOT NULL) AS tx,
              arg_max(gas_per_second, elapsed_seconds) FILTER (gas_per_second IS NOT NULL) AS gas FROM v_samples GROUP BY ALL) GROUP BY tool""",
    ),
)
def latest_metrics(spark, d):
    return _round6(O.latest_summary(v_samples(spark, d), _VALUES, "event_id"))


_METRIC_GRID = """mgrid AS (SELECT s.tool, s.run_id, s.instance_id, s.step_no, s.time_hours, c.v FROM
      (SELECT tool, run_id, instance_id, CAST(i AS INTEGER) AS step_no, i * CAST(6.0 AS DOUBLE) AS time_hours
       FROM (SELECT DISTINCT tool, run_id, instance_id FROM v_samples WHERE gas_per_second IS NOT NULL), range(121) r(i)) s
    ASOF LEFT JOIN (SELECT tool, run_id, instance_id, elapsed_seconds / 3600.0 AS time_hours, avg(gas_per_second) AS v
       FROM v_samples WHERE gas_per_second IS NOT NULL GROUP BY ALL) c
      ON s.tool = c.tool AND s.run_id = c.run_id AND s.instance_id = c.instance_id AND s.time_hours >= c.time_hours)"""


@query("J6", with_views("v_samples", "SELECT tool, run_id, instance_id, step_no, time_hours, v AS gas_per_second FROM mgrid", _METRIC_GRID))
def metric_grid(spark, d):
    return curves.to_grid(_hours(spark, d), curves.REPLICATE, "gas_per_second", HORIZON_HOURS, STEP_MIN, "mean", before=None)


@query(
    "A13",
    with_views(
        "v_samples",
        """SELECT tool, step_no, time_hours, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75
           FROM mgrid WHERE v IS NOT NULL GROUP BY ALL""",
        _METRIC_GRID,
    ),
)
def metric_bands(spark, d):
    grid = curves.to_grid(_hours(spark, d), curves.REPLICATE, "gas_per_second", HORIZON_HOURS, STEP_MIN, "mean", before=None)
    return _round6(O.metric_bands(grid, "gas_per_second"))


@query(
    "V3 J6",
    with_views(
        "v_samples",
        """SELECT s.tool, s.run_id, s.instance_id, s.step_no, s.time_hours, CASE WHEN s.time_hours <= s.last_h THEN c.v END AS coverage_proxy FROM
             (SELECT tool, run_id, instance_id, last_h, CAST(i AS INTEGER) AS step_no, i * CAST(6.0 AS DOUBLE) AS time_hours
              FROM (SELECT tool, run_id, instance_id, max(time_hours) AS last_h FROM obs GROUP BY ALL HAVING count(DISTINCT time_hours) >= 2), range(121) r(i)) s
           ASOF LEFT JOIN (SELECT tool, run_id, instance_id, time_hours, arg_max(coverage_proxy, event_id) AS v FROM obs GROUP BY ALL) c
             ON s.tool = c.tool AND s.run_id = c.run_id AND s.instance_id = c.instance_id AND s.time_hours >= c.time_hours""",
        "obs AS (SELECT *, elapsed_seconds / 3600.0 AS time_hours FROM v_samples WHERE coverage_proxy IS NOT NULL)",
    ),
)
def coverage_series(spark, d):
    rows = O.observed_series(_hours(spark, d))
    return curves.to_grid(
        rows, curves.REPLICATE, "coverage_proxy", HORIZON_HOURS, STEP_MIN, "last", before=None, extend=False, tie=["event_id"]
    )


@query(
    "A20 V3",
    with_views(
        "v_samples",
        """SELECT t.tool, expected_runs, coalesce(runs_with_signal, 0) AS runs_with_signal, coalesce(runs_with_series, 0) AS runs_with_series,
             coalesce(samples, 0) AS samples, first_min_hours, first_max_hours, last_min_hours, last_max_hours, coalesce(distinct_sources, 0) AS distinct_sources,
             CASE WHEN coalesce(runs_with_signal, 0) = 0 THEN 'unavailable' WHEN t.tool = 'signup' THEN 'end-only'
               WHEN runs_with_signal < expected_runs OR runs_with_series < runs_with_signal OR last_min_hours < 0.9 * 720 THEN 'partial' ELSE 'live' END AS state
           FROM (SELECT tool, count(DISTINCT instance_id) AS expected_runs FROM v_samples GROUP BY tool) t LEFT JOIN
             (SELECT tool, count(*) AS runs_with_signal, count(*) FILTER (nt >= 2) AS runs_with_series, CAST(sum(n) AS BIGINT) AS samples, min(a) AS first_min_hours, max(a) AS first_max_hours,
                min(b) AS last_min_hours, max(b) AS last_max_hours FROM (SELECT tool, run_id, instance_id, count(*) AS n, count(DISTINCT elapsed_seconds) AS nt,
                  min(elapsed_seconds / 3600.0) AS a, max(elapsed_seconds / 3600.0) AS b FROM ok GROUP BY ALL) GROUP BY tool) m ON t.tool = m.tool
           LEFT JOIN (SELECT tool, count(DISTINCT source) AS distinct_sources FROM ok GROUP BY tool) s ON t.tool = s.tool""",
        "ok AS (SELECT * FROM v_samples WHERE coverage_proxy IS NOT NULL AND tool <> 'error')",
    ),
)
def coverage_availability(spark, d):
    rows = _hours(spark, d)
    expected = rows.groupBy("tool").agg(F.count_distinct("instance_id").alias("expected_runs"))
    muted = rows.withColumn("coverage_proxy", F.when(F.col("tool") == "error", F.lit(float("nan"))).otherwise(F.col("coverage_proxy")))
    return O.availability(muted, expected, budget_hours=HORIZON_HOURS, is_series=F.col("tool") != "signup")


@query(
    "A21",
    with_views(
        "v_events",
        """SELECT tool, final_found, last_activity_hours, instances,
             CASE WHEN last_activity_hours IS NULL AND final_found = 0 THEN 'never executed' ELSE 'terminated early' END AS problem FROM (
           SELECT f.tool, f.final_found, a.last_activity_hours, a.instances FROM
             (SELECT tool, max(CASE WHEN tool IN ('view', 'click') THEN 0 ELSE k END) AS final_found FROM v_events GROUP BY tool) f LEFT JOIN
             (SELECT tool, max(elapsed_seconds / 3600.0) AS last_activity_hours, count(DISTINCT instance_id) AS instances
              FROM v_events WHERE tool NOT IN ('view', 'error') AND (tool <> 'purchase' OR elapsed_seconds < 864000) GROUP BY tool) a ON f.tool = a.tool)
           WHERE (last_activity_hours IS NULL AND final_found = 0) OR last_activity_hours < 360""",
    ),
)
def run_health(spark, d):
    ev = v_events(spark, d).withColumn("time_hours", F.col("elapsed_seconds") / 3600.0)
    curve = ev.select("tool", F.when(F.col("tool").isin("view", "click"), 0).otherwise(F.col("k")).alias("found"))
    activity = ev.where(~F.col("tool").isin("view", "error") & ((F.col("tool") != "purchase") | (F.col("elapsed_seconds") < 864000)))
    return O.run_health(curve, activity, HORIZON_HOURS)


@query(
    "P33",
    with_views(
        "v_events",
        "SELECT budget_hours, min(n) < 10 OR budget_hours < 24 AS is_trial FROM (SELECT tool, count(DISTINCT instance_id) AS n FROM v_events GROUP BY tool), (SELECT unnest([12.0::DOUBLE, 24.0, 720.0]) AS budget_hours) GROUP BY budget_hours",
    ),
)
def trial_flag(spark, d):
    runs = v_events(spark, d).select("tool", "instance_id").distinct().groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    fewest = runs.agg(F.min("n").alias("n"))
    return fewest.select("n", F.explode(F.array(*[F.lit(h) for h in (12.0, 24.0, 720.0)])).alias("budget_hours")).select(
        "budget_hours", S.is_trial(F.col("budget_hours"), F.col("n")).alias("is_trial")
    )


@query(
    "P29",
    with_views("v_events", "SELECT tool, 'Fuzzer ' || chr(CAST(64 + row_number() OVER (ORDER BY tool) AS INTEGER)) AS alias FROM (SELECT DISTINCT tool FROM v_events)"),
)
def anonymous_tools(spark, d):
    return O.series_positions(v_events(spark, d), ["tool"])


# --- host metrics -----------------------------------------------------------------------


def _raw_host(spark, d):
    """Host samples per machine: one row in seven has no valid timestamp."""
    ev = v_events(spark, d)
    good = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return ev.select(
        "run_id", "instance_id", F.concat("instance_id", F.lit("-"), "tool_label").alias("instance_label"), "tool", "tool_label",
        F.col("instance_id").alias("metrics_path"),
        F.floor(F.col("us") / 86_400_000_000).alias("day"),
        "us", "event_id",
        F.when(F.col("event_id") % 7 == 0, F.lit("bad")).otherwise(good).alias("timestamp"),
        (F.col("us") / 1e6).cast("string").alias("uptime_seconds"),
        F.col("value").cast("string").alias("cpu_user_pct"),
        (F.col("k") / 10.0).cast("string").alias("cpu_system_pct"),
        F.when(F.col("k") % 4 == 0, F.lit("")).otherwise(F.lit("1.5")).alias("cpu_iowait_pct"),
        F.lit("8388608").alias("mem_total_kb"),
        (F.col("k") * 131072).cast("string").alias("mem_used_kb"),
    )


def _host(spark, d, budget=None):
    return O.derive_host_metrics(_raw_host(spark, d), ["metrics_path"], "day", ["us", "event_id"], budget)


_HOST = """hraw AS (SELECT *, 'i-' || user_id || '-' || tool_label AS instance_label, CASE WHEN event_id % 7 <> 0 THEN us / 1e6 END AS ts FROM v_events),
 hst AS (SELECT *, greatest(coalesce(last_value(ts IGNORE NULLS) OVER w - first_value(ts IGNORE NULLS) OVER w, 0), 0) AS el,
   least(value + k / 10.0::DOUBLE + CASE WHEN k % 4 = 0 THEN 0 ELSE 1.5 END, 100.0) AS cpu, least(k * 131072 / 8388608.0::DOUBLE * 100, 100.0) AS mem_pct, k * 131072 / 1048576.0::DOUBLE AS gib
   FROM hraw WINDOW w AS (PARTITION BY instance_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_INST = """hi AS (SELECT run_id, instance_id, instance_label, tool, tool_label, count(*) AS samples, max(el) / 3600.0 AS duration_hours, avg(cpu) AS cpu_active_avg_pct,
   max(cpu) AS cpu_active_peak_pct, avg(gib) AS mem_used_avg_gib, max(gib) AS mem_used_peak_gib, avg(mem_pct) AS mem_used_avg_pct, max(mem_pct) AS mem_used_peak_pct FROM hst GROUP BY ALL)"""


@query(
    "A9 S7",
    with_views("v_events", "SELECT event_id, round(el, 6) AS elapsed_seconds, round(cpu, 6) AS cpu_active_pct, round(mem_pct, 6) AS mem_used_pct, gib AS mem_used_gib FROM hst WHERE el <= 240.0 * 3600", _HOST),
)
def host_metrics(spark, d):
    rows = _host(spark, d, 240.0)
    return rows.select("event_id", *[F.round(c, 6).alias(c) for c in ("elapsed_seconds", "cpu_active_pct", "mem_used_pct")], "mem_used_gib")


@query(
    "A10 V8",
    with_views(
        "v_events",
        "SELECT run_id, instance_id, instance_label, tool, tool_label, samples, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in ("duration_hours", "cpu_active_avg_pct", "cpu_active_peak_pct", "mem_used_avg_gib", "mem_used_peak_gib", "mem_used_avg_pct", "mem_used_peak_pct"))
        + " FROM hi",
        _HOST + "," + _INST,
    ),
)
def host_instances(spark, d):
    out = O.host_summary(_host(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(
    "A11 V8",
    with_views(
        "v_events",
        "SELECT tool, count(DISTINCT instance_label) AS instances, round(quantile_cont(cpu_active_avg_pct, 0.5), 6) AS cpu_active_avg_pct_median, round(quantile_cont(mem_used_peak_gib, 0.5), 6) AS mem_used_peak_gib_median FROM hi GROUP BY tool",
        _HOST + "," + _INST,
    ),
)
def host_tool_medians(spark, d):
    out = O.host_medians(O.host_summary(_host(spark, d)), ["cpu_active_avg_pct", "mem_used_peak_gib"])
    return out.select("tool", "instances", *[F.round(c, 6).alias(c) for c in ("cpu_active_avg_pct_median", "mem_used_peak_gib_median")])


@query(
    "A12",
    with_views(
        "v_events",
        """SELECT tool, bin * 86400.0::DOUBLE / 3600.0 AS elapsed_hours, count(*) AS instances, round(quantile_cont(m, 0.25), 6) AS p25, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.75), 6) AS p75
           FROM (SELECT tool, instance_label, floor(el / 86400) AS bin, avg(cpu) AS m FROM hst GROUP BY ALL) GROUP BY tool, bin""",
        _HOST,
    ),
)
def host_bins(spark, d):
    out = O.binned(_host(spark, d), "cpu_active_pct", 86400.0)
    return out.select("tool", "elapsed_hours", "instances", *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")])
