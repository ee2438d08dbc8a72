"""Queries on discovery curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves
from .registry import query
from .views import HORIZON_HOURS, STEP_MIN, v_events, with_views

REP = curves.REPLICATE


def _curve(spark, d):
    return curves.cumulative(v_events(spark, d))


def _grid(spark, d):
    return curves.to_grid(_curve(spark, d), REP, "found", HORIZON_HOURS, STEP_MIN)


def _bands(spark, d):
    return curves.bands(_grid(spark, d))


@query("A1", with_views("first_times", "SELECT * FROM first_times"))
def first_times(spark, d):
    return curves.first_times(v_events(spark, d))


@query("W1 J4", with_views("curve", "SELECT tool, run_id, instance_id, time_hours, CAST(found AS BIGINT) AS found FROM curve"))
def cumulative_curve(spark, d):
    return _curve(spark, d)


@query(
    "W1",
    with_views(
        "v_events",
        """SELECT tool, run_id, instance_id, elapsed_seconds / 3600.0 AS time_hours,
           row_number() OVER (PARTITION BY tool, run_id, instance_id ORDER BY elapsed_seconds) AS found FROM v_events""",
    ),
)
def cumulative_all_rows(spark, d):
    return curves.cumulative(v_events(spark, d), include_zero=False, dedupe=False)


@query(
    "W2",
    with_views(
        "v_events",
        """SELECT tool, run_id, instance_id, 'decreased' AS reason, count(*) AS rows FROM (
             SELECT *, lag(found) OVER (PARTITION BY tool, run_id, instance_id ORDER BY time_hours, found) AS prev
             FROM (SELECT tool, run_id, instance_id, elapsed_seconds / 3600.0 AS time_hours, k AS found FROM v_events))
           WHERE found < prev GROUP BY ALL""",
    ),
)
def curve_violations(spark, d):
    noisy = v_events(spark, d).select(
        *REP, (F.col("elapsed_seconds") / 3600.0).alias("time_hours"), F.col("k").alias("found")
    )
    return curves.check_monotonic(noisy)


@query("J6", with_views("grid", "SELECT tool, run_id, instance_id, step_no, time_hours, CAST(found AS BIGINT) AS found FROM grid"))
def curve_grid(spark, d):
    return _grid(spark, d)


@query("A13", with_views("bands", "SELECT tool, step_no, time_hours, runs, CAST(top AS BIGINT) AS top, p25, p50, p75 FROM bands"))
def curve_bands(spark, d):
    return _bands(spark, d)


_CHECK = (24.0, 100.0, 333.0, 720.0)


@query(
    "A14 V1",
    with_views(
        "bands",
        """SELECT tool, checkpoint_hours, CAST(round_even(p50, 0) AS BIGINT) AS p50, CAST(round_even(p25, 0) AS BIGINT) AS p25,
             CAST(round_even(p75, 0) AS BIGINT) AS p75 FROM (
             SELECT *, row_number() OVER (PARTITION BY tool, checkpoint_hours ORDER BY abs(time_hours - checkpoint_hours), time_hours) AS r
             FROM bands, (SELECT unnest([24.0::DOUBLE, 100.0, 333.0, 720.0]) AS checkpoint_hours)) WHERE r = 1""",
    ),
)
def checkpoint_scores(spark, d):
    return curves.checkpoint_values(_bands(spark, d), _CHECK)


_OVERALL = """overall AS (
  SELECT tool, max(runs) AS runs,
    sum(CASE WHEN step_no < 120 THEN p50 * 6.0::DOUBLE ELSE 0 END) AS area,
    max(top) AS top, arg_min(p50, abs(time_hours - 360.0) * 1e6 + time_hours) AS mid, max(p50) AS peak,
    max(p25) FILTER (step_no = 120) AS f25, max(p50) FILTER (step_no = 120) AS f50, max(p75) FILTER (step_no = 120) AS f75
  FROM bands GROUP BY tool),
scored AS (SELECT o.tool, o.runs,
  area / (720.0::DOUBLE * greatest((SELECT max(top) FROM bands), 1)) AS auc_norm,
  (SELECT min(time_hours) FROM bands b WHERE b.tool = o.tool AND b.p50 = o.peak) AS plateau_hours,
  CASE WHEN f50 > 0 THEN (f50 - mid) / f50 ELSE 0 END AS late_share,
  CAST(round_even(f50, 0) AS BIGINT) AS final_p50, f75 - f25 AS final_iqr FROM overall o)"""


@query(
    "A15 A16 A17 A19 W5 V1",
    with_views(
        "bands",
        """SELECT tool, runs, round(auc_norm, 9) AS auc_norm, plateau_hours, round(late_share, 9) AS late_share, final_p50, final_iqr,
             CAST(row_number() OVER (ORDER BY final_p50 DESC, auc_norm DESC, tool) AS INTEGER) AS position FROM scored""",
        _OVERALL,
    ),
)
def overall_scores(spark, d):
    table = curves.tool_order(curves.overall(_bands(spark, d), HORIZON_HOURS, STEP_MIN))
    return table.withColumn("auc_norm", F.round("auc_norm", 9)).withColumn(
        "late_share", F.round("late_share", 9)
    )


_MILES = """miles AS (SELECT tool, k, quantile_cont(t, 0.5) AS median_hours, count(t) AS reached, count(*) AS runs
  FROM (SELECT tool, run_id, instance_id, k, min(time_hours) FILTER (found >= k) AS t
        FROM grid, (SELECT unnest([1, 3, 5, 10, 40]) AS k) GROUP BY ALL) GROUP BY tool, k)"""


@query(
    "A18 V1",
    with_views(
        "grid",
        "SELECT tool, k, median_hours, reached, runs, reached / runs AS reach_rate FROM miles",
        _MILES,
    ),
)
def milestone_times(spark, d):
    return curves.milestones(_grid(spark, d), (1, 3, 5, 10, 40))


@query(
    "V1",
    with_views(
        "bands",
        """SELECT s.tool, s.runs, round(auc_norm, 9) AS auc_norm, plateau_hours, round(late_share, 9) AS late_share, final_p50, final_iqr,
          max(median_hours) FILTER (k = 1) AS median_hours_k1, max(reached / m.runs) FILTER (k = 1) AS reach_rate_k1,
          max(median_hours) FILTER (k = 5) AS median_hours_k5, max(reached / m.runs) FILTER (k = 5) AS reach_rate_k5
        FROM scored s JOIN miles m ON s.tool = m.tool GROUP BY ALL""",
        _OVERALL + "," + _MILES,
    ),
)
def scorecard(spark, d):
    card = curves.scorecard(v_events(spark, d), HORIZON_HOURS, STEP_MIN, ks=(1, 5))
    return card.withColumn("auc_norm", F.round("auc_norm", 9)).withColumn(
        "late_share", F.round("late_share", 9)
    )


@query(
    "V9",
    with_views("v_events", "SELECT tool, run_id, instance_id, elapsed_seconds / 3600.0 AS time_hours, CAST(0 AS BIGINT) AS found FROM v_events WHERE elapsed_seconds < 0"),
)
def empty_curve(spark, d):
    none = v_events(spark, d).where(F.col("elapsed_seconds") < 0)
    return curves.cumulative(none)
