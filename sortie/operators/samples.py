"""Metric samples and host metrics: latest values, bands, availability, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import coverage_counter, coverage_signal, finite, to_number
from .ordered import grouped_quantiles, quantiles, scan

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def latest_summary(
    samples: DataFrame, values: Sequence[str], ordinal: str, scope: Sequence[str] = ()
) -> DataFrame:
    """Last non-null value per replicate and metric, then quartiles per tool.

    Equal times take the later row by ``ordinal``. ``runs`` counts replicates,
    ``<metric>_n`` those that have the metric.
    """
    at = F.struct("elapsed_seconds", F.col(ordinal))
    latest = samples.groupBy(*scope, "tool", "tool_label", "run_id", "instance_id").agg(
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(v) for v in values]
    )
    keys = [*scope, "tool"]
    runs = latest.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"))
    return runs.join(grouped_quantiles(latest, keys, values, QUARTILES), keys)


def metric_bands(grid: DataFrame, value: str, scope: Sequence[str] = ()) -> DataFrame:
    """Quartiles across replicates per grid time, for measured (unbounded) values."""
    return quantiles(grid, [*scope, "tool", "step_no", "time_hours"], value, QUARTILES)


def availability(
    samples: DataFrame,
    expected: DataFrame,
    value: str = "coverage_proxy",
    budget_hours: float = 0.0,
    is_series: Column | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """How much of a coverage signal each tool delivered, and its state.

    ``expected`` is (tool, expected_runs). Times are hours. ``is_series`` says
    whether the tool's signal is a time series (default: by tool name).
    """
    keys = [*scope, "tool"]
    series = ["run_id", "instance_id"]
    rows = samples.where(coverage_counter(F.col(value)).isNotNull())
    by_time = rows.groupBy(*keys, *series, "time_hours").agg(F.count(F.lit(1)).alias("_n"))
    per_series = by_time.groupBy(*keys, *series).agg(
        F.sum("_n").alias("_n"),
        F.count(F.lit(1)).alias("_times"),
        F.min("time_hours").alias("_first"),
        F.max("time_hours").alias("_last"),
    )
    measured = per_series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs_with_signal"),
        F.count_if(F.col("_times") >= 2).alias("runs_with_series"),
        F.sum("_n").alias("samples"),
        F.min("_first").alias("first_min_hours"),
        F.max("_first").alias("first_max_hours"),
        F.min("_last").alias("last_min_hours"),
        F.max("_last").alias("last_max_hours"),
    )
    sources = (
        rows.select(*keys, F.trim("source").alias("_s")).where(F.col("_s") != "").distinct()
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_sources"))
    )
    counts = ["expected_runs", "runs_with_signal", "runs_with_series", "samples", "distinct_sources"]
    tools = expected.select(*keys).union(samples.select(*keys)).distinct()
    out = (
        tools.join(expected, keys, "left").join(measured, keys, "left").join(sources, keys, "left")
        .fillna(0, subset=counts)
    )
    series_tool = coverage_signal(F.col("tool"))["is_series"] if is_series is None else is_series
    signal = F.col("runs_with_signal")
    gaps = (
        ((F.col("expected_runs") > 0) & (signal < F.col("expected_runs")))
        | (F.col("runs_with_series") < signal)
        | (F.lit(budget_hours > 0) & (F.col("last_min_hours") < F.lit(0.9 * budget_hours)))
    )
    return out.withColumn(
        "state",
        F.when(signal == 0, "unavailable")
        .when(~series_tool, "end-only")
        .when(gaps, "partial")
        .otherwise("live"),
    )


def observed_series(samples: DataFrame, value: str = "coverage_proxy") -> DataFrame:
    """Rows of the series that have at least two distinct observation times."""
    series = ["tool", "run_id", "instance_id"]
    rows = samples.where(F.col(value).isNotNull())
    eligible = (
        rows.groupBy(*series)
        .agg(F.min("time_hours").alias("_a"), F.max("time_hours").alias("_b"))
        .where(F.col("_a") < F.col("_b"))
        .select(*series)
    )
    return rows.join(eligible, series, "left_semi")


def run_health(
    curve: DataFrame,
    activity: DataFrame,
    budget_hours: float,
    early_exit: float = fixed.EARLY_EXIT_FRACTION,
) -> DataFrame:
    """Tools that most likely never ran or stopped early. ``activity``: (tool, run_id, instance_id, time_hours)."""
    final = curve.groupBy("tool").agg(F.max("found").alias("final_found"))
    per_series = activity.groupBy("tool", "run_id", "instance_id").agg(F.max("time_hours").alias("t"))
    last = per_series.groupBy("tool").agg(
        F.max(F.greatest(F.col("t"), F.lit(0.0))).alias("last_activity_hours"),
        F.count(F.lit(1)).alias("instances"),
    )
    problem = F.when(
        F.col("last_activity_hours").isNull() & (F.col("final_found") == 0), "never executed"
    ).when(F.col("last_activity_hours") < F.lit(early_exit * budget_hours), "terminated early")
    return (
        final.join(last, "tool", "left")
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull() & F.lit(budget_hours > 0))
    )


# --- host metrics ---------------------------------------------------------------------

INSTANCE = ("run_id", "instance_id", "instance_label", "tool", "tool_label")


def derive_host_metrics(
    raw: DataFrame,
    keys: Sequence[str] = ("metrics_path",),
    segment: str | None = None,
    order: Sequence[str] = ("line_no",),
    budget_hours: float | None = None,
) -> DataFrame:
    """Elapsed time and usage columns from raw host samples.

    Elapsed comes from the first valid timestamp of a file, else from uptime,
    else from the row number; gaps carry the last value forward and it never
    falls below zero. A budget keeps at least the earliest row of a file.
    """
    keys = list(keys)
    stamp = F.unix_micros(F.col("timestamp").try_cast("timestamp")) / F.lit(1e6)
    work = raw.withColumn("_ts", stamp).withColumn("_up", to_number("uptime_seconds"))
    seen = scan(
        work,
        keys,
        order,
        {
            "_ts0": ("first", F.col("_ts")),
            "_ts1": ("last", F.col("_ts")),
            "_up0": ("first", F.col("_up")),
            "_up1": ("last", F.col("_up")),
            "_row": ("sum", F.lit(1)),
        },
        segment,
    )
    has = work.groupBy(*keys).agg(
        F.count("_ts").alias("_has_ts"), F.count("_up").alias("_has_up")
    )
    elapsed = (
        F.when(F.col("_has_ts") > 0, F.coalesce(F.col("_ts1") - F.col("_ts0"), F.lit(0.0)))
        .when(F.col("_has_up") > 0, F.coalesce(F.col("_up1") - F.col("_up0"), F.lit(0.0)))
        .otherwise((F.col("_row") - 1).cast("double"))
    )
    zero = F.lit(0.0)

    def number(col: str) -> Column:
        return F.coalesce(finite(to_number(col)), zero)

    total, used = number("mem_total_kb"), F.greatest(number("mem_used_kb"), zero)
    out = (
        seen.join(has, keys)
        .withColumn("elapsed_seconds", F.greatest(elapsed, zero))
        .withColumn(
            "cpu_active_pct",
            F.least(
                F.greatest(number("cpu_user_pct") + number("cpu_system_pct") + number("cpu_iowait_pct"), zero),
                F.lit(100.0),
            ),
        )
        .withColumn(
            "mem_used_pct",
            F.when(total > 0, F.least(F.greatest(used / F.nullif(total, zero) * 100.0, zero), F.lit(100.0))).otherwise(zero),
        )
        .withColumn("mem_used_gib", used / F.lit(1024.0 * 1024.0))
        .drop("_ts", "_up", "_ts0", "_ts1", "_up0", "_up1", "_row", "_has_ts", "_has_up")
    )
    if budget_hours is None:
        return out
    earliest = out.groupBy(*keys).agg(
        F.min(F.struct("elapsed_seconds", *order)).alias("_first")
    )
    inside = F.col("elapsed_seconds") <= F.lit(budget_hours * 3600.0 + 1e-9)
    keep = F.struct("elapsed_seconds", *order) == F.col("_first")
    return out.join(earliest, keys).where(inside | keep).drop("_first")


def host_summary(metrics: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """Per instance: samples, duration, average and peak usage."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        (F.max("elapsed_seconds") / 3600.0).alias("duration_hours"),
        F.avg("cpu_active_pct").alias("cpu_active_avg_pct"),
        F.max("cpu_active_pct").alias("cpu_active_peak_pct"),
        F.avg("mem_used_gib").alias("mem_used_avg_gib"),
        F.max("mem_used_gib").alias("mem_used_peak_gib"),
        F.avg("mem_used_pct").alias("mem_used_avg_pct"),
        F.max("mem_used_pct").alias("mem_used_peak_pct"),
    )


def host_medians(summary: DataFrame, values: Sequence[str]) -> DataFrame:
    """Median of instance statistics per tool."""
    instances = summary.groupBy("tool").agg(F.count_distinct("instance_label").alias("instances"))
    medians = grouped_quantiles(summary, ["tool"], values, {"median": 0.5})
    return instances.join(medians.select("tool", *[f"{v}_median" for v in values]), "tool")


def binned(
    metrics: DataFrame, value: str, bin_seconds: float, instance: str = "instance_label"
) -> DataFrame:
    """Tumbling bins on elapsed time: mean per instance and bin, then quartiles per tool."""
    per_instance = (
        metrics.where(F.col("elapsed_seconds").isNotNull() & F.col(value).isNotNull())
        .groupBy("tool", instance, F.floor(F.col("elapsed_seconds") / F.lit(float(bin_seconds))).alias("bin"))
        .agg(F.avg(value).alias("_mean"))
    )
    return quantiles(per_instance, ["tool", "bin"], "_mean", QUARTILES).select(
        "tool",
        (F.col("bin") * F.lit(float(bin_seconds)) / 3600.0).alias("elapsed_hours"),
        F.col("n").alias("instances"),
        *QUARTILES,
    )


def series_positions(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Anonymous names: groups in order become `Fuzzer A`, …, `Fuzzer Z`, `Fuzzer AA`, …"""
    names = df.select(*by).distinct()
    place = F.row_number().over(Window.orderBy(*by)) - 1
    letters = []
    for length in range(1, 8):  # names of one letter come first, then those of two, and so on; seven serve any row number
        shorter = sum(26**i for i in range(1, length))
        digits = F.floor((place - shorter) / 26 ** (length - 1)), *[F.floor((place - shorter) / 26**i) for i in range(length - 2, -1, -1)]
        letters.append(F.when(place < shorter + 26**length, F.concat(*[F.char(65 + F.pmod(x, F.lit(26))) for x in digits])))
    return names.withColumn("alias", F.concat(F.lit("Fuzzer "), F.coalesce(*letters)))
