"""Discovery curves: first times, cumulative counts, grids, bands, scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import not_excluded
from ..session import stage
from .ordered import scan

REPLICATE = ("tool", "run_id", "instance_id")
HOUR = 3600.0


def first_times(events: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Earliest time of each event per replicate (run, instance and raw label)."""
    return events.groupBy(*scope, "tool", "tool_label", "run_id", "instance_id", "event").agg(
        F.min("elapsed_seconds").alias("elapsed_seconds")
    )


def cumulative(
    events: DataFrame,
    inventory: DataFrame | None = None,
    include_zero: bool = True,
    dedupe: bool = True,
    exclude: Sequence[str] = (),
    scope: Sequence[str] = (),
) -> DataFrame:
    """Step series per replicate: one row per finding with the running count.

    ``inventory`` keeps replicates without findings. ``dedupe=False`` counts
    every event row instead of each event once.
    """
    keys = [*scope, *REPLICATE]
    rows = events.where(not_excluded(exclude, "tool", "tool_label")).where(
        F.col("elapsed_seconds").isNotNull()
    )
    times = first_times(rows, scope) if dedupe else rows
    at_once = (
        times.groupBy(*keys, "elapsed_seconds")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_hour", F.floor(F.col("elapsed_seconds") / HOUR))
    )
    running = scan(at_once, keys, ["elapsed_seconds"], {"_upto": ("sum", F.col("_n"))}, "_hour")
    steps = running.select(
        *keys,
        (F.col("elapsed_seconds") / HOUR).alias("time_hours"),
        F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, F.col("_upto"))).alias("found"),
    )
    if not include_zero:
        return steps
    replicates = rows.select(*keys)
    if inventory is not None:
        listed = inventory
        if exclude:
            labels = [c for c in ("tool", "tool_label") if c in inventory.columns]
            listed = inventory.where(not_excluded(exclude, *labels))
        replicates = replicates.unionByName(listed.select(*keys))
    start = replicates.distinct().select(
        *keys, F.lit(0.0).alias("time_hours"), F.lit(0).cast("bigint").alias("found")
    )
    return start.unionByName(steps)


def check_monotonic(curve: DataFrame, keys: Sequence[str] = REPLICATE) -> DataFrame:
    """Violations only: (keys, reason, rows). Empty means the curve is valid."""
    value = F.col("found").cast("double")
    seen = scan(
        curve.withColumn("_hour", F.floor("time_hours")),
        keys,
        ["time_hours", "found"],
        {"_peak": ("prev", value)},
        "_hour",
    )
    reasons = F.array_compact(
        F.array(
            F.when(value < F.col("_peak"), F.lit("decreased")),
            F.when(value < 0, F.lit("negative")),
            F.when(value != F.floor(value), F.lit("not integer")),
            F.when(F.col("time_hours").isNull(), F.lit("time missing")),
        )
    )
    return (
        seen.select(*keys, F.explode(reasons).alias("reason"))
        .groupBy(*keys, "reason")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def require_monotonic(curve: DataFrame, keys: Sequence[str] = REPLICATE) -> DataFrame:
    """Raise with the first 20 violations, else hand the curve back."""
    bad = check_monotonic(curve, keys).orderBy(*keys, "reason").limit(20).collect()
    if bad:
        raise ValueError("curve is not a valid step series: " + "; ".join(map(str, bad)))
    return curve


def infer_budget(curve: DataFrame) -> float:
    """Longest time, rounded to hours unless that gives nothing (one small action)."""
    longest = curve.agg(F.max("time_hours")).first()[0] or 0.0
    return float(round(longest)) if round(longest) > 0 else float(longest)


def clamp_checkpoints(checkpoints: Sequence[float], budget_hours: float) -> list[float]:
    kept = list(dict.fromkeys(float(c) for c in checkpoints if c <= budget_hours + 1e-9))
    return kept or [float(budget_hours)]


def grid_size(budget_hours: float, step_min: float) -> int:
    step = step_min / 60.0
    n = 0
    # arange(0, budget + 1e-9, step): count from the ratio, corrected for roundoff
    n = int((budget_hours + 1e-9) / step)
    while n * step < budget_hours + 1e-9:
        n += 1
    return n


def to_grid(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    budget_hours: float,
    step_min: float = 6.0,
    duplicates: str = "max",
    before: float | None = 0,
    extend: bool = True,
    tie: Sequence[str] = (),
) -> DataFrame:
    """As-of resampling to a regular grid: (keys, step_no, time_hours, value).

    Observations first shrink to the latest one per grid cell (map-side
    combined), so a series never holds more rows than the grid; each remaining
    row then fills the cells up to the next one. ``duplicates`` settles equal
    times: ``max``, ``mean`` or ``last`` (by the ``tie`` columns). ``before``
    is the value ahead of the first observation. ``extend=False`` stops a
    series at its last observation.
    """
    keys, step = list(keys), step_min / 60.0
    n = grid_size(budget_hours, step_min)
    t = F.col("time_hours")
    guess = F.ceil(t / F.lit(step))
    cell = (
        F.when((guess - 1) * F.lit(step) >= t, guess - 1)
        .when(guess * F.lit(step) < t, guess + 1)
        .otherwise(guess)
    )
    cell = F.greatest(F.lit(0), F.least(F.lit(n), cell)).cast("int")
    obs = series.where(t.isNotNull() & F.col(value).isNotNull())
    if duplicates == "mean":
        obs = obs.groupBy(*keys, "time_hours").agg(F.avg(value).alias(value))
        latest = F.struct("time_hours")
    elif duplicates == "max":
        latest = F.struct("time_hours", F.col(value))
    elif duplicates == "last":
        latest = F.struct("time_hours", *tie)
    else:
        raise ValueError(f"unknown duplicates rule {duplicates}")
    cells = obs.groupBy(*keys, cell.alias("_cell")).agg(
        F.max_by(F.col(value), latest).alias("_value"), F.max("time_hours").alias("_at")
    )
    along = Window.partitionBy(*keys).orderBy("_cell")
    spans = cells.select(
        *keys,
        "_value",
        "_cell",
        F.when(F.lag("_cell").over(along).isNull(), F.col("_cell")).alias("_lead_in"),
        F.lead("_cell").over(along).alias("_next"),
        "_at",
    )
    last_cell = F.coalesce(F.col("_next"), F.lit(n)) - 1
    if not extend:
        exact = F.col("_cell") * F.lit(step) == F.col("_at")
        last_cell = F.when(F.col("_next").isNotNull(), last_cell).otherwise(
            F.when(exact, F.col("_cell")).otherwise(F.col("_cell") - 1)
        )
    vtype = series.schema[value].dataType if duplicates != "mean" else "double"

    def run(lo: Column, hi: Column, v: Column) -> Column:
        return F.when(
            lo <= hi,
            F.transform(F.sequence(lo, hi), lambda i: F.struct(i.alias("i"), v.cast(vtype).alias("v"))),
        )

    none = F.array().cast(f"array<struct<i:int,v:{_type_name(vtype)}>>")
    filled = F.coalesce(
        run(F.col("_cell"), F.least(last_cell, F.lit(n - 1)), F.col("_value")), none
    )
    ahead = F.coalesce(run(F.lit(0), F.col("_lead_in") - 1, F.lit(before)), none)
    tail = none
    if not extend:
        tail = F.when(
            F.col("_next").isNull(),
            F.coalesce(run(last_cell + 1, F.lit(n - 1), F.lit(None)), none),
        ).otherwise(none)
    points = spans.select(*keys, F.explode(F.concat(ahead, filled, tail)).alias("_p"))
    return points.select(
        *keys,
        F.col("_p.i").alias("step_no"),
        (F.col("_p.i") * F.lit(step)).alias("time_hours"),
        F.col("_p.v").alias(value),
    )


def _type_name(t) -> str:
    return t if isinstance(t, str) else t.simpleString()


def bands(grid: DataFrame, value: str = "found", scope: Sequence[str] = ()) -> DataFrame:
    """p25/p50/p75 across replicates per tool and grid time.

    Meant for counts: the built-in percentile keeps one map entry per distinct
    value, and counts have at most as many as one replicate has findings.
    """
    p = F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        grid.where(F.col(value).isNotNull())
        .groupBy(*scope, "tool", "step_no", "time_hours")
        .agg(p.alias("_p"), F.count(F.lit(1)).alias("runs"), F.max(value).alias("top"))
        .select(
            *scope, "tool", "step_no", "time_hours", "runs", "top",
            F.col("_p")[0].alias("p25"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p75"),
        )
    )


def checkpoint_values(
    band: DataFrame, checkpoints: Sequence[float], scope: Sequence[str] = ()
) -> DataFrame:
    """Rounded band values at the grid time nearest each checkpoint (earliest on ties)."""
    keys = [*scope, "tool"]
    near = [
        F.min_by(
            F.struct(F.lit(float(c)).alias("checkpoint_hours"), "p50", "p25", "p75"),
            F.struct(F.abs(F.col("time_hours") - F.lit(float(c))), F.col("time_hours")),
        )
        for c in checkpoints
    ]
    picked = band.groupBy(*keys).agg(F.array(*near).alias("_c"))
    return picked.select(*keys, F.explode("_c").alias("_r")).select(
        *keys,
        "_r.checkpoint_hours",
        *[F.rint(f"_r.{p}").cast("bigint").alias(p) for p in ("p50", "p25", "p75")],
    )


def overall(
    band: DataFrame, budget_hours: float, step_min: float = 6.0, scope: Sequence[str] = ()
) -> DataFrame:
    """One row per tool: normalised area, plateau time, late share, final spread."""
    keys, step = [*scope, "tool"], step_min / 60.0
    n = grid_size(budget_hours, step_min)
    width = (F.col("step_no") + 1) * F.lit(step) - F.col("step_no") * F.lit(step)
    area = F.sum(F.when(F.col("step_no") < n - 1, F.col("p50") * width).otherwise(F.lit(0.0)))
    half = budget_hours / 2.0
    final = F.col("step_no") == n - 1
    per_tool = band.groupBy(*keys).agg(
        F.max("runs").alias("runs"),
        F.max("top").alias("_top"),
        area.alias("_area"),
        F.min_by("time_hours", F.struct(-F.col("p50"), F.col("time_hours"))).alias("plateau_hours"),
        F.min_by(
            "p50", F.struct(F.abs(F.col("time_hours") - F.lit(half)), F.col("time_hours"))
        ).alias("_mid"),
        *[F.max(F.when(final, F.col(p))).alias(f"_final_{p}") for p in ("p25", "p50", "p75")],
    )
    everyone = Window.partitionBy(*(scope or [F.lit(1)]))  # one row per tool by now
    scored = per_tool.withColumn("_peak", F.max("_top").over(everyone))
    last = F.col("_final_p50")
    return scored.select(
        *keys,
        "runs",
        (F.col("_area") / (F.lit(float(budget_hours)) * F.greatest(F.col("_peak"), F.lit(1)))).alias("auc_norm"),
        "plateau_hours",
        F.when(last > 0, (last - F.col("_mid")) / last).otherwise(F.lit(0.0)).alias("late_share"),
        F.rint(last).cast("bigint").alias("final_p50"),
        (F.col("_final_p75") - F.col("_final_p25")).alias("final_iqr"),
    )


def milestones(
    grid: DataFrame, ks: Sequence[int], keys: Sequence[str] = REPLICATE, scope: Sequence[str] = ()
) -> DataFrame:
    """Time to the k-th finding: median over replicates that got there, and their share.

    Never reached is NULL. Times are grid times, so the percentile's map is as
    small as the grid.
    """
    series = list(dict.fromkeys([*scope, *keys]))
    hit = grid.groupBy(*series).agg(
        F.array(
            *[
                F.struct(
                    F.lit(int(k)).alias("k"),
                    F.min(F.when(F.col("found") >= int(k), F.col("time_hours"))).alias("t"),
                )
                for k in ks
            ]
        ).alias("_k")
    )
    return (
        hit.select(*scope, "tool", F.explode("_k").alias("_r"))
        .groupBy(*scope, "tool", F.col("_r.k").alias("k"))
        .agg(
            F.percentile("_r.t", F.lit(0.5)).alias("median_hours"),
            F.count("_r.t").alias("reached"),
            F.count(F.lit(1)).alias("runs"),
        )
        .withColumn("reach_rate", F.col("reached") / F.col("runs"))
    )


def scorecard(
    events: DataFrame,
    budget_hours: float,
    step_min: float = 6.0,
    ks: Sequence[int] = (1, 3, 5),
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Flagship: how fast does each tool accumulate findings? Best tools first."""
    curve = cumulative(events, inventory)
    grid = stage(to_grid(curve, REPLICATE, "found", budget_hours, step_min), "grid")
    band = bands(grid)
    reach = milestones(grid, ks)
    cols = [
        F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_k{k}")
        for k in ks
        for c in ("median_hours", "reach_rate")
    ]
    return (
        overall(band, budget_hours, step_min)
        .join(reach.groupBy("tool").agg(*cols), "tool", "left")
        .orderBy(F.desc("final_p50"), F.desc("auc_norm"), "tool")
    )


def tool_order(table: DataFrame) -> DataFrame:
    """Position by (final median, area), best first. One row per tool in."""
    by = Window.orderBy(F.desc("final_p50"), F.desc("auc_norm"), F.asc("tool"))
    return table.withColumn("position", F.row_number().over(by))
