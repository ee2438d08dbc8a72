"""Run index and lifecycle: which runs are complete, superseded, analysed, stale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import blank_to_null, repo_url, strip

RUN = ("run_id", "benchmark_uuid")


def started_epoch(run_id: Column, explicit: Column) -> Column:
    """Explicit start time, else an all-digit run id; NULL when neither is a positive integer."""
    text = blank_to_null(strip(explicit.cast("string")))
    given = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    legacy = F.when(run_id.rlike(r"^\d+$"), run_id.try_cast("bigint"))
    value = F.when(text.isNotNull(), given).otherwise(legacy)
    return F.when(value > 0, value)


def is_complete(started: Column, timeout_hours: Column, now: int, grace_s: int = fixed.GRACE_SECONDS) -> Column:
    hours = F.coalesce(timeout_hours, F.lit(fixed.DEFAULT_TIMEOUT_HOURS))
    return F.lit(now) >= started + (hours * 3600).cast("bigint") + grace_s


def analysis_kind(runs: DataFrame, published: DataFrame) -> DataFrame:
    """Where the report lives: current place, else legacy place, else missing.

    ``published``: (run_id, benchmark_uuid, place) with place `analysis` or `reports`.
    """
    found = published.groupBy(*RUN).agg(F.min("place").alias("_place"))
    return runs.join(found, list(RUN), "left").withColumn(
        "analysis_kind", F.coalesce("_place", F.lit("missing"))
    ).drop("_place")


def analysis_status(kind: Column) -> Column:
    return F.when(kind == "missing", "Missing analysis").when(kind == "reports", "Analyzed (legacy)").otherwise("Analyzed")


def complete_runs(
    runs: DataFrame,
    markers: DataFrame,
    published: DataFrame,
    now: int,
    grace_s: int = fixed.GRACE_SECONDS,
) -> DataFrame:
    """Runs past their deadline, without any superseded marker, with their analysis status.

    Every marker excludes its run, unreadable ones too.
    """
    done = runs.where(is_complete(F.col("started_epoch"), F.col("timeout_hours"), now, grace_s))
    kept = done.join(markers.select(*RUN).distinct(), list(RUN), "left_anti")
    return analysis_kind(kept, published).withColumn("status", analysis_status(F.col("analysis_kind")))


def marker_warnings(markers: DataFrame) -> DataFrame:
    """Markers that exclude a run although they are not valid."""
    return markers.where(~F.coalesce("valid", F.lit(False))).select(*RUN, "detail")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Greatest row by ``order`` for each key: an aggregate, so no group is sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_t")).select(*keys, "_t.*")


def history(runs: DataFrame) -> DataFrame:
    """Runs of each benchmark from newest to oldest."""
    w = Window.partitionBy("benchmark_uuid").orderBy(F.desc("started_epoch"), F.desc("run_id"))
    return runs.withColumn("age_rank", F.row_number().over(w))


def tool_versions(manifests: DataFrame) -> DataFrame:
    """(run_id, tool, version): own version field, else a short reference, else the alias's version.

    ``manifests``: (run_id, fuzzer_keys ARRAY, fields MAP<STRING,STRING>).
    """
    fields = F.col("fields")

    def text(key: Column | str) -> Column:
        k = F.lit(key) if isinstance(key, str) else key
        return blank_to_null(strip(F.try_element_at(fields, k)))

    def short(key: str, prefix: str) -> Column:
        return F.concat(F.lit(prefix), F.substring(text(key), 1, 7))

    rows = manifests.select(
        "run_id", "fields", F.explode(F.array_distinct(F.transform("fuzzer_keys", lambda t: F.trim(t)))).alias("tool")
    ).where(F.col("tool") != "")
    tool = F.col("tool")
    # Reference fields that stand in for a missing version.
    fallback = (
        F.when(tool == "foundry", short("foundry_git_ref", "git:"))
        .when(tool == "echidna", short("echidna_ci_commit", "ci:"))
        .when(tool == "medusa", short("medusa_git_commit", "git:"))
    )
    alias = None
    for name, other in fixed.VERSION_ALIASES.items():
        hit = F.when(tool == name, text(f"{other}_version"))
        alias = hit if alias is None else F.coalesce(alias, hit)
    own = text(F.concat(tool, F.lit("_version")))
    return rows.select("run_id", "tool", F.coalesce(own, fallback, alias).alias("version"))


def lifecycle(runs: DataFrame, now: int) -> Column:
    """`terminal-artifacts`, `orphan-deadline` or NULL.

    Needs started_epoch, timeout_hours, expected, archives, active,
    updated_epoch and heartbeat_epoch columns (the last two may be NULL).
    """
    deadline = F.col("started_epoch") + (F.col("timeout_hours") * 3600).cast("bigint") + fixed.ORPHAN_GRACE_SECONDS
    if "orphan_after_epoch" in runs.columns:
        deadline = F.coalesce("orphan_after_epoch", deadline)
    alive = F.greatest("started_epoch", "updated_epoch", "heartbeat_epoch")
    idle = F.col("active") == 0
    return F.when(idle & (F.col("expected") > 0) & (F.col("archives") >= F.col("expected")), "terminal-artifacts").when(
        idle & (F.lit(now) >= deadline) & (F.lit(now) - alive >= fixed.STALE_SECONDS), "orphan-deadline"
    )


def resolve_targets(runs: DataFrame, targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Target of each run when both its repository and its commit equal the catalog's.

    ``runs``: (run_id, target_repo_url, target_commit[, target_id explicit]).
    ``targets``: (id, repo). ``catalog``: (target_id, target_commit). An
    explicit id is verified like any other; otherwise the reason is given.
    """
    explicit = "target_id" in runs.columns
    r = runs.select(
        "run_id",
        repo_url("target_repo_url").alias("_repo"),
        F.coalesce(strip("target_commit"), F.lit("")).alias("_commit"),
        (blank_to_null("target_id") if explicit else F.lit(None).cast("string")).alias("_asked"),
    )
    t = targets.select(F.col("id").alias("_tid"), repo_url("repo").alias("_trepo"))
    by_repo = t.groupBy("_trepo").agg(F.min("_tid").alias("_by_repo"))
    c = catalog.select(F.col("target_id").alias("_cid"), F.col("target_commit").alias("_ccommit"))
    rows = (
        r.join(by_repo, r["_repo"] == by_repo["_trepo"], "left")
        .withColumn("_id", F.coalesce("_asked", "_by_repo"))
        .drop("_trepo")
    )
    rows = rows.join(c, rows["_id"] == c["_cid"], "left").join(
        t.withColumnRenamed("_tid", "_ref"), F.col("_id") == F.col("_ref"), "left"
    )
    asked = F.col("_asked").isNotNull()
    reason = (
        F.when(asked & F.col("_cid").isNull(), "target ID is not cataloged")
        .when(F.col("_repo") == "", "run manifest has no target_repo_url")
        .when(asked & ~F.coalesce(F.col("_repo") == F.col("_trepo"), F.lit(False)), "repository does not match the target")
        .when(F.col("_commit") == "", "run manifest has no target_commit")
        .when(~asked & F.col("_by_repo").isNull(), "run repository is not in the active target manifest")
        .when(F.col("_cid").isNull(), "target has no ground-truth catalog entry")
        .when(F.col("_commit") != F.col("_ccommit"), "run commit is not the cataloged revision")
    )
    return rows.select(
        "run_id",
        F.when(reason.isNull(), F.col("_id")).alias("target_id"),
        F.coalesce(reason, F.when(asked, "matched explicit target ID").otherwise("matched run repository and commit")).alias("reason"),
    )


# --- in-flight checkpoints ----------------------------------------------------------


def settled_checkpoint(started: Column, interval: Column, now: int, settle_s: int = fixed.SETTLE_SECONDS) -> Column:
    """Newest checkpoint whose settle delay has passed; below 1 means none."""
    return F.floor((F.lit(now) - started - max(0, settle_s)) / interval)


def select_checkpoints(
    snapshots: DataFrame,
    published: DataFrame,
    runs: DataFrame,
    now: int,
    settle_s: int = fixed.SETTLE_SECONDS,
) -> DataFrame:
    """The one checkpoint per live run to publish now, if any.

    The newest settled snapshot counts; when that one is published already,
    older ones are not made up for. ``runs``: (run_id, benchmark_uuid,
    started_epoch, timeout_hours, interval_seconds, enabled, finalized).
    """
    live = runs.where(
        F.col("enabled") & ~F.col("finalized")
        & (F.lit(now) >= F.col("started_epoch"))
        & (F.lit(now) < F.col("started_epoch") + (F.col("timeout_hours") * 3600).cast("bigint"))
    ).withColumn("_settled", settled_checkpoint(F.col("started_epoch"), F.col("interval_seconds"), now, settle_s))
    newest = (
        live.where(F.col("_settled") >= 1).join(snapshots.select(*RUN, "checkpoint"), list(RUN))
        .where(F.col("checkpoint") <= F.col("_settled"))
        .groupBy(*RUN).agg(F.max("checkpoint").alias("checkpoint"))
    )
    fresh = newest.join(published.select(*RUN, "checkpoint"), [*RUN, "checkpoint"], "left_anti")
    return fresh.join(live.drop("_settled"), list(RUN))


def snapshot_sets(captures: DataFrame, legs: DataFrame, runs: DataFrame) -> DataFrame:
    """Per (run, checkpoint): legs expected, present and missing, capture window, as-of.

    ``captures``: (run, checkpoint, tool, run_index, captured_epoch). ``legs``:
    (run, tool, run_index). Always flagged as incomplete and non-terminal.
    """
    expected = legs.groupBy(*RUN).agg(F.count(F.lit(1)).alias("expected"))
    present = captures.select(*RUN, "checkpoint", "tool", "run_index", "captured_epoch").groupBy(*RUN, "checkpoint", "tool", "run_index").agg(
        F.min("captured_epoch").alias("_a"), F.max("captured_epoch").alias("_b")
    )
    per_set = present.groupBy(*RUN, "checkpoint").agg(
        F.count(F.lit(1)).alias("present"), F.min("_a").alias("capture_start"), F.max("_b").alias("capture_end")
    )
    return (
        per_set.join(expected, list(RUN)).join(runs.select(*RUN, "started_epoch", "interval_seconds", "timeout_hours"), list(RUN))
        .select(
            *RUN, "checkpoint", "expected", "present",
            (F.col("expected") - F.col("present")).alias("missing"),
            (F.col("started_epoch") + F.col("checkpoint") * F.col("interval_seconds")).alias("scheduled_epoch"),
            "capture_start", "capture_end", F.col("capture_end").alias("as_of_epoch"),
            (F.col("capture_end") - F.col("started_epoch")).alias("elapsed_seconds"),
            (F.col("timeout_hours") * 3600).cast("bigint").alias("planned_seconds"),
            F.lit(True).alias("incomplete"), F.lit(True).alias("non_terminal"),
        )
    )


def missing_legs(captures: DataFrame, legs: DataFrame) -> DataFrame:
    """Legs without a capture, per run and checkpoint."""
    sets = captures.select(*RUN, "checkpoint").distinct()
    wanted = sets.join(legs.select(*RUN, "tool", "run_index"), list(RUN))
    return wanted.join(captures, [*RUN, "checkpoint", "tool", "run_index"], "left_anti")


def horizon_hours(sets: DataFrame) -> DataFrame:
    """Budget for analysing a checkpoint: its schedule, strictly inside the run."""
    seconds = F.col("checkpoint") * F.col("interval_seconds")
    ok = (seconds > 0) & (seconds < (F.col("timeout_hours") * 3600).cast("bigint"))
    return sets.withColumn("budget_hours", F.when(ok, seconds / 3600.0))
