"""What was found: summaries, overlap between tools, catalog mapping, hit rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_event, normalize_tool, not_excluded
from .curves import first_times
from .ordered import grouped_quantiles

REPLICATE = ("run_id", "instance_id", "tool")


def _tools_per_event(events: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per event with its sorted set of tools (as long as the tool list, at most)."""
    return (
        events.select(*scope, "event", "tool")
        .distinct()
        .groupBy(*scope, "event")
        .agg(F.array_sort(F.collect_list("tool")).alias("tools"))
    )


def exclusive(events: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Events seen by exactly one tool."""
    return (
        _tools_per_event(events, scope)
        .where(F.size("tools") == 1)
        .select(*scope, F.col("tools")[0].alias("tool"), "event")
    )


def tool_summary(events: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per tool: replicates with events, distinct/exclusive/shared events, counts, time to first."""
    keys = [*scope, "tool"]
    per_run = (
        first_times(events, scope)
        .groupBy(*keys, "tool_label", "run_id", "instance_id")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("elapsed_seconds").alias("ttfb"),
        )
    )
    plain = per_run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("count").alias("mean_events"),
        F.coalesce(F.stddev_samp("count"), F.lit(0.0)).alias("stdev_events"),
        F.min("count").alias("min_events"),
        F.max("count").alias("max_events"),
        F.avg("ttfb").alias("mean_ttfb_seconds"),
    )
    medians = grouped_quantiles(per_run, keys, ["count", "ttfb"], {"p50": 0.5}).select(
        *keys,
        F.col("count_p50").alias("median_events"),
        F.col("ttfb_p50").alias("median_ttfb_seconds"),
    )
    sets = (
        _tools_per_event(events, scope)
        .select(*scope, F.explode("tools").alias("tool"), (F.size("tools") == 1).alias("own"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("distinct_events"),
            F.count_if("own").alias("exclusive_events"),
        )
        .withColumn("shared_events", F.col("distinct_events") - F.col("exclusive_events"))
    )
    return plain.join(medians, keys).join(sets, keys)


def peers(table: DataFrame, columns: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Each row of a one-row-per-tool table next to every row of its scope, as column ``peer``."""
    everyone = Window.partitionBy(*(scope or [F.lit(1)]))
    listed = table.withColumn("_peers", F.collect_list(F.struct(*columns)).over(everyone))
    return listed.withColumn("peer", F.explode("_peers")).drop("_peers")


def jaccard(events: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Shared and united event counts of every ordered tool pair, and their ratio.

    Events are first counted by their exact tool set, so pairs are made from
    a handful of sets rather than from every event.
    """
    sets = _tools_per_event(events, scope).groupBy(*scope, "tools").agg(F.count(F.lit(1)).alias("n"))
    one = sets.select(*scope, F.explode("tools").alias("tool"), "tools", "n")
    sizes = one.groupBy(*scope, "tool").agg(F.sum("n").alias("size"))
    shared = (
        one.select(*scope, "tool", F.explode("tools").alias("other"), "n")
        .groupBy(*scope, "tool", "other")
        .agg(F.sum("n").alias("shared"))
    )
    both = (
        peers(sizes, ["tool", "size"], scope)
        .select(*scope, "tool", "size", F.col("peer.tool").alias("other"), F.col("peer.size").alias("other_size"))
        .join(shared, [*scope, "tool", "other"], "left")
    )
    n = F.coalesce(F.col("shared"), F.lit(0))
    union = F.col("size") + F.col("other_size") - n
    return both.select(
        *scope, "tool", "other",
        n.cast("bigint").alias("shared"),
        union.cast("bigint").alias("united"),
        F.coalesce(F.try_divide(n, union), F.lit(0.0)).alias("jaccard"),
    )


def jaccard_matrix(events: DataFrame, tools: Sequence[str]) -> DataFrame:
    return jaccard(events).groupBy("tool").pivot("other", list(tools)).agg(F.first("jaccard"))


def intersections(
    events: DataFrame, top_k: int | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Events grouped by their exact tool set, largest first; `rank` within the scope."""
    sets = (
        _tools_per_event(events, scope)
        .groupBy(*scope, "tools")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(*scope, F.array_join("tools", ",").alias("tools"), F.size("tools").alias("tool_count"), "events")
    )
    order = Window.partitionBy(*(scope or [F.lit(1)])).orderBy(F.desc("events"), F.asc("tools"))
    ranked = sets.withColumn("rank", F.row_number().over(order))
    return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)


def shared_by_all(events: DataFrame) -> DataFrame:
    """Events found by every tool that found anything."""
    sets = _tools_per_event(events, ())
    active = events.agg(F.count_distinct("tool").alias("n")).scalar()
    return sets.where(F.size("tools") == active).select("event")


def overlap(events: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Canonical event × tool: first seen and replicates hit."""
    named = events.withColumn("event", canonical_event("event")).where(
        (F.col("event") != "") & F.col("elapsed_seconds").isNotNull()
    )
    return (
        named.groupBy(*scope, "event", "tool", "run_id", "instance_id")
        .agg(F.min("elapsed_seconds").alias("t"))
        .groupBy(*scope, "event", "tool")
        .agg(F.min("t").alias("first_seen_s"), F.count(F.lit(1)).alias("runs_hit"))
    )


def overlap_wide(events: DataFrame, tools: Sequence[str]) -> DataFrame:
    """One row per canonical event with a first-seen and a runs-hit column per tool."""
    long = overlap(events)
    cells = []
    for t in tools:
        hit = F.col("tool") == t
        cells += [
            F.max(F.when(hit, F.col("first_seen_s"))).alias(f"{t}_first_seen_s"),
            F.max(F.when(hit, F.col("runs_hit"))).alias(f"{t}_runs_hit"),
        ]
    return long.groupBy("event").agg(
        F.array_join(F.array_sort(F.collect_list("tool")), ",").alias("tools"),
        F.count(F.lit(1)).alias("tool_count"),
        *cells,
    )


def set_sizes(events: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Distinct canonical events per tool; tools in ``expected`` stay at zero."""
    found = overlap(events).groupBy("tool").agg(F.count(F.lit(1)).alias("events"))
    if expected is None:
        return found
    return (
        expected.select("tool").union(found.select("tool")).distinct()
        .join(found, "tool", "left")
        .select("tool", F.coalesce("events", F.lit(0)).cast("bigint").alias("events"))
    )


def head_list(
    df: DataFrame, by: Sequence[str], item: str, max_items: int
) -> DataFrame:
    """First items per group in order, and how many more there are."""
    w = Window.partitionBy(*by).orderBy(item)
    ranked = df.select(*by, item).distinct().withColumn("position", F.row_number().over(w))
    total = df.select(*by, item).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return (
        ranked.where(F.col("position") <= max_items)
        .join(total, list(by))
        .select(*by, "position", item, F.greatest(F.col("_n") - max_items, F.lit(0)).alias("more"))
    )


# --- catalog --------------------------------------------------------------------


def alias_index(catalog: DataFrame) -> DataFrame:
    """One catalog row per (target, tool, event): a known bug beats a canary, later beats earlier.

    Takes (target_id, tool, event, finding_class, entry_id[, title, kind, ordinal]).
    """
    ordinal = F.col("ordinal") if "ordinal" in catalog.columns else F.col("entry_id")
    extra = [c for c in ("title", "kind") if c in catalog.columns]
    scope = [c for c in ("target_id",) if c in catalog.columns]
    best = F.max_by(
        F.struct("finding_class", "entry_id", *extra),
        F.struct((F.col("finding_class") == "known_bug").alias("known"), ordinal.alias("o")),
    )
    return catalog.groupBy(*scope, "tool", "event").agg(best.alias("_b")).select(
        *scope, "tool", "event", "_b.*"
    )


def map_findings(
    events: DataFrame,
    alias: DataFrame,
    ordinal: str,
    exclude: Sequence[str] = (),
    tool: Column | None = None,
) -> DataFrame:
    """Catalog lookup, then one row per replicate and ground-truth id (or unmapped event).

    The earliest observation gives the attributes; equal times go to the row
    that came first by ``ordinal``. ``observations`` counts the merged rows.
    """
    extra = [c for c in ("title", "kind") if c in alias.columns]
    scope = [c for c in ("target_id",) if c in alias.columns and c in events.columns]
    rows = (
        events.where(not_excluded(exclude, "tool", "tool_label"))
        .withColumn("tool", normalize_tool("tool") if tool is None else tool)
        .withColumn("raw_event", F.col("event"))
        .withColumn("event", canonical_event("event"))
        .where(F.col("event") != "")
    )
    hit = rows.join(alias, [*scope, "tool", "event"], "left").withColumn(
        "finding_class", F.coalesce("finding_class", F.lit("unmapped"))
    )
    identity = F.coalesce("entry_id", "event")
    keep = [c for c in ("tool_label", "event", "raw_event", "elapsed_seconds", "source", "log_path") if c in hit.columns]
    first = F.min_by(
        F.struct(*keep, "entry_id", *extra), F.struct("elapsed_seconds", F.col(ordinal))
    )
    return (
        hit.groupBy(*scope, *REPLICATE, "finding_class", identity.alias("_identity"))
        .agg(first.alias("_f"), F.count(F.lit(1)).alias("observations"))
        .select(*scope, *REPLICATE, "finding_class", "_f.*", "observations")
    )


def replicates(
    events: DataFrame,
    inventory: DataFrame | None = None,
    default_run_id: str = "unknown",
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Every replicate seen in events or listed as a machine.

    A listed machine takes the run of its events when they name exactly one.
    """
    ev = events.where(not_excluded(exclude, "tool", "tool_label"))
    seen = ev.select(*REPLICATE).distinct()
    if inventory is None:
        return seen
    runs = (
        events.select("instance_id", "tool", "run_id").distinct()
        .groupBy("instance_id", "tool")
        .agg(F.min("run_id").alias("_run"), F.count(F.lit(1)).alias("_n"))
    )
    listed = (
        inventory.where(not_excluded(exclude, *[c for c in ("tool", "tool_label") if c in inventory.columns]))
        .join(runs, ["instance_id", "tool"], "left")
        .select(
            F.when(F.col("_n") == 1, F.col("_run")).otherwise(F.lit(default_run_id)).alias("run_id"),
            "instance_id",
            "tool",
        )
    )
    return seen.unionByName(listed).distinct()


def missing_replicates(
    present: DataFrame, expected: DataFrame, default_run_id: str = "unknown"
) -> DataFrame:
    """Pad ids `missing-<tool>-<i>` up to the configured number per tool.

    ``expected`` has one row per configured key: (tool, instances).
    """
    want = expected.groupBy("tool").agg(F.sum("instances").cast("int").alias("_want"))
    have = present.groupBy("tool").agg(F.count(F.lit(1)).cast("int").alias("_have"))
    gap = want.join(have, "tool", "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    return gap.where(F.col("_want") > F.col("_have")).select(
        F.lit(default_run_id).alias("run_id"),
        "tool",
        F.explode(F.sequence(F.col("_have") + 1, F.col("_want"))).alias("_i"),
    ).select("run_id", F.concat(F.lit("missing-"), "tool", F.lit("-"), F.col("_i").cast("string")).alias("instance_id"), "tool")


def hit_rates(findings: DataFrame, present: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per tool: how much of the catalog it can discover, and how often it did."""
    size = catalog.select("tool", "finding_class", "entry_id").distinct().groupBy("tool").agg(
        F.count_if(F.col("finding_class") == "known_bug").alias("known_bugs"),
        F.count_if(F.col("finding_class") == "canary").alias("canaries"),
    )
    runs = present.groupBy("tool").agg(F.count(F.lit(1)).alias("replicates"))
    per_id = findings.groupBy("tool", "finding_class", F.coalesce("entry_id", "event").alias("_id")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    cls = F.col("finding_class")

    def rows(c: str) -> Column:
        return F.coalesce(F.sum(F.when(cls == c, F.col("_rows"))), F.lit(0))

    hits = per_id.groupBy("tool").agg(
        rows("known_bug").alias("known_bug_hits"),
        F.count_if(cls == "known_bug").alias("distinct_known_bugs"),
        rows("canary").alias("canary_hits"),
        F.count_if(cls == "canary").alias("distinct_canaries"),
        rows("unmapped").alias("unmapped_findings"),
        F.count_if(cls == "unmapped").alias("distinct_unmapped"),
    )
    numbers = [c for t in (runs, size, hits) for c in t.columns if c != "tool"]
    joined = (
        runs.select("tool").union(hits.select("tool")).distinct()
        .join(runs, "tool", "left").join(size, "tool", "left").join(hits, "tool", "left")
        .fillna(0, subset=numbers)
    )
    c = F.col
    return joined.select(
        "tool",
        *numbers,
        (c("known_bugs") * c("replicates")).alias("known_bug_opportunities"),
        F.try_divide("known_bug_hits", c("known_bugs") * c("replicates")).alias("known_bug_hit_rate"),
        F.try_divide("distinct_known_bugs", "known_bugs").alias("known_bug_coverage"),
        (c("canaries") * c("replicates")).alias("canary_opportunities"),
        F.try_divide("canary_hits", c("canaries") * c("replicates")).alias("canary_hit_rate"),
        F.try_divide("distinct_canaries", "canaries").alias("canary_coverage"),
    )


def unmapped(findings: DataFrame) -> DataFrame:
    """(tool, event) to the number of distinct replicates, for triage."""
    return (
        findings.where(F.col("finding_class") == "unmapped")
        .select("tool", "event", "run_id", "instance_id").distinct()
        .groupBy("tool", "event").agg(F.count(F.lit(1)).alias("replicates"))
    )
