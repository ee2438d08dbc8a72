"""Queries on what was found, by whom, and against the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import findings as O
from .registry import query
from .views import HORIZON_HOURS, TYPES, table, v_alias, v_events, with_views

_R = 6


def _rounded(df, *cols):
    return df.select(*[F.round(c, _R).alias(c) if c in cols else c for c in df.columns])


_SETS = "sets AS (SELECT event, string_agg(tool, ',' ORDER BY tool) AS tools, count(*) AS n FROM (SELECT DISTINCT event, tool FROM v_events) GROUP BY event)"


@query("A3", with_views("v_events", "SELECT min(tool) AS tool, event FROM v_events GROUP BY event HAVING count(DISTINCT tool) = 1"))
def exclusive_events(spark, d):
    return O.exclusive(v_events(spark, d))


@query(
    "A2",
    with_views(
        "first_times",
        """SELECT tool, runs, round(mean_events, 6) AS mean_events, median_events, round(stdev_events, 6) AS stdev_events, min_events, max_events,
             round(mean_ttfb_seconds, 3) AS mean_ttfb_seconds, round(median_ttfb_seconds, 6) AS median_ttfb_seconds,
             distinct_events, exclusive_events, distinct_events - exclusive_events AS shared_events
           FROM per_tool JOIN (SELECT tool, count(*) AS distinct_events, count(*) FILTER (n = 1) AS exclusive_events
             FROM (SELECT DISTINCT event, tool FROM v_events) JOIN sets USING (event) GROUP BY tool) USING (tool)""",
        """per_run AS (SELECT tool, tool_label, run_id, instance_id, count(*) AS c, min(elapsed_seconds) AS t FROM first_times GROUP BY ALL),
        per_tool AS (SELECT tool, count(*) AS runs, avg(c) AS mean_events, quantile_cont(CAST(c AS DOUBLE), 0.5) AS median_events,
          coalesce(stddev_samp(c), 0) AS stdev_events, min(c) AS min_events, max(c) AS max_events, avg(t) AS mean_ttfb_seconds,
          quantile_cont(t, 0.5) AS median_ttfb_seconds FROM per_run GROUP BY tool), """ + _SETS,
    ),
)
def tool_summary(spark, d):
    out = _rounded(O.tool_summary(v_events(spark, d)), "mean_events", "stdev_events", "median_ttfb_seconds")
    return out.withColumn("mean_ttfb_seconds", F.round("mean_ttfb_seconds", 3))


_TE = "te AS (SELECT DISTINCT tool, event FROM v_events), sz AS (SELECT tool, count(*) AS n FROM te GROUP BY tool), pairs AS (SELECT a.tool AS tool, b.tool AS other, a.n AS na, b.n AS nb, coalesce(c.shared, 0) AS shared FROM sz a CROSS JOIN sz b LEFT JOIN (SELECT x.tool AS t1, y.tool AS t2, count(*) AS shared FROM te x JOIN te y ON x.event = y.event GROUP BY ALL) c ON c.t1 = a.tool AND c.t2 = b.tool)"


@query("J18 E1", with_views("v_events", "SELECT tool, other, shared, na + nb - shared AS united, shared / (na + nb - shared) AS jaccard FROM pairs", _TE))
def jaccard_pairs(spark, d):
    return O.jaccard(v_events(spark, d))


@query(
    "E1",
    with_views(
        "v_events",
        "SELECT tool, " + ", ".join(f"max(shared / (na + nb - shared)) FILTER (other = '{t}') AS \"{t}\"" for t in TYPES) + " FROM pairs GROUP BY tool",
        _TE,
    ),
)
def jaccard_square(spark, d):
    return O.jaccard_matrix(v_events(spark, d), TYPES)


@query(
    "A23 T1 V7",
    with_views(
        "v_events",
        """SELECT tools, CAST(n AS INTEGER) AS tool_count, events, CAST(rank AS INTEGER) AS rank FROM (
           SELECT tools, n, count(*) AS events, row_number() OVER (ORDER BY count(*) DESC, tools) AS rank FROM sets GROUP BY tools, n)""",
        _SETS,
    ),
)
def tool_intersections(spark, d):
    return O.intersections(v_events(spark, d))


@query("A23", with_views("v_events", "SELECT event FROM sets WHERE n = (SELECT count(DISTINCT tool) FROM v_events)", _SETS))
def found_by_all(spark, d):
    return O.shared_by_all(v_events(spark, d))




def _decorated(spark, d):
    """Events as tools really print them: qualified, with parameters, wrapped, suffixed."""
    ev = v_events(spark, d)
    e, k = F.col("event"), F.col("k")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("Suite.Inner."), e, F.lit("(uint256,address)")))
        .when(k % 4 == 1, F.concat(F.lit("invariant_assertion_failure_"), e))
        .when(k % 4 == 2, F.concat(F.lit("  "), e, F.lit("_ASSERTION_"), F.upper("tool"), F.lit("_7()")))
        .otherwise(e)
    )
    return ev.withColumn("plain", e).withColumn("event", raw)


@query("P15", with_views("v_events", "SELECT event_id, event AS canonical FROM v_events"))
def canonical_events(spark, d):
    return _decorated(spark, d).select("event_id", S.canonical_event("event").alias("canonical"))


@query(
    "A22",
    with_views(
        "v_events",
        "SELECT event, tool, min(elapsed_seconds) AS first_seen_s, count(DISTINCT run_id || ':' || instance_id) AS runs_hit FROM v_events GROUP BY ALL",
    ),
)
def event_overlap(spark, d):
    return O.overlap(_decorated(spark, d))


@query(
    "A22",
    with_views(
        "v_events",
        "SELECT event, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, count(DISTINCT tool) AS tool_count, "
        + ", ".join(
            f"min(elapsed_seconds) FILTER (tool = '{t}') AS {t}_first_seen_s, nullif(count(DISTINCT instance_id) FILTER (tool = '{t}'), 0) AS {t}_runs_hit"
            for t in TYPES
        )
        + " FROM v_events GROUP BY event",
    ),
)
def event_overlap_wide(spark, d):
    return O.overlap_wide(_decorated(spark, d), TYPES)


@query(
    "J5",
    with_views(
        "v_events",
        """SELECT tool, coalesce(events, 0) AS events FROM (SELECT tool FROM v_events UNION SELECT lower(r_name) FROM region)
           LEFT JOIN (SELECT tool, count(DISTINCT event) AS events FROM v_events GROUP BY tool) USING (tool)""",
    ),
)
def tool_set_sizes(spark, d):
    """Regions play tools that were set up and found nothing."""
    ev = v_events(spark, d)
    idle = table(spark, d, "region").select(F.lower("r_name").alias("tool"))
    return O.set_sizes(ev, ev.select("tool").union(idle).distinct())


@query(
    "P32",
    with_views("v_events", "SELECT tool, count(*) AS events FROM v_events WHERE elapsed_seconds <= 240.0 * 3600 GROUP BY tool"),
)
def budgeted_events(spark, d):
    return v_events(spark, d).where(S.within_budget("elapsed_seconds", 240.0)).groupBy("tool").agg(F.count(F.lit(1)).alias("events"))


@query(
    "P31",
    with_views("v_events", "SELECT tool, tool_label, count(*) AS events FROM v_events WHERE tool <> 'view' AND tool_label <> 'click-v1' GROUP BY ALL"),
)
def exclusion_filter(spark, d):
    ev = v_events(spark, d).where(S.not_excluded(["VIEW", "Click-V1"], "tool", "tool_label"))
    return ev.groupBy("tool", "tool_label").agg(F.count(F.lit(1)).alias("events"))


@query(
    "T1",
    with_views(
        "v_events",
        """SELECT tool, CAST(position AS INTEGER) AS position, event, greatest(n - 10, 0) AS more FROM (
             SELECT tool, event, row_number() OVER (PARTITION BY tool ORDER BY event) AS position, count(*) OVER (PARTITION BY tool) AS n
             FROM (SELECT DISTINCT tool, event FROM v_events)) WHERE position <= 10""",
    ),
)
def first_items_per_tool(spark, d):
    return O.head_list(v_events(spark, d), ["tool"], "event", 10)


# --- catalog -----------------------------------------------------------------------


def _alias(spark, d):
    return O.alias_index(v_alias(spark, d))


def _findings(spark, d):
    ev = v_events(spark, d)
    return O.map_findings(ev, _alias(spark, d), "event_id", tool=F.col("tool"))


_MAPPED = """mapped AS (SELECT e.*, coalesce(a.finding_class, 'unmapped') AS finding_class, a.entry_id,
    coalesce(a.entry_id, e.event) AS ident FROM v_events e LEFT JOIN v_alias a ON e.tool = a.tool AND e.event = a.event),
  finds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, instance_id, tool, finding_class, ident ORDER BY elapsed_seconds, event_id) AS r,
    count(*) OVER (PARTITION BY run_id, instance_id, tool, finding_class, ident) AS observations FROM mapped) WHERE r = 1)"""


@query("J1", with_views("v_events v_alias", "SELECT tool, finding_class, count(*) AS rows, count(DISTINCT ident) AS ids FROM mapped GROUP BY ALL", _MAPPED))
def alias_join(spark, d):
    hit = v_events(spark, d).join(_alias(spark, d), ["tool", "event"], "left")
    return (
        hit.groupBy(
            "tool",
            F.coalesce("finding_class", F.lit("unmapped")).alias("finding_class"),
            F.coalesce("entry_id", "event").alias("_id"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("tool", "finding_class")
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"))
    )


@query(
    "A24",
    with_views("v_events v_alias", "SELECT run_id, instance_id, tool, finding_class, entry_id, event, elapsed_seconds, observations FROM finds", _MAPPED),
)
def mapped_findings(spark, d):
    return _findings(spark, d).select(
        "run_id", "instance_id", "tool", "finding_class", "entry_id", "event", "elapsed_seconds", "observations"
    )


@query(
    "A25 V8",
    with_views(
        "v_events v_alias",
        """SELECT tool, replicates, known_bugs, canaries, known_bug_hits, distinct_known_bugs, canary_hits, distinct_canaries, unmapped_findings, distinct_unmapped,
             known_bugs * replicates AS known_bug_opportunities, round(known_bug_hits / nullif(known_bugs * replicates, 0), 9) AS known_bug_hit_rate,
             round(distinct_known_bugs / nullif(known_bugs, 0), 9) AS known_bug_coverage, canaries * replicates AS canary_opportunities,
             round(canary_hits / nullif(canaries * replicates, 0), 9) AS canary_hit_rate, round(distinct_canaries / nullif(canaries, 0), 9) AS canary_coverage
           FROM (SELECT tool, count(DISTINCT run_id || instance_id) AS replicates FROM v_events GROUP BY tool)
           JOIN (SELECT tool, count(DISTINCT entry_id) FILTER (finding_class = 'known_bug') AS known_bugs, count(DISTINCT entry_id) FILTER (finding_class = 'canary') AS canaries FROM v_alias GROUP BY tool) USING (tool)
           JOIN (SELECT tool, count(*) FILTER (finding_class = 'known_bug') AS known_bug_hits, count(DISTINCT ident) FILTER (finding_class = 'known_bug') AS distinct_known_bugs,
             count(*) FILTER (finding_class = 'canary') AS canary_hits, count(DISTINCT ident) FILTER (finding_class = 'canary') AS distinct_canaries,
             count(*) FILTER (finding_class = 'unmapped') AS unmapped_findings, count(DISTINCT ident) FILTER (finding_class = 'unmapped') AS distinct_unmapped FROM finds GROUP BY tool) USING (tool)""",
        _MAPPED,
    ),
)
def catalog_hit_rates(spark, d):
    out = O.hit_rates(_findings(spark, d), O.replicates(v_events(spark, d)), v_alias(spark, d))
    names = [c for c in out.columns if c.endswith(("_rate", "_coverage"))]
    return out.select(*[F.round(c, 9).alias(c) if c in names else c for c in out.columns])


@query(
    "A26 V8",
    with_views("v_events v_alias", "SELECT tool, event, count(DISTINCT run_id || ':' || instance_id) AS replicates FROM finds WHERE finding_class = 'unmapped' GROUP BY ALL", _MAPPED),
)
def unmapped_triage(spark, d):
    return O.unmapped(_findings(spark, d))


# --- replicates ------------------------------------------------------------------------

_LEGS = """legs AS (SELECT tool, user_id FROM (SELECT DISTINCT tool FROM v_events) CROSS JOIN (SELECT user_id FROM v_events UNION SELECT c_custkey FROM customer)),
  early AS (SELECT DISTINCT tool, user_id, run_id, instance_id FROM v_events)"""


def _machines(spark, d):
    """Every machine runs every tool: a row per (tool, machine), made per machine.

    Customers are machines too; those without events are the missing ones.
    """
    users = table(spark, d, "events").select("user_id").union(table(spark, d, "customer").select("c_custkey")).distinct()
    return users.select(
        F.explode(F.array(*[F.lit(t) for t in TYPES])).alias("tool"),
        F.concat(F.lit("i-"), F.col("user_id").cast("string")).alias("instance_id"),
    )


@query(
    "J2",
    with_views(
        "v_events",
        """SELECT coalesce(e.run_id, 'r0') AS run_id, 'i-' || l.user_id AS instance_id, l.tool FROM legs l LEFT JOIN early e ON l.tool = e.tool AND l.user_id = e.user_id""",
        _LEGS,
    ),
)
def replicate_inventory(spark, d):
    return O.replicates(v_events(spark, d), _machines(spark, d), default_run_id="r0")


@query(
    "J3",
    with_views(
        "v_events",
        """SELECT 'r0' AS run_id, 'missing-' || tool || '-' || i AS instance_id, tool FROM (
             SELECT tool, unnest(range(have + 1, want + 1)) AS i FROM (SELECT tool, count(*) AS want FROM legs GROUP BY tool)
             JOIN (SELECT tool, count(*) AS have FROM early GROUP BY tool) USING (tool))""",
        _LEGS,
    ),
)
def missing_replicates(spark, d):
    present = O.replicates(v_events(spark, d))
    expected = _machines(spark, d).groupBy("tool").agg(F.count(F.lit(1)).alias("instances"))
    return O.missing_replicates(present, expected, "r0")


@query(
    "E2 E3",
    with_views(
        "v_events",
        """SELECT tool, user_id, 'missing' AS part FROM (SELECT tool, user_id FROM legs EXCEPT SELECT tool, user_id FROM early)
           UNION ALL SELECT tool, user_id, 'present' FROM (SELECT tool, user_id FROM legs INTERSECT SELECT tool, user_id FROM early)""",
        _LEGS,
    ),
)
def leg_sets(spark, d):
    legs = _machines(spark, d).select("tool", F.substring("instance_id", 3, 30).cast("bigint").alias("user_id"))
    early = v_events(spark, d).select("tool", "user_id")
    missing = legs.exceptAll(early.distinct()).withColumn("part", F.lit("missing"))
    return missing.unionByName(legs.intersect(early).withColumn("part", F.lit("present")))
