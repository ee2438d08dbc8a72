"""Queries on the run index, checkpoints, costs, manifests and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import cost as C
from ..operators import quality as Q
from ..operators import runs as R
from ..sources import coverage_maps, manifest, tables
from .registry import query
from .views import base_events, table, v_alias, v_cost, v_runs, with_views

NOW = 946_684_800  # 2000-01-01
MID = 897_868_800  # 1998-06-15


def _complete(spark, d):
    runs = v_runs(spark, d)
    markers = runs.where("superseded").select(*R.RUN)
    published = runs.where(F.col("analysis_kind") != "missing").select(*R.RUN, F.col("analysis_kind").alias("place"))
    return R.complete_runs(runs.drop("analysis_kind", "superseded", "price"), markers, published, NOW)


_DONE = f"""done AS (SELECT run_id, benchmark_uuid, started_epoch, timeout_hours, analysis_kind,
  CASE analysis_kind WHEN 'missing' THEN 'Missing analysis' WHEN 'reports' THEN 'Analyzed (legacy)' ELSE 'Analyzed' END AS status
  FROM v_runs WHERE NOT superseded AND {NOW} >= started_epoch + CAST(timeout_hours * 3600 AS BIGINT) + 3600)"""


@query("R2 R3 J14 J16", with_views("v_runs", "SELECT * FROM done", _DONE))
def complete_runs(spark, d):
    return _complete(spark, d)


@query(
    "T2 R4",
    with_views(
        "v_runs",
        "SELECT run_id, benchmark_uuid, started_epoch, timeout_hours, analysis_kind, status FROM (SELECT *, row_number() OVER (PARTITION BY benchmark_uuid ORDER BY started_epoch DESC, run_id DESC) AS r FROM done) WHERE r = 1",
        _DONE,
    ),
)
def latest_runs(spark, d):
    return R.latest_per(_complete(spark, d), ["benchmark_uuid"], ["started_epoch", "run_id"])


@query(
    "R4",
    with_views("v_runs", "SELECT run_id, benchmark_uuid, started_epoch, CAST(row_number() OVER (PARTITION BY benchmark_uuid ORDER BY started_epoch DESC, run_id DESC) AS INTEGER) AS age_rank FROM done", _DONE),
)
def benchmark_history(spark, d):
    return R.history(_complete(spark, d)).select("run_id", "benchmark_uuid", "started_epoch", "age_rank")


@query(
    "R1",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN nullif(o_orderkey, 0) WHEN 1 THEN o_custkey + 5 END AS started_epoch FROM orders""",
)
def start_epochs(spark, d):
    k = F.col("o_orderkey")
    explicit = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(F.lit(" "), (F.col("o_custkey") + 5).cast("string"))).when(k % 4 == 2, "soon").otherwise("-7")
    return table(spark, d, "orders").select("o_orderkey", R.started_epoch(k.cast("string"), explicit).alias("started_epoch"))


@query(
    "R5",
    """SELECT run_id, tool, CASE tool WHEN 'echidna' THEN CASE WHEN k % 3 = 0 THEN 'ci:' || substr(h, 1, 7) ELSE 'v' || k END
         WHEN 'foundry' THEN CASE WHEN k % 2 = 0 THEN 'git:' || substr(h, 1, 7) ELSE '1.' || k END WHEN 'recon-fuzzer' THEN 'r' || k END AS version
       FROM (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h, unnest(['echidna', 'foundry', 'recon-fuzzer', 'other']) AS tool FROM orders)""",
)
def tool_versions(spark, d):
    k = F.col("o_orderkey")
    h = F.md5(k.cast("string"))
    fields = F.create_map(
        F.lit("echidna_version"), F.when(k % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("v"), k.cast("string"))),
        F.lit("echidna_ci_commit"), h,
        F.lit("foundry_version"), F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("1."), k.cast("string"))),
        F.lit("foundry_git_ref"), h,
        F.lit("recon_version"), F.concat(F.lit("r"), k.cast("string")),
    )
    keys = F.array(*[F.lit(t) for t in ("echidna", " foundry", "recon-fuzzer", "other", "echidna")])
    return R.tool_versions(table(spark, d, "orders").select(k.cast("string").alias("run_id"), keys.alias("fuzzer_keys"), fields.alias("fields")))


@query(
    "R6",
    with_views(
        "v_runs",
        f"""SELECT run_id, CASE WHEN active = 0 AND expected > 0 AND archives >= expected THEN 'terminal-artifacts'
             WHEN active = 0 AND {MID} >= started_epoch + CAST(timeout_hours * 3600 AS BIGINT) + 10800 AND {MID} - greatest(started_epoch, coalesce(heartbeat, 0)) >= 1800 THEN 'orphan-deadline' END AS state
           FROM (SELECT *, k % 4 AS archives, k % 3 AS expected, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS active, CASE WHEN k % 2 = 0 THEN {MID} - k END AS heartbeat
             FROM (SELECT *, CAST(run_id AS BIGINT) AS k FROM v_runs))""",
    ),
)
def run_lifecycle(spark, d):
    k = F.col("run_id").cast("bigint")
    rows = v_runs(spark, d).select(
        "run_id", "started_epoch", "timeout_hours", (k % 4).alias("archives"), (k % 3).alias("expected"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("active"), F.lit(None).cast("bigint").alias("updated_epoch"),
        F.when(k % 2 == 0, F.lit(MID) - k).alias("heartbeat_epoch"),
    )
    return rows.select("run_id", R.lifecycle(rows, MID).alias("state"))


def _keys(spark, d):
    o = table(spark, d, "orders")
    name = F.when(F.col("o_orderstatus") == "P", "superseded.json").when(F.col("o_orderstatus") == "F", "manifest.json").otherwise("notes.txt")
    path = F.concat_ws("/", F.lit("runs"), F.concat(F.lit("r."), F.col("o_orderkey").cast("string")), F.md5(F.col("o_custkey").cast("string")), name)
    return o.select(path.alias("path"))


@query("S9", "SELECT 'r.' || o_orderkey AS run_id, md5(CAST(o_custkey AS VARCHAR)) AS benchmark_uuid FROM orders WHERE o_orderstatus = 'F'")
def run_key_index(spark, d):
    return tables.run_keys(_keys(spark, d)).drop("path")


@query("J14 S9", "SELECT 'r.' || o_orderkey AS run_id, md5(CAST(o_custkey AS VARCHAR)) AS benchmark_uuid FROM orders WHERE o_orderstatus = 'P'")
def superseded_index(spark, d):
    return tables.superseded_keys(_keys(spark, d))


@query(
    "J15 P16",
    """SELECT run_id, CASE WHEN ok THEN 't-' || s END AS target_id, CASE WHEN k % 7 = 0 THEN 'run manifest has no target_repo_url' WHEN k % 9 = 0 THEN 'run manifest has no target_commit'
         WHEN k % 5 = 0 THEN 'run repository is not in the active target manifest' WHEN s % 4 = 0 THEN 'target has no ground-truth catalog entry'
         WHEN k % 11 = 0 THEN 'run commit is not the cataloged revision' ELSE 'matched run repository and commit' END AS reason
       FROM (SELECT *, k % 7 <> 0 AND k % 9 <> 0 AND k % 5 <> 0 AND s % 4 <> 0 AND k % 11 <> 0 AS ok FROM
         (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey AS k, o_custkey % (SELECT count(*) FROM supplier) AS s FROM orders))""",
)
def resolved_targets(spark, d):
    supp = table(spark, d, "supplier")
    s = F.col("s_suppkey")
    repo = F.concat(F.lit("https://git.example/o/R"), s.cast("string"))
    targets = supp.select(F.concat(F.lit("t-"), s.cast("string")).alias("id"), repo.alias("repo"))
    catalog = supp.where(s % 4 != 0).select(F.concat(F.lit("t-"), s.cast("string")).alias("target_id"), F.md5(s.cast("string")).alias("target_commit"))
    k, n = F.col("o_orderkey"), supp.agg(F.count(F.lit(1))).scalar()
    own = (F.col("o_custkey") % n).cast("string")
    runs = table(spark, d, "orders").select(
        k.cast("string").alias("run_id"),
        F.when(k % 7 == 0, "").when(k % 5 == 0, "https://git.example/x").otherwise(F.concat(F.lit("HTTPS://git.example/o/r"), own, F.lit(".git/"))).alias("target_repo_url"),
        F.when(k % 9 == 0, " ").when(k % 11 == 0, "beef").otherwise(F.md5(own)).alias("target_commit"),
    )
    return R.resolve_targets(runs, targets, catalog)


@query(
    "J17",
    """SELECT 'nation without supplier' AS rule, CAST(n_nationkey AS VARCHAR) AS key, '' AS detail FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
       UNION ALL SELECT 'order without customer', CAST(k AS VARCHAR), '' FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer)""",
)
def foreign_keys(spark, d):
    a = Q.absent(table(spark, d, "nation"), table(spark, d, "supplier"), "nation without supplier", "n_nationkey", "s_nationkey")
    doubled = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("k"))
    return a.unionByName(Q.absent(doubled, table(spark, d, "customer"), "order without customer", "k", "c_custkey"))


# --- checkpoints ---------------------------------------------------------------------------


def _by_run(rows, count):
    """Rows dealt by run to tasks of about 250 000 rows, however many a file or the session's partitions hold."""
    return rows.repartition(max(1, -(-count // 250_000)), "run_id")


def _live(spark, d):
    k = F.col("run_id").cast("bigint")
    return _by_run(v_runs(spark, d), table(spark, d, "orders").count()).select(
        *R.RUN, "started_epoch", "timeout_hours", F.lit(14400).alias("interval_seconds"), (k % 5 != 0).alias("enabled"), F.col("superseded").alias("finalized")
    )


def _snapshots(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("checkpoint"), "l_returnflag")
    return line.join(v_runs(spark, d).select(*R.RUN), "run_id")


@query(
    "ST3 ST4",
    with_views(
        "v_runs",
        f"""SELECT run_id, benchmark_uuid, checkpoint, started_epoch, timeout_hours, 14400 AS interval_seconds, true AS enabled, false AS finalized FROM newest
            WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE CAST(l.l_orderkey AS VARCHAR) = newest.run_id AND l.l_linenumber = checkpoint AND l_returnflag = 'R')""",
        f"""live AS (SELECT *, floor(({MID} - started_epoch - 300) / 14400.0) AS settled FROM v_runs WHERE CAST(run_id AS BIGINT) % 5 <> 0 AND NOT superseded
              AND {MID} >= started_epoch AND {MID} < started_epoch + CAST(timeout_hours * 3600 AS BIGINT)),
            newest AS (SELECT run_id, benchmark_uuid, started_epoch, timeout_hours, CAST(max(l_linenumber) AS BIGINT) AS checkpoint FROM live JOIN lineitem ON CAST(l_orderkey AS VARCHAR) = run_id
              WHERE settled >= 1 AND l_linenumber <= settled GROUP BY ALL)""",
    ),
)
def due_checkpoints(spark, d):
    snaps = _snapshots(spark, d)
    published = snaps.where(F.col("l_returnflag") == "R").select(*R.RUN, "checkpoint").distinct()
    return R.select_checkpoints(snaps.select(*R.RUN, "checkpoint").distinct(), published, _live(spark, d), MID)


_TOOLS = ("A", "N", "R")


def _captures(spark, d):
    line, runs = table(spark, d, "lineitem"), _live(spark, d)
    rows = line.select(
        F.col("l_orderkey").cast("string").alias("run_id"), (F.col("l_linenumber") % 3 + 1).cast("bigint").alias("checkpoint"),
        F.col("l_returnflag").alias("tool"), (F.col("l_suppkey") % 2).cast("int").alias("run_index"), (F.col("l_partkey") % 400).alias("late"),
    )
    rows = _by_run(rows, line.count()).join(runs.select(*R.RUN, "started_epoch", "interval_seconds"), "run_id")
    return rows.withColumn("captured_epoch", F.col("started_epoch") + F.col("checkpoint") * F.col("interval_seconds") + F.col("late"))


def _legs(spark, d):
    tools = F.explode(F.array(*[F.lit(t) for t in _TOOLS])).alias("tool")
    return _live(spark, d).select(*R.RUN, tools).select(*R.RUN, "tool", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("run_index"))


def _sets(spark, d):
    cap = _captures(spark, d).select(*R.RUN, "checkpoint", "tool", "run_index", "captured_epoch")
    return R.snapshot_sets(cap, _legs(spark, d), _live(spark, d))


_SETS = """cap AS (SELECT run_id, benchmark_uuid, started_epoch, timeout_hours, CAST(l_linenumber % 3 + 1 AS BIGINT) AS checkpoint, l_returnflag AS tool, CAST(l_suppkey % 2 AS INTEGER) AS run_index,
    started_epoch + (l_linenumber % 3 + 1) * 14400 + l_partkey % 400 AS at FROM lineitem JOIN v_runs ON CAST(l_orderkey AS VARCHAR) = run_id),
  ss AS (SELECT run_id, benchmark_uuid, checkpoint, CAST(6 AS BIGINT) AS expected, count(DISTINCT (tool, run_index)) AS present, 6 - count(DISTINCT (tool, run_index)) AS missing,
    started_epoch + checkpoint * 14400 AS scheduled_epoch, min(at) AS capture_start, max(at) AS capture_end, max(at) AS as_of_epoch, max(at) - started_epoch AS elapsed_seconds,
    CAST(timeout_hours * 3600 AS BIGINT) AS planned_seconds, true AS incomplete, true AS non_terminal FROM cap GROUP BY run_id, benchmark_uuid, checkpoint, started_epoch, timeout_hours)""".replace(" AS at ", " AS cat ").replace("(at)", "(cat)")


@query("ST5 E3", with_views("v_runs", "SELECT * FROM ss", _SETS))
def snapshot_sets(spark, d):
    return _sets(spark, d)


@query(
    "ST5 J12",
    with_views(
        "v_runs",
        """SELECT run_id, benchmark_uuid, checkpoint, tool, CAST(run_index AS INTEGER) AS run_index FROM (SELECT DISTINCT run_id, benchmark_uuid, checkpoint FROM cap), (SELECT unnest(['A', 'N', 'R']) AS tool), (SELECT unnest([0, 1]) AS run_index)
           EXCEPT SELECT run_id, benchmark_uuid, checkpoint, tool, run_index FROM cap""",
        _SETS,
    ),
)
def missing_legs(spark, d):
    return R.missing_legs(_captures(spark, d).select(*R.RUN, "checkpoint", "tool", "run_index"), _legs(spark, d))


@query(
    "ST6",
    with_views("v_runs", "SELECT run_id, checkpoint, CASE WHEN checkpoint * 43200 < timeout_hours * 3600 THEN checkpoint * 43200 / 3600.0::DOUBLE END AS budget_hours FROM (SELECT DISTINCT run_id, checkpoint, timeout_hours FROM cap)", _SETS),
)
def checkpoint_budgets(spark, d):
    sets = _captures(spark, d).select("run_id", "checkpoint").distinct().join(_live(spark, d).select("run_id", "timeout_hours"), "run_id")
    return R.horizon_hours(sets.withColumn("interval_seconds", F.lit(43200))).select("run_id", "checkpoint", "budget_hours")


@query(
    "D5",
    with_views(
        "v_runs",
        """SELECT 'capture window is too wide' AS rule, run_id || '/' || checkpoint AS key, CAST(capture_end - capture_start AS VARCHAR) AS detail FROM ss WHERE capture_end - capture_start > 300
           UNION ALL SELECT 'elapsed exceeds the plan', run_id || '/' || checkpoint, '' FROM ss WHERE elapsed_seconds * 3 > planned_seconds""",
        _SETS,
    ),
)
def snapshot_set_checks(spark, d):
    sets = _sets(spark, d).withColumn("elapsed_seconds", F.col("elapsed_seconds") * 3)
    return Q.dq_report(sets, Q.snapshot_set_rules(), F.concat_ws("/", F.col("run_id"), F.col("checkpoint").cast("string")))


@query(
    "D4 P36",
    """SELECT r.rule, key, CASE r.rule WHEN 'timeout is out of range' THEN CAST(CAST(t AS DOUBLE) AS VARCHAR) WHEN 'interval is out of range' THEN CAST(i AS VARCHAR) WHEN 'disabled interval is not zero' THEN CAST(i AS VARCHAR)
          WHEN 'instances are out of range' THEN CAST(n AS VARCHAR) ELSE '' END AS detail FROM
       (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey % 80 AS t, o_orderkey % 100 AS i, o_orderkey % 3 <> 0 AS e, o_custkey % 22 AS n, o_orderkey % 6 AS f FROM orders),
       (SELECT unnest(['timeout is out of range', 'interval is out of range', 'disabled interval is not zero', 'instances are out of range', 'tool list is empty', 'tool list repeats', 'tool name is unsafe']) AS rule) r
       WHERE CASE r.rule WHEN 'timeout is out of range' THEN t NOT BETWEEN 1 AND 72 WHEN 'interval is out of range' THEN e AND i < 60 WHEN 'disabled interval is not zero' THEN NOT e AND i <> 0
         WHEN 'instances are out of range' THEN n NOT BETWEEN 1 AND 20 WHEN 'tool list is empty' THEN f = 0 WHEN 'tool list repeats' THEN f = 1 ELSE f = 2 END""",
)
def run_manifest_checks(spark, d):
    k = F.col("o_orderkey")
    tools = F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 6 == 1, F.array(F.lit("a"), F.lit("a"))).when(k % 6 == 2, F.array(F.lit("a b"))).otherwise(F.array(F.lit("echidna"), F.lit("medusa")))
    rows = table(spark, d, "orders").select(
        k.cast("string").alias("run_id"), F.md5(k.cast("string")).alias("benchmark_uuid"), F.lit(1_700_000_000).alias("started_epoch"),
        (k % 80).cast("double").alias("timeout_hours"), (k % 100).alias("interval_seconds"), (k % 3 != 0).alias("enabled"),
        tools.alias("fuzzer_keys"), (F.col("o_custkey") % 22).alias("instances_per_fuzzer"),
    )
    return Q.dq_report(rows, Q.manifest_rules(), F.col("run_id"))


@query(
    "D4",
    """SELECT rule, key, '' AS detail FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS k, o_custkey AS c FROM orders),
       (SELECT unnest(['reason is missing', 'no replacement', 'replaces itself', 'issue is out of range', 'manifest hash is not valid']) AS rule)
       WHERE CASE rule WHEN 'reason is missing' THEN k % 4 = 0 WHEN 'no replacement' THEN k % 5 = 0 WHEN 'replaces itself' THEN k % 5 = 1 WHEN 'issue is out of range' THEN k % 5 <> 0 AND c % 10 = 0 ELSE k % 7 = 0 END""",
)
def superseded_marker_checks(spark, d):
    k = F.col("o_orderkey")
    rid = k.cast("string")
    rows = table(spark, d, "orders").select(
        rid.alias("run_id"), rid.alias("key_run_id"), F.lit("u").alias("benchmark_uuid"), F.lit("u").alias("key_uuid"),
        F.when(k % 4 == 0, " ").otherwise("bad build").alias("reason"),
        F.when(k % 5 == 1, rid).alias("replacement_run_id"), F.when(k % 5 != 0, F.col("o_custkey") % 10).alias("replacement_issue"),
        F.lit(5).alias("superseded_at_epoch"), F.substring(F.sha2(rid, 256), 1, 40).alias("suite_commit"),
        F.when(k % 7 == 0, "x").otherwise(F.sha2(rid, 256)).alias("manifest_sha256"),
    )
    return Q.dq_report(rows, Q.superseded_rules(), F.col("run_id"))


def _target_list(spark, d):
    s = F.col("s_suppkey")
    repo_no = F.when(s % 10 == 9, s - 1).otherwise(s).cast("string")
    return table(spark, d, "supplier").select(
        F.when(s % 6 == 0, F.concat(F.lit("T_"), s.cast("string"))).otherwise(F.concat(F.lit("t-"), s.cast("string"))).alias("id"),
        F.col("s_name").alias("label"),
        F.concat(F.lit("https://github.com/o/r"), repo_no, F.when(s % 8 == 0, ".git").otherwise("")).alias("repo"),
        F.substring(F.sha2(s.cast("string"), 256), 1, 40).alias("commit"),
        F.when(s % 5 == 0, "/abs/P.sol").when(s % 5 == 1, "a//P.sol").when(s % 5 == 2, "a/P.txt").otherwise("test/P.sol").alias("properties_path"),
        F.when(s % 9 == 0, F.lit(None)).otherwise("why").alias("rationale"), F.lit("group-a").alias("overlap_group"), F.lit("n").alias("overlap_notes"),
    )


_LIST = """tl AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 6 = 0 THEN 'T_' ELSE 't-' END || s_suppkey AS id,
   'https://github.com/o/r' || (CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 1 ELSE s_suppkey END) || CASE WHEN s_suppkey % 8 = 0 THEN '.git' ELSE '' END AS repo,
   CASE s_suppkey % 5 WHEN 0 THEN '/abs/P.sol' WHEN 1 THEN 'a//P.sol' WHEN 2 THEN 'a/P.txt' ELSE 'test/P.sol' END AS path FROM supplier)"""


@query(
    "D2",
    with_views(
        "",
        """SELECT 'id is not a slug' AS rule, id AS key, '' AS detail FROM tl WHERE s % 6 = 0 UNION ALL SELECT 'repo is not canonical', id, repo FROM tl WHERE s % 8 = 0
           UNION ALL SELECT 'properties path is not valid', id, path FROM tl WHERE s % 5 < 3 UNION ALL SELECT 'rationale is empty', id, '' FROM tl WHERE s % 9 = 0
           UNION ALL SELECT 'repo occurs twice', lower(repo), CAST(count(*) AS VARCHAR) FROM tl GROUP BY lower(repo) HAVING count(*) > 1""",
        _LIST,
    ),
)
def target_list_checks(spark, d):
    return Q.target_list_report(_target_list(spark, d))


@query(
    "D1 J17",
    with_views(
        "",
        """SELECT 'target id is not a slug' AS rule, id AS key, '' AS detail FROM tl WHERE s % 6 = 0 AND s % 3 <> 2
           UNION ALL SELECT 'target commit differs from the target list', id, h FROM tc WHERE s % 7 = 0 AND s % 3 <> 2
           UNION ALL SELECT 'target notes are empty', id, '' FROM tl WHERE s % 4 = 0 AND s % 3 <> 2
           UNION ALL SELECT 'target list entry has no catalog', id, '' FROM tl WHERE s % 3 = 2
           UNION ALL SELECT 'entry kind is unknown', ekey, 'rumour' FROM en WHERE kind = 'rumour'
           UNION ALL SELECT 'entry has no pinned evidence', ekey, '' FROM en WHERE p % 5 = 0
           UNION ALL SELECT 'evidence url is not https', ekey, 'http://x/y' FROM en WHERE p % 5 = 0
           UNION ALL SELECT 'alias event is not canonical', ekey, 'f_ASSERTION_' || p FROM en WHERE p % 6 = 0
           UNION ALL SELECT 'alias tool is unknown', ekey, 'afl' FROM en WHERE p % 11 = 0
           UNION ALL SELECT 'alias occurs twice', id || '/' || CASE WHEN p % 11 = 0 THEN 'afl' ELSE 'medusa' END || '/' || CASE WHEN p % 6 = 0 THEN 'f_ASSERTION_' || p ELSE 'f' END, CAST(count(*) AS VARCHAR)
             FROM en GROUP BY id, CASE WHEN p % 11 = 0 THEN 'afl' ELSE 'medusa' END, CASE WHEN p % 6 = 0 THEN 'f_ASSERTION_' || p ELSE 'f' END HAVING count(*) > 1""",
        _LIST
        + """, tc AS (SELECT *, substr(sha256(CAST(s AS VARCHAR)), 1, 40) AS h FROM tl),
        en AS (SELECT p_partkey AS p, id, id || '/known_bug/e-' || p_partkey AS ekey, CASE p_partkey % 3 WHEN 0 THEN 'rumour' ELSE 'documented-known-issue' END AS kind
          FROM part JOIN tl ON p_partkey % (SELECT count(*) FROM supplier) = s WHERE s % 3 <> 2)""",
    ),
)
def catalog_checks(spark, d):
    listed = _target_list(spark, d)
    s = F.col("s_suppkey")
    supp = table(spark, d, "supplier").where(s % 3 != 2)
    tid = F.when(s % 6 == 0, F.concat(F.lit("T_"), s.cast("string"))).otherwise(F.concat(F.lit("t-"), s.cast("string")))
    good = F.substring(F.sha2(s.cast("string"), 256), 1, 40)
    targets = supp.select(
        tid.alias("target_id"), F.when(s % 7 == 0, F.reverse(good)).otherwise(good).alias("target_commit"), F.when(s % 4 == 0, "").otherwise("n").alias("notes"), "s_suppkey"
    )
    p, n = F.col("p_partkey"), table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    base = table(spark, d, "part").withColumn("_s", p % n).join(targets, F.col("_s") == s).join(listed.select(F.col("id").alias("target_id"), "repo"), "target_id")
    e = base.select("target_id", F.lit("known_bug").alias("class"), F.concat(F.lit("e-"), p.cast("string")).alias("id"), p.alias("p"), "repo", "target_commit")
    entries = e.select("target_id", "class", "id", F.lit("t").alias("title"), F.when(F.col("p") % 3 == 0, "rumour").otherwise("documented-known-issue").alias("kind"))
    pinned = F.concat_ws("/", "repo", F.lit("blob"), "target_commit", F.lit("src/A.sol#L1-L9"))
    evidence = e.select("target_id", "class", "id", F.when(F.col("p") % 5 == 0, "http://x/y").otherwise(pinned).alias("url"), F.lit("d").alias("description"))
    aliases = e.select(
        "target_id", "class", "id", F.when(F.col("p") % 6 == 0, F.concat(F.lit("f_ASSERTION_"), F.col("p").cast("string"))).otherwise("f").alias("event"),
        F.when(F.col("p") % 11 == 0, "afl").otherwise("medusa").alias("tool"),
    )
    return Q.catalog_report(targets.drop("s_suppkey"), entries, evidence, aliases, listed)


# --- costs -----------------------------------------------------------------------------------


@query(
    "A34",
    with_views(
        "v_cost",
        """SELECT month, service, cost, CASE WHEN total > 0 THEN round(CAST(cost AS DOUBLE) / CAST(total AS DOUBLE) * 100.0::DOUBLE, 4) ELSE 0 END AS share_pct FROM
             (SELECT CAST(date_trunc('month', day) AS DATE) AS month, service, CAST(sum(cost) AS DECIMAL(28,4)) AS cost FROM v_cost GROUP BY ALL)
             JOIN (SELECT CAST(date_trunc('month', day) AS DATE) AS month, sum(cost) AS total FROM v_cost GROUP BY ALL) USING (month) WHERE cost <> 0""",
    ),
)
def service_costs(spark, d):
    return C.service_months(v_cost(spark, d))


_TODAY = dt.date(2001, 12, 5)


@query(
    "A34",
    with_views(
        "v_cost",
        """SELECT coalesce(m.month, c.month) AS month, coalesce(total, 0) AS total, coalesce(tax, 0) AS tax, coalesce(m.month, c.month) = DATE '2001-12-01' AS estimated FROM
             (SELECT CAST(date_trunc('month', day) AS DATE) AS month, sum(cost) AS total, sum(cost) FILTER (service = 'NATION_3') AS tax FROM v_cost WHERE day >= DATE '2000-12-01' AND day < DATE '2002-01-01' GROUP BY 1) m
             FULL JOIN (SELECT DATE '2001-12-01' AS month) c ON m.month = c.month""",
    ),
)
def month_costs(spark, d):
    ledger = v_cost(spark, d).withColumn("service", F.when(F.col("service") == "NATION_3", "Tax").otherwise(F.col("service")))
    return C.month_totals(ledger, _TODAY, 12)


@query("A34", with_views("v_cost", "SELECT service, CAST(sum(cost) AS DECIMAL(28,4)) AS cost FROM v_cost GROUP BY service HAVING sum(cost) > 0"))
def top_services(spark, d):
    return C.top_services(v_cost(spark, d))


@query("A34", with_views("v_cost", "SELECT day, CAST(sum(cost) AS DECIMAL(28,4)) AS total FROM v_cost WHERE day >= DATE '1998-05-01' AND day < DATE '1998-06-01' GROUP BY day"))
def daily_costs(spark, d):
    return C.daily(v_cost(spark, d), dt.date(1998, 5, 1))


@query("A35", "SELECT p_brand AS brand, min(CASE WHEN p_size % 4 <> 0 AND p_retailprice > 0 THEN p_retailprice END) AS usd_per_hour FROM part GROUP BY p_brand")
def lowest_prices(spark, d):
    price = F.when(F.col("p_size") % 4 == 0, "0.0000").otherwise(F.col("p_retailprice").cast("string"))
    product = F.concat(
        F.lit('{"terms": {"OnDemand": {"t1": {"priceDimensions": {"d1": {"pricePerUnit": {"USD": "'), price,
        F.lit('"}}, "d2": {"pricePerUnit": {"EUR": "0.01"}}}}}}}'),
    )
    return C.lowest_price(table(spark, d, "part").select(F.col("p_brand").alias("brand"), product.alias("product")))


# --- manifests and shapes ------------------------------------------------------------------------


@query(
    "S12",
    """SELECT path, CASE WHEN i % 11 = 0 AND i % 7 <> 0 THEN 'changed' WHEN i % 7 = 0 THEN 'removed' END AS change FROM (SELECT source || '/' || doc_id AS path, doc_id AS i FROM documents) WHERE i % 7 = 0 OR i % 11 = 0
       UNION ALL SELECT 'new/' || doc_id, 'added' FROM documents WHERE doc_id % 13 = 0""",
)
def tree_changes(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    path = F.concat_ws("/", "source", i.cast("string"))
    before = docs.select(path.alias("path"), F.sha2("text", 256).alias("sha256"))
    text = F.when(i % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = docs.where(i % 7 != 0).select(path.alias("path"), F.sha2(text, 256).alias("sha256")).unionByName(
        docs.where(i % 13 == 0).select(F.concat(F.lit("new/"), i.cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    )
    return manifest.changes(before, after)


@query("S12", "SELECT source || '/' || doc_id AS path, strlen(text) AS size, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256")
    )


_WIDE = [(t, r) for t in ("view", "click", "error", "purchase", "signup") for r in range(3)]


@query(
    "S14",
    with_views(
        "b_events",
        """SELECT tool, CAST(r AS VARCHAR) AS run_id, time_hours, count(*) FILTER (event_type = tool AND user_id % 3 = r AND day = time_hours / 24) AS found
           FROM (SELECT *, us // 86400000000 - 19723 AS day FROM b_events), (SELECT unnest(['view', 'click', 'error', 'purchase', 'signup']) AS tool), range(3) t(r),
             (SELECT DISTINCT CAST((us // 86400000000 - 19723) * 24 AS DOUBLE) AS time_hours FROM b_events) GROUP BY ALL""",
    ),
)
def wide_to_long(spark, d):
    ev = base_events(spark, d).withColumn("time_hours", ((F.floor(F.col("us") / 86_400_000_000) - 19723) * 24).cast("double"))
    cells = [F.count_if((F.col("event_type") == t) & (F.col("user_id") % 3 == r)).alias(f"{t}_run{r}") for t, r in _WIDE]
    wide = ev.groupBy("time_hours").agg(*cells, F.count(F.lit(1)).alias("total"))
    return tables.wide_to_long(wide)


@query(
    "S2",
    with_views("b_events", "SELECT CAST(event_id AS VARCHAR) AS run_id, 'unknown' AS instance_id, event_type AS tool, event_type AS tool_label, event, value AS elapsed_seconds, 'unknown' AS source, 'unknown' AS log_path FROM b_events WHERE k % 4 <> 0"),
)
def lenient_events(spark, d):
    raw = base_events(spark, d).select(
        F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("fuzzer"), "event",
        F.when(F.col("k") % 8 == 0, "soon").when(F.col("k") % 8 == 4, "nan").otherwise(F.col("value").cast("string")).alias("elapsed_seconds"),
    )
    return tables.events_lenient(raw)


@query(
    "S4",
    with_views("b_events", "SELECT event_type AS tool, 'r' AS run_id, CAST(user_id AS VARCHAR) AS instance_id, 'r:' || user_id AS series_id, value / 3600.0::DOUBLE AS time_hours, CASE WHEN k % 3 <> 0 THEN CAST(k AS DOUBLE) END AS rate, '' AS source FROM b_events WHERE k % 5 <> 0"),
)
def sample_table(spark, d):
    raw = base_events(spark, d).select(
        F.col("event_type").alias("fuzzer"), F.lit("r").alias("run_id"), F.col("user_id").cast("string").alias("instance_id"),
        F.when(F.col("k") % 5 == 0, "").otherwise(F.col("value").cast("string")).alias("elapsed_seconds"),
        F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("k").cast("string")).alias("rate"),
    )
    return tables.metric_samples(raw, ["rate"], ["rate"])


@query(
    "S3",
    with_views("b_events", "SELECT 'r' || user_id AS run_id, 'unknown' AS instance_id, event_type AS tool, event_type AS tool_label, event, value AS elapsed_seconds, '' AS source, 'log' AS log_path FROM b_events"),
)
def strict_events(spark, d):
    raw = base_events(spark, d).select(
        F.concat(F.lit(" r"), F.col("user_id").cast("string")).alias("run_id"), F.lit("").alias("instance_id"), F.col("event_type").alias("fuzzer"),
        "event", F.col("value").cast("string").alias("elapsed_seconds"), F.lit(" log ").alias("log_path"),
    )
    return tables.events_strict(raw)


def _map_lines(spark, d):
    """A coverage map per (user, tool, suite): some with a bad line, some with nothing covered."""
    u, k = F.col("user_id"), F.col("k")
    label = F.concat(F.lit("i-"), F.lower(F.hex("user_id")), F.lit("-eng__target-t"), (u % 3).cast("string"), F.lit("__seed-"), u.cast("string"))
    folder = F.concat(F.col("event_type"), F.lit("__s"), (F.col("event_id") % 2).cast("string"))
    count = F.when(u % 10 == 3, 0).when(k % 7 == 0, 0).otherwise(k + 1).cast("string")
    line = F.when((u % 10 == 4) & (k % 2 == 0), F.col("event")).otherwise(F.concat(F.lit(" "), F.col("event"), F.lit(": "), count))
    path = F.concat_ws("/", label, F.lit("out/showmap"), folder, F.lit("trial.txt"))
    return base_events(spark, d).select(path.alias("path"), line.alias("line"))


_MAPS = """ml AS (SELECT user_id AS u, k, event, event_type, event_id % 2 AS s, CASE WHEN user_id % 10 = 3 OR k % 7 = 0 THEN 0 ELSE k + 1 END AS c, user_id % 10 = 4 AND k % 2 = 0 AS bad FROM b_events),
  mj AS (SELECT u, event_type, s, CASE WHEN bool_or(bad) THEN 'malformed line' WHEN NOT bool_or(c > 0 AND NOT bad) THEN 'empty coverage' END AS reason FROM ml GROUP BY ALL)"""


@query(
    "S5 P17 P18 P19",
    with_views(
        "b_events",
        """SELECT DISTINCT 'i-' || lower(to_hex(u)) AS instance_id, 'eng' AS tool_label, 't' || (u % 3) AS target_label, CAST(u AS VARCHAR) AS seed_label, event_type AS approach, 's' || s AS suite_test,
             'seed-' || u AS trial_id, event AS edge FROM ml JOIN mj USING (u, event_type, s) WHERE reason IS NULL AND c > 0""",
        _MAPS,
    ),
)
def coverage_map_edges(spark, d):
    return coverage_maps.judge_maps(_map_lines(spark, d))[1].drop("instance_label", "path")


@query(
    "S5",
    with_views("b_events", "SELECT reason, count(*) AS files FROM mj WHERE reason IS NOT NULL AND event_type <> 'view' GROUP BY reason", _MAPS),
)
def coverage_map_rejects(spark, d):
    rejects = coverage_maps.judge_maps(_map_lines(spark, d), exclude=["VIEW"])[2]
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


@query("S8", with_views("v_alias", "SELECT 'target-' || tool AS target_id, tool, event, finding_class, entry_id FROM v_alias"))
def catalog_aliases(spark, d):
    """A catalog document per alias row, read back through the catalog schema."""
    known = F.col("finding_class") == "known_bug"
    entry = F.concat(
        F.lit('{"id": "'), F.col("entry_id"), F.lit('", "title": "t", "evidence": [{"url": "https://x", "description": "d"}], "aliases": [{"event": "'),
        F.col("event"), F.lit('", "fuzzers": ["'), F.col("tool"), F.lit('"]}]}'),
    )
    doc = F.concat(
        F.lit('{"schema_version": 1, "targets": [{"target_id": "target-'), F.col("tool"), F.lit('", "canaries": ['), F.when(known, "").otherwise(entry),
        F.lit('], "known_bugs": ['), F.when(known, entry).otherwise(""), F.lit("]}]}"),
    )
    docs = v_alias(spark, d).select(F.from_json(doc, tables.CATALOG_SCHEMA).alias("d")).select("d.*")
    return tables.flatten_catalog(docs)["aliases"].select(
        "target_id", "tool", "event", F.col("class").alias("finding_class"), F.col("id").alias("entry_id")
    )


@query(
    "S10",
    """SELECT instance_label, path, CASE WHEN path = min(path) OVER (PARTITION BY instance_label, base) OR NOT contains(path, '/') THEN base ELSE replace(regexp_replace(path, '/[^/]*$', ''), '/', '__') || '__' || base END AS name
       FROM (SELECT source AS instance_label, lang || '/' || doc_id || '/f' || (doc_id % 50) || '.csv' AS path, 'f' || (doc_id % 50) || '.csv' AS base FROM documents)""",
)
def gathered_files(spark, d):
    i = F.col("doc_id")
    path = F.concat_ws("/", "lang", i.cast("string"), F.concat(F.lit("f"), (i % 50).cast("string"), F.lit(".csv")))
    return manifest.gathered_names(table(spark, d, "documents").select(F.col("source").alias("instance_label"), path.alias("path")))
