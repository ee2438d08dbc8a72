"""Stand-in views: the given tables read as campaign data, in Spark and in SQL.

`SQL` holds the same definitions for a single-node SQL engine; `with_views`
prefixes the ones a query needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HORIZON_HOURS = 720.0
STEP_MIN = 360.0
TYPES = ("view", "click", "error", "purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _event_name() -> Column:
    idx = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1
    digit = F.col("k") % 10
    own = (digit == idx) | ((F.col("event_type") == "click") & (digit == 6))
    k = F.col("k").cast("string")
    return F.when(own, F.concat(F.lit("only_"), F.col("event_type"), F.lit("_"), k)).otherwise(
        F.concat(F.lit("inv_"), k)
    )


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", _k())
        .withColumn("us", micros("ts"))
        .withColumn("event", _event_name())
    )


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = base_events(spark, sf_dir)
    origin = table(spark, sf_dir, "events").select(F.min(micros("ts"))).scalar()
    return raw.select(
        "event_id",
        F.lit("r1").alias("run_id"),
        F.concat(F.lit("i-"), F.col("user_id").cast("string")).alias("instance_id"),
        F.col("event_type").alias("tool"),
        F.concat(F.col("event_type"), F.lit("-v1")).alias("tool_label"),
        "event",
        ((F.col("us") - origin) / F.lit(1e6)).alias("elapsed_seconds"),
        F.lit("table").alias("source"),
        F.lit("").alias("log_path"),
        "user_id",
        "k",
        "value",
        "us",
    )


def v_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_events(spark, sf_dir).select(
        "event_id", "run_id", "instance_id", "tool", "tool_label", "elapsed_seconds",
        F.col("value").alias("tx_per_second"),
        F.when(F.col("k") % 3 != 0, F.col("value") * F.col("k")).alias("gas_per_second"),
        F.when(F.col("k") % 5 != 0, F.col("k").cast("double")).alias("coverage_proxy"),
        F.concat(F.lit("s"), (F.col("k") % 4).cast("string")).alias("source"),
    )


def v_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.col("event_type")
    return base_events(spark, sf_dir).select(
        F.when(tool == "view", "main").when(tool == "click", "feature").otherwise(tool).alias("approach"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("target_label"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string"))).alias("suite_test"),
        F.concat(F.lit("seed-"), F.col("user_id").cast("string")).alias("trial_id"),
        F.col("event").alias("edge"),
    )


def v_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows: two targets so that their ids never clash."""
    ev = base_events(spark, sf_dir)
    k = F.col("k")
    keep = (k < 22) & ~((F.col("event_type") == "signup") & (k % 2 == 1))
    return ev.where(keep).select(
        F.col("event_type").alias("tool"),
        "event",
        F.when(k < 20, "known_bug").otherwise("canary").alias("finding_class"),
        F.when(k < 20, F.concat(F.lit("bug-"), F.floor(k / 2).cast("string")))
        .otherwise(F.concat(F.lit("canary-"), k.cast("string")))
        .alias("entry_id"),
    ).distinct()


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_custkey").cast("string").alias("benchmark_uuid"),
        F.floor(micros("o_orderdate") / 1_000_000).alias("started_epoch"),
        (F.lit(24) + F.col("o_orderkey") % 48).cast("double").alias("timeout_hours"),
        (F.col("o_orderstatus") == "P").alias("superseded"),
        F.when(kind == "1", "analysis").when(kind == "2", "reports").otherwise("missing").alias("analysis_kind"),
        F.col("o_totalprice").alias("price"),
    )


def v_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supp, nation = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * (
        F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    )
    return (
        line.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("service"),
            F.col("l_shipdate").cast("date").alias("day"),
            F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).cast("decimal(18,4)").alias("cost"),
        )
    )


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per (instance, tool): one falsified-test line per event, in time order."""
    return base_events(spark, sf_dir).select(
        F.lit("r1").alias("run_id"),
        F.concat(F.lit("i-"), F.col("user_id").cast("string")).alias("instance_id"),
        F.col("event_type").alias("tool"),
        F.concat(F.col("event_type"), F.lit("-v1")).alias("tool_label"),
        F.concat(F.lit("i-"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".log")).alias("log_path"),
        F.floor(F.col("us") / 86_400_000_000).alias("block"),
        F.struct(F.col("us").alias("a"), F.col("event_id").alias("b")).alias("pos"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"),
        "event", "k", "value", "us", "event_id", "user_id",
    )


EV = """CASE WHEN k % 10 = CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2
        WHEN 'purchase' THEN 3 ELSE 4 END OR (event_type = 'click' AND k % 10 = 6)
      THEN 'only_' || event_type || '_' || k ELSE 'inv_' || k END"""

SQL = {
    "b_events": f"""SELECT *, epoch_us(ts) AS us, {EV} AS event FROM
        (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "v_events": """SELECT event_id, 'r1' AS run_id, 'i-' || user_id AS instance_id, event_type AS tool,
        event_type || '-v1' AS tool_label, event, user_id, k, value, us,
        (us - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS elapsed_seconds FROM b_events""",
    "v_samples": """SELECT event_id, run_id, instance_id, tool, tool_label, elapsed_seconds,
        value AS tx_per_second, CASE WHEN k % 3 <> 0 THEN value * k END AS gas_per_second,
        CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS coverage_proxy, 's' || (k % 4) AS source FROM v_events""",
    "v_edges": """SELECT CASE event_type WHEN 'view' THEN 'main' WHEN 'click' THEN 'feature' ELSE event_type END AS approach,
        't' || (user_id % 3) AS target_label,
        CASE WHEN event_id % 4 <> 0 THEN 's' || (event_id % 2) END AS suite_test,
        'seed-' || user_id AS trial_id, event AS edge FROM b_events""",
    "v_alias": """SELECT DISTINCT event_type AS tool, event,
        CASE WHEN k < 20 THEN 'known_bug' ELSE 'canary' END AS finding_class,
        CASE WHEN k < 20 THEN 'bug-' || (k // 2) ELSE 'canary-' || k END AS entry_id
        FROM b_events WHERE k < 22 AND NOT (event_type = 'signup' AND k % 2 = 1)""",
    "v_runs": """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_custkey AS VARCHAR) AS benchmark_uuid,
        epoch_us(o_orderdate) // 1000000 AS started_epoch, CAST(24 + o_orderkey % 48 AS DOUBLE) AS timeout_hours,
        o_orderstatus = 'P' AS superseded,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'analysis' WHEN '2' THEN 'reports' ELSE 'missing' END AS analysis_kind,
        o_totalprice AS price FROM orders""",
    "v_cost": """SELECT n_name AS service, CAST(l_shipdate AS DATE) AS day,
        CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(12,2))
          * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS cost
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    # --- derived steps several queries share ---
    "first_times": """SELECT tool, tool_label, run_id, instance_id, event, min(elapsed_seconds) AS elapsed_seconds
        FROM v_events GROUP BY ALL""",
    "curve": """SELECT tool, run_id, instance_id, elapsed_seconds / 3600.0 AS time_hours,
          row_number() OVER (PARTITION BY tool, run_id, instance_id ORDER BY elapsed_seconds) AS found FROM first_times
        UNION ALL SELECT DISTINCT tool, run_id, instance_id, 0.0, 0 FROM v_events""",
    "grid": """SELECT s.tool, s.run_id, s.instance_id, s.step_no, s.time_hours, coalesce(c.found, 0) AS found FROM
          (SELECT tool, run_id, instance_id, CAST(i AS INTEGER) AS step_no, i * CAST(6.0 AS DOUBLE) AS time_hours
           FROM (SELECT DISTINCT tool, run_id, instance_id FROM v_events), range(121) r(i)) s
        ASOF LEFT JOIN (SELECT tool, run_id, instance_id, time_hours, max(found) AS found FROM curve GROUP BY ALL) c
          ON s.tool = c.tool AND s.run_id = c.run_id AND s.instance_id = c.instance_id AND s.time_hours >= c.time_hours""",
    "bands": """SELECT tool, step_no, time_hours, count(*) AS runs, max(found) AS top,
          quantile_cont(CAST(found AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(found AS DOUBLE), 0.5) AS p50,
          quantile_cont(CAST(found AS DOUBLE), 0.75) AS p75 FROM grid GROUP BY ALL""",
    "campaign_edges": """SELECT DISTINCT campaign, approach, trial_id, edge FROM (
          SELECT 'combined' AS campaign, * FROM v_edges
          UNION ALL SELECT 'by_target/' || target_label, * FROM v_edges
          UNION ALL SELECT 'by_test/' || suite_test, * FROM v_edges WHERE suite_test IS NOT NULL
          UNION ALL SELECT 'by_target/' || target_label || '/by_test/' || suite_test, * FROM v_edges WHERE suite_test IS NOT NULL)""",
}

_NEEDS = {
    "v_events": ("b_events",),
    "v_samples": ("v_events",),
    "v_edges": ("b_events",),
    "v_alias": ("b_events",),
    "first_times": ("v_events",),
    "curve": ("first_times",),
    "grid": ("curve",),
    "bands": ("grid",),
    "campaign_edges": ("v_edges",),
}


def with_views(names: str, body: str, extra: str = "") -> str:
    """`WITH` clause for the named views (and what they need), then the query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in ordered]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
