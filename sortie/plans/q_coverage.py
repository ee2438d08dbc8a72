"""Queries on coverage campaigns and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import coverage as C
from ..operators import curves, stats, verdicts
from ..operators.scoreboard import scoreboard
from ..session import stage
from .registry import query
from .views import HORIZON_HOURS, STEP_MIN, table, v_edges, v_events, with_views


def _ce(spark, d):
    return C.campaigns(C.edge_sets(v_edges(spark, d)))


def _measures(spark, d):
    ce = _pair_edges(spark, d)
    trials = C.trials_of(ce)
    return C.pair_measures(ce, trials, C.baseline_feature(trials))


def _matched(rows, value):
    """Trials present on both sides: x from the feature, y from the baseline."""
    x = F.col("is_x")
    wide = rows.groupBy("campaign", "trial_id").agg(
        F.max(F.when(x, F.col(value))).alias("x"), F.max(F.when(~x, F.col(value))).alias("y")
    )
    return wide.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _pair_edges(spark, d):
    """All event types as two builds: the shape of a build-against-build comparison."""
    main = F.col("approach").isin("main", "error", "signup")
    built = v_edges(spark, d).withColumn("approach", F.when(main, "main").otherwise("feature"))
    return C.campaigns(C.edge_sets(built))


def _round(df, n=9):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else c for c, t in df.dtypes])


_PAIR = """pe AS (SELECT DISTINCT campaign, CASE WHEN approach IN ('main', 'error', 'signup') THEN 'main' ELSE 'feature' END AS approach, trial_id, edge
   FROM campaign_edges)"""


def _score_sql(src: str, p: str) -> str:
    return f"""{p}un AS (SELECT DISTINCT campaign, approach, edge FROM {src}),
  {p}ap AS (SELECT campaign, count(DISTINCT approach) AS a FROM {src} GROUP BY campaign),
  {p}own AS (SELECT campaign, edge, count(*) AS o FROM {p}un GROUP BY ALL),
  {p}ts AS (SELECT e.campaign, e.approach, e.trial_id, CAST(sum(a - o) AS DOUBLE) AS score FROM {src} e JOIN {p}own USING (campaign, edge) JOIN {p}ap USING (campaign) GROUP BY ALL),
  {p}rs AS (SELECT campaign, approach, avg(score) AS relscore FROM {p}ts GROUP BY ALL)"""


def _cov_sql(src: str, p: str) -> str:
    return f"""{p}cu AS (SELECT DISTINCT campaign, approach, edge FROM {src}),
  {p}cs AS (SELECT campaign, approach AS reference, count(*) AS reference_edges FROM {p}cu GROUP BY ALL),
  {p}ov AS (SELECT e.campaign, e.approach, e.trial_id, u.approach AS reference, count(*) AS shared FROM {src} e JOIN {p}cu u ON e.campaign = u.campaign AND e.edge = u.edge GROUP BY ALL),
  {p}rc AS (SELECT t.campaign, t.approach, t.trial_id, s.reference, coalesce(o.shared, 0) AS shared, s.reference_edges, coalesce(o.shared, 0) / s.reference_edges AS relcov
    FROM (SELECT DISTINCT campaign, approach, trial_id FROM {src}) t JOIN {p}cs s ON t.campaign = s.campaign
    LEFT JOIN {p}ov o ON o.campaign = t.campaign AND o.approach = t.approach AND o.trial_id = t.trial_id AND o.reference = s.reference)"""


@query("A6", with_views("campaign_edges", "SELECT campaign, approach, count(*) AS rows, count(DISTINCT trial_id) AS trials FROM campaign_edges GROUP BY ALL"))
def coverage_campaigns(spark, d):
    per_trial = _ce(spark, d).groupBy(*C.TRIAL).agg(F.sum(F.bit_count("mask")).alias("n"))
    return per_trial.groupBy(*C.ARM).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("trials"))


@query("A7 J10", with_views("campaign_edges", "SELECT campaign, approach, round(relscore, 9) AS relscore FROM rs", _score_sql("campaign_edges", "")))
def rarity_scores(spark, d):
    return _round(C.relscore(_ce(spark, d)))


@query("A8 J10", with_views("campaign_edges", "SELECT campaign, approach, trial_id, score FROM ts", _score_sql("campaign_edges", "")))
def trial_rarity_scores(spark, d):
    return C.trial_scores(_ce(spark, d))


@query("J8", with_views("campaign_edges", "SELECT * FROM rc", _cov_sql("campaign_edges", "")))
def relative_coverage_samples(spark, d):
    return C.relcov_samples(_ce(spark, d))


@query(
    "J8",
    with_views("campaign_edges", "SELECT campaign, approach, reference, round(quantile_cont(relcov, 0.5), 9) AS relcov FROM rc GROUP BY ALL", _cov_sql("campaign_edges", "")),
)
def relative_coverage(spark, d):
    return _round(C.relcov(C.relcov_samples(_ce(spark, d))))


@query(
    "P21",
    with_views("campaign_edges", "SELECT DISTINCT campaign, 'main' AS baseline, 'feature' AS feature FROM pe", _PAIR),
)
def baseline_pairs(spark, d):
    return C.baseline_feature(C.trials_of(_pair_edges(spark, d)))


@query(
    "A32",
    with_views(
        "campaign_edges",
        """SELECT campaign, approach, trials, edges, te * greatest(tt, 1) AS work_items FROM
           (SELECT campaign, approach, count(DISTINCT trial_id) AS trials, count(DISTINCT edge) AS edges FROM campaign_edges GROUP BY ALL)
           JOIN (SELECT campaign, count(DISTINCT edge) AS te, count(DISTINCT (approach, trial_id)) AS tt FROM campaign_edges GROUP BY ALL) USING (campaign)""",
    ),
)
def campaign_sizes(spark, d):
    return C.campaign_size(_ce(spark, d))


@query(
    "P20",
    with_views(
        "campaign_edges",
        """SELECT campaign, campaign LIKE 'by_target/%' AND campaign NOT LIKE '%/by_test/%' AS target_family, campaign LIKE 'by_test/%' OR campaign LIKE '%/by_test/%' AS per_test
           FROM (SELECT DISTINCT campaign FROM campaign_edges)""",
    ),
)
def campaign_families(spark, d):
    names = C.campaigns(v_edges(spark, d).drop("edge")).select("campaign").distinct()
    return names.select("campaign", S.is_target_family("campaign").alias("target_family"), S.is_per_test("campaign").alias("per_test"))


_PAIRED = """m AS (SELECT x.campaign, x.trial_id, x.score AS x, y.score AS y FROM pts x JOIN pts y ON x.campaign = y.campaign AND x.trial_id = y.trial_id
   WHERE x.approach = 'feature' AND y.approach = 'main')"""


@query(
    "J9",
    with_views(
        "campaign_edges",
        """SELECT campaign, pairs, CAST(least(f, b) AS BIGINT) AS expected, pairs / least(f, b) AS matched_rate FROM (SELECT campaign, count(*) AS pairs FROM m GROUP BY campaign) JOIN
           (SELECT campaign, count(*) FILTER (approach = 'feature') AS f, count(*) FILTER (approach = 'main') AS b FROM pts WHERE trial_id LIKE 'seed-%' GROUP BY campaign) USING (campaign)""",
        _PAIR + ", " + _score_sql("pe", "p") + ", " + _PAIRED,
    ),
)
def paired_trials(spark, d):
    sides = _measures(spark, d)
    pairs = _matched(sides, "score").groupBy("campaign").agg(F.count(F.lit(1)).alias("pairs"))
    seeds = sides.where(F.col("trial_id").startswith("seed-")).groupBy("campaign").agg(
        F.least(F.count_if("is_x"), F.count_if(~F.col("is_x"))).alias("expected")
    )
    return pairs.join(seeds, "campaign").withColumn("matched_rate", F.col("pairs") / F.col("expected"))


def _rank_sql(src: str) -> str:
    return f"""r AS (SELECT *, rank() OVER (PARTITION BY campaign ORDER BY v) + (count(*) OVER (PARTITION BY campaign, v) - 1) / 2.0::DOUBLE AS rk,
      count(*) OVER (PARTITION BY campaign, v) AS t FROM {src}),
    rr AS (SELECT campaign, count(*) FILTER (is_x) AS n1, count(*) FILTER (NOT is_x) AS n2, sum(rk) FILTER (is_x) AS rx, CAST(sum(CAST(t AS BIGINT) * t - 1) AS DOUBLE) AS ties,
      avg(v) FILTER (is_x) AS mean_x, avg(v) FILTER (NOT is_x) AS mean_y FROM r GROUP BY campaign),
    rk AS (SELECT campaign, n1, n2, rx - n1 * (n1 + 1) / 2.0::DOUBLE AS u, ties, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y,
      (rx - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n2) AS a12 FROM rr)"""


@query(
    "X1 X3",
    with_views(
        "campaign_edges",
        "SELECT campaign, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u, ties, mean_x, mean_y, round(a12, 9) AS a12 FROM rk",
        _PAIR + ", " + _score_sql("pe", "p") + ", s AS (SELECT campaign, score AS v, approach = 'feature' AS is_x FROM pts), " + _rank_sql("s"),
    ),
)
def rank_sums(spark, d):
    sides = _measures(spark, d)
    sums = stats.rank_sums(sides, ["campaign"], F.col("score"), F.col("is_x"))
    return sums.select(
        "campaign", "n1", "n2", "u", "ties", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 6).alias("mean_y"),
        F.round(stats.a12(), 9).alias("a12"),
    )


@query("X3")
def directed_rank_tests(spark, d):
    sides = _measures(spark, d)
    return stats.directed_rank_test(stats.rank_sums(sides, ["campaign"], F.col("score"), F.col("is_x")))


@query(
    "X4",
    with_views(
        "campaign_edges",
        """SELECT campaign, count(*) AS n, sum(CASE WHEN x > y THEN rk ELSE 0 END) AS w_plus, CAST(sum(CAST(t AS BIGINT) * t - 1) AS DOUBLE) AS ties, round(avg(x - y), 6) AS mean_diff
           FROM (SELECT *, rank() OVER (PARTITION BY campaign ORDER BY abs(x - y)) + (count(*) OVER (PARTITION BY campaign, abs(x - y)) - 1) / 2.0::DOUBLE AS rk,
             count(*) OVER (PARTITION BY campaign, abs(x - y)) AS t FROM m WHERE x <> y) GROUP BY campaign""",
        _PAIR + ", " + _score_sql("pe", "p") + ", " + _PAIRED,
    ),
)
def signed_rank_sums(spark, d):
    sides = _measures(spark, d)
    sums = stats.signed_sums(_matched(sides, "score"), ["campaign"], F.col("x") - F.col("y"))
    return sums.withColumn("mean_diff", F.round("mean_diff", 6))


@query("X4")
def directed_signed_tests(spark, d):
    sides = _measures(spark, d)
    return stats.directed_signed_test(stats.signed_sums(_matched(sides, "score"), ["campaign"], F.col("x") - F.col("y")))


_SHIFT = _PAIR + ", " + _cov_sql("pe", "c") + """, s AS (SELECT campaign, approach = 'feature' AS is_x,
     CASE WHEN approach = 'feature' THEN relcov + 0.05::DOUBLE ELSE relcov END AS v FROM crc WHERE reference = 'main'), """ + _rank_sql("s")


@query("X5", with_views("campaign_edges", "SELECT campaign, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u FROM rk", _SHIFT))
def noninferiority_ranks(spark, d):
    sides = _measures(spark, d)
    return stats.noninferiority_rank_test(sides, ["campaign"], F.col("relcov"), F.col("is_x")).select("campaign", "n1", "n2", F.col("statistic").alias("u"))


@query("X7")
def retention_intervals(spark, d):
    return stats.bca_ci(_measures(spark, d), ["campaign"], F.col("relcov"), F.col("is_x"))


@query("X6 X5")
def paired_retention_intervals(spark, d):
    both = _matched(_measures(spark, d), "relcov")
    diff = F.col("x") - F.col("y")
    test = stats.noninferiority_signed_test(both, ["campaign"], diff).select("campaign", "n", "statistic", "p_value")
    return stats.bca_ci(both, ["campaign"], diff).join(test, "campaign", "left")


@query("X10 X11 J9 P30")
def paired_verdicts(spark, d):
    return verdicts.differential_verdicts(_pair_edges(spark, d), pairing="paired")


@query("X10")
def unpaired_verdicts(spark, d):
    return verdicts.differential_verdicts(_pair_edges(spark, d))


@query("X11 X10 A33")
def verdict_summary(spark, d):
    ce = _pair_edges(spark, d)
    return verdicts.summary_rows(ce, verdicts.differential_verdicts(ce))


@query("V6 X10")
def differential_chart_rows(spark, d):
    return verdicts.chart_rows(verdicts.differential_verdicts(_pair_edges(spark, d)))


# --- pairwise tests on final counts ------------------------------------------------------


def _finals(spark, d):
    curve = curves.cumulative(v_events(spark, d))
    grid = stage(curves.to_grid(curve, curves.REPLICATE, "found", HORIZON_HOURS, STEP_MIN), "grid")
    order = curves.tool_order(curves.overall(curves.bands(grid), HORIZON_HOURS, STEP_MIN))
    last = curves.grid_size(HORIZON_HOURS, STEP_MIN) - 1
    return grid.where(F.col("step_no") == last).select("tool", "found"), order.select("tool", "position")


_FINALS = """overall AS (SELECT tool, sum(CASE WHEN step_no < 120 THEN p50 * 6.0::DOUBLE ELSE 0 END) AS area, max(p50) FILTER (step_no = 120) AS f50 FROM bands GROUP BY tool),
  pos AS (SELECT tool, row_number() OVER (ORDER BY round_even(f50, 0) DESC, area DESC, tool) AS position FROM overall),
  fin AS (SELECT tool, found FROM grid WHERE step_no = 120),
  pr AS (SELECT a.tool AS tool_a, b.tool AS tool_b FROM pos a JOIN pos b ON a.position < b.position),
  sm AS (SELECT tool_a, tool_b, true AS is_a, found FROM pr JOIN fin ON tool = tool_a UNION ALL SELECT tool_a, tool_b, false, found FROM pr JOIN fin ON tool = tool_b),
  rkd AS (SELECT *, rank() OVER (PARTITION BY tool_a, tool_b ORDER BY found) + (count(*) OVER (PARTITION BY tool_a, tool_b, found) - 1) / 2.0::DOUBLE AS rk FROM sm),
  res AS (SELECT tool_a, tool_b, count(*) FILTER (is_a) AS n_a, count(*) FILTER (NOT is_a) AS n_b,
    quantile_cont(CAST(found AS DOUBLE), 0.5) FILTER (is_a) AS median_a, quantile_cont(CAST(found AS DOUBLE), 0.5) FILTER (NOT is_a) AS median_b,
    sum(rk) FILTER (is_a) - count(*) FILTER (is_a) * (count(*) FILTER (is_a) + 1) / 2.0::DOUBLE AS u FROM rkd GROUP BY ALL)"""


@query(
    "X2 J7 X1 P34",
    with_views(
        "bands",
        """SELECT tool_a, tool_b, n_a, n_b, median_a, median_b, u, round(u / (n_a * n_b), 9) AS a12, (SELECT count(*) FROM pr) AS n_comparisons,
           CASE WHEN m < 0.56 THEN 'negligible' WHEN m < 0.64 THEN 'small' WHEN m < 0.71 THEN 'medium' ELSE 'large' END AS effect,
           CASE WHEN u * 2 > n_a * n_b THEN '>' WHEN u * 2 < n_a * n_b THEN '<' ELSE '=' END AS direction
           FROM (SELECT *, greatest(u / (n_a * n_b), 1 - u / (n_a * n_b)) AS m FROM res)""",
        _FINALS,
    ),
)
def pairwise_effects(spark, d):
    finals, order = _finals(spark, d)
    out = stats.pairwise_rank_tests(finals, order)
    return out.select(
        "tool_a", "tool_b", "n_a", "n_b", "median_a", "median_b", "u", F.round("a12", 9).alias("a12"), "n_comparisons", "effect", "direction"
    )


@query("X2 V5")
def pairwise_tests(spark, d):
    finals, order = _finals(spark, d)
    return stats.pairwise_rank_tests(finals, order)


# --- rules on derived rows ---------------------------------------------------------------


def _hypotheses(spark, d):
    """p-values per (tool, instance): the mean of K over 100."""
    return v_events(spark, d).groupBy("tool", "instance_id").agg((F.sum("k") / F.count(F.lit(1)) / 100.0).alias("p"))


@query(
    "X8",
    with_views(
        "v_events",
        """SELECT tool, instance_id, round(p, 9) AS p, round(max(step) OVER (PARTITION BY tool ORDER BY p), 9) AS p_adjusted FROM (
           SELECT *, least(1.0, (count(*) OVER (PARTITION BY tool) - row_number() OVER (PARTITION BY tool ORDER BY p) + 1) * p) AS step
           FROM (SELECT tool, instance_id, sum(k) / count(*) / 100.0 AS p FROM v_events GROUP BY ALL))""",
    ),
)
def holm_adjusted(spark, d):
    return _round(stats.holm(_hypotheses(spark, d), ["tool"], "p"))


def _cases(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(k % 3 == 0, F.concat(F.lit("by_target/t"), (k % 7).cast("string"))).otherwise("combined").alias("campaign"),
        (F.col("o_custkey") % 50).alias("customer"),
        ((k % 40) / 400.0).alias("p_adjusted"),
        F.col("o_totalprice").alias("feature_mean"),
        F.lit(250000.0).alias("baseline_mean"),
        ((k % 101) / 100.0).alias("a12"),
        (((k % 17) - 12) / 100.0).alias("ci_low"),
        (((k % 17) - 6) / 100.0).alias("ci_high"),
        F.when(k % 11 == 0, "insufficient n").otherwise("ok").alias("ci_status"),
        (k % 13 == 0).alias("too_few"),
        (k % 19 == 0).alias("fallback"),
    )


def _judged(spark, d):
    c = _cases(spark, d)
    usable = ~F.col("fallback") & ~F.col("too_few") & (F.col("ci_status") == "ok")
    status = verdicts.noninferiority_status(F.col("ci_low"), F.col("ci_high"), usable, 0.05)
    c = c.withColumn("relcov_status", status)
    v = verdicts.verdict(
        F.col("p_adjusted"), F.col("feature_mean"), F.col("baseline_mean"), F.col("a12"), F.col("relcov_status"), F.col("too_few") | F.col("fallback")
    )
    c = c.withColumn("verdict", v)
    return c.withColumn(
        "reason", verdicts.verdict_reason(F.col("verdict"), F.col("relcov_status"), F.col("ci_status"), F.col("fallback"), F.col("too_few"))
    )


_CASES = """cases AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN 'by_target/t' || (o_orderkey % 7) ELSE 'combined' END AS campaign, o_custkey % 50 AS customer,
   (o_orderkey % 40) / 400.0::DOUBLE AS p_adjusted, o_totalprice AS fm, (o_orderkey % 101) / 100.0::DOUBLE AS a12, (o_orderkey % 17 - 12) / 100.0::DOUBLE AS lo, (o_orderkey % 17 - 6) / 100.0::DOUBLE AS hi,
   CASE WHEN o_orderkey % 11 = 0 THEN 'insufficient n' ELSE 'ok' END AS ci_status, o_orderkey % 13 = 0 AS too_few, o_orderkey % 19 = 0 AS fallback FROM orders),
  st AS (SELECT *, CASE WHEN fallback OR too_few OR ci_status <> 'ok' THEN 'inconclusive' WHEN hi < -0.05 THEN 'failed' WHEN lo >= -0.05 THEN 'held' ELSE 'inconclusive' END AS relcov_status,
    p_adjusted <= 0.05 AND fm > 250000 AND a12 >= 0.56 AS up, p_adjusted <= 0.05 AND fm < 250000 AND a12 <= 0.44 AS down FROM cases),
  vd AS (SELECT *, CASE WHEN too_few OR fallback THEN 'inconclusive' WHEN down OR relcov_status = 'failed' THEN 'regression' WHEN up AND relcov_status = 'held' THEN 'improvement'
    WHEN up THEN 'needs-review' ELSE 'inconclusive' END AS verdict FROM st)"""


@query("X9", with_views("", "SELECT case_id, relcov_status FROM st", _CASES))
def noninferiority_statuses(spark, d):
    return _judged(spark, d).select("case_id", "relcov_status")


@query(
    "X10",
    with_views(
        "",
        """SELECT case_id, verdict, CASE WHEN fallback THEN 'paired mode requires matched seed labels; unpaired fallback disabled' WHEN too_few THEN 'too few runs'
           WHEN verdict = 'improvement' THEN 'significant relscore improvement and relcov non-inferiority held'
           WHEN verdict = 'regression' AND relcov_status = 'failed' THEN 'relcov non-inferiority failed' WHEN verdict = 'regression' THEN 'significant relscore regression'
           WHEN verdict = 'needs-review' AND ci_status <> 'ok' THEN 'significant relscore improvement with relcov ' || ci_status
           WHEN verdict = 'needs-review' THEN 'significant relscore improvement with relcov non-inferiority inconclusive'
           ELSE 'not significant after correction' END AS reason FROM vd""",
        _CASES,
    ),
)
def verdict_ladder(spark, d):
    return _judged(spark, d).select("case_id", "verdict", "reason")


@query(
    "A33",
    with_views(
        "",
        """SELECT customer, count(*) FILTER (t) AS targets, CASE WHEN count(*) FILTER (t AND verdict = 'regression') > 0 THEN 'regression'
             WHEN count(*) FILTER (t AND verdict = 'needs-review') > 0 THEN 'needs-review'
             WHEN count(*) FILTER (t) > 0 AND count(*) FILTER (t AND verdict = 'improvement') * 2 > count(*) FILTER (t) AND bool_and(relcov_status = 'held') FILTER (t) THEN 'improvement'
             ELSE 'inconclusive' END AS verdict, count(*) AS eligible FROM (SELECT *, campaign LIKE 'by_target/%' AS t FROM vd) GROUP BY customer""",
        _CASES,
    ),
)
def aggregate_verdicts(spark, d):
    return verdicts.aggregate_verdict(_judged(spark, d), ("customer",))


@query(
    "P34",
    with_views("", "SELECT case_id, CASE WHEN m < 0.56 THEN 'negligible' WHEN m < 0.64 THEN 'small' WHEN m < 0.71 THEN 'medium' ELSE 'large' END AS effect FROM (SELECT case_id, greatest(a12, 1 - a12) AS m FROM cases)", _CASES),
)
def effect_classes(spark, d):
    return _cases(spark, d).select("case_id", S.effect_class("a12").alias("effect"))


# --- scoreboard --------------------------------------------------------------------------


@query(
    "W4 W6",
    with_views(
        "campaign_edges",
        """SELECT approach, CAST(rank AS INTEGER) AS rank, round(relscore, 9) AS relscore, round(relcov, 9) AS relcov, round(relscore / nullif(max(relscore) OVER (), 0), 9) AS relscore_to_best, round(relcov / nullif(max(relcov) OVER (), 0), 9) AS relcov_to_best,
             CASE WHEN abs(relscore - max(relscore) OVER ()) <= 1e-9 * relscore AND abs(relcov - max(relcov) OVER ()) <= 1e-9 * relcov THEN 'best overall' ELSE 'compare both scores' END AS readout
           FROM (SELECT *, row_number() OVER (ORDER BY relscore DESC, relcov DESC, approach) AS rank FROM
             (SELECT approach, relscore FROM rs WHERE campaign = 'combined') JOIN
             (SELECT approach, quantile_cont(relcov, 0.5) AS relcov FROM rc WHERE campaign = 'combined' AND reference = 'main' GROUP BY approach) USING (approach))""",
        _score_sql("campaign_edges", "") + ", " + _cov_sql("campaign_edges", ""),
    ),
)
def relative_scoreboard(spark, d):
    ce = _ce(spark, d).where(F.col("campaign") == "combined")
    scores = C.relscore(ce).select("approach", "relscore")
    cover = C.relcov(C.relcov_samples(ce)).where(F.col("reference") == "main").select("approach", "relcov")
    return _round(scoreboard(scores.join(cover, "approach", "full"), "approach"))
