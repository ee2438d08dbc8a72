import datetime as dt

import pytest
from pyspark.sql import functions as F

from sortie.functions import scalars as S
from sortie.operators import cost, curves, findings, quality, runs, samples
from sortie.operators.scoreboard import load_scores, scoreboard

EVENT = "run_id string, instance_id string, tool string, tool_label string, event string, elapsed_seconds double"


def overlap_events(spark):
    """Three tools, seven events; the last one only after 200 seconds."""
    short = "f a A 10,f b A 12,f a A 20,f a B 25,e a B 30,m a B 40,e a C 50,m a C 60,f a E 70,m a E 80,f a F 90,e a F 95,m a F 100,e a G 105,f a H 200,m a H 210"
    names = {"f": "foundry", "e": "echidna", "m": "medusa"}
    rows = [("1000", f"i-{i}", names[t], names[t], e, float(s)) for t, i, e, s in (x.split() for x in short.split(","))]
    return spark.createDataFrame(rows, EVENT)


def test_intersections_within_a_budget(spark):
    ev = overlap_events(spark)
    early = ev.where(S.within_budget("elapsed_seconds", 0.03))
    got = {r.tools: r.events for r in findings.intersections(early).collect()}
    assert got == {"foundry": 1, "echidna": 1, "echidna,medusa": 1, "foundry,medusa": 1, "echidna,foundry,medusa": 2}
    assert {r.tools: r.events for r in findings.intersections(ev).collect()}["foundry,medusa"] == 2
    assert {r.tool: r.events for r in findings.set_sizes(early).collect()} == {"echidna": 4, "foundry": 4, "medusa": 4}
    first = findings.overlap(early).where("event = 'A'").first()
    assert (first.tool, first.first_seen_s, first.runs_hit) == ("foundry", 10.0, 2)
    assert {r.event for r in findings.shared_by_all(early).collect()} == {"B", "F"}
    none = spark.createDataFrame([("idle",), ("medusa",)], "tool string")
    assert {r.tool: r.events for r in findings.set_sizes(early, none).collect()}["idle"] == 0
    with pytest.raises(ValueError):
        S.within_budget("elapsed_seconds", -1)


def test_summary_numbers(spark):
    rows = [("r1", "i-1", e, t) for e, t in (("a", 5.0), ("a", 9.0), ("b", 7.0), ("b", 3.0), ("c", 20.0))] + [("r1", "i-2", "a", 6.0), ("r1", "i-2", "a", 8.0)]
    df = spark.createDataFrame([(r, i, "m", "m", e, t) for r, i, e, t in rows], EVENT)
    r = findings.tool_summary(df).first()
    assert (r.runs, r.distinct_events, r.exclusive_events, r.shared_events, r.min_events, r.max_events) == (2, 3, 3, 0, 1, 3)
    assert r.mean_events == 2.0 and r.stdev_events == pytest.approx(2**0.5) and r.mean_ttfb_seconds == 4.5 and r.median_ttfb_seconds == 4.5


def catalog_events(spark):
    raw = [
        ("i-a1", "foundry", "SuiteTester.assert_canary_ASSERTION_CANARY(uint256)", 1.0), ("i-a1", "foundry", "assert_canary_ASSERTION_CANARY", 2.0),
        ("i-a1", "foundry", "invariant_canary()", 0.5), ("i-a1", "foundry", "squeezeUndone(uint8,uint8)", 3.0), ("i-a1", "foundry", "squeezeWithdrawn", 4.0),
        ("i-a1", "foundry", "testUnexpected(uint256)", 5.0), ("i-a2", "echidna", "assert_canary_ASSERTION_CANARY(uint256)", 1.0),
        ("i-a2", "echidna", "invariant_canary", 0.0), ("i-a2", "echidna", "squeezeWithdrawn(uint8,uint8)", 7.0), ("i-a3", "foundry", "invariant_canary", 0.0),
        ("i-a3", "foundry", "testUnexpected(uint256)", 8.0),
    ]
    df = spark.createDataFrame([("run-1", i, t, t, e, s) for i, t, e, s in raw], EVENT)
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def test_catalog_mapping(spark):
    both = ("foundry", "echidna")
    rows = [("canary", "assertion-canary", "assert_canary"), ("canary", "invariant-canary", "invariant_canary"), ("known_bug", "squeeze", "squeezeUndone"), ("known_bug", "squeeze", "squeezeWithdrawn"), ("canary", "shadowed", "squeezeUndone")]
    catalog = spark.createDataFrame([(t, e, c, i) for c, i, e in rows if i != "shadowed" for t in both] + [("foundry", "squeezeUndone", "canary", "shadowed")], "tool string, event string, finding_class string, entry_id string")
    ev = catalog_events(spark)
    found = findings.map_findings(ev, findings.alias_index(catalog), "ordinal")
    mine = {(r.finding_class, r.entry_id): r for r in found.where("instance_id = 'i-a1'").collect()}
    assert len(mine) == 4 and mine["known_bug", "squeeze"].observations == 2 and mine["known_bug", "squeeze"].elapsed_seconds == 3.0
    assert mine["canary", "assertion-canary"].observations == 2 and mine["unmapped", None].event == "testUnexpected"
    rates = {r.tool: r for r in findings.hit_rates(found, findings.replicates(ev), catalog.where("entry_id <> 'shadowed'")).collect()}
    f, e = rates["foundry"], rates["echidna"]
    assert (f.replicates, f.known_bug_hits, f.known_bug_opportunities, f.known_bug_hit_rate) == (2, 1, 2, 0.5)
    assert (f.canary_hits, f.canary_opportunities, f.canary_hit_rate, f.unmapped_findings) == (3, 4, 0.75, 2)
    assert e.known_bug_hit_rate == 1.0
    assert [(r.tool, r.event, r.replicates) for r in findings.unmapped(found).collect()] == [("foundry", "testUnexpected", 2)]


def test_missing_replicates(spark):
    events = spark.createDataFrame([("run-9", "i-a1", "foundry", "foundry", "e", 1.0)], EVENT)
    machines = spark.createDataFrame([("i-a1", "foundry"), ("i-b2", "medusa")], "instance_id string, tool string")
    present = findings.replicates(events, machines, "run-1")
    assert {(r.run_id, r.instance_id, r.tool) for r in present.collect()} == {("run-9", "i-a1", "foundry"), ("run-1", "i-b2", "medusa")}
    expected = spark.createDataFrame([("foundry", 2), ("medusa", 3)], "tool string, instances int")
    pads = {r.instance_id for r in findings.missing_replicates(present, expected, "run-1").collect()}
    assert pads == {"missing-foundry-2", "missing-medusa-2", "missing-medusa-3"}


def series(spark, rows, value="found bigint"):
    return spark.createDataFrame(rows, f"tool string, run_id string, instance_id string, time_hours double, {value}")


def test_grid_keeps_steps_and_zero_runs(spark):
    curve = series(spark, [("t", "r", "a", 0.0, 0), ("t", "r", "a", 0.25, 1), ("t", "r", "a", 0.25, 2), ("t", "r", "a", 0.9, 3), ("t", "r", "a", 2.0, 9), ("t", "r", "b", 0.0, 0), ("t", "r", "c", 5.0, 4)])
    grid = curves.to_grid(curve, curves.REPLICATE, "found", 1.0, 30.0)
    got = {}
    for r in grid.orderBy("step_no").collect():
        got.setdefault(r.instance_id, []).append(r.found)
    assert got == {"a": [0, 2, 3], "b": [0, 0, 0], "c": [0, 0, 0]}
    card = {r.k: r for r in curves.milestones(grid, [1, 5]).collect()}
    assert (card[1].median_hours, card[1].reached, card[1].runs) == (0.5, 1, 3) and card[5].median_hours is None


def test_metric_grid_stops_at_the_last_observation(spark):
    rows = [("t", "r", "a", 0.25, 10.0), ("t", "r", "a", 0.5, 8.0), ("t", "r", "a", 1.2, 5.0)]
    grid = curves.to_grid(series(spark, rows, "v double"), curves.REPLICATE, "v", 2.0, 30.0, "last", before=None, extend=False)
    assert [r.v for r in grid.orderBy("step_no").collect()] == [None, 8.0, 8.0, None, None]
    grid = curves.to_grid(series(spark, rows, "v double"), curves.REPLICATE, "v", 2.0, 30.0, "mean", before=None)
    assert [r.v for r in grid.orderBy("step_no").collect()] == [None, 8.0, 8.0, 5.0, 5.0]


def test_invalid_curves_raise(spark):
    bad = series(spark, [("t", "r", "a", 0.0, 1), ("t", "r", "a", 1.0, 0), ("t", "r", "b", 0.0, -1)])
    assert {(r.instance_id, r.reason) for r in curves.check_monotonic(bad).collect()} == {("a", "decreased"), ("b", "negative")}
    with pytest.raises(ValueError, match="decreased"):
        curves.require_monotonic(bad)
    good = series(spark, [("t", "r", "a", 0.0, 0), ("t", "r", "a", 23.7, 2)])
    assert curves.infer_budget(curves.require_monotonic(good)) == 24.0
    assert curves.clamp_checkpoints([1, 8, 24, 48, 8], 24.0) == [1.0, 8.0, 24.0] and curves.clamp_checkpoints([48], 24.0) == [24.0]
    assert [curves.grid_size(b, 6.0) for b in (0.0, 0.1, 1.0, 24.0)] == [1, 2, 11, 241]


def test_cumulative_keeps_silent_replicates(spark):
    ev = spark.createDataFrame([("r", "a", "t", "t", "x", 3600.0), ("r", "a", "t", "t", "x", 7200.0), ("r", "a", "t", "t", "y", 3600.0)], EVENT)
    listed = spark.createDataFrame([("r", "b", "t")], "run_id string, instance_id string, tool string")
    got = sorted((r.instance_id, r.time_hours, r.found) for r in curves.cumulative(ev, listed).collect())
    assert got == [("a", 0.0, 0), ("a", 1.0, 1), ("a", 1.0, 2), ("b", 0.0, 0)]
    assert curves.cumulative(ev, dedupe=False, include_zero=False).count() == 3


def test_run_health(spark):
    curve = spark.createDataFrame([("dead", 0), ("quiet", 2), ("early", 0), ("fine", 1)], "tool string, found long")
    activity = spark.createDataFrame([("early", "r", "i", 0.3), ("early", "r", "j", 0.4), ("fine", "r", "i", 1.5)], "tool string, run_id string, instance_id string, time_hours double")
    got = {r.tool: (r.problem, r.instances) for r in samples.run_health(curve, activity, 2.0).collect()}
    assert got == {"dead": ("never executed", None), "early": ("terminated early", 2)}
    assert samples.run_health(curve, activity, 0.0).count() == 0


def test_latest_values(spark):
    rows = [(1, "m", "i1", 1.0, 100.0), (2, "m", "i1", 5.0, 200.0), (3, "m", "i1", 5.0, 300.0), (4, "m", "i1", 9.0, None), (5, "m", "i2", 1.0, 500.0)]
    df = spark.createDataFrame([(o, t, t, "r", i, s, v) for o, t, i, s, v in rows], "o int, tool string, tool_label string, run_id string, instance_id string, elapsed_seconds double, v double")
    r = samples.latest_summary(df, ["v"], "o").first()
    assert (r.runs, r.v_n, r.v_p25, r.v_p50, r.v_p75) == (2, 2, 350.0, 400.0, 450.0)


def test_scoreboard(spark):
    df = spark.createDataFrame([("b", "0.9", "1.0"), ("a", "1.0", "1.0"), ("c", "", "x")], "Approach string, RelScores string, relative_coverage string")
    got = {r.tool: r for r in scoreboard(load_scores(df)).collect()}
    assert (got["a"].rank, got["a"].readout, got["b"].rank, got["b"].relscore_to_best, got["c"].readout) == (1, "best overall", 2, 0.9, "no relative scores")
    with pytest.raises(ValueError):
        load_scores(df.drop("Approach"))


def test_effect_class_limits(spark):
    values = [0.5, 0.559, 0.56, 0.44, 0.64, 0.36, 0.71, 0.29, 1.0]
    got = [r.c for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.effect_class("v").alias("c")).collect()]
    assert got == ["negligible", "negligible", "small", "small", "medium", "medium", "large", "large", "large"]
    with pytest.raises(Exception, match="between 0 and 1"):
        spark.createDataFrame([(1.2,)], "v double").select(S.effect_class("v")).collect()


def test_checkpoint_selection_never_goes_back(spark):
    run = "run_id string, benchmark_uuid string, "
    rs = spark.createDataFrame(
        [("live", "u", 1000, 1.0, 600, True, False), ("done", "u", 1000, 1.0, 600, True, True), ("off", "u", 1000, 1.0, 600, False, False), ("old", "u", -9000, 1.0, 600, True, False)],
        run + "started_epoch long, timeout_hours double, interval_seconds long, enabled boolean, finalized boolean",
    )
    snaps = spark.createDataFrame([(r, "u", c) for r in ("live", "done", "off", "old") for c in (1, 2, 3, 4)], run + "checkpoint long")
    none = snaps.where("false")
    pick = lambda now, done=none: [(r.run_id, r.checkpoint) for r in runs.select_checkpoints(snaps, done, rs, now).collect()]
    assert pick(1000 + 600 + 299) == [] and pick(1000 + 600 + 300) == [("live", 1)] and pick(1000 + 3 * 600 + 350) == [("live", 3)]
    assert pick(1000 + 3 * 600 + 350, snaps.where("checkpoint = 3")) == []
    assert pick(1000 + 3600) == []


def test_costs_keep_negative_services_and_absent_months(spark):
    day = dt.date(2026, 3, 2)
    rows = [("A", day, "10.00"), ("A", day, "5.00"), ("Credit", day, "-3.00"), ("Zero", day, "0"), (" ", day, "3.00"), ("Tax", day, "1")]
    ledger = spark.createDataFrame(rows, "service string, day date, cost string").withColumn("cost", F.col("cost").cast("decimal(38,12)"))
    got = {r.service: (float(r.cost), r.share_pct) for r in cost.service_months(ledger).collect()}
    assert got == {"A": (15.0, 93.75), "Credit": (-3.0, -18.75), "Unknown": (3.0, 18.75), "Tax": (1.0, 6.25)}
    months = {r.month: (float(r.total), float(r.tax), r.estimated) for r in cost.month_totals(ledger, dt.date(2026, 4, 9)).collect()}
    assert months == {dt.date(2026, 3, 1): (16.0, 1.0, False), dt.date(2026, 4, 1): (0.0, 0.0, True)}


def test_target_resolution(spark):
    targets = spark.createDataFrame([("t", "https://h/o/R.git")], "id string, repo string")
    catalog = spark.createDataFrame([("t", "c1")], "target_id string, target_commit string")
    rows = [("ok", "HTTPS://h/o/r/", "c1", None), ("asked", "https://h/o/r", "c1", "t"), ("bypass", "https://h/o/x", "c1", "t"), ("rev", "https://h/o/r", "c2", None), ("no", None, "c1", None), ("gone", "https://h/o/r", "c1", "zz")]
    df = spark.createDataFrame(rows, "run_id string, target_repo_url string, target_commit string, target_id string")
    got = {r.run_id: (r.target_id, r.reason) for r in runs.resolve_targets(df, targets, catalog).collect()}
    assert got["ok"] == ("t", "matched run repository and commit") and got["asked"] == ("t", "matched explicit target ID")
    assert {k: v[1] for k, v in got.items() if v[0] is None} == {
        "bypass": "repository does not match the target", "rev": "run commit is not the cataloged revision",
        "no": "run manifest has no target_repo_url", "gone": "target ID is not cataloged",
    }


def test_rules_for_urls_and_markers(spark):
    urls = ["https://github.com/o/r/blob/c/src/A.sol#L1-L2", "https://github.com/o/r/blob/c/src/A.sol", "https://u:p@x/y", "https://x/y#frag", "http://x/y", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in df.select(quality.https_url("u", quality.LINES), quality.pinned_url("u", F.lit("https://github.com/O/R"), F.lit("c"))).collect()]
    assert got == [(True, True), (True, False), (False, False), (False, False), (False, False), (False, False)]
    marker = spark.createDataFrame([("r", "u", "r", "u", True, "x-u-r", None, None), ("r", "u", "r", "u", False, "bad", True, "")], "run_id string, benchmark_uuid string, key_run_id string, key_uuid string, stream_closed boolean, release_tag string, superseded boolean, superseded_reference string")
    broken = {(r.rule) for r in quality.dq_report(marker, quality.finalized_rules("x-"), F.col("run_id")).collect()}
    assert broken == {"stream is not closed", "superseded run claims a tag", "superseded run has no reference"}
