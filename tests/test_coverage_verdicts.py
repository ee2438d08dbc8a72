import random
import statistics

import pytest

from sortie.functions import fixed
from sortie.operators import coverage as C
from sortie.operators import stats, verdicts


def table(spark, campaigns):
    rows = [(c, a, t, e) for c, arms in campaigns.items() for a, trials in arms.items() for t, es in trials.items() for e in es]
    names = [(c, a, t) for c, arms in campaigns.items() for a, trials in arms.items() for t in trials]
    return (
        C.edge_sets(spark.createDataFrame(rows, "campaign string, approach string, trial_id string, edge string")),
        spark.createDataFrame(names, "campaign string, approach string, trial_id string"),
    )


def test_scores_match_a_set_model_on_500_random_campaigns(spark):
    rng = random.Random(5)
    camps = {}
    for i in range(500):
        edges = [f"e{j}" for j in range(rng.randrange(1, 40))]
        camps[f"c{i}"] = {
            f"a{a}": {f"t{t}": {e for e in edges if rng.random() < rng.choice([0.0, 0.3, 0.8])} for t in range(rng.randrange(1, 6))}
            for a in range(rng.randrange(1, 6))
        }
    edges, trials = table(spark, camps)
    score, per_trial, cover = {}, {}, {}
    for c, arms in camps.items():
        union = {a: set().union(*ts.values()) for a, ts in arms.items()}
        rare = lambda e: sum(e not in u for u in union.values())
        for a, ts in arms.items():
            each = {t: sum(map(rare, es)) for t, es in ts.items()}
            full = sum(bool(es) for es in ts.values())
            score[c, a] = sum(each.values()) / full if full else 0.0
            per_trial.update({(c, a, t): float(v) for t, v in each.items()})
            for ref, u in union.items():
                cover[c, a, ref] = statistics.median(len(es & u) / len(u) for es in ts.values()) if u else 0.0
    got = {(r.campaign, r.approach): r.relscore for r in C.relscore(edges, trials).collect()}
    assert got.keys() == score.keys() and all(abs(got[k] - score[k]) < 1e-9 for k in score)
    assert {(r.campaign, r.approach, r.trial_id): r.score for r in C.trial_scores(edges, trials).collect()} == per_trial
    got = {(r.campaign, r.approach, r.reference): r.relcov for r in C.relcov(C.relcov_samples(edges, trials)).collect()}
    assert got.keys() == cover.keys() and all(abs(got[k] - cover[k]) < 1e-9 for k in cover)


def test_hand_picked_relative_coverage(spark):
    camp = {"by_target/x": {"master": {"seed-1": {"a", "b"}, "seed-2": {"b", "c"}}, "pr-1": {"seed-1": {"a"}, "seed-2": {"d"}}}}
    edges, trials = table(spark, camp)
    got = {(r.approach, r.reference): r.relcov for r in C.relcov(C.relcov_samples(edges, trials)).collect()}
    assert got["master", "master"] == pytest.approx(2 / 3) and got["pr-1", "master"] == pytest.approx(1 / 6)


def test_baseline_needs_exactly_one_baseline_of_two(spark):
    camps = {"a": ["main", "pr"], "b": ["main", "x-master"], "c": ["pr", "qr"], "d": ["main", "pr", "qr"], "e": ["y-main", "STABLEX"]}
    edges, trials = table(spark, {c: {a: {"t": {"e"}} for a in arms} for c, arms in camps.items()})
    got = {r.campaign: (r.baseline, r.feature) for r in C.baseline_feature(trials).collect()}
    assert got == {"a": ("main", "pr"), "e": ("y-main", "STABLEX")}


def region(tag, i):
    return {f"{tag}{i}-{e}" for e in range(10)}


def paired(feature):
    base = {f"seed-{i}": region("c", i % 3) for i in range(1, 7)}
    return {"master": base, "pr-1": {s: feature(i, i % 3, base[s]) for i, s in enumerate(base, 1)}}


def test_verdict_scenarios(spark):
    shared = {f"s-{i}" for i in range(100)}
    camps = {
        "by_target/aa": paired(lambda i, r, b: b),
        "by_target/up": paired(lambda i, r, b: b | {f"f-{i}-{x}" for x in range(4)}),
        "by_target/lost": paired(lambda i, r, b: {f"c{r}-{e}" for e in range(5)} | {f"f-{i}-{x}" for x in range(8)}),
        "by_target/shift": paired(lambda i, r, b: region("shift", r)),
        "by_target/floor": {
            "master": {f"seed-{i}": shared for i in range(1, 7)},
            "pr-1": {f"seed-{i}": {f"s-{e}" for e in range(90)} | {f"f-{i}-{x}" for x in range(8)} for i in range(1, 7)},
        },
        "by_target/tiny": {"master": {"seed-1": {"a"}}, "pr-1": {"seed-1": {"a", "b"}}},
        "by_test/only": {"master": {"seed-1": {"a"}}, "pr-1": {"seed-1": {"a"}}},
        "combined": {"master": {"run-a": {"a"}}, "pr-1": {"run-b": {"a"}}},
    }
    edges, trials = table(spark, camps)
    out = verdicts.differential_verdicts(edges, trials, pairing="paired", per_test=False, draws=400)
    rows = {(r.campaign, r.metric): r for r in out.collect()}
    got = {c: (r.relcov_status, r.verdict) for (c, m), r in rows.items() if m == "relscore"}
    assert got == {
        "by_target/aa": ("held", "inconclusive"), "by_target/up": ("held", "improvement"), "by_target/lost": ("failed", "regression"),
        "by_target/shift": ("failed", "regression"), "by_target/floor": ("failed", "regression"), "by_target/tiny": ("inconclusive", "inconclusive"),
        "combined": ("inconclusive", "inconclusive"),
    }
    assert rows["by_target/tiny", "relscore"].reason == "too few runs"
    assert rows["combined", "relscore"].reason == fixed.VERDICT_SENTENCES["unpaired"] and rows["combined", "relcov"].test_name == "paired-required"
    lost = rows["by_target/lost", "relscore"]
    assert lost.ci_high < -0.05 and lost.feature_sample_mean > lost.baseline_sample_mean
    assert rows["by_target/floor", "relscore"].baseline_reliability == pytest.approx(1.0)
    assert all(rows[c, "relcov"].verdict == r.verdict for (c, m), r in rows.items() if m == "relscore")
    summary = verdicts.aggregate_verdict(out.where("metric = 'relscore'")).first()
    assert summary.verdict == "regression" and summary.targets == 6
    every = {r.campaign: r.verdict for r in verdicts.summary_rows(edges, out, trials).collect()}
    assert every["by_test/only"] == "inconclusive" and every["by_target/up"] == "improvement"


def test_unpaired_improvement_and_aggregate(spark):
    base = [region("c", i % 3) for i in range(6)]
    feat = [b | {f"f-{i}-{x}" for x in range(4)} for i, b in enumerate(base)]
    camp = {"main": {f"m{i}": e for i, e in enumerate(base)}, "pr": {f"p{i}": e for i, e in enumerate(feat)}}
    edges, trials = table(spark, {"by_target/u": camp})
    out = verdicts.differential_verdicts(edges, trials, draws=400)
    r = out.where("metric = 'relscore'").first()
    assert (r.relcov_status, r.verdict, r.test_name, r.paired) == ("held", "improvement", "mann-whitney-u", False)
    assert verdicts.aggregate_verdict(out.where("metric = 'relscore'")).first().verdict == "improvement"
    assert verdicts.chart_rows(out).first().label == "u"


def exact_u(x, y):
    """P(U >= u) by listing every split."""
    from itertools import combinations

    pool = x + y
    u = lambda a, b: sum((i > j) + 0.5 * (i == j) for i in a for j in b)
    seen = u(x, y)
    idx = range(len(pool))
    hits = [u([pool[i] for i in c], [pool[i] for i in idx if i not in c]) >= seen for c in combinations(idx, len(x))]
    return sum(hits) / len(hits)


def test_p_values():
    rng = random.Random(2)
    for _ in range(20):
        pool = rng.sample(range(100), 9)
        x, y = pool[:4], pool[4:]
        u = sum(i > j for i in x for j in y)
        assert stats.rank_p_value(u, 4, 5, 0, "greater") == pytest.approx(exact_u(x, y))
    assert stats.rank_p_value(8, 4, 4, 0, "two-sided") == 1.0
    assert stats.rank_p_value(25, 5, 5, 0, "two-sided") == pytest.approx(2 / 252)
    # 10 against 10, no overlap, ties: normal with continuity and tie correction
    assert 0 < stats.rank_p_value(100, 10, 10, 12, "two-sided") < 3e-4
    assert stats.signed_p_value(21, 6, 0, "greater") == pytest.approx(1 / 64)
    assert stats.signed_p_value(0, 6, 0, "less") == pytest.approx(1 / 64)
    assert stats.signed_p_value(21, 6, 210, "greater") < 0.01
    assert stats.rank_p_value(4.5, 3, 3, 6**3 - 6, "two-sided") == 1.0


def test_effect_size_properties(spark):
    from pyspark.sql import functions as F

    rows = [(g, s, v) for g, a, b in (("tie", [1, 1], [1, 1]), ("up", [3, 4, 5], [1, 2, 3]), ("down", [1, 2, 3], [3, 4, 5])) for s, vs in ((True, a), (False, b)) for v in vs]
    df = spark.createDataFrame(rows, "g string, x boolean, v int")
    got = {r.g: r.a for r in stats.rank_sums(df, ["g"], F.col("v"), F.col("x")).select("g", stats.a12().alias("a")).collect()}
    assert got["tie"] == 0.5 and got["up"] + got["down"] == pytest.approx(1.0) and got["up"] == pytest.approx(8.5 / 9)


def test_pairwise_tests(spark):
    finals = spark.createDataFrame([("a", v) for v in (5, 6, 7, 8, 9)] + [("b", v) for v in (1, 2, 3, 4, 5)] + [("c", 3)], "tool string, found long")
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "tool string, position int")
    got = {(r.tool_a, r.tool_b): r for r in stats.pairwise_rank_tests(finals, order).collect()}
    ab = got["a", "b"]
    assert (ab.u, ab.n_comparisons, ab.direction, ab.effect) == (24.5, 3, ">", "large")
    assert ab.p_corrected == pytest.approx(min(1, 3 * ab.p_value)) and ab.significant
    assert got["a", "c"].warning == "fewer than 2 runs" and got["a", "c"].p_value is None


def plain_bca(x, y, draws, rng):
    """The textbook interval of mean(x) - mean(y), resampling rows."""
    import numpy as np

    arms = [a for a in (x, y) if a is not None]
    signs = (1, -1)
    theta = sum(s * a.mean() for s, a in zip(signs, arms))
    boot = np.sort(sum(s * rng.choice(a, (draws, len(a))).mean(1) for s, a in zip(signs, arms)))
    z0 = stats.NORMAL.inv_cdf(((boot < theta).sum() + 0.5 * (boot == theta).sum()) / draws)
    jack = np.concatenate([theta - s * a.mean() + s * (a.sum() - a) / (len(a) - 1) for s, a in zip(signs, arms)])
    off = jack.mean() - jack
    accel = (off**3).sum() / (6 * (off**2).sum() ** 1.5)
    at = lambda q: stats.NORMAL.cdf(z0 + (z0 + stats.NORMAL.inv_cdf(q)) / (1 - accel * (z0 + stats.NORMAL.inv_cdf(q))))
    return np.quantile(boot, at(0.025)), np.quantile(boot, at(0.975))


def test_bootstrap_over_many_leaves_equals_a_plain_model(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(stats, "LEAF", 4)  # so that small arms have many leaves and long paths
    rng = np.random.default_rng(4)
    arms = {
        "skewed": (rng.exponential(2.0, 300), rng.exponential(1.0, 200)), "tied": (np.repeat([0.0, 0.5, 1.0], [3, 4, 5]), np.repeat([0.0, 1.0], [6, 6])),
        "narrow": (1.7e9 + rng.random(200), 1.7e9 + rng.random(150)), "constant": (np.ones(9), np.zeros(7)), "few": (np.arange(5.0), np.arange(9.0)),
    }
    rows = [(k, side, float(v)) for k, (x, y) in arms.items() for side, a in ((True, x), (False, y)) for v in a] + [("few", True, None), ("few", True, float("nan"))]
    df = spark.createDataFrame(rows, "k string, x boolean, v double")
    ask = lambda: {r.k: r for r in stats.bca_ci(df, ["k"], F.col("v"), F.col("x")).collect()}
    got = ask()
    assert got == ask()
    assert got["constant"][1:] == (1.0, 1.0, "ok") and got["few"][1:] == (None, None, "insufficient n")
    for k in ("skewed", "tied", "narrow"):
        low, high = plain_bca(*arms[k], 20000, rng)
        assert got[k].ci_low == pytest.approx(low, abs=0.06 * (high - low)) and got[k].ci_high == pytest.approx(high, abs=0.06 * (high - low))
    one = {r.k: r for r in stats.bca_ci(df.where("x"), ["k"], F.col("v")).collect()}
    low, high = plain_bca(arms["skewed"][0], None, 20000, rng)
    assert one["skewed"].ci_low == pytest.approx(low, abs=0.06 * (high - low)) and one["constant"].ci_low == 1.0


def test_bootstrap_shares_a_hot_campaign_out(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.lit("c").alias("k"), (F.col("id") % 2 == 0).alias("x"), (F.col("id") / 3.0).alias("v"))
    counts = df.select("k", F.col("x").alias("is_x"), "v", F.lit(1).cast("bigint").alias("c"))
    leaves = stats._leaves(counts, ["k"]).collect()
    assert len(leaves) >= 256 and max(len(r["_vc"]) for r in leaves) <= 1024 and sum(r["_held"] for r in leaves) == 20_000
    assert all(r["_path"] for r in leaves)
    ci = stats.bca_ci(df, ["k"], F.col("v"), F.col("x"), draws=400).first()
    assert ci.ci_low < -1 / 3 < ci.ci_high and ci.ci_high - ci.ci_low == pytest.approx(2 * 1.96 * 1924.5 * (2 / 10_000) ** 0.5, rel=0.25)


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "d", 0.6), ("g", "e", 0.6)], "f string, k string, p double")
    got = {r.k: round(r.p_adjusted, 9) for r in stats.holm(df, ["f"], "p").collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06, "d": 1.0, "e": 1.0}


def test_holm_over_one_large_family_runs_in_several_tasks(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [("r1", i, rng.choice([0.5, rng.random(), rng.random() / 1000, None])) for i in range(3000)] + [("r2", 1, 0.01)]
    df = spark.createDataFrame(rows, "run string, i int, p double")
    ps = sorted(p for r, _, p in rows if r == "r1" and p is not None)
    want, top = {}, 0.0
    for k, p in enumerate(ps):
        top = max(top, min(1.0, (len(ps) - k) * p))
        want.setdefault(p, top)
    want = {p: max(v, want[p]) for p, v in want.items()}
    for r in stats.holm(df, ["run"], "p").collect():
        assert (r.p_adjusted is None) if r.p is None else r.p_adjusted == pytest.approx(0.01 if r.run == "r2" else want[r.p])
    counts = df.where("p is not null").groupBy("run", "p").count()
    assert stats.with_segments(counts, "p").select("_seg").distinct().count() > 200
