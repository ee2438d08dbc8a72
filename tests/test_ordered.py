import random

import numpy as np
from pyspark.sql import functions as F

from sortie.operators.ordered import grouped_quantiles, quantiles, scan, with_segments


def test_scan_equals_plain_windows_with_a_hot_group(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        group = "hot" if rng.random() < 0.6 else rng.choice("abc")
        rows.append((group, i // 25, i, rng.choice([None, rng.randrange(-9, 9)])))
    df = spark.createDataFrame(rows, "g string, seg int, t int, v int")
    kinds = ["first", "last", "prev", "sum", "max", "min", "prior_max"]
    got = scan(df, ["g"], ["t"], {k: (k, F.col("v")) for k in kinds}, "seg")
    plain = scan(df, ["g"], ["t"], {k: (k, F.col("v")) for k in kinds})
    cols = ["g", "t", *kinds]
    assert sorted(got.select(cols).collect()) == sorted(plain.select(cols).collect())
    # and against a loop
    state, want = {}, {}
    for g, _, t, v in rows:
        s = state.setdefault(g, [])
        before = [x for x in s if x is not None]
        s.append(v)
        seen = [x for x in s if x is not None]
        want[g, t] = (
            seen[0] if seen else None, seen[-1] if seen else None, before[-1] if before else None, sum(seen) if seen else None,
            max(seen) if seen else None, min(seen) if seen else None, max(before) if before else None,
        )
    assert {(r.g, r.t): tuple(r[k] for k in kinds) for r in got.collect()} == want


def test_quantiles_equal_linear_interpolation(spark):
    rng = random.Random(3)
    data = {g: [rng.uniform(-1000, 1e6) if rng.random() < 0.7 else 5.0 for _ in range(n)] for g, n in {"a": 1, "b": 2, "c": 501}.items()}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("c", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    for r in quantiles(df, ["g"], "v", points).collect():
        assert r.n == len(data[r.g])
        for name, q in points.items():
            assert abs(r[name] - np.quantile(data[r.g], q)) < 1e-6


def test_grouped_quantiles_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, None)], "g string, x double, y double")
    got = {r.g: r for r in grouped_quantiles(df, ["g"], ["x", "y"], {"p50": 0.5}).collect()}
    assert (got["a"].x_n, got["a"].x_p50, got["a"].y_n, got["a"].y_p50) == (2, 2.0, 0, None)
    assert (got["b"].x_n, got["b"].x_p50) == (0, None)



def test_segments_follow_the_values_wherever_they_lie(spark):
    for low, high in ((1.700e9, 1.708e9), (0.500, 0.506), (-3.0, 1e300)):
        df = spark.range(5000).select((F.lit(low) + F.col("id") * ((high - low) / 5000)).alias("x"))
        rows = with_segments(df, "x", "s").orderBy("x").collect()
        segments = [r.s for r in rows]
        assert segments == sorted(segments) and len(set(segments)) > 200
        assert max(segments.count(s) for s in set(segments)) < 50
    empty = spark.range(0).select(F.col("id").cast("double").alias("x"))
    assert with_segments(empty, "x").count() == 0
