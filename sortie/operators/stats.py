"""Rank statistics, corrections and bootstrap intervals.

Ranks come from value counts run along the value order, so neither a big
sample nor a value shared by most rows meets a single task. Python only
turns one row of sums per group into a p-value, and draws resamples of
one leaf of values at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.scalars import effect_class
from ..session import stage
from .findings import peers
from .ordered import SEGMENTS, quantiles, scan, with_segments

NORMAL = NormalDist()


def rank_sums(samples: DataFrame, keys: Sequence[str], value: Column, is_x: Column, weight: Column | None = None) -> DataFrame:
    """Per group: n1, n2, U of x over y, tie term, and both means."""
    keys, w = list(keys), F.lit(1) if weight is None else weight
    counts = (
        samples.select(*keys, value.cast("double").alias("_x"), is_x.alias("_is_x"), w.alias("_w"))
        .where(F.col("_x").isNotNull() & ~F.isnan("_x"))
        .groupBy(*keys, "_x")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_is_x"), F.col("_w"))), F.lit(0)).alias("_nx"),
            F.coalesce(F.sum(F.when(~F.col("_is_x"), F.col("_w"))), F.lit(0)).alias("_ny"),
        )
    )
    counts = with_segments(counts, "_x")
    ranked = scan(counts, keys, ["_x"], {"_upto": ("sum", F.col("_ny"))}, "_seg")
    t = (F.col("_nx") + F.col("_ny")).cast("double")
    return ranked.groupBy(*keys).agg(
        F.sum("_nx").alias("n1"),
        F.sum("_ny").alias("n2"),
        F.sum(F.col("_nx") * (F.col("_upto") - F.col("_ny") / 2.0)).alias("u"),
        F.sum(t * t * t - t).alias("ties"),
        F.try_divide(F.sum(F.col("_nx") * F.col("_x")), F.sum("_nx")).alias("mean_x"),
        F.try_divide(F.sum(F.col("_ny") * F.col("_x")), F.sum("_ny")).alias("mean_y"),
    )


def a12(u: str = "u", n1: str = "n1", n2: str = "n2") -> Column:
    """P(x > y) + P(x = y) / 2; one half when a side is empty."""
    return F.coalesce(F.try_divide(F.col(u), F.col(n1) * F.col(n2)), F.lit(0.5))


def _u_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties: coefficients of the Gaussian binomial."""
    small, large = sorted((n1, n2))
    top = small * large
    ways = np.zeros(top + 1)
    ways[0] = 1.0
    for i in range(1, small + 1):
        up, down = large + i, i
        if up <= top:
            ways[up:] = ways[up:] - ways[: top + 1 - up].copy()
        lanes = np.zeros(-(-(top + 1) // down) * down)  # running sums with stride `down`
        lanes[: top + 1] = ways
        ways = np.cumsum(lanes.reshape(-1, down), axis=0).ravel()[: top + 1]
    at = math.ceil(u - 1e-9)
    return float(ways[at:].sum() / ways.sum()) if at <= top else 0.0


def rank_p_value(u: float, n1: int, n2: int, ties: float, alternative: str) -> float:
    """Exact when a side has at most 8 values and nothing is tied, else normal with corrections."""
    if n1 < 1 or n2 < 1:
        return 1.0
    best = {"greater": u, "less": n1 * n2 - u, "two-sided": max(u, n1 * n2 - u)}[alternative]
    sides = 2.0 if alternative == "two-sided" else 1.0
    if min(n1, n2) <= 8 and ties == 0:
        return min(1.0, sides * _u_exact_sf(best, n1, n2))
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0))) if n > 1 else 0.0
    if var <= 0:
        return 1.0
    z = (best - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)
    return min(1.0, sides * 0.5 * math.erfc(z / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def rank_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, alternative: pd.Series) -> pd.Series:
    return pd.Series(
        [rank_p_value(float(a), int(b), int(c), float(t), alt) for a, b, c, t, alt in zip(u, n1, n2, ties, alternative)]
    )


def directed_rank_test(sums: DataFrame, forced: Column | None = None) -> DataFrame:
    """One-sided in the direction of the means; equal means give (0, 1).

    Rows where ``forced`` holds are tested for "greater" whatever their means.
    """
    direction = F.when(F.col("mean_x") > F.col("mean_y"), "greater").when(
        F.col("mean_x") < F.col("mean_y"), "less"
    )
    if forced is not None:
        direction = F.when(forced, "greater").otherwise(direction)
    ready = sums.withColumn("direction", direction)
    p = rank_p("u", "n1", "n2", "ties", F.coalesce("direction", F.lit("greater")))
    return ready.select(
        "*",
        F.when(F.col("direction").isNull(), 0.0).otherwise(F.col("u")).alias("statistic"),
        F.when(F.col("direction").isNull(), 1.0).otherwise(p).alias("p_value"),
        a12().alias("a12"),
    )


def noninferiority_rank_test(
    samples: DataFrame, keys: Sequence[str], value: Column, is_x: Column, delta: float = fixed.NONINFERIORITY_DELTA
) -> DataFrame:
    """One-sided test that x shifted up by delta exceeds y."""
    shifted = F.when(is_x, value + F.lit(delta)).otherwise(value)
    sums = rank_sums(samples, keys, shifted, is_x)
    return sums.withColumn("statistic", F.col("u")).withColumn(
        "p_value", rank_p("u", "n1", "n2", "ties", F.lit("greater"))
    )


def signed_sums(pairs: DataFrame, keys: Sequence[str], diff: Column) -> DataFrame:
    """Per group: W+ over non-zero differences, their number, tie term and mean."""
    keys = list(keys)
    counts = (
        pairs.select(*keys, diff.cast("double").alias("_d"))
        .where(F.col("_d").isNotNull() & ~F.isnan("_d") & (F.col("_d") != 0.0))
        .groupBy(*keys, F.abs("_d").alias("_x"))
        .agg(F.count_if(F.col("_d") > 0).alias("_up"), F.count(F.lit(1)).alias("_t"))
    )
    counts = with_segments(counts, "_x")
    ranked = scan(counts, keys, ["_x"], {"_upto": ("sum", F.col("_t"))}, "_seg")
    rank = F.col("_upto") - (F.col("_t") - 1) / 2.0
    t = F.col("_t").cast("double")
    return ranked.groupBy(*keys).agg(
        F.sum("_t").alias("n"),
        F.sum(F.col("_up") * rank).alias("w_plus"),
        F.sum(t * t * t - t).alias("ties"),
        (F.sum((2 * F.col("_up") - F.col("_t")) * F.col("_x")) / F.sum("_t")).alias("mean_diff"),
    )


def signed_p_value(w_plus: float, n: int, ties: float, alternative: str) -> float:
    """Exact for up to 50 untied differences, else the normal approximation."""
    if n < 1:
        return 1.0
    top = n * (n + 1) // 2
    best = w_plus if alternative == "greater" else top - w_plus
    if n <= 50 and ties == 0:
        ways = np.zeros(top + 1)
        ways[0] = 1.0
        for i in range(1, n + 1):
            ways[i:] = ways[i:] + ways[: top + 1 - i].copy()
        return float(min(1.0, ways[math.ceil(best - 1e-9):].sum() / ways.sum()))
    var = n * (n + 1.0) * (2 * n + 1.0) / 24.0 - ties / 48.0
    if var <= 0:
        return 1.0
    return 0.5 * math.erfc((best - top / 2.0) / math.sqrt(var) / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def signed_p(w_plus: pd.Series, n: pd.Series, ties: pd.Series, alternative: pd.Series) -> pd.Series:
    return pd.Series(
        [signed_p_value(float(w), int(m), float(t), alt) for w, m, t, alt in zip(w_plus, n, ties, alternative)]
    )


def directed_signed_test(sums: DataFrame, forced: Column | None = None) -> DataFrame:
    """One-sided in the direction of the mean difference; no direction gives (0, 1)."""
    direction = F.when(F.col("mean_diff") > 0, "greater").when(F.col("mean_diff") < 0, "less")
    if forced is not None:
        direction = F.when(forced, "greater").otherwise(direction)
    ready = sums.withColumn("direction", direction)
    p = signed_p("w_plus", "n", "ties", F.coalesce("direction", F.lit("greater")))
    return ready.select(
        "*",
        F.when(F.col("direction").isNull(), 0.0).otherwise(F.col("w_plus")).alias("statistic"),
        F.when(F.col("direction").isNull(), 1.0).otherwise(p).alias("p_value"),
    )


def noninferiority_signed_test(
    pairs: DataFrame, keys: Sequence[str], diff: Column, delta: float = fixed.NONINFERIORITY_DELTA
) -> DataFrame:
    sums = signed_sums(pairs, keys, diff + F.lit(delta))
    return sums.withColumn("statistic", F.col("w_plus")).withColumn(
        "p_value", signed_p("w_plus", "n", "ties", F.lit("greater"))
    )


def holm(df: DataFrame, family: Sequence[str], p: str, out: str = "p_adjusted") -> DataFrame:
    """Step-down adjusted p-values inside each family of hypotheses; a null p stays null and counts for nothing.

    Equal p-values are one row with a count. Ranks and the running maximum are carried
    over segments of p, so a family may be a whole archive.
    """
    keys = [f"_f{i}" for i in range(len(family))]
    counts = (
        df.where(F.col(p).isNotNull()).groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(family, keys)], F.col(p).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    counts = stage(with_segments(counts, "_p"), "p-values")
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    ranked = scan(counts, keys, ["_p"], {"_upto": ("sum", F.col("_c"))}, "_seg").join(sizes, keys)
    ranked = stage(ranked, "p-ranks")  # the second scan reads it twice
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_upto") + F.col("_c")) * F.col("_p"))
    adjusted = scan(ranked, keys, ["_p"], {out: ("max", step)}, "_seg").select(*keys, "_p", F.col(out).alias("_adjusted"))
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(k) for c, k in zip(family, keys)]
    return df.join(adjusted, [*same, F.col(p) == F.col("_p")], "left").withColumn(out, F.col("_adjusted")).drop(*keys, "_p", "_adjusted")


def pairwise_rank_tests(
    finals: DataFrame,
    order: DataFrame,
    alpha: float = 0.05,
) -> DataFrame:
    """Two-sided test of every tool pair on final counts, Bonferroni over *all* pairs.

    ``finals``: (tool, found), one row per replicate. ``order``: (tool,
    position). Pairs with fewer than two runs on a side carry no test.
    """
    counts = finals.groupBy("tool", "found").agg(F.count(F.lit(1)).alias("_c"))
    medians = quantiles(finals, ["tool"], "found", {"median": 0.5})
    own = ("tool", "position", "n", "median")
    dim = order.select("tool", "position").join(medians, "tool", "left")
    pairs = (
        peers(dim, own)
        .select(*[F.col(c).alias(f"{c}_a") for c in own], *[F.col(f"peer.{c}").alias(f"{c}_b") for c in own])
        .where(F.col("position_a") < F.col("position_b"))
    )
    n_pairs = pairs.agg(F.count(F.lit(1)).alias("n")).scalar()
    sides = pairs.select(
        "tool_a", "tool_b",
        F.explode(
            F.array(
                F.struct(F.col("tool_a").alias("tool"), F.lit(True).alias("is_a")),
                F.struct(F.col("tool_b").alias("tool"), F.lit(False).alias("is_a")),
            )
        ).alias("_s"),
    ).select("tool_a", "tool_b", "_s.*")
    sums = rank_sums(
        counts.join(sides, "tool"), ["tool_a", "tool_b"], F.col("found"), F.col("is_a"), F.col("_c")
    ).drop("mean_x", "mean_y")
    p = rank_p("u", "n1", "n2", "ties", F.lit("two-sided"))
    tested = pairs.join(sums, ["tool_a", "tool_b"], "left").withColumn("n_comparisons", n_pairs)
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    effect = F.when(enough, a12())
    with_p = tested.withColumn("p_value", F.when(enough, p)).withColumn("a12", effect)
    corrected = F.least(F.col("p_value") * F.col("n_comparisons"), F.lit(1.0))
    return with_p.select(
        "tool_a", "tool_b",
        F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"),
        "median_a", "median_b",
        F.when(enough, F.col("u")).alias("u"),
        "a12",
        effect_class("a12").alias("effect"),
        "n_comparisons",
        "p_value",
        corrected.alias("p_corrected"),
        (corrected < alpha).alias("significant"),
        F.when(F.col("a12") > 0.5, ">").when(F.col("a12") < 0.5, "<").when(F.col("a12").isNotNull(), "=").alias("direction"),
        F.when(~F.coalesce(enough, F.lit(False)), "fewer than 2 runs")
        .when(F.least("n_a", "n_b") < 5, "fewer than 5 runs").alias("warning"),
    )


# --- bootstrap ------------------------------------------------------------------

#: Distinct values of a leaf, and draws that are made together.
LEAF, BLOCK = 1024, 200
#: Bits of a leaf's place inside its segment.
_PLACE = 20


def _leaves(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, is_x, leaf, n, values, counts, path): an arm's distinct values in leaves of a binary tree.

    A path has, from the root down, each node where the tree forks: how many rows
    lie below it and below its left side, and on which side the leaf is.
    """
    arm = [*keys, "is_x"]
    counts = with_segments(counts, "v")
    nth = F.row_number().over(Window.partitionBy(*arm, "_seg").orderBy("v")) - 1
    leaf = F.col("_seg").cast("bigint") * (1 << _PLACE) + F.floor(nth / LEAF)
    leaves = (
        counts.withColumn("_leaf", leaf).groupBy(*arm, "_leaf")
        .agg(F.sum("c").alias("_held"), F.sort_array(F.collect_list(F.struct("v", "c"))).alias("_vc"))
    )
    leaves = stage(leaves, "leaves")  # the rows behind a draw must not change between its parts
    levels = _PLACE + SEGMENTS.bit_length()
    up = lambda c, by: F.floor(c / F.pow(F.lit(2.0), by)).cast("bigint")
    above = leaves.select(*arm, "_leaf", "_held", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"))
    above = above.withColumn("_node", up(F.col("_leaf"), F.col("_level")))
    nodes = above.groupBy(*arm, "_level", "_node").agg(F.sum("_held").alias("_n"))
    right = F.sum(F.when(F.col("_node") % 2 == 1, F.col("_n")))
    left = F.sum(F.when(F.col("_node") % 2 == 0, F.col("_n")))
    forks = (
        nodes.groupBy(*arm, (F.col("_level") + 1).alias("_level"), up(F.col("_node"), F.lit(1)).alias("_node"))
        .agg(left.alias("_left"), right.alias("_right")).where(F.col("_left").isNotNull() & F.col("_right").isNotNull())
    )
    side = up(F.col("_leaf"), F.col("_level") - 1) % 2 == 1
    step = F.struct((-F.col("_level")).alias("level"), F.col("_node").alias("node"), F.col("_left").alias("left"), (F.col("_left") + F.col("_right")).alias("both"), side.alias("right"))
    paths = above.join(forks, [*arm, "_level", "_node"]).groupBy(*arm, "_leaf").agg(F.sort_array(F.collect_list(step)).alias("_path"))
    total = nodes.where(F.col("_level") == levels).groupBy(*arm).agg(F.sum("_n").alias("_rows"))
    return leaves.join(paths, [*arm, "_leaf"], "left").join(total, arm)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _partial_sums(arm: pa.Array, block: pa.Array, rows: pa.Array, leaf: pa.Array, path: pa.Array, values: pa.Array, draws: pa.Array) -> pa.Array:
    """What a leaf adds to the sum of each draw of a block; draws are multinomial over all values of the arm.

    The rows of a draw are shared out along the path by conditional binomials. The chance
    at a fork is seeded by the fork, so every leaf below it agrees on it.
    """
    out = []
    for name, nth, n, at, steps, vc, many in zip(*[c.to_pylist() for c in (arm, block, rows, leaf, path, values, draws)], strict=True):
        held = np.full(many, n, np.int64)
        for s in steps or ():
            fork = np.random.default_rng([name & (2**64 - 1), nth, 1 - s["level"], s["node"]])
            left = fork.binomial(held, s["left"] / s["both"])
            held = held - left if s["right"] else left
        v, c = np.array([x["v"] for x in vc]), np.array([x["c"] for x in vc], float)
        own = np.random.default_rng([name & (2**64 - 1), nth, 0, at])
        out.append(own.multinomial(held, c / c.sum()) @ v)
    return pa.array([o.tolist() for o in out], pa.list_(pa.float64()))


@F.arrow_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _bca(boot: pa.Array, theta: pa.Array, skew: pa.Array, spread: pa.Array, level: pa.Array) -> pa.Array:
    """Bias-corrected and accelerated limits from all draws of a group, its estimate and jackknife moments."""
    out = []
    for draws, t, third, second, confidence in zip(*[c.to_pylist() for c in (boot, theta, skew, spread, level)], strict=True):
        b = np.sort(np.array(draws, float))
        same = np.isclose(b, t, rtol=1e-12, atol=1e-15)  # equal up to summation order
        below = (np.count_nonzero((b < t) & ~same) + 0.5 * np.count_nonzero(same)) / len(b)
        z0 = NORMAL.inv_cdf(min(max(below, fixed.LEAST_SHARE), 1.0 - fixed.LEAST_SHARE))
        accel = third / (6.0 * second**1.5) if second else 0.0

        def limit(alpha: float) -> float:
            z = z0 + NORMAL.inv_cdf(alpha)
            share = NORMAL.cdf(z0 + z / (1.0 - accel * z)) if accel * z != 1.0 else alpha
            return float(np.quantile(b, min(max(share, 0.0), 1.0)))

        tail = (1.0 - confidence) / 2.0
        out.append({"low": limit(tail), "high": limit(1.0 - tail)})
    return pa.array(out, pa.struct([("low", pa.float64()), ("high", pa.float64())]))


def bca_ci(
    samples: DataFrame,
    keys: Sequence[str],
    value: Column,
    is_x: Column | None = None,
    level: float = 0.95,
    min_samples: int = fixed.MIN_VERDICT_SAMPLES,
    draws: int = fixed.BOOTSTRAP_DRAWS,
    seed: int = fixed.BOOTSTRAP_SEED,
) -> DataFrame:
    """BCa interval per group of a mean, or with ``is_x`` of a difference of means.

    Equal values are one with a count; an arm's values lie in leaves of at most LEAF, and a
    task draws BLOCK resamples of one leaf. Sums of a draw are merged by groups; only the
    draws of a group (a fixed number) ever meet. Null, infinite and undefined values are
    left out. The law is the same for every size, and draws repeat from run to run.
    """
    keys = list(keys)
    side = F.lit(True) if is_x is None else is_x
    counts = (
        samples.select(*keys, value.cast("double").alias("v"), side.alias("is_x"))
        .where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
        .groupBy(*keys, "is_x", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    arm = [*keys, "is_x"]
    means = counts.groupBy(*arm).agg(
        F.sum("c").alias("_n"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("_mean"), F.count(F.lit(1)).alias("_kinds")
    )
    sign = F.when(F.col("is_x"), 1.0).otherwise(-1.0)
    off = sign * (F.col("v") - F.col("_mean")) / (F.col("_n") - 1)  # a jackknife estimate less their mean
    moments = counts.join(means.where(F.col("_n") > 1), arm).groupBy(*keys).agg(
        F.sum(F.col("c") * off * off).alias("_m2"), F.sum(F.col("c") * off * off * off).alias("_m3")
    )
    wanted = 1 if is_x is None else 2
    arms = means.groupBy(*keys).agg(
        (F.count_if(F.col("_n") >= min_samples) == wanted).alias("_enough"), (F.max("_kinds") == 1).alias("_constant"),
        F.sum(sign * F.col("_mean")).alias("_theta"),
    )
    named = F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col("is_x"))
    drawn = arms.where(F.col("_enough") & ~F.col("_constant")).select(*keys)
    leaves = _leaves(counts.join(drawn, keys, "left_semi"), keys)
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // BLOCK)))
    many = F.least(F.lit(BLOCK), F.lit(draws) - F.col("_block") * BLOCK)
    parts = leaves.select("*", blocks.alias("_block")).select(
        *arm, "_block", "_rows",
        _partial_sums(named, F.col("_block"), F.col("_rows"), F.col("_leaf"), F.col("_path"), F.col("_vc"), many).alias("_sums"),
    ).select(*arm, "_block", "_rows", F.posexplode("_sums").alias("_at", "_sum"))
    sums = parts.groupBy(*keys, "_block", "_at").agg(F.sum(sign * F.col("_sum") / F.col("_rows")).alias("_estimate"))
    boots = sums.groupBy(*keys).agg(F.collect_list("_estimate").alias("_boot"))
    wide = arms.join(moments, keys, "left").join(boots, keys, "left")
    zero = F.lit(0.0)
    limits = _bca(F.col("_boot"), F.col("_theta"), F.coalesce("_m3", zero), F.coalesce("_m2", zero), F.lit(float(level)))
    held = wide.where(F.col("_boot").isNotNull()).select(*keys, "_enough", "_constant", "_theta", limits.alias("_ci"))
    rest = wide.where(F.col("_boot").isNull()).select(*keys, "_enough", "_constant", "_theta", F.lit(None).cast("struct<low: double, high: double>").alias("_ci"))

    def limit(end: str) -> Column:
        return F.when(~F.col("_enough"), None).when(F.col("_constant"), F.col("_theta")).otherwise(F.col(f"_ci.{end}"))

    status = F.when(F.col("_enough"), "ok").otherwise("insufficient n")
    return held.unionByName(rest).select(*keys, limit("low").alias("ci_low"), limit("high").alias("ci_high"), status.alias("ci_status"))
