"""Ordered computations that survive one group holding most of the rows.

A plain window over a group puts the whole group into one task. Here a group
is cut into segments that follow the order; windows run inside segments, one
small row per segment is carried across, and the two are combined. Results
equal the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("first", "last", "prev", "sum", "max", "min", "prior_max")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carries: Mapping[str, tuple[str, Column]],
    segment: str | None = None,
) -> DataFrame:
    """Add running values per group: name -> (kind, column).

    ``first``/``last`` carry the first/latest non-null value up to this row,
    ``prev`` the latest non-null value strictly before it, ``sum``/``max``/
    ``min`` run up to this row and ``prior_max`` strictly before it (NULL adds
    nothing). ``segment`` names a
    column that never decreases along ``order``; keys must not be NULL. Without
    it the group is one window: only for groups with a known row bound.
    """
    keys = list(keys)
    folds = {"sum": F.sum, "max": F.max, "min": F.min, "prior_max": F.max}
    for name, (kind, value) in carries.items():
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        df = df.withColumn(f"_v_{name}", value)

    part = Window.partitionBy(*keys, *([segment] if segment else [])).orderBy(*order)
    upto = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = part.rowsBetween(Window.unboundedPreceding, -1)

    def local(name: str, kind: str) -> Column:
        v = F.col(f"_v_{name}")
        if kind == "first":
            return F.first(v, ignorenulls=True).over(upto)
        if kind == "last":
            return F.last(v, ignorenulls=True).over(upto)
        if kind == "prev":
            return F.last(v, ignorenulls=True).over(before)
        if kind == "prior_max":
            return F.max(v).over(before)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](v).over(upto)

    inside = df.select("*", *[local(n, k).alias(n) for n, (k, _) in carries.items()])
    if segment is None:
        return inside.drop(*[f"_v_{n}" for n in carries])

    place = F.struct(*[F.col(c) for c in order])

    def total(name: str, kind: str) -> Column:
        v = F.col(f"_v_{name}")
        at = F.when(v.isNotNull(), place)
        if kind == "first":
            return F.min_by(v, at)
        if kind in ("last", "prev"):
            return F.max_by(v, at)
        return folds[kind](v)

    totals = df.groupBy(*keys, segment).agg(
        *[total(n, k).alias(f"_t_{n}") for n, (k, _) in carries.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    )

    def prefix(name: str, kind: str) -> Column:
        t = F.col(f"_t_{name}")
        if kind == "first":
            return F.first(t, ignorenulls=True).over(earlier)
        if kind in ("last", "prev"):
            return F.last(t, ignorenulls=True).over(earlier)
        return folds[kind](t).over(earlier)

    carried = totals.select(
        *keys, segment, *[prefix(n, k).alias(f"_p_{n}") for n, (k, _) in carries.items()]
    )

    def combined(name: str, kind: str) -> Column:
        here, there = F.col(name), F.col(f"_p_{name}")
        if kind == "first":
            return F.coalesce(there, here)
        if kind in ("last", "prev"):
            return F.coalesce(here, there)
        if kind == "sum":
            return F.coalesce(here + there, here, there)
        return F.least(here, there) if kind == "min" else F.greatest(here, there)

    joined = inside.join(carried, [*keys, segment])
    extra = [f"_v_{n}" for n in carries] + [f"_p_{n}" for n in carries] + list(carries)
    kept = [c for c in inside.columns if c not in extra]
    return joined.select(*kept, *[combined(n, k).alias(n) for n, (k, _) in carries.items()])


def keep_signals(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows that carry at least one of the value columns.

    The test runs on finished values behind a generator: as a plain filter it
    would be pushed below the projection and every pattern matched twice.
    """
    row = F.struct(*[F.col(v) for v in values])
    found = lambda r: ~reduce(lambda a, b: a & b, [r[v].isNull() for v in values])
    return df.select(*keys, F.inline(F.filter(F.array(row), found)))


#: Segments that a value order is cut into.
SEGMENTS = 256


def with_segments(counts: DataFrame, value: str, name: str = "_seg") -> DataFrame:
    """Adds the segment of a DOUBLE column, which never decreases as the value grows.

    The cuts are quantiles of the table's own rows, from a mergeable sketch whose
    rank error is a tenth of a segment at most: no segment holds more than about
    1 / SEGMENTS of the rows unless they are one value. Eight comparisons find it.
    """
    shares = F.array(*[F.lit(i / SEGMENTS) for i in range(1, SEGMENTS)])
    cuts = counts.agg(
        F.percentile_approx(value, shares, 10 * SEGMENTS).alias("_cuts"),
        F.max(F.xxhash64(*counts.columns)).alias("_all"),  # with all columns in use, both sides read one shuffle
    )
    steps = F.array(*[F.lit(SEGMENTS >> i) for i in range(1, SEGMENTS.bit_length())])
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.get("_cuts", at + step - 1) <= F.col(value), step).otherwise(0)
    )
    return counts.crossJoin(cuts).select(*counts.columns, found.alias(name))  # one row


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, plus the row count ``n``.

    The built-in exact percentile holds a group's distinct values in one
    task's heap. This counts values first (map-side combined), cuts each group
    into value segments, finds from the segment totals which segments hold the
    wanted ranks, and orders only those. NULL and NaN are left out; a group of
    only those is absent.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, v.alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    counts = with_segments(counts, "_x")
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    segments = (
        counts.groupBy(*keys, "_seg")
        .agg(F.sum("_c").alias("_held"))
        .select(
            *keys,
            "_seg",
            "_held",
            F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_held").over(group).alias("n"),
        )
    )
    ranks = {
        f"_{name}_{side}": cut(F.lit(float(q)) * (F.col("n") - 1))
        for name, q in points.items()
        for side, cut in (("lo", F.floor), ("hi", F.ceil))
    }
    wanted = reduce(
        lambda a, b: a | b,
        [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_held")) for r in ranks.values()],
    )
    inside = Window.partitionBy(*keys, "_seg").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(segments.where(wanted).drop("_held"), [*keys, "_seg"]).withColumn(
        "_hi", F.col("_before") + F.sum("_c").over(inside)
    )
    picks = [
        F.max(F.when((F.col("_hi") - F.col("_c") <= r) & (r < F.col("_hi")), F.col("_x"))).alias(name)
        for name, r in ranks.items()
    ]
    out = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)

    def between(name: str, q: float) -> Column:
        at = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return out.select(*keys, "n", *[between(n, q) for n, q in points.items()])


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    points: Mapping[str, float],
) -> DataFrame:
    """``quantiles`` of several columns in one pass: ``<value>_n`` and ``<value>_<point>``.

    Every group of ``df`` is present; a column without values gives NULL.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("_metric"), F.col(c).cast("double").alias("_value"))
                    for c in values
                ]
            )
        ).alias("_m"),
    ).select(*keys, "_m._metric", "_m._value")
    found = quantiles(long, [*keys, "_metric"], "_value", points)
    picked = []
    for c in values:
        is_c = F.col("_metric") == c
        picked.append(F.coalesce(F.max(F.when(is_c, F.col("n"))), F.lit(0).cast("bigint")).alias(f"{c}_n"))
        picked += [F.max(F.when(is_c, F.col(p))).alias(f"{c}_{p}") for p in points]
    wide = found.groupBy(*keys).agg(*picked)
    return (
        df.select(*keys)
        .distinct()
        .join(wide, keys, "left")
        .fillna(0, subset=[f"{c}_n" for c in values])
    )
