"""Coverage campaigns: rarity scores, relative coverage, baseline pairs, sizes.

A trial's edges are a bitmap: edges are numbered densely over the whole table, and
a set is stored as (word, mask) rows of 64 numbers each, empty words left out. Unions
are `bit_or`, overlaps `bit_count` of two masks. All scores follow from the overlaps
of trials with approaches: a trial's rarity score is the sum over approaches of its
edges less the overlap, and relative coverage is overlap over reference.

Tables may carry `run_id`; every result is then per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_baseline_name
from ..session import stage
from .numbering import dense_numbers
from .ordered import quantiles

ARM = ("campaign", "approach")
TRIAL = ("campaign", "approach", "trial_id")
WORD = 64


def scoped(df: DataFrame, *names: str) -> list[str]:
    """The names, after `run_id` where the table has it."""
    return [*(["run_id"] if "run_id" in df.columns else []), *names]


def edge_sets(rows: DataFrame) -> DataFrame:
    """Replaces `edge` by `word` and `mask`, one row per set and word that is not empty; staged.

    Rows of equal other columns are one set; a repeated edge counts once and a null
    one is no edge. Edges that sort side by side share words, so the edges of one
    target make dense words.
    """
    others = [c for c in rows.columns if c != "edge"]
    numbers = dense_numbers(rows, "edge", "_number")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_number") % WORD).cast("int"))
    words = (
        rows.join(numbers, "edge")
        .groupBy(*others, F.floor(F.col("_number") / WORD).alias("word")).agg(F.bit_or(bit).alias("mask"))
    )
    return stage(words, "edge-sets")


def _campaign_names() -> Column:
    t, s = F.col("target_label"), F.col("suite_test")
    target, test = F.concat(F.lit("by_target/"), t), F.concat(F.lit("by_test/"), s)
    return F.array_compact(F.array(F.lit("combined"), target, test, F.concat(target, F.lit("/"), test)))


def campaigns(rows: DataFrame) -> DataFrame:
    """Every campaign a trial belongs to; a trial's sets are united there.

    Takes (approach, target_label, suite_test, trial_id) with word and mask for sets,
    without for trials. Rows whose label is missing are not in the labelled campaigns.
    """
    named = rows.withColumn("campaign", F.explode(_campaign_names()))
    if "word" not in rows.columns:
        return trials_of(named)
    return named.groupBy(*scoped(rows, *TRIAL), "word").agg(F.bit_or("mask").alias("mask"))


def trials_of(sets: DataFrame) -> DataFrame:
    return sets.select(*scoped(sets, *TRIAL)).distinct()


def unions(sets: DataFrame) -> DataFrame:
    """The edges each approach ever hit, as words."""
    return sets.groupBy(*scoped(sets, *ARM), "word").agg(F.bit_or("mask").alias("mask"))


def campaign_size(sets: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """Trials and distinct edges per approach, and the work items of the whole campaign."""
    trials = trials_of(sets) if trials is None else trials
    arm, campaign = scoped(sets, *ARM), scoped(sets, "campaign")
    per_arm = unions(sets)
    edges = per_arm.groupBy(*arm).agg(F.sum(F.bit_count("mask")).alias("edges"))
    counts = trials.groupBy(*arm).agg(F.count(F.lit(1)).alias("trials"))
    whole = per_arm.groupBy(*campaign, "word").agg(F.bit_or("mask").alias("mask"))
    whole = whole.groupBy(*campaign).agg(F.sum(F.bit_count("mask")).alias("_edges"))
    all_trials = trials.groupBy(*campaign).agg(F.count(F.lit(1)).alias("_trials"))
    work = all_trials.join(whole, campaign, "left").select(
        *campaign,
        (F.coalesce("_edges", F.lit(0)) * F.greatest(F.col("_trials"), F.lit(1))).alias("work_items"),
    )
    return counts.join(edges, arm, "left").fillna(0, subset=["edges"]).join(work, campaign)


def overlaps(sets: DataFrame) -> DataFrame:
    """(trial columns, reference, shared): how many edges of a trial an approach of its campaign ever hit.

    Only pairs that share a word are there; with its own approach a trial shares all
    its edges. One join of words, in which a key meets a row per approach.
    """
    held = unions(sets).select(
        *scoped(sets, "campaign"), "word", F.col("approach").alias("reference"), F.col("mask").alias("_held")
    )
    return (
        sets.join(held, scoped(sets, "campaign", "word"))
        .groupBy(*scoped(sets, *TRIAL), "reference")
        .agg(F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col("_held")))).alias("shared"))
    )


def _own() -> Column:
    return F.sum(F.when(F.col("reference") == F.col("approach"), F.col("shared")))


def _scored(sets: DataFrame, trials: DataFrame | None, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Per trial: own_edges and score, zero included; `extra` aggregates see its overlaps.

    Without ``trials`` they are those of the sets, each of which overlaps with its own approach.
    """
    campaign, trial = scoped(sets, "campaign"), scoped(sets, *TRIAL)
    arms = (unions(sets) if trials is None else trials).groupBy(*campaign).agg(F.count_distinct("approach").alias("_arms"))
    sums = overlaps(sets).groupBy(*trial).agg(_own().alias("own_edges"), F.sum("shared").alias("_all"), *extra)
    joined = (sums if trials is None else trials.join(sums, trial, "left")).join(arms, campaign)
    score = F.col("_arms") * F.col("own_edges") - F.col("_all")
    return (
        joined.withColumn("score", F.coalesce(score, F.lit(0)).cast("double"))
        .withColumn("own_edges", F.coalesce("own_edges", F.lit(0))).drop("_arms", "_all")
    )


def trial_scores(sets: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """Rarity score of every trial: its edges weighted by the approaches that never hit them."""
    return _scored(sets, trials).select(*scoped(sets, *TRIAL), "score")


def relscore(sets: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """Rarity score per approach: the mean over its trials that hit anything, zero without one."""
    full = F.count_if(F.col("own_edges") > 0)
    return _scored(sets, trials).groupBy(*scoped(sets, *ARM)).agg(
        F.coalesce(F.try_divide(F.sum("score"), full), F.lit(0.0)).alias("relscore")
    )


def relcov_samples(
    sets: DataFrame,
    trials: DataFrame | None = None,
    references: DataFrame | None = None,
) -> DataFrame:
    """Share of a reference approach's edges each trial covers, zero overlap included.

    ``references`` (campaign, reference) narrows the references.
    """
    trials = trials_of(sets) if trials is None else trials
    campaign, trial = scoped(sets, "campaign"), scoped(sets, *TRIAL)
    sizes = unions(sets).groupBy(*campaign, F.col("approach").alias("reference")).agg(F.sum(F.bit_count("mask")).alias("_u"))
    refs = (
        trials.select(*campaign, F.col("approach").alias("reference")).distinct()
        .join(sizes, [*campaign, "reference"], "left")
        .select(*campaign, "reference", F.coalesce("_u", F.lit(0)).alias("reference_edges"))
    )
    if references is not None:
        refs = refs.join(references, scoped(references, "campaign", "reference"), "left_semi")
    shared = F.coalesce("shared", F.lit(0))
    return (
        trials.join(refs, campaign).join(overlaps(sets), [*trial, "reference"], "left")
        .select(
            *trial, "reference", shared.alias("shared"), "reference_edges",
            F.coalesce(F.try_divide(shared, "reference_edges"), F.lit(0.0)).alias("relcov"),
        )
    )


def relcov(samples: DataFrame) -> DataFrame:
    """Median over trials per (approach, reference)."""
    keys = scoped(samples, *ARM, "reference")
    return quantiles(samples, keys, "relcov", {"relcov": 0.5}).select(*keys, "relcov")


def baseline_feature(trials: DataFrame) -> DataFrame:
    """Campaigns with exactly two approaches of which exactly one is a baseline by name."""
    campaign = scoped(trials, "campaign")
    arms = trials.select(*campaign, "approach").distinct().withColumn("_base", is_baseline_name("approach"))
    return (
        arms.groupBy(*campaign)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if("_base").alias("_b"),
            F.max(F.when(F.col("_base"), F.col("approach"))).alias("baseline"),
            F.max(F.when(~F.col("_base"), F.col("approach"))).alias("feature"),
        )
        .where((F.col("_n") == 2) & (F.col("_b") == 1))
        .select(*campaign, "baseline", "feature")
    )


def pair_measures(sets: DataFrame, trials: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per trial of a baseline/feature pair: rarity score and coverage of the baseline.

    One join of words gives both. ``relcov`` is NULL where the baseline has no edges at all.
    """
    campaign, trial = scoped(sets, "campaign"), scoped(sets, *TRIAL)
    chosen = pairs.select(*campaign, "baseline", "feature")
    words = sets.join(chosen, campaign)
    runs = trials.join(chosen.select(*campaign), campaign, "left_semi")
    # of two approaches the other one's overlap is all overlaps less the own
    other = F.sum(F.when(F.col("reference") != F.col("approach"), F.col("shared"))).alias("_other")
    scored = _scored(words.select(sets.columns), runs, (other,)).join(chosen, campaign)
    size = unions(words.where(F.col("approach") == F.col("baseline")).select(sets.columns))
    size = size.groupBy(*campaign).agg(F.sum(F.bit_count("mask")).alias("_ref"))
    is_x = F.col("approach") == F.col("feature")
    shared = F.when(is_x, F.coalesce("_other", F.lit(0))).otherwise(F.col("own_edges"))
    return scored.join(size, campaign, "left").select(
        *trial, "baseline", "feature", is_x.alias("is_x"), "own_edges", "score",
        (shared / F.col("_ref")).alias("relcov"),
    )
