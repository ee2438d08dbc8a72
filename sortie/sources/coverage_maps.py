"""Coverage maps: `edge:count` text files below `<instance>/showmap/<approach>/…`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coverage_approach, coverage_instance, normalize_tool, not_excluded, safe_component, strip
from .paths import first_part, relative_path


def read_edges(
    spark: SparkSession, root: str, exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trials, edges, rejects) of every map below ``root``."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root)
    lines = raw.select(relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("line"))
    return judge_maps(lines, exclude)


def judge_maps(
    lines: DataFrame, exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trials, edges, rejects) from map lines (path, line).

    A file with a malformed line, without any covered edge, or outside an
    approach folder is rejected as a whole and listed with the reason; only
    positive counts cover. Files are judged by aggregates over their lines.
    """
    raw = lines.select("path", strip("line").alias("line")).where(F.col("path").rlike(r"(^|/)showmap/"))
    inside = F.regexp_extract("path", r"(?:^|.*?/)showmap/(.*)$", 1)
    label = first_part(F.col("path"))
    who = coverage_instance(label)
    arm = coverage_approach(first_part(inside))
    trial = F.regexp_replace(F.regexp_replace(F.regexp_replace(inside, r"^[^/]*/", ""), r"\.[^./]*$", ""), "/", "__")
    in_folder = inside.contains("/")
    named = raw.select(
        "path", "line", label.alias("instance_label"), who.alias("_who"), arm.alias("_arm"), trial.alias("_trial"), in_folder.alias("_ok")
    ).select(
        "path", "line", "instance_label", "_trial", "_ok",
        F.col("_who.instance_id").alias("instance_id"), F.col("_who.tool_label").alias("tool_label"),
        F.col("_who.target_label").alias("target_label"), F.col("_who.seed_label").alias("seed_label"),
        F.col("_arm.approach").alias("_approach"), F.col("_arm.suite_test").alias("_suite"),
    )
    kept = named.where(
        ~F.col("_ok")
        | not_excluded(exclude, "_approach", normalize_tool("_approach"), "tool_label", normalize_tool("tool_label"))
    )
    count_text = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    well_formed = F.col("line").contains(":") & count_text.rlike(r"^[+-]?\d+$")
    hit = well_formed & (count_text.try_cast("decimal(38,0)") > 0)
    judged = kept.groupBy("path").agg(
        F.bool_or(~F.col("_ok")).alias("_outside"),
        F.bool_or((F.col("line") != "") & ~well_formed).alias("_bad"),
        F.bool_or(hit).alias("_any"),
    )
    reason = (
        F.when(F.col("_outside"), "missing approach directory")
        .when(F.col("_bad"), "malformed line")
        .when(~F.col("_any"), "empty coverage")
    )
    judged = judged.withColumn("reason", reason)
    rejects = judged.where(F.col("reason").isNotNull()).select("path", "reason")
    accepted = judged.where(F.col("reason").isNull()).select("path")
    good = kept.where(hit).join(accepted, "path", "left_semi")
    seeded = F.when(F.col("seed_label").isNotNull(), F.concat(F.lit("seed-"), F.col("seed_label"))).otherwise(
        F.concat_ws("__", "instance_label", "_trial")
    )
    columns = [
        "instance_label", "instance_id", "tool_label", "target_label", "seed_label",
        safe_component("_approach").alias("approach"),
        F.when(F.col("_suite").isNotNull(), safe_component("_suite")).alias("suite_test"),
        safe_component(seeded).alias("trial_id"), "path",
    ]
    edges = good.select(*columns, F.trim(F.substring_index("line", ":", 1)).alias("edge")).distinct()
    trials = good.select(*columns).distinct()
    return trials, edges, rejects
