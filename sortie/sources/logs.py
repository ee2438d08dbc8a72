"""Raw logs as ordered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import instance_id, normalize_tool, not_excluded, run_id_from_path, tool_label
from .paths import file_name, first_part, relative_path


def ordered_lines(
    spark: SparkSession,
    root: str,
    run_id: str | None = None,
    raw_labels: bool = False,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Every `*.log` below ``root``, one row per line.

    (run_id, instance_id, tool, tool_label, log_path, block, pos, line). A
    file is read in blocks by several tasks; (block, pos) is its line order,
    and `block` is the segment that ordered scans work in. The full relative
    path is the file's key, so equal names never overwrite each other.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(root)
    rel = relative_path(F.col("_metadata.file_path"), root)
    lines = raw.select(
        rel.alias("log_path"),
        F.col("_metadata.file_path").alias("_full"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )
    return labelled(lines, run_id, raw_labels, exclude)


def labelled(lines: DataFrame, run_id: str | None = None, raw_labels: bool = False, exclude: Sequence[str] = ()) -> DataFrame:
    """Adds what paths tell: (log_path, _full, block, pos, line) to the lines table, without files that are no logs."""
    name = file_name(F.col("log_path"))
    label = first_part(F.col("log_path"))
    named = lines.where(
        F.col("log_path").contains("/")
        & name.rlike(r".+\.log$")
        & ~F.lower(name).isin(*fixed.IGNORED_LOGS)
    ).withColumn("tool_label", tool_label(label))
    run = F.lit(run_id) if run_id else F.coalesce(run_id_from_path("_full"), F.lit("unknown"))
    return named.select(
        run.alias("run_id"),
        instance_id(label).alias("instance_id"),
        (F.col("tool_label") if raw_labels else normalize_tool("tool_label")).alias("tool"),
        "tool_label",
        "log_path",
        "block",
        "pos",
        "line",
    ).where(not_excluded(exclude, "tool", "tool_label"))


def tails(lines: DataFrame, n: int, keys: Sequence[str] = ("log_path",)) -> DataFrame:
    """Last ``n`` lines of every file with the file's size in characters and lines.

    Each block first keeps only its own last ``n`` lines, so a huge file never
    meets one task.
    """
    keys = list(keys)
    in_block = Window.partitionBy(*keys, "block").orderBy(F.desc("pos"))
    in_file = Window.partitionBy(*keys).orderBy(F.desc("block"), F.desc("pos"))
    kept = (
        lines.withColumn("_r", F.row_number().over(in_block)).where(F.col("_r") <= n)
        .withColumn("from_end", F.row_number().over(in_file)).where(F.col("from_end") <= n)
    )
    size = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars")
    )
    return kept.select(*keys, "from_end", "line").join(size, keys)
