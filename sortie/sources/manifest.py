"""Content manifests: path, size and hash per file, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import relative_path


def content_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        relative_path(F.col("path"), root).alias("path"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"),
    )


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that were added, removed or changed; empty means the trees are equal."""
    b = before.select("path", F.col("sha256").alias("_b"))
    a = after.select("path", F.col("sha256").alias("_a"))
    kind = (
        F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
        .when(F.col("_a") != F.col("_b"), "changed")
    )
    return b.join(a, "path", "full").select("path", kind.alias("change")).where(F.col("change").isNotNull())


def gathered_names(files: DataFrame) -> DataFrame:
    """Flat name of each file within its instance: (instance_label, path, name).

    The first path of a name keeps it; others are prefixed by their folders.
    Readers here use full paths instead, so this only matters for exports.
    """
    name = F.substring_index("path", "/", -1)
    folders = F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), "/", "__")
    named = files.select("instance_label", "path", name.alias("_name"))
    owner = named.groupBy("instance_label", "_name").agg(F.min("path").alias("_owner"))
    return named.join(owner, ["instance_label", "_name"]).select(
        "instance_label", "path",
        F.when((F.col("path") == F.col("_owner")) | ~F.col("path").contains("/"), F.col("_name"))
        .otherwise(F.concat_ws("__", folders, "_name")).alias("name"),
    )
