"""Saved input corpora: which files hold call sequences, per engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import instance_id, normalize_tool, not_excluded, tool_label
from .elements import array_elements, read_pieces
from .paths import first_part, relative_path

NAMES = "*.{txt,json,gz,TXT,JSON,GZ}"


def is_artifact(engine: Column, inside: Column) -> Column:
    """Does the path below the instance folder belong to the engine's corpus?"""
    lower = F.lower(inside)
    folders = F.slice(F.split(lower, "/"), 1, F.greatest(F.size(F.split(lower, "/")) - 1, F.lit(0)))

    def below(name: str) -> Column:
        return F.array_contains(folders, name)

    return (
        F.when(engine.isin("echidna", "recon-fuzzer"), below("coverage") & lower.endswith(".txt"))
        .when(engine == "medusa", below("call_sequences") & lower.endswith(".json"))
        .when(engine == "foundry", below("corpus") & (lower.endswith(".json") | lower.endswith(".json.gz")))
        .otherwise(F.lit(False))
    )


def _named(files: DataFrame, run_id: str, raw_labels: bool, exclude: Sequence[str]) -> DataFrame:
    """Instance columns from `path`, for the files that belong to a corpus; other columns stay."""
    label = first_part(F.col("path"))
    raw = tool_label(label, ignore_case=True)
    engine = normalize_tool(raw)
    inside = F.regexp_replace("path", r"^[^/]*/", "")
    return (
        files.where(F.col("path").contains("/") & (instance_id(label, ignore_case=True) != "unknown"))
        .where(is_artifact(engine, inside))
        .select(
            F.lit(run_id).alias("run_id"), label.alias("instance_label"), instance_id(label, ignore_case=True).alias("instance_id"),
            engine.alias("engine"), (raw if raw_labels else engine).alias("tool"), raw.alias("tool_label"), *files.columns,
        )
        .where(not_excluded(exclude, "engine", "tool_label"))
    )


def read_artifacts(
    spark: SparkSession,
    root: str,
    run_id: str = "unknown",
    raw_labels: bool = False,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """One row per corpus file: instance columns, path, bytes, content.

    Compressed files are read through their codec. Size limits are reported
    by ``selectors.instance_summary``, nothing is cut. A file must fit a row;
    `read_elements` takes files of any size.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).text(root, wholetext=True)
        .select(relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("content"))
        .select("path", F.octet_length("content").cast("bigint").alias("bytes"), "content")
    )
    return _named(files, run_id, raw_labels, exclude)


def read_elements(
    spark: SparkSession,
    root: str,
    run_id: str = "unknown",
    raw_labels: bool = False,
    exclude: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(elements, files) of the corpora: a row per array element, and per file its bytes and whether it is well formed.

    Files are read in splits and may be of any size; an element must fit a row. Both
    tables have the instance columns and the path. Files without a byte are not listed,
    here as in `read_artifacts`.
    """
    pieces = _named(read_pieces(spark, root, NAMES), run_id, raw_labels, exclude).select("path", "block", "pos", "piece")
    elements, files = array_elements(pieces)
    names = (run_id, raw_labels, exclude)
    return _named(elements, *names), _named(files, *names)
