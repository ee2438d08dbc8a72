"""Table-shaped inputs: event and sample CSVs, wide curves, host metrics, catalogs, keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.scalars import instance_id, normalize_tool, strip, to_number, tool_label
from .paths import file_name, first_part, relative_path

EVENT_FIELDS = ("run_id", "instance_id", "fuzzer", "fuzzer_label", "event", "elapsed_seconds", "source", "log_path")
STRICT_FIELDS = ("elapsed_seconds", "event", "fuzzer", "instance_id", "run_id")
SAMPLE_FIELDS = ("fuzzer", "run_id", "instance_id", "elapsed_seconds")
HOST_FIELDS = (
    "timestamp", "uptime_seconds", "cpu_user_pct", "cpu_system_pct", "cpu_iowait_pct", "mem_total_kb", "mem_used_kb",
)


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header, every column as text: coercion is the caller's rule."""
    return spark.read.option("header", "true").option("escape", '"').csv(path)


def _column(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def events_lenient(raw: DataFrame) -> DataFrame:
    """Missing columns become `unknown`, the label falls back to the tool, bad times drop the row."""
    unknown = F.lit("unknown")
    tool = F.coalesce(_column(raw, "fuzzer"), unknown)
    return raw.select(
        *[F.coalesce(_column(raw, c), unknown).alias(c) for c in ("run_id", "instance_id")],
        tool.alias("tool"),
        F.coalesce(_column(raw, "fuzzer_label"), tool).alias("tool_label"),
        F.coalesce(_column(raw, "event"), unknown).alias("event"),
        to_number(_column(raw, "elapsed_seconds")).alias("elapsed_seconds"),
        *[F.coalesce(_column(raw, c), unknown).alias(c) for c in ("source", "log_path")],
    ).where(F.col("elapsed_seconds").isNotNull())


def events_strict(raw: DataFrame) -> DataFrame:
    """Five required columns; any time that is no number fails the job (one small action)."""
    missing = sorted(set(STRICT_FIELDS) - set(raw.columns))
    if missing:
        raise ValueError("events are missing columns: " + ", ".join(missing))
    bad = raw.where(to_number("elapsed_seconds").isNull()).select(*STRICT_FIELDS).take(5)
    if bad:
        raise ValueError("invalid elapsed_seconds in: " + "; ".join(str(r.asDict()) for r in bad))

    def text(*names: str, default: str = ""):
        return strip(F.coalesce(*[F.nullif(_column(raw, n), F.lit("")) for n in names], F.lit(default)))

    return raw.select(
        text("run_id", default="unknown").alias("run_id"),
        text("instance_id", default="unknown").alias("instance_id"),
        text("fuzzer", default="unknown").alias("tool"),
        text("fuzzer_label", "fuzzer", default="unknown").alias("tool_label"),
        text("event").alias("event"),
        to_number("elapsed_seconds").alias("elapsed_seconds"),
        text("source").alias("source"),
        text("log_path").alias("log_path"),
    )


def metric_samples(raw: DataFrame, values: Sequence[str], strict_nonnegative: Sequence[str] = ()) -> DataFrame:
    """Samples with a series id and hours; values that are no numbers are NULL.

    A strict column fails the job on text that is no finite non-negative number.
    """
    missing = [c for c in (*SAMPLE_FIELDS, *values) if c not in raw.columns]
    if missing:
        raise ValueError("samples are missing columns: " + ", ".join(missing))
    for c in strict_nonnegative:
        given = strip(F.coalesce(F.col(c), F.lit("")))
        bad = raw.where((given != "") & ~F.coalesce(to_number(c) >= 0, F.lit(False))).select(*SAMPLE_FIELDS, c).take(5)
        if bad:
            raise ValueError(f"malformed non-negative {c}: " + "; ".join(str(r.asDict()) for r in bad))
    hours = to_number("elapsed_seconds") / 3600.0
    return raw.select(
        F.col("fuzzer").cast("string").alias("tool"),
        F.col("run_id").cast("string").alias("run_id"),
        F.col("instance_id").cast("string").alias("instance_id"),
        F.concat_ws(":", "run_id", "instance_id").alias("series_id"),
        hours.alias("time_hours"),
        *[to_number(c).alias(c) for c in values],
        F.coalesce(_column(raw, "source"), F.lit("")).alias("source"),
    ).where(F.col("time_hours").isNotNull())


def wide_to_long(wide: DataFrame, time: str = "time_hours") -> DataFrame:
    """Columns `<tool>_run<id>` become rows; other columns are left out."""
    series = [c for c in wide.columns if c != time and "_run" in c]
    if not series:
        raise ValueError("no columns match <tool>_run<id>")
    long = wide.unpivot([time], series, "_series", "found")
    parts = F.split("_series", "_run", 2)
    return long.select(parts[0].alias("tool"), F.trim(parts[1]).alias("run_id"), F.col(time), "found")


def read_host_metrics(spark: SparkSession, root: str, run_id: str, raw_labels: bool = False) -> DataFrame:
    """Host samples of every metrics CSV below ``root``, with instance columns and line numbers.

    Files are told by name; empty ones and ones without a required column add
    nothing. Columns are found by the header of each file, so files may differ.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(root)
        .select(
            relative_path(F.col("_metadata.file_path"), root).alias("metrics_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_no"),
            F.col("value"),
        )
        .where(
            F.col("metrics_path").contains("/")
            & F.lower(file_name(F.col("metrics_path"))).rlike(r"runner[_-]metrics")
        )
    )
    heads = files.where(F.col("block") == 0).groupBy("metrics_path").agg(
        F.min_by("value", "line_no").alias("_head"), F.min("line_no").alias("_head_no")
    )
    heads = heads.withColumn("_names", F.transform(F.split("_head", ","), lambda c: F.trim(c))).where(
        F.size(F.array_intersect("_names", F.array(*[F.lit(c) for c in HOST_FIELDS]))) == len(HOST_FIELDS)
    )
    rows = files.join(heads, "metrics_path").where((F.col("block") > 0) | (F.col("line_no") > F.col("_head_no")))
    cells = F.split("value", ",", -1)
    label = first_part(F.col("metrics_path"))

    def cell(name: str):
        return F.get(cells, (F.array_position("_names", name) - 1).cast("int")).alias(name)

    raw_label = tool_label(label)
    return rows.where(F.trim("value") != "").select(
        F.lit(run_id).alias("run_id"),
        instance_id(label).alias("instance_id"),
        label.alias("instance_label"),
        (raw_label if raw_labels else normalize_tool(raw_label)).alias("tool"),
        raw_label.alias("tool_label"),
        "metrics_path", "block", "line_no",
        *[cell(c) for c in HOST_FIELDS],
    )


# --- catalogs and manifests -----------------------------------------------------------

_ALIASES = "aliases ARRAY<STRUCT<event: STRING, fuzzers: ARRAY<STRING>>>"
_EVIDENCE = "evidence ARRAY<STRUCT<url: STRING, description: STRING>>"
CATALOG_SCHEMA = f"""schema_version INT, targets ARRAY<STRUCT<target_id: STRING, target_commit: STRING, notes: STRING,
  canaries: ARRAY<STRUCT<id: STRING, title: STRING, {_EVIDENCE.replace(' ARRAY', ': ARRAY')}, {_ALIASES.replace(' ARRAY', ': ARRAY', 1)}>>,
  known_bugs: ARRAY<STRUCT<id: STRING, title: STRING, kind: STRING, {_EVIDENCE.replace(' ARRAY', ': ARRAY')}, {_ALIASES.replace(' ARRAY', ': ARRAY', 1)}>>>>"""
TARGETS_SCHEMA = """schema_version INT, targets ARRAY<STRUCT<id: STRING, label: STRING, repo: STRING, commit: STRING,
  properties_path: STRING, rationale: STRING, related_work_refs: ARRAY<STRUCT<url: STRING, description: STRING>>,
  overlap_group: STRING, overlap_notes: STRING>>"""


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(TARGETS_SCHEMA).option("multiLine", "true").json(path)
    return doc.select(F.inline("targets"))


def read_catalog(spark: SparkSession, path: str) -> Mapping[str, DataFrame]:
    """Flat tables: targets, entries, evidence, aliases (with the order they were written in)."""
    return flatten_catalog(spark.read.schema(CATALOG_SCHEMA).option("multiLine", "true").json(path))


def flatten_catalog(doc: DataFrame) -> Mapping[str, DataFrame]:
    """Flat tables of catalog documents with ``CATALOG_SCHEMA``."""
    targets = doc.select(F.inline("targets"))

    def entries_of(field: str, name: str) -> DataFrame:
        e = targets.select("target_id", F.posexplode(field).alias("pos", "e"))
        kind = F.col("e.kind") if name == "known_bug" else F.lit(None).cast("string")
        return e.select(
            "target_id", F.lit(name).alias("class"), "pos", F.col("e.id").alias("id"), F.col("e.title").alias("title"),
            kind.alias("kind"), F.col("e.evidence").alias("evidence"), F.col("e.aliases").alias("aliases"),
        )

    entries = entries_of("canaries", "canary").unionByName(entries_of("known_bugs", "known_bug"))
    alias = entries.select("target_id", "class", "id", "title", "kind", "pos", F.posexplode("aliases").alias("apos", "a"))
    return {
        "targets": targets.select("target_id", "target_commit", "notes"),
        "entries": entries.select("target_id", "class", "id", "title", "kind"),
        "evidence": entries.select("target_id", "class", "id", F.inline("evidence")),
        "aliases": alias.select(
            "target_id", "class", "id", "title", "kind", F.struct("pos", "apos").alias("ordinal"),
            F.col("a.event").alias("event"), F.explode("a.fuzzers").alias("tool"),
        ),
    }


RUN_MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("benchmark_uuid", T.StringType()),
        T.StructField("run_started_at_epoch", T.LongType()),
        T.StructField("timeout_hours", T.DoubleType()),
        T.StructField("instances_per_fuzzer", T.IntegerType()),
        T.StructField("fuzzer_keys", T.ArrayType(T.StringType())),
        T.StructField("target_repo_url", T.StringType()),
        T.StructField("target_commit", T.StringType()),
        T.StructField(
            "preliminary",
            T.StructType([T.StructField("enabled", T.BooleanType()), T.StructField("interval_seconds", T.LongType())]),
        ),
    ]
)
# Where a run manifest may lie, best place first, relative to the logs root.
MANIFEST_PLACES = ("manifest.json", "benchmark_manifest.json", "../logs/zips/manifest.json")


def read_run_manifests(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Typed core columns plus the original JSON; a file that is no JSON object is skipped."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(
        F.col("_metadata.file_path").alias("path"), F.from_json("value", RUN_MANIFEST_SCHEMA).alias("m"),
        F.try_parse_json("value").alias("v"), F.col("value").alias("raw"),
    )
    return parsed.where(F.col("v").isNotNull() & F.ltrim("raw").startswith("{")).select("path", "m.*", "raw")


def find_run_manifest(spark: SparkSession, logs_root: str, explicit: str | None = None) -> str | None:
    """First existing manifest place; an explicit one must exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs

    def exists(p: str) -> bool:
        path = hadoop.Path(p)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    if explicit is not None:
        if not exists(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    return next((p for p in (f"{logs_root}/{q}" for q in MANIFEST_PLACES) if exists(p)), None)


def run_keys(paths: DataFrame, key: str = "path") -> DataFrame:
    """(run_id, benchmark_uuid) of the manifest keys in a listing; other keys are ignored."""
    c = F.col(key)
    return paths.where(c.rlike(fixed.RUN_KEY)).select(
        F.regexp_extract(c, fixed.RUN_KEY, 1).alias("run_id"), F.regexp_extract(c, fixed.RUN_KEY, 2).alias("benchmark_uuid"), c.alias(key)
    )


def superseded_keys(paths: DataFrame, key: str = "path") -> DataFrame:
    c = F.col(key)
    return paths.where(c.rlike(fixed.SUPERSEDED_KEY)).select(
        F.regexp_extract(c, fixed.SUPERSEDED_KEY, 1).alias("run_id"), F.regexp_extract(c, fixed.SUPERSEDED_KEY, 2).alias("benchmark_uuid")
    )


def checkpoint_keys(paths: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Snapshot and published checkpoints named by a listing."""
    c = F.col(key)

    def of(pattern: str) -> DataFrame:
        return paths.where(c.rlike(pattern)).select(
            F.regexp_extract(c, pattern, 1).alias("run_id"), F.regexp_extract(c, pattern, 2).alias("benchmark_uuid"),
            F.regexp_extract(c, pattern, 3).cast("bigint").alias("checkpoint"),
        ).distinct()

    return of(fixed.SNAPSHOT_KEY), of(fixed.PUBLISHED_KEY)
