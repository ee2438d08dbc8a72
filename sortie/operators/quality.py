"""Data-quality rules: one pass per table, one row per violation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import repo_url


@dataclass(frozen=True)
class Rule:
    """``broken`` is true (not NULL) where the row violates the rule."""

    name: str
    broken: Column
    detail: Column | None = None


def dq_report(df: DataFrame, rules: Sequence[Rule], key: Column) -> DataFrame:
    """(rule, key, detail) for every violation; rows are read once for all rules."""
    checks = [
        F.when(
            F.coalesce(r.broken, F.lit(False)),
            F.struct(
                F.lit(r.name).alias("rule"),
                key.cast("string").alias("key"),
                (r.detail if r.detail is not None else F.lit("")).cast("string").alias("detail"),
            ),
        )
        for r in rules
    ]
    return df.select(F.inline(F.array_compact(F.array(*checks))))


def duplicates(df: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    """One violation per key that occurs more than once."""
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        .select(F.lit(rule).alias("rule"), text.alias("key"), F.col("_n").cast("string").alias("detail"))
    )


def absent(df: DataFrame, other: DataFrame, rule: str, key: str, other_key: str) -> DataFrame:
    """Foreign-key check: keys of ``df`` that ``other`` lacks."""
    ids = df.select(F.col(key).cast("string").alias("key")).distinct()
    known = other.select(F.col(other_key).cast("string").alias("key")).distinct()
    return ids.join(known, "key", "left_anti").select(F.lit(rule).alias("rule"), "key", F.lit("").alias("detail"))


def missing_text(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col)) == "", F.lit(True))


def mismatch(col: str, pattern: str) -> Column:
    return F.coalesce(~F.col(col).rlike(pattern), F.lit(True))


def not_canonical_event(col: str) -> Column:
    c = F.col(col)
    return mismatch(col, fixed.EVENT_NAME) | c.startswith(fixed.ASSERTION_WRAPPER) | c.rlike(fixed.ASSERTION_SUFFIX)


def https_url(col: str, fragment: str | None) -> Column:
    """HTTPS with a host, no credentials; a fragment only if it fits the pattern."""
    c = F.col(col)
    after = F.try_parse_url(c, F.lit("REF"))
    ok_fragment = after.isNull() | (after == "")
    if fragment:
        ok_fragment = ok_fragment | after.rlike(fragment)
    host = F.try_parse_url(c, F.lit("HOST"))
    return F.coalesce(c.startswith("https://") & host.isNotNull() & ~F.split(c, "/")[2].contains("@") & ok_fragment, F.lit(False))


LINES = r"^L[0-9]+(?:-L[0-9]+)?$"


def pinned_url(url: str, repo: Column, commit: Column) -> Column:
    """`<repo>/blob/<commit>/<path>#L…` on the target's own repository and revision."""
    c = F.col(url)
    path = F.split(F.substring_index(F.substring_index(c, "#", 1), "?", 1), "/")
    own = repo_url(F.concat_ws("/", F.slice(path, 1, 5))) == repo_url(repo)
    parts = F.slice(path, F.lit(8), F.size(path))
    return F.coalesce(
        own & (F.get(path, F.lit(5)) == "blob") & (F.get(path, F.lit(6)) == commit) & (F.size(parts) > 0)
        & ~F.exists(parts, lambda p: p == "") & ~c.contains("?") & F.substring_index(c, "#", -1).rlike(LINES) & c.contains("#"),
        F.lit(False),
    )


def catalog_report(targets: DataFrame, entries: DataFrame, evidence: DataFrame, aliases: DataFrame, manifest: DataFrame) -> DataFrame:
    """All catalog rules on the flattened catalog.

    targets (target_id, target_commit, notes), entries (target_id, class, id,
    title, kind), evidence (target_id, class, id, url, description), aliases
    (target_id, class, id, event, tool), manifest (id, repo, commit).
    """
    ref = manifest.select(F.col("id").alias("target_id"), F.col("repo").alias("_repo"), F.col("commit").alias("_commit"))
    entry_key = F.concat_ws("/", "target_id", "class", "id")
    t = targets.join(ref, "target_id", "left")
    with_repo = evidence.join(ref, "target_id", "left").join(
        targets.select("target_id", F.col("target_commit").alias("_tc")), "target_id", "left"
    )
    pinned = with_repo.groupBy("target_id", "class", "id").agg(
        F.max(pinned_url("url", F.col("_repo"), F.col("_tc")).cast("int")).alias("_pinned")
    )
    e = entries.join(pinned, ["target_id", "class", "id"], "left")
    parts = [
        dq_report(
            t,
            [
                Rule("target id is not a slug", mismatch("target_id", fixed.SLUG)),
                Rule("target commit is not a commit", mismatch("target_commit", fixed.COMMIT), F.col("target_commit")),
                Rule("target is not in the target list", F.col("_commit").isNull()),
                Rule("target commit differs from the target list", F.col("target_commit") != F.col("_commit"), F.col("_commit")),
                Rule("target notes are empty", missing_text("notes")),
            ],
            F.col("target_id"),
        ),
        dq_report(
            e,
            [
                Rule("entry id is not a slug", mismatch("id", fixed.SLUG)),
                Rule("entry title is empty", missing_text("title")),
                Rule("entry kind is unknown", (F.col("class") == "known_bug") & ~F.coalesce(F.col("kind").isin(*fixed.BUG_KINDS), F.lit(False)), F.col("kind")),
                Rule("entry has no evidence", F.col("_pinned").isNull()),
                Rule("entry has no pinned evidence", F.col("_pinned") == 0),
            ],
            entry_key,
        ),
        dq_report(
            evidence,
            [
                Rule("evidence url is not https", ~https_url("url", LINES), F.col("url")),
                Rule("evidence description is empty", missing_text("description")),
            ],
            entry_key,
        ),
        dq_report(
            aliases,
            [
                Rule("alias event is not canonical", not_canonical_event("event"), F.col("event")),
                Rule("alias tool is unknown", ~F.coalesce(F.col("tool").isin(*fixed.TOOLS), F.lit(False)), F.col("tool")),
            ],
            entry_key,
        ),
        duplicates(targets, "target id occurs twice", ["target_id"]),
        duplicates(entries, "entry id occurs twice", ["target_id", "id"]),
        duplicates(aliases, "alias occurs twice", ["target_id", "tool", "event"]),
        absent(manifest, targets, "target list entry has no catalog", "id", "target_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def target_list_report(targets: DataFrame) -> DataFrame:
    """Rules of the target list: (id, label, repo, commit, properties_path, rationale, overlap_group, overlap_notes)."""
    path = F.col("properties_path")
    bad_path = (
        mismatch("properties_path", fixed.PROPERTIES_PATH) | (F.length(path) > 200) | path.startswith("/")
        | path.contains("..") | path.rlike(r"//|(^|/)\.(/|$)|/$") | ~path.endswith(".sol")
    )
    rules = [
        Rule("id is not a slug", mismatch("id", fixed.SLUG)),
        Rule("label is empty", missing_text("label")),
        Rule("repo is not canonical", mismatch("repo", fixed.REPO_URL) | F.col("repo").endswith(".git"), F.col("repo")),
        Rule("commit is not a commit", mismatch("commit", fixed.COMMIT), F.col("commit")),
        Rule("properties path is not valid", bad_path, path),
        Rule("rationale is empty", missing_text("rationale")),
        Rule("overlap group is not a slug", mismatch("overlap_group", fixed.SLUG)),
        Rule("overlap notes are empty", missing_text("overlap_notes")),
    ]
    lowered = targets.select(F.lower("repo").alias("repo"))
    return (
        dq_report(targets, rules, F.col("id"))
        .unionByName(duplicates(targets, "id occurs twice", ["id"]))
        .unionByName(duplicates(lowered, "repo occurs twice", ["repo"]))
    )


def manifest_rules() -> list[Rule]:
    """Rules for run manifests flattened to typed columns."""
    c = F.col
    return [
        Rule("run id is not valid", mismatch("run_id", fixed.SNAPSHOT_RUN_ID)),
        Rule("uuid is not valid", mismatch("benchmark_uuid", fixed.UUID)),
        Rule("start is not positive", F.coalesce(c("started_epoch") <= 0, F.lit(True)), c("started_epoch")),
        Rule("timeout is out of range", ~F.coalesce(c("timeout_hours").between(0.25, 72), F.lit(False)), c("timeout_hours")),
        Rule("interval is out of range", c("enabled") & ~F.coalesce(c("interval_seconds").between(60, 86400), F.lit(False)), c("interval_seconds")),
        Rule("disabled interval is not zero", ~c("enabled") & F.coalesce(c("interval_seconds") != 0, F.lit(False)), c("interval_seconds")),
        Rule("tool list is empty", F.coalesce(F.size("fuzzer_keys") < 1, F.lit(True))),
        Rule("tool list is too long", F.size("fuzzer_keys") > 64),
        Rule("tool list repeats", F.size(F.array_distinct("fuzzer_keys")) < F.size("fuzzer_keys")),
        Rule("tool name is unsafe", F.exists("fuzzer_keys", lambda t: ~t.rlike(fixed.SAFE_LABEL))),
        Rule("instances are out of range", ~F.coalesce(c("instances_per_fuzzer").between(1, 20), F.lit(False)), c("instances_per_fuzzer")),
    ]


def superseded_rules() -> list[Rule]:
    """Rules for superseded markers: key_run_id/key_uuid come from the marker's path."""
    c = F.col
    return [
        Rule("run id differs from the key", ~F.coalesce(c("run_id") == c("key_run_id"), F.lit(False))),
        Rule("uuid differs from the key", ~F.coalesce(c("benchmark_uuid") == c("key_uuid"), F.lit(False))),
        Rule("reason is missing", missing_text("reason") | (F.length("reason") > 2000)),
        Rule("no replacement", c("replacement_run_id").isNull() & c("replacement_issue").isNull()),
        Rule("replaces itself", c("replacement_run_id") == c("run_id")),
        Rule("replacement run id is not valid", ~c("replacement_run_id").rlike(fixed.RUN_ID)),
        Rule("issue is out of range", ~c("replacement_issue").between(1, 10**9)),
        Rule("time is not positive", F.coalesce(c("superseded_at_epoch") <= 0, F.lit(True))),
        Rule("commit is not valid", mismatch("suite_commit", fixed.COMMIT)),
        Rule("manifest hash is not valid", mismatch("manifest_sha256", fixed.SHA256)),
    ]


def finalized_rules(tag_prefix: str) -> list[Rule]:
    """Rules for finalisation markers; a superseded run may close without a release tag."""
    c = F.col
    tag = F.concat(F.lit(tag_prefix), c("key_uuid"), F.lit("-"), c("key_run_id"))
    gone = F.coalesce(c("superseded"), F.lit(False))
    return [
        Rule("run id differs from the key", ~F.coalesce(c("run_id") == c("key_run_id"), F.lit(False))),
        Rule("uuid differs from the key", ~F.coalesce(c("benchmark_uuid") == c("key_uuid"), F.lit(False))),
        Rule("stream is not closed", ~F.coalesce(c("stream_closed"), F.lit(False))),
        Rule("superseded run claims a tag", gone & (F.coalesce(c("release_tag"), F.lit("")) != "")),
        Rule("superseded run has no reference", gone & (missing_text("superseded_reference") | (F.length("superseded_reference") > 200))),
        Rule("release tag is unexpected", ~gone & ~F.coalesce(c("release_tag") == tag, F.lit(False)), c("release_tag")),
    ]


def snapshot_set_rules() -> list[Rule]:
    """Arithmetic that every snapshot set must satisfy."""
    c = F.col
    window = c("capture_end") - c("capture_start")
    ordered = (c("scheduled_epoch") <= c("capture_start")) & (c("capture_start") <= c("capture_end")) & (c("capture_end") == c("as_of_epoch"))
    return [
        Rule("checkpoint is out of range", ~F.coalesce(c("checkpoint").between(1, 999999), F.lit(False))),
        Rule("more present than expected", c("present") > c("expected")),
        Rule("capture window is inconsistent", ~F.coalesce(ordered, F.lit(False))),
        Rule("capture window is too wide", window > fixed.CAPTURE_LATENESS_SECONDS, window),
        Rule("elapsed exceeds the plan", c("elapsed_seconds") > c("planned_seconds")),
        Rule("missing count is inconsistent", c("missing") != c("expected") - c("present")),
        Rule("flags are wrong", ~(c("incomplete") & c("non_terminal"))),
    ]
