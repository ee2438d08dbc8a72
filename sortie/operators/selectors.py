"""Which functions the saved inputs call: extraction, dedupe, distribution, expectations.

Calls are counted per (instance, identity) as soon as they are known, so a
function that makes up most of a corpus is one row from then on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.payloads import canonical_json, signature_selector, typed_signature
from ..functions.scalars import (
    canonical_selector,
    canonical_signature,
    selector_from_calldata,
    signature_name,
)
from ..session import stage
from .quality import Rule, dq_report, duplicates

INSTANCE = ("run_id", "instance_label", "engine", "tool", "tool_label")
IDENTITY = ("selector", "signature", "name", "source_format")


def sequences(artifacts: DataFrame) -> DataFrame:
    """Artifacts with their sequence digest; NULL digest marks a malformed file."""
    return artifacts.withColumn("digest", F.sha2(canonical_json("content"), 256))


def dedupe(files: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """First file (by path) per instance and digest, with the number of copies."""
    return (
        files.where(F.col("digest").isNotNull()).groupBy(*keys, "digest")
        .agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))
    )


def _at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("_item", path, kind)


def _text_at(path: str) -> Column:
    """The value only if it is a JSON string."""
    is_text = F.schema_of_variant(_at(path, "variant")) == "STRING"
    return F.when(is_text, _at(path))


def extract_calls(files: DataFrame) -> DataFrame:
    """One row per array item of every well-formed file; identity columns NULL when ignored."""
    return calls_of(files.where(F.col("digest").isNotNull()).select(
        *INSTANCE, "path", "digest", F.posexplode(F.from_json("content", "array<variant>")).alias("pos", "_item")
    ))


def element_sequences(elements: DataFrame, files: DataFrame) -> DataFrame:
    """Files with their sequence digest, from their elements; NULL digest marks a malformed file.

    Each element's digest covers its place; a file's is the exclusive or of them, so
    no task holds a whole file. An empty array has a digest of its own.
    """
    each = F.sha2(F.concat_ws(":", F.col("part").cast("string"), canonical_json(F.concat(F.lit("["), "text", F.lit("]")))), 256)
    quarters = [F.bit_xor(F.conv(F.substring("_sha", 16 * i + 1, 16), 16, -10).cast("bigint")).alias(f"_q{i}") for i in range(4)]
    sums = elements.select(*INSTANCE, "path", each.alias("_sha")).groupBy(*INSTANCE, "path").agg(*quarters)
    digest = F.lower(F.concat(*[F.lpad(F.hex(F.coalesce(f"_q{i}", F.lit(0).cast("bigint"))), 16, "0") for i in range(4)]))
    return files.join(sums, [*INSTANCE, "path"], "left").select(*files.columns, F.when(F.col("well_formed"), digest).alias("digest"))


def extract_element_calls(elements: DataFrame, files: DataFrame) -> DataFrame:
    """`extract_calls` from element rows; ``files`` has the digests."""
    named = files.where(F.col("digest").isNotNull()).select(*INSTANCE, "path", "digest")
    items = elements.select(*INSTANCE, "path", F.col("part").alias("pos"), F.try_parse_json("text").alias("_item"))
    return calls_of(items.join(named, [*INSTANCE, "path"]))


def calls_of(items: DataFrame) -> DataFrame:
    """One row per item (`_item`, a VARIANT); identity columns NULL when ignored."""
    engine, tag = F.col("engine"), _at("$.call.tag")
    pair = _at("$.call.contents[1]", "variant").isNotNull() & _at("$.call.contents[2]", "variant").isNull()
    tagged = (engine == "echidna") & (tag == "SolCall") & pair
    mapped = (engine == "recon-fuzzer") & _at("$.call.SolCall.name", "variant").isNotNull()
    typed = F.when(
        tagged,
        F.struct(F.lit("tagged").alias("dialect"), _text_at("$.call.contents[0]").alias("name"), F.to_json(_at("$.call.contents[1]", "variant")).alias("args")),
    ).when(
        mapped,
        F.struct(F.lit("mapped").alias("dialect"), _text_at("$.call.SolCall.name").alias("name"), F.to_json(_at("$.call.SolCall.args", "variant")).alias("args")),
    )
    raw = (
        F.when((engine == "echidna") & (tag == "SolCalldata"), _at("$.call.contents"))
        .when((engine == "recon-fuzzer") & ~mapped, _at("$.call.SolCalldata"))
        .when(engine == "medusa", _at("$.call.data"))
        .when(engine == "foundry", _at("$.calldata"))
    )
    label = F.when(engine == "medusa", canonical_signature(_at("$.call.dataAbiValues.methodSignature")))
    # Names of the corpus formats.
    source = (
        F.when(engine == "echidna", F.when(tagged, "echidna-typed-corpus").otherwise("echidna-raw-calldata"))
        .when(engine == "recon-fuzzer", F.when(mapped, "recon-typed-corpus").otherwise("recon-raw-calldata"))
        .when(engine == "medusa", "medusa-call-sequence")
        .when(engine == "foundry", "foundry-persisted-corpus")
    )
    seen = items.select(
        *INSTANCE, "path", "digest", "pos",
        typed.alias("_t"), selector_from_calldata(raw).alias("selector"), label.alias("_label"), source.alias("source_format"),
    )
    signature = F.coalesce(
        canonical_signature(typed_signature(F.col("_t.name"), F.col("_t.args"), F.col("_t.dialect"))),
        F.when(F.col("selector").isNotNull(), F.col("_label")),
    )
    return seen.withColumn("signature", signature).select(
        *INSTANCE, "path", "digest", "pos", "selector", "signature",
        F.coalesce(F.col("_t.name"), signature_name("signature")).alias("name"), "source_format",
    )


def looked_up(rows: DataFrame, key: str, found: DataFrame, other: str) -> DataFrame:
    """Left join of text `key` with `other`; rows without a key are dealt by their content, or all would meet in one task."""
    spare = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*rows.columns), F.lit(4096)).cast("string"))
    dealt = rows.withColumn("_dealt", F.coalesce(F.col(key), spare))
    return dealt.join(found, (F.col("_dealt") == F.col(other)) & F.col(key).isNotNull(), "left").drop("_dealt")


def resolve(calls: DataFrame) -> DataFrame:
    """Selectors of signatures, and the guard: a raw selector drops a label that contradicts it."""
    known = calls.select("signature").where(F.col("signature").isNotNull()).distinct()
    hashed = known.select(F.col("signature").alias("_known"), signature_selector("signature").alias("_sel"))
    both = looked_up(calls, "signature", hashed, "_known")
    clash = F.coalesce(F.col("selector") != F.col("_sel"), F.lit(False))
    return both.select(
        *[c for c in calls.columns if c not in ("selector", "signature", "name")],
        F.coalesce("selector", "_sel").alias("selector"),
        F.when(~clash, F.col("signature")).alias("signature"),
        F.when(~clash, F.col("name")).alias("name"),
        clash.alias("mismatch"),
        (F.col("selector").isNull() & F.col("_sel").isNull() & F.col("signature").isNull() & F.col("name").isNull()).alias("ignored"),
    )


def counted(calls: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """Calls per instance and identity."""
    return calls.groupBy(*keys, *IDENTITY).agg(F.count(F.lit(1)).alias("n"))


def enrich(counts: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """Fill names and selectors that have exactly one candidate across all instances."""
    full = counts.where(
        F.col("selector").isNotNull() & F.col("signature").isNotNull() & F.col("name").isNotNull()
    ).select("selector", "signature", "name").distinct()

    def only(key: str, a: str, b: str) -> DataFrame:
        one = full.groupBy(key).agg(F.min(F.struct(a, b)).alias("_lo"), F.max(F.struct(a, b)).alias("_hi"))
        return one.where(F.col("_lo") == F.col("_hi")).select(
            F.col(key).alias(f"_{key}"), F.col(f"_lo.{a}").alias(f"_{a}_of"), F.col(f"_lo.{b}").alias(f"_{b}_of")
        )

    by_selector, by_name = only("selector", "name", "signature"), only("name", "selector", "signature")
    rows = looked_up(counts, "selector", by_selector, "_selector")
    lacking = F.col("_selector").isNotNull() & (F.col("signature").isNull() | F.col("name").isNull())
    rows = rows.select(
        *keys, "selector", "source_format", "n",
        F.when(lacking, F.col("_name_of")).otherwise(F.col("name")).alias("name"),
        F.when(lacking, F.col("_signature_of")).otherwise(F.col("signature")).alias("signature"),
    )
    rows = looked_up(rows, "name", by_name, "_name")
    nameless = F.col("selector").isNull() & F.col("_name").isNotNull()
    return rows.select(
        *keys,
        F.when(nameless, F.col("_selector_of")).otherwise(F.col("selector")).alias("selector"),
        F.when(nameless, F.col("_signature_of")).otherwise(F.col("signature")).alias("signature"),
        "name", "source_format", "n",
    ).groupBy(*keys, *IDENTITY).agg(F.sum("n").alias("n"))


def call_key() -> Column:
    return F.coalesce("selector", F.concat(F.lit("name:"), F.col("name")), F.lit("unknown"))


def distribution(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of each call identity per group, with the names it was seen under."""

    def listed(col: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(col)), ";")

    rows = counts.withColumn("key", call_key()).groupBy(*by, "key").agg(
        F.max("selector").alias("selector"), F.sum("n").alias("calls"),
        listed("signature").alias("signatures"), listed("name").alias("names"), listed("source_format").alias("sources"),
    )
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return rows.join(totals, list(by)).select(
        *by, "key", "selector", "calls", F.round(F.col("calls") / F.col("_total"), 12).alias("share"), "signatures", "names", "sources"
    )


def instance_summary(
    files: DataFrame, calls: DataFrame, inventory: DataFrame | None = None
) -> DataFrame:
    """Counters and status per instance. Limits are flags: everything was processed."""
    c = F.col
    per_file = files.groupBy(*INSTANCE).agg(
        F.count(F.lit(1)).alias("artifact_files"),
        F.sum("bytes").alias("bytes"),
        F.count_if(c("digest").isNull()).alias("malformed"),
        F.count_if(c("bytes") > fixed.MAX_ARTIFACT_BYTES).alias("_big"),
    )
    per_digest = dedupe(files).groupBy(*INSTANCE).agg(
        F.count(F.lit(1)).alias("sequences"), F.sum(c("copies") - 1).alias("duplicates")
    )
    per_call = calls.groupBy(*INSTANCE).agg(
        F.count_if(~c("ignored")).alias("calls"), F.count_if("ignored").alias("ignored"), F.count_if("mismatch").alias("mismatches")
    )
    base = per_file.select(*INSTANCE) if inventory is None else per_file.select(*INSTANCE).union(inventory.select(*INSTANCE)).distinct()
    rows = base.join(per_file, list(INSTANCE), "left").join(per_digest, list(INSTANCE), "left").join(per_call, list(INSTANCE), "left")
    rows = rows.fillna(0, subset=["artifact_files", "bytes", "malformed", "_big", "sequences", "duplicates", "calls", "ignored", "mismatches"])
    limits = c("_big") + sum(
        (c(col) > cap).cast("bigint")
        for col, cap in (("bytes", fixed.MAX_INSTANCE_BYTES), ("artifact_files", fixed.MAX_ARTIFACT_FILES), ("calls", fixed.MAX_INSTANCE_CALLS))
    )
    rows = rows.withColumn("limit_violations", limits).drop("_big")
    return rows.withColumn("status", status(rows)).withColumn(
        "warnings",
        F.array_compact(
            F.array(
                F.when(c("status") == "observed_zero", "no selector calls were saved"),
                F.when(c("malformed") > 0, F.concat(c("malformed").cast("string"), F.lit(" malformed artifact(s)"))),
                F.when(c("mismatches") > 0, F.concat(c("mismatches").cast("string"), F.lit(" label(s) disagreed with raw calldata"))),
            )
        ),
    )


def status(rows: DataFrame) -> Column:
    """unavailable, observed_zero, malformed, partial or available."""
    c = F.col
    trouble = c("malformed") > 0  # sizes are reported in limit_violations and change no status
    saved = c("engine") != "foundry"
    return (
        F.when(~c("engine").isin(*fixed.TOOLS), "unavailable")
        .when(c("artifact_files") == 0, F.when(saved, "observed_zero").otherwise("unavailable"))
        .when((c("calls") > 0) | (c("sequences") > 0), F.when(trouble, "partial").when(c("calls") > 0, "available").otherwise("observed_zero"))
        .when(trouble, "malformed")
        .otherwise("unavailable")
    )


def tool_status(instances: DataFrame) -> DataFrame:
    """One status per tool: shared by all its instances, else partial (also if all are partial)."""
    s = F.col("status")
    return instances.groupBy("tool").agg(
        F.when((F.count_distinct(s) == 1) & (F.min(s) != "partial"), F.min(s)).otherwise("partial").alias("status"),
        F.count(F.lit(1)).alias("instances"),
        F.count_if(s.isin("available", "partial")).alias("available"),
        F.count_if(s == "observed_zero").alias("observed_zero"),
        F.count_if(s == "unavailable").alias("unavailable"),
        F.count_if(s == "malformed").alias("malformed"),
    )


def _family(engine: Column) -> Column:
    return F.coalesce(*[F.when(engine == k, F.lit(v)) for k, v in fixed.EVIDENCE_FAMILY.items()], engine)


def peer_expected(counts: DataFrame, instances: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Selectors every available instance of an engine saved, in at least two evidence families."""
    usable = instances.where(F.col("status").isin("available", "partial")).select(*scope, "engine", "instance_label").distinct()
    needed = usable.groupBy(*scope, "engine").agg(F.count(F.lit(1)).alias("_needed"))
    seen = (
        counts.where(F.col("selector").isNotNull()).join(usable, [*scope, "engine", "instance_label"], "left_semi")
        .groupBy(*scope, "engine", "instance_label", "selector")
        .agg(F.min("name").alias("_a"), F.max("name").alias("_b"), F.min("signature").alias("_s"), F.max("signature").alias("_z"))
        .where(F.col("_a") == F.col("_b"))
    )
    name = F.col("_a")
    plumbing = name.isin(*fixed.FRAMEWORK_FUNCTIONS)
    for prefix in fixed.TEST_PREFIXES:
        plumbing = plumbing | name.startswith(prefix)
    candidates = seen.where(~plumbing)
    per_engine = candidates.groupBy(*scope, "selector", "engine").agg(F.count(F.lit(1)).alias("_have"))
    support = (
        per_engine.join(needed, [*scope, "engine"]).where(F.col("_have") == F.col("_needed"))
        .groupBy(*scope, "selector")
        .agg(
            F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"),
            F.count_distinct(_family(F.col("engine"))).alias("families"),
        )
        .where(F.col("families") >= 2)
    )
    labels = candidates.groupBy(*scope, "selector").agg(
        F.when(F.min("_a") == F.max("_b"), F.min("_a")).alias("name"),
        F.when(F.min("_s") == F.max("_z"), F.min("_s")).alias("signature"),
    )
    return support.join(labels, [*scope, "selector"])


def missing_expected(expected: DataFrame, counts: DataFrame, instances: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Expected selectors an instance did not call; only instances that can be compared.

    The expected set has at most one selector per function of the code under
    test, so it travels as one array per scope.
    """
    listed = expected.select(*scope, "selector").distinct()
    comparable = instances.where(F.col("status").isin("available", "partial", "observed_zero")).select(*scope, "instance_label")
    seen = (
        counts.where(F.col("selector").isNotNull()).select(*scope, "instance_label", "selector").distinct()
        .join(listed, [*scope, "selector"], "left_semi")
        .groupBy(*scope, "instance_label").agg(F.collect_list("selector").alias("_seen"))
    )
    wanted = listed.groupBy(*scope).agg(F.collect_list("selector").alias("_want"))
    rows = comparable.join(wanted, list(scope)) if scope else comparable.withColumn("_want", wanted.scalar())
    rows = rows.join(seen, [*scope, "instance_label"], "left")
    gap = F.array_except("_want", F.coalesce("_seen", F.array().cast("array<string>")))
    return rows.select(*scope, "instance_label", F.explode(gap).alias("selector"))


def health(instances: DataFrame, missing: DataFrame, explicit: bool = False) -> DataFrame:
    """(instance_label, severity, kind, amount): zero, malformed, limits, missing selectors."""
    c = F.col
    found = instances.select(
        "instance_label",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(c("status") == "observed_zero", F.struct(F.lit("observed_zero").alias("kind"), F.lit(0).cast("bigint").alias("amount"))),
                    F.when(c("malformed") > 0, F.struct(F.lit("malformed_artifact").alias("kind"), c("malformed").alias("amount"))),
                    F.when(c("limit_violations") > 0, F.struct(F.lit("resource_limit").alias("kind"), c("limit_violations").alias("amount"))),
                )
            )
        ),
    ).withColumn("severity", F.lit("warning"))
    gaps = missing.groupBy("instance_label").agg(F.count(F.lit(1)).alias("amount")).select(
        "instance_label", F.lit("missing_explicit_selector" if explicit else "peer_heuristic_gap").alias("kind"), "amount",
        F.lit("warning" if explicit else "info").alias("severity"),
    )
    return found.unionByName(gaps)


def expected_catalog(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed selectors (selector, signature, function_name) and the rule violations among them."""
    c = F.col
    rows = entries.select(
        canonical_selector("selector").alias("selector"), canonical_signature("signature").alias("signature"),
        c("function_name"), c("selector").alias("_raw_selector"), c("signature").alias("_raw_signature"),
    )
    hashed = rows.select("signature").where(c("signature").isNotNull()).distinct().withColumn("_sel", signature_selector("signature"))
    rows = rows.join(hashed, "signature", "left").withColumn("_sig_name", signature_name("signature"))
    key = F.coalesce("_raw_selector", "_raw_signature", F.lit("?"))
    rules = [
        Rule("signature is not valid", c("_raw_signature").isNotNull() & c("signature").isNull()),
        Rule("selector is not valid", c("_raw_selector").isNotNull() & c("selector").isNull()),
        Rule("selector disagrees with signature", c("selector") != c("_sel"), c("_sel")),
        Rule("function name is not valid", ~c("function_name").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")),
        Rule("function name disagrees with signature", c("function_name") != c("_sig_name"), c("_sig_name")),
        Rule("entry has no selector", c("selector").isNull() & c("_sel").isNull()),
    ]
    final = rows.select(
        F.coalesce("selector", "_sel").alias("selector"), F.coalesce("function_name", "_sig_name").alias("name"), "signature"
    ).where(c("selector").isNotNull()).distinct()
    bad = dq_report(rows, rules, key).unionByName(duplicates(final, "selector has conflicting entries", ["selector"]))
    return final, bad


def analyze(artifacts: DataFrame, inventory: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole selector report from corpus files: calls are extracted and staged once."""
    files = stage(sequences(artifacts), "sequences")
    return _report(files, stage(resolve(extract_calls(files)), "calls"), inventory)


def analyze_elements(elements: DataFrame, files: DataFrame, inventory: DataFrame | None = None) -> dict[str, DataFrame]:
    """The same report from `corpora.read_elements`, for files of any size."""
    known = stage(element_sequences(elements, files), "sequences")
    return _report(known, stage(resolve(extract_element_calls(elements, known)), "calls"), inventory)


def _report(files: DataFrame, calls: DataFrame, inventory: DataFrame | None) -> dict[str, DataFrame]:
    first = dedupe(files).select(*INSTANCE, "path")
    kept = calls.join(first, [*INSTANCE, "path"], "left_semi")
    counts = enrich(counted(kept.where(~F.col("ignored"))))
    instances = instance_summary(files, kept, inventory)
    expected = peer_expected(counts, instances)
    missing = missing_expected(expected, counts, instances)
    return {
        "instances": instances,
        "tools": tool_status(instances),
        "distribution": distribution(counts, INSTANCE),
        "tool_distribution": distribution(counts, ["tool"]),
        "expected": expected,
        "missing": missing,
        "health": health(instances, missing),
    }
