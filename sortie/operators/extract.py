"""Events from log lines, without a loop over lines.

Lines are (run_id, instance_id, tool, tool_label, log_path, block, pos, line).
Lines that carry neither a clock nor a hit are dropped before anything moves;
what a sequential reader would keep in variables is carried by `scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import (
    bang_event,
    blank_to_null,
    duration_seconds,
    failure_name,
    let,
    prefix_epoch,
    strip,
    strip_colour,
    to_number,
)
from ..session import stage
from .ordered import keep_signals, scan

FILE = ("run_id", "instance_id", "tool", "tool_label", "log_path")
ORDER = ("block", "pos")
EVENT_COLUMNS = ("run_id", "instance_id", "tool", "tool_label", "event", "elapsed_seconds", "source", "log_path")


def elapsed_text(line: Column) -> Column:
    """Seconds of an `elapsed:` clock in the line."""
    return F.when(
        line.contains("elapsed:"), duration_seconds(F.regexp_extract(line, fixed.ELAPSED_TEXT, 1))
    )


def _group(line: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(line, pattern, 1))


def _hit(name: Column, source: str) -> Column:
    return let(
        name, lambda n: F.when(n.isNotNull(), F.struct(n.alias("name"), F.lit(source).alias("source")))
    )


def _is_panic(line: Column) -> Column:
    return line.contains("panic: assertion failed")


def _first_per_name(rows: DataFrame) -> DataFrame:
    """Earliest line per (file, event): (event, elapsed_seconds, source)."""
    return (
        rows.groupBy(*FILE, "event")
        .agg(F.min_by(F.struct("elapsed_seconds", "source"), F.struct(*ORDER)).alias("_f"))
        .select(*FILE, "event", "_f.*")
        .select(*EVENT_COLUMNS)
    )


def timestamp_events(
    lines: DataFrame, bang: bool = True, falsified: bool = True, failed: bool = False
) -> DataFrame:
    """Text logs with bracketed timestamps; per line the first rule that matches wins."""
    line = strip_colour("line")
    rules = []
    if bang:
        rules.append(_hit(bang_event("_line"), "bang"))
    if failed:
        rules.append(_hit(_group(F.col("_line"), fixed.FAILED_CALL), "failed"))
    if falsified:
        rules.append(_hit(_group(F.col("_line"), fixed.FALSIFIED), "falsified"))
    panic = _is_panic(F.col("_line")) | F.col("_line").contains("FAILURE")
    rules.append(_hit(F.when(panic, F.lit("assertion_failed")), "panic"))
    rows = lines.withColumn("_line", line).select(
        *FILE, *ORDER, prefix_epoch("_line").alias("ts"), F.coalesce(*rules).alias("hit")
    )
    sparse = stage(keep_signals(rows, [*FILE, *ORDER], ["ts", "hit"]), "text-signals")
    timed = scan(sparse, FILE, ORDER, {"t0": ("first", F.col("ts")), "t1": ("last", F.col("ts"))}, "block")
    return _first_per_name(
        timed.where(F.col("hit").isNotNull() & F.col("t1").isNotNull()).select(
            *FILE, *ORDER, F.col("hit.name").alias("event"), (F.col("t1") - F.col("t0")).alias("elapsed_seconds"), "hit.source"
        )
    )


def elapsed_events(lines: DataFrame) -> DataFrame:
    """Text logs with an `elapsed:` clock; later lines reuse the last failed test's name."""
    c = F.col("_line")
    failed = F.when(c.contains("[FAILED]") & c.rlike(fixed.FAILED_TEST), strip(F.regexp_extract(c, fixed.FAILED_TEST, 1)))
    clock = F.when(c.rlike(fixed.ELAPSED_TEXT), F.struct(elapsed_text(c).alias("s")))
    panic = F.when(_is_panic(c), F.lit(True))
    rows = lines.withColumn("_line", strip_colour("line")).select(
        *FILE, *ORDER, clock.alias("clock"), failed.alias("failed"), bang_event(c).alias("bang"), panic.alias("panic")
    )
    sparse = keep_signals(rows, [*FILE, *ORDER], ["clock", "failed", "bang", "panic"])
    known = scan(
        stage(sparse, "elapsed-signals"), FILE, ORDER, {"now": ("last", F.col("clock")), "known": ("last", F.col("failed"))}, "block"
    )
    last_name = blank_to_null("known")
    hit = F.coalesce(
        _hit(F.col("failed"), "medusa-failed"),
        F.when(F.col("bang").isNotNull(), _hit(F.coalesce(last_name, F.col("bang")), "medusa-bang")),
        F.when(F.col("panic"), _hit(last_name, "medusa-panic")),
    )
    return _first_per_name(
        known.withColumn("hit", hit).where(F.col("hit").isNotNull() & F.col("now.s").isNotNull()).select(
            *FILE, *ORDER, F.col("hit.name").alias("event"), F.col("now.s").cast("double").alias("elapsed_seconds"), "hit.source"
        )
    )


# --- JSON-line logs ------------------------------------------------------------------


def with_payload(lines: DataFrame) -> DataFrame:
    """Adds `_line` (colours stripped) and `_json` (VARIANT, NULL unless a valid JSON object line)."""
    return lines.withColumn("_line", strip_colour("line")).withColumn(
        "_json", F.when(F.col("_line").rlike(fixed.JSON_LINE), F.try_parse_json("_line"))
    )


def field(path: str) -> Column:
    return F.try_variant_get("_json", path, "string")


def _payload_failure() -> Column:
    """Failure named by a payload."""
    invariant, target = failure_name(field("$.invariant")), failure_name(field("$.target"))
    selector = F.lower(strip(field("$.selector")))
    resolved = None
    for known, name in fixed.HANDLER_SELECTORS.items():
        resolved = F.when(selector == known, F.lit(name)) if resolved is None else resolved.when(selector == known, F.lit(name))
    is_failure = F.coalesce(strip(field("$.event")) == "failure", F.lit(False))
    is_handler = F.coalesce(strip(field("$.failure_type")) == "handler_assertion", F.lit(False))
    is_legacy = F.coalesce(strip(field("$.type")) == "invariant_failure", F.lit(False))
    return F.when(is_failure & is_handler, _hit(resolved, "foundry-handler-selector")).otherwise(
        F.coalesce(
            F.when(is_failure, _hit(F.coalesce(invariant, target), "foundry-failure-event")),
            F.when(is_legacy, _hit(invariant, "foundry-invariant-failure")),
        )
    )


def _expected_failures() -> Column:
    """Failures a pulse says exist; NULL unless it reports both counters."""

    def counter(*names: str) -> Column:
        return F.floor(F.coalesce(*[to_number(field(f"$.metrics.{n}")) for n in names]))

    return counter("unique_failures", "broken_invariants") + counter("broken_assertions", "broken_handlers")


def _text_failure(line: Column) -> Column:
    result = F.when(line.rlike(fixed.FAIL_RESULT), _group(line, fixed.RESULT_NAME))
    return failure_name(
        F.coalesce(_group(line, fixed.FAIL_LINE), _group(line, fixed.INVARIANT_SUMMARY), result)
    )


def signal_rows(lines: DataFrame) -> DataFrame:
    """Sparse rows: clocks, named failures (with their kind) and pulse totals."""
    text = F.when(F.col("_json").isNull(), F.col("_line"))
    handler = _group(text, fixed.HANDLER_SUMMARY)
    stamped = F.col("ts").isNotNull()
    rows = (
        with_payload(lines)
        .withColumn("ts", to_number(field("$.timestamp")))
        .select(
            *FILE, *ORDER, "ts",
            elapsed_text(F.col("_line")).alias("text_clock"),
            F.when(stamped, _payload_failure()).alias("_payload"),
            _hit(handler, "foundry-handler-summary").alias("_handler"),
            F.when(handler.isNull(), _hit(_text_failure(text), "foundry-text-failure")).alias("_text"),
            F.when(stamped, _expected_failures()).alias("expected"),
        )
        .select(
            *FILE, *ORDER, "ts", "text_clock", "expected",
            F.coalesce("_payload", "_handler", "_text").alias("hit"),
        )
    )
    return keep_signals(rows, [*FILE, *ORDER], ["ts", "text_clock", "expected", "hit"])


def json_signals(lines: DataFrame) -> DataFrame:
    """The same, staged for the scans that read it more than once."""
    return stage(signal_rows(lines), "json-signals")


def reconcile(signals: DataFrame) -> DataFrame:
    """Named failures, anonymous ones implied by pulse counters, and late names given to them.

    ``signals`` is (file columns, block, pos, elapsed_seconds, name, source,
    expected): one row per hit or pulse. With N the running number of distinct
    names, a pulse brings the anonymous total to the running maximum S of
    (expected - N). The i-th summary name of a file takes anonymous number
    M_i = i + min(0, running min(A_j - j)), A_j being S before name j, when
    M_i exceeds M_(i-1); otherwise it is an event of its own.
    """
    cols = [*FILE, *ORDER]
    named = (
        signals.where(F.col("name").isNotNull())
        .groupBy(*FILE, "name")
        .agg(F.min_by(F.struct(*ORDER, "elapsed_seconds", "source"), F.struct(*ORDER)).alias("_f"))
        .select(*FILE, "name", "_f.*")
    )
    pulses = signals.where(F.col("expected").isNotNull())
    none = F.lit(None).cast("string")
    sparse = stage(named.select(
        *cols, F.lit(0).alias("step"), "elapsed_seconds", "name", "source", F.lit(None).cast("bigint").alias("expected")
    ).unionByName(
        pulses.select(*cols, F.lit(1).alias("step"), "elapsed_seconds", none.alias("name"), none.alias("source"), "expected")
    ), "names-and-pulses")
    order = [*ORDER, "step"]
    is_name = F.col("name").isNotNull()
    is_late = F.col("source") == "foundry-handler-summary"
    counted = scan(sparse, FILE, order, {"n_names": ("sum", is_name.cast("bigint"))}, "block")
    implied = stage(scan(
        stage(counted, "names-counted"),
        FILE,
        order,
        {
            "s_before": ("prior_max", F.col("expected") - F.col("n_names")),
            "s_now": ("max", F.col("expected") - F.col("n_names")),
            "late_no": ("sum", F.when(is_late, F.lit(1).cast("bigint"))),
        },
        "block",
    ), "failures-implied")
    floor0 = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    anonymous = (
        implied.where(F.col("expected").isNotNull() & (floor0("s_now") > floor0("s_before")))
        .select(
            *FILE, F.col("elapsed_seconds").alias("at"),
            F.explode(F.sequence(floor0("s_before") + 1, floor0("s_now"))).alias("number"),
        )
    )
    # distinct summary names of one file: as many as the contract under test has functions
    along = Window.partitionBy(*FILE).orderBy(*order)
    late = (
        implied.where(is_late)
        .withColumn("_m", F.col("late_no") + F.least(F.lit(0), F.min(floor0("s_before") - F.col("late_no")).over(along)))
        .withColumn("_before", F.coalesce(F.lag("_m").over(along), F.lit(0)))
        .select(*FILE, "name", "elapsed_seconds", F.when(F.col("_m") > F.col("_before"), F.col("_m")).alias("number"))
    )
    matched = anonymous.join(late.where(F.col("number").isNotNull()), [*FILE, "number"], "full").select(
        *FILE,
        F.coalesce("name", F.concat(F.lit("foundry_handler_bug_"), F.col("number").cast("string"))).alias("event"),
        F.coalesce("at", "elapsed_seconds").alias("elapsed_seconds"),
        F.when(F.col("name").isNotNull(), "foundry-handler-summary").otherwise("foundry-broken-handler-metric").alias("source"),
    )
    own = late.where(F.col("number").isNull()).select(
        *FILE, F.col("name").alias("event"), "elapsed_seconds", F.lit("foundry-handler-summary").alias("source")
    )
    others = implied.where(is_name & ~is_late).select(*FILE, F.col("name").alias("event"), "elapsed_seconds", "source")
    return others.unionByName(matched).unionByName(own).select(*EVENT_COLUMNS)


def json_events(lines: DataFrame) -> DataFrame:
    """JSON-line logs mixed with text summaries: named, anonymous and late-named failures."""
    timed = scan(
        json_signals(lines),
        FILE,
        ORDER,
        {"t0": ("first", F.col("ts")), "t1": ("last", F.col("ts")), "text_now": ("last", F.col("text_clock"))},
        "block",
    )
    # a zero first timestamp counts as missing, as in the source of these rules
    own_clock = F.col("ts") - F.coalesce(F.nullif(F.col("t0"), F.lit(0.0)), F.col("ts"))
    carried = F.coalesce(F.col("t1") - F.col("t0"), F.col("text_now").cast("double"), F.lit(0.0))
    hits = timed.where(F.col("hit").isNotNull() | F.col("expected").isNotNull()).select(
        *FILE, *ORDER,
        F.coalesce(own_clock, carried).alias("elapsed_seconds"),
        F.col("hit.name").alias("name"), F.col("hit.source").alias("source"), "expected",
    )
    return reconcile(stage(hits, "hits-and-pulses"))


def extract_events(lines: DataFrame) -> DataFrame:
    """Dispatch by normalised tool; unknown tools use the generic text rules."""
    tool = F.col("tool")
    known = list(fixed.TOOLS)
    parts = [
        json_events(lines.where(tool == "foundry")),
        elapsed_events(lines.where(tool == "medusa")),
        timestamp_events(lines.where(tool == "echidna"), bang=False),
        timestamp_events(lines.where(tool == "recon-fuzzer"), bang=False, failed=True),
        timestamp_events(lines.where(~tool.isin(known))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
