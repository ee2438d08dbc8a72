"""Scalar rules as native column expressions (Column in, Column out)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

Col = Column | str


def _c(col: Col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used.

    Written out twice inside a condition, a pattern would be matched twice.
    """
    return F.transform(F.array(value), use)[0]


def strip(col: Col) -> Column:
    """Trim every kind of whitespace, not only spaces."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def blank_to_null(col: Col) -> Column:
    return let(_c(col), lambda c: F.when(c != "", c))


def to_number(col: Col) -> Column:
    """Text to a finite DOUBLE; anything else is NULL (never NaN or infinity)."""
    shape = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    text = strip(_c(col).cast("string"))
    return finite(let(text, lambda t: F.when(t.rlike(shape), t.try_cast("double"))))


def finite(col: Col) -> Column:
    return let(
        _c(col).cast("double"), lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    )


# --- time ---------------------------------------------------------------------


def duration_seconds(text: Col) -> Column:
    """`1h2m3s` style text to seconds: every number-unit pair counts."""
    def total(c: Column) -> Column:
        amounts = F.regexp_extract_all(c, F.lit(fixed.DURATION_PART), 1)
        units = F.regexp_extract_all(c, F.lit(fixed.DURATION_PART), 2)
        parts = F.zip_with(
            amounts,
            units,
            lambda n, u: n.try_cast("bigint")
            * F.when(u == "h", F.lit(3600)).when(u == "m", F.lit(60)).otherwise(F.lit(1)),
        )
        summed = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        return F.when(c.rlike(fixed.DURATION_PART), summed)

    return let(_c(text), total)


def prefix_epoch(line: Col) -> Column:
    """Epoch seconds of a leading `[YYYY-MM-DD HH:MM:SS.ff]`; NULL when absent or invalid."""
    shape = r"^\d{4}-\d{2}-\d{2} \d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?$"

    def epoch(stamp: Column) -> Column:
        full = F.when(stamp.rlike(r" \d{2}$"), F.concat(stamp, F.lit(":00"))).otherwise(stamp)
        return F.when(stamp.rlike(shape), F.unix_micros(full.try_cast("timestamp")) / F.lit(1e6))

    c = _c(line)
    return F.when(c.startswith("["), let(F.regexp_extract(c, fixed.TIMESTAMP_PREFIX, 1), epoch))


# --- labels and paths ---------------------------------------------------------------


def instance_id(label: Col, ignore_case: bool = False) -> Column:
    pattern = ("(?i)" if ignore_case else "") + fixed.INSTANCE_LABEL
    return F.coalesce(
        blank_to_null(F.regexp_extract(_c(label), pattern, 1)), F.lit("unknown")
    )


def tool_label(label: Col, ignore_case: bool = False) -> Column:
    pattern = ("(?i)" if ignore_case else "") + fixed.INSTANCE_LABEL
    return F.when(_c(label).rlike(pattern), F.regexp_extract(_c(label), pattern, 2)).otherwise(
        _c(label)
    )


def run_id_from_path(path: Col) -> Column:
    parts = F.filter(F.split(_c(path), "/"), lambda p: p.rlike(fixed.RUN_ID_PART))
    return F.get(parts, F.lit(0))


def normalize_tool(label: Col, rules: Sequence[tuple[str, str, str]] = fixed.TOOL_RULES) -> Column:
    """Ordered rules from a raw label to a tool; no match leaves the label unchanged."""
    lower = F.lower(_c(label))
    out = None
    for kind, text, tool in rules:
        hit = lower.startswith(text) if kind == "startswith" else lower.contains(text)
        out = F.when(hit, F.lit(tool)) if out is None else out.when(hit, F.lit(tool))
    return _c(label) if out is None else out.otherwise(_c(label))


def coverage_approach(name: Col) -> Column:
    """`a__suite__test` to (approach, suite_test)."""
    parts = F.filter(F.split(_c(name), "__"), lambda p: p != "")
    return F.when(
        F.size(parts) >= 2,
        F.struct(
            F.get(parts, F.lit(0)).alias("approach"),
            F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "__").alias("suite_test"),
        ),
    ).otherwise(F.struct(_c(name).alias("approach"), F.lit(None).cast("string").alias("suite_test")))


def safe_component(value: Col) -> Column:
    cleaned = F.regexp_replace(strip(value), r"[^A-Za-z0-9_.=-]+", "_")
    return F.when(cleaned.isin("", ".", ".."), F.lit("unknown")).otherwise(cleaned)


def coverage_instance(label: Col) -> Column:
    """Instance label with `__target-` / `__seed-` tags to its four parts."""
    c = _c(label)
    tag_at = F.regexp_instr(c, F.lit(r"__(?:target|seed)-"))
    base = F.when(tag_at > 0, F.substring(c, F.lit(1), tag_at - 1)).otherwise(c)
    tags = F.when(tag_at > 0, F.split(F.substring(c, tag_at + 2, F.length(c)), "__")).otherwise(
        F.array().cast("array<string>")
    )

    def tag(prefix: str) -> Column:
        hits = F.filter(tags, lambda p: p.startswith(prefix))
        last = F.try_element_at(hits, F.lit(-1))
        return safe_component(F.substring(last, F.lit(len(prefix) + 1), F.length(last)))

    def has(prefix: str) -> Column:
        return F.exists(tags, lambda p: p.startswith(prefix))

    return F.struct(
        instance_id(base).alias("instance_id"),
        tool_label(base).alias("tool_label"),
        F.when(has("target-"), tag("target-")).alias("target_label"),
        F.when(has("seed-"), tag("seed-")).alias("seed_label"),
    )


def short_label(label: Col) -> Column:
    """`<engine>-<arm>__target-<t>` to `<arm> · <t>`."""
    c = _c(label)
    arm = F.substring_index(c, "__target-", 1)
    target = F.regexp_replace(c, r"^.*?__target-", "")
    prefixes = "|".join(fixed.ENGINE_PREFIXES)
    return F.when(
        c.contains("__target-"),
        F.concat(F.regexp_replace(arm, f"^(?:{prefixes})", ""), F.lit(" · "), target),
    ).otherwise(c)


def repo_url(url: Col) -> Column:
    bare = F.regexp_replace(strip(F.coalesce(_c(url), F.lit(""))), r"/+$", "")
    return F.lower(F.regexp_replace(bare, r"\.git$", ""))


# --- metrics -------------------------------------------------------------------------


def pick_entry(metrics: Col, keys: Sequence[str]) -> Column:
    """The preferred entry of an ordered `array<struct<key,value>>`.

    Keys are tried in order by equality or `_key` suffix; only when none of
    them hits, in order by substring. One pass over the array: each entry gets
    the rank of the first rule it meets, and the least (rank, position) wins.
    """
    n = len(keys)

    def rank(key: Column) -> Column:
        out = None
        for i, want in enumerate(keys):
            hit = (key == want) | key.endswith("_" + want)
            out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
        for i, want in enumerate(keys):
            out = out.when(key.contains(want), F.lit(n + i))
        return out

    ranked = F.transform(
        _c(metrics),
        lambda m, i: F.struct(
            rank(m["key"]).alias("rank"), i.alias("pos"), m["value"].alias("value")
        ),
    )
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))


def pick_metric(metrics: Col, keys: Sequence[str]) -> Column:
    return pick_entry(metrics, keys)["value"]


def first_number(line: Col, patterns: Sequence[str], group: int = 1) -> Column:
    """Value of the first pattern that matches and holds a finite number."""
    found = [F.regexp_extract(_c(line), p, group).try_cast("double") for p in patterns]
    return F.coalesce(*[let(v, lambda x: F.when(x < F.lit(float("inf")), x)) for v in found])


def nonnegative(value: Col) -> Column:
    return let(_c(value), lambda v: F.when(v >= 0, v))


def coverage_counter(value: Col) -> Column:
    return finite(nonnegative(value))


def unit_rate(value: Col) -> Column:
    return let(_c(value), lambda v: F.when((v >= 0.0) & (v <= 1.0), v))


def failure_ratio(line: Col, tool: Col) -> Column:
    """`failures: X/Y` as a rate; the tool whose counters are unbounded gets NULL."""
    pair = F.struct(
        first_number(line, (fixed.FAILURES_TEXT,), 1).alias("x"),
        first_number(line, (fixed.FAILURES_TEXT,), 2).alias("y"),
    )
    ratio = let(pair, lambda p: F.when(p["y"] > 0, unit_rate(p["x"] / p["y"])))
    return F.when(_c(tool) != "medusa", ratio)


def coverage_from_payload(metrics: Col, tool: Col) -> Column:
    """struct(value, signal): only counters that belong to this tool."""

    def labelled(keys: Sequence[str]) -> Callable[[Column], Column]:
        signal = F.array(*[F.lit(k) for k in keys])
        return lambda e: F.when(
            coverage_counter(e["value"]).isNotNull(),
            F.struct(
                e["value"].alias("value"),
                F.get(signal, F.pmod(e["rank"], F.lit(len(keys)))).alias("signal"),
            ),
        )

    out = None
    for name, keys in fixed.COVERAGE_KEYS.items():
        found = let(pick_entry(metrics, keys), labelled(keys))
        hit = _c(tool) == name
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out


def coverage_from_text(line: Col, tool: Col) -> Column:
    def labelled(signal: str) -> Callable[[Column], Column]:
        return lambda v: F.when(v >= 0, F.struct(v.alias("value"), F.lit(signal).alias("signal")))

    out = None
    for name, (signal, pattern) in fixed.COVERAGE_TEXT.items():
        found = let(first_number(line, (pattern,)), labelled(signal))
        hit = _c(tool) == name
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out


def coverage_signal(tool: Col) -> Column:
    """struct(signal, unit, is_series) by tool prefix."""
    lower = F.lower(strip(tool))

    def row(signal: str, unit: str, series: bool) -> Column:
        return F.struct(
            F.lit(signal).alias("signal"), F.lit(unit).alias("unit"), F.lit(series).alias("is_series")
        )

    out = None
    for prefix, signal, unit, series in fixed.COVERAGE_SIGNALS:
        hit = lower.startswith(prefix)
        value = row(signal, unit, series)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(row(*fixed.UNKNOWN_SIGNAL))


# --- event names -----------------------------------------------------------------------


def strip_colour(line: Col) -> Column:
    return F.regexp_replace(_c(line), fixed.TERMINAL_COLOUR, "")


def bang_event(line: Col) -> Column:
    """Text after the first `!!!`, cut at a guillemet, a quote, then a bracket."""
    c = _c(line)
    text = strip(F.substring(c, F.instr(c, "!!!") + 3, F.length(c)))
    for stop in ("»", '"', ")"):
        text = strip(F.substring_index(text, stop, 1))
    return F.when(c.contains("!!!"), blank_to_null(text))


def failure_name(value: Col) -> Column:
    """`Contract:function` keeps the function; other names stay as they are."""
    def pick(name: Column) -> Column:
        return F.when(name.rlike(r"^[^:]+:[^:]+$"), strip(F.substring_index(name, ":", -1))).otherwise(name)

    return blank_to_null(let(strip(value), pick))


def canonical_event(value: Col) -> Column:
    """Name of a finding that is comparable across tools."""
    name = strip(F.coalesce(_c(value), F.lit("")))
    name = F.regexp_replace(name, fixed.QUALIFIED_EVENT, "$1")
    name = F.regexp_replace(name, fixed.TRAILING_PARAMS, "")
    name = F.regexp_replace(name, "^" + fixed.ASSERTION_WRAPPER, "")
    return strip(F.regexp_replace(name, fixed.ASSERTION_SUFFIX, ""))


# --- call signatures --------------------------------------------------------------------


def canonical_signature(value: Col) -> Column:
    def rebuild(text: Column) -> Column:
        args = F.regexp_extract(text, fixed.SIGNATURE, 2)
        args = F.regexp_replace(args, r"\baddress\s+payable\b", "address")
        args = F.regexp_replace(args, r"\s+", "")
        for short, full in (("uint", "uint256"), ("int", "int256"), ("byte", "bytes1")):
            args = F.regexp_replace(args, rf"\b{short}(?=(?:\[|,|\)|$))", full)
        name = F.regexp_extract(text, fixed.SIGNATURE, 1)
        return F.when(text.rlike(fixed.SIGNATURE), F.concat(name, F.lit("("), args, F.lit(")")))

    return let(strip(value), rebuild)


def signature_name(signature: Col) -> Column:
    return blank_to_null(F.regexp_extract(_c(signature), fixed.SIGNATURE, 1))


def selector_from_calldata(value: Col) -> Column:
    return let(
        strip(value),
        lambda t: F.when(t.rlike(fixed.CALLDATA) & (F.length(t) >= 10), F.lower(F.substring(t, 1, 10))),
    )


def canonical_selector(value: Col) -> Column:
    return let(F.lower(strip(value)), lambda t: F.when(t.rlike(fixed.SELECTOR), t))


# --- rules on tables ---------------------------------------------------------------------


def not_excluded(tools: Sequence[str], *cols: Col) -> Column:
    """Keep a row unless one of its labels, lower-cased, is on the list."""
    names = [t.lower() for t in tools]
    if not names:
        return F.lit(True)
    return ~reduce(lambda a, b: a | b, [F.lower(_c(c)).isin(names) for c in cols])


def within_budget(elapsed: Col, budget_hours: float | None) -> Column:
    if budget_hours is None:
        return F.lit(True)
    if budget_hours < 0:
        raise ValueError("budget_hours must not be negative")
    return _c(elapsed) <= F.lit(float(budget_hours) * 3600.0)


def is_trial(budget_hours: Col | float, fewest_runs: Col) -> Column:
    hours = F.lit(budget_hours) if isinstance(budget_hours, (int, float)) else _c(budget_hours)
    return (hours < fixed.TRIAL_MIN_HOURS) | F.coalesce(
        _c(fewest_runs) < fixed.TRIAL_MIN_RUNS, F.lit(False)
    )


def effect_class(a12: Col) -> Column:
    a = _c(a12)
    far = F.greatest(a, F.lit(1.0) - a)
    out = F.when(~a.between(0.0, 1.0), F.raise_error(F.lit("A12 must be between 0 and 1")).cast("string"))
    for limit, name in fixed.A12_CLASSES:
        out = out.when(far < limit, F.lit(name))
    return F.when(a.isNotNull(), out.otherwise(F.lit("large")))


def is_target_family(campaign: Col) -> Column:
    c = _c(campaign)
    return c.startswith("by_target/") & ~c.contains("/by_test/")


def is_per_test(campaign: Col) -> Column:
    c = _c(campaign)
    return c.startswith("by_test/") | c.contains("/by_test/")


def is_baseline_name(approach: Col) -> Column:
    lower = F.lower(_c(approach))
    out = lower.isin(*fixed.BASELINE_NAMES)
    for suffix in fixed.BASELINE_SUFFIXES:
        out = out | lower.endswith(suffix)
    return out


def fingerprint(*cols: str) -> Column:
    """md5 of the definition as JSON with sorted keys; equal definitions share it."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"}))
