"""Metric samples from log lines: throughput and progress."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.payloads import flatten_numbers
from ..functions.scalars import (
    coverage_from_payload,
    coverage_from_text,
    failure_ratio,
    first_number,
    nonnegative,
    pick_metric,
    prefix_epoch,
    to_number,
    unit_rate,
)
from .extract import FILE, ORDER, elapsed_text, field, with_payload
from ..session import stage
from .ordered import keep_signals, scan


def _clocked(lines: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Rows with a signal and the elapsed time a reader would have at that line.

    A line's own clock is its JSON timestamp, else `elapsed:` text, else its
    bracketed timestamp; without one the latest clock holds.
    """
    is_json = F.col("_json").isNotNull()
    rows = (
        with_payload(lines)
        .withColumn("_metrics", F.when(is_json, flatten_numbers(F.when(is_json, F.col("_line")))))
        .withColumn("_text", F.when(~is_json, F.col("_line")))
        .select(
            *FILE, *ORDER,
            is_json.alias("is_json"),
            prefix_epoch("_line").alias("abs_ts"),
            elapsed_text(F.col("_line")).cast("double").alias("text_s"),
            F.when(is_json, to_number(field("$.timestamp"))).alias("json_ts"),
            *[v.alias(k) for k, v in signals.items()],
        )
    )
    sparse = keep_signals(
        rows, [*FILE, *ORDER, "is_json"], ["abs_ts", "text_s", "json_ts", *signals]
    )

    def clock(kind: int, col: str) -> Column:
        return F.when(F.col(col).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(col).alias("at")))

    timed = scan(
        stage(sparse, "metric-signals"),
        FILE,
        ORDER,
        {
            "_now": ("last", F.coalesce(clock(2, "json_ts"), clock(1, "text_s"), clock(0, "abs_ts"))),
            "_abs0": ("first", F.col("abs_ts")),
            "_json0": ("first", F.col("json_ts")),
        },
        "block",
    )
    at, kind = F.col("_now.at"), F.col("_now.kind")
    elapsed = F.when(kind == 1, at).otherwise(
        F.greatest(at - F.when(kind == 2, F.col("_json0")).otherwise(F.col("_abs0")), F.lit(0.0))
    )
    carried = timed.withColumn("elapsed_seconds", F.when(kind.isNotNull(), elapsed))
    some = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in signals])
    kept = carried.where(F.col("elapsed_seconds").isNotNull() & some)
    return kept.select(*FILE, *ORDER, "is_json", "elapsed_seconds", *signals)


def _changes_only(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """Drop a sample equal to the one before it (time to 3, values to 12 decimals)."""
    key = F.struct(F.round("elapsed_seconds", 3).alias("t"), *[F.round(v, 12).alias(v) for v in values])
    marked = scan(stage(rows.withColumn("_key", key), "samples"), FILE, ORDER, {"_last": ("prev", F.col("_key"))}, "block")
    return marked.where(F.col("_last").isNull() | ~F.col("_key").eqNullSafe(F.col("_last")))


def throughput_samples(lines: DataFrame) -> DataFrame:
    """Call and gas rates: reported, from JSON totals, or from the change of text counters."""
    m, text = F.col("_metrics"), F.col("_text")
    # every pattern needs one of these words; most lines have none, and this scan is cheap
    calls = F.when(text.rlike("(?i)tx|call|transaction"), text)
    gas_text = F.when(text.rlike("(?i)gas"), text)

    def metric(keys: Sequence[str], line: Column, patterns: Sequence[str]) -> Column:
        return nonnegative(F.coalesce(pick_metric(m, keys), first_number(line, patterns)))

    rows = _clocked(
        lines,
        {
            "tx_rate": metric(fixed.TX_RATE_KEYS, calls, fixed.TX_RATE_TEXT),
            "gas_rate": metric(fixed.GAS_RATE_KEYS, gas_text, fixed.GAS_RATE_TEXT),
            "tx_count": metric(fixed.TX_COUNT_KEYS, text, fixed.TX_COUNT_TEXT),
            "gas_count": metric(fixed.GAS_COUNT_KEYS, gas_text, fixed.GAS_COUNT_TEXT),
        },
    )
    t = F.col("elapsed_seconds")
    counted = ~F.col("is_json") & t.isNotNull() & F.col("tx_rate").isNull() & F.col("tx_count").isNotNull()
    seed = F.when(counted, F.struct(F.col("tx_count").alias("n"), t.alias("t")))
    rows = scan(stage(rows, "metric-clocks"), FILE, ORDER, {"_seed": ("prev", seed)}, "block")
    from_total = F.col("is_json") & (t > 0)
    interval = F.when(
        counted & (t > F.col("_seed.t")) & (F.col("tx_count") >= F.col("_seed.n")),
        (F.col("tx_count") - F.col("_seed.n")) / (t - F.col("_seed.t")),
    )
    tx = F.coalesce(F.col("tx_rate"), F.when(from_total, F.col("tx_count") / t), interval)
    gas = F.coalesce(F.col("gas_rate"), F.when(t > 0, F.col("gas_count") / t))
    gas_derived = F.col("gas_rate").isNull() & F.col("gas_count").isNotNull() & (t > 0)
    reported = F.col("tx_rate").isNotNull() | F.col("gas_rate").isNotNull()
    source = (
        F.when(F.col("is_json"), F.when(reported, "json-rate").otherwise("json-cumulative"))
        .when(gas_derived, "text-cumulative")
        .when(interval.isNotNull(), "text-interval")
        .otherwise("text-rate")
    )
    samples = rows.select(
        *FILE, *ORDER, "elapsed_seconds", tx.alias("tx_per_second"), gas.alias("gas_per_second"), source.alias("source")
    ).where(t.isNotNull() & (F.col("tx_per_second").isNotNull() | F.col("gas_per_second").isNotNull()))
    return _changes_only(samples, ("tx_per_second", "gas_per_second")).select(
        *FILE, *ORDER, "elapsed_seconds", "tx_per_second", "gas_per_second", "source"
    )


PROGRESS = ("seq_per_second", "coverage_proxy", "corpus_size", "favored_items", "failure_rate")


def progress_samples(lines: DataFrame, coverage: bool = False) -> DataFrame:
    """Sequence rate, coverage counter (on request), corpus size, favoured items, failure rate."""
    m, text, tool = F.col("_metrics"), F.col("_text"), F.col("tool")
    direct = unit_rate(pick_metric(m, fixed.FAILURE_RATE_KEYS))
    total = pick_metric(m, fixed.FAILED_TOTAL_KEYS)
    ratio = unit_rate(F.when(total > 0, pick_metric(m, fixed.FAILED_CURRENT_KEYS) / total))
    signals = {
        "seq_per_second": F.coalesce(pick_metric(m, fixed.SEQ_RATE_KEYS), first_number(text, fixed.SEQ_RATE_TEXT)),
        "corpus_size": F.coalesce(pick_metric(m, fixed.CORPUS_KEYS), first_number(text, fixed.CORPUS_TEXT)),
        "favored_items": pick_metric(m, fixed.FAVOURED_KEYS),
        "failure_rate": F.coalesce(direct, ratio, failure_ratio(text, tool)),
    }
    if coverage:
        signals["_cov"] = F.coalesce(coverage_from_payload(m, tool), coverage_from_text(text, tool))
    rows = _clocked(lines, signals)
    cov = F.col("_cov") if coverage else None
    rows = rows.withColumn("coverage_proxy", cov["value"] if coverage else F.lit(None).cast("double"))
    kind = F.when(F.col("is_json"), "json-metrics").otherwise("text-metrics")
    tag = F.concat_ws(":", kind, cov["signal"]) if coverage else kind
    any_value = F.coalesce(*[F.col(c).cast("double") for c in PROGRESS]).isNotNull()
    samples = rows.where(any_value & F.col("elapsed_seconds").isNotNull()).select(
        *FILE, *ORDER, "elapsed_seconds", *PROGRESS, tag.alias("source")
    )
    return _changes_only(samples, PROGRESS).select(*FILE, *ORDER, "elapsed_seconds", *PROGRESS, "source")
