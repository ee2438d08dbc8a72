"""Failures of JSON-line logs in flight: names, anonymous ones implied by counters, and late names.

The batch operator runs windows over a whole log. Here each file has a small state: its
clock, the names seen, how many anonymous failures its pulses implied, and the times of
those still without a name. A late name is sent as a correction of the row it names, so
that the updates of any cut into micro-batches settle to the batch result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.extract import EVENT_COLUMNS, FILE, ORDER, signal_rows

_SIGNAL = ("ts", "text_clock", "expected", "name", "source")
LATE, IMPLIED = "foundry-handler-summary", "foundry-broken-handler-metric"
_UPDATE = T.StructType(
    [T.StructField(c, T.StringType()) for c in (*FILE, "key")]
    + [T.StructField("version", T.IntegerType()), T.StructField("event", T.StringType())]
    + [T.StructField("elapsed_seconds", T.DoubleType()), T.StructField("source", T.StringType())]
)


class Reader:
    """The state of one file, and what its next signals add."""

    def __init__(self, saved: str | None = None):
        empty = {"first": None, "now": None, "text": None, "names": [], "implied": 0, "waiting": []}
        self.s = json.loads(saved) if saved else empty
        self.names = set(self.s["names"])

    def saved(self) -> str:
        return json.dumps(self.s | {"names": sorted(self.names)})

    def elapsed(self, ts: float | None) -> float:
        s = self.s
        if ts is not None:  # a zero first timestamp counts as missing
            return ts - (s["first"] or ts)
        if s["now"] is not None:
            return s["now"] - s["first"]
        return float(s["text"] or 0.0)

    def take(self, ts, text_clock, expected, name, source) -> Iterator[tuple[str, int, str, float, str]]:
        """(key, version, event, elapsed, source) updates of one line; missing values are None."""
        s = self.s
        if ts is not None:
            s["first"], s["now"] = ts if s["first"] is None else s["first"], ts
        if text_clock is not None:
            s["text"] = text_clock
        at = self.elapsed(ts)
        if name is not None and name not in self.names:
            self.names.add(name)
            if source == LATE and s["waiting"]:
                number, since = s["waiting"].pop(0)
                yield f"#{number}", 1, name, since, source
            else:
                yield f"={name}", 0, name, at, source
        if expected is not None:
            while s["implied"] < expected - len(self.names):
                s["implied"] += 1
                s["waiting"].append([s["implied"], at])
                yield f"#{s['implied']}", 0, f"foundry_handler_bug_{s['implied']}", at, IMPLIED


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A micro-batch of one file's signals, in order; only clocks, hits and pulses come here.

    Signals and updates come and go as one column of JSON: a call costs by its columns.
    """
    reader = Reader(state.get[0] if state.exists else None)
    rows = sorted((line for batch in batches for line in map(json.loads, batch["signal"])), key=itemgetter(*ORDER))
    out = []
    for line in rows:
        out += [dict(zip(_UPDATE.names[len(FILE) :], update, strict=True)) for update in reader.take(*map(line.get, _SIGNAL))]
    state.update((reader.saved(),))
    if out:
        yield pd.DataFrame({"file": [key[0]], "updates": [json.dumps(out)]})


def live_failures(lines: DataFrame) -> DataFrame:
    """A stream of updates (file columns, key, version, event, elapsed_seconds, source) from a stream of lines.

    Lines of a file must come in order from batch to batch; (block, pos) orders them inside one.
    """
    signals = signal_rows(lines).select(
        *FILE, *ORDER, "ts", "text_clock", F.col("expected").cast("double").alias("expected"),
        F.col("hit.name").alias("name"), F.col("hit.source").alias("source"),
    ).select(F.to_json(F.struct(*FILE)).alias("file"), F.to_json(F.struct(*ORDER, *_SIGNAL)).alias("signal"))
    state = T.StructType([T.StructField("saved", T.StringType())])
    packed = signals.groupBy("file").applyInPandasWithState(_advance, "file string, updates string", state, "append", GroupStateTimeout.NoTimeout)
    fields = T.StructType(_UPDATE.fields[: len(FILE)]), T.ArrayType(T.StructType(_UPDATE.fields[len(FILE) :]))
    rows = packed.select(F.from_json("file", fields[0]).alias("_f"), F.explode(F.from_json("updates", fields[1])).alias("_u"))
    return rows.select("_f.*", "_u.*")


def settled(updates: DataFrame) -> DataFrame:
    """The events that updates have come to: of each key the last version."""
    last = F.max_by(F.struct("event", "elapsed_seconds", "source"), "version")
    return updates.groupBy(*FILE, "key").agg(last.alias("_e")).select(*FILE, "_e.*").select(*EVENT_COLUMNS)
