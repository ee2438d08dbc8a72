"""Helpers of the training-data operators: whole texts in bounded pieces, as arrays."""

from __future__ import annotations

import ctypes
import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are held as arrays at once in a task; a longer text is held alone.
CHUNK_BYTES = 1 << 19


def bounded(spark: SparkSession) -> SparkSession:
    """Sets how much of a table a Python worker gets at once: few rows, and fewer where texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(function):
    """A Python function that Spark calls once a row: else a filter on its result goes below it and calls it again, by one more Python worker a task."""
    return function.asNondeterministic()


def id_remainder(column: Column, parts: int) -> Column:
    """crc32 of an id's text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % parts


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive runs of whole texts of about `limit` bytes; null texts become empty."""
    tidy()  # of what the batch before has left
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    starts = np.flatnonzero(np.diff(ends // limit, prepend=-1))
    for at, stop in zip(starts, [*starts[1:], len(texts)], strict=True):
        yield texts.slice(int(at), int(stop - at))
    tidy()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each text begins (one more: the end)."""
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))).astype(np.int64)
    data = texts.cast(pa.large_binary()).buffers()[2]
    if data is None or ends[-1] == 0:
        return np.zeros(0, np.uint8), ends
    first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
    return np.frombuffer(data, np.uint8)[first : first + ends[-1]], ends


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and where each text begins (one more: the end)."""
    data, _ = raw_bytes(texts)
    bounds = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), bounds


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether Unicode calls it a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def bitmap(rows: DataFrame, hashes: Column, bits: int = 23) -> np.ndarray:
    """A map of 2**bits bits, in words of 64: those at the low bits of the 64-bit hashes of all rows are set. It has one size, however many rows."""
    low = hashes.bitwiseAND(F.lit((1 << bits) - 1))
    words = rows.select(F.shiftright(low, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found, out = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow(), np.zeros(1 << bits >> 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a `bitmap` holds each of the hashes: true of all that were put in, and of some others."""
    low = hashes.astype(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def held(hashes: Column, words: np.ndarray) -> Column:
    """`in_bitmap` of a column."""

    @F.arrow_udf("boolean")
    def looked_up(values: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(words, values.to_numpy(zero_copy_only=False)))

    return looked_up(hashes)


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse, modulo 2**64; the longest tables so far are kept."""
    if not _tables or len(_tables[0][0]) < n:
        base, size = 0x9E3779B97F4A7C15, 1 << max(16, n.bit_length())
        with np.errstate(over="ignore"):
            _tables[:] = [tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64)))) for x in (base, pow(base, -1, 1 << 64)))]
    return _tables[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half of the result."""
    v = values.astype(np.uint64)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


@functools.cache
def _symbols() -> np.ndarray:
    return mixed(np.arange(1, sys.maxunicode + 2, dtype=np.uint64))


@functools.cache
def word_signs() -> np.ndarray:
    """For each code point, whether it is a letter, a mark or a number."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@functools.cache
def unspaced() -> np.ndarray:
    """For each code point, whether its script is written without blanks: Thai to Lao, Myanmar, Khmer, kana, Han."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for low, high in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        out[low : high + 1] = True
    return out


def words(points: np.ndarray, bounds: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words (runs of letters, marks and numbers), and each text's first word (one more: all).

    single: for each code point, whether each such sign is a word of its own.
    """
    inside = np.zeros(len(points) + 1, bool)
    inside[:-1] = word_signs()[points]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    if single is not None:
        alone = single[points]
        if alone.any():
            begins |= inside[:-1] & alone
            begins[1:] |= inside[1:-1] & alone[:-1]
    cut = bounds[1:-1][(bounds[1:-1] < len(points)) & (bounds[1:-1] > 0)]
    begins[cut] |= inside[cut]
    starts = np.flatnonzero(begins)
    ends = inside[:-1] & ~inside[1:]
    ends[:-1] |= inside[:-2] & begins[1:]
    return starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, bounds)


def span_hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, from one running sum; equal spans agree wherever they stand."""
    return symbol_hashes(_symbols()[points], starts, lengths)


def symbol_hashes(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same for spans of 64-bit symbols."""
    up, down = _powers(len(symbols) + 1)
    sums_ = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * up[: len(symbols)])))
    return mixed((sums_[starts + lengths] - sums_[starts]) * down[starts] + lengths.astype(np.uint64))


def distinct(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span the number of its content, and for each content a span that has it."""
    _, first, number = np.unique(span_hashes(points, starts, lengths), return_index=True, return_inverse=True)
    return number, first


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` (along its first axis) between the bounds; an empty span sums to 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=np.float64)
    return out


def sample_by_hash(rows: DataFrame, key: Column, group: str, most: int) -> DataFrame:
    """About `most` rows of each group, chosen by a hash of the key; small groups stay whole.

    The share of a group follows from its exact count, so the sample is bounded
    by most x groups in expectation, and repeats from run to run. Groups are the classes
    of a model, which the driver holds in any case; rows aren't shuffled.
    """
    counts = rows.groupBy(group).count().where(F.col(group).isNotNull()).collect()
    if not counts:
        return rows.limit(0)
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r[group], most / r["count"])])
    scale = 1 << 30
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(scale)) < F.element_at(shares, F.col(group)) * scale)


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def tidy() -> None:
    """Gives freed memory back to the system: Python workers live long, and an executor's share is small."""
    _trim()(0)
    pa.default_memory_pool().release_unused()
