"""Periodic runs of words: descending-LCP Kruskal over the suffix classes of each text.

A run is a stretch of words with smallest period q and a length of at least 2q that
no neighbouring word extends. The suffixes of a text are sorted by prefix doubling;
neighbours in that order are edges weighted by their longest common prefix (LCP).
Taking edges by falling weight, union-find joins classes of suffixes, each with the
ordered set of its positions; the smaller set is put into the larger. When a union at
weight l makes positions s < t adjacent and t - s <= l, the words from s to t + l repeat
with period t - s, and smallest so: a smaller period would have put a position between
them earlier. Such a seed is a whole run if the word before s breaks the period.

A run of length at least max(shortest, 2q) has LCP length - q >= shortest / 2 at its
start, so lighter edges are never needed, and a text without a repeated word sequence
of that length has no run. Both cut work only, never a run.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import common

#: What `found` returns.
FOUND = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts end to end, a number for each distinct word, and each text's first word (one more: all)."""
    lists = pc.ascii_split_whitespace(texts)
    values, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.not_equal(values, "")
    ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    values = values.filter(full)
    return values, values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), ends[bounds]


def repeating(symbols: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """For each text, whether a sequence of `width` symbols may stand in it twice (by 64-bit hashes; symbols are the texts' own)."""
    size = len(symbols) - width + 1
    out = np.zeros(len(bounds) - 1, bool)
    if size <= 0:
        return out
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    each = common.mixed(symbols + 1)
    h = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + size]
    at = np.flatnonzero(text[:size] == text[width - 1 :])
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    out[text[order[1:][same]]] = True
    return out


def suffixes(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order by prefix doubling, and the ranks by the first 1, 2, 4, ... symbols.

    Symbols of different texts differ, and `ends` has each position's end of text.
    A rank is the place of the first suffix of its group, so groups that are single stay as they are.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    start = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = start[np.cumsum(first) - 1]
    sizes = np.diff(np.append(start, n))
    active = order[np.repeat(sizes > 1, sizes)]
    levels, width = [rank.astype(np.int32)], 1
    while len(active):
        after = active + width
        key = rank[active] * (n + 1) + np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        begins = np.concatenate(([True], old[1:] != old[:-1]))
        places = np.arange(len(active))
        rank[active] = old + np.maximum.accumulate(np.where(first, places, 0)) - np.maximum.accumulate(np.where(begins, places, 0))
        sizes = np.diff(np.append(np.flatnonzero(first), len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        levels.append(rank.astype(np.int32))
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many symbols the suffixes at a and b share, by their ranks at falling widths."""
    n, shared = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + shared, b + shared
        inside = np.maximum(i, j) < n
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        shared += (inside & (levels[k][i] == levels[k][j])).astype(np.int64) << k
    return shared


def seeds(order: np.ndarray, shared: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(position, period, LCP) of all pairs that become adjacent in a class at a distance within the LCP."""
    edges = np.flatnonzero(shared >= least)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    ranks = np.unique(np.concatenate((edges, edges + 1)))
    number = np.searchsorted(ranks, edges).tolist()
    parent = list(range(len(ranks)))
    sets = [[p] for p in order[ranks].tolist()]
    out = []
    for left, lcp in zip(number, shared[edges].tolist(), strict=True):
        right = left + 1  # ranks are consecutive along an edge
        while parent[left] != left:
            parent[left] = left = parent[parent[left]]
        while parent[right] != right:
            parent[right] = right = parent[parent[right]]
        big, small = sets[left], sets[right]
        if len(big) < len(small):
            left, right, big, small = right, left, small, big
        parent[right], sets[right] = left, None
        last = len(small) - 1
        for k, x in enumerate(small):
            at = bisect_left(big, x)
            if at:  # of the larger set, unless the element before x comes from the smaller one
                before = big[at - 1]
                if x - before <= lcp and (k == 0 or small[k - 1] < before):
                    out.append((before, x - before, lcp))
            if at < len(big):
                after = big[at]
                if after - x <= lcp and (k == last or after < small[k + 1]):
                    out.append((x, after - x, lcp))
            big.insert(at, x)
    return out


def runs_of(codes: np.ndarray, bounds: np.ndarray, shortest: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of at least `shortest` symbols, sorted."""
    none = np.zeros((0, 4), np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(codes):
        return none
    symbols = text * (int(codes.max()) + 1) + codes
    least = max(1, -(-shortest // 2))
    kept = np.flatnonzero(repeating(symbols, bounds, least)[text])
    if not len(kept):
        return none
    own, word = text[kept], symbols[kept]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    sizes = np.diff(np.append(starts, len(kept)))
    order, levels = suffixes(word, np.repeat(starts + sizes, sizes))
    shared = common_prefixes(order[:-1], order[1:], levels)
    found = np.array(seeds(order, shared, least), np.int64).reshape(-1, 3)
    s, period, lcp = found.T
    begins = np.zeros(len(kept), bool)
    begins[starts] = True
    whole = (lcp + period >= shortest) & (begins[s] | (word[s - 1] != word[s + period - 1]))
    s, period, lcp = s[whole], period[whole], lcp[whole]
    rows = np.stack((own[s], kept[s] - bounds[own[s]], lcp + period, period), axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapse(words: pa.Array, bounds: np.ndarray, runs: np.ndarray) -> pa.Array:
    """The texts with one blank between words, less what runs hold after their first period."""
    steps = np.zeros(len(words) + 1, np.int64)
    at = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(steps, at + runs[:, 3], 1)
    np.add.at(steps, at + runs[:, 2], -1)
    kept = np.cumsum(steps)[:-1] == 0
    ends = np.concatenate(([0], np.cumsum(kept)))[bounds]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept))), pa.scalar(" ", words.type))


def found(text: Column, shortest: int = 12) -> Column:
    """Number of words, all runs of at least `shortest` words, and the text with each run cut to its first period.

    Words are separated by the six ASCII blanks; runs come by start, then period, and may
    overlap; a word goes if any run holds it after that run's first period. A null or
    empty text has no words, no runs and an empty collapsed text. Texts are whole,
    however long: a task holds about half a megabyte of texts, or one longer text, at a time.
    Equal texts give equal results; nothing depends on other rows or columns.
    """

    @F.arrow_udf(FOUND)
    def tagged(texts: pa.Array) -> pa.Array:
        counts, flat, sizes, joined = [], [], [], []
        for part in common.chunks(texts):
            words, codes, bounds = word_codes(part)
            runs = runs_of(codes, bounds, shortest)
            counts.append(np.diff(bounds))
            flat.append(runs[:, 1:])
            sizes.append(np.bincount(runs[:, 0], minlength=len(part)))
            joined.append(collapse(words, bounds, runs).cast(pa.string()))
        counts, sizes = np.concatenate([*counts, []]).astype(np.int64), np.concatenate([*sizes, []]).astype(np.int64)
        columns = np.concatenate([*flat, np.zeros((0, 3), np.int64)]).T
        items = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), items)
        whole = pa.concat_arrays([*joined, pa.array([], pa.string())])
        return pa.StructArray.from_arrays([pa.array(counts), lists, whole], ["n_words", "runs", "collapsed"])

    return tagged(text)
