"""Byte-level BPE: encoding by padded numpy matrices, and decoding.

A text is split by the tokenizer's pattern. Each distinct piece of a batch becomes
a row of byte ids in a matrix of rows of about its length; in every round each row
merges its leftmost pair of least rank, found in a hashed pair table, and is
compacted. A piece that is a vocabulary entry as a whole is that entry.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import common

NONE = np.int32(2**31 - 1)
#: Rows longer than this have no matrix (its work is the square of the length); a heap does the same merges.
LONGEST_ROW = 256
#: Words whose ids a worker remembers; all are forgotten beyond it.
REMEMBERED = 120_000
#: Ids that are spelled out at once when decoding.
DECODED = 1 << 18
#: The published pattern of the byte-level vocabularies (a fixed value).
CUTS_AT_BLANKS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks of a tiktoken file, with the pair table: (left id, right id) -> id of the two joined."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys, found = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(2 * len(pairs)).bit_length())
        self.keys, self.found = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        del pairs
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # each free slot takes one of the keys that want it; the others try the next
            self.probes += 1
            free = self.keys[slot[left]] == 2**64 - 1
            self.keys[slot[left[free]]] = keys[left[free]]
            won = self.keys[slot[left]] == keys[left]
            self.found[slot[left[won]]] = found[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    @functools.cached_property
    def byte_pairs(self) -> np.ndarray:
        """The id of each two bytes joined, by left * 256 + right; NONE where there is none."""
        return self.merged(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))

    @functools.cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each id, and the bytes of all ids end to end."""
        return np.fromiter(map(len, self.tokens), np.int64, len(self.tokens)), np.frombuffer(b"".join(self.tokens), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs; NONE where there is none, or an id is negative (padding)."""
        keys = left.astype(np.uint64) << np.uint64(32) | (right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        slot, out = self._slot(keys), np.full(keys.shape, NONE, np.int32)
        hit = self.keys[slot] == keys
        out[hit] = self.found[slot[hit]]
        open_ = ~hit & (self.keys[slot] != 2**64 - 1)
        at = np.flatnonzero(open_.ravel())
        flat, slots, res = keys.ravel(), slot.ravel(), out.ravel()
        for _ in range(self.probes):
            if not len(at):
                break
            slots[at] = (slots[at] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[at]]
            hit = seen == flat[at]
            res[at[hit]] = self.found[slots[at[hit]]]
            at = at[~hit & (seen != 2**64 - 1)]
        out = res.reshape(keys.shape)
        out[(left < 0) | (right < 0)] = NONE
        return out

    def long_row(self, ids: list[int]) -> list[int]:
        """The same merges for one long row: a heap of (rank, place) over a linked list."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = lambda i: self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[after[i]]]) if after[i] < n else None
        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def rows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merged rows of pieces of about one length: which piece, how many ids, and the ids end to end."""
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        raw = data[np.where(inside, starts[:, None] + np.arange(width), 0)].astype(np.int32)
        ids = np.where(inside, self.bytes[raw], np.int32(-1))
        rank = np.where(inside[:, 1:], self.byte_pairs[raw[:, :-1] << 8 | raw[:, 1:]], NONE)
        which, counts, flat, row = [], [], [], np.arange(len(sizes))
        while len(row):
            each = np.arange(len(row))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[each, at] if rank.shape[1] else np.full(len(row), NONE)
            if (done := best == NONE).any():
                ended = ids[done]
                which.append(row[done])
                counts.append((ended >= 0).sum(1))
                flat.append(ended[ended >= 0])
                row, ids, rank, at, best = row[~done], ids[~done], rank[~done], at[~done], best[~done]
                if not len(row):
                    break
                each = np.arange(len(row))
            ids[each, at] = best
            width = ids.shape[1] - 1
            stays = np.ones(ids.shape, bool)
            stays[each, at + 1] = False
            ids, rank = ids[stays].reshape(-1, width), rank[stays[:, 1:]].reshape(-1, width - 1)
            r, p = np.concatenate((each, each)), np.concatenate((at - 1, at))  # the pairs beside the merged one
            ok = (p >= 0) & (p < width - 1)
            r, p = r[ok], p[ok]
            rank[r, p] = self.merged(ids[r, p], ids[r, p + 1])
        return np.concatenate(which), np.concatenate(counts), np.concatenate(flat)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids of all pieces end to end."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), np.uint8)
        which, counts, flat = [np.flatnonzero(whole >= 0)], [np.ones(int((whole >= 0).sum()), np.int64)], [whole[whole >= 0]]
        for i in np.flatnonzero((whole < 0) & (sizes > LONGEST_ROW)).tolist():
            ids = self.long_row(self.bytes[np.frombuffer(pieces[i], np.uint8)].tolist())
            which, counts, flat = [*which, np.array([i])], [*counts, np.array([len(ids)])], [*flat, np.array(ids, np.int32)]
        rows = np.flatnonzero((whole < 0) & (sizes <= LONGEST_ROW) & (sizes > 0))
        bucket = np.where(sizes[rows] <= 16, sizes[rows], np.ceil(np.log2(np.maximum(sizes[rows], 1))).astype(np.int64) + 16)
        order = np.argsort(bucket, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            group = rows[group]
            most = max(1, (1 << 18) // int(sizes[group].max()))
            for k in range(0, len(group), most):
                part = group[k : k + most]
                w, c, f = self.rows(data, starts[part], sizes[part])
                which, counts, flat = [*which, part[w]], [*counts, c], [*flat, f]
        which, counts, flat = np.concatenate(which), np.concatenate(counts), np.concatenate(flat)
        order = np.argsort(which, kind="stable")
        total = np.zeros(len(pieces), np.int64)
        total[which] = counts
        return total, flat[spans((np.cumsum(counts) - counts)[order], counts[order])]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def white() -> np.ndarray:
    """For each code point, whether the pattern's \\s matches it."""
    out = np.zeros(sys.maxunicode + 1, bool)
    out[[ord(c) for c in regex.findall(r"\s", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000)))))]] = True
    return out


class Memory:
    """Ids of the words that a worker has met: word -> place; the ids of all words end to end."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def take(self, words: list[str], vocab: Vocabulary, pattern: str) -> np.ndarray:
        """The place of each word; new words are split by the pattern, and all their pieces are merged together."""
        if len(self.places) > REMEMBERED:
            self.__init__()
        new = [w for w in words if w not in self.places]
        if new:
            parts = list(map(regex.compile(pattern).findall, new))
            counts, flat = vocab.encode_pieces([p.encode() for p in chain.from_iterable(parts)])
            ends = np.concatenate(([0], np.cumsum(counts)))[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]
            sizes = np.diff(ends, prepend=0)
            self.places.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.flat) + ends - sizes))
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))


@functools.lru_cache(maxsize=4)
def memory(path: str, pattern: str) -> Memory:
    return Memory()


def encode_texts(texts: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each text has, and the ids of all texts end to end; no special tokens.

    No match of the published pattern goes over a blank that has no white space beside
    it, so texts are cut there; each distinct word (with its blank) of a batch is split
    and merged once. Under another pattern a text is one word.
    """
    points, bounds = common.codepoints(texts)
    joined, size = points.tobytes().decode("utf-32-le"), len(points)
    begins = np.zeros(size + 1, bool)
    if pattern == CUTS_AT_BLANKS and size > 2:
        space = white()[points]
        begins[1 : size - 1] = (points[1:-1] == 32) & ~space[:-2] & ~space[2:]
    begins[bounds] = True
    starts = np.flatnonzero(begins[:size])
    lengths = np.diff(starts, append=size)
    word, first = common.distinct(points, starts, lengths)
    words = [joined[i : i + n] for i, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
    known = memory(path, pattern)
    place = known.take(words, vocabulary(path), pattern)[word]
    sizes = known.sizes[place]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    per_text = np.diff(ends[np.searchsorted(starts, bounds)])
    return per_text, known.flat[spans(known.starts[place], sizes)]


def encode_array(texts: pa.Array, path: str, pattern: str) -> pa.Array:
    got = [encode_texts(part, path, pattern) for part in common.chunks(texts)]
    ends = np.concatenate([[0], np.cumsum(np.concatenate([x[0] for x in got]))]) if got else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([x[1] for x in got]) if got else np.zeros(0, np.int32)))


def decode_array(lists: pa.Array, path: str) -> pa.Array:
    lengths, text = vocabulary(path).spelled
    at = np.cumsum(lengths) - lengths
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and (flat.min() < 0 or flat.max() >= len(lengths)):
        raise ValueError("an id is not in the vocabulary")
    parts = [text[spans(at[flat[k : k + DECODED]], lengths[flat[k : k + DECODED]])] for k in range(0, len(flat), DECODED)]
    sizes = np.concatenate(([0], np.cumsum(lengths[flat]) if len(flat) else np.zeros(0, np.int64)))[ends]
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    out = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
    return pc.if_else(lists.is_null(), pa.scalar(None, pa.binary()), out) if lists.null_count else out


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Token ids of a text, array<int>; a null or empty text has none.

    path: a rank file that every executor can open, such as an installed vocabulary.
    """
    return F.arrow_udf(lambda texts: encode_array(texts, path, pattern), "array<int>")(text)


def decoded(ids: Column, path: str) -> Column:
    """The bytes that token ids stand for; null for null. An id outside the vocabulary fails."""
    return F.arrow_udf(lambda lists: decode_array(lists, path), "binary")(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """struct(ids, decoded): both of the above by one Python worker a task, so ids aren't sent back for decoding."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        ids = encode_array(texts, path, pattern)
        return pa.StructArray.from_arrays([ids, decode_array(ids, path)], ["ids", "decoded"])

    return both(text)
