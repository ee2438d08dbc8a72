"""Benchmark passages in documents, near copies included.

Texts become words (runs of letters, marks and numbers, lower case; in scripts without
blanks every sign is a word). A window is as
long as an item. The CGK embedding walks over a window's words and at each step, by
a hash of step and word, stays or moves on; words at a small edit distance become
walks at a small Hamming distance. A band is a few sampled steps of a walk; windows
and items that share a band are compared exactly. An item is in a document if at
most (1 - similarity) x its words are inserted, deleted or replaced.

Windows start at every word. Only those that can hold an item are walked: k edits
leave n - 1 - 2k of an item's n - 1 word pairs, so a window with fewer pairs known to
the benchmark (a bitmap of fixed size) can't hold one. A second bitmap, of the items'
bands, keeps bands that no item has from being shuffled. Neither loses a match.

Items too short to allow an edit are looked for as they are: the hash of an item's
words is its only key, and so is that of as many words from each place of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import common


#: Windows and words that a task holds before it walks them, and windows walked at once.
HELD, SLICE = 1 << 17, 1 << 15


@dataclass(frozen=True)
class Scheme:
    """similarity: 1 - allowed edits per item word. walks x bands keys of `steps` sampled steps each.

    bits: size of both bitmaps (2**bits). growth: item lengths of one class differ by this factor at most.
    shortest: items of fewer words take no part; by default all with a word do.
    """

    similarity: float = 0.8
    walks: int = 6
    bands: int = 4
    steps: int = 2
    bits: int = 24
    growth: float = 1.2
    shortest: int = 1

    def edits(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.asarray(n) * (1 - self.similarity) + 1e-9).astype(np.int64)

    def length_class(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / np.log(self.growth) + 1e-9).astype(np.int64)

    def lengths(self, c: int) -> tuple[int, int]:
        """The least and the greatest item length of a class."""
        guess = np.arange(max(1, int(self.growth**c) - 2), int(self.growth ** (c + 1)) + 3)
        own = guess[self.length_class(guess) == c]
        return int(own[0]), int(own[-1])

    def exact(self, c: int) -> bool:
        """Whether the items of a class allow no edit; such a class has items of one length."""
        low, high = self.lengths(c)
        return low == high and self.edits(high) == 0

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: int) -> np.ndarray:
        """Band keys of the windows of class c that begin at `starts`; a word at or past `ends` is a blank one."""
        low, _ = self.lengths(c)
        draw = np.random.default_rng(7919 + c)
        padded, out = np.append(words, np.uint64(0)), np.empty((self.walks * self.bands, len(starts)), np.uint64)
        for walk in range(self.walks):
            seeds = draw.integers(0, 2**63, 2 + 2 * low // 64, dtype=np.uint64)
            moves = [common.mixed(words ^ s).view(np.uint8).reshape(-1, 8) for s in seeds]
            sampled = np.sort(np.array([draw.choice(2 * low, self.steps, replace=False) for _ in range(self.bands)]), 1)
            salts = draw.integers(0, 2**63, (self.bands, self.steps), dtype=np.uint64)
            bands, at, before = np.zeros((self.bands, len(starts)), np.uint64), starts, 0
            for step in np.unique(sampled).tolist():
                # a walk past its end meets blank words only, so it may go on there by any words
                at, before = at + strides(moves, before, step)[np.minimum(at, len(words))], step
                here = padded[np.where(at < ends, at, len(words))]
                for band, place in zip(*np.nonzero(sampled == step), strict=True):
                    bands[band] = common.mixed(bands[band] ^ (here + salts[band, place]))
            number = np.arange(self.bands, dtype=np.uint64)[:, None]
            out[walk * self.bands : (walk + 1) * self.bands] = common.mixed(bands + np.uint64(walk * 131 + c * 65537) + number)
        return np.ascontiguousarray(out.T)


def strides(moves: list[np.ndarray], start: int, stop: int) -> np.ndarray:
    """How far a walk gets from each word (and from the end) in the steps from `start` to `stop`.

    moves: for every 64 steps the bits of each word, as eight bytes, lowest first. Steps are
    taken from the last to the first, so all words go at once: one that moves on gets as far as the word after it, and one more.
    """
    far = np.zeros(len(moves[0]) + 1, np.min_scalar_type(stop - start))
    for step in range(stop - 1, start - 1, -1):
        if step == stop - 1 or step % 8 == 7:
            octet = np.ascontiguousarray(moves[step // 64][:, step % 64 // 8])
        more = far[1:] - far[:-1]  # may wrap around, and back
        more += far.dtype.type(1)
        more *= (octet >> np.uint8(step % 8)) & np.uint8(1)
        far[:-1] += more
    return far


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word, the character it begins at in its text, and each text's first word (one more: all)."""
    points, bounds = common.codepoints(pc.utf8_lower(texts))
    starts, lengths, first = common.words(points, bounds, common.unspaced())
    hashes = common.span_hashes(points, starts, lengths)
    return hashes, starts - np.repeat(bounds[:-1], np.diff(first)), first


def pairs(words: np.ndarray) -> np.ndarray:
    return common.mixed(words[:-1] * np.uint64(3) + words[1:])


def whole(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The key of n words from each start, apart from all band keys."""
    return common.mixed(common.symbol_hashes(words, starts, np.full(len(starts), n)) ^ np.uint64(0x9E3779B97F4A7C15))


def _bitmap(batches, column: int, bits: int):
    """One bitmap per task: the low bits of a column of 64-bit lists."""
    seen = np.zeros(1 << bits, bool)
    for batch in batches:
        seen[batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << bits) - 1)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bitmap"])


def items(benchmark: DataFrame, scheme: Scheme, *, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, pairs, class, keys) of the items long enough to count; staged."""

    def build(batches):
        for batch in batches:
            at = 0
            for part in common.chunks(batch.column(1)):
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                hashes, _, first = word_hashes(part)
                sizes = np.diff(first)
                rows = np.flatnonzero(sizes >= max(scheme.shortest, 1))
                lists = [hashes[first[i] : first[i + 1]] for i in rows]
                classes = scheme.length_class(sizes[rows])
                start = np.zeros(1, np.int64)
                keys = [whole(x, start, len(x)) if scheme.exact(int(c)) else scheme.keys(x, start, np.array([len(x)]), int(c))[0] for x, c in zip(lists, classes, strict=True)]
                as_list = lambda x: pa.array([y.view(np.int64) for y in x], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), as_list(lists), as_list([pairs(x) for x in lists]), pa.array(classes, pa.int64()), as_list(keys)], ["item", "words", "pairs", "class", "keys"])

    kind = benchmark.schema[item].dataType.simpleString()
    return stage(benchmark.select(item, F.col(text).cast("string")).mapInArrow(build, f"item {kind}, words array<long>, pairs array<long>, class long, keys array<long>"), "items")


def windows(docs: DataFrame, known: DataFrame, scheme: Scheme, *, key: str, text: str) -> DataFrame:
    """(key, place, offset, words, keys) of the windows that share a band with some item."""
    bits, spark = scheme.bits, docs.sparkSession
    gathered = [known.select(c).mapInArrow(lambda b: _bitmap(b, 0, bits), "bitmap binary") for c in ("pairs", "keys")]
    maps = []
    for frame in gathered:  # one bitmap of fixed size per task of the benchmark's table
        total = np.zeros(1 << bits >> 3, np.uint8)
        for row in frame.toLocalIterator():
            total |= np.frombuffer(row.bitmap, np.uint8)
        maps.append(total)
    classes = sorted(r["class"] for r in known.select("class").distinct().collect())  # as many as the logarithm of the longest item
    shared = spark.sparkContext.broadcast((maps, classes))

    def in_map(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
        return (bitmap[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 > 0

    def sent(ids: pa.Array, place: np.ndarray, offset: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n_keys: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """The windows of `sizes` words at `starts`, each with `n_keys` of the keys."""
        content = words[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        ends_of = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(place), pa.array(offset), pa.ListArray.from_arrays(ends_of(sizes), pa.array(content.view(np.int64))), pa.ListArray.from_arrays(ends_of(n_keys), pa.array(keys.view(np.int64)))],
            ["key", "place", "offset", "words", "keys"],
        )

    def walked(held: dict[int, list], key_map: np.ndarray):
        """The windows held of each class that share a band with some item."""
        for c, parts in held.items():
            ids, place, offset, texts, starts, ends = (list(x) for x in zip(*parts, strict=True))
            base = np.cumsum([0, *map(len, texts)])
            words, ids, place, offset = np.concatenate(texts), pa.concat_arrays(ids), np.concatenate(place), np.concatenate(offset)
            starts, ends = (np.concatenate([x + at for x, at in zip(xs, base, strict=False)]) for xs in (starts, ends))
            for k in range(0, len(starts), SLICE):
                s, e = starts[k : k + SLICE], ends[k : k + SLICE]
                # windows of equal words are walked once
                _, one, same = np.unique(common.symbol_hashes(words, s, e - s), return_index=True, return_inverse=True)
                keys = scheme.keys(words, s[one], e[one], c)
                shared_bands = in_map(key_map, keys.ravel()).reshape(keys.shape)
                keys, common_bands = keys[same], shared_bands[same]
                some = np.flatnonzero(common_bands.any(1))
                if len(some):
                    found = some + k
                    yield sent(ids.take(pa.array(found)), place[found], offset[found], words, s[some], (e - s)[some], common_bands[some].sum(1), keys[some][common_bands[some]])

    def find(batches):
        (pair_map, key_map), classes = shared.value
        held, waiting = {}, 0  # windows of each class, until there are enough to walk together
        for batch in batches:
            at = 0
            for part in common.chunks(batch.column(1)):
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                hashes, offsets, first = word_hashes(part)
                if not len(hashes) or not classes:
                    continue
                hits = np.concatenate(([0], np.cumsum(in_map(pair_map, pairs(hashes)), dtype=np.int64)))
                for c in classes:
                    low, high = scheme.lengths(c)
                    if scheme.exact(c):
                        if len(hashes) < low:
                            continue
                        starts = np.arange(len(hashes) - low + 1)
                        starts = starts[hits[starts + low - 1] - hits[starts] == low - 1]
                        owner = np.searchsorted(first, starts, side="right") - 1
                        inside = starts + low <= first[owner + 1]
                        starts, owner = starts[inside], owner[inside]
                        keys = whole(hashes, starts, low)
                        some = in_map(key_map, keys)
                        starts, owner, keys = starts[some], owner[some], keys[some]
                        # a text's first place of a key tells all that is asked of it
                        one = np.unique(np.stack([owner.view(np.uint64), keys], 1), axis=0, return_index=True)[1] if len(keys) else np.zeros(0, np.int64)
                        if len(one):
                            yield sent(ids.take(pa.array(owner[one])), (starts - first[owner])[one], offsets[starts[one]], hashes, starts[one], np.full(len(one), low), np.ones(len(one), np.int64), keys[one])
                        continue
                    span = high + int(scheme.edits(high))
                    lengths = np.arange(low, high + 1)
                    need = max(int((lengths - 1 - 2 * scheme.edits(lengths)).min()), 0)
                    stop = np.minimum(np.arange(len(hashes)) + span - 1, len(hashes) - 1)
                    starts = np.flatnonzero(hits[stop] - hits[: len(hashes)] >= need)
                    owner = np.searchsorted(first, starts, side="right") - 1
                    ends = np.minimum(first[owner + 1], starts + span)
                    roomy = ends - starts >= low - int(scheme.edits(low))
                    starts, owner, ends = starts[roomy], owner[roomy], ends[roomy]
                    for k in range(0, len(starts), SLICE):
                        s, o, e = starts[k : k + SLICE], owner[k : k + SLICE], ends[k : k + SLICE]
                        # only words of windows are held
                        edge = np.bincount(s, minlength=len(hashes) + 1) - np.bincount(e, minlength=len(hashes) + 1)
                        used = np.cumsum(edge) > 0
                        moved = np.cumsum(used) - used
                        content = hashes[used[:-1]]
                        held.setdefault(c, []).append((ids.take(pa.array(o)), s - first[o], offsets[s], content, moved[s], moved[s] + e - s))
                        waiting += len(s) + len(content)
                        if waiting >= HELD:
                            yield from walked(held, key_map)
                            held, waiting = {}, 0
        yield from walked(held, key_map)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(find, f"key {kind}, place long, offset long, words array<long>, keys array<long>")


def prefix_edits(window: tuple[np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distance of each item to the best prefix of its window where that is at most `most`, else more than `most`.

    Each side: sizes, and words end to end. All pairs go in step, over the diagonals within
    the largest `most` of the main one; a pair whose whole row exceeds its own `most` is done.
    """
    (n, b_flat), (m, a_flat) = window, item
    out = most + 1
    if not len(m):
        return out
    far = np.int32(1 << 29)
    k = int(most.max())
    a, b = np.zeros((len(m), int(m.max())), np.int64), np.zeros((len(n), max(int(m.max()), int(n.max())) + 2 * k + 1), np.int64)
    a[np.arange(a.shape[1]) < m[:, None]] = a_flat
    b[(np.arange(b.shape[1]) >= k) & (np.arange(b.shape[1]) < k + n[:, None])] = b_flat
    steps = np.arange(2 * k + 1, dtype=np.int32)  # a window's word j lies on diagonal j - i + k of an item's word i
    pair, limit = np.arange(len(m)), most
    before = np.where((steps >= k) & (steps - k <= n[:, None]), steps - np.int32(k), far)
    ended = m == 0
    out[ended] = 0
    for i in range(1, a.shape[1] + 1):
        now = before + (b[:, i - 1 : i + 2 * k] != a[:, i - 1, None])
        np.minimum(now[:, :-1], before[:, 1:] + np.int32(1), out=now[:, :-1])
        place = steps + np.int32(i - k)
        now[(place < 0) | (place > n[:, None])] = far
        if i <= k:
            now[:, k - i] = i  # the item's beginning is left out whole
        before = np.minimum(np.minimum.accumulate(now - steps, axis=1) + steps, far)
        before[place > n[:, None]] = far
        best = before.min(1)
        ended = m == i
        out[pair[ended]] = best[ended]
        alive = ~ended & (best <= limit)
        if 4 * np.count_nonzero(alive) < 3 * len(pair):
            a, b, m, n, pair, limit, before = a[alive], b[alive], m[alive], n[alive], pair[alive], limit[alive], before[alive]
            if not len(pair):
                break
    return out


def edits(window: Column, item: Column, scheme: Scheme) -> Column:
    """Edit distance of the item's words to the best prefix of the window's, exact where the scheme allows that many."""

    @F.arrow_udf("int")
    def distance(window: pa.Array, item: pa.Array) -> pa.Array:
        def lists(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            return pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64), x.flatten().to_numpy(zero_copy_only=False)

        order = np.argsort(lists(item)[0], kind="stable")  # pairs of about one length go together
        window, item, out = window.take(pa.array(order)), item.take(pa.array(order)), np.zeros(len(order), np.int32)
        for k in range(0, len(order), 1000):
            pair = lists(window.slice(k, 1000)), lists(item.slice(k, 1000))
            out[order[k : k + 1000]] = prefix_edits(*pair, scheme.edits(pair[1][0]))
        return pa.array(out)

    return distance(window, item)


def contaminated(docs: DataFrame, benchmark: DataFrame, scheme: Scheme | None = None, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, edits, n_words, place, offset): one row per document and item found in it.

    edits: fewest over the document's windows; place and offset: the first such window's
    first word and character. Null texts hold nothing; rows that share a key count as one.
    Whole texts of any length are searched; an empty table on either side gives no rows.
    """
    scheme = scheme or Scheme()
    known = items(benchmark, scheme, item=item, text=item_text)
    found = windows(docs, known, scheme, key=key, text=text).select("key", "place", "offset", "words", F.explode("keys").alias("band"))
    bands = known.select(F.col("item").alias("_item"), F.explode("keys").alias("item_band"))
    met = found.join(bands, F.col("band") == F.col("item_band")).groupBy("key", "place", "_item", F.xxhash64("words").alias("_window")).agg(F.first("offset").alias("offset"), F.first("words").alias("words"))
    met = met.join(known.select("item", F.col("words").alias("item_words")), F.col("_item") == F.col("item"))
    met = met.withColumn("edits", edits(F.col("words"), F.col("item_words"), scheme)).withColumn("n_words", F.size("item_words"))
    allowed = F.floor(F.col("n_words") * (1 - scheme.similarity) + 1e-9)
    best = met.where(F.col("edits") <= allowed).groupBy("key", "item", "n_words").agg(F.min(F.struct("edits", "place", "offset")).alias("best"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), F.col("best.edits").alias("edits"), "n_words", F.col("best.place").alias("place"), F.col("best.offset").alias("offset"))


def clean(docs: DataFrame, benchmark: DataFrame, scheme: Scheme | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item is found; all columns stay, null keys and null texts included.

    Rows are told apart by key and text, since keys may be null or repeat.
    """
    row = F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("print"))
    found = contaminated(docs.select(row.alias("_row"), F.col(text).alias("_content")), benchmark, scheme, key="_row", text="_content")
    found = stage(found.select(F.col("_row.key").alias("_leak_found"), F.col("_row.print").alias("_leak_print")).distinct(), "contaminated")
    return docs.join(found, F.col(key).eqNullSafe(F.col("_leak_found")) & (F.xxhash64(F.col(text)) == F.col("_leak_print")), "left_anti")
