"""Near copies by word shingles: SimHash and bands of min-hashes propose pairs, exact Jaccard similarity decides.

Texts with the same set of shingles are folded into one. Sets whose SimHashes are within
two bits meet first (the links of `simhash`). Then `bands` keys of `rows`
min-hashes each bring texts together; at similarity s a pair shares none with chance
(1 - s**rows)**bands, 4 in 10 000 at 0.8 by the defaults and less above. Every pair
that is linked was compared by its whole shingle sets. Texts of a band are first
held against its smallest one, a text against that of most of its bands, and copies
fold away, as long as that takes a tenth of them. Then all texts that met are joined by
prefixes, but for pairs that links have joined already, so no link of a folded text is lost:
shingles are put in one order, rare ones first, and two sets of n and m shingles
that are similar share one of their first n - ceil(0.8 n) + 1 (m alike). That is exact, and
a passage that many texts hold makes no pairs, being at the end of that order. The order
goes by classes of how many sets have a shingle, which bitmaps of fixed size hold, and in a
class by the shingle's hash, so a task finds the prefix of a text alone. Sets that
share such a shingle are first held against the next one each, if it is of another group,
as long as that finds links for a tenth of the groups; pairs are made of what is left, and
only where the signs of two sets (the parity of their shingles on 512 bits) differ in so
few bits that the sets can be similar.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stage
from . import common, simhash
from .components import components

#: A shingle's class in the order is the number of these that its count in sets is above.
RARE = (8, 64, 512, 4096)

#: Bits of a set's sign. Sets of up to about 1000 shingles are told apart by it; larger ones only rarely, and are compared.
SIGN_BITS = 512


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct 64-bit shingles of `width` words, sorted; words as in SimHash, and fewer words are one shingle."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        words = [b" ".join(words)] * width
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, out = len(words) - width + 1, np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = common.mixed(out + hashes[i : i + n])
    return np.unique(out)


def marks(text: Column, width: int, bands: int, rows: int, seed: int = 42) -> Column:
    """digest: of the set of shingles (128 bits). n: its size. bands: keys that similar sets share."""
    draw = np.random.default_rng(seed)
    masks, odd = draw.integers(0, 2**63, bands * rows, dtype=np.uint64), draw.integers(0, 2**62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @F.arrow_udf("digest binary, n int, bands array<long>")
    def marked(texts: pa.Array) -> pa.Array:
        digests, sizes, keys = [], [], []
        for part in common.chunks(texts):
            for x in part.cast(pa.large_binary()).to_pylist():
                own = shingles(x, width)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                if not bands or not len(own):
                    keys.append([])
                    continue
                parts = [((own[i : i + 4096] ^ masks[:, None]) * odd[:, None]).min(1) for i in range(0, len(own), 4096)]
                least = np.min(parts, axis=0).reshape(bands, rows)
                key = np.arange(bands, dtype=np.uint64)
                for i in range(rows):
                    key = common.mixed(key + least[:, i])
                keys.append(key.view(np.int64))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["digest", "n", "bands"])

    return common.once(marked)(text)


def shingle_list(text: Column, width: int) -> Column:
    """The distinct shingles of a text."""

    @F.arrow_udf("array<long>")
    def listed(texts: pa.Array) -> pa.Array:
        sets = [shingles(x, width).view(np.int64) for part in common.chunks(texts) for x in part.cast(pa.large_binary()).to_pylist()]
        return pa.array(sets, pa.list_(pa.int64()))

    return listed(text)


def prefix(text: Column, width: int, similarity: float, often: list[np.ndarray]) -> Column:
    """n: size of a text's set. first: its prefix, in order. sign: for each of SIGN_BITS, whether an odd number of its shingles has it.

    Shingles are in order of the number of bitmaps in `often` that hold them, then of their value.
    """

    @F.arrow_udf("n int, first array<long>, sign array<long>")
    def found(texts: pa.Array) -> pa.Array:
        sizes, firsts, signs, low = [], [], [], np.uint64(SIGN_BITS - 1)
        for part in common.chunks(texts):
            for x in part.cast(pa.large_binary()).to_pylist():
                own = shingles(x, width)
                n, kind = len(own), np.zeros(len(own), np.int8)
                for one in often:
                    kind += common.in_bitmap(one, own)
                sizes.append(n)
                firsts.append(own[np.argsort(kind, kind="stable")][: n - math.ceil(n * similarity - 1e-9) + 1].view(np.int64))
                signs.append(np.packbits(np.bincount((own & low).astype(np.int64), minlength=SIGN_BITS) & 1).view(np.int64))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (firsts, signs)]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), *lists], ["n", "first", "sign"])

    return common.once(found)(text)


def rare_prefixes(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(shingle, a, n, place, sign): the prefixes of the sets of `texts` (digest, text); staged, a row a set."""
    counts = texts.select(F.explode(shingle_list(F.col("text"), width)).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("sets"))
    counts = stage(counts.where(F.col("sets") > RARE[0]), "often")
    often = [common.bitmap(counts.where(F.col("sets") > n), F.col("shingle")) for n in RARE]
    sets = stage(texts.select(F.col("digest").alias("a"), prefix(F.col("text"), width, similarity, often).alias("_p")).select("a", "_p.*"), "prefixes")
    return sets.select("a", "n", F.posexplode("first").alias("_at", "shingle"), "sign").select("shingle", "a", "n", (F.col("_at") + 1).alias("place"), "sign")


def mixed_prefixes(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of `prefixes` whose shingle several groups have, with their `root`; staged. `groups` (node, root): sets that are joined already."""
    rows = prefixes.select("shingle", "a", "n", "place").join(groups, F.col("a") == F.col("node"), "left").select("shingle", "a", "n", "place", F.coalesce("root", "a").alias("root"))
    mixed = rows.groupBy("shingle").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least < _most").select(F.col("shingle").alias("_mixed"))
    rows = rows.join(mixed, F.col("shingle") == F.col("_mixed"), "left_semi")
    signs = prefixes.select(F.col("a").alias("_signed"), "sign").distinct()  # wide: only rows that stay take theirs along
    return stage(rows.join(signs, F.col("a") == F.col("_signed")).select("shingle", "a", "n", "place", "sign", "root"), "mixed-prefixes")


def _can_be_similar(similarity: float) -> Column:
    """Whether two sets, n long at `place` with `sign` and m long at `at` with `_sign`, have room to be similar."""
    both = F.col("n") + F.col("m")
    alike = F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9  # sizes of similar sets
    # from their first common shingle on similar sets have room for all that they must share
    room = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) + 1 >= both * (similarity / (1 + similarity)) - 1e-6
    # a bit that differs takes a shingle that one of them has alone
    apart = sum((F.bit_count(F.col("sign")[i].bitwiseXOR(F.col("_sign")[i])) for i in range(SIGN_BITS // 64)), F.lit(0))
    return alike & room & (apart <= both * ((1 - similarity) / (1 + similarity)) + 1e-6)


def neighbours(prefixes: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b), a > b: at each shingle a set beside the next one, if that is of another group, in an order that each turn draws anew; no more pairs than rows."""
    order = W.partitionBy("shingle").orderBy(F.xxhash64("a", F.lit(turn)), "a")
    met = prefixes.withColumn("y", F.lead(F.struct("a", "n", "place", "sign", "root")).over(order)).where(F.col("y.root") != F.col("root"))
    met = met.select("a", "n", "place", "sign", F.col("y.a").alias("b"), F.col("y.n").alias("m"), F.col("y.place").alias("at"), F.col("y.sign").alias("_sign"))
    return met.where(_can_be_similar(similarity)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def prefix_pairs(prefixes: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a > b: all pairs of different groups that can be similar, by `mixed_prefixes`; repeats too."""
    other = prefixes.select(F.col("shingle").alias("_shingle"), F.col("a").alias("b"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("sign").alias("_sign"), F.col("root").alias("_root"))
    met = (F.col("shingle") == F.col("_shingle")) & (F.col("a") > F.col("b")) & (F.col("root") != F.col("_root"))
    return prefixes.join(other, met & _can_be_similar(similarity)).select("a", "b")


def rare_pairs(texts: DataFrame, width: int, similarity: float, groups: DataFrame | None = None) -> DataFrame:
    """(a, b), a > b: all pairs of digests that can be similar. `texts` has (digest, text), `groups` (node, root) of sets that are joined already: no pair of theirs comes.

    Both share a shingle of both prefixes, from which on there is room for as many common
    ones as similar sets of their sizes have, and their signs differ in no more bits than
    similar sets have shingles alone.
    """
    groups = groups if groups is not None else texts.select(F.col("digest").alias("node"), F.col("digest").alias("root")).limit(0)
    return prefix_pairs(mixed_prefixes(rare_prefixes(texts, width, similarity), groups), similarity)


def jaccard(left: Column, right: Column, width: int) -> Column:
    """Exact similarity of two texts' sets of shingles; 0 if both are empty."""

    @F.arrow_udf("double")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = (shingles((t.as_py() or "").encode(), width) for t in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(len(x) + len(y) - both, 1))
        return pa.array(out, pa.float64())

    return similarity(left, right)


def print_pairs(prints: DataFrame) -> DataFrame:
    """(a, b), a != b: sets with the same SimHash beside the smallest such set, and those sets where SimHashes are linked. `prints` has (digest, print)."""
    top = prints.groupBy("print").agg(F.min("digest").alias("top"))
    same = prints.join(top, "print").where(F.col("digest") != F.col("top")).select(F.col("digest").alias("a"), F.col("top").alias("b"))
    ends = [top.select(F.col("print").alias(c), F.col("top").alias(f"_{c}")) for c in ("a", "b")]
    return same.unionByName(simhash.links(prints, "print").join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def wanted_digest(text: Column, hashed: Column, width: int, wanted: np.ndarray) -> Column:
    """The digest of a text's set, as in `marks`; null where the bitmap doesn't hold the row's hash."""

    @F.arrow_udf("binary")
    def digests(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        asked = common.in_bitmap(wanted, hashes.to_numpy(zero_copy_only=False))
        parts = common.chunks(texts.filter(pa.array(asked)))
        found = iter([xxhash.xxh3_128_digest(shingles(x, width).tobytes()) for part in parts for x in part.cast(pa.large_binary()).to_pylist()])
        return pa.array([next(found) if x else None for x in asked], pa.binary())

    return common.once(digests)(text, hashed)


def crowded_texts(docs: DataFrame, every: DataFrame, nodes: DataFrame, *, key: str, text: str, width: int) -> DataFrame:
    """(digest, text): one text of each set of `nodes` (node); staged once for all rounds.

    `every` has (digest, content, least): a set's name, what `marks` calls it, and its smallest key. Only
    rows with the key of such a set (and those few that a bitmap takes for one) are shuffled.
    """
    named = stage(every.join(nodes, F.col("digest") == F.col("node"), "left_semi").select("digest", "content", F.xxhash64("least").alias("hashed")), "crowded")
    wanted = common.bitmap(named, F.col("hashed"))
    texts = docs.select(F.col(text).alias("text"), wanted_digest(F.col(text), F.xxhash64(key), width, wanted).alias("_own")).where(F.col("_own").isNotNull())
    return stage(texts.join(named, F.col("_own") == F.col("content")).groupBy("digest").agg(F.first("text").alias("text")), "crowded-texts")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): the pairs of digests whose texts are similar; staged. `texts` has (digest, text)."""
    pairs = stage(pairs.distinct(), "candidates")
    left = texts.select(F.col("digest").alias("_l"), F.col("text").alias("_left"))
    right = texts.select(F.col("digest").alias("_r"), F.col("text").alias("_right"))
    both = pairs.join(left, F.col("a") == F.col("_l")).join(right, F.col("b") == F.col("_r"))
    return stage(both.where(jaccard(F.col("_left"), F.col("_right"), width) >= similarity).select("a", "b"), "verified")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """`groups` (node, root) joined by more links."""
    return components(links.select("a", "b").unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _folded(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a group (node, root) of sets: that with the smallest key, null keys last."""
    grouped = sets.join(groups, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "digest")).alias("best"))
    return stage(best.select("best.least", "best.digest"), "folded")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 5) -> DataFrame:
    """The rows of `docs` without near copies; all columns stay.

    Of rows joined by links of at least `similarity`, over any number of others, the one with the
    smallest key stays (null keys last). Texts without words count as copies.
    """
    both = docs.select(F.col(key).alias("_key"), marks(F.col(text), width, bands, rows).alias("m"), simhash.fingerprint(F.col(text), width).alias("print"))
    marked = stage(both.select("_key", "m.*", "print"), "marks")
    every = marked.groupBy(F.col("digest").alias("content")).agg(F.min("_key").alias("least"), F.first("print").alias("print"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    every = stage(every.withColumn("digest", F.monotonically_increasing_id()), "sets")  # from here on a number names a set
    cells = every.select("digest", "n", F.explode("bands").alias("band"))
    shared = cells.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select(F.col("band").alias("_band"))
    cells = stage(cells.join(shared, F.col("band") == F.col("_band"), "left_semi"), "bands")
    near = stage(print_pairs(every.where("print is not null").select("digest", "print")), "prints")
    every = every.select("digest", "content", "least")
    nodes = cells.select(F.col("digest").alias("node")).union(near.select("a")).union(near.select("b")).distinct()
    texts = crowded_texts(docs, every, nodes, key=key, text=text, width=width)
    groups = components(verified(near, texts, width, similarity))
    sets = _folded(every, groups)
    alike = F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9  # sizes of similar sets
    while True:
        left = cells.join(sets, "digest", "left_semi")
        met = stage(left.groupBy("band").agg(F.min(F.struct("digest", "n")).alias("top"), F.count("*").alias("members")).where("members > 1").select(F.col("band").alias("_band"), "top"), "tops")
        cells = stage(left.join(met, F.col("band") == F.col("_band")).select(left.columns + ["top"]), "bands")
        stars = cells.select(F.col("digest").alias("a"), F.col("top.digest").alias("b"), "n", F.col("top.n").alias("m")).where((F.col("a") != F.col("b")) & alike)
        # each set meets the one it shares most bands with
        votes = stars.groupBy("a", "b").agg(F.count("*").alias("bands"))
        best = votes.groupBy("a").agg(F.max(F.struct("bands", "b")).alias("best")).select("a", "best.b")
        links, cells = verified(best, texts, width, similarity), cells.drop("top")
        folds = links.count()
        if folds:
            groups = _joined(groups, links)
            sets = _folded(every, groups)
        if 10 * folds <= cells.select("digest").distinct().count():
            break
    # links of sets that folded away count too: all crowded sets are joined, but for pairs that are in one group already
    prefixes, turn = rare_prefixes(texts, width, similarity), 0
    while True:
        prefixes = mixed_prefixes(prefixes, groups)
        if turn < 0:
            break
        links = verified(neighbours(prefixes, similarity, turn), texts, width, similarity)
        groups = _joined(groups, links)
        turn = turn + 1 if 10 * links.count() > prefixes.select("root").distinct().count() else -1
    rest = verified(prefix_pairs(prefixes, similarity), texts, width, similarity)
    sets = _folded(every, _joined(groups, rest))
    kept = sets.join(every.select("digest", "content"), "digest").select(F.col("least").alias("_dedup_key"), F.col("content").alias("_dedup_digest"))
    if marked.groupBy("_key").count().where("count > 1").isEmpty():
        kept = kept.select("_dedup_key")
        # most rows stay: only those whose key may be one that goes (a bitmap says) meet the keys that stay
        gone = marked.select("_key").join(kept, F.col("_key").eqNullSafe(F.col("_dedup_key")), "left_anti")
        doubtful = common.held(F.xxhash64(key), common.bitmap(gone, F.xxhash64("_key")))
        return docs.where(~doubtful).unionByName(docs.where(doubtful).join(kept, F.col(key).eqNullSafe(F.col("_dedup_key"))).select(docs.columns))
    # keys that repeat don't name a row: there the set does, and of rows that are alike in both one stays
    own = docs.withColumn("_dedup_own", marks(F.col(text), width, 0, 0)["digest"])
    return own.join(kept, F.col(key).eqNullSafe(F.col("_dedup_key")) & (F.col("_dedup_own") == F.col("_dedup_digest"))).dropDuplicates(["_dedup_own"]).select(docs.columns)
