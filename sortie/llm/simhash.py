"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits have a word within half the radius of both.
So every distinct fingerprint emits all words within half the radius; words are
shuffled, and fingerprints that meet are verified. At half a radius of one bit a
word has at most 65 distinct fingerprints, whatever the data: copies were folded
into one fingerprint before.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stage
from . import common
from .components import components

#: How many shingles are held at once in a task.
HELD = 1 << 19


def _fingerprints(texts: list[bytes], width: int, seed: int) -> np.ndarray:
    digest, digests, counts = xxhash.xxh64_digest, [], []
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
        joined = b" ".join(words)
        if len(words) <= width:
            digests += [digest(joined, seed)] if words else []
            counts.append(1 if words else 0)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        digests += [digest(joined[i:j], seed) for i, j in zip(begins[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
        counts.append(len(words) - width + 1)
    n = np.array(counts, np.int64)
    octets = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    # bits are counted by the histogram of each of the eight octets, then by the bits of the 256 octets
    cell = (np.repeat(np.arange(len(n)), n)[:, None] * 8 + np.arange(8)) * 256 + octets
    seen = np.bincount(cell.ravel(), minlength=len(n) * 2048).reshape(-1, 8, 256)
    bits = seen @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return np.packbits(2 * bits.reshape(-1, 64) > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """A text's 64-bit SimHash over shingles of `width` words, repeats included.

    Words are cut at ASCII white space and lower-cased in A-Z. A text of fewer words
    is one shingle; a null text or one without words has fingerprint 0. A bit is set
    if it is set in over half the shingles' XXH64.
    """

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        out = []
        for part in common.chunks(texts):
            rows, group, size = part.cast(pa.large_binary()).to_pylist(), [], 0
            for row in rows:
                if group and (size + len(row) > 6 * HELD or len(group) >= 1024):
                    out.append(_fingerprints(group, width, seed))
                    group, size = [], 0
                group.append(row)
                size += len(row)
            out.append(_fingerprints(group, width, seed))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    return fingerprints(text)


def ball(word: Column, radius: int) -> Column:
    """All words within `radius` bits of a 64-bit word, as an array."""
    flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return F.array(*[word.bitwiseXOR(F.lit(x - (1 << 64) if x >> 63 else x)) for x in flips])


def links(prints: DataFrame, column: str = "fingerprint", radius: int = 2) -> DataFrame:
    """(a, b), a > b: verified links that join all distinct fingerprints within `radius` bits.

    Of the fingerprints that meet at a word each is linked to the smallest, if they are
    within the radius. For radius 2 (and 1) any two that meet are, so no connection
    is lost; a larger radius links all that meet with each other.
    """
    met = prints.where(F.col(column).isNotNull()).select(F.col(column).alias("a")).distinct()
    met = met.select("a", F.explode(ball(F.col("a"), (radius + 1) // 2)).alias("word"))
    if (radius + 1) // 2 * 2 <= max(radius, 2):
        met = met.withColumn("b", F.min("a").over(W.partitionBy("word")))
    else:
        met = met.join(met.select("word", F.col("a").alias("b")), "word")
    return met.where("a > b").select("a", "b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fingerprint long, component, root): one row per row; component is the least key reachable by links.

    root is the group's least fingerprint, which tells groups without any key apart.

    Rows with a null key keep a row; the component ignores nulls (null only if all are).
    """
    prints = stage(docs.select(F.col(key).alias("_key"), fingerprint(F.col(text), width, seed).alias("_print")), "fingerprints")
    least = prints.groupBy("_print").agg(F.min("_key").alias("_least"))
    roots = components(links(prints, "_print", radius))
    joined = stage(least.join(roots, F.col("_print") == F.col("node"), "left").select("_print", F.coalesce("root", "_print").alias("_root"), "_least"), "roots")
    first = joined.groupBy("_root").agg(F.min("_least").alias("component")).withColumnRenamed("_root", "_top")
    named = stage(joined.join(first, F.col("_root") == F.col("_top")).select(F.col("_print").alias("_at"), F.col("_root").alias("root"), "component"), "components")
    return prints.join(named, F.col("_print") == F.col("_at")).select(F.col("_key").alias(key), F.col("_print").alias("fingerprint"), "component", "root")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """The rows of `docs` whose key is its component's; all columns stay. Of rows with one key, one stays."""
    found = stage(classes(docs.select(key, text), key=key, text=text, radius=radius, width=width, seed=seed), "classes")
    first = found.where(F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("_dedup_kept"), F.col("fingerprint").alias("_dedup_print"), F.col("root").alias("_dedup_root"))
    many = found.groupBy(F.col(key).alias("_dedup_key")).count().where("count > 1")
    if many.isEmpty():
        return docs.join(first.select("_dedup_kept"), F.col(key).eqNullSafe(F.col("_dedup_kept"))).select(docs.columns)
    # keys that repeat don't name a row: there the fingerprint does, and of rows that are alike in both one stays
    many = stage(many.select("_dedup_key"), "repeated")
    once = docs.join(first.join(many, F.col("_dedup_kept").eqNullSafe(F.col("_dedup_key")), "left_anti"), F.col(key).eqNullSafe(F.col("_dedup_kept")))
    again = docs.join(many, F.col(key).eqNullSafe(F.col("_dedup_key")), "left_semi").withColumn("_dedup_own", fingerprint(F.col(text), width, seed))
    again = again.join(first.distinct(), F.col(key).eqNullSafe(F.col("_dedup_kept")) & (F.col("_dedup_own") == F.col("_dedup_print"))).dropDuplicates(["_dedup_root"])
    return once.select(docs.columns).unionByName(again.select(docs.columns))
