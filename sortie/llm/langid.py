"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is one blank; runs of one to three
characters are hashed into buckets. The model is a bucket x language matrix of
log probabilities, fixed in size, which is broadcast; tasks score Arrow batches
in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """languages: sorted; weights: (buckets + 1, languages), the last row for what isn't a gram."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray


def grams(texts: pa.Array, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length, the bucket of the gram that begins at each character (2**bits: none); text bounds."""
    points, bounds = common.codepoints(pc.utf8_lower(texts))
    word = common.letters()[points]
    symbol = np.where(word, points, 32).astype(np.uint32)
    last = np.zeros(len(points), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    out, h, any_letter, ends = [], np.zeros(len(points), np.uint32), np.zeros(len(points), bool), np.zeros(len(points), bool)
    for n in range(1, 4):
        size = max(len(points) - n + 1, 0)
        if n > 1:
            ends = (ends[:size] | last[n - 2 : n - 2 + size])
        h = (h[:size] ^ symbol[n - 1 : n - 1 + size]) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        any_letter = any_letter[:size] | word[n - 1 : n - 1 + size]
        bucket = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int32)
        bucket[~any_letter | ends] = 1 << bits
        out.append(bucket)
    return out, bounds


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 5000, bits: int = 15, smoothing: float = 0.5) -> Model:
    """Counts grams of labelled rows (null languages and texts are skipped) and takes logarithms.

    per_language bounds the sample: about so many rows of each language, chosen by a
    hash of the key. Each task sends at most one row per bucket and language it saw.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    rows = common.sample_by_hash(rows, F.col("_key"), "_lang", per_language).select("_text", "_lang")
    none = 1 << bits

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.asarray(batch.column(1).to_pylist(), dtype=object)
            at = 0
            for part in common.chunks(batch.column(0)):
                mine, (buckets, bounds) = names[at : at + len(part)], grams(part, bits)
                at += len(part)
                for name in set(mine):
                    chosen = np.repeat(mine == name, np.diff(bounds))
                    total = totals.setdefault(name, np.zeros(none + 1, np.int64))
                    for b in buckets:
                        total += np.bincount(b[chosen[: len(b)]], minlength=none + 1)
                    total[none] += int((mine == name).sum())
        for name, total in totals.items():
            seen = np.flatnonzero(total[:none])
            docs_seen = pa.array([total[none]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(seen) + 1)), pa.concat_arrays([pa.array(seen, pa.int32()), pa.array([none], pa.int32())]), pa.concat_arrays([pa.array(total[seen]), docs_seen])], ["lang", "bucket", "n"])

    # what isn't a gram falls on the last bucket, which here holds the number of texts instead
    def counted(batches):
        for out in count(batches):
            yield out

    got = rows.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(set(got["lang"])))
    if not names:
        return Model((), np.zeros((none + 1, 0), np.float32), np.zeros(0))
    counts = np.zeros((none + 1, len(names)))
    counts[got["bucket"].to_numpy(), [names.index(x) for x in got["lang"]]] = got["n"]
    texts, counts = counts[none].copy(), counts[:none] + smoothing
    weights = np.vstack([np.log(counts / counts.sum(0)), np.zeros(len(names))]).astype(np.float32)
    return Model(names, weights, np.log(np.maximum(texts, 1) / max(texts.sum(), 1)))


def predicted(model: Model, text: Column) -> Column:
    """struct(lang, score): the likeliest language and its posterior.

    `und` with score 0 for a null text, one without a letter, or a model that
    learned no language. Ties go to the first language in alphabetical order.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)
    kind = "lang string, score double"

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        bits = (len(model.weights) - 1).bit_length() - 1
        langs, scores = [], []
        for part in common.chunks(texts):
            buckets, bounds = grams(part, bits)
            known = common.sums(buckets[0] < (1 << bits), bounds) > 0
            if not model.languages:
                known[:] = False
            total = np.zeros((len(part), max(len(model.languages), 1)))
            if model.languages:
                weight = model.weights[buckets[0]]
                for b in buckets[1:]:
                    weight[: len(b)] += model.weights[b]
                total = common.sums(weight, bounds) + model.prior
            best = total.argmax(1)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            langs += [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            scores.append(np.where(known, share, 0.0))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"])

    return common.once(score)(text)
