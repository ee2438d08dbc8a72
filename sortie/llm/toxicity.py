"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens (words) are toxic or not. Emissions are sums of weights of hashed features:
the word, its beginnings, and the words beside it; transitions are four
weights. Forward and backward messages give each token's marginal. They run over
segments of bounded length for all texts of a batch in step: each segment is run
from both states, and a text's segments are chained by 2 x 2 matrices, so a long text
costs no more steps than a short one, and nothing is approximated.

Labels are of documents, so tokens are labelled through them: a word, or a beginning
of words, is a toxic unit if toxic sample documents have it and clean ones hardly do;
in toxic documents the words with such a unit are toxic tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tokens of a segment.
SEGMENT = 256
TEMPLATES = 6


@dataclass(frozen=True)
class Model:
    """weights: (TEMPLATES, 2**bits), of toxic over not; moves: log potentials [from, to]; ends: of the first state.

    document: intercept and weights of the logistic score over `summary`.
    """

    weights: np.ndarray
    moves: np.ndarray
    ends: np.ndarray
    document: np.ndarray


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (units, tokens) of the word and its beginnings; starts and lengths in their text; first tokens."""
    points, bounds = common.codepoints(pc.utf8_lower(texts))
    starts, lengths, first = common.words(points, bounds)
    parts = [(starts, lengths), *((starts, np.minimum(lengths, n)) for n in (3, 4, 5))]
    units = np.stack([common.span_hashes(points, s, n) for s, n in parts]) if len(starts) else np.zeros((4, 0), np.uint64)
    return units, starts - np.repeat(bounds[:-1], np.diff(first)), lengths, first, bounds


def buckets(units: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """(TEMPLATES, tokens): the bucket of each feature; beside a text's end stands the empty word."""
    word = units[0]
    before, after = np.append(np.uint64(0), word)[:-1].copy(), np.append(word, np.uint64(0))[1:].copy()
    full = first[:-1][np.diff(first) > 0]
    before[full] = 0
    after[first[1:][np.diff(first) > 0] - 1] = 0
    salted = [common.mixed(h ^ np.uint64(977 * (i + 1))) for i, h in enumerate((*units, before, after))]
    return (np.stack(salted) >> np.uint64(64 - bits)).astype(np.int32)


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the chance to be toxic; of each text the expected moves (2, 2), and the first state's chance.

    emission: log potential of toxic over not. All exact, by segments.
    """
    n, texts = len(emission), len(first) - 1
    p, pair, start = np.zeros(n), np.zeros((texts, 2, 2)), np.zeros((texts, 2))
    if not n:
        return p, pair, start
    sizes = np.diff(first)
    per_text = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(texts), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = first[owner] + nth * SEGMENT
    length = np.minimum(SEGMENT, first[owner + 1] - at)
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    depth = int(length[0])
    active = np.searchsorted(-length, -np.arange(depth), side="left")  # segments longer than each step
    move, count = np.exp(moves), len(at)
    e = np.exp(np.clip(emission, -30, 30))
    begin, opens = np.exp(ends), nth[order] == 0
    # forward[t, s, i]: messages of the token when the state before the segment was i (0, 1), at t = 0 the state before
    forward = np.zeros((depth + 1, count, 2, 2))
    forward[0] = np.eye(2)
    scale = np.ones((depth + 1, count))
    for t in range(depth):
        k = active[t]
        new = forward[t, :k] @ move
        if t == 0:  # a text's first segment has one way in: its opening potentials
            new[opens] = np.array([begin, [0.0, 0.0]])
        new[:, :, 1] *= e[at[:k] + t][:, None]
        total = new.sum((1, 2))
        scale[t + 1, :k] = total
        forward[t + 1, :k] = new / total[:, None, None]
    whole = forward[length, np.arange(count)]
    # chain the segments of each text: the message into a segment, and the one back out of it
    chained = np.empty_like(whole)
    chained[order] = whole
    into, out = np.zeros((count, 2)), np.ones((count, 2))
    starts_of = np.cumsum(per_text) - per_text
    for j in range(int(per_text.max())):
        rows = starts_of[per_text > j] + j
        into[rows] = (1.0, 0.0) if j == 0 else np.einsum("si,sij->sj", into[rows - 1], chained[rows - 1])
        into[rows] /= into[rows].sum(1, keepdims=True)
    for j in range(int(per_text.max()) - 2, -1, -1):
        rows = starts_of[per_text > j + 1] + j
        out[rows] = np.einsum("sij,sj->si", chained[rows + 1], out[rows + 1])
        out[rows] /= out[rows].sum(1, keepdims=True)
    into, back, mine = into[order], out[order].copy(), owner[order]
    for t in range(depth - 1, -1, -1):
        k = active[t]
        here = np.einsum("si,sij->sj", into[:k], forward[t + 1, :k])
        joint = here * back[:k]
        p[at[:k] + t] = joint[:, 1] / joint.sum(1)
        weighted = back[:k].copy()
        weighted[:, 1] *= e[at[:k] + t]
        if t == 0:
            firsts = opens[:k]
            z = begin * weighted[firsts]
            start[mine[:k][firsts]] += z / z.sum(1, keepdims=True)
        left = np.einsum("si,sij->sj", into[:k], forward[t, :k])
        both = left[:, :, None] * move * weighted[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        inner = np.ones(k, bool) if t else ~opens[:k]
        np.add.at(pair, mine[:k][inner], both[inner])
        back[:k] = weighted @ move.T
        back[:k] /= back[:k].sum(1, keepdims=True)
    return np.clip(p, 0.0, 1.0), pair, start


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: log of the expected toxic tokens, the greatest marginal, and the log of their share."""
    expected, most = common.sums(p, first), np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        most[full] = np.maximum.reduceat(p, first[:-1][full])
    return np.stack([np.log(0.05 + expected), most, np.log(1e-4 + expected / np.maximum(np.diff(first), 1))], 1)


def _toxic_units(units: np.ndarray, first: np.ndarray, toxic: np.ndarray, least: int, odds: float) -> np.ndarray:
    """For each token, whether a unit of it marks toxic documents.

    A unit is counted by the different words before it, not by documents: copies of a
    document don't make its rare words look frequent.
    """
    of_toxic, marked = toxic[np.repeat(np.arange(len(toxic)), np.diff(first))], np.zeros(units.shape[1], bool)
    before = np.append(np.uint64(0), units[0])[:-1]
    for row in units:
        found = np.unique(np.stack([row, before, of_toxic.astype(np.uint64)], 1), axis=0)
        names, place = np.unique(found[:, 0], return_inverse=True)
        bad = np.bincount(place, found[:, 2] == 1, len(names))
        clean = np.bincount(place, minlength=len(names)) - bad
        rate = (bad + 0.5) / (toxic.sum() + 1) / ((clean + 0.5) / ((~toxic).sum() + 1))
        marked |= np.isin(row, names[(bad >= least) & (rate >= odds)])
    return marked & of_toxic


def fit(labelled: DataFrame, texts: DataFrame | None = None, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1200, bits: int = 18, epochs: int = 3, rate: float = 0.3, least: int = 12, odds: float = 20.0) -> Model:
    """Learns from about `per_class` rows of each label (a bounded sample by a hash of the key); whole texts are used.

    Labels may lie in a table of their own, with the texts in `texts`: then keys are sampled
    first, and the few chosen are sent to the texts, which are not shuffled. Rows with a null
    text or label are skipped; a repeated key counts as often as it stands there. Without
    both labels, as in an empty table, the model scores all texts alike.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"), *([F.col(text).alias("_text")] if texts is None else []))
    chosen = common.sample_by_hash(rows if texts is not None else rows.where("_text IS NOT NULL"), F.col("_key"), "_label", per_class)
    if texts is not None:  # per_class bounds what is broadcast
        named = texts.select(F.col(key).alias("_of"), F.col(text).alias("_text")).where("_text IS NOT NULL")
        chosen = named.join(F.broadcast(chosen), F.col("_of") == F.col("_key"))
    got = chosen.select("_text", "_label", F.xxhash64("_key").alias("_order")).toPandas().sort_values(["_order", "_text"])
    toxic = got["_label"].to_numpy() == 1
    model = Model(np.zeros((TEMPLATES, 1 << bits), np.float32), np.zeros((2, 2)), np.zeros(2), np.array([-2.0, 0, 0, 0]))
    if not toxic.any() or toxic.all():
        return model
    units, _, _, first, _ = tokens(pa.array(got["_text"], pa.large_string()))
    del got
    common.tidy()
    least = max(3, min(least, int(toxic.sum()) // 40))  # few toxic rows can't show many contexts
    gold, columns = _toxic_units(units, first, toxic, least, odds).astype(np.int64), buckets(units, first, bits)
    weights, moves, ends = model.weights.astype(np.float64), model.moves.copy(), np.array([0.0, -2.0])
    weights[0] -= 2.0  # most tokens are not toxic, those never seen least of all
    square = [np.full_like(weights, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    usual = np.stack([np.bincount(c, minlength=1 << bits) > least for c in columns])  # a rare feature says nothing
    draw = np.random.default_rng(11)
    for _ in range(epochs):  # likelihood gradients: what the labels have less what the field expects
        for batch in np.array_split(draw.permutation(len(toxic)), max(1, len(toxic) // 150)):
            sizes = np.diff(first)[batch]
            take = np.repeat(first[batch] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            x, y = columns[:, take], gold[take]
            p, pair, start = marginals(sum(w[c] for w, c in zip(weights, x, strict=True)), bounds, moves, ends)
            follows = np.ones(len(y), bool)
            follows[bounds[:-1][sizes > 0]] = False
            now = np.flatnonzero(follows)
            seen = np.bincount(2 * y[now - 1] + y[now], minlength=4).reshape(2, 2)
            opening = np.bincount(y[bounds[:-1][sizes > 0]], minlength=2)
            steps = [np.stack([np.bincount(c, y - p, 1 << bits) for c in x]) * usual, seen - pair.sum(0), opening - start.sum(0)]
            for value, step, total in zip((weights, moves, ends), steps, square, strict=True):
                total += step * step
                value += rate * step / np.sqrt(total)
    p, _, _ = marginals(sum(w[c] for w, c in zip(weights, columns, strict=True)), first, moves, ends)
    x, y = np.column_stack([np.ones(len(toxic)), summary(p, first)]), toxic.astype(float)
    theta = np.zeros(4)
    for _ in range(25):  # Newton steps of a ridge logistic fit
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        theta += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(4), x.T @ (y - q) - 0.5 * theta)
    return Model(weights.astype(np.float32), moves, ends, theta)


def tagged(model: Model, text: Column, at_least: float = 0.5) -> Column:
    """struct(score, spans): a document's chance to be toxic, and its words of marginal `at_least` with offsets.

    Offsets are code points, the end exclusive. A null or empty text, or one without
    words, has no spans and the score of no evidence.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])

    @F.arrow_udf("struct<score:double,spans:array<struct<start:int,end:int,marginal:double>>>")
    def tag(texts: pa.Array) -> pa.Array:
        model, scores, lists = shared.value, [np.zeros(0)], [pa.array([], pa.list_(span))]
        bits = (model.weights.shape[1] - 1).bit_length()
        for part in common.chunks(texts, common.CHUNK_BYTES):
            units, starts, lengths, first, _ = tokens(part)
            columns = buckets(units, first, bits)
            emission = np.zeros(columns.shape[1])
            for w, c in zip(model.weights, columns, strict=True):
                emission += w[c]
            p, _, _ = marginals(emission, first, model.moves, model.ends)
            x = np.column_stack([np.ones(len(part)), summary(p, first)]) @ model.document
            scores.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
            bad = np.flatnonzero(p >= at_least)
            ends = np.searchsorted(bad, first).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(starts[bad].astype(np.int32)), pa.array((starts + lengths)[bad].astype(np.int32)), pa.array(p[bad])], fields=list(span))
            lists.append(pa.ListArray.from_arrays(pa.array(ends), rows).cast(pa.list_(span)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.concat_arrays(lists)], ["score", "spans"])

    return tag(text)
