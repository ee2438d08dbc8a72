"""Nearest neighbours by a forest of random-projection trees and exact reranking.

Trees are grown on a bounded sample: each node splits at the median along the best of
a few random directions. They are broadcast (their size follows from the sample's
bound); every vector is then dropped into its leaf of each tree. A query searches all
trees through one priority queue, ordered by its distance to the cells not yet opened,
until the leaves taken hold its budget of vectors by their exact counts. The budget is at
least `candidates` and grows until a fixed set of probing queries, whose true neighbours
one pass over all vectors finds, reaches `recall`. Leaves are cut
into blocks, each query meets the blocks of its leaves, and the inner products of
all pairs in a block are taken exactly; the best of each query's blocks are merged.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stage


@dataclass(frozen=True)
class Tree:
    """Nodes in order: direction, threshold, left and right child; a child below 0 is leaf ~child."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def grow(sample: np.ndarray, leaf: int, seed: int, tries: int = 6) -> Tree:
    """A tree over the sample; a part whose vectors no direction splits is a leaf."""
    draw, nodes, leaves = np.random.default_rng(seed), [], 0
    stack = [(np.arange(len(sample)), -1, 0)]
    children: list[list[int]] = []
    while stack:
        rows, parent, side = stack.pop()
        best = None
        if len(rows) > leaf:
            for _ in range(tries):
                a, b = sample[draw.choice(rows, 2, replace=False)]
                d = a - b + 1e-3 * draw.standard_normal(sample.shape[1])
                d /= np.linalg.norm(d) or 1.0
                x = sample[rows] @ d
                t = float(np.median(x))
                if (x > t).any() and (best is None or x.std() > best[0]):
                    best = (x.std(), d, t, x > t)
        if best is None:
            number, leaves = ~leaves, leaves + 1
        else:
            number = len(nodes)
            nodes.append((best[1], best[2]))
            children.append([0, 0])
            stack += [(rows[~best[3]], number, 0), (rows[best[3]], number, 1)]
        if parent >= 0:
            children[parent][side] = number
    dim = sample.shape[1]
    return Tree(np.array([n[0] for n in nodes]).reshape(-1, dim), np.array([n[1] for n in nodes]), np.array(children, np.int64).reshape(-1, 2), leaves)


def drop(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    at = np.zeros(len(x), np.int64) if len(tree.directions) else np.full(len(x), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        right = np.einsum("ij,ij->i", x[inner], tree.directions[node]) > tree.thresholds[node]
        at[inner] = tree.children[node, right.astype(np.int64)]
    return ~at


def search(trees: list[Tree], counts: list[np.ndarray], q: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order opened, over all trees at once, until the leaves hold `wanted` vectors of one tree's count each."""
    offsets = [t.directions @ q - t.thresholds if len(t.directions) else np.zeros(0) for t in trees]
    heap = [(0.0, i, 0 if len(t.directions) else -1) for i, t in enumerate(trees)]
    taken, out = 0, []
    while heap and taken < wanted:
        far, i, node = heapq.heappop(heap)
        while node >= 0:  # down the near side; the far side waits with its squared distance
            m = float(offsets[i][node])
            near, other = trees[i].children[node, int(m > 0)], trees[i].children[node, int(m <= 0)]
            heapq.heappush(heap, (far + m * m, i, int(other)))
            node = int(near)
        if counts[i][~node]:
            taken += int(counts[i][~node])
            out.append((i, ~node))
    return out


def budget(trees: list[Tree], counts: list[np.ndarray], probes: np.ndarray, nearest: list[np.ndarray], recall: float) -> int:
    """The least `wanted` of a search that finds that share of the probes' neighbours; nearest: for each probe its neighbours' leaves, one column a tree."""
    needs = []
    for q, leaves in zip(probes, nearest, strict=True):
        before, taken = [np.full(t.leaves, 1 << 62) for t in trees], 0
        for i, j in search(trees, counts, q, 1 << 62):
            before[i][j] = taken
            taken += int(counts[i][j])
        needs += np.min([b[leaves[:, i]] for i, b in enumerate(before)], axis=0).tolist()
    return sorted(needs)[max(0, int(np.ceil(recall * len(needs))) - 1)] + 1 if needs else 0


def scaled(x: np.ndarray, largest: float) -> np.ndarray:
    """Unit vectors whose nearest by distance is the largest by inner product: one component more fills up the norm."""
    y = x / largest
    return np.hstack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))[:, None]])


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score): each query's k best of a block, its own id left out.

    A matrix product finds the shortlist; the scores are sums of row products, alike for equal vectors.
    """
    out = []
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ vectors.T
        for j, row in enumerate(rough):
            row[ids == query_ids[at + j]] = -np.inf
            cut = np.partition(row, -k)[-k] if len(row) > k else row.min()
            few = np.flatnonzero((row >= (cut if np.isfinite(cut) else row.min()) - 1e-9 * (1 + abs(cut) if np.isfinite(cut) else 1)) & np.isfinite(row))
            score = (vectors[few] * queries[at + j]).sum(1)
            few = few[order := np.lexsort((ids[few], -score))][:k]
            out.append((np.full(len(few), at + j), ids[few], score[order][:k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, *, key: str = "vec_id", vector: str = "embedding", trees: int = 4, leaf: int = 1500, candidates: int = 60_000, recall: float = 0.97, probes: int = 64, sample: int = 60_000, block: int = 2_000, seed: int = 17) -> DataFrame:
    """(query_id, rank, key, score): each query's k nearest found by inner product, in double precision.

    Ties go to the smaller key; a query's own key is no neighbour. Vectors that are
    null, zero or hold null or non-finite components, or are not of the commonest
    length (ties: the greater), take no part, nor do rows with a null key. Of equal
    vectors only the k + 1 smallest keys can be among the k nearest; the rest are put
    aside before the search, so a hot vector costs no more than k + 1. `sample` bounds the rows that
    trees grow on (by a hash of the key), and so their size; all vectors are indexed.
    The search is as deep as `probes` queries (by a hash of the key) need for `recall` against
    brute force; on vectors without structure that is a large share of the table at any size.
    """
    spark = vectors.sparkSession
    good = lambda df: df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    every, asked = good(vectors), good(queries)
    size = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    empty = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    if not size:
        return empty
    every, asked = (df.where(F.size("v") == size[0]["n"]) for df in (every, asked))
    nth = F.row_number().over(W.partitionBy("v").orderBy("id"))
    kept = stage(every.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).drop("_nth"), "vectors")
    facts = kept.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("largest")).first()
    drawn = kept.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(sample / max(facts["n"], 1) * (1 << 30))).select("v").toPandas()
    if not len(drawn):
        drawn = kept.limit(1).select("v").toPandas()
    largest = float(facts["largest"])
    grown = scaled(np.vstack(drawn["v"]), largest)
    forest = [grow(grown, max(1, int(leaf * len(grown) / facts["n"])), seed + i) for i in range(trees)]
    shared = spark.sparkContext.broadcast((forest, largest))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def place(batches):
        forest, largest = shared.value
        for batch in batches:
            x = scaled(matrix(batch.column(1)), largest)
            for i, tree in enumerate(forest):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(drop(tree, x).astype(np.int32)), batch.column(0), batch.column(1)], ["tree", "leaf", "id", "v"])

    placed = stage(kept.mapInArrow(place, "tree int, leaf int, id long, v array<double>"), "leaves")
    counts = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in placed.groupBy("tree", "leaf").count().toLocalIterator():  # as many rows as the forest has leaves
        counts[r["tree"]][r["leaf"]] = r["count"]
    chosen = asked.distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(probes).collect()
    probe_ids = np.array([r["id"] for r in chosen], np.int64)
    probe_vectors = np.array([r["v"] for r in chosen], np.float64).reshape(len(chosen), -1)

    def nearest(batches):
        forest, largest = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, probe_vectors.shape[1])))] * len(probe_ids)
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            for n, score in enumerate(probe_vectors @ x.T):
                other = np.flatnonzero((ids != probe_ids[n]) & (len(best[n][0]) < k or score >= best[n][0][-1]))
                if len(other):
                    s, i, v = np.append(best[n][0], score[other]), np.append(best[n][1], ids[other]), np.vstack((best[n][2], x[other]))
                    top = np.lexsort((i, -s))[:k]
                    best[n] = s[top], i[top], v[top]
        for n, (score, ids, v) in enumerate(best):
            if len(ids):
                at = np.stack([drop(tree, scaled(v, largest)) for tree in forest], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), n, np.int32)), pa.array(ids), pa.array(score), pa.array(list(at), pa.list_(pa.int64()))], ["probe", "id", "score", "at"])

    if chosen:
        nth = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "id"))
        true = kept.mapInArrow(nearest, "probe int, id long, score double, at array<long>").withColumn("_nth", nth).where(F.col("_nth") <= k).select("probe", "at").collect()
        units = np.hstack((probe_vectors / np.linalg.norm(probe_vectors, axis=1)[:, None], np.zeros((len(chosen), 1))))
        leaves = [np.array([r["at"] for r in true if r["probe"] == n], np.int64).reshape(-1, trees) for n in range(len(chosen))]
        candidates = max(candidates, budget(forest, counts, units, leaves, recall))
    told = spark.sparkContext.broadcast([np.maximum(1, -(-c // block)) for c in counts])
    counted = spark.sparkContext.broadcast(counts)

    def choose(batches):
        (forest, largest), counts, blocks = shared.value, counted.value, told.value
        for batch in batches:
            for n, (number, q) in enumerate(zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True)):
                unit = np.append(q / (np.linalg.norm(q) or 1.0), 0.0)
                leaves = search(forest, counts, unit, candidates)
                rows = [(i, j, b) for i, j in leaves for b in range(int(blocks[i][j]))]
                if rows:
                    t, j, b = map(np.array, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.full(len(rows), number)), batch.column(1).take(pa.array(np.full(len(rows), n)))], ["tree", "leaf", "block", "id", "v"])

    def block_of(batches):
        blocks = told.value
        for batch in batches:
            t, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            most = np.array([blocks[a][b] for a, b in zip(t, j, strict=True)], np.int64)
            mixed = (batch.column(2).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((mixed.astype(np.int64) % most).astype(np.int32)), batch.column(2), batch.column(3)], ["tree", "leaf", "block", "id", "v"])

    kind = "tree int, leaf int, block int, id long, v array<double>"
    cells = placed.mapInArrow(block_of, kind).groupBy("tree", "leaf", "block")
    wanted = asked.distinct().repartition(F.col("id")).mapInArrow(choose, kind).groupBy("tree", "leaf", "block")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        place, ids, score = best_in_block(np.vstack(right["v"]), right["id"].to_numpy(), np.vstack(left["v"]), left["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": right["id"].to_numpy()[place], "id": ids, "score": score})

    found = cells.cogroup(wanted).applyInPandas(rank, "query_id long, id long, score double")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    merged = found.distinct().withColumn("rank", order).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", F.col("id").alias(key), "score")
