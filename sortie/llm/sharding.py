"""Shards of nearly equal bytes by sampled splitters and range partitioning.

The key of a row is (hash of its text, id), so equal texts lie side by side. Keys are
drawn with a chance that grows with the row's bytes; their quantiles split the keys
into many ranges. Exact sizes of the ranges follow from one aggregation; ranges over
twice their fair share are drawn from again and subdivided, down to the ids of one text.
Whole ranges, in key order, then fill the shards by their exact running sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stage

#: A row's key as the driver and the tasks hold it.
KEY = np.dtype([("hash", "<i8"), ("id", "<i8")])


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _draws(rows: DataFrame, per_range: float, share: float, seed: int) -> np.ndarray:
    """Sorted keys drawn with chance size / share x per_range, by a hash of the key; at most a key per row."""
    scale = float(1 << 40)
    drawn = F.pmod(F.xxhash64("_hash", "_id", F.lit(seed)), F.lit(1 << 40)) < F.least(F.lit(1.0), F.col("_size") * (per_range / share)) * scale
    got = rows.where(drawn).select("_hash", "_id").distinct().toPandas()
    keys = np.empty(len(got), KEY)
    keys["hash"], keys["id"] = got["_hash"].to_numpy("int64"), got["_id"].to_numpy("int64")
    return keys[np.lexsort((keys["id"], keys["hash"]))]


def splits(keys: np.ndarray, at: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """From the sorted keys of each range (`at`: each key's range, rising), those that cut it into its `parts`."""
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    sizes = np.diff(np.append(begins, len(at)))
    parts = np.maximum(parts, 2)
    nth = np.arange((parts - 1).sum()) - np.repeat(np.cumsum(parts - 1) - (parts - 1), parts - 1) + 1
    return np.unique(keys[np.repeat(begins, parts - 1) + np.repeat(sizes, parts - 1) * nth // np.repeat(parts, parts - 1)])


def _ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds `_range`: how many splitters are at most the row's key."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    @F.arrow_udf("int")
    def place(hashes: pa.Array, ids: pa.Array) -> pa.Array:
        keys = np.empty(len(hashes), KEY)
        keys["hash"], keys["id"] = hashes.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        cuts = shared.value
        low = np.searchsorted(cuts["hash"], keys["hash"], "left")
        high = np.searchsorted(cuts["hash"], keys["hash"], "right")
        mixed = high > low  # splitters inside one text's rows: by id too
        low[mixed] = np.searchsorted(cuts, keys[mixed], "right")
        return pa.array(low.astype(np.int32))

    return rows.withColumn("_range", place(F.col("_hash"), F.col("_id")))


def assign(docs: DataFrame, shards: int = 8, *, key: str = "doc_id", text: str = "text", ranges_per_shard: int = 48, range_bytes: int = 256 << 20, draws_per_range: int = 24, rounds: int = 6) -> DataFrame:
    """(key, size, text_crc32, shard, slot): shards of nearly equal bytes, slots gapless from 0 in key order.

    Ranges number ranges_per_shard a shard, or as many as keep each under range_bytes;
    the driver holds their splitters and draws (16 bytes each) and sizes, no rows.
    Rows of one id and one text can't be told apart and stay in one range. A null id
    sorts as the smallest; a null text counts as empty.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63) + 1)).alias("_id"), text_size(F.col(text)).alias("_size"), F.crc32(value).alias("_crc"), F.xxhash64(value).alias("_hash"))
    rows = stage(slim, "sizes")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    wanted = max(shards * ranges_per_shard, -(-total // range_bytes))
    share = max(total / wanted, 1.0)
    drawn = _draws(rows, draws_per_range, share, 1)
    splitters = np.unique(drawn[draws_per_range // 2 :: draws_per_range])
    for again in range(rounds):
        ranged = _ranged(rows, splitters)
        sizes = {r["_range"]: r["size"] for r in ranged.groupBy("_range").agg(F.sum("_size").alias("size"), F.min(F.struct("_hash", "_id")).alias("low"), F.max(F.struct("_hash", "_id")).alias("high")).where("low < high").select("_range", "size").toLocalIterator()}
        over = sorted(r for r, size in sizes.items() if size > 2 * share)
        if not over:
            break
        full = ranged.where(F.col("_range").isin(over)) if len(over) < 1000 else ranged.join(rows.sparkSession.createDataFrame([(r,) for r in over], "_range int"), "_range")
        keys = _draws(full, draws_per_range * (again + 1), share, again + 2)
        at = np.searchsorted(splitters, keys, "right")
        parts = np.ceil([sizes.get(int(r), 0) / share for r in np.unique(at)]).astype(np.int64)
        more = np.union1d(splitters, splits(keys, at, parts))
        if len(more) == len(splitters):
            break
        splitters = more
    ranged = stage(_ranged(rows, splitters), "ranges")
    stats = sorted((r["_range"], r["size"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).toLocalIterator())
    plan, done, counts = [], 0, [0] * shards
    for r, size, n in stats:
        shard = min(shards - 1, int((done + size / 2) * shards / max(total, 1)))
        plan.append((r, shard, counts[shard]))
        counts[shard] += n
        done += size
    places = docs.sparkSession.createDataFrame(plan or [(-1, 0, 0)], "_at int, shard int, _first long")
    nth = F.row_number().over(W.partitionBy("_range").orderBy("_hash", "_id", "_size")).cast("long")
    out = ranged.withColumn("_nth", nth - 1).join(places, F.col("_range") == F.col("_at"))
    return out.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_first") + F.col("_nth")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 8, *, key: str = "doc_id", **options) -> None:
    """Writes whole rows as Parquet, a folder per shard; the key must be unique and not null."""
    placed = assign(docs, shards, key=key, **options).select(F.col(key).alias("_of"), F.col("shard").alias("_shard"))
    docs.join(placed, F.col(key) == F.col("_of")).drop("_of").write.partitionBy("_shard").parquet(path)
