"""Connected components of a link table, by alternating stars.

Each round hangs every node's larger neighbours on its smallest one, then its
smaller ones; rounds end when all links are stars. Rounds are written to the shared
folder, so a lost executor costs one round. Minima are taken by aggregation
(combined before the shuffle) and joined back, so a hub is never one task's group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


#: How many links a task takes: late rounds of few links need few tasks, whatever the number of shuffle partitions.
TASK_LINKS = 50_000


def _stars(pairs: DataFrame, tasks: int) -> bool:
    """Whether every node hangs on one other (u on v) that hangs on none."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(None).cast("int").alias("up")))
    found = ends.groupBy("node").agg(F.count("up").alias("up"), F.count("*").alias("all")).coalesce(tasks)
    return not found.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("all") > F.col("up"))))).first()[0]


def _hung(pairs: DataFrame, tasks: int) -> DataFrame:
    """For (node, peer) pairs: every node of a neighbourhood beside the neighbourhood's smallest node."""
    least = pairs.groupBy("node").agg(F.min("peer").alias("least")).select(F.col("node").alias("hub"), F.least("node", "least").alias("least"))
    return pairs.join(least, F.col("node") == F.col("hub")).coalesce(tasks)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link to another.

    Nulls and self-links say nothing and are skipped; repeated links count once.
    The result is staged. An empty table gives an empty one.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = stage(pairs, "links")
    while True:
        tasks = 8 + pairs.count() // TASK_LINKS
        if _stars(pairs, tasks):
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = pairs.select(F.col("u").alias("node"), F.col("v").alias("peer")).unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("peer")))
        large = _hung(both, tasks).where(F.col("peer") > F.col("node")).select(F.col("peer").alias("node"), F.col("least").alias("peer")).where("node > peer").distinct().coalesce(tasks)
        hung = _hung(large, tasks)
        small = hung.select(F.col("peer").alias("u"), F.col("least").alias("v")).unionByName(hung.select(F.col("node").alias("u"), F.col("least").alias("v"))).where("u > v").distinct()
        pairs = stage(small.coalesce(tasks), "links")
