"""Deterministic keep-first / keep-last, top-k and upsert.

``row_number() = 1`` behind a filter is planned with a map-side group limit, so a hot key sends at most
one row per map task into the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Orders = Sequence[str | Column]


def keep_first(df: DataFrame, key: Sequence[str], order: Orders) -> DataFrame:
    """One row per key: the first under a total order."""
    return top_k(df, key, order, 1)


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top_k(df, key, [F.col(c).desc() for c in order], 1)


def top_k(df: DataFrame, key: Sequence[str], order: Orders, k: int) -> DataFrame:
    """The first k rows per key under a total order."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k).drop("_n")


def worst_n(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The n smallest values of a report column."""
    return df.orderBy(F.col(value), F.col(tie)).limit(n)


def upsert_latest(old: DataFrame, new: DataFrame, key: Sequence[str], order: Orders = ()) -> DataFrame:
    """Union of an existing output and fresh rows; the fresh row wins its key."""
    both = old.withColumn("_fresh", F.lit(0)).unionByName(new.withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, key, [F.col("_fresh").desc(), *order]).drop("_fresh")


def priority_union(sources: Sequence[DataFrame], key: Sequence[str], order: Orders = ()) -> DataFrame:
    """Union of sources from best to worst; the best source holding a key keeps it."""
    ranked = None
    for rank, source in enumerate(sources):
        tagged = source.withColumn("_rank", F.lit(rank))
        ranked = tagged if ranked is None else ranked.unionByName(tagged, allowMissingColumns=True)
    return keep_first(ranked, key, ["_rank", *order]).drop("_rank")


def overlap_count(sources: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """How many rows a priority union gives up because a better source holds the key."""
    keys = None
    for source in sources:
        part = source.select(*key)
        keys = part if keys is None else keys.unionByName(part)
    return keys.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("overlap")
    )


def first_nonempty_tier(tiers: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """All rows of the first tier that has any row for a key."""
    tagged = None
    for rank, tier in enumerate(tiers):
        part = tier.withColumn("_tier", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    winner = tagged.groupBy(*key).agg(F.min("_tier").alias("_tier"))
    return tagged.join(winner, [*key, "_tier"], "left_semi").drop("_tier")
