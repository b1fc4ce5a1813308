"""Exact quantiles, ranks and AUC from distinct-value counts.

The built-in exact percentile keeps every distinct value of a group in one task. Here the values are
counted first and the cumulative counts come from an ordered scan, which splits large groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtape.operators.ordered import ordered, prior_sum, scan
from playtape.session import cut_lineage


def value_counts_before(df: DataFrame, by: Sequence[str], value: str, hot_rows: int | None = None) -> DataFrame:
    """(by, value, n, before): how many rows carry the value and how many lie strictly below it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)  # read several times below
    o = ordered(counts, by, [value], hot_rows)
    return scan(o, before=prior_sum(F.col("n"), F.lit(0).cast("bigint"))).result()


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one named column each."""
    keys = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    placed = value_counts_before(source.select(*keys, value), keys, value, hot_rows)
    if by:
        placed = placed.join(placed.groupBy(*keys).agg(F.sum("n").alias("_total")), keys)
    else:
        placed = placed.withColumn("_total", placed.agg(F.sum("n").alias("t")).scalar())
    upto = F.col("before") + F.col("n")
    picks = []
    for p, name in zip(probs, names):
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        picks.append(F.min(F.when(upto > F.floor(spot), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(upto > F.ceil(spot), F.col(value))).alias(f"_hi_{name}"))
    found = placed.groupBy(*keys, "_total").agg(*picks)
    out = [
        (
            F.col(f"_lo_{name}")
            + (F.lit(float(p)) * (F.col("_total") - 1) - F.floor(F.lit(float(p)) * (F.col("_total") - 1)))
            * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
        ).alias(name)
        for p, name in zip(probs, names)
    ]
    return found.select(*by, *out)


def describe(
    df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, min, the asked quantiles and max; per group when ``by`` is given."""
    base = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    quantiles = exact_quantiles(df, value, probs, names, by, hot_rows)
    if by:
        return base.join(quantiles, list(by), "left")
    both = base.unionByName(quantiles, allowMissingColumns=True)  # two single rows
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def rank_auc(df: DataFrame, score: str, label: str, hot_rows: int | None = None) -> DataFrame:
    """Area under the ROC curve by mid-ranks of tied scores."""
    counts = (
        df.groupBy(F.lit(0).alias("_all"), score)
        .agg(F.sum(F.col(label)).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    )
    counts = cut_lineage(counts)
    o = scan(ordered(counts, ["_all"], [score], hot_rows), below=prior_sum(F.col("neg"), F.lit(0.0)))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return o.result().agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))
