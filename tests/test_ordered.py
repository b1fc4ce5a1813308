"""The split route of the ordered scans gives what the plain window gives, whatever the skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from playtape.operators import ordered as o
from playtape.operators.quantiles import describe, exact_quantiles, rank_auc


def _table(spark, seed, ties):
    rng = np.random.default_rng(seed)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 40, n))
    at = rng.integers(0, 12 if ties else 100_000, n)
    pdf = pd.DataFrame({"key": key, "at": at, "id": rng.permutation(n), "v": rng.integers(-50, 50, n).astype(float)})
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v")))


def _scanned(df, hot_rows):
    x = o.ordered(df, ["key"], ["at", "id"], hot_rows)
    x = o.scan(
        x, s=o.running_sum(F.col("v")), p=o.prior_sum(F.col("v"), F.lit(0.0)), m=o.running_max(F.col("v")),
        f=o.ffill(F.col("v")), b=o.bfill(F.col("v")), g=o.lag(F.col("v"), F.lit(-1.0)), n=o.row_number(), c=o.prior_count(),
    )
    x = o.run_id(x.with_columns({"sign": F.col("v") > 0}), ["sign"])
    return x, x.result().toPandas().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("seed,ties", [(1, False), (2, True)])
def test_split_equals_plain(spark, seed, ties):
    df = _table(spark, seed, ties)
    plain, want = _scanned(df, 10_000)
    split, got = _scanned(df, 100)
    assert not plain.split and split.split
    pd.testing.assert_frame_equal(want, got[want.columns])


def test_split_pieces_stay_small(spark):
    df = spark.range(20_000).select(F.lit(1).alias("key"), F.lit(5).alias("at"), F.col("id"))
    x = o.ordered(df, ["key"], ["at", "id"], 1000)
    largest = x.df.groupBy(o.PIECE).count().agg(F.max("count")).first()[0]
    assert x.split and largest < 5000, "one instant holding every row must be divided too"


def test_null_keys_and_orders(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), (1, None, 4.0), (1, 5, 5.0)], "key int, at int, v double")
    for hot in (100, 1):
        out = o.scan(o.ordered(df, ["key"], ["at"], hot), s=o.running_sum(F.col("v"))).result()
        assert {(r.key, r.at): r.s for r in out.collect()} == {(None, 1): 2.0, (None, 2): 5.0, (1, None): 4.0, (1, 5): 9.0}


def test_bound_skips_the_measurement(spark):
    x = o.ordered(spark.range(10).withColumn("k", F.lit(1)), ["k"], ["id"], at_most=10)
    assert x.largest == 10 and not x.split


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "v": np.round(rng.normal(size=2000), 2)})
    df = spark.createDataFrame(pdf)
    for hot in (None, 50):
        got = exact_quantiles(df, "v", [0.05, 0.5, 0.9], ["a", "b", "c"], ["g"], hot).toPandas().set_index("g").sort_index()
        want = pdf.groupby("g")["v"].quantile([0.05, 0.5, 0.9]).unstack()
        np.testing.assert_allclose(got.to_numpy(), want.to_numpy())
    row = describe(df, "v", [0.5], ["p50"], hot_rows=50).first()
    assert row.n == 2000 and abs(row.sd - pdf.v.std()) < 1e-9


def test_auc_with_ties(spark):
    pdf = pd.DataFrame({"p": [0.1, 0.4, 0.4, 0.8, 0.8, 0.9], "y": [0, 0, 1, 0, 1, 1]})
    pos, neg = pdf[pdf.y == 1].p.to_numpy(), pdf[pdf.y == 0].p.to_numpy()
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(rank_auc(spark.createDataFrame(pdf), "p", "y").first().auc - want) < 1e-12


@pytest.mark.parametrize("order", [["name", "id"], ["day", "name", "id"], ["name"]])
def test_text_orders_are_cut_like_numbers(spark, order):
    rng = np.random.default_rng(4)
    n = 1500
    pdf = pd.DataFrame({"key": np.where(rng.random(n) < 0.6, 7, rng.integers(0, 9, n)), "day": rng.integers(0, 3, n), "id": rng.permutation(n)})
    df = spark.createDataFrame(pdf).withColumns({
        "name": F.when(F.col("id") % 11 != 0, F.concat(F.lit("same head "), (F.col("id") % 40 if len(order) > 1 else F.col("id")).cast("string"))),
        "v": (F.col("id") % 13).cast("double")})
    if order == ["name"]:
        df = df.where("name IS NOT NULL")

    def scanned(hot_rows):
        x = o.ordered(df, ["key"], order, hot_rows)
        x = o.scan(x, s=o.running_sum(F.col("v")), g=o.lag(F.col("v")), n=o.row_number(), f=o.ffill(F.when(F.col("v") > 9, F.col("v"))))
        return x.split, x.result().toPandas().sort_values("id").reset_index(drop=True)

    (plain, want), (split, got) = scanned(1_000_000), scanned(50)
    assert not plain and split
    pd.testing.assert_frame_equal(want, got[want.columns])
