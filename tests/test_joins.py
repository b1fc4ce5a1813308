import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from playtape.operators import asof, dedupe


@pytest.fixture()
def sides(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"g": np.where(rng.random(1500) < 0.5, 1, rng.integers(0, 20, 1500)), "t": rng.integers(0, 5000, 1500), "l": np.arange(1500)})
    right = pd.DataFrame({"g": np.where(rng.random(900) < 0.5, 1, rng.integers(0, 20, 900)), "r": rng.integers(0, 5000, 900), "px": np.arange(900)})
    right = right.drop_duplicates(["g", "r"])
    return left, right, spark.createDataFrame(left), spark.createDataFrame(right)


@pytest.mark.parametrize("hot", [None, 60])
def test_backward_matches_merge_asof(sides, hot):
    left, right, sl, sr = sides
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("r"), left_on="t", right_on="r", by="g").sort_values("l")
    got = asof.asof_backward(sl, sr, ["g"], "t", "r", ["px"], hot_rows=hot).toPandas().sort_values("l")
    np.testing.assert_array_equal(got["px"].fillna(-1).to_numpy(), want["px"].fillna(-1).to_numpy())


@pytest.mark.parametrize("hot", [None, 60])
def test_forward_within_window(sides, hot):
    left, right, sl, sr = sides
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("r"), left_on="t", right_on="r", by="g", direction="forward", tolerance=25).sort_values("l")
    got = asof.asof_forward(sl, sr, ["g"], "t", "r", ["px"], 25, hot_rows=hot).toPandas().sort_values("l")
    np.testing.assert_array_equal(got["px"].fillna(-1).to_numpy(), want["px"].fillna(-1).to_numpy())
    np.testing.assert_array_equal(got["fill_delay"].fillna(-1).to_numpy(), (want["r"] - want["t"]).fillna(-1).to_numpy())


def test_own_date_beats_the_neighbour(spark):
    d = datetime.date
    games = spark.createDataFrame([(d(2024, 1, 1), "A", "g1"), (d(2024, 1, 2), "A", "g2")], "day date, pair string, game string")
    tape = spark.createDataFrame([(d(2024, 1, 1), "A"), (d(2024, 1, 2), "A"), (d(2024, 1, 3), "A"), (d(2024, 1, 5), "A")], "day date, pair string")
    matched, unmatched = asof.join_nearby_day(tape, games, "day", ["pair"], "game")
    assert {r.day.day: r.game for r in matched.collect()} == {1: "g1", 2: "g2", 3: "g2"}
    assert [r.day.day for r in unmatched.collect()] == [5]


def test_version_is_clamped_to_the_first(spark):
    d = datetime.date
    rows = spark.createDataFrame([(d(2024, 1, 1),), (d(2024, 1, 9),), (d(2024, 1, 20),)], "day date")
    versions = spark.createDataFrame([(d(2024, 1, 5),), (d(2024, 1, 12),)], "v date")
    got = {r.day.day: r.version.day for r in asof.asof_version(rows, "day", versions, "v", "version").collect()}
    assert got == {1: 5, 9: 5, 20: 12}


def test_match_within_takes_null_start(spark):
    t = datetime.datetime
    games = spark.createDataFrame([("g", "A", t(2024, 1, 1, 20))], "id string, k string, start timestamp")
    events = spark.createDataFrame([(0, "A", t(2024, 1, 1, 10)), (1, "A", None), (2, "A", t(2024, 1, 1, 20))], "pos int, k string, es timestamp")
    assert asof.match_within(games, events, ["k"], "id", "start", "es", ["pos"], 5400).first().pos == 1


def test_keep_first_reduces_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    out = dedupe.keep_first(df, ["k"], ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and {r.id for r in out.collect()} == {0, 1, 2}


def test_upsert_priority_and_tiers(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert {r.k: r.v for r in dedupe.upsert_latest(old, new, ["k"]).collect()} == {1: "old", 2: "new", 3: "new"}
    assert {r.k: r.v for r in dedupe.priority_union([old, new], ["k"]).collect()} == {1: "old", 2: "old", 3: "new"}
    assert dedupe.overlap_count([old, new], ["k"]).first().overlap == 1
    many = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert dedupe.first_nonempty_tier([many, old], ["k"]).count() == 3
