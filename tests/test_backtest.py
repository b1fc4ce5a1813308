import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from playtape.plans import backtest as bt
from playtape.plans import reports, tape
from playtape.plans.rates import prior_totals


def _book(spark, n=900):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({
        "season": rng.integers(2022, 2024, n), "grid_unix": rng.integers(0, 400, n), "leg": rng.integers(0, 2, n),
        "play_number": np.arange(n), "edge": np.round(rng.gamma(2, 0.02, n) + 0.02, 4),
    })
    pdf["game_id"] = (pdf["play_number"] % 37).astype(str)
    return pdf, spark.createDataFrame(pdf)


def _expected(pdf, warmup):
    out = {}
    for _, g in pdf.sort_values(["grid_unix", "leg", "game_id", "play_number"]).groupby("season"):
        edges, mults = [], []
        for r in g.itertuples():
            mean, sd = (np.mean(edges), np.std(edges)) if edges else (0.0, 0.0)
            live = len(edges) >= warmup and sd > 1e-12
            mult = float(np.clip(1 + (r.edge - mean) / sd, 0.2, 3.0)) if live else 1.0
            norm = np.mean(mults) if mults else 1.0
            out[r.play_number] = max(1.0, np.rint(100 * mult / norm))
            edges.append(r.edge)
            mults.append(mult)
    return out


@pytest.mark.parametrize("hot", [None, 80])
def test_expanding_size_matches_a_plain_walk(spark, hot):
    pdf, df = _book(spark)
    got = {r.play_number: r.contracts for r in bt.size_expanding(df, warmup=50, hot_rows=hot).collect()}
    assert got == _expected(pdf, 50)


def test_sizing_never_looks_ahead(spark):
    _, df = _book(spark)
    cut = df.where("grid_unix < 200")
    early = {r.play_number: r.contracts for r in bt.size_expanding(cut, warmup=20).collect()}
    full = {r.play_number: r.contracts for r in bt.size_expanding(df, warmup=20).where("grid_unix < 200").collect()}
    assert early == full


def test_prior_totals_ignore_the_row_and_its_future(spark):
    rows = [("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 11.0), ("b", 1, 1.0)]
    base = prior_totals(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], ["t"], ["v"])
    changed = prior_totals(spark.createDataFrame(rows[:2] + [("a", 3, 99.0), rows[3]], "k string, t int, v double"), ["k"], ["t"], ["v"])
    got = {(r.k, r.t): (r.prior_v, r.prior_gp) for r in base.collect()}
    assert got == {("a", 1): (0.0, 0), ("a", 2): (5.0, 1), ("a", 3): (12.0, 2), ("b", 1): (0.0, 0)}
    assert got == {(r.k, r.t): (r.prior_v, r.prior_gp) for r in changed.collect()}


def test_whole_book_pins_the_mean(spark):
    _, df = _book(spark)
    sized = bt.size_whole_book(df, target=100)
    assert abs(sized.agg(F.avg("contracts")).first()[0] - 100) < 0.5
    assert bt.size_whole_book(df, slope=0.0).select("contracts").distinct().collect()[0][0] == 100.0


def test_settle_and_fee(spark):
    df = spark.createDataFrame([(10.0, 40.0, 1), (10.0, 40.0, 0)], "contracts double, price double, won int")
    win, loss = bt.settle(df).orderBy(F.col("won").desc()).collect()
    assert (win.fee, win.staked) == (0.17, 4.0) and abs(win.pnl - 5.83) < 1e-12 and abs(loss.pnl + 4.17) < 1e-12


def test_taker_price_of_both_sides(spark):
    rows = [(60.0, 1, "yes"), (60.0, 1, "no"), (60.0, 0, "yes"), (60.0, 0, "no"), (60.0, 1, None)]
    df = spark.createDataFrame(rows, "yes_price_cents double, is_home_yes int, taker_side string").withColumn("home_yes_price_cents", F.lit(60.0))
    got = {(r.is_home_yes, r.taker_side): (r.px_home, r.px_away) for r in tape.price_sides(df).collect()}
    assert got == {(1, "yes"): (60.0, 41.0), (1, "no"): (61.0, 40.0), (0, "yes"): (41.0, 60.0), (0, "no"): (40.0, 61.0), (1, None): (61.0, 40.0)}
    with pytest.raises(ValueError):
        tape.price_sides(df, mode="guess")


def test_backtest_end_to_end(spark):
    at = datetime.datetime(2024, 1, 1, 20, 0, 0)
    day = datetime.date(2024, 1, 1)
    def state(n, seconds, p, margin):
        return ("g", n, at + datetime.timedelta(seconds=seconds), p, 100.0, 90.0, 2024, 1, day, "BOS", "DEN", margin, 0.4, 600.0)
    schema = ("game_id string, play_number int, wallclock timestamp, p_home double, home_final double, away_final double, season int, period int, "
              "game_date date, home_team string, away_team string, score_margin int, logit_close double, pc_seconds_left double")
    scored = spark.createDataFrame([state(1, 0, 0.9, 3), state(2, 0, 0.5, 4), state(3, 100, 0.9, -3), state(4, 300, 0.9, 0)], schema)
    unix = int(at.replace(tzinfo=datetime.timezone.utc).timestamp())
    prints = spark.createDataFrame([("g", unix + 9, 10.0, 91.0, 1.0), ("g", unix + 12, 45.0, 56.0, 1.0), ("g", unix + 110, 60.0, 41.0, 1.0), ("g", unix + 316, 50.0, 51.0, 1.0)],
                                   "game_id string, ts bigint, px_home double, px_away double, count_fp double")
    rows = bt.backtest(scored, prints).collect()
    assert [(r.play_number, r.side, r.fill_delay, r.price) for r in sorted(rows, key=lambda r: r.play_number)] == [
        (2, "home", 2, 45.0), (3, "home", 0, 60.0)]
    third = next(r for r in rows if r.play_number == 3)
    assert (third.margin_bucket, third.role, third.quarter, third.month, third.price_bucket) == ("trail 1-4", "home fav", "Q1", "2024-01", "60-69")
    view = reports.summarise_by(bt.backtest(scored, prints), "role")
    assert {r.bucket: r.bets for r in view.collect()} == {"home fav": 2, "TOTAL": 2}
