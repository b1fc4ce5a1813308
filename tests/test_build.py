"""The two-pass build on the play view: parameters are sane, scores are probabilities, features obey the clock."""

from pyspark.sql import functions as F

from playtape.plans import build
from playtape.session import cut_lineage
from playtape.workloads import base

FOLDER = "/root/testdata/sf0.001"


def test_build_all(spark):
    pbp = cut_lineage(base.plays(spark, FOLDER).withColumn("wallclock", F.col("ts").cast("string")))
    codes = pbp.select("home_team").distinct()
    odds = base.odds(spark, FOLDER)
    table, model, known = build.build_all(
        pbp, pbp, odds, base.rates(spark, FOLDER), base.rosters(spark, FOLDER), teams=codes,
        predictors=["exp_margin_full", "frac_left"], min_cell=20, min_states=100, surface_min=2, min_games=3,
        names=["score_margin", "frac_left", "sim_wp", "sim_logit"], seeds=(17,), depth=2, rounds=2, tail_cuts=(0.1,), eval_frac=0.4)
    assert 0 < known.fg2_pct < 1 and abs(sum(known.points_distribution) - 1) < 1e-9 and known.edge_coefs.keys() == {"exp_margin_full", "frac_left"}
    scored = build.score(model, table)
    low, high, n = scored.agg(F.min("p_home"), F.max("p_home"), F.count("p_home")).first()
    assert 0 < low <= high < 1 and n == table.count() > 500
    assert table.where("frac_left < 0 or frac_left > 1 or abs(sim_adv) > 0.3").count() == 0
    assert 0 < model.report["eval_logloss"] < 5
