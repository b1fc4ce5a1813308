import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from playtape.plans import build, features, fits, priors, rates


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(2)
    n = 1200
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2]
    y = 2 + x @ [1.0, -0.5, 3.0] + rng.normal(size=n)
    w = rng.uniform(0.5, 2, n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, w=w, game=np.arange(n) % 60)
    return pdf, spark.createDataFrame(pdf)


def _plain(pdf, alpha):
    x = pdf[["a", "b", "c"]].to_numpy()
    mu, sd = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(x)), (x - mu) / sd])
    w = pdf.w.to_numpy()
    pen = alpha * np.diag([0.0, 1, 1, 1])
    bz = np.linalg.solve(z.T @ (z * w[:, None]) + pen, z.T @ (w * pdf.y.to_numpy()))
    b = bz[1:] / sd
    return np.r_[bz[0] - b @ mu, b]


@pytest.mark.parametrize("alpha", [0.0, 150.0])
def test_ridge_matches_numpy(design, alpha):
    pdf, df = design
    got = {r.term: r.coef for r in fits.wls_ridge(df, "y", ["a", "b", "c"], "w", alpha).collect()}
    np.testing.assert_allclose([got[t] for t in ("intercept", "a", "b", "c")], _plain(pdf, alpha), rtol=1e-8)


def test_alpha_is_chosen_on_the_holdout(spark, design):
    _, df = design
    held = df.withColumn("held", F.col("game") % 5 == 0)
    out = fits.select_alpha(held, "y", ["a", "b", "c"], "w", "held", [0.0, 1e7])
    assert out["alpha"] == 0.0 and out["r2_holdout"] > 0.5 > out["scores"][1e7]
    pred = held.where("held").withColumn("pred", fits.linear_score(out["holdout_beta"], ["a", "b", "c"]))
    assert abs(fits.weighted_r2(pred, "y", "pred", "w").first().r2 - out["r2_holdout"]) < 1e-9


@pytest.mark.parametrize("hot", [None, 20])
def test_group_split_is_exact_and_disjoint(spark, hot):
    df = spark.range(3000).select((F.col("id") % 300).cast("string").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    games = df.groupBy("g").agg(F.min("y").alias("y"))
    split = fits.group_split(games, "g", 0.15, 17, "y", hot).join(games, "g").toPandas()
    assert len(split) == 300 and split.groupby("y")["picked"].sum().to_dict() == {0: 30, 1: 15}
    again = fits.group_split(games, "g", 0.15, 17, "y").where("picked").toPandas()
    assert set(again.g) == set(split[split.picked].g)


def test_isotonic_clips_and_interpolates(spark):
    pdf = pd.DataFrame({"p": [0.1, 0.2, 0.3, 0.4, 0.5], "y": [0, 1, 0, 1, 1]})
    cal = fits.fit_calibrator(spark.createDataFrame(pdf), "isotonic", "p", "y")
    probe = spark.createDataFrame([(0.0,), (0.15,), (0.25,), (0.35,), (0.9,)], "p double")
    got = [r.q for r in probe.select("p", fits.apply_calibrator(cal, F.col("p")).alias("q")).orderBy("p").collect()]
    np.testing.assert_allclose(got, np.interp([0.0, 0.15, 0.25, 0.35, 0.9], cal["x"], cal["y"]))
    assert got[0] == 0.0 and got[-1] == 1.0


def test_platt_recovers_a_known_line(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0.02, 0.98, 20_000)
    z = np.log(p / (1 - p))
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * z + 0.3)))).astype(int)
    cal = fits.fit_calibrator(spark.createDataFrame(pd.DataFrame({"p": p, "y": y})), "platt", "p", "y")
    assert abs(cal["a"] - 0.5) < 0.05 and abs(cal["b"] - 0.3) < 0.05


def test_unknown_calibrators_are_refused(spark):
    with pytest.raises(ValueError):
        fits.apply_calibrator({"kind": "magic"}, F.lit(0.5))
    with pytest.raises(ValueError):
        fits.edge_target(spark.createDataFrame([(1,)], "a int"))
    with pytest.raises(ValueError):
        fits.drop_names(["a", "b", "c"], ["zzz"], strict=True)


def test_boosting_improves_on_the_base_margin(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 2000
    x = rng.normal(size=(n, 2))
    base = 0.5 * x[:, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(base + 2.0 * (x[:, 1] > 0) - 1.0)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "base": base, "y": y, "g": np.arange(n) % 200}))
    members = fits.boosted_ensemble(df, ["x0", "x1", "base"], "y", "g", "base", seeds=(17, 41), depth=2, eta=0.3, rounds=8, patience=3,
                                    colsample=1.0, min_child_weight=5.0)
    scored = fits.predict_ensemble(df, members, ["x0", "x1", "base"], "base")
    loss = scored.agg(fits.log_loss(F.col("p_home"), F.col("y")), fits.log_loss(1 / (1 + F.exp(-F.col("base"))), F.col("y"))).first()
    assert loss[0] < loss[1] - 0.05
    # The node table gives each row the leaves that the fitted trees give it, in one step of the plan.
    rows, one = fits.assemble_features(df, ["x0", "x1"]), members[0]
    for tree, nodes, places in zip(one.trees[: one.best], one.nodes[: one.best], one.places[: one.best], strict=True):
        values = dict(enumerate(nodes["value"][nodes["feature"] < 0].tolist()))
        rows = fits._add_tree(rows if "_logit" in rows.columns else rows.withColumn("_logit", F.col("base")), tree, values, places, one.eta)
    alone = fits.predict_ensemble(df, members[:1], ["x0", "x1", "base"], "base")
    assert np.allclose(sorted(r.p for r in rows.select((1 / (1 + F.exp(-F.col("_logit")))).alias("p")).collect()), sorted(r.p_home for r in alone.select("p_home").collect()), atol=1e-9)
    assert str(scored._jdf.queryExecution().executedPlan().toString()).count("ArrowEvalPython") == 1
    # The rows' layout does not matter, a child keeps its hessian, and a saved model scores as it did.
    again = fits.boosted_ensemble(df.repartition(7, "x0"), ["x0", "x1", "base"], "y", "g", "base", seeds=(17,), depth=2, eta=0.3,
                                  rounds=2, patience=3, colsample=0.5, min_child_weight=60.0)
    once = fits.boosted_ensemble(df, ["x0", "x1", "base"], "y", "g", "base", seeds=(17,), depth=2, eta=0.3, rounds=2, patience=3,
                                 colsample=0.5, min_child_weight=60.0)
    splits = lambda m: [line for t in m[0].trees for line in t.toDebugString.split("\n") if "If (" in line]
    assert [len(x) for x in once[0].places[:1]] == [1] and once[0].places == again[0].places and splits(once) == splits(again)
    model = build.Model(members, ["x0", "x1", "base"], "base", {"kind": "platt", "a": 1.1, "b": -0.1}, {"eval_auc": 0.5})
    build.save_model(spark, model, str(tmp_path / "model"))
    loaded = build.load_model(spark, str(tmp_path / "model"), ["x0", "x1", "base"])
    want, got = (sorted(r.p_home for r in build.score(m, df).select("p_home").collect()) for m in (model, loaded))
    assert np.allclose(want, got, atol=1e-12)
    with pytest.raises(ValueError, match="other features"):
        build.load_model(spark, str(tmp_path / "model"), ["x0"])


def test_priors_are_saved_whole(spark, tmp_path):
    known = features.Priors(0.35, 0.5, 0.75, 0.8, 14.5, [0.5, 0.0, 0.4, 0.1], (90.0, 0.1), 0.01, {"sim_adv": 0.2})
    build.save_priors(spark, known, str(tmp_path / "priors"))
    assert build.load_priors(spark, str(tmp_path / "priors")) == known
    build.save_priors(spark, features.Priors(0.35, 0.5, 0.75, None, 14.5, [1.0]), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="decay"):
        build.load_priors(spark, str(tmp_path / "bad"))


def test_decay_power_is_found(spark):
    rng = np.random.default_rng(8)
    n = 60_000
    e, fl, s = rng.normal(size=n) * 6, rng.random(n), rng.normal(size=n) * 8
    y = 0.4 + 0.9 * e * fl**0.77 + 0.05 * s + rng.normal(size=n) * 0.5
    df = spark.createDataFrame(pd.DataFrame({"rest_margin": y, "exp_margin": e, "frac_left": fl, "score_margin": s}))
    out = priors.fit_decay_power(df)
    assert abs(out["sim_decay_pow"] - 0.77) <= 0.02 and abs(out["sim_decay_b"] - 0.9) < 0.02 and not out["at_edge"]
    with pytest.raises(ValueError):
        priors.fit_decay_power(df.limit(100))


def test_rapm_matches_augmented_least_squares(spark):
    rng = np.random.default_rng(10)
    d0 = datetime.date(2024, 1, 1)
    rows = []
    for i in range(400):
        h, a = sorted(rng.choice(np.arange(1, 9), 5, replace=False)), sorted(rng.choice(np.arange(11, 19), 5, replace=False))
        rows.append((i, str(i % 20), d0 + datetime.timedelta(days=int(i // 40)), 2023 + (i >= 200), ",".join(map(str, h)), ",".join(map(str, a)),
                     float(rng.integers(0, 9)), float(rng.integers(0, 9)), float(rng.integers(0, 6)), float(rng.integers(0, 6)), 60.0))
    schema = "stint_id bigint, game_id string, game_date date, season int, home_lineup string, away_lineup string, pts_home double, pts_away double, poss_home double, poss_away double, seconds double"
    stint = spark.createDataFrame(rows, schema)
    refit = d0 + datetime.timedelta(days=8)
    refits = spark.createDataFrame([(d0,), (refit,)], "refit_date date")
    got = rates.rapm(stint, refits, ridge_lambda=40.0, season_decay=0.5, min_stints=10).toPandas()
    assert set(got.refit_date) == {refit}, "nothing lies before the first refit"

    players = sorted({int(p) for r in rows if r[2] < refit for c in (r[4], r[5]) for p in c.split(",")})
    at, n = {p: k for k, p in enumerate(players)}, len(players)
    x, y, w = [], [], []
    for r in (r for r in rows if r[2] < refit):
        for off, dfn, pts, poss, home in ((r[4], r[5], r[6], r[8], 1), (r[5], r[4], r[7], r[9], 0)):
            if poss <= 0:
                continue
            line = np.zeros(2 * n + 2)
            line[[at[int(p)] for p in off.split(",")]] = 1
            line[[n + at[int(p)] for p in dfn.split(",")]] = 1
            line[2 * n], line[2 * n + 1] = home, 1
            x.append(line)
            y.append(100 * pts / poss)
            w.append(0.5 ** (2024 - r[3]) * poss)
    sw = np.sqrt(w)
    pen = np.diag(np.sqrt(np.r_[np.full(2 * n, 40.0), 0, 0]))
    sol = np.linalg.lstsq(np.vstack([np.array(x) * sw[:, None], pen]), np.r_[np.array(y) * sw, np.zeros(2 * n + 2)], rcond=None)[0]
    got = got.set_index("athlete_id").loc[players]
    np.testing.assert_allclose(got.rapm_off, sol[:n], atol=1e-6)
    np.testing.assert_allclose(got.rapm_def, sol[n:2 * n], atol=1e-6)


def test_rapm_of_many_refits_is_alike_however_they_are_cut(spark):
    """One running segment, several, and the last refit asked for alone: the same ratings."""
    rng = np.random.default_rng(3)
    d0 = datetime.date(2024, 1, 1)
    rows = []
    for i in range(900):
        new = 3 * (i // 300)
        h, a = rng.choice(np.arange(1 + new, 9 + new), 5, replace=False), rng.choice(np.arange(21, 29), 5, replace=False)
        rows.append((i, str(i % 30), d0 + datetime.timedelta(days=int(i // 15)), 2022 + i // 300, ",".join(map(str, sorted(h))), ",".join(map(str, sorted(a))),
                     float(rng.integers(0, 9)), float(rng.integers(0, 9)), float(rng.integers(0, 6)), float(rng.integers(0, 6)), 60.0))
    stint = spark.createDataFrame(rows, "stint_id bigint, game_id string, game_date date, season int, home_lineup string, away_lineup string, "
                                        "pts_home double, pts_away double, poss_home double, poss_away double, seconds double")
    days = [d0 + datetime.timedelta(days=k) for k in (0, 5, 17, 18, 19, 30, 41, 44, 59, 90, 91)]
    refits = spark.createDataFrame([(d,) for d in days], "refit_date date")
    found = {}
    for segments in (1, 2, 3):
        got = rates.rapm(stint, refits, 40.0, 0.5, 50, segments)
        found[segments] = {(r.refit_date, r.athlete_id): (r.rapm_off, r.rapm_def) for r in got.collect()}
    last = spark.createDataFrame([(days[-1],)], "refit_date date")
    alone = {r.athlete_id: (r.rapm_off, r.rapm_def) for r in rates.rapm(stint, last, 40.0, 0.5, 50).collect()}
    for player, value in alone.items():
        np.testing.assert_allclose(found[1][days[-1], player], value, atol=1e-7)
    for segments in (2, 3):
        assert found[segments].keys() == found[1].keys()
        for name, value in found[segments].items():
            np.testing.assert_allclose(value, found[1][name], atol=1e-7)
    assert {d for d, _ in found[1]} == set(days[1:])


def test_edge_model_falls_back_when_a_column_is_missing(spark):
    df = spark.createDataFrame([(10.0, -4.0, 0.5, 3.0)], "sim_n_poss double, home_spread_close double, frac_left double, exp_margin_left double")
    known = features.Priors(0.36, 0.5, 0.78, 0.8, 14.0, [0.5, 0, 0.5, 0, 0], None, 0.01, {"exp_margin_full": 0.02})
    stale = features.Priors(0.36, 0.5, 0.78, 0.8, 14.0, [0.5, 0, 0.5, 0, 0], None, 0.01, {"gone": 0.02})
    assert abs(df.select(features.per_possession_edge(df, known)).first()[0] - 0.09) < 1e-12
    assert df.select(features.per_possession_edge(df, stale)).first()[0] == 0.3


def test_leaves_keep_the_sums_of_their_rows_and_rows_are_dealt_by_number(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 600
    rows = pd.DataFrame({"x0": rng.normal(size=n), "x1": rng.normal(size=n), "g": np.arange(n) % 150})
    rows["y"] = (rng.random(150) < 0.5).astype(int)[rows["g"]]
    df, dealt, fit = spark.createDataFrame(rows), [], fits.boost_member

    def member(state, *args, **kwargs):
        dealt.append(state.rdd.getNumPartitions())
        return fit(state, *args, **kwargs)

    monkeypatch.setattr(fits, "boost_member", member)
    monkeypatch.setattr(fits, "ROWS_PER_TASK", 20, raising=False)
    one = fits.boosted_ensemble(df, ["x0", "x1"], "y", "g", None, seeds=(17,), depth=2, eta=0.3, rounds=1, subsample=1.0, colsample=1.0,
                                min_child_weight=5.0)[0]
    assert dealt == [max(30, spark.sparkContext.defaultParallelism)]
    stop = {r.g for r in fits.group_split(df, "g", 0.15, 17, "y").where("picked").collect()}
    train = rows[~rows["g"].isin(stop)]
    nodes, sums = one.nodes[0], {}
    for x, y in zip(train[["x0", "x1"]].to_numpy(), train["y"], strict=True):
        at = 0
        while nodes["feature"][at] >= 0:
            at = nodes["below" if x[nodes["feature"][at]] <= nodes["threshold"][at] else "above"][at]
        sums[at] = sums.get(at, np.zeros(2)) + (0.5 - y, 0.25)
    assert len(sums) == (nodes["feature"] < 0).sum() > 1
    for at, (g, h) in sums.items():
        assert abs(nodes["value"][at] + g / (h + 1.0)) < 1e-9


def test_the_boosted_query_is_fitted_until_the_stopping_rows_end_it(spark, tmp_path, monkeypatch):
    from playtape.workloads import REGISTRY

    rng = np.random.default_rng(9)
    n = 5000
    rows = pd.DataFrame({"o_orderkey": np.arange(n), "o_custkey": np.arange(n) % 2500, "o_totalprice": rng.uniform(1000, 500000, n)})
    rows["o_orderstatus"] = np.where(rng.random(2500)[rows["o_custkey"]] < 0.5, "F", "O")
    rows["o_totalprice"] += np.where(rows["o_orderstatus"] == "F", 60000.0, 0.0)
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "orders.parquet"))
    fitted, fit = [], fits.boosted_ensemble
    monkeypatch.setattr(fits, "boosted_ensemble", lambda *args, **kwargs: fitted.extend(fit(*args, **kwargs)) or fitted)
    got = REGISTRY["boosted_ensemble"].run(spark, str(tmp_path)).first()
    assert got.n == n and len(fitted) == 5
    assert all(len(m.trees) == m.best + 50 for m in fitted)  # neither a least number of rounds nor a most ends a member
    assert max(len(nodes) for m in fitted for nodes in m.nodes) > 3


def test_all_ways_of_boosting_grow_the_best_trees(spark, monkeypatch):
    rng = np.random.default_rng(10)
    n = 1500
    rows = pd.DataFrame({"x0": rng.normal(size=n).round(1), "x1": rng.integers(0, 9, n).astype(float), "g": np.arange(n), "w": rng.uniform(0.5, 2, n)})
    rows["y"] = (rng.random(n) < 1 / (1 + np.exp(-rows["x0"] * (rows["x1"] > 4)))).astype(int)
    df, found = spark.createDataFrame(rows).repartition(4), []
    for cells, here, large in ((1 << 16, 1 << 20, 1 << 26), (1 << 16, 0, 1 << 26), (0, 0, 1 << 26), (0, 0, 0)):
        monkeypatch.setattr(fits, "CELLS", cells)
        monkeypatch.setattr(fits, "ROWS_HERE", here)
        monkeypatch.setattr(fits, "ROWS_PER_TASK", 400)
        monkeypatch.setattr(fits, "TO_DRIVER", large)
        found.append(fits.boosted_ensemble(df, ["x0", "x1"], "y", "g", None, seeds=(17,), weight="w", depth=3, eta=0.3, rounds=5, subsample=1.0,
                                           colsample=1.0, min_child_weight=5.0, checkpoint_every=2)[0])
    for other in found[1:]:
        assert other.best == found[0].best and len(other.nodes) == len(found[0].nodes)
        for one, same in zip(found[0].nodes, other.nodes, strict=True):
            assert (one["feature"] == same["feature"]).all() and np.allclose(one["threshold"], same["threshold"]) and np.allclose(one["value"], same["value"])
    # The first split is the best of all, by every threshold of every feature.
    stop = {r.g for r in fits.group_split(df, "g", 0.15, 17, "y").where("picked").collect()}
    train, tried = rows[~rows["g"].isin(stop)], {}
    g, h = train["w"] * (0.5 - train["y"]), train["w"] * 0.25
    for f, name in enumerate(["x0", "x1"]):
        values = np.unique(rows[name])
        for t in (values[1:] + values[:-1]) / 2:
            low = train[name] <= t
            if min(h[low].sum(), h[~low].sum()) >= 5.0:
                tried[f, t] = g[low].sum() ** 2 / h[low].sum() + g[~low].sum() ** 2 / h[~low].sum()
    f, t = max(tried, key=tried.get)
    first = found[0].nodes[0][0]
    assert first["feature"] == f and abs(first["threshold"] - t) < 1e-9


def test_thresholds_part_all_values_or_equal_shares_and_no_rows_make_no_trees(spark):
    rng = np.random.default_rng(11)
    rows = pd.DataFrame({"few": rng.integers(0, 5, 3000).astype(float), "many": rng.normal(size=3000)})
    few, many = fits.split_points(fits.assemble_features(spark.createDataFrame(rows).repartition(5), ["few", "many"]))
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5]
    assert len(many) == fits.BINS - 1 and np.bincount(np.searchsorted(many, rows["many"])).max() <= 2 * 3000 / fits.BINS
    none = spark.createDataFrame(rows).limit(0).withColumns({"y": F.lit(1), "g": F.lit(1)})
    members = fits.boosted_ensemble(none, ["few", "many"], "y", "g", None, seeds=(17,))
    assert [m.best for m in members] == [0] and fits.predict_ensemble(none, members, ["few", "many"], None).collect() == []
