"""The whole way from clean plays to a scored, calibrated model, in its two passes.

The edge model is fitted on features that need an edge themselves: the first pass uses the decayed spread,
the second the fitted edge. Only parameters travel through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtape.fixed_values import CALIBRATOR_KINDS, EDGE_PREDICTORS, feature_names
from playtape.functions.numeric import clip, season_weight
from playtape.operators.quantiles import rank_auc
from playtape.plans import box, features, fits, priors
from playtape.session import cut_lineage
from playtape.sources.io import read_params, write_params


def measure(pbp: DataFrame, odds: DataFrame, season_types=(2,), teams=None, min_cell: int = 200,
            min_states: int = 50_000) -> tuple[features.Priors, DataFrame]:
    """Priors and the possession-seconds grid from earlier seasons."""
    events = features.parse_events(features.usable_games(pbp, season_types, teams))
    segments = cut_lineage(box.possession_segments(features.possession_state(events)))
    league = priors.league_rates(events).first()
    decay = priors.fit_decay_power(priors.decay_states(events, odds), min_states=min_states)
    share = [r.share for r in priors.points_distribution(segments).orderBy("points").collect()]
    pace = priors.pace_fit(segments, odds).first()
    overall = segments.where(F.col("period") <= 4).agg(F.avg("duration").alias("m")).first().m
    known = features.Priors(
        league.league_fg3_pct, league.league_fg2_pct, league.league_ft_pct, decay["sim_decay_pow"], overall, share,
        None if pace.slope is None else (pace.intercept, pace.slope),
    )
    return known, cut_lineage(priors.possession_seconds(segments, min_cell))


def measure_surface(states: DataFrame, min_n: int = 30) -> DataFrame:
    """State surface from a table holding sim_adv, sim_n_poss, score_margin, possession and home_won."""
    cells = features.surface_keys(F.col("sim_adv"), F.col("sim_n_poss"), F.col("score_margin"))
    keyed = states.withColumns({**cells, "ball": (F.col("possession") > 0).cast("int")})
    return cut_lineage(priors.fit_state_surface(keyed, [*cells, "ball"], ["margin_cell", "ball"], "home_won", min_n))


def surface_states(pbp: DataFrame, odds: DataFrame, grid: DataFrame, known: features.Priors, season_types=(2,),
                   teams=None) -> DataFrame:
    """Earlier states with their edge and possessions left, for measuring the surface."""
    events = features.parse_events(features.usable_games(pbp, season_types, teams))
    df = features.clock_features(features.possession_state(events))
    df = df.join(odds.withColumnRenamed("espn_game_id", "game_id"), "game_id", "left")
    df = features.possessions_left(features.pregame_features(df, known.decay_power), grid, known)
    plain = replace(known, edge_intercept=None)
    return df.withColumn("sim_adv", features.per_possession_edge(df, plain))


def fit_edge(table: DataFrame, known: features.Priors, predictors: Sequence[str] = EDGE_PREDICTORS, min_poss: float = 5.0,
             weight_pow: float = 0.5, alphas: Sequence[float] = (0.0,), holdout_frac: float = 0.2) -> tuple[features.Priors, dict]:
    """Linear edge model chosen on held-out games; returns priors that carry it."""
    target = fits.edge_target(table, min_poss, weight_pow, predictors)
    held = fits.group_split(table, "game_id", holdout_frac, 11).withColumnRenamed("picked", "_held")
    out = fits.select_alpha(target.join(held, "game_id"), "realized_edge", list(predictors), "fit_weight", "_held", alphas)
    return replace(known, edge_intercept=out["intercept"], edge_coefs=out["coefs"]), out


@dataclass(frozen=True)
class Model:
    """Boosted members on a base margin with the calibrator that won the cross-fit."""

    members: list
    features: list[str]
    base_margin: str | None
    calibrator: dict
    report: dict


def train_model(table: DataFrame, names: Sequence[str] | None = None, seeds: Sequence[int] = (17, 41, 99, 123, 271),
                eval_frac: float = 0.15, season_decay: float = 1.0, base_margin: str | None = "sim_logit",
                tail_cuts: Sequence[float] = (0.05, 0.10, 0.20), bet_weight: str | None = None, **boost_args) -> Model:
    """Members trained outside the evaluation games, calibrated and measured inside them."""
    names = list(names or feature_names())
    split = fits.group_split(table, "game_id", eval_frac, 1234, "home_won").withColumnRenamed("picked", "_eval")
    newest = table.agg(F.max("season").alias("m")).scalar()
    weight = season_weight(F.col("season"), newest, season_decay) * (F.col(bet_weight) if bet_weight else F.lit(1.0))
    rows = table.join(split, "game_id").withColumn("_weight", weight)
    members = fits.boosted_ensemble(
        rows.where(~F.col("_eval")), names, "home_won", "game_id", base_margin, seeds, weight="_weight", **boost_args
    )
    scored = fits.predict_ensemble(rows.where("_eval"), members, names, base_margin, "_p")
    halves = fits.group_split(scored, "game_id", 0.5, 7).withColumnRenamed("picked", "_half")
    held = cut_lineage(scored.join(halves, "game_id").select("game_id", "_p", "home_won", "_half"))
    chosen = fits.choose_calibrator(held, "_p", "home_won", "_half", tail_cuts)
    calibrated = fits.apply_calibrator(chosen["calibrator"], F.col("_p"))
    report = {
        "eval_logloss": held.agg(fits.log_loss(calibrated, F.col("home_won")).alias("l")).first().l,
        "eval_auc": rank_auc(held, "_p", "home_won").first().auc,
        "calibrator": chosen["chosen"], "scores": chosen["scores"],
    }
    return Model(members, names, base_margin, chosen["calibrator"], report)


def score(model: Model, table: DataFrame, out: str = "p_home") -> DataFrame:
    """Calibrated home-win probability of every state."""
    if model.base_margin and model.base_margin not in table.columns:
        raise ValueError(f"the model needs the base margin {model.base_margin}; rebuild the features")
    raw = fits.predict_ensemble(table, model.members, model.features, model.base_margin, "_p")
    return raw.withColumn(out, clip(fits.apply_calibrator(model.calibrator, F.col("_p")), 1e-6, 1 - 1e-6)).drop("_p")


NODE_ROWS = "member int, tree int, node int, feature int, threshold double, below int, above int, value double"


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """The whole model below ``path``: parameters as rows, and the nodes of all trees as one table."""
    rows = [(i, j, k, *map(_plain, node)) for i, m in enumerate(model.members) for j, tree in enumerate(m.nodes[: m.best]) for k, node in enumerate(tree)]
    spark.createDataFrame(rows, NODE_ROWS).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    members = [{"eta": m.eta, "best": m.best, "places": m.places[: m.best]} for m in model.members]
    write_params(spark, {"members": members, "features": model.features, "base_margin": model.base_margin,
                         "calibrator": model.calibrator, "report": model.report}, f"{path}/params")


def _plain(value: np.generic) -> int | float:
    return value.item()


def load_model(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Model:
    """A saved model. Refuses an unknown calibrator, and other features than the ones it will be given."""
    params = read_params(spark, f"{path}/params", ["members", "features", "calibrator"])
    if params["calibrator"].get("kind") not in CALIBRATOR_KINDS:
        raise ValueError(f"unknown calibrator {params['calibrator'].get('kind')}")
    if features is not None and list(features) != params["features"]:
        raise ValueError("the model was trained on other features; train it again")
    table = spark.read.schema(NODE_ROWS).parquet(f"{path}/nodes").toPandas().sort_values(["member", "tree", "node"])  # a model's own size
    trees = {name: np.array([tuple(r) for r in rows[list(fits.NODE.names)].itertuples(index=False)], fits.NODE)
             for name, rows in table.groupby(["member", "tree"], sort=True)}
    members = []
    for i, saved in enumerate(params["members"]):
        member = fits.BoostedMember(saved["eta"])
        member.best, member.places = saved["best"], saved["places"]
        member.nodes = [trees[i, j] for j in range(saved["best"])]
        members.append(member)
    return Model(members, params["features"], params.get("base_margin"), params["calibrator"], params.get("report", {}))


def save_priors(spark: SparkSession, priors: features.Priors, path: str) -> None:
    write_params(spark, asdict(priors), path)


def load_priors(spark: SparkSession, path: str) -> features.Priors:
    """Saved priors; a table without a decay power is refused."""
    params = read_params(spark, path, ["decay_power", "fg3_pct", "fg2_pct", "ft_pct", "overall_seconds", "points_distribution"])
    if params["decay_power"] is None:
        raise ValueError(f"priors at {path} have no decay power; measure them again")
    pace = params.get("pace_fit")
    return features.Priors(**{**params, "pace_fit": tuple(pace) if pace else None})


def build_all(pbp: DataFrame, earlier: DataFrame, odds: DataFrame, rates: DataFrame, rosters: DataFrame, season_types=(2,),
              teams=None, predictors: Sequence[str] = EDGE_PREDICTORS, min_cell: int = 200, min_states: int = 50_000,
              surface_min: int = 30, min_games: int = 50, **train_args) -> tuple[DataFrame, Model, features.Priors]:
    """Priors, features, edge model, features again, trained model."""
    known, grid = measure(earlier, odds, season_types, teams, min_cell, min_states)
    surface = measure_surface(surface_states(earlier, odds, grid, known, season_types, teams), surface_min)

    def build(p: features.Priors) -> DataFrame:
        return cut_lineage(features.build_features(
            pbp, odds, rates, rosters, grid, surface, p, season_types, teams, min_games=min_games))

    fitted, _ = fit_edge(build(known), known, predictors)
    table = build(fitted)
    return table, train_model(table, **train_args), fitted
