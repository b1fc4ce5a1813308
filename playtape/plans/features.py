"""Per-event feature table: possession, clock, pregame lines, shooting luck, lineups and state surface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.fixed_values import (
    DECAY_POWERS,
    EDGE_LIMIT,
    EDGE_STEP,
    FEATURE_IDS,
    MARGIN_CAP,
    MARGIN_EDGES,
    MAX_POSSESSIONS,
    OVERTIME_SECONDS,
    PACE_SCALE_RANGE,
    REGULATION_PERIODS,
    REGULATION_SECONDS,
    TIME_LEFT_EDGES,
    decay_tag,
    feature_names,
)
from playtape.functions.clock import fraction_left, horizon_left
from playtape.functions.numeric import (
    clip,
    clipped_bin_index,
    decayed,
    finite_or,
    floored_rate,
    logit,
    per_root_second,
)
from playtape.functions.text import has, shot_flags
from playtape.operators.dedupe import keep_first
from playtape.operators.filters import (
    drop_groups_with,
    franchise_games,
    regular_season,
    require_columns,
    select_in_order,
    undecided,
)
from playtape.operators.ordered import Ordered, ffill, ordered, running_sum, scan
from playtape.session import cut_lineage


def parse_events(pbp: DataFrame) -> DataFrame:
    """Add the strict event flags."""
    return pbp.withColumns(shot_flags(F.col("type_text"), F.col("text")))


def possession_rule() -> Column:
    """1 home ball, -1 away ball, null where the event says nothing (missed shots included)."""
    actor = F.col("actor_team_id")
    side = F.when(actor.isNotNull(), F.when(actor == F.col("home_team_id"), 1.0).otherwise(-1.0))
    made = F.col("is_fg3m") | F.col("is_fg2m")
    missed = (F.col("is_fga") & ~made) | (F.col("is_ft_last") & ~F.col("is_ftm"))
    flips = F.col("is_turnover") | made | (F.col("is_ft_last") & F.col("is_ftm"))
    keeps = F.col("is_def_reb") | F.col("is_off_reb") | F.col("is_steal")
    return F.when(missed, F.lit(None).cast("double")).when(flips, -side).when(keeps, side)


def possession_state(events: DataFrame, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Who holds the ball after each event, carried forward inside the game; 0 before anything is known."""
    o = ordered(events.withColumn("_ball", possession_rule()), ["game_id"], ["play_number"], hot_rows, at_most)
    return carry_possession(o).result()


def carry_possession(o: Ordered) -> Ordered:
    o = scan(o, possession=ffill(F.col("_ball")))
    known = F.col("possession").isNotNull()
    o = o.with_columns({"poss_known": known.cast("int"), "possession": F.coalesce("possession", F.lit(0.0))})
    return Ordered(o.df.drop("_ball"), o.part, o.order, o.split, o.largest)


def closing_markets(moneylines: DataFrame, spreads: DataFrame, totals: DataFrame) -> DataFrame:
    """Full outer union of the three closing markets, one row per game; of repeated ids a row with a price stands."""
    ml = moneylines.select("espn_game_id", "p_home_close", "home_close_ml", "away_close_ml")
    sp = spreads.select("espn_game_id", "home_spread_close")
    to = totals.select("espn_game_id", "total_close")
    odds = ml.join(sp, "espn_game_id", "full").join(to, "espn_game_id", "full")
    odds = odds.withColumn("espn_game_id", F.col("espn_game_id").cast("string"))
    order = ["p_home_close", "home_spread_close", "total_close", "home_close_ml", "away_close_ml"]
    return keep_first(odds, ["espn_game_id"], [F.col(c).asc_nulls_last() for c in order])


def available_players(rosters: DataFrame) -> DataFrame:
    """Pregame availability: did-not-play rows go unless the reason is missing or the coach's decision."""
    require_columns(rosters, ["game_id", "team_id", "athlete_id", "did_not_play", "reason"], "rosters")
    coach = F.col("reason").isNull() | has(F.col("reason"), "coach")
    sat_out = F.coalesce(F.col("did_not_play"), F.lit(False)) & ~coach
    ids = rosters.withColumns({
        "game_id": F.col("game_id").cast("string"),
        "team_id": F.col("team_id").cast("string").try_cast("double").cast("bigint"),
        "athlete_id": F.col("athlete_id").cast("string").try_cast("double").cast("bigint"),
    }).where(F.col("team_id").isNotNull() & F.col("athlete_id").isNotNull() & ~sat_out)
    return keep_first(ids.select("game_id", "team_id", "athlete_id"), ["game_id", "athlete_id"], ["team_id"])


def clock_features(df: DataFrame) -> DataFrame:
    period, left = F.col("period"), F.col("seconds_left_horizon")
    df = df.withColumn("seconds_left_horizon", horizon_left(period, F.col("seconds_left_reg"), F.col("pc_seconds_left")))
    return df.withColumns({
        "is_ot": (period > REGULATION_PERIODS).cast("int"),
        "ot_number": F.greatest(F.lit(0), period - REGULATION_PERIODS),
        "period_len": F.when(period <= REGULATION_PERIODS, 720.0).otherwise(float(OVERTIME_SECONDS)),
        "frac_left": fraction_left(period, left),
        "frac_elapsed": 1.0 - fraction_left(period, left),
        "seconds_left_period": F.col("pc_seconds_left"),
    })


def pregame_features(df: DataFrame, decay_power: float, powers: list[float] = DECAY_POWERS) -> DataFrame:
    """Closing line terms, always decayed, and how far the game has contradicted the line."""
    df = df.withColumns({
        "logit_close": logit(F.col("p_home_close"), 1e-4),
        "_expected": -F.col("home_spread_close").cast("double"),
    })
    left, expected, margin = F.col("frac_left"), F.col("_expected"), F.col("score_margin")
    new = {}
    for k in powers:
        new[f"exp_margin_left_{decay_tag(k)}"] = decayed(expected, left, k)
        new[f"logit_close_{decay_tag(k)}"] = decayed(F.col("logit_close"), left, k)
        new[f"total_left_{decay_tag(k)}"] = decayed(F.col("total_close").cast("double"), left, k)
    df = df.withColumns(new).withColumns({
        "exp_margin_left": decayed(expected, left, decay_power),
        "line_surprise": margin - expected * (1.0 - F.pow(left, F.lit(decay_power))),
    })
    left_margin = F.col("exp_margin_left")
    rate = clip(F.col("line_surprise") / clip(F.col("frac_elapsed"), 0.15, 1.0), -30.0, 30.0)
    return df.withColumns({
        "line_surprise_rate": rate,
        "exp_margin_x_surprise_rate": expected * rate,
        "exp_margin_left_x_surprise": left_margin * F.col("line_surprise"),
        "margin_plus_exp_left": margin + left_margin,
        "exp_margin_left_per_sec": left_margin / F.sqrt(F.greatest(F.col("seconds_left_horizon"), F.lit(1.0))),
    }).drop("_expected")


def expected_shooting(df: DataFrame, league: dict[str, float | Column], shrink_min: float = 500.0) -> DataFrame:
    """Shooter's expected percentages: own prior rate and league rate mixed by prior minutes."""
    minutes = F.greatest(F.coalesce("prior_min", F.lit(0.0)), F.lit(0.0))
    own = minutes / (minutes + shrink_min)
    new = {}
    for name in ("fg3_pct", "ft_pct", "fg2_pct"):
        base = league[name] if isinstance(league[name], Column) else F.lit(float(league[name]))
        new[f"exp_{name}"] = own * F.coalesce(F.col(name), base) + (1 - own) * base
    return df.withColumns(new)


def luck_sums(o: Ordered) -> Ordered:
    """Running sums per side of attempts, makes, expected makes and fouls, all over one sort."""
    actor = F.col("actor_team_id")
    sides = {
        "h": F.coalesce(actor == F.col("home_team_id"), F.lit(False)),
        "a": F.coalesce(actor == F.col("away_team_id"), F.lit(False)),
    }
    sums = {}
    for s, mine in sides.items():
        for name, flag in (("fg3a", "is_fg3a"), ("fg3m", "is_fg3m"), ("fg2a", "is_fg2a"), ("fg2m", "is_fg2m"),
                           ("fta", "is_fta"), ("ftm", "is_ftm"), ("foul", "is_foul")):
            sums[f"_{s}_{name}"] = running_sum((mine & F.col(flag)).cast("double"))
        for name, flag, rate in (("x3", "is_fg3a", "exp_fg3_pct"), ("x2", "is_fg2a", "exp_fg2_pct"),
                                 ("xft", "is_fta", "exp_ft_pct")):
            sums[f"_{s}_{name}"] = running_sum(F.when(mine & F.col(flag), F.col(rate)).otherwise(0.0))
    return scan(o, **sums)


def luck_features(o: Ordered) -> Ordered:
    """Points above or below what the same shots by the same shooters give on average, home minus away."""
    o = luck_sums(o)

    def d(name: str) -> Column:
        return F.col(f"_h_{name}") - F.col(f"_a_{name}")

    left = F.col("frac_left")
    o = o.with_columns({
        "fg3a_home": F.col("_h_fg3a"), "fg3a_away": F.col("_a_fg3a"),
        "fg3_luck_home_pts": 3.0 * (F.col("_h_fg3m") - F.col("_h_x3")),
        "fg3_luck_away_pts": 3.0 * (F.col("_a_fg3m") - F.col("_a_x3")),
        "ft_luck_diff_pts": (F.col("_h_ftm") - F.col("_h_xft")) - (F.col("_a_ftm") - F.col("_a_xft")),
        "fg2_luck_diff_pts": 2.0 * ((F.col("_h_fg2m") - F.col("_h_x2")) - (F.col("_a_fg2m") - F.col("_a_x2"))),
        "fta_diff": d("fta"), "foul_diff": d("foul"), "fg3a_diff": d("fg3a"),
        "fga_total": F.col("_h_fg3a") + F.col("_a_fg3a") + F.col("_h_fg2a") + F.col("_a_fg2a"),
    })
    o = o.with_columns({"fg3_luck_diff_pts": F.col("fg3_luck_home_pts") - F.col("fg3_luck_away_pts")})
    o = o.with_columns({
        "luck_diff_pts": F.col("fg3_luck_diff_pts") + F.col("ft_luck_diff_pts") + F.col("fg2_luck_diff_pts")
    })
    o = o.with_columns({
        "margin_ex_luck": F.col("score_margin") - F.col("luck_diff_pts"),
        "fg3_luck_x_fracleft": F.col("fg3_luck_diff_pts") * left,
        "luck_x_fracleft": F.col("luck_diff_pts") * left,
        "fta_diff_x_fracleft": F.col("fta_diff") * left,
    })
    helper = [c for c in o.df.columns if c.startswith(("_h_", "_a_"))]
    return Ordered(o.df.drop(*helper), o.part, o.order, o.split, o.largest)


def state_features(df: DataFrame) -> DataFrame:
    """Pace against the closing total, and the margin weighed by the time left."""
    points, margin = F.col("home_score") + F.col("away_score"), F.col("score_margin")
    return df.withColumns({
        "pts_total": points,
        "pace_ratio": floored_rate(points, F.col("total_close"), F.col("frac_elapsed")),
        "margin_x_fracleft": margin * F.col("frac_left"),
        "margin_per_sec_left": per_root_second(margin, F.col("seconds_left_horizon")),
        "team_foul_diff_period": F.col("home_team_fouls_period") - F.col("away_team_fouls_period"),
    })


def lineup_value(df: DataFrame, rates: DataFrame, lineup: str, value: str, out: str,
                 source: DataFrame | None = None) -> DataFrame:
    """Sum of a player value over each lineup, evaluated once per distinct (game, lineup).

    ``{out}`` is null when no player is known; ``{out}_missing`` counts the unknown ones. ``source`` may
    name a cheaper table holding the same lineups, so that ``df`` is not computed twice.
    """
    distinct = (df if source is None else source).select("game_id", lineup).distinct()
    ids = F.filter(F.split(F.coalesce(F.col(lineup), F.lit("")), ","), lambda x: F.trim(x) != "")
    players = distinct.select("game_id", lineup, F.explode_outer(ids).alias("_id")).withColumn(
        "athlete_id", F.col("_id").try_cast("bigint")
    )
    known = rates.select("game_id", "athlete_id", F.col(value).alias("_v"), F.lit(1).alias("_known"))
    found = players.join(known, ["game_id", "athlete_id"], "left").groupBy("game_id", lineup).agg(
        F.sum("_v").alias(out), (F.count("_id") - F.count("_known")).alias(f"{out}_missing")
    )
    same = (df["game_id"] == found["game_id"]) & df[lineup].eqNullSafe(found[lineup])
    return df.join(found, same, "left").select(df["*"], found[out], found[f"{out}_missing"])


def rest_value(available: DataFrame, sides: DataFrame, rates: DataFrame) -> DataFrame:
    """Expected five-man value of the available players, weighted by prior minutes per game; one row per game."""
    placed = available.join(sides, "game_id", "inner")
    home, away = F.col("team_id") == F.col("home_team_id"), F.col("team_id") == F.col("away_team_id")
    placed = placed.withColumn("side", F.when(home, "home").when(away, "away")).where(F.col("side").isNotNull())
    known = placed.join(rates.select("game_id", "athlete_id", "rapm_net", "mpg"), ["game_id", "athlete_id"], "left")
    w, v = F.coalesce("mpg", F.lit(0.0)), F.coalesce("rapm_net", F.lit(0.0))
    out = []
    for side in ("home", "away"):
        mine = F.col("side") == side
        weight = F.sum(F.when(mine, w))
        out.append(F.when(weight > 0, F.sum(F.when(mine, w * v)) / weight * 5.0).alias(f"{side}_rest_rapm"))
    return known.groupBy("game_id").agg(*out)


def rating_base(rates: DataFrame) -> DataFrame:
    """Ratings with unknowns at league average, and prior minutes per game."""
    games = F.coalesce("prior_gp", F.lit(0))
    return rates.select(
        "game_id", "athlete_id",
        F.coalesce("rapm_net", F.lit(0.0)).alias("rapm_net"),
        F.when(games > 0, F.coalesce("prior_min", F.lit(0.0)) / games).otherwise(0.0).alias("mpg"),
    )


def roster_residual(per_game: DataFrame, min_games: int = 50) -> DataFrame:
    """Roster differential not explained by the pregame margin, from one least-squares line over games."""
    y, x = F.col("rest_rapm_diff"), F.col("exp_margin_full")
    fit = per_game.select(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a")
    )
    enough = fit.select(F.col("n") >= min_games).scalar()
    slope, level = fit.select("b").scalar(), fit.select("a").scalar()
    return per_game.withColumn("rest_rapm_resid", F.when(enough, y - (level + slope * x)))


def lineup_features(df: DataFrame, rates: DataFrame, available: DataFrame, min_games: int = 50,
                    source: DataFrame | None = None) -> DataFrame:
    """On-court value, expected rest-of-game value and the edges between them.

    ``source`` may name a cheaper table with the same games and lineups (the stored plays with their lines).
    """
    base = rating_base(rates)
    source = df if source is None else source
    sides = source.groupBy("game_id").agg(
        F.min("home_team_id").alias("home_team_id"), F.min("away_team_id").alias("away_team_id"),
        F.min("home_spread_close").alias("_spread"),
    )
    rest = sides.select("game_id", "_spread").join(rest_value(available, sides, base), "game_id", "left")
    rest = rest.withColumns({
        "rest_rapm_diff": F.col("home_rest_rapm") - F.col("away_rest_rapm"), "exp_margin_full": -F.col("_spread"),
    })
    # one row per game, read by the fit and by the join: stored once
    rest = roster_residual(cut_lineage(rest), min_games).drop("_spread", "exp_margin_full")
    for side in ("home", "away"):
        df = lineup_value(df, base, f"{side}_lineup", "rapm_net", f"_{side}_oncourt", source)
    df = df.join(rest, "game_id", "left")
    home, away = F.col("_home_oncourt"), F.col("_away_oncourt")
    df = df.withColumns({
        "oncourt_rapm_diff": home - away,
        "oncourt_edge": (home - away) - F.col("rest_rapm_diff"),
        "home_oncourt_edge": home - F.col("home_rest_rapm"),
        "away_oncourt_edge": away - F.col("away_rest_rapm"),
        "rest_rapm_diff_left": F.col("rest_rapm_diff") * F.col("frac_left"),
        "rest_rapm_resid_left": F.col("rest_rapm_resid") * F.col("frac_left"),
        "oncourt_rapm_missing": F.coalesce("_home_oncourt_missing", F.lit(0))
        + F.coalesce("_away_oncourt_missing", F.lit(0)),
    })
    return df.drop("_home_oncourt", "_away_oncourt", "_home_oncourt_missing", "_away_oncourt_missing")


@dataclass(frozen=True)
class Priors:
    """What the feature build takes from earlier seasons: all of it small and fixed in size."""

    fg3_pct: float
    fg2_pct: float
    ft_pct: float
    decay_power: float
    overall_seconds: float
    points_distribution: list[float]
    pace_fit: tuple[float, float] | None = None
    edge_intercept: float | None = None
    edge_coefs: dict[str, float] = field(default_factory=dict)

    @property
    def league(self) -> dict[str, float]:
        return {"fg3_pct": self.fg3_pct, "fg2_pct": self.fg2_pct, "ft_pct": self.ft_pct}


def possessions_left(df: DataFrame, seconds_grid: DataFrame, priors: Priors) -> DataFrame:
    """Total possessions left: measured seconds per possession of the state's bin, scaled by pregame pace."""
    off_margin = F.when(F.col("possession") > 0, F.col("score_margin")).otherwise(-F.col("score_margin"))
    df = df.withColumns({
        "tl": clipped_bin_index(F.col("seconds_left_horizon"), TIME_LEFT_EDGES),
        "mg": clipped_bin_index(off_margin, MARGIN_EDGES),
    })
    # the grid has one row per pair of fixed bins
    df = df.join(F.broadcast(seconds_grid.select("tl", "mg", F.col("value").alias("_sec"))), ["tl", "mg"], "left")
    league_points = sum(i * p for i, p in enumerate(priors.points_distribution))
    usual = REGULATION_SECONDS / max(priors.overall_seconds, 1.0)
    total = F.col("total_close").cast("double")
    if priors.pace_fit:
        expected = priors.pace_fit[0] + priors.pace_fit[1] * total
    else:
        expected = total / max(league_points, 0.5)
    expected = F.when(expected > 40, expected).otherwise(usual)
    seconds = F.coalesce("_sec", F.lit(priors.overall_seconds)) * clip(usual / expected, *PACE_SCALE_RANGE)
    count = clip(F.col("seconds_left_horizon") / F.greatest(seconds, F.lit(1.0)), 0.0, float(MAX_POSSESSIONS))
    return df.withColumn("sim_n_poss", count).drop("tl", "mg", "_sec")


def per_possession_edge(df: DataFrame, priors: Priors) -> Column:
    """Linear edge model where one is given and all its columns exist; else the decayed spread per possession."""
    fallback = F.col("exp_margin_left") / F.greatest(F.col("sim_n_poss") / 2.0, F.lit(1.0))
    columns = set(df.columns) | {"exp_margin_full"}
    if priors.edge_intercept is None or not set(priors.edge_coefs) <= columns:
        edge = fallback
    else:
        edge = F.lit(priors.edge_intercept)
        for name, coef in priors.edge_coefs.items():
            value = -F.col("home_spread_close") if name == "exp_margin_full" else F.col(name)
            edge = edge + F.lit(coef) * finite_or(value.cast("double"), 0.0)
    return clip(finite_or(edge, 0.0), -EDGE_LIMIT, EDGE_LIMIT)


def grid_cell(x: Column, start: float, step: float, low: int, high: int) -> Column:
    """Index of the nearest grid point, clipped to the grid."""
    return clip(F.rint((x - start) / step), low, high).cast("int")


def surface_keys(edge: Column, possessions: Column, margin: Column) -> dict[str, Column]:
    """Cell of the state surface: edge grid, whole possessions, capped margin."""
    return {
        "edge_cell": grid_cell(edge, -EDGE_LIMIT, EDGE_STEP, 0, round(2 * EDGE_LIMIT / EDGE_STEP)),
        "poss_cell": grid_cell(possessions, 0.0, 1.0, 0, MAX_POSSESSIONS),
        "margin_cell": grid_cell(margin, 0.0, 1.0, -MARGIN_CAP, MARGIN_CAP),
    }


def nearest_grid_lookup(df: DataFrame, surface: DataFrame, cells: dict[str, Column], value: str, out: str,
                        bounded: bool = False) -> DataFrame:
    """Snap each row to its surface cell and read the cell's value.

    ``bounded`` says that the grid itself caps the surface at a size every executor can hold.
    """
    keyed = df.withColumns({f"_cell_{k}": v for k, v in cells.items()})
    table = surface.select(*[F.col(k).alias(f"_cell_{k}") for k in cells], F.col(value).alias(out))
    table = F.broadcast(table) if bounded else table
    return keyed.join(table, [f"_cell_{k}" for k in cells], "left").drop(*[f"_cell_{k}" for k in cells])


def surface_features(df: DataFrame, surface: DataFrame) -> DataFrame:
    """Win probability of the state, of the state with the other side holding the ball, and at zero edge.

    The surface has at most 31 edges x 251 possession counts x 121 margins x 2 sides, under two million
    rows of five numbers, so it is broadcast and the wide rows are not shuffled for the three lookups.
    """
    ball = (F.col("possession") > 0).cast("int")
    n, m, edge = F.col("sim_n_poss"), F.col("score_margin"), F.col("sim_adv")
    for out, e, b in (("sim_wp", edge, ball), ("_other_ball", edge, 1 - ball), ("sim_wp_neutral", F.lit(0.0), ball)):
        df = nearest_grid_lookup(df, surface, {**surface_keys(e, n, m), "ball": b}, "wp", out, bounded=True)
    return df.withColumns({
        "sim_logit": logit(F.col("sim_wp")),
        "sim_ball_value": F.col("sim_wp") - F.col("_other_ball"),
        "sim_pregame_lift": F.col("sim_wp") - F.col("sim_wp_neutral"),
    }).drop("_other_ball")


def usable_games(pbp: DataFrame, season_types=(2,), teams=None) -> DataFrame:
    kept = franchise_games(regular_season(pbp, season_types), teams)
    kept = kept.withColumn("game_id", F.col("game_id").cast("string"))
    return drop_groups_with(kept, ["game_id"], undecided())


def build_features(pbp: DataFrame, odds: DataFrame, rates: DataFrame, rosters: DataFrame, seconds_grid: DataFrame,
                   surface: DataFrame, priors: Priors, season_types=(2,), teams=None, shrink_min: float = 500.0,
                   powers: list[float] = DECAY_POWERS, min_games: int = 50, hot_rows: int | None = None,
                   at_most: int | None = None,
                   edge_scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The full per-event feature table: identifiers, features and outcome.

    ``at_most`` may carry a known bound on the rows of a game and saves measuring it. ``edge_scorer`` adds
    an ``_edge`` column from a model that beat the linear one; without it the linear edge is used.
    """
    df = clock_features(parse_events(usable_games(pbp, season_types, teams)))
    df = source = df.join(odds, df["game_id"] == odds["espn_game_id"], "left").drop("espn_game_id")
    order = [F.col(c).asc_nulls_last() for c in ("prior_min", "prior_gp", "fg3_pct", "fg2_pct", "ft_pct")]
    shooter = keep_first(rates, ["game_id", "athlete_id"], order).select(
        "game_id", F.col("athlete_id").alias("shooter_id"), "fg3_pct", "fg2_pct", "ft_pct", "prior_min"
    )
    df = df.withColumn("shooter_id", F.col("athlete_id_1").cast("bigint"))
    df = expected_shooting(df.join(shooter, ["game_id", "shooter_id"], "left"), priors.league, shrink_min)
    o = ordered(df.withColumn("_ball", possession_rule()), ["game_id"], ["play_number"], hot_rows, at_most)
    df = state_features(luck_features(carry_possession(o)).result())
    df = lineup_features(df, rates, available_players(rosters), min_games, source)
    # row by row, so after the shuffles, which need not carry its columns
    df = pregame_features(df, priors.decay_power, powers)
    df = possessions_left(df, seconds_grid, priors)
    if edge_scorer is None:
        edge = per_possession_edge(df, priors)
    else:
        df = edge_scorer(df)
        edge = clip(finite_or(F.col("_edge"), 0.0), -EDGE_LIMIT, EDGE_LIMIT)
    df = surface_features(df.withColumn("sim_adv", edge), surface)
    df = df.withColumn("home_won", F.col("home_won").cast("int"))
    return select_in_order(df, FEATURE_IDS + feature_names(powers) + ["home_won"])

