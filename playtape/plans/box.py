"""Box scores, stints and possession runs from clean play-by-play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.fixed_values import FREE_THROW_WEIGHT, MAX_POINTS, MAX_POSSESSION_SECONDS, MAX_SHOT_SECONDS
from playtape.functions.clock import game_length, period_start
from playtape.functions.text import box_flags, rebuilt_points
from playtape.operators.filters import franchise_games, in_range, regular_season
from playtape.operators.ordered import fill_both, lag, ordered, run_id, scan

OPPONENT_COLUMNS = [
    "pts", "fga", "fgm", "fg3a", "fg3m", "fta", "ftm", "oreb", "dreb", "tov", "ast", "fouls", "tov_stolen",
    "fga_blocked", "poss",
]


def tag_box(pbp: DataFrame) -> DataFrame:
    """Add the box flags and rebuilt points.

    A play value of three breaks the three-point tie only in seasons whose values all stay within four.
    """
    value = F.col("score_value").cast("string").try_cast("double")
    usable = pbp.groupBy("season").agg((F.max(value) <= 4).alias("_value_is_points"))
    tagged = pbp.join(F.broadcast(usable), "season", "left")  # one row per season
    flags = box_flags(
        F.col("type_text"), F.col("text"), value, F.col("_value_is_points"), F.col("athlete_id_1")
    )
    tagged = tagged.withColumns(flags).drop("_value_is_points")
    return tagged.withColumn("pts", rebuilt_points(F.col("is_fgm"), F.col("is_fg3m"), F.col("is_ft_made")))


def rating_plays(pbp: DataFrame, season_types=(2,), teams=None, lineups: bool = True) -> DataFrame:
    """Regular-season franchise plays; player rates also need a resolved lineup, team totals do not."""
    kept = franchise_games(regular_season(pbp, season_types), teams, former=True)
    return tag_box(kept.where(F.coalesce("lineup_ok", F.lit(False))) if lineups else kept)


def _home_actor() -> Column:
    return F.coalesce(F.col("actor_team_id") == F.col("home_team_id"), F.lit(False))


def _away_actor() -> Column:
    return ~_home_actor() & F.col("actor_team_id").isNotNull()


def _count(test: Column) -> Column:
    return F.sum(test.cast("bigint"))


def formula_possessions(fga: Column, oreb: Column, tov: Column, fta: Column) -> Column:
    return (fga - oreb + tov + FREE_THROW_WEIGHT * fta).cast("double")


def stints(tagged: DataFrame, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """One row per game and unbroken pair of lineups with points, possessions and seconds per side."""
    o = run_id(ordered(tagged, ["game_id"], ["play_number"], hot_rows, at_most), ["home_lineup", "away_lineup"], "stint_id")
    sides = {"home": _home_actor(), "away": _away_actor()}
    player_oreb = F.col("is_oreb") & F.col("athlete_id_1").isNotNull()
    sums = []
    for side, mine in sides.items():
        sums += [
            F.sum(F.when(mine, F.col("pts")).otherwise(0.0)).alias(f"pts_{side}"),
            formula_possessions(
                _count(mine & F.col("is_fga")), _count(mine & player_oreb), _count(mine & F.col("is_tov")),
                _count(mine & F.col("is_ft_att")),
            ).alias(f"poss_{side}"),
        ]
    span = F.greatest(F.max("seconds_elapsed") - F.min("seconds_elapsed"), F.lit(0.0))
    grouped = o.result().groupBy("game_id", "game_date", "season", "stint_id", "home_lineup", "away_lineup").agg(
        *sums, span.cast("double").alias("seconds")
    )
    return grouped.where((F.col("poss_home") > 0) | (F.col("poss_away") > 0)).select(
        "stint_id", "game_id", "game_date", "season", "home_lineup", "away_lineup",
        "pts_home", "pts_away", "poss_home", "poss_away", "seconds",
    )


def oncourt_exposure(stint: DataFrame) -> DataFrame:
    """Possessions for and against and seconds per game and player, from the lineups."""
    parts = None
    for side, other, flag in (("home", "away", 1), ("away", "home", 0)):
        part = stint.select(
            "game_id",
            F.explode(F.split(f"{side}_lineup", ",")).alias("athlete"),
            F.col(f"poss_{side}").alias("poss_off"),
            F.col(f"poss_{other}").alias("poss_def"),
            "seconds",
            F.lit(flag).alias("oc_is_home"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return (
        parts.where(F.length("athlete") > 0)
        .groupBy("game_id", F.col("athlete").cast("bigint").alias("athlete_id"))
        .agg(
            F.sum("poss_off").alias("poss_off"), F.sum("poss_def").alias("poss_def"),
            F.sum("seconds").alias("seconds"), F.max("oc_is_home").alias("oc_is_home"),
        )
        .withColumn("minutes", F.col("seconds") / 60.0)
    )


def player_counts(tagged: DataFrame) -> DataFrame:
    """Counting stats per game and acting player, with the side they mostly acted for."""
    names = {
        "fga": "is_fga", "fgm": "is_fgm", "fg3a": "is_fg3a", "fg3m": "is_fg3m", "fg2a": "is_fg2a", "fg2m": "is_fg2m",
        "fta": "is_ft_att", "ftm": "is_ft_made", "tov": "is_tov", "oreb": "is_oreb", "dreb": "is_dreb",
        "fouls": "is_foul",
    }
    acting = tagged.where(F.col("athlete_id_1").isNotNull())
    return acting.groupBy("game_id", F.col("athlete_id_1").cast("bigint").alias("athlete_id")).agg(
        (F.avg(_home_actor().cast("double")) > 0.5).cast("int").alias("is_home"),
        F.sum("pts").alias("pts"),
        *[_count(F.col(flag)).alias(name) for name, flag in names.items()],
    )


def missing_points(tagged: DataFrame) -> DataFrame:
    """Official minus rebuilt points of both sides, with the game's date and season."""
    return tagged.groupBy("game_id").agg(
        F.min("game_date").alias("game_date"),
        F.min("season").alias("season"),
        (F.max("home_final") - F.sum(F.when(_home_actor(), F.col("pts")).otherwise(0.0))).alias("gap_home"),
        (F.max("away_final") - F.sum(F.when(_away_actor(), F.col("pts")).otherwise(0.0))).alias("gap_away"),
    )


def player_game_box(tagged: DataFrame, stint: DataFrame) -> DataFrame:
    """Everyone who was on the floor, with counts (zero when they never acted) and exposure."""
    counts = player_counts(tagged)
    out = oncourt_exposure(stint).join(counts, ["game_id", "athlete_id"], "left")
    out = out.join(missing_points(tagged), "game_id", "left")
    gap = F.when(F.col("oc_is_home") == 1, F.col("gap_home")).otherwise(F.col("gap_away"))
    zero = [c for c in counts.columns if c not in ("game_id", "athlete_id", "is_home")]
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in zero}
    filled["pts_gap"] = F.coalesce(gap, F.lit(0.0))
    filled["is_home"] = F.coalesce("is_home", F.lit(0))
    return out.withColumns(filled).drop("gap_home", "gap_away", "oc_is_home")


def game_meta(pbp: DataFrame) -> DataFrame:
    """Constants of each game and its total game clock."""
    firsts = ["season", "game_date", "home_team", "away_team", "home_team_id", "away_team_id", "home_final", "away_final"]
    known = {c: F.when(F.col(c).isNotNull(), F.col("play_number")) for c in firsts}
    return pbp.groupBy("game_id").agg(
        *[F.min_by(c, at).alias(c) for c, at in known.items()], F.max("period").alias("max_period")
    ).withColumn("game_seconds", game_length(F.col("max_period")))


def team_game_box(tagged: DataFrame) -> DataFrame:
    """Totals per game and team, the result, formula possessions, and the opponent's totals alongside."""
    names = {
        "fga": "is_fga", "fgm": "is_fgm", "fg3a": "is_fg3a", "fg3m": "is_fg3m", "fta": "is_ft_att",
        "ftm": "is_ft_made", "oreb": "is_oreb_player", "dreb": "is_dreb_player", "tov": "is_tov", "ast": "is_ast",
        "fouls": "is_foul", "tov_stolen": "tov_stolen", "fga_blocked": "fga_blocked",
    }
    totals = tagged.where(F.col("actor_team_id").isNotNull()).groupBy(
        "game_id", F.col("actor_team_id").cast("bigint").alias("team_id")
    ).agg(F.sum("pts").alias("pts"), *[_count(F.col(f)).alias(n) for n, f in names.items()])
    box = totals.join(game_meta(tagged), "game_id")
    home = F.col("team_id") == F.col("home_team_id")
    box = box.where(home | (F.col("team_id") == F.col("away_team_id")))

    def side(mine: str, theirs: str) -> Column:
        return F.when(home, F.col(mine)).otherwise(F.col(theirs))

    box = box.withColumns({
        "is_home": home.cast("int"),
        "team": side("home_team", "away_team"), "opponent": side("away_team", "home_team"),
        "opp_team_id": side("away_team_id", "home_team_id").cast("bigint"),
        "team_final": side("home_final", "away_final"), "opp_final": side("away_final", "home_final"),
        "poss": formula_possessions(F.col("fga"), F.col("oreb"), F.col("tov"), F.col("fta")),
    }).withColumns({
        "won": F.coalesce(F.col("team_final") > F.col("opp_final"), F.lit(False)).cast("int"),
        "pts_gap": (F.col("team_final") - F.col("pts")).cast("double"),
    })
    box = mirror_opponent(box, OPPONENT_COLUMNS)
    return box.withColumns({
        "stl": F.coalesce(F.col("opp_tov_stolen").cast("double"), F.lit(0.0)),
        "blk": F.coalesce(F.col("opp_fga_blocked").cast("double"), F.lit(0.0)),
        "reb": F.col("oreb") + F.col("dreb"),
        "opp_reb": F.col("opp_oreb") + F.col("opp_dreb"),
        "opp_stl": F.col("tov_stolen"),
        "opp_blk": F.col("fga_blocked"),
    })


def mirror_opponent(box: DataFrame, columns: list[str], key: str = "game_id", me: str = "team_id",
                    other: str = "opp_team_id") -> DataFrame:
    """The other side's columns of the same game, prefixed ``opp_``."""
    theirs = box.select(key, F.col(me).alias(other), *[F.col(c).alias(f"opp_{c}") for c in columns])
    return box.join(theirs, [key, other], "left")


def possession_runs(tagged: DataFrame, hot_rows: int | None = None, at_most: int | None = None) -> tuple[DataFrame, int]:
    """Runs of plays by one offence inside a period, with the team read off unambiguous plays.

    Also returns the size of the largest period, which bounds the runs per period.
    """
    actor = F.col("actor_team_id")
    offence = (F.col("is_fga") | F.col("is_ft_att") | F.col("is_tov") | F.col("is_oreb")) & actor.isNotNull()
    defence = F.col("is_dreb") & actor.isNotNull()
    other = F.when(actor == F.col("home_team_id"), F.col("away_team_id")).otherwise(F.col("home_team_id"))
    plays = tagged.withColumn("_said", F.when(offence, actor).when(defence, other)).select(
        "game_id", "period", "play_number", "seconds_elapsed", "is_fga", "_said"
    )
    o = fill_both(ordered(plays, ["game_id", "period"], ["play_number"], hot_rows, at_most), "_said", "team_id")
    o = run_id(o.where(F.col("team_id").isNotNull()), ["team_id"], "poss_id")
    runs = o.result().groupBy("game_id", "period", "poss_id", "team_id").agg(
        F.max("seconds_elapsed").alias("t_end"),
        F.min(F.when(F.col("is_fga"), F.col("seconds_elapsed"))).alias("t_first_fga"),
    )
    return runs, o.largest


def possession_timing(tagged: DataFrame, max_poss_seconds: float = MAX_POSSESSION_SECONDS,
                      max_shot_seconds: float = MAX_SHOT_SECONDS, hot_rows: int | None = None,
                      at_most: int | None = None) -> DataFrame:
    """Per game and team: possessions, and sums and counts of their length and time to first shot."""
    runs, largest = possession_runs(tagged, hot_rows, at_most)
    o = scan(ordered(runs, ["game_id", "period"], ["poss_id"], hot_rows, largest), prev_end=lag(F.col("t_end")))
    start = F.coalesce(F.col("prev_end"), period_start(F.col("period")).cast("double"))
    length = in_range(F.col("t_end") - start, 0.0, max_poss_seconds)
    to_shot = in_range(F.col("t_first_fga") - start, 0.0, max_shot_seconds)
    return o.result().groupBy("game_id", F.col("team_id").cast("bigint").alias("team_id")).agg(
        F.count(F.lit(1)).alias("poss_seg"),
        F.coalesce(F.sum(length), F.lit(0.0)).alias("sum_poss_sec"), F.count(length).alias("n_poss_sec"),
        F.coalesce(F.sum(to_shot), F.lit(0.0)).alias("sum_shot_sec"), F.count(to_shot).alias("n_shot_sec"),
    )


def possession_segments(states: DataFrame, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Points, opponent points, length and starting margin of every possession.

    The possession flag turns over on the play that ends a possession, so the offence during a row is
    the flag carried into it. Points are end score minus the previous segment's end score.
    """
    o = ordered(states, ["game_id"], ["play_number"], hot_rows, at_most)
    o = scan(o, _offence=lag(F.col("possession"), F.lit(0.0)))
    o = run_id(o.with_columns({"_offence": F.coalesce("_offence", F.lit(0.0))}), ["_offence"], "segment")
    at = F.col("play_number")

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), at)

    ends = o.result().groupBy("game_id", "segment").agg(
        F.min("_offence").alias("possession"),
        F.max_by("home_score", known("home_score")).cast("double").alias("home_end"),
        F.max_by("away_score", known("away_score")).cast("double").alias("away_end"),
        F.max_by("seconds_elapsed", known("seconds_elapsed")).alias("elapsed_end"),
        F.min_by("seconds_left_reg", known("seconds_left_reg")).alias("seconds_left_reg"),
        F.min_by("period", known("period")).alias("period"),
    )
    o = scan(
        ordered(ends, ["game_id"], ["segment"], hot_rows, o.largest),
        home_start=lag(F.col("home_end")), away_start=lag(F.col("away_end")), _began=lag(F.col("elapsed_end")),
    )
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("home_start", "away_start", "_began")}
    seg = o.result().withColumns(zero)
    home_gain, away_gain = F.col("home_end") - F.col("home_start"), F.col("away_end") - F.col("away_start")
    mine = F.col("possession") > 0
    seg = seg.withColumns({
        "margin_start": F.col("home_start") - F.col("away_start"),
        "points": F.when(mine, home_gain).otherwise(away_gain),
        "opp_points": F.when(mine, away_gain).otherwise(home_gain),
        "duration": F.col("elapsed_end") - F.col("_began"),
    }).drop("_began")
    return seg.where(
        F.col("points").between(0, MAX_POINTS)
        & F.col("duration").between(0, MAX_POSSESSION_SECONDS)
        & (F.col("possession") != 0)
    )
