"""Raw feed, rosters and schedule to the clean play-by-play table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtape.functions.clock import clock_seconds, regulation_left, seconds_elapsed
from playtape.functions.text import is_team_foul
from playtape.operators.dedupe import keep_first
from playtape.operators.ordered import Ordered, ffill, ordered, running_max, running_sum, scan
from playtape.plans.lineups import NOTES, resolve_lineups
from playtape.plans.tape import counters_table
from playtape.session import cut_lineage

OPTIONAL = {"wallclock": "string", "athlete_id_3": "bigint", "home_team_spread": "double", "game_spread": "double"}
CLEAN_COLUMNS = [
    "game_id", "season", "season_type", "game_date", "home_team", "away_team", "home_team_id", "away_team_id",
    "home_final", "away_final", "home_won", "period", "play_number", "type_text", "text", "wallclock",
    "pc_seconds_left", "seconds_elapsed", "seconds_left_reg", "home_score", "away_score", "score_margin",
    "actor_team_id", "athlete_id_1", "athlete_id_2", "athlete_id_3", "scoring_play", "score_value", "home_lineup",
    "away_lineup", "lineup_ok", "home_team_fouls_period", "away_team_fouls_period", "player_fouls",
    "espn_home_spread",
]


def prepare_raw(raw: DataFrame) -> DataFrame:
    """Missing optional columns as nulls, ids in one type, working names."""
    fill = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in raw.columns}
    df = raw.withColumns(fill) if fill else raw
    ids = {c: F.col(c).cast("double").cast("bigint") for c in
           ("home_team_id", "away_team_id", "team_id", "athlete_id_1", "athlete_id_2", "athlete_id_3")}
    return df.withColumns({**ids, "game_id": F.col("game_id").cast("string")}).withColumnsRenamed(
        {"period_number": "period", "game_play_number": "play_number"}
    )


def game_teams(pbp: DataFrame) -> DataFrame:
    """Home and away team of every game that names both."""
    at = F.struct("period", "play_number")
    return pbp.groupBy("game_id").agg(
        F.min_by("home_team_id", F.when(F.col("home_team_id").isNotNull(), at)).alias("home_team_id"),
        F.min_by("away_team_id", F.when(F.col("away_team_id").isNotNull(), at)).alias("away_team_id"),
    ).where(F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull())


def official_finals(schedule: DataFrame) -> DataFrame:
    """Official final scores, one row per game."""
    known = schedule.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).select(
        F.col("game_id").cast("string").alias("game_id"), F.col("home_score").cast("double").alias("home_final"),
        F.col("away_score").cast("double").alias("away_final"),
    )
    return keep_first(known, ["game_id"], ["home_final", "away_final"])


def normal_roster(roster: DataFrame) -> DataFrame:
    ids = {c: F.col(c).cast("double").cast("bigint") for c in ("athlete_id", "team_id")}
    return roster.withColumns({**ids, "game_id": F.col("game_id").cast("string")}).where(F.col("athlete_id").isNotNull())


def monotone_scores(o: Ordered) -> Ordered:
    """Both scores carried over gaps and never falling; ``score_corrections`` counts the repaired cells."""
    o = o.with_columns({c: F.col(c).cast("string").try_cast("double") for c in ("home_score", "away_score")})
    o = scan(o, _h=ffill(F.col("home_score")), _a=ffill(F.col("away_score")))
    o = o.with_columns({"_h": F.coalesce("_h", F.lit(0.0)), "_a": F.coalesce("_a", F.lit(0.0))})
    o = scan(o, home_score=running_max(F.col("_h")), away_score=running_max(F.col("_a")))
    fixed = (F.col("home_score") != F.col("_h")).cast("int") + (F.col("away_score") != F.col("_a")).cast("int")
    o = o.with_columns({"score_corrections": fixed})
    return Ordered(o.df.drop("_h", "_a"), o.part, o.order, o.split, o.largest)


def period_fouls(df: DataFrame, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Team fouls of both sides so far in the period."""
    foul = is_team_foul(F.col("type_text"))
    counts = {
        f"{side}_team_fouls_period": running_sum(
            (foul & F.coalesce(F.col("team_id") == F.col(f"{side}_team_id"), F.lit(False))).cast("int")
        )
        for side in ("home", "away")
    }
    o = scan(ordered(df, ["game_id", "period"], ["play_number"], hot_rows, at_most), **counts)
    return o.with_columns({c: F.col(c).cast("int") for c in counts}).result()


def working_table(raw: DataFrame, roster: DataFrame, schedule: DataFrame, season: int | None = None,
                  hot_rows: int | None = None) -> DataFrame:
    """All clean columns plus the repair notes, for the games that have teams, a roster and a result."""
    pbp = prepare_raw(raw)
    people = normal_roster(roster)
    pbp = pbp.drop("home_team_id", "away_team_id").join(game_teams(pbp), "game_id")
    pbp = pbp.join(people.select("game_id").distinct(), "game_id", "left_semi")
    pbp = pbp.join(official_finals(schedule), "game_id")
    o = monotone_scores(ordered(pbp, ["game_id"], ["period", "play_number"], hot_rows))
    left = clock_seconds(F.col("clock_display_value"))
    df = period_fouls(o.result(), hot_rows, o.largest).withColumn("pc_seconds_left", left)
    df = df.withColumn("seconds_elapsed", seconds_elapsed(F.col("period"), F.col("pc_seconds_left")))
    df = resolve_lineups(df, people)
    return df.withColumns({
        "season": F.lit(season) if season is not None else F.col("season"),
        "home_team": F.col("home_team_abbrev"), "away_team": F.col("away_team_abbrev"),
        "home_won": (F.col("home_final") > F.col("away_final")).cast("int"),
        "seconds_left_reg": regulation_left(F.col("seconds_elapsed")),
        "home_score": F.col("home_score").cast("int"), "away_score": F.col("away_score").cast("int"),
        "score_margin": (F.col("home_score") - F.col("away_score")).cast("int"),
        "actor_team_id": F.col("team_id"), "espn_home_spread": F.col("home_team_spread").cast("double"),
    })


def build_pbp(raw: DataFrame, roster: DataFrame, schedule: DataFrame, season: int | None = None,
              hot_rows: int | None = None) -> DataFrame:
    """The clean play-by-play table of a season (or of all seasons when the feed carries the column)."""
    return working_table(raw, roster, schedule, season, hot_rows).select(*CLEAN_COLUMNS)


def label_disagreement(pbp: DataFrame) -> DataFrame:
    """Games whose last play-by-play score differs from the official one, and those with another winner."""
    last = pbp.groupBy("game_id", "home_final", "away_final").agg(
        F.max("home_score").alias("h"), F.max("away_score").alias("a")
    )
    differs = (F.col("h") != F.col("home_final")) | (F.col("a") != F.col("away_final"))
    flipped = (F.col("home_final") > F.col("away_final")) != (F.col("h") > F.col("a"))
    return last.agg(
        F.count_if(differs).alias("final_score_disagreement"),
        F.count_if(differs & flipped).alias("winner_would_have_flipped"),
    ).unpivot([], ["final_score_disagreement", "winner_would_have_flipped"], "metric", "value")


def quality_report(raw: DataFrame, roster: DataFrame, schedule: DataFrame, season: int | None = None) -> DataFrame:
    """(metric, value): games dropped and why, cells and lineups repaired, labels that disagree."""
    pbp, people = prepare_raw(raw), normal_roster(roster)
    teams = game_teams(pbp).withColumn("_teams", F.lit(True)).select("game_id", "_teams")
    staffed = people.select("game_id").distinct().withColumn("_roster", F.lit(True))
    scored = official_finals(schedule).select("game_id").withColumn("_score", F.lit(True))
    games = pbp.select("game_id").distinct()
    for table in (teams, staffed, scored):
        games = games.join(table, "game_id", "left")
    has_teams, has_roster = F.col("_teams").isNotNull(), F.col("_roster").isNotNull()
    dropped = counters_table(games, {
        "no_team_ids": ~has_teams, "no_roster": has_teams & ~has_roster,
        "no_official_score": has_teams & has_roster & F.col("_score").isNull(),
    })
    names = {f"note_{n}": n for n in NOTES} | {"score_corrections": "score_corrections"}
    finals = ["game_id", "home_final", "away_final", "home_score", "away_score"]
    work = cut_lineage(working_table(raw, roster, schedule, season).select(*finals, *names))  # the walk runs once
    sums = work.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in names.items()])
    repaired = sums.unpivot([], list(names.values()), "metric", "value")
    return dropped.unionByName(repaired).unionByName(label_disagreement(work))
