"""Closing lines out of landed snapshot documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.fixed_values import FULL_TEAM_NAMES
from playtape.functions.clock import floor_minutes, floor_to_grid, instant
from playtape.functions.numeric import american_probability, devigged
from playtape.functions.text import lookup
from playtape.operators.asof import asof_backward, match_within
from playtape.operators.dedupe import keep_first, priority_union
from playtape.operators.quantiles import exact_quantiles
from playtape.operators.filters import drop_exhibitions

LINE_COLUMNS = [
    "season", "game_date", "home_team", "away_team", "espn_game_id", "home_close_ml", "away_close_ml",
    "p_home_close", "overround_close", "line_source", "snapshot_lag_seconds",
]


def explode_snapshots(snapshots: DataFrame, market: str | None = None, book: str | None = None) -> DataFrame:
    """One row per (snapshot, event, book, market, outcome) in document order, team names mapped to codes."""
    events = snapshots.select(
        F.col("timestamp").alias("snapshot_time"), F.posexplode("data").alias("event_pos", "ev"),
        *[c for c in ("source_file",) if c in snapshots.columns],
    )
    books = events.select("*", F.posexplode_outer("ev.bookmakers").alias("book_pos", "bk"))
    markets = books.select("*", F.posexplode_outer("bk.markets").alias("market_pos", "mk"))
    if book:
        markets = markets.where(F.col("bk.key") == book)
    if market:
        markets = markets.where(F.col("mk.key") == market)
    outcomes = markets.select("*", F.posexplode_outer("mk.outcomes").alias("outcome_pos", "oc"))
    return outcomes.select(
        instant(F.col("snapshot_time")).alias("snapshot_time"),
        "event_pos", "book_pos", "market_pos", "outcome_pos",
        F.col("ev.id").alias("odds_api_event_id"),
        F.col("ev.home_team").alias("home_name"), F.col("ev.away_team").alias("away_name"),
        lookup(F.col("ev.home_team"), FULL_TEAM_NAMES).alias("home_team"),
        lookup(F.col("ev.away_team"), FULL_TEAM_NAMES).alias("away_team"),
        instant(F.col("ev.commence_time")).alias("commence_time_api"),
        F.col("bk.key").alias("book"), F.col("mk.key").alias("market"),
        F.col("oc.name").alias("outcome"), lookup(F.col("oc.name"), FULL_TEAM_NAMES).alias("outcome_team"),
        F.col("oc.price").alias("price"), F.col("oc.point").alias("point"),
        *[c for c in ("source_file",) if c in snapshots.columns],
    )


def unmapped_names(snapshots: DataFrame) -> DataFrame:
    """Team names the fixed table does not know, for the audit."""
    names = snapshots.select(F.explode("data").alias("ev")).select(
        F.explode(F.array("ev.home_team", "ev.away_team")).alias("name")
    ).distinct()
    return names.where(F.col("name").isNotNull() & lookup(F.col("name"), FULL_TEAM_NAMES).isNull())


def moneyline_quotes(snapshots: DataFrame, book: str = "pinnacle") -> DataFrame:
    """Both prices of each event in each snapshot, the last named price winning; one-sided events drop out."""
    rows = explode_snapshots(snapshots, "h2h", book).where(
        F.col("home_team").isNotNull() & F.col("away_team").isNotNull() & F.col("price").isNotNull()
    )
    at = F.struct("book_pos", "market_pos", "outcome_pos")
    home = F.when(F.col("outcome_team") == F.col("home_team"), at)
    away = F.when(F.col("outcome_team") == F.col("away_team"), at)
    quotes = rows.groupBy("snapshot_time", "event_pos", "home_team", "away_team", "commence_time_api").agg(
        F.max_by("price", home).alias("home_close_ml"), F.max_by("price", away).alias("away_close_ml")
    )
    return quotes.where(F.col("home_close_ml").isNotNull() & F.col("away_close_ml").isNotNull())


def load_schedule(schedule: DataFrame) -> DataFrame:
    """Scheduled games between real teams with their UTC start."""
    named = schedule.withColumnsRenamed({"home_abbreviation": "home_team", "away_abbreviation": "away_team"})
    start = F.col("game_date_time")
    if dict(schedule.dtypes)["game_date_time"] == "string":
        start = instant(start)
    named = drop_exhibitions(named).withColumns({
        "game_id": F.col("game_id").cast("string"), "commence_time": start.cast("timestamp")
    })
    return named.where(F.col("commence_time").isNotNull())


def closing_moneyline(schedule: DataFrame, quotes: DataFrame, max_lag_seconds: float = 1800,
                      source: str = "pinnacle", hot_rows: int | None = None) -> DataFrame:
    """Latest quote at or before each tip, devigged; quotes staler than the limit are dropped."""
    hit = asof_backward(
        schedule, quotes, ["home_team", "away_team"], "commence_time", "snapshot_time",
        ["home_close_ml", "away_close_ml"], ["event_pos"], matched_ts="snapshot_time", hot_rows=hot_rows,
    )
    lag = (F.unix_micros("commence_time") - F.unix_micros("snapshot_time")) / 1e6
    p, overround = devigged(
        american_probability(F.col("home_close_ml")), american_probability(F.col("away_close_ml"))
    )
    return hit.withColumn("snapshot_lag_seconds", lag).where(F.col("snapshot_lag_seconds") <= max_lag_seconds).select(
        "season", F.col("game_date").cast("date").alias("game_date"), "home_team", "away_team",
        F.col("game_id").alias("espn_game_id"), "home_close_ml", "away_close_ml", p.alias("p_home_close"),
        overround.alias("overround_close"), "snapshot_time", "commence_time", "snapshot_lag_seconds",
        F.lit(source).alias("line_source"),
    )


def moneyline_audit(schedule: DataFrame, quotes: DataFrame, max_lag_seconds: float = 1800) -> DataFrame:
    """(metric, value): games without a quote before tip, and with one that is too old."""
    hit = asof_backward(schedule, quotes, ["home_team", "away_team"], "commence_time", "snapshot_time",
                        ["home_close_ml"], ["event_pos"], matched_ts="snapshot_time")
    lag = (F.unix_micros("commence_time") - F.unix_micros("snapshot_time")) / 1e6
    return hit.agg(
        F.count_if(F.col("snapshot_time").isNull()).alias("no_snapshot_before_tip"),
        F.count_if(lag > max_lag_seconds).alias("too_stale"),
    ).unpivot([], ["no_snapshot_before_tip", "too_stale"], "metric", "value")


def _snap_key(column: str, minutes: int) -> Column:
    return F.date_trunc("second", floor_minutes(F.col(column), minutes))


def _first_book(rows: DataFrame, key: list[str]) -> DataFrame:
    return keep_first(rows, key, ["book_pos", "market_pos"])


def spread_quotes(snapshots: DataFrame, book: str | None = None) -> DataFrame:
    """First quoting book's spread per event and snapshot; a missing side is the other one mirrored."""
    rows = explode_snapshots(snapshots, "spreads", book).where(
        F.col("home_team").isNotNull() & F.col("away_team").isNotNull()
    )
    at = F.col("outcome_pos")
    is_home = F.when(F.col("outcome_team") == F.col("home_team"), at)
    is_away = F.when(F.col("outcome_team") == F.col("away_team"), at)
    key = ["snapshot_time", "event_pos", "odds_api_event_id", "home_team", "away_team", "commence_time_api",
           "book_pos", "book", "market_pos"]
    sides = rows.groupBy(*key).agg(
        F.max_by("point", is_home).alias("home_pt"), F.max_by("point", is_away).alias("away_pt"),
        F.max_by("price", is_home).alias("home_spread_price"), F.max_by("price", is_away).alias("away_spread_price"),
    ).withColumns({
        "home_spread_close": F.coalesce(F.col("home_pt"), -F.col("away_pt")),
        "away_spread_close": F.coalesce(F.col("away_pt"), -F.col("home_pt")),
    }).where(F.col("home_spread_close").isNotNull()).drop("home_pt", "away_pt")
    return _first_book(sides, ["snapshot_time", "event_pos"])


def total_quotes(snapshots: DataFrame, book: str | None = None) -> DataFrame:
    """First quoting book's total per event and snapshot; the point from Over, else from Under."""
    rows = explode_snapshots(snapshots, "totals", book).where(
        F.col("home_team").isNotNull() & F.col("away_team").isNotNull()
    )
    at = F.col("outcome_pos")
    over, under = F.when(F.col("outcome") == "Over", at), F.when(F.col("outcome") == "Under", at)
    key = ["snapshot_time", "event_pos", "odds_api_event_id", "home_team", "away_team", "commence_time_api",
           "book_pos", "book", "market_pos"]
    sides = rows.groupBy(*key).agg(
        F.max_by("point", over).alias("_over"), F.max_by("point", under).alias("_under"),
        F.max_by("price", over).alias("over_price"), F.max_by("price", under).alias("under_price"),
    ).withColumn("total_close", F.coalesce("_over", "_under")).where(F.col("total_close").isNotNull())
    return _first_book(sides.drop("_over", "_under"), ["snapshot_time", "event_pos"])


def _close_at_moneyline(games: DataFrame, quotes: DataFrame, snap_round: int, tol_minutes: float) -> DataFrame:
    keyed_games = games.withColumn("_snap", _snap_key("snapshot_time", snap_round))
    keyed_quotes = quotes.withColumn("_snap", _snap_key("snapshot_time", snap_round)).drop("snapshot_time")
    return match_within(
        keyed_games, keyed_quotes, ["_snap", "home_team", "away_team"], "espn_game_id", "commence_time",
        "commence_time_api", ["event_pos"], tol_minutes * 60,
    ).drop("_snap", "event_pos", "book_pos", "market_pos", "commence_time_api")


def closing_spread(games: DataFrame, snapshots: DataFrame, snap_round: int = 0, tol_minutes: float = 90,
                   book: str | None = None) -> DataFrame:
    """Spread of every game in the snapshot that closed its moneyline."""
    out = _close_at_moneyline(games, spread_quotes(snapshots, book), snap_round, tol_minutes)
    return out.select("espn_game_id", "season", "game_date", "home_team", "away_team", "snapshot_time",
                      "home_spread_close", "away_spread_close", "home_spread_price", "away_spread_price", "book",
                      "odds_api_event_id")


def closing_total(games: DataFrame, snapshots: DataFrame, snap_round: int = 5, tol_minutes: float = 90,
                  book: str | None = None) -> DataFrame:
    """Total of every game in the snapshot that closed its moneyline."""
    out = _close_at_moneyline(games, total_quotes(snapshots, book), snap_round, tol_minutes)
    return out.select("espn_game_id", "season", "game_date", "home_team", "away_team", "snapshot_time",
                      "total_close", "over_price", "under_price", "book", "odds_api_event_id")


def unresolved_games(games: DataFrame, resolved: DataFrame) -> DataFrame:
    return games.join(resolved.select("espn_game_id").distinct(), "espn_game_id", "left_anti")


def snapshot_grid(snapshots: DataFrame, default_step: int = 300) -> DataFrame:
    """Spacing (snapped to 300 or 600 seconds) and phase (whole minutes) of each snapshot's grid."""
    now = F.unix_seconds(instant(F.col("timestamp")))

    def gap(c: str) -> Column:
        distance = F.abs(F.unix_seconds(instant(F.col(c))) - now)
        return F.when(distance > 0, distance)

    raw = F.coalesce(F.least(gap("previous_timestamp"), gap("next_timestamp")), F.lit(default_step))
    step = F.when(F.abs(raw - 300) <= F.abs(raw - 600), 300).otherwise(600)
    step = F.when(now.isNull(), F.lit(default_step)).otherwise(step)
    phase = F.coalesce(F.pmod((F.rint(F.pmod(now, step) / 60.0) * 60).cast("int"), step), F.lit(0))
    return snapshots.withColumns({"step": step.cast("int"), "phase": phase.cast("int")})


def snapshot_plan(schedule: DataFrame, grids: DataFrame | None = None, lead_seconds: int = 60,
                  default_step: int = 300) -> DataFrame:
    """Requested snapshot second of every game: start minus lead, floored to the season's grid."""
    target = F.unix_seconds("commence_time") - lead_seconds
    planned = schedule.withColumn("target_unix", target)
    if grids is None:
        return planned.withColumn("snapshot_unix", floor_to_grid(F.col("target_unix"), default_step, 0))
    planned = planned.join(F.broadcast(grids.select("season", "step", "phase")), "season", "left")  # one row per season
    step, phase = F.coalesce("step", F.lit(default_step)), F.coalesce("phase", F.lit(0))
    return planned.withColumn("snapshot_unix", floor_to_grid(F.col("target_unix"), step, phase)).drop("step", "phase")


def plan_summary(planned: DataFrame, landed: DataFrame | None = None) -> DataFrame:
    """Games, distinct snapshots and those still missing, per season."""
    if landed is not None:
        have = landed.select(F.col("snapshot_unix")).distinct().withColumn("_have", F.lit(True))
        planned = planned.join(have, "snapshot_unix", "left")
        missing = F.when(F.col("_have").isNull(), F.col("snapshot_unix"))
    else:
        missing = F.col("snapshot_unix")
    return planned.groupBy("season").agg(
        F.count(F.lit(1)).alias("games"), F.countDistinct("snapshot_unix").alias("snapshots"),
        F.countDistinct(missing).alias("to_fetch"),
    )


def schedule_complete(schedule: DataFrame, lines: DataFrame, key: str = "espn_game_id",
                      price: str = "p_home_close") -> DataFrame:
    """Every scheduled game, with its line where there is one and a flag."""
    own = [c for c in lines.columns if c not in schedule.columns]
    out = schedule.join(lines.select(key, *own), key, "left")
    return out.withColumn("has_line", F.col(price).isNotNull())


def merge_lines(preferred: DataFrame, other: DataFrame, schedule: DataFrame) -> DataFrame:
    """Preferred source per game, else the other one, over the complete schedule."""
    def usable(df: DataFrame) -> DataFrame:
        if "snapshot_lag_seconds" not in df.columns:
            df = df.withColumn("snapshot_lag_seconds", F.lit(None).cast("double"))
        df = df.withColumn("espn_game_id", F.col("espn_game_id").cast("string"))
        return df.where(F.col("espn_game_id").isNotNull() & F.col("p_home_close").isNotNull()).select(*LINE_COLUMNS)

    best = priority_union([usable(preferred), usable(other)], ["espn_game_id"], ["p_home_close"])
    games = drop_exhibitions(
        schedule.withColumnsRenamed({"home_abbreviation": "home_team", "away_abbreviation": "away_team"})
    ).select(F.col("game_id").cast("string").alias("espn_game_id"), "season",
             F.col("game_date").cast("date").alias("game_date"), "home_team", "away_team")
    return schedule_complete(games, best)


def coverage_by_season(lines: DataFrame, source: str = "line_source", price: str | None = None) -> DataFrame:
    """Scheduled, priced, unpriced games and the covered share per season; with ``price`` also its least, median and greatest."""
    out = lines.groupBy("season").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col(source) == "pinnacle").alias("preferred"),
        F.count_if(F.col(source).isNotNull() & (F.col(source) != "pinnacle")).alias("other"),
        F.count_if(~F.col("has_line")).alias("no_line"),
        (F.count_if("has_line") / F.count(F.lit(1))).alias("covered"),
    )
    if price is None:
        return out
    ranges = exact_quantiles(lines, price, [0.0, 0.5, 1.0], ["line_min", "line_median", "line_max"], ["season"])
    return out.join(ranges, "season", "left")
