"""The raw feed to the clean table, and the live forms, on the play view."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtape.plans import pbp
from playtape.plans.lineups import ACTORS, roster_sides
from playtape.session import cut_lineage, ensure_checkpoint_dir, shuffle_width
from playtape.streaming import live
from playtape.workloads.base import PLAYS_SQL, plays, query, rosters, table
from playtape.workloads.boxes import STRICT
from playtape.workloads.walk_twin import FOULS_SQL, walk_sql

TEAM_FOUL = "type_text IN ('Shooting Foul', 'Personal Foul')"

# -- raw feed ------------------------------------------------------------------------------------


def _raw(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feed, roster and schedule: scores with gaps and drops, a malformed clock, games without a result."""
    p = cut_lineage(plays(spark, folder))
    k = F.col("k")
    face = F.when(k % 13 == 0, "--").otherwise(F.concat((k % 12).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0")))
    raw = p.select(
        "game_id", "season", "season_type", "game_date", "home_team_id", "away_team_id", F.col("home_team").alias("home_team_abbrev"),
        F.col("away_team").alias("away_team_abbrev"), F.col("period").alias("period_number"), F.col("play_number").alias("game_play_number"),
        face.alias("clock_display_value"), "type_text", "text", F.col("actor_team_id").alias("team_id"), "athlete_id_1", "athlete_id_2",
        F.when(k % 7 != 0, F.col("home_score") - F.when(k % 11 == 0, 3).otherwise(0)).alias("home_score"), "away_score", "scoring_play", "score_value")
    schedule = p.groupBy("game_id").agg(
        F.when(F.max(F.col("user_id") % 9) != 0, F.max("home_final")).alias("home_score"), F.max("away_final").alias("away_score"))
    return raw, rosters(spark, folder), schedule


CLEAN = f"""{PLAYS_SQL},
kept AS (SELECT *, CASE WHEN k % 7 <> 0 THEN home_score - CASE WHEN k % 11 = 0 THEN 3 ELSE 0 END END AS raw_home FROM plays WHERE user_id % 9 <> 0),
seen AS (SELECT *, coalesce(last_value(raw_home IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY play_number ROWS UNBOUNDED PRECEDING), 0) AS seen_home FROM kept),
fixed AS (SELECT *, CAST(max(seen_home) OVER (PARTITION BY game_id ORDER BY play_number ROWS UNBOUNDED PRECEDING) AS INT) AS fixed_home FROM seen),
{FOULS_SQL}"""


@query("build_pbp", f"""WITH RECURSIVE {CLEAN}, {walk_sql('kept')},
timed AS (SELECT *, CASE WHEN k % 13 <> 0 THEN CAST((k % 12) * 60 + k % 60 AS DOUBLE) END AS left_in FROM fixed),
clocked AS (SELECT *, CASE WHEN period <= 4 THEN 720 * period ELSE 2880 + 300 * (period - 4) END - left_in AS gone FROM timed)
SELECT f.game_id, f.season, f.season_type, f.game_date, f.home_team, f.away_team, f.home_team_id, f.away_team_id, f.home_final, f.away_final, CAST(f.home_final > f.away_final AS INT) AS home_won,
  f.period, f.play_number, f.type_text, f.text, CAST(NULL AS VARCHAR) AS wallclock, left_in AS pc_seconds_left, gone AS seconds_elapsed, 2880 - gone AS seconds_left_reg,
  f.fixed_home AS home_score, CAST(f.away_score AS INT) AS away_score, CAST(f.fixed_home - f.away_score AS INT) AS score_margin, f.actor_team_id, f.athlete_id_1, f.athlete_id_2,
  CAST(NULL AS BIGINT) AS athlete_id_3, f.scoring_play, f.score_value, l.home_lineup, l.away_lineup, l.lineup_ok,
  CAST(sum(CASE WHEN {TEAM_FOUL} AND actor_team_id = home_team_id THEN 1 ELSE 0 END) OVER w AS INT) AS home_team_fouls_period,
  CAST(sum(CASE WHEN {TEAM_FOUL} AND actor_team_id = away_team_id THEN 1 ELSE 0 END) OVER w AS INT) AS away_team_fouls_period,
  coalesce(t.player_fouls, '') AS player_fouls, CAST(NULL AS DOUBLE) AS espn_home_spread
FROM clocked f JOIN lineups l USING (play_number) LEFT JOIN tally t USING (play_number) WINDOW w AS (PARTITION BY f.game_id, f.period ORDER BY f.play_number ROWS UNBOUNDED PRECEDING)""")
def _(spark, folder):
    return pbp.build_pbp(*_raw(spark, folder))


@query("official_labels", f"""WITH {CLEAN}, last AS (SELECT game_id, max(fixed_home) AS h, max(away_score) AS a, max(home_final) AS hf, max(away_final) AS af FROM fixed GROUP BY 1)
SELECT 'final_score_disagreement' AS metric, CAST(count(*) FILTER (WHERE h <> hf OR a <> af) AS BIGINT) AS value FROM last UNION ALL
SELECT 'winner_would_have_flipped', CAST(count(*) FILTER (WHERE (h <> hf OR a <> af) AND (hf > af) <> (h > a)) AS BIGINT) FROM last""")
def _(spark, folder):
    return pbp.label_disagreement(pbp.build_pbp(*_raw(spark, folder)))


_NOTES = ["carried_forward", "unresolved_period", "sub_no_side", "sub_out_not_on_court", "sub_in_already_on_court", "repaired_short_lineup"]


@query("quality_report", f"""WITH RECURSIVE {CLEAN}, {walk_sql('kept')},
games AS (SELECT game_id, count(*) FILTER (WHERE user_id % 9 = 0) > 0 AS unscored FROM plays GROUP BY 1),
noted AS ({' UNION ALL '.join(f"SELECT '{n}' AS metric, CAST(coalesce(sum({n}), 0) AS BIGINT) AS value FROM lineups" for n in _NOTES)}),
last AS (SELECT game_id, max(fixed_home) AS h, max(away_score) AS a, max(home_final) AS hf, max(away_final) AS af FROM fixed GROUP BY 1)
SELECT 'no_team_ids' AS metric, CAST(0 AS BIGINT) AS value UNION ALL SELECT 'no_roster', 0 UNION ALL SELECT 'no_official_score', CAST(count(*) FILTER (WHERE unscored) AS BIGINT) FROM games
UNION ALL SELECT * FROM noted UNION ALL SELECT 'score_corrections', CAST(count(*) FILTER (WHERE fixed_home <> seen_home) AS BIGINT) FROM fixed
UNION ALL SELECT 'final_score_disagreement', CAST(count(*) FILTER (WHERE h <> hf OR a <> af) AS BIGINT) FROM last
UNION ALL SELECT 'winner_would_have_flipped', CAST(count(*) FILTER (WHERE (h <> hf OR a <> af) AND (hf > af) <> (h > a)) AS BIGINT) FROM last""")
def _(spark, folder):
    return pbp.quality_report(*_raw(spark, folder))


# -- live forms: the events file as a stream, drained with availableNow --------------------------


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    return live.landed_stream(spark, f"{folder}/{name}.parquet*", schema, "parquet")


def _own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for every run, so that no run meets another's progress."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _drained(df: DataFrame, name: str) -> DataFrame:
    """Run the stream to its end into a table of its own and return it."""
    folder = _own_folder(df.sparkSession, name)
    live.land(df, f"{folder}/out", f"{folder}/progress").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


@query("stream_upsert", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, folder):
    own = _own_folder(spark, "upsert")
    live.append_versions(_stream(spark, folder, "orders").select("o_custkey", "o_orderkey"), f"{own}/out", f"{own}/progress").awaitTermination()
    return live.latest_version(spark, f"{own}/out", ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("stream_landing", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, folder):
    return _drained(_stream(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "landing")


@query("stream_dedupe", "SELECT user_id AS trade_id FROM events GROUP BY 1")
def _(spark, folder):
    trades = _stream(spark, folder, "events").select(F.col("user_id").alias("trade_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    return _drained(live.dedupe_trades(trades, lateness="40 days"), "dedupe").select("trade_id")


@query("stream_trades_per_minute", """SELECT user_id AS game_id, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, CAST(count(*) AS BIGINT) AS trades, round(sum(value), 2) AS contracts
FROM events GROUP BY ALL""")
def _(spark, folder):
    trades = _stream(spark, folder, "events").select(
        F.col("user_id").alias("game_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("count_fp"))
    own = _own_folder(spark, "minutes")
    out = live.drained_windows(live.trades_per_minute(trades), f"{own}/out", f"{own}/progress", ["game_id", "minute"])
    return out.select("game_id", F.col("minute").cast("timestamp_ntz").alias("minute"), "trades", F.round("contracts", 2).alias("contracts"))


def _rocksdb(spark: SparkSession, run) -> DataFrame:
    """Run a stream whose state needs RocksDB, and leave the session's provider as it was."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, live.ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


@query("stream_lineups", f"""WITH RECURSIVE {PLAYS_SQL}, {walk_sql('plays')}, {FOULS_SQL}
SELECT play_number, home_lineup, away_lineup, lineup_ok, coalesce(player_fouls, '') AS player_fouls, 0 AS late FROM lineups LEFT JOIN tally USING (play_number)""")
def _(spark, folder):
    """The plays land out of order: odd ones in the first trigger, even ones in the second, then the feed's heartbeat."""
    own, width = _own_folder(spark, "lineups"), shuffle_width(spark)
    p = plays(spark, folder).select(
        "game_id", "period", "play_number", "type_text", "text", F.col("actor_team_id").alias("team_id"), "home_team_id", "away_team_id",
        *ACTORS, F.col("ts").cast("timestamp").alias("at"))
    p = cut_lineage(p)
    teams = p.groupBy("game_id").agg(F.max("home_team_id").alias("home_team_id"), F.max("away_team_id").alias("away_team_id"))
    sides = cut_lineage(roster_sides(rosters(spark, folder), teams))
    # A heartbeat is a row of no game, a year on: it moves the watermark past every play.
    beat = p.agg((F.max("at") + F.expr("INTERVAL 365 DAYS")).alias("at")).select(
        *[F.col(c) if c == "at" else F.lit("heartbeat" if c == "game_id" else None).cast(p.schema[c].dataType).alias(c) for c in p.columns])
    for part in (p.where("play_number % 2 = 1"), p.where("play_number % 2 = 0"), beat.fillna(0, ["period", "play_number"])):
        part.repartition(width).write.mode("append").parquet(f"{own}/in")
    landed = live.landed_stream(spark, f"{own}/in", p.schema, "parquet", width)
    out = _rocksdb(spark, lambda: _drained(live.live_lineups(landed, sides, "40 days", "41 days"), "lineups"))
    return out.where("game_id <> 'heartbeat'").select("play_number", "home_lineup", "away_lineup", "lineup_ok", "player_fouls", "late")


@query("stream_possession", f"WITH {STRICT} SELECT play_number, possession, poss_known FROM states")
def _(spark, folder):
    from playtape.workloads.base import PLAY_ROWS
    rows = spark.sql(PLAY_ROWS.replace("{events}", "{source}"), source=_stream(spark, folder, "events"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = _rocksdb(spark, lambda: _drained(live.live_possession(rows), "possession"))
    return out.select("play_number", "possession", "poss_known")


@query("stream_fills", """SELECT s.user_id AS game_id, s.event_id AS play_number, arg_min(p.value, (p.ts, p.value)) AS px_home
FROM events s JOIN events p ON s.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts >= s.ts + INTERVAL 60 SECOND AND p.ts <= s.ts + INTERVAL 86460 SECOND
WHERE s.event_type <> 'purchase' GROUP BY ALL""")
def _(spark, folder):
    def split(ev):
        ev = ev.withColumn("at", F.col("ts").cast("timestamp"))
        states = ev.where("event_type <> 'purchase'").select(F.col("user_id").alias("game_id"), F.col("event_id").alias("play_number"), F.col("at").alias("state_time"))
        prints = ev.where("event_type = 'purchase'").select(F.col("user_id").alias("game_id"), F.col("at").alias("print_time"), F.col("value").alias("px_home"), (100 - F.col("value")).alias("px_away"))
        return states, prints

    streamed = _rocksdb(spark, lambda: _drained(live.live_fills(*split(_stream(spark, folder, "events")), 60, 86400), "fills"))
    return live.complete_fills(streamed, *split(table(spark, folder, "events")), 60, 86400).select("game_id", "play_number", "px_home")
