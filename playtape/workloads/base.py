"""Shared inputs of the registered queries.

The driver tables carry no games, so an event log shaped like play-by-play is derived from ``events``:
a user's events are a game, ``event_id`` is the play number, ``props.k`` the acting player, even players
act for the home side. The row-wise derivation is one SQL text that both engines run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtape.operators.ordered import ordered, running_sum, scan
from playtape.session import HUGE_METHOD

PLAYS_PER_TASK = 250_000
Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name with its DuckDB twin."""
    def add(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Registered(run, sql)
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; its zone-less timestamps are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, negative zero removed."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def shown(sql: str, keep: str, rnd: str, digits: int = 6) -> str:
    """Wrap a SELECT so that it returns ``keep`` as they are and ``rnd`` rounded like ``rounded``."""
    columns = keep.split() + [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in rnd.split()]
    return f"SELECT {', '.join(columns)} FROM (\n{sql}\n) shown_rows"


PARSED_ROWS = """SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
      CAST((extract(day FROM ts) - 1) * 1440 + extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INT) AS m
    FROM {events}"""

PLACED_ROWS = """
SELECT event_id AS play_number, user_id, ts, k, m, value, event_type, is_home, period,
  CAST(user_id AS STRING) AS game_id,
  2022 + CAST(user_id % 3 AS INT) AS season,
  CASE WHEN user_id % 10 = 9 THEN 3 ELSE 2 END AS season_type,
  CAST(concat(CAST(2022 + user_id % 3 AS STRING), '-0', CAST(CAST(1 + floor(((user_id * 7) % 84) / 28.0) AS INT) AS STRING),
       '-', lpad(CAST(1 + (user_id * 7) % 28 AS STRING), 2, '0')) AS DATE) AS game_date,
  home_team_id, away_team_id,
  concat('T', CAST(home_team_id AS STRING)) AS home_team,
  concat('T', CAST(away_team_id AS STRING)) AS away_team,
  CASE WHEN k % 25 = 24 THEN NULL WHEN is_home THEN home_team_id ELSE away_team_id END AS actor_team_id,
  CASE WHEN k % 25 = 24 THEN NULL ELSE CAST(k AS BIGINT) END AS athlete_id_1,
  CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN CAST((k + 2) % 100 AS BIGINT) END AS athlete_id_2,
  CAST(NULL AS BIGINT) AS athlete_id_3,
  CASE event_type
    WHEN 'click' THEN CASE k % 5 WHEN 0 THEN 'Layup Shot' WHEN 1 THEN 'Jump Shot' WHEN 2 THEN 'Free Throw - 2 of 2'
                                 WHEN 3 THEN 'Hook Shot' ELSE 'Driving Layup Shot' END
    WHEN 'purchase' THEN CASE k % 5 WHEN 0 THEN 'Dunk Shot' WHEN 1 THEN 'Jump Shot' WHEN 2 THEN 'Free Throw - 1 of 2'
                                    WHEN 3 THEN 'Free Throw - 2 of 2' ELSE 'Pullup Jump Shot' END
    WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 'Bad Pass Turnover' WHEN 1 THEN 'Lost Ball Turnover' ELSE 'Shooting Foul' END
    WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'Offensive Rebound' ELSE 'Defensive Rebound' END
    ELSE CASE k % 4 WHEN 2 THEN 'Personal Foul' WHEN 3 THEN 'Technical Foul' ELSE 'Substitution' END END AS type_text,
  CASE WHEN k = 49 THEN NULL ELSE CASE event_type
    WHEN 'click' THEN CASE k % 5 WHEN 0 THEN concat(other, ' blocks ', who, ' driving layup')
        WHEN 1 THEN concat(who, ' misses 26-foot three point jumper') WHEN 2 THEN concat(who, ' misses free throw 2 of 2')
        WHEN 3 THEN concat(who, ' misses 8-foot hook shot') ELSE concat(who, ' misses driving layup') END
    WHEN 'purchase' THEN CASE k % 5 WHEN 0 THEN concat(who, ' makes dunk (', other, ' assists)')
        WHEN 1 THEN concat(who, ' makes 25-foot three point shot (', other, ' assists)')
        WHEN 2 THEN concat(who, ' makes free throw 1 of 2') WHEN 3 THEN concat(who, ' makes free throw 2 of 2')
        ELSE concat(who, ' makes 16-foot pullup jump shot') END
    WHEN 'error' THEN CASE k % 3 WHEN 0 THEN concat(who, ' bad pass (', other, ' steals)')
        WHEN 1 THEN concat(who, ' lost ball turnover') ELSE concat(who, ' shooting foul') END
    WHEN 'view' THEN CASE k % 3 WHEN 0 THEN concat(who, ' offensive rebound') ELSE concat(who, ' defensive rebound') END
    ELSE CASE k % 4 WHEN 0 THEN concat(who, ' enters the game for ', other) WHEN 1 THEN concat('enters the game for ', who)
        WHEN 2 THEN concat(who, ' personal foul') ELSE concat(who, ' technical foul') END END END AS text,
  event_type = 'purchase' AS scoring_play,
  CASE WHEN event_type = 'purchase' AND k <> 49 THEN CASE k % 5 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 2 END ELSE 0 END AS points,
  CASE WHEN user_id % 3 = 1 AND k = 7 THEN 9 WHEN event_type = 'purchase' THEN
       CASE k % 5 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 2 END ELSE 0 END AS score_value,
  CASE WHEN period <= 4 THEN 720 - 720 * (m % 10000) / 1e4 ELSE 300 - 300 * (m - 40000) / 3.2e3 END AS pc_seconds_left,
  CASE WHEN period <= 4 THEN 720 * (period - 1) + 720 * (m % 10000) / 1e4 ELSE 2880 + 300 * (m - 40000) / 3.2e3 END AS seconds_elapsed,
  CASE WHEN period <= 4 THEN 2880 - (720 * (period - 1) + 720 * (m % 10000) / 1e4) ELSE 0 - 300 * (m - 40000) / 3.2e3 END AS seconds_left_reg,
  concat_ws(',', CAST(b AS STRING), CAST(b + 2 AS STRING), CAST(b + 4 AS STRING), CAST(b + 6 AS STRING), CAST(b + 8 AS STRING)) AS home_lineup,
  concat_ws(',', CAST(b + 1 AS STRING), CAST(b + 3 AS STRING), CAST(b + 5 AS STRING), CAST(b + 7 AS STRING), CAST(b + 9 AS STRING)) AS away_lineup,
  k % 20 <> 19 AS lineup_ok,
  CAST(k % 6 AS INT) AS home_team_fouls_period, CAST(m % 5 AS INT) AS away_team_fouls_period
FROM (
  SELECT *, CAST(least(floor(m / 1e4), 4) AS INT) + 1 AS period, k % 2 = 0 AS is_home,
    100 + user_id % 12 AS home_team_id,
    100 + (user_id % 12 + 1 + CAST(floor(user_id / 1.2e1) AS BIGINT) % 11) % 12 AS away_team_id,
    concat('P', CAST(k AS STRING)) AS who, concat('P', CAST((k + 2) % 100 AS STRING)) AS other,
    2 * (user_id % 5 + 5 * (CAST(floor(m / 5e3) AS BIGINT) % 4)) AS b
  FROM (
    {parsed}
  ) parsed
) placed
"""
PLAY_ROWS = PLACED_ROWS.replace("{parsed}", PARSED_ROWS)

GAME_ROWS = """
SELECT CAST(user_id AS STRING) AS game_id, CAST(user_id AS STRING) AS espn_game_id,
  CASE WHEN user_id % 13 = 0 THEN NULL ELSE user_id % 21 - 1.05e1 END AS home_spread_close,
  CASE WHEN user_id % 17 = 0 THEN NULL ELSE 2e1 + user_id % 40 END AS total_close,
  CASE WHEN user_id % 19 = 0 THEN NULL ELSE 5e-2 + 9e-3 * ((user_id * 37) % 100) END AS p_home_close
FROM (SELECT DISTINCT user_id FROM {events}) games
"""

RATE_ROWS = """
SELECT CAST(user_id AS STRING) AS game_id, CAST(k AS BIGINT) AS athlete_id,
  CASE WHEN k % 8 = 0 THEN NULL ELSE 25e-2 + (k % 20) / 1e2 END AS fg3_pct,
  40e-2 + (k % 30) / 1e2 AS fg2_pct, 60e-2 + (k % 35) / 1e2 AS ft_pct,
  CASE WHEN k % 11 = 0 THEN NULL ELSE (k * 7) % 900 / 1e0 END AS prior_min,
  k % 5 AS prior_gp, CASE WHEN k % 9 = 0 THEN NULL ELSE (k - 50) / 1e1 END AS rapm_net
FROM (SELECT DISTINCT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) pairs
"""

ROSTER_ROWS = """
SELECT CAST(user_id AS STRING) AS game_id, CAST(k AS BIGINT) AS athlete_id,
  CASE WHEN k % 37 = 0 THEN NULL WHEN k % 2 = 0 THEN 100 + user_id % 12
       ELSE 100 + (user_id % 12 + 1 + CAST(floor(user_id / 1.2e1) AS BIGINT) % 11) % 12 END AS team_id,
  k < 10 AS starter, CASE WHEN k % 14 = 13 THEN NULL ELSE k % 6 = 0 END AS did_not_play,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'COACH''S DECISION' WHEN 2 THEN 'Injury - knee' ELSE 'Coach decision' END AS reason
FROM (SELECT DISTINCT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) pairs
"""


def from_events(spark: SparkSession, folder: str, text: str) -> DataFrame:
    return spark.sql(text.replace("{events}", "{source}"), source=table(spark, folder, "events"))


def game_bound(spark: SparkSession, folder: str) -> int:
    """Rows of the largest game, read off the key column of the raw table; bounds every table derived per game."""
    sizes = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("n")).first().n or 0


def games_count(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "events").select("user_id").distinct().count()


def plays(spark: SparkSession, folder: str) -> DataFrame:
    """Play-by-play shaped rows with running and final scores."""
    parsed = from_events(spark, folder, PARSED_ROWS)
    # A number of its own, which adaptive execution leaves alone: it goes by compressed bytes, and plays compress well.
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, folder, "events").count() // PLAYS_PER_TASK))
    # The narrow rows are dealt, and the wide ones made where they lie: behind the exchange each reads its number from a
    # column, in front of it every text would take it out of ``props`` again.
    dealt = parsed.repartition(parts, F.col("user_id").cast("string"))
    rows = spark.sql(PLACED_ROWS.replace("{parsed}", "SELECT * FROM {dealt}"), dealt=dealt)
    o = ordered(rows, ["game_id"], ["play_number"], at_most=game_bound(spark, folder))
    o = scan(
        o,
        home_score=running_sum(F.when(F.col("is_home"), F.col("points")).otherwise(0)),
        away_score=running_sum(F.when(F.col("is_home"), F.lit(0)).otherwise(F.col("points"))),
    )
    finals = rows.groupBy("game_id").agg(
        (F.sum(F.when(F.col("is_home"), F.col("points")).otherwise(0))
         + F.max(F.when(F.col("user_id") % 7 == 0, 2).otherwise(0))).cast("double").alias("home_final"),
        F.sum(F.when(F.col("is_home"), F.lit(0)).otherwise(F.col("points"))).cast("double").alias("away_final"),
    )
    out = o.result().join(finals.repartition(parts, "game_id"), "game_id")
    return out.withColumns({
        "score_margin": F.col("home_score") - F.col("away_score"),
        "home_won": (F.col("home_final") > F.col("away_final")).cast("int"),
    })


PLAYS_SQL = f"""
plays AS (
  SELECT *, home_score - away_score AS score_margin, CAST(home_final > away_final AS INT) AS home_won FROM (
    SELECT *,
      CAST(sum(CASE WHEN is_home THEN points ELSE 0 END) OVER running AS BIGINT) AS home_score,
      CAST(sum(CASE WHEN is_home THEN 0 ELSE points END) OVER running AS BIGINT) AS away_score,
      CAST(sum(CASE WHEN is_home THEN points ELSE 0 END) OVER (PARTITION BY game_id) AS DOUBLE)
        + CASE WHEN user_id % 7 = 0 THEN 2 ELSE 0 END AS home_final,
      CAST(sum(CASE WHEN is_home THEN 0 ELSE points END) OVER (PARTITION BY game_id) AS DOUBLE) AS away_final
    FROM ({PLAY_ROWS.replace('{events}', 'events')}) play_rows
    WINDOW running AS (PARTITION BY game_id ORDER BY play_number ROWS UNBOUNDED PRECEDING)
  ) scored
)"""
ODDS_SQL = f"odds AS ({GAME_ROWS.replace('{events}', 'events')})"
RATES_SQL = f"rates AS ({RATE_ROWS.replace('{events}', 'events')})"
ROSTERS_SQL = f"rosters AS ({ROSTER_ROWS.replace('{events}', 'events')})"


def odds(spark: SparkSession, folder: str) -> DataFrame:
    return from_events(spark, folder, GAME_ROWS).drop("game_id")


def rates(spark: SparkSession, folder: str) -> DataFrame:
    return from_events(spark, folder, RATE_ROWS)


def rosters(spark: SparkSession, folder: str) -> DataFrame:
    return from_events(spark, folder, ROSTER_ROWS)


def orders_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their date as a day, their year, and the price in whole cents."""
    return table(spark, folder, "orders").withColumns({
        "day": F.to_date("o_orderdate"),
        "season": F.year("o_orderdate"),
        "cents": F.round(F.col("o_totalprice") * 100).cast("bigint"),
    })


ORDERS_SQL = """
dated AS (SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(extract(year FROM o_orderdate) AS INT) AS season,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""
