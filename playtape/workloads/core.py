"""Ordered scans, dedupe, sets and filters on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtape.functions import sql
from playtape.functions.clock import floor_minutes, floor_to_grid
from playtape.operators import dedupe, filters
from playtape.operators.ordered import (
    bfill,
    ffill,
    fill_both,
    fixed_running_max,
    lag,
    ordered,
    prior_sum,
    run_id,
    running_sum,
    scan,
)
from playtape.operators.quantiles import describe
from playtape.plans.backtest import expanding_zscore
from playtape.plans.rates import every_nth_date, prior_totals
from playtape.session import ensure_checkpoint_dir
from playtape.sources import io, schemas
from playtape.workloads.base import ORDERS_SQL, PLAYS_SQL, game_bound, orders_by_year, plays, query, rounded, shown, table


def _events(spark, folder):
    return table(spark, folder, "events")


CLICK = "CASE WHEN event_type = 'click' THEN value END"


@query("ffill", f"""SELECT event_id, last_value({CLICK} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS last_click FROM events""")
def _(spark, folder):
    o = ordered(_events(spark, folder), ["user_id"], ["ts", "event_id"])
    value = F.when(F.col("event_type") == "click", F.col("value"))
    return scan(o, last_click=ffill(value)).result().select("event_id", "last_click")


@query("fill_both", f"""SELECT event_id, coalesce(
    last_value({CLICK} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
    first_value({CLICK} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM events""")
def _(spark, folder):
    df = _events(spark, folder).withColumn("click", F.when(F.col("event_type") == "click", F.col("value")))
    return fill_both(ordered(df, ["user_id"], ["ts", "event_id"]), "click", "filled").result().select("event_id", "filled")


@query("bfill", f"""SELECT event_id, first_value({CLICK} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_click FROM events""")
def _(spark, folder):
    o = ordered(_events(spark, folder), ["user_id"], ["ts", "event_id"])
    return scan(o, next_click=bfill(F.when(F.col("event_type") == "click", F.col("value")))).result().select(
        "event_id", "next_click")


@query("running_max_corrections", """
WITH f AS (SELECT *, coalesce(last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS seen FROM events),
g AS (SELECT *, max(seen) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS fixed FROM f)
SELECT user_id, round(max(fixed), 6) AS top, CAST(count(*) FILTER (WHERE fixed <> seen) AS BIGINT) AS corrected FROM g GROUP BY user_id""")
def _(spark, folder):
    df = _events(spark, folder).withColumn("level", F.when(F.col("event_type") != "error", F.col("value")))
    o = fixed_running_max(ordered(df, ["user_id"], ["event_id"]), "level", "fixed")
    return rounded(o.result().groupBy("user_id").agg(
        F.max("fixed").alias("top"), F.count_if("fixed_corrected").alias("corrected")))


@query("running_side_sum", f"""
WITH {PLAYS_SQL}
SELECT play_number,
  CAST(sum(CASE WHEN is_home AND event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS home_makes,
  CAST(sum(CASE WHEN NOT is_home AND event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS away_makes,
  round(sum(CASE WHEN is_home THEN value ELSE 0 END) OVER w, 4) AS home_value
FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_number ROWS UNBOUNDED PRECEDING)""")
def _(spark, folder):
    made, home = F.col("event_type") == "purchase", F.col("is_home")
    o = scan(
        ordered(plays(spark, folder), ["game_id"], ["play_number"], at_most=game_bound(spark, folder)),
        home_makes=running_sum((made & home).cast("bigint")), away_makes=running_sum((made & ~home).cast("bigint")),
        home_value=running_sum(F.when(home, F.col("value")).otherwise(0.0)),
    )
    return rounded(o.result().select("play_number", "home_makes", "away_makes", "home_value"), 4)


@query("prior_totals", f"""WITH {ORDERS_SQL}
SELECT o_orderkey, round(coalesce(sum(CAST(cents AS DOUBLE)) OVER w, 0), 2) AS prior_cents, CAST(count(*) OVER w AS BIGINT) AS prior_gp
FROM dated WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, folder):
    df = prior_totals(orders_by_year(spark, folder), ["o_custkey"], ["day", "o_orderkey"], ["cents"])
    return rounded(df.select("o_orderkey", "prior_cents", "prior_gp"), 2)


@query("prior_totals_by_season", f"""WITH {ORDERS_SQL}
SELECT o_orderkey, round(coalesce(sum(CAST(cents AS DOUBLE)) OVER w, 0), 2) AS prior_cents, CAST(count(*) OVER w AS BIGINT) AS games_played
FROM dated WINDOW w AS (PARTITION BY season, o_custkey ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, folder):
    df = prior_totals(orders_by_year(spark, folder), ["season", "o_custkey"], ["day", "o_orderkey"], ["cents"],
                      count="games_played")
    return rounded(df.select("o_orderkey", "prior_cents", "games_played"), 2)


@query("run_id", f"""WITH {PLAYS_SQL},
l AS (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS n FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_number))
SELECT play_number, CAST(sum(CASE WHEN n = 1 OR event_type IS DISTINCT FROM was THEN 1 ELSE 0 END)
  OVER (PARTITION BY game_id ORDER BY play_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM l""")
def _(spark, folder):
    o = run_id(ordered(plays(spark, folder), ["game_id"], ["play_number"], at_most=game_bound(spark, folder)), ["event_type"])
    return o.result().select("play_number", "run_id")


@query("lag_with_default", """SELECT event_id, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0.0) AS before FROM events""")
def _(spark, folder):
    o = scan(ordered(_events(spark, folder), ["user_id"], ["event_id"]), before=lag(F.col("value"), F.lit(0.0)))
    return o.result().select("event_id", "before")


@query("running_count_reset", f"""WITH {PLAYS_SQL}
SELECT play_number, CAST(sum(CASE WHEN type_text IN ('Shooting Foul', 'Personal Foul') AND actor_team_id = home_team_id THEN 1 ELSE 0 END) OVER w AS INT) AS home_team_fouls_period,
  CAST(sum(CASE WHEN type_text IN ('Shooting Foul', 'Personal Foul') AND actor_team_id = away_team_id THEN 1 ELSE 0 END) OVER w AS INT) AS away_team_fouls_period
FROM plays WINDOW w AS (PARTITION BY game_id, period ORDER BY play_number ROWS UNBOUNDED PRECEDING)""")
def _(spark, folder):
    from playtape.plans.pbp import period_fouls
    df = plays(spark, folder).withColumn("team_id", F.col("actor_team_id"))
    return period_fouls(df, at_most=game_bound(spark, folder)).select("play_number", "home_team_fouls_period", "away_team_fouls_period")


@query("running_count_by_player", f"""WITH {PLAYS_SQL}
SELECT play_number, athlete_id_1 AS athlete_id, CAST(count(*) OVER (PARTITION BY game_id, athlete_id_1 ORDER BY play_number
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fouls
FROM plays WHERE type_text IN ('Shooting Foul', 'Personal Foul') AND actor_team_id IS NOT NULL""")
def _(spark, folder):
    from playtape.functions.text import is_personal_foul
    from playtape.operators.ordered import row_number
    fouls = plays(spark, folder).where(is_personal_foul(F.col("type_text")) & F.col("actor_team_id").isNotNull())
    o = scan(ordered(fouls, ["game_id", "athlete_id_1"], ["play_number"]), fouls=row_number())
    return o.result().select("play_number", F.col("athlete_id_1").alias("athlete_id"), "fouls")


@query("keep_first", """SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS n FROM events) WHERE n = 1""")
def _(spark, folder):
    return dedupe.keep_first(_events(spark, folder), ["user_id", "event_type"], ["value", "event_id"]).select(
        "user_id", "event_type", "event_id", "value")


@query("keep_last", """SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def _(spark, folder):
    return dedupe.keep_last(_events(spark, folder), ["user_id", "event_type"], ["event_id"]).select(
        "user_id", "event_type", "event_id")


@query("every_nth_date", f"""WITH {ORDERS_SQL},
d AS (SELECT day, row_number() OVER (ORDER BY day) AS n, max(day) OVER () AS last FROM (SELECT DISTINCT day FROM dated) x)
SELECT day FROM d WHERE (n - 1) % 7 = 0 OR day = last""")
def _(spark, folder):
    return every_nth_date(orders_by_year(spark, folder), "day", 7)


@query("prior_daily_totals", f"""WITH {ORDERS_SQL},
d AS (SELECT day, sum(cents) AS c, count(*) AS n FROM dated GROUP BY day)
SELECT day, round(100.0 * coalesce(sum(c) OVER w, 0) / greatest(coalesce(sum(n) OVER w, 0), 1) / 1e6, 4) AS prior_rate
FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, folder):
    from playtape.operators.ordered import whole
    daily = orders_by_year(spark, folder).groupBy("day").agg(
        F.sum("cents").cast("double").alias("c"), F.count(F.lit(1)).cast("double").alias("n"))
    o = scan(ordered(whole(daily), ["_all"], ["day"]),
             pc=prior_sum(F.col("c"), F.lit(0.0)), pn=prior_sum(F.col("n"), F.lit(0.0)))
    return rounded(o.result().select("day", (100.0 * F.col("pc") / F.greatest("pn", F.lit(1.0)) / 1e6).alias("prior_rate")), 4)


@query("expanding_zscore", f"""WITH {ORDERS_SQL},
p AS (SELECT o_orderkey, o_totalprice / 1000 AS x, avg(o_totalprice / 1000) OVER w AS m, stddev_pop(o_totalprice / 1000) OVER w AS s
  FROM dated WINDOW w AS (PARTITION BY season ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, CASE WHEN s > 1e-9 THEN round((x - m) / s, 5) + 0.0 END AS z FROM p""")
def _(spark, folder):
    df = orders_by_year(spark, folder).withColumn("x", F.col("o_totalprice") / 1000)
    out = expanding_zscore(df, "x", ["season"], ["day", "o_orderkey"])
    return rounded(out.select("o_orderkey", "z"), 5)


@query("worst_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15")
def _(spark, folder):
    return dedupe.worst_n(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15, "o_orderkey")


@query("top_k_per_group", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def _(spark, folder):
    return dedupe.top_k(table(spark, folder, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("union_all_sides", """SELECT side, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS value FROM (
  SELECT 'home' AS side, value FROM events WHERE event_type IN ('click', 'purchase') UNION ALL SELECT 'away', value FROM events WHERE event_type NOT IN ('click', 'purchase')) GROUP BY side""")
def _(spark, folder):
    ev = _events(spark, folder)
    scores = F.col("event_type").isin("click", "purchase")
    home = ev.where(scores).select(F.lit("home").alias("side"), "value")
    away = ev.where(~scores).select(F.lit("away").alias("side"), "value")
    return rounded(home.unionByName(away).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")), 2)


@query("distinct_keys", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _(spark, folder):
    a = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    b = table(spark, folder, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("key"))
    return a.unionByName(b).distinct()


@query("difference_keys", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    b = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return a.subtract(b)


@query("intersection_keys", "SELECT c_custkey AS key FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, folder):
    a = table(spark, folder, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("key"))
    b = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return a.intersect(b)


@query("priority_union", """SELECT o_custkey, o_orderkey, source FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rank, o_orderkey) AS n FROM (
  SELECT o_custkey, o_orderkey, 'best' AS source, 0 AS rank FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_custkey, o_orderkey, 'other', 1 FROM orders WHERE o_orderpriority <> '1-URGENT')) WHERE n = 1""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    best = o.where("o_orderpriority = '1-URGENT'").withColumn("source", F.lit("best"))
    other = o.where("o_orderpriority <> '1-URGENT'").withColumn("source", F.lit("other"))
    return dedupe.priority_union([best, other], ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "source")


@query("priority_overlap", """SELECT CAST(sum(n - 1) AS BIGINT) AS overlap FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderpriority")
    return dedupe.overlap_count([o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority <> '1-URGENT'")], ["o_custkey"])


@query("upsert_latest", """SELECT o_custkey, o_orderkey, fresh FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY fresh DESC, o_orderkey) AS n FROM (
  SELECT o_custkey, o_orderkey, 0 AS fresh FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
  UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')) WHERE n = 1""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    old = o.where(F.col("o_orderdate") < cut).withColumn("fresh", F.lit(0))
    new = o.where(F.col("o_orderdate") >= cut).withColumn("fresh", F.lit(1))
    return dedupe.upsert_latest(old, new, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "fresh")


@query("first_nonempty_tier", """WITH t AS (SELECT user_id, event_id, 0 AS tier FROM events WHERE event_type = 'purchase' AND value > 100
  UNION ALL SELECT user_id, event_id, 1 FROM events WHERE NOT (event_type = 'purchase' AND value > 100))
SELECT user_id, event_id FROM t JOIN (SELECT user_id, min(tier) AS tier FROM t GROUP BY user_id) w USING (user_id, tier)""")
def _(spark, folder):
    ev = _events(spark, folder).select("user_id", "event_id", "event_type", "value")
    archived = ev.where("event_type = 'purchase' AND value > 100")
    live = ev.where("NOT (event_type = 'purchase' AND value > 100)")
    return dedupe.first_nonempty_tier([archived, live], ["user_id"]).select("user_id", "event_id")


@query("incremental_append", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01')""")
def _(spark, folder):
    sink = _folder(spark, "appended")
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    io.incremental_append(o.where(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp_ntz")), sink, ["o_custkey"])
    io.incremental_append(o, sink, ["o_custkey"])
    return spark.read.parquet(sink).select("o_orderkey", "o_custkey")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for queries that write and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("scan_seasons", f"""WITH {ORDERS_SQL} SELECT season, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM dated WHERE season IN (1996, 1997, 1998) GROUP BY season""")
def _(spark, folder):
    root = _folder(spark, "seasons")
    io.write_season_table(orders_by_year(spark, folder).select("season", "o_orderkey", "cents"), root, ["o_orderkey"])
    return io.scan_seasons(spark, root, [1996, 1997, 1998]).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("write_season_table", f"""WITH {ORDERS_SQL} SELECT season, o_orderkey, CASE WHEN season = 1997 THEN 2 ELSE 1 END AS version FROM dated""")
def _(spark, folder):
    root = _folder(spark, "seasons")
    rows = orders_by_year(spark, folder).select("season", "o_orderkey", F.lit(1).alias("version"))
    io.write_season_table(rows, root, ["o_orderkey"])
    io.write_season_table(rows.where("season = 1997").withColumn("version", F.lit(2)), root, ["o_orderkey"])
    return io.scan_seasons(spark, root).select("season", "o_orderkey", "version")


@query("scan_columns", "SELECT l_orderkey, l_suppkey FROM lineitem")
def _(spark, folder):
    return io.scan_columns(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_suppkey"])


@query("read_required", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS unread FROM orders")
def _(spark, folder):
    rows, losses = io.read_required(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_custkey"], "orders", tolerate=True)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(losses.count()).alias("unread"))


@query("landed_losses", """SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (WHERE o_orderkey % 10 = 3) AS BIGINT) AS broken FROM orders""")
def _(spark, folder):
    path = _folder(spark, "landed")
    orders = table(spark, folder, "orders").select(F.to_json(F.struct("o_orderkey", "o_custkey")).alias("value"), "o_orderkey")
    # Every tenth document is cut off in the middle.
    cut = F.when(F.col("o_orderkey") % 10 == 3, F.substring("value", 1, 12)).otherwise(F.col("value"))
    orders.select(cut.alias("value")).write.text(path)
    losses = io.landed_losses(spark, path, T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType())]))
    return losses.agg(F.sum("documents").alias("documents"), F.sum("broken").alias("broken"))


@query("bets_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS game_id, CAST(o_custkey % 100 AS DOUBLE) AS price, o_orderstatus AS side FROM orders")
def _(spark, folder):
    path = _folder(spark, "bets")
    bets = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("game_id"), (F.col("o_custkey") % 100).cast("double").alias("price"), F.col("o_orderstatus").alias("side"))
    io.write_bets_csv(filters.conform(bets, schemas.BETS), path)
    return io.read_bets_csv(spark, path, ["game_id", "price", "side"])


@query("sql_functions", """SELECT o_orderkey, round(CASE WHEN odds < 0 THEN -odds / (-odds + 100) ELSE 100 / (odds + 100) END, 8) AS p,
  o_orderkey - (((o_orderkey - 7) % 60) + 60) % 60 AS slot, CAST(o_orderkey % 12 * 60 + o_custkey % 60 AS DOUBLE) AS seconds
FROM (SELECT *, CAST(o_orderkey % 400 - 200 AS DOUBLE) AS odds FROM orders)""")
def _(spark, folder):
    sql.register(spark)
    return spark.sql("""SELECT o_orderkey, round(american_probability(CAST(o_orderkey % 400 - 200 AS DOUBLE)), 8) AS p,
        floor_to_grid(o_orderkey, 60, 7) AS slot, clock_seconds(concat(o_orderkey % 12, ':', o_custkey % 60)) AS seconds FROM {orders}""",
                     orders=table(spark, folder, "orders"))


@query("params_round_trip", "SELECT o_orderpriority AS name, CAST(count(*) AS BIGINT) AS value FROM orders GROUP BY 1")
def _(spark, folder):
    path = _folder(spark, "params")
    counts = filters.value_counts(table(spark, folder, "orders"), "o_orderpriority").collect()  # a handful of priorities
    io.write_params(spark, {r.o_orderpriority: r.n for r in counts}, path)
    return spark.createDataFrame(sorted(io.read_params(spark, path).items()), "name string, value long")


@query("conform_schema", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(NULL AS DOUBLE) AS snapshot_lag_seconds FROM customer""")
def _(spark, folder):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                           T.StructField("c_nationkey", T.LongType()), T.StructField("snapshot_lag_seconds", T.DoubleType())])
    return filters.conform(table(spark, folder, "customer"), schema, ["c_custkey"])


@query("normalise_keys", """SELECT CAST(event_id AS VARCHAR) AS event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS user_id
FROM events WHERE event_type <> 'error'""")
def _(spark, folder):
    raw = _events(spark, folder).select(
        "event_id", F.when(F.col("event_type") == "error", "x").otherwise(F.col("user_id").cast("string")).alias("user_id"))
    return filters.normalise_keys(raw, ["event_id"], ["user_id"], ["user_id"])


@query("regular_season", f"WITH {PLAYS_SQL} SELECT season_type, CAST(count(*) AS BIGINT) AS n FROM plays WHERE season_type IN (2) GROUP BY season_type")
def _(spark, folder):
    return filters.regular_season(plays(spark, folder)).groupBy("season_type").agg(F.count(F.lit(1)).alias("n"))


@query("franchise_games", f"""WITH {PLAYS_SQL}, t AS (SELECT concat('T', CAST(100 + n_nationkey AS VARCHAR)) AS code FROM nation WHERE n_regionkey < 4 AND n_nationkey < 12)
SELECT game_id, CAST(count(*) AS BIGINT) AS n FROM plays WHERE home_team IN (SELECT code FROM t) AND away_team IN (SELECT code FROM t) GROUP BY game_id""")
def _(spark, folder):
    codes = table(spark, folder, "nation").where("n_regionkey < 4 AND n_nationkey < 12").select(
        F.concat(F.lit("T"), (100 + F.col("n_nationkey")).cast("string")).alias("code"))
    return filters.franchise_games(plays(spark, folder), codes).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))


@query("drop_exhibitions", f"WITH {PLAYS_SQL} SELECT game_id, CAST(count(*) AS BIGINT) AS n FROM plays WHERE home_team NOT IN ('T100', 'T105') AND away_team NOT IN ('T100', 'T105') GROUP BY game_id")
def _(spark, folder):
    return filters.drop_exhibitions(plays(spark, folder), codes=("T100", "T105")).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))


@query("lineup_ok_rows", f"WITH {PLAYS_SQL} SELECT season, CAST(count(*) AS BIGINT) AS n FROM plays WHERE lineup_ok GROUP BY season")
def _(spark, folder):
    return plays(spark, folder).where("lineup_ok").groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("drop_bad_games", f"""WITH {PLAYS_SQL} SELECT game_id, CAST(count(*) AS BIGINT) AS n FROM plays WHERE game_id NOT IN (
  SELECT game_id FROM plays WHERE home_final = away_final) GROUP BY game_id""")
def _(spark, folder):
    kept = filters.drop_groups_with(plays(spark, folder), ["game_id"], filters.undecided())
    return kept.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))


@query("price_band", "SELECT o_orderkey FROM orders WHERE o_totalprice / 1000 > 0 AND o_totalprice / 1000 < 101 AND 101 - o_totalprice / 1000 > 0")
def _(spark, folder):
    df = table(spark, folder, "orders").withColumns({"px_home": F.col("o_totalprice") / 1000, "px_away": 101 - F.col("o_totalprice") / 1000})
    return filters.price_band(df).select("o_orderkey")


@query("near_days", f"""WITH {ORDERS_SQL}, g AS (SELECT DISTINCT day FROM dated WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice > 450000)
SELECT o_orderkey FROM dated d WHERE EXISTS (SELECT 1 FROM g WHERE d.day BETWEEN g.day - 1 AND g.day + 1)""")
def _(spark, folder):
    o = orders_by_year(spark, folder)
    games = o.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice > 450000").select(F.col("day").alias("gday"))
    return filters.near_days(o, "day", games, "gday").select("o_orderkey")


@query("date_window", f"WITH {ORDERS_SQL} SELECT o_orderkey FROM dated WHERE day BETWEEN DATE '1997-02-01' AND DATE '1997-04-30'")
def _(spark, folder):
    import datetime
    return filters.date_window(orders_by_year(spark, folder), "day", datetime.date(1997, 2, 1), datetime.date(1997, 4, 30)).select("o_orderkey")


@query("null_below_volume", """WITH r AS (SELECT l_partkey, count(*) AS n, avg(l_discount) AS rate FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, CASE WHEN n >= 30 THEN round(rate, 6) END AS rate, round(CASE WHEN n < 30 THEN 0.05 ELSE rate END, 6) AS shrunk FROM r""")
def _(spark, folder):
    r = table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("rate"), F.avg("l_discount").alias("shrunk"))
    return rounded(filters.null_below_volume(r, ["rate"], "n", 30, {"shrunk": F.lit(0.05)}).drop("n"))


@query("null_out_of_range", "SELECT l_returnflag, CAST(count(CASE WHEN l_quantity BETWEEN 10 AND 40 THEN 1 END) AS BIGINT) AS kept, round(avg(CASE WHEN l_quantity BETWEEN 10 AND 40 THEN l_quantity END), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def _(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("q", filters.in_range(F.col("l_quantity"), 10, 40))
    return rounded(df.groupBy("l_returnflag").agg(F.count("q").alias("kept"), F.avg("q").alias("mean")))


@query("drop_features", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def _(spark, folder):
    kept, unknown = filters.drop_names(["l_orderkey", "l_quantity", "l_discount", "l_tax"], ["l_discount", "nothing"])
    return filters.select_in_order(table(spark, folder, "lineitem"), [*kept, kept[0]])


@query("value_counts", "SELECT CASE WHEN k < 50 THEN event_type END AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) GROUP BY 1")
def _(spark, folder):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return filters.value_counts(_events(spark, folder).select(F.when(k < 50, F.col("event_type")).alias("kind")), "kind")


@query("thin_groups", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id HAVING count(*) < 60")
def _(spark, folder):
    return filters.thin_groups(_events(spark, folder), ["user_id"], 60)


@query("anti_audit", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def _(spark, folder):
    known = table(spark, folder, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return filters.anti(table(spark, folder, "orders").select("o_custkey").distinct(), known, ["o_custkey"])


@query("semi_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(spark, folder):
    known = table(spark, folder, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return filters.semi(table(spark, folder, "orders"), known, ["o_custkey"]).select("o_orderkey")


@query("describe", shown("""SELECT count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events""", "n", "mean sd min max p05 p50 p95", 5))
def _(spark, folder):
    return rounded(describe(_events(spark, folder), "value", [0.05, 0.5, 0.95], ["p05", "p50", "p95"]), 5)


@query("describe_by_group", shown("""SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type""",
                                  "event_type n", "mean sd min max p50 p90 p99", 5))
def _(spark, folder):
    return rounded(describe(_events(spark, folder), "value", [0.5, 0.9, 0.99], ["p50", "p90", "p99"], ["event_type"]), 5)


@query("distinct_counts", "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days FROM events GROUP BY event_type")
def _(spark, folder):
    return _events(spark, folder).groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("floor_to_grid", """SELECT event_id, u - (((u - 120) % 600) + 600) % 600 AS slot, date_trunc('second', to_timestamp(CAST(u - u % 300 AS BIGINT))::TIMESTAMP) AS five
FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM events)""")
def _(spark, folder):
    ts = F.col("ts").cast("timestamp")
    return _events(spark, folder).select(
        "event_id", floor_to_grid(F.unix_seconds(ts), 600, 120).alias("slot"),
        floor_minutes(ts, 5).cast("timestamp_ntz").alias("five"))
