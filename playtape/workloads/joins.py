"""Enrichment, as-of, tolerance and nearest-day joins on the driver tables; line snapshots made from pages of orders."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from playtape.functions.numeric import clip
from playtape.operators.asof import asof_backward, asof_forward, asof_version, join_nearby_day, match_within
from playtape.plans import lines
from playtape.plans.backtest import fill_report, fill_states, state_gaps, state_grid
from playtape.plans.box import mirror_opponent
from playtape.plans.features import closing_markets, lineup_value, nearest_grid_lookup, grid_cell
from playtape.plans.rates import every_nth_date
from playtape.session import ensure_checkpoint_dir
from playtape.workloads.base import (
    ODDS_SQL,
    ORDERS_SQL,
    PLAYS_SQL,
    RATES_SQL,
    game_bound,
    odds,
    orders_by_year,
    plays,
    query,
    rates,
    rounded,
    shown,
    table,
)


def _events(spark, folder):
    return table(spark, folder, "events")


def _seconds(df):
    return df.withColumn("unix", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("enrichment_join", """SELECT o_orderkey, c_mktsegment, n_name FROM orders
LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, folder):
    c = table(spark, folder, "customer").where("c_acctbal > 0")
    return table(spark, folder, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).select("o_orderkey", "c_mktsegment", "n_name")


@query("inner_restrict", """SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F' GROUP BY l_returnflag""")
def _(spark, folder):
    o = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rounded(table(spark, folder, "lineitem").join(o, "l_orderkey").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")), 2)


@query("closing_markets", f"""WITH {ODDS_SQL}
SELECT espn_game_id, p_home_close, CAST(NULL AS INT) AS home_close_ml, CAST(NULL AS INT) AS away_close_ml, home_spread_close, total_close FROM odds
WHERE p_home_close IS NOT NULL OR home_spread_close IS NOT NULL OR total_close IS NOT NULL""")
def _(spark, folder):
    o = odds(spark, folder)
    ml = o.where("p_home_close IS NOT NULL").select(
        "espn_game_id", "p_home_close", F.lit(None).cast("int").alias("home_close_ml"), F.lit(None).cast("int").alias("away_close_ml"))
    # A third of the games are listed a second time without a price; the row with one stands.
    blank = o.where("p_home_close IS NOT NULL AND CAST(espn_game_id AS BIGINT) % 3 = 0").select(
        "espn_game_id", F.lit(None).cast("double").alias("p_home_close"), F.lit(None).cast("int").alias("home_close_ml"),
        F.lit(None).cast("int").alias("away_close_ml"))
    return closing_markets(ml.unionByName(blank), o.where("home_spread_close IS NOT NULL"), o.where("total_close IS NOT NULL"))


@query("mirror_opponent", """WITH b AS (SELECT l_orderkey, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT a.l_orderkey AS game_id, a.l_linestatus AS team_id, a.q AS q, CAST(o.n AS BIGINT) AS opp_n, o.q AS opp_q FROM b a LEFT JOIN b o ON a.l_orderkey = o.l_orderkey
 AND o.l_linestatus = CASE a.l_linestatus WHEN 'F' THEN 'O' ELSE 'F' END""")
def _(spark, folder):
    box = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_linestatus").alias("team_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    box = box.withColumn("opp_team_id", F.when(F.col("team_id") == "F", "O").otherwise("F"))
    return mirror_opponent(box, ["n", "q"]).select("game_id", "team_id", "q", "opp_n", "opp_q")


@query("dictionary_lookup", """SELECT DISTINCT n_name, coalesce(CASE n_name WHEN 'NATION_1' THEN 'AMER' WHEN 'NATION_2' THEN 'ASIA' END, n_name) AS code FROM nation""")
def _(spark, folder):
    from playtape.functions.text import lookup
    name = F.col("n_name")
    return table(spark, folder, "nation").select(
        "n_name", F.coalesce(lookup(name, {"NATION_1": "AMER", "NATION_2": "ASIA"}), name).alias("code")).distinct()


@query("asof_backward", """SELECT l.event_id, r.event_id AS hit, r.value AS hit_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def _(spark, folder):
    ev = _events(spark, folder)
    right = ev.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("hit"), F.col("value").alias("hit_value"))
    out = asof_backward(ev.where("event_type <> 'purchase'"), right, ["user_id"], "ts", "ts", ["hit", "hit_value"])
    return out.select("event_id", "hit", "hit_value")


@query("asof_tolerance", """WITH met AS (SELECT l.event_id, r.event_id AS hit, r.ts AS met_at, l.ts - r.ts > INTERVAL 2 DAY AS stale FROM (SELECT * FROM events WHERE event_type <> 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts)
SELECT event_id, CASE WHEN NOT stale THEN hit END AS hit, count(*) FILTER (WHERE met_at IS NULL) OVER () AS unmatched, count(*) FILTER (WHERE stale) OVER () AS too_stale FROM met""")
def _(spark, folder):
    """Matches of at most two days, and what was lost, counted on the way into the table."""
    ev, audit = _events(spark, folder), Observation()
    right = ev.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("hit"))
    out = asof_backward(ev.where("event_type <> 'purchase'"), right, ["user_id"], "ts", "ts", ["hit"], tolerance=F.expr("INTERVAL 2 DAYS"), audit=audit)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/asof-{uuid.uuid4().hex}"
    out.select("event_id", "hit").write.parquet(path)
    return spark.read.parquet(path).withColumns({c: F.lit(audit.get[c]).cast("long") for c in ("unmatched", "too_stale")})


@query("asof_forward", """WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS unix FROM events),
p AS (SELECT user_id, unix, min(event_id) AS hit FROM e WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT event_id, hit, delay FROM (SELECT l.event_id, r.hit, r.unix - (l.unix + 600) AS delay,
  row_number() OVER (PARTITION BY l.event_id ORDER BY r.unix) AS n
  FROM (SELECT * FROM e WHERE event_type <> 'purchase') l LEFT JOIN p r ON l.user_id = r.user_id AND r.unix BETWEEN l.unix + 600 AND l.unix + 600 + 86400) WHERE n = 1""")
def _(spark, folder):
    ev = _seconds(_events(spark, folder))
    right = ev.where("event_type = 'purchase'").select("user_id", "unix", F.col("event_id").alias("hit"))
    left = ev.where("event_type <> 'purchase'").withColumn("at", F.col("unix") + 600)
    return asof_forward(left, right, ["user_id"], "at", "unix", ["hit"], 86400, delay="delay").select("event_id", "hit", "delay")


@query("asof_version", f"""WITH {ORDERS_SQL},
d AS (SELECT day, row_number() OVER (ORDER BY day) AS n, max(day) OVER () AS last FROM (SELECT DISTINCT day FROM dated WHERE season >= 1997) x),
v AS (SELECT day AS version FROM d WHERE (n - 1) % 7 = 0 OR day = last)
SELECT o_orderkey, coalesce((SELECT max(version) FROM v WHERE version <= day), (SELECT min(version) FROM v)) AS version FROM dated""")
def _(spark, folder):
    o = orders_by_year(spark, folder)
    v = every_nth_date(o.where("season >= 1997"), "day", 7).withColumnRenamed("day", "version_day")
    return asof_version(o, "day", v, "version_day", "version").select("o_orderkey", "version")


@query("join_nearby_day", f"""WITH {ORDERS_SQL},
g AS (SELECT o_orderkey AS game, day, o_custkey % 5 AS pair FROM dated WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
look AS (SELECT day, pair, game FROM (SELECT g.day + o AS day, pair, game, row_number() OVER (PARTITION BY g.day + o, pair ORDER BY abs(o), o, game) AS n
  FROM g, (VALUES (-1), (0), (1)) t(o)) WHERE n = 1)
SELECT d.o_orderkey, l.game FROM dated d JOIN look l ON d.day = l.day AND d.o_custkey % 5 = l.pair""")
def _(spark, folder):
    o = orders_by_year(spark, folder).withColumn("pair", F.col("o_custkey") % 5)
    games = o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select("day", "pair", F.col("o_orderkey").alias("game"))
    matched, _ = join_nearby_day(o, games, "day", ["pair"], "game")
    return matched.select("o_orderkey", "game")


@query("unmatched_nearby_day", f"""WITH {ORDERS_SQL}, g AS (SELECT day, o_custkey % 5 AS pair FROM dated WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
SELECT o_orderkey FROM dated d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.pair = d.o_custkey % 5 AND abs(date_diff('day', g.day, d.day)) <= 1)""")
def _(spark, folder):
    o = orders_by_year(spark, folder).withColumn("pair", F.col("o_custkey") % 5)
    games = o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select("day", "pair", F.col("o_orderkey").alias("game"))
    return join_nearby_day(o, games, "day", ["pair"], "game")[1].select("o_orderkey")


@query("match_within", """WITH e AS (SELECT event_id, user_id, event_type, ts, CAST(ts AS DATE) AS day, epoch_us(ts) AS us FROM events)
SELECT g_id, e_id FROM (SELECT g.event_id AS g_id, v.event_id AS e_id, row_number() OVER (PARTITION BY g.event_id ORDER BY v.event_id) AS n
  FROM e g JOIN e v ON g.user_id = v.user_id AND g.day = v.day
  WHERE g.event_type <> 'view' AND v.event_type = 'view' AND (v.event_id % 11 = 0 OR abs(v.us - g.us) <= 5400000000)) WHERE n = 1""")
def _(spark, folder):
    ev = _events(spark, folder).withColumns({"at": F.col("ts").cast("timestamp"), "day": F.to_date("ts")})
    games = ev.where("event_type <> 'view'").select("user_id", "day", F.col("event_id").alias("g_id"), F.col("at").alias("start"))
    events = ev.where("event_type = 'view'").select(
        "user_id", "day", F.col("event_id").alias("e_id"), F.when(F.col("event_id") % 11 != 0, F.col("at")).alias("e_start"))
    return match_within(games, events, ["user_id", "day"], "g_id", "start", "e_start", ["e_id"], 5400).select("g_id", "e_id")


@query("schedule_complete", f"""WITH {ORDERS_SQL}, p AS (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT') WHERE n = 1)
SELECT c_custkey, o_orderkey AS p_home_close, o_orderkey IS NOT NULL AS has_line FROM customer LEFT JOIN p ON c_custkey = o_custkey""")
def _(spark, folder):
    from playtape.operators.dedupe import keep_first
    p = keep_first(table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'"), ["o_custkey"], ["o_orderkey"]).select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("p_home_close"))
    return lines.schedule_complete(table(spark, folder, "customer").select("c_custkey"), p, "c_custkey")


@query("nearest_grid_lookup", """WITH s AS (SELECT CAST(greatest(0, least(10, round_even(l_discount / 0.02, 0))) AS INT) AS d, CAST(greatest(0, least(20, round_even(l_quantity / 2.5, 0))) AS INT) AS q, avg(l_tax) AS wp FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(wp) AS BIGINT) AS hits, round(avg(wp), 6) AS mean FROM (SELECT s.wp FROM lineitem LEFT JOIN s ON s.d = CAST(greatest(0, least(10, round_even(l_discount / 0.02, 0))) AS INT)
 AND s.q = CAST(greatest(0, least(20, round_even(l_quantity / 2.5, 0))) AS INT))""")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    cells = {"d": grid_cell(F.col("l_discount"), 0.0, 0.02, 0, 10), "q": grid_cell(F.col("l_quantity"), 0.0, 2.5, 0, 20)}
    surface = li.where("l_returnflag = 'A'").groupBy(*[v.alias(k) for k, v in cells.items()]).agg(F.avg("l_tax").alias("value"))
    out = nearest_grid_lookup(li, surface, cells, "value", "wp")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.count("wp").alias("hits"), F.avg("wp").alias("mean")))


@query("lineup_value", shown(f"""WITH {PLAYS_SQL}, {RATES_SQL},
p AS (SELECT DISTINCT game_id, home_lineup FROM plays),
x AS (SELECT game_id, home_lineup, CAST(unnest(string_split(home_lineup, ',')) AS BIGINT) AS athlete_id FROM p)
SELECT x.game_id, x.home_lineup, sum(rapm_net) AS rapm, CAST(count(*) - count(r.athlete_id) AS BIGINT) AS rapm_missing
FROM x LEFT JOIN rates r ON x.game_id = r.game_id AND x.athlete_id = r.athlete_id GROUP BY 1, 2""", "game_id home_lineup rapm_missing", "rapm"))
def _(spark, folder):
    df = plays(spark, folder).select("game_id", "home_lineup").distinct()
    return rounded(lineup_value(df, rates(spark, folder), "home_lineup", "rapm_net", "rapm").select(
        "game_id", "home_lineup", "rapm", "rapm_missing"))


# -- states against prints -----------------------------------------------------------------------


@query("state_grid", """SELECT CAST(user_id AS VARCHAR) AS game_id, grid_unix, max(event_id) AS play_number FROM (
  SELECT user_id, event_id, CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT) AS grid_unix FROM events) GROUP BY 1, 2""")
def _(spark, folder):
    df = plays(spark, folder).withColumn("wallclock", F.col("ts").cast("timestamp"))
    return state_grid(df).select("game_id", "grid_unix", "play_number")


@query("state_gaps", shown("""SELECT count(g) AS n, avg(g) AS mean, quantile_cont(g, 0.5) AS median, quantile_cont(g, 0.9) AS p90 FROM (
  SELECT grid_unix - lag(grid_unix) OVER (PARTITION BY user_id ORDER BY grid_unix) AS g FROM (SELECT DISTINCT user_id, CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT) AS grid_unix FROM events)) WHERE g IS NOT NULL""", "n", "mean median p90", 4))
def _(spark, folder):
    df = plays(spark, folder).withColumn("wallclock", F.col("ts").cast("timestamp"))
    return rounded(state_gaps(state_grid(df), at_most=game_bound(spark, folder)), 4)


PRINTS_SQL = """prints AS (SELECT user_id, unix AS ts, px, event_id FROM (SELECT user_id, CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT) AS unix, value AS px, event_id,
  row_number() OVER (PARTITION BY user_id, CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT) ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1)"""


@query("one_print_per_second", f"WITH {PRINTS_SQL} SELECT user_id, ts, event_id FROM prints")
def _(spark, folder):
    from playtape.plans.tape import one_print_per_second
    ev = _events(spark, folder).where("event_type = 'purchase'")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    tape = ev.select(F.col("user_id").alias("game_id"), F.rint(at).cast("bigint").alias("ts"), at.alias("timestamp_unix"), F.col("event_id").alias("trade_id"))
    return one_print_per_second(tape).select(F.col("game_id").alias("user_id"), "ts", F.col("trade_id").alias("event_id"))


def _fills(spark, folder):
    df = plays(spark, folder).where("event_type <> 'purchase'").withColumn("wallclock", F.col("ts").cast("timestamp"))
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint")
    prints = plays(spark, folder).where("event_type = 'purchase'").select("game_id", at.alias("ts"), F.col("value").alias("px_home"), F.col("play_number").alias("print"))
    return fill_states(state_grid(df), prints, 60, 7200, ["px_home", "print"], at_most=game_bound(spark, folder))


FILLS_SQL = f"""WITH {PRINTS_SQL},
g AS (SELECT user_id, max(event_id) AS event_id, unix FROM (SELECT user_id, event_id, CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT) AS unix FROM events WHERE event_type <> 'purchase') GROUP BY user_id, unix),
f AS (SELECT * FROM (SELECT g.event_id AS play_number, p.event_id AS print, p.ts - g.unix - 60 AS fill_delay, row_number() OVER (PARTITION BY g.event_id ORDER BY p.ts) AS n
  FROM g LEFT JOIN prints p ON g.user_id = p.user_id AND p.ts BETWEEN g.unix + 60 AND g.unix + 60 + 7200) WHERE n = 1)"""


@query("fill_states", f"{FILLS_SQL} SELECT play_number, print, fill_delay FROM f")
def _(spark, folder):
    return _fills(spark, folder).select("play_number", "print", "fill_delay")


@query("fill_report", f"{FILLS_SQL} SELECT CAST(count(*) AS BIGINT) AS states, CAST(count(fill_delay) AS BIGINT) AS fills, round(count(*) FILTER (WHERE fill_delay = 0) / count(fill_delay), 6) AS exact_share, round(avg(fill_delay), 6) AS mean_delay FROM f")
def _(spark, folder):
    return rounded(fill_report(_fills(spark, folder)))


# -- lines ---------------------------------------------------------------------------------------

LINE_TABLES = """
sched AS (SELECT o_orderkey AS game_id, day, season, concat('H', CAST(o_custkey % 40 AS VARCHAR)) AS home_team, concat('A', CAST(o_custkey % 7 AS VARCHAR)) AS away_team,
  epoch(day) + (o_orderkey % 24) * 3600 AS start FROM dated WHERE o_orderpriority <> '5-LOW'),
quotes AS (SELECT concat('H', CAST(o_custkey % 40 AS VARCHAR)) AS home_team, concat('A', CAST(o_custkey % 7 AS VARCHAR)) AS away_team,
  epoch(day) + (o_orderkey % 48) * 1800 AS qat, o_orderkey AS event_pos, -110 - o_orderkey % 200 AS home_ml, 100 + o_orderkey % 150 AS away_ml FROM dated WHERE o_orderpriority = '5-LOW')"""


def _line_tables(spark, folder):
    o = orders_by_year(spark, folder)
    pair = {"home_team": F.concat(F.lit("H"), (F.col("o_custkey") % 40).cast("string")),
            "away_team": F.concat(F.lit("A"), (F.col("o_custkey") % 7).cast("string"))}
    day = F.unix_date("day").cast("bigint") * 86400
    sched = o.where("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("game_id"), F.col("day").alias("game_date"), "season", *[v.alias(k) for k, v in pair.items()],
        F.timestamp_seconds(day + (F.col("o_orderkey") % 24) * 3600).alias("commence_time"))
    quotes = o.where("o_orderpriority = '5-LOW'").select(
        *[v.alias(k) for k, v in pair.items()], F.timestamp_seconds(day + (F.col("o_orderkey") % 48) * 1800).alias("snapshot_time"),
        F.col("o_orderkey").alias("event_pos"), (-110 - F.col("o_orderkey") % 200).cast("double").alias("home_close_ml"),
        (100 + F.col("o_orderkey") % 150).cast("double").alias("away_close_ml"))
    return sched, quotes


ASOF_LINES = f"""WITH {ORDERS_SQL}, {LINE_TABLES},
q1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY home_team, away_team, qat ORDER BY event_pos) AS n FROM quotes) WHERE n = 1),
m AS (SELECT s.*, q.qat, q.home_ml, q.away_ml, s.start - q.qat AS lag FROM sched s ASOF LEFT JOIN q1 q ON s.home_team = q.home_team AND s.away_team = q.away_team AND s.start >= q.qat)"""


@query("closing_moneyline", shown(f"""{ASOF_LINES}
SELECT game_id, lag, ph / (ph + pa) AS p_home_close, ph + pa - 1 AS overround_close FROM (SELECT *, -home_ml / (-home_ml + 100.0) AS ph, 100.0 / (away_ml + 100.0) AS pa FROM m WHERE lag <= 864000)""",
                                  "game_id", "lag p_home_close overround_close"))
def _(spark, folder):
    sched, quotes = _line_tables(spark, folder)
    out = lines.closing_moneyline(sched, quotes, 864000)
    return rounded(out.select(F.col("espn_game_id").alias("game_id"), F.col("snapshot_lag_seconds").alias("lag"), "p_home_close", "overround_close"))


@query("moneyline_audit", f"""{ASOF_LINES} SELECT 'no_snapshot_before_tip' AS metric, CAST(count(*) AS BIGINT) AS value FROM m WHERE qat IS NULL
UNION ALL SELECT 'too_stale', CAST(count(*) AS BIGINT) FROM m WHERE lag > 864000""")
def _(spark, folder):
    sched, quotes = _line_tables(spark, folder)
    return lines.moneyline_audit(sched, quotes, 864000)


@query("snapshot_plan", f"""WITH {ORDERS_SQL}, {LINE_TABLES}, p AS (SELECT season, CAST(start - 60 AS BIGINT) - CAST(start - 60 - 300 AS BIGINT) % 600 AS slot FROM sched)
SELECT season, CAST(count(*) AS BIGINT) AS games, CAST(count(DISTINCT slot) AS BIGINT) AS snapshots, CAST(count(DISTINCT CASE WHEN slot % 7 <> 0 THEN slot END) AS BIGINT) AS to_fetch FROM p GROUP BY season""")
def _(spark, folder):
    sched, _ = _line_tables(spark, folder)
    grids = sched.select("season").distinct().withColumns({"step": F.lit(600), "phase": F.lit(300)})
    planned = lines.snapshot_plan(sched, grids)
    landed = planned.where(F.col("snapshot_unix") % 7 == 0)
    return lines.plan_summary(planned, landed)


@query("snapshot_grid", """WITH s AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS u, event_id % 5 AS a, event_id % 3 AS b FROM events),
g AS (SELECT event_id, u, CASE WHEN abs(gap - 300) <= abs(gap - 600) THEN 300 ELSE 600 END AS step FROM (SELECT *, least(CASE WHEN a > 0 THEN 290 + a * 80 END, CASE WHEN b > 0 THEN 250 + b * 200 END) AS g0,
  coalesce(least(CASE WHEN a > 0 THEN 290 + a * 80 END, CASE WHEN b > 0 THEN 250 + b * 200 END), 300) AS gap FROM s))
SELECT event_id, CAST(step AS INT) AS step, CAST(CAST(round_even((u % step) / 60.0, 0) * 60 AS BIGINT) % step AS INT) AS phase FROM g""")
def _(spark, folder):
    u = F.unix_seconds(F.col("ts").cast("timestamp"))

    def stamp(x):
        return F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    a, b = F.col("event_id") % 5, F.col("event_id") % 3
    docs = _events(spark, folder).select(
        "event_id", stamp(u).alias("timestamp"), F.when(a > 0, stamp(u - (290 + a * 80))).alias("previous_timestamp"),
        F.when(b > 0, stamp(u + (250 + b * 200))).alias("next_timestamp"))
    return lines.snapshot_grid(docs).select("event_id", "step", "phase")


@query("merge_lines", shown(f"""WITH {ORDERS_SQL},
src AS (SELECT o_custkey AS id, 'pinnacle' AS line_source, o_totalprice / 1e6 AS p, o_orderkey FROM dated WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') UNION ALL
  SELECT o_custkey, 'other', o_totalprice / 1e6, o_orderkey FROM dated WHERE o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_source DESC, p) AS n FROM src) WHERE n = 1)
SELECT CAST(c_custkey AS VARCHAR) AS espn_game_id, line_source, p AS p_home_close, p IS NOT NULL AS has_line FROM customer LEFT JOIN best ON c_custkey = id
WHERE c_nationkey NOT IN (3)""", "espn_game_id line_source has_line", "p_home_close"))
def _(spark, folder):
    o = orders_by_year(spark, folder)

    preferred = F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM")

    def source(chosen, name):
        blank = {c: F.lit(None).cast("double") for c in ("home_close_ml", "away_close_ml", "overround_close")}
        text = {c: F.lit("X") for c in ("home_team", "away_team")}
        return o.where(chosen).select(
            F.col("o_custkey").alias("espn_game_id"), "season", F.col("day").alias("game_date"), F.lit(name).alias("line_source"),
            (F.col("o_totalprice") / 1e6).alias("p_home_close"), *[v.alias(k) for k, v in {**blank, **text}.items()])

    schedule = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("game_id"), F.lit(2000).alias("season"), F.lit("2000-01-01").cast("date").alias("game_date"),
        F.when(F.col("c_nationkey") == 3, "EAST").otherwise("H").alias("home_abbreviation"), F.lit("A").alias("away_abbreviation"))
    out = lines.merge_lines(source(preferred, "pinnacle"), source(~preferred, "other"), schedule)
    return rounded(out.select("espn_game_id", "line_source", "p_home_close", "has_line"))


@query("coverage_by_season", f"""WITH {ORDERS_SQL} SELECT season, CAST(count(*) AS BIGINT) AS games, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS preferred,
 CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS other, CAST(count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'P')) AS BIGINT) AS no_line, round(count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) / count(*), 6) AS covered,
 round(min(line), 6) AS line_min, round(quantile_cont(line, 0.5), 6) AS line_median, round(max(line), 6) AS line_max
 FROM (SELECT *, CASE WHEN o_orderstatus IN ('F', 'P') THEN CAST(o_custkey % 41 AS DOUBLE) - 20.5e0 END AS line FROM dated) GROUP BY season""")
def _(spark, folder):
    o = orders_by_year(spark, folder)
    src = F.when(F.col("o_orderstatus") == "F", "pinnacle").when(F.col("o_orderstatus") == "P", "other")
    line = F.when(src.isNotNull(), (F.col("o_custkey") % 41).cast("double") - 20.5)
    df = o.select("season", src.alias("line_source"), src.isNotNull().alias("has_line"), line.alias("line"))
    return rounded(lines.coverage_by_season(df, price="line"))


def _documents(spark, folder, market):
    """Snapshot documents, one per order: two events, each with two books and a market of two outcomes."""
    o = orders_by_year(spark, folder)
    k = F.col("o_orderkey")

    def outcome(name, price, point):
        return F.struct(F.lit(name).alias("name"), price.cast("double").alias("price"), point.cast("double").alias("point"))

    def market_of(shift):
        names = ("Over", "Under") if market == "totals" else ("Boston Celtics", "Denver Nuggets")
        first = F.when((k + shift) % 4 != 0, outcome(names[0], -110 - k % 9, (k + shift) % 20 - 9.5 if market != "totals" else 200 + (k + shift) % 30))
        second = F.when((k + shift) % 6 != 1, outcome(names[1], 105 + k % 7, 9.5 - (k + shift) % 20 if market != "totals" else 200 + (k + shift) % 30))
        return F.struct(F.lit(market).alias("key"), F.filter(F.array(first, second), lambda x: x.isNotNull()).alias("outcomes"))

    def book(name, shift):
        return F.struct(F.lit(name).alias("key"), F.array(market_of(shift)).alias("markets"))

    def event(home, away, shift):
        return F.struct(
            F.concat(F.lit("e"), (k + shift).cast("string")).alias("id"), F.lit(home).alias("home_team"), F.lit(away).alias("away_team"),
            F.lit("2024-01-02T00:00:00Z").alias("commence_time"), F.array(book("slow", shift), book("pinnacle", shift + 1)).alias("bookmakers"))

    at = F.date_format(F.timestamp_seconds(F.lit(1700000000) + k * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(at.alias("timestamp"), F.array(event("Boston Celtics", "Denver Nuggets", 0), event("Nowhere", "Denver Nuggets", 2)).alias("data"))


DOCUMENT_BOOKS = """b AS (SELECT k, book, book_pos, CASE WHEN (k + s) % 4 <> 0 THEN 1 END AS one, CASE WHEN (k + s) % 6 <> 1 THEN 1 END AS two, k + s AS ks FROM
 (SELECT o_orderkey AS k FROM orders) o, (VALUES ('slow', 0, 0), ('pinnacle', 1, 1)) t(book, book_pos, s))"""


@query("moneyline_quotes", f"""WITH {DOCUMENT_BOOKS} SELECT k * 60 + 1700000000 AS at, CAST(-110 - k % 9 AS DOUBLE) AS home_close_ml, CAST(105 + k % 7 AS DOUBLE) AS away_close_ml FROM b
WHERE book = 'pinnacle' AND one = 1 AND two = 1""")
def _(spark, folder):
    q = lines.moneyline_quotes(_documents(spark, folder, "h2h"))
    return q.select(F.unix_seconds("snapshot_time").alias("at"), "home_close_ml", "away_close_ml")


@query("spread_quotes", f"""WITH {DOCUMENT_BOOKS}, q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY book_pos) AS n FROM b WHERE one = 1 OR two = 1)
SELECT k * 60 + 1700000000 AS at, book, ks % 20 - 9.5e0 AS home_spread_close, 9.5e0 - ks % 20 AS away_spread_close, CASE WHEN one = 1 THEN CAST(-110 - k % 9 AS DOUBLE) END AS home_spread_price FROM q WHERE n = 1""")
def _(spark, folder):
    q = lines.spread_quotes(_documents(spark, folder, "spreads"))
    return q.select(F.unix_seconds("snapshot_time").alias("at"), "book", "home_spread_close", "away_spread_close", "home_spread_price")


@query("total_quotes", f"""WITH {DOCUMENT_BOOKS}, q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY book_pos) AS n FROM b WHERE one = 1 OR two = 1)
SELECT k * 60 + 1700000000 AS at, book, CAST(200 + ks % 30 AS DOUBLE) AS total_close, CASE WHEN one = 1 THEN CAST(-110 - k % 9 AS DOUBLE) END AS over_price, CASE WHEN two = 1 THEN CAST(105 + k % 7 AS DOUBLE) END AS under_price FROM q WHERE n = 1""")
def _(spark, folder):
    q = lines.total_quotes(_documents(spark, folder, "totals"))
    return q.select(F.unix_seconds("snapshot_time").alias("at"), "book", "total_close", "over_price", "under_price")


@query("closing_spread", f"""WITH {DOCUMENT_BOOKS}, q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY book_pos) AS n FROM b WHERE one = 1 OR two = 1)
SELECT CAST(k AS VARCHAR) AS espn_game_id, book, ks % 20 - 9.5e0 AS home_spread_close FROM q WHERE n = 1 AND k % 3 <> 0""")
def _(spark, folder):
    games = _line_games(spark, folder)
    return lines.closing_spread(games, _documents(spark, folder, "spreads")).select("espn_game_id", "book", "home_spread_close")


@query("closing_total", f"""WITH {DOCUMENT_BOOKS}, q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY book_pos) AS n FROM b WHERE (one = 1 OR two = 1) AND book = 'pinnacle')
SELECT CAST(k AS VARCHAR) AS espn_game_id, CAST(200 + ks % 30 AS DOUBLE) AS total_close FROM q WHERE n = 1 AND k % 3 <> 0""")
def _(spark, folder):
    games = _line_games(spark, folder)
    return lines.closing_total(games, _documents(spark, folder, "totals"), 0, book="pinnacle").select("espn_game_id", "total_close")


@query("unresolved_games", f"""WITH {DOCUMENT_BOOKS} SELECT CAST(o_orderkey AS VARCHAR) AS espn_game_id FROM orders WHERE (o_orderkey % 3 = 0 OR o_orderkey NOT IN (SELECT k FROM b WHERE one = 1 OR two = 1))""")
def _(spark, folder):
    games = _line_games(spark, folder)
    return lines.unresolved_games(games, lines.closing_spread(games, _documents(spark, folder, "spreads"))).select("espn_game_id")


@query("unmapped_names", "SELECT 'Nowhere' AS name FROM orders GROUP BY 1")
def _(spark, folder):
    return lines.unmapped_names(_documents(spark, folder, "h2h"))


def _line_games(spark, folder):
    o = orders_by_year(spark, folder)
    k = F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("espn_game_id"), "season", F.col("day").alias("game_date"), F.lit("BOS").alias("home_team"),
        F.lit("DEN").alias("away_team"), F.timestamp_seconds(F.lit(1700000000) + k * 60).alias("snapshot_time"),
        F.when(k % 3 != 0, F.lit("2024-01-02 01:00:00").cast("timestamp")).otherwise(F.lit("2024-01-05").cast("timestamp")).alias("commence_time"))


@query("clip_and_ratio", """SELECT l_orderkey, l_linenumber, greatest(0.02, least(0.08, l_discount)) AS clipped, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS ratio FROM lineitem""")
def _(spark, folder):
    from playtape.functions.numeric import safe_ratio
    return rounded(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", clip(F.col("l_discount"), 0.02, 0.08).alias("clipped"),
        safe_ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio")))
