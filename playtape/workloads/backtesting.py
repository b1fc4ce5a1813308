"""Bets, sizing, settlement and the grouped reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtape.plans import backtest as bt
from playtape.plans import reports
from playtape.session import cut_lineage
from playtape.workloads.base import ORDERS_SQL, PLAYS_SQL, game_bound, orders_by_year, plays, query, rounded, shown, table

# -- sizing on orders: one bet per order, edge from the price, season = year ---------------------

ORDER_BETS = f"""{ORDERS_SQL},
bets0 AS (SELECT o_orderkey, season, day, o_custkey, o_orderstatus, o_orderpriority, o_totalprice / 1e6 + 0.02e0 AS edge, 1e0 + o_orderkey % 98 AS price, CAST(o_orderstatus = 'F' AS INT) AS won FROM dated),
mom AS (SELECT *, CAST(count(*) OVER w AS BIGINT) AS k, coalesce(sum(edge) OVER w, 0) AS s1, coalesce(sum(edge * edge) OVER w, 0) AS s2 FROM bets0 WINDOW w AS (PARTITION BY season ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dev AS (SELECT *, s1 / greatest(k, 1) AS m, sqrt(greatest(s2 / greatest(k, 1) - (s1 / greatest(k, 1)) * (s1 / greatest(k, 1)), 0)) AS sd FROM mom),
zed AS (SELECT *, CASE WHEN k >= 100 AND sd > 1e-12 THEN (edge - m) / sd ELSE 0 END AS edge_z, k >= 100 AND sd > 1e-12 AS live FROM dev),
mul AS (SELECT *, CASE WHEN live THEN greatest(0.2e0, least(3e0, 1 + edge_z)) ELSE 1e0 END AS mult FROM zed),
nrm AS (SELECT *, coalesce(sum(mult) OVER (PARTITION BY season ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(k, 1) AS pm FROM mul),
sized AS (SELECT *, greatest(1, round_even(100 * mult / CASE WHEN k > 0 AND pm > 1e-6 THEN pm ELSE 1 END, 0)) AS contracts FROM nrm),
settled AS (SELECT *, contracts * price / 100 AS staked, ceil(0.07e0 * contracts * (price / 100) * (1 - price / 100) * 100) / 100 AS fee FROM sized),
bets AS (SELECT *, CASE WHEN won = 1 THEN contracts * (1 - price / 100) ELSE -contracts * (price / 100) END - fee AS pnl FROM settled)"""


def _order_bets(spark, folder):
    return orders_by_year(spark, folder).select(
        "o_orderkey", "season", "day", "o_custkey", "o_orderstatus", "o_orderpriority",
        (F.col("o_totalprice") / 1e6 + 0.02).alias("edge"), (1.0 + F.col("o_orderkey") % 98).alias("price"),
        (F.col("o_orderstatus") == "F").cast("int").alias("won"))


def _settled(spark, folder):
    return bt.settle(bt.size_expanding(_order_bets(spark, folder), order=["day", "o_orderkey"]))


@query("size_expanding", shown(f"WITH {ORDER_BETS} SELECT * FROM bets", "o_orderkey", "edge_z contracts", 5))
def _(spark, folder):
    return rounded(bt.size_expanding(_order_bets(spark, folder), order=["day", "o_orderkey"]).select("o_orderkey", "edge_z", "contracts"), 5)


@query("settle", shown(f"WITH {ORDER_BETS} SELECT * FROM bets", "o_orderkey", "contracts fee staked pnl"))
def _(spark, folder):
    return rounded(_settled(spark, folder).select("o_orderkey", "contracts", "fee", "staked", "pnl"))


@query("size_whole_book", shown(f"""WITH RECURSIVE {ORDERS_SQL}, b AS (SELECT o_orderkey, o_totalprice / 1e6 + 0.02e0 AS edge FROM dated), st AS (SELECT avg(edge) AS m, stddev_pop(edge) AS s FROM b),
mu AS (SELECT o_orderkey, (edge - m) / s AS edge_z, greatest(0.2e0, least(3e0, 1 + (edge - m) / s)) AS raw FROM b, st), nm AS (SELECT avg(raw) AS a FROM mu), mm AS (SELECT o_orderkey, edge_z, raw / a AS mult FROM mu, nm),
scaled AS (SELECT 0 AS i, 100e0 AS scale, false AS done UNION ALL SELECT i + 1, CASE WHEN abs(avg_c - 100) < 1e-9 THEN scale ELSE scale * 100 / avg_c END, abs(avg_c - 100) < 1e-9 FROM (
  SELECT i, scale, (SELECT avg(greatest(1, round_even(scale * mult, 0))) FROM mm) AS avg_c FROM scaled WHERE i < 40 AND NOT done)),
pick AS (SELECT max_by(scale, i) AS scale FROM scaled)
SELECT o_orderkey, edge_z, greatest(1, round_even((SELECT scale FROM pick) * mult, 0)) AS contracts FROM mm""", "o_orderkey", "edge_z contracts", 5))
def _(spark, folder):
    return rounded(bt.size_whole_book(_order_bets(spark, folder)).select("o_orderkey", "edge_z", "contracts"), 5)


SUMMARY = "bets, games, round(staked, 2) AS staked, round(pnl, 2) AS pnl, round(avg_size, 4) AS avg_size, round(100 * pnl / staked, 4) AS roi_pct"


def _sum_cols(df):
    return df.select(*[c for c in df.columns if c not in ("staked", "pnl", "avg_size", "roi_pct")],
                     F.round("staked", 2).alias("staked"), F.round("pnl", 2).alias("pnl"), F.round("avg_size", 4).alias("avg_size"), F.round("roi_pct", 4).alias("roi_pct"))


@query("summary_with_total", f"""WITH {ORDER_BETS} SELECT bucket, {SUMMARY} FROM (
  SELECT coalesce(o_orderpriority, 'TOTAL') AS bucket, count(*) AS bets, count(DISTINCT o_custkey) AS games, sum(staked) AS staked, sum(pnl) AS pnl, avg(contracts) AS avg_size FROM bets GROUP BY GROUPING SETS ((o_orderpriority), ()))""")
def _(spark, folder):
    return _sum_cols(reports.summarise_by(_settled(spark, folder), "o_orderpriority", "o_custkey"))


@query("summary_views", f"""WITH {ORDER_BETS}, x AS (SELECT 'o_orderpriority' AS view, o_orderpriority AS bucket, * FROM bets UNION ALL BY NAME SELECT 'o_orderstatus' AS view, o_orderstatus AS bucket, * FROM bets UNION ALL BY NAME SELECT 'season' AS view, CAST(season AS VARCHAR) AS bucket, * FROM bets)
SELECT view, bucket, {SUMMARY} FROM (SELECT view, coalesce(bucket, 'TOTAL') AS bucket, count(*) AS bets, count(DISTINCT o_custkey) AS games, sum(staked) AS staked, sum(pnl) AS pnl, avg(contracts) AS avg_size FROM x GROUP BY GROUPING SETS ((view, bucket), (view)))""")
def _(spark, folder):
    return _sum_cols(reports.summarise_views(_settled(spark, folder), ["o_orderpriority", "o_orderstatus", "season"], "o_custkey"))


@query("error_table", shown(f"""WITH {ORDER_BETS} SELECT o_orderpriority, count(*) AS bets, count(DISTINCT o_custkey) AS games, sum(staked) AS staked, sum(pnl) AS pnl, avg(edge) AS model_p, avg(price) / 100 AS market_p, avg(won) AS actual, 100 * sum(pnl) / sum(staked) AS roi_pct,
  avg(edge) - avg(won) AS model_err, avg(price) / 100 - avg(won) AS market_err FROM bets GROUP BY 1""", "o_orderpriority bets games", "staked pnl model_p market_p actual roi_pct model_err market_err", 4))
def _(spark, folder):
    return rounded(reports.error_table(_settled(spark, folder).withColumn("p_win", F.col("edge")), "o_orderpriority", "o_custkey"), 4)


@query("concentration", shown(f"""WITH {ORDER_BETS}, g AS (SELECT o_custkey, sum(pnl) AS p FROM bets GROUP BY 1)
SELECT count(*) AS games, sum(p) AS total_pnl, (SELECT sum(p) FROM (SELECT p FROM g ORDER BY p, o_custkey LIMIT 15)) AS worst_n_pnl, quantile_cont(p, 0.5) AS median_pnl, 100 * avg(CASE WHEN p < 0 THEN 1.0 ELSE 0 END) AS losing_pct FROM g""", "games", "total_pnl worst_n_pnl median_pnl losing_pct", 4))
def _(spark, folder):
    return rounded(reports.concentration(_settled(spark, folder), 15, "o_custkey"), 4)


@query("worst_games_by_bucket", shown(f"""WITH {ORDER_BETS}, g AS (SELECT season, o_custkey, sum(pnl) AS pnl FROM bets GROUP BY 1, 2) SELECT season, o_custkey, pnl FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY pnl, o_custkey) AS n FROM g) WHERE n <= 5""", "season o_custkey", "pnl", 4))
def _(spark, folder):
    return rounded(reports.worst_games(_settled(spark, folder), "season", 5, "o_custkey"), 4)


# -- calibration tables --------------------------------------------------------------------------

CAL = "c AS (SELECT o_orderkey, greatest(0.0, least(1.0, o_totalprice / 500000)) AS p, CAST(o_orderstatus = 'F' AS INT) AS y, (1 + o_custkey % 98) / 1e2 AS mk FROM orders)"


def _cal(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("o_totalprice") / 500000)).alias("p"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), ((1 + F.col("o_custkey") % 98) / 100.0).alias("mk"))


EDGES = "e AS (SELECT " + ", ".join(f"quantile_cont(p, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM c), q AS (SELECT c.*, CAST(" + " + ".join(f"CAST(p > e{i} AS INT)" for i in range(1, 10)) + " AS INT) AS q FROM c, e)"


@query("calibration_deciles", shown(f"WITH {CAL}, {EDGES} SELECT q, count(y) AS n, avg(p) AS pred, avg(y) AS actual, avg(y) - avg(p) AS gap FROM q GROUP BY q", "q n", "pred actual gap"))
def _(spark, folder):
    return rounded(reports.calibration_deciles(_cal(spark, folder), "p", "y"))


@query("model_vs_market", shown(f"WITH {CAL}, {EDGES} SELECT q, count(y) AS n, avg(p) AS pred, avg(y) AS actual, avg(y) - avg(p) AS gap, avg(mk) AS market, avg(y) - avg(mk) AS market_gap FROM q GROUP BY q", "q n", "pred actual gap market market_gap"))
def _(spark, folder):
    return rounded(reports.calibration_deciles(_cal(spark, folder), "p", "y", "mk"))


@query("tail_calibration", shown(f"WITH {CAL}, t(cut) AS (VALUES (0.02e0), (0.05e0), (0.1e0)) SELECT 'low' AS tail, cut, count(y) AS n, avg(p) AS pred, avg(y) AS actual FROM c, t WHERE p < cut GROUP BY cut UNION ALL SELECT 'high', cut, count(y), avg(p), avg(y) FROM c, t WHERE p > 1 - cut GROUP BY cut", "tail n", "cut pred actual"))
def _(spark, folder):
    return rounded(reports.tail_calibration(_cal(spark, folder), "p", "y"))


@query("weighted_histogram", shown(f"WITH {CAL}, h AS (SELECT CAST(least(floor(p * 20), 19) AS INT) AS bin, sum(mk) AS w FROM c GROUP BY 1) SELECT CAST(g AS INT) AS bin, coalesce(w, 0) AS w FROM generate_series(0, 19) t(g) LEFT JOIN h ON g = bin", "bin", "w"))
def _(spark, folder):
    return rounded(reports.weighted_histogram(_cal(spark, folder), "p", "mk"))


@query("bet_region_weights", shown(f"""WITH {CAL}, base AS (SELECT CAST(least(floor(p * 20), 19) AS INT) AS bin, count(*) AS w FROM c GROUP BY 1), st AS (SELECT CAST(least(floor(mk * 20), 19) AS INT) AS bin, sum(mk) AS s FROM c WHERE y = 1 GROUP BY 1),
r AS (SELECT CAST(g AS INT) AS bin, CASE WHEN coalesce(w, 0) > 0 THEN coalesce(s, 0) / greatest(w, 1) ELSE 0 END AS ratio FROM generate_series(0, 19) t(g) LEFT JOIN base ON g = base.bin LEFT JOIN st ON g = st.bin)
SELECT o_orderkey, greatest(0.05e0, least(20, 1 + 0.8e0 * (ratio / (SELECT greatest(avg(ratio), 1e-9) FROM r) - 1))) AS bet_weight FROM c JOIN r ON r.bin = CAST(least(floor(p * 20), 19) AS INT)""", "o_orderkey", "bet_weight"))
def _(spark, folder):
    rows = _cal(spark, folder)
    return rounded(reports.bet_region_weights(rows, "p", rows.where("y = 1"), "mk", "mk", 0.8).select("o_orderkey", "bet_weight"))


# -- bets from events: states against prints -----------------------------------------------------

BETS_SQL = f"""{PLAYS_SQL},
sec AS (SELECT *, CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT) AS unix FROM plays),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, unix ORDER BY play_number DESC) AS n FROM sec WHERE event_type <> 'purchase') WHERE n = 1),
pr AS (SELECT game_id, unix AS pts, 1e0 + k % 98 AS px_home, 100e0 - k % 98 AS px_away FROM (SELECT *, row_number() OVER (PARTITION BY game_id, unix ORDER BY play_number) AS n FROM sec WHERE event_type = 'purchase') WHERE n = 1),
f AS (SELECT * FROM (SELECT g.* EXCLUDE (n), 1e-2 + 98e-2 * (g.play_number * 37 % 100) / 1e2 AS p_home, px_home, px_away, pts - unix - 60 AS fill_delay, row_number() OVER (PARTITION BY g.play_number ORDER BY pts) AS n
  FROM g JOIN pr ON g.game_id = pr.game_id AND pts BETWEEN unix + 60 AND unix + 60 + 21600) WHERE n = 1),
legs AS (SELECT *, 'home' AS side, 0 AS leg, px_home AS price, p_home AS p_win, CAST(home_final > away_final AS INT) AS won FROM f UNION ALL SELECT *, 'away', 1, px_away, 1 - p_home, CAST(away_final > home_final AS INT) FROM f),
chosen AS (SELECT * FROM (SELECT *, p_win - price / 100 - ceil(0.07e0 * 100 * (price / 100) * (1 - price / 100) * 100) / 100 / 100 AS edge FROM legs) WHERE edge >= 0.02)"""


def _scored(spark, folder):
    df = cut_lineage(plays(spark, folder)).withColumns({
        "wallclock": F.col("ts").cast("timestamp"),
        "p_home": 0.01 + 0.98 * (F.col("play_number") * 37 % 100) / 100.0,
        "logit_close": (F.col("user_id") % 21 - 10).cast("double"),
    })
    at = F.rint(F.unix_micros(F.col("wallclock")) / 1e6).cast("bigint")
    prints = df.where("event_type = 'purchase'").select(
        "game_id", at.alias("ts"), (1.0 + F.col("k") % 98).alias("px_home"), (100.0 - F.col("k") % 98).alias("px_away"),
        F.lit(1.0).alias("count_fp"), F.col("play_number").alias("trade_id"), "wallclock")
    from playtape.operators.dedupe import keep_first
    return df.where("event_type <> 'purchase'"), keep_first(prints, ["game_id", "ts"], ["trade_id"])


@query("select_bets", shown(f"WITH {BETS_SQL} SELECT play_number, side, price, won, fill_delay, p_win, edge FROM chosen", "play_number side won fill_delay", "price p_win edge"))
def _(spark, folder):
    states, prints = _scored(spark, folder)
    filled = bt.fill_states(bt.state_grid(states), prints, 60, 21600, at_most=game_bound(spark, folder))
    return rounded(bt.select_bets(filled).select("play_number", "side", "won", "fill_delay", "price", "p_win", "edge"))


FULL = f"""{BETS_SQL},
mom AS (SELECT *, count(*) OVER w AS bk, coalesce(sum(edge) OVER w, 0) AS s1, coalesce(sum(edge * edge) OVER w, 0) AS s2 FROM chosen WINDOW w AS (PARTITION BY season ORDER BY unix, leg, game_id, play_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dev AS (SELECT *, s1 / greatest(bk, 1) AS mn, sqrt(greatest(s2 / greatest(bk, 1) - (s1 / greatest(bk, 1)) * (s1 / greatest(bk, 1)), 0)) AS sd FROM mom),
zed AS (SELECT *, CASE WHEN bk >= 20 AND sd > 1e-12 THEN (edge - mn) / sd ELSE 0 END AS edge_z, bk >= 20 AND sd > 1e-12 AS live FROM dev),
mul AS (SELECT *, CASE WHEN live THEN greatest(0.2e0, least(3e0, 1 + edge_z)) ELSE 1e0 END AS mult FROM zed),
nrm AS (SELECT *, coalesce(sum(mult) OVER (PARTITION BY season ORDER BY unix, leg, game_id, play_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(bk, 1) AS pm FROM mul),
sized AS (SELECT *, greatest(1, round_even(100 * mult / CASE WHEN bk > 0 AND pm > 1e-6 THEN pm ELSE 1 END, 0)) AS contracts FROM nrm),
settled AS (SELECT *, contracts * price / 100 AS staked, ceil(0.07e0 * contracts * (price / 100) * (1 - price / 100) * 100) / 100 AS fee FROM sized),
bets AS (SELECT *, CASE WHEN won = 1 THEN contracts * (1 - price / 100) ELSE -contracts * (price / 100) END - fee AS pnl,
  CASE WHEN side = 'home' THEN user_id % 21 - 10 >= 0 ELSE NOT (user_id % 21 - 10 >= 0) END AS fav, CASE WHEN side = 'home' THEN score_margin ELSE -score_margin END AS lead FROM settled),
labelled AS (SELECT *, CASE WHEN edge < 0.03 THEN '2-3%' WHEN edge < 0.05 THEN '3-5%' WHEN edge < 0.075 THEN '5-7.5%' WHEN edge < 0.1 THEN '7.5-10%' WHEN edge < 0.15 THEN '10-15%' WHEN edge < 1 THEN '15%+' END AS edge_bucket,
  CASE WHEN price >= 90 THEN '90-100' WHEN price < 10 THEN '0-9' ELSE concat(CAST(floor(price / 10) * 10 AS INT), '-', CAST(floor(price / 10) * 10 + 9 AS INT)) END AS price_bucket,
  CASE WHEN lead <= -14.5 THEN 'trail 15+' WHEN lead <= -9.5 THEN 'trail 10-14' WHEN lead <= -4.5 THEN 'trail 5-9' WHEN lead <= -0.5 THEN 'trail 1-4' WHEN lead <= 0.5 THEN 'tied' WHEN lead <= 4.5 THEN 'lead 1-4' WHEN lead <= 9.5 THEN 'lead 5-9' WHEN lead <= 14.5 THEN 'lead 10-14' ELSE 'lead 15+' END AS margin_bucket,
  concat(CASE side WHEN 'home' THEN 'home ' ELSE 'road ' END, CASE WHEN fav THEN 'fav' ELSE 'dog' END) AS role, CASE WHEN fav THEN 'pregame fav' ELSE 'pregame dog' END AS favdog,
  strftime(game_date, '%Y-%m') AS month, CASE WHEN period <= 4 THEN concat('Q', period) ELSE 'OT' END AS quarter FROM bets)"""
BET_VIEWS = {"edge_bucket": "edge_bucket", "side_label": "side", "favdog": "favdog", "price_bucket": "price_bucket", "quarter": "quarter", "margin_bucket": "margin_bucket", "role": "role", "month": "month", "season": "CAST(season AS VARCHAR)"}


def _bets(spark, folder):
    states, prints = _scored(spark, folder)
    return bt.backtest(states, prints, 60, 21600, size_warmup=20, at_most=game_bound(spark, folder))


@query("bucket_bets", f"WITH {FULL} SELECT play_number, side, edge_bucket, price_bucket, margin_bucket, role, favdog, month, quarter FROM labelled")
def _(spark, folder):
    return _bets(spark, folder).select("play_number", "side", "edge_bucket", "price_bucket", "margin_bucket", "role", "favdog", "month", "quarter")


@query("backtest_bets", shown(f"WITH {FULL} SELECT * FROM labelled", "play_number side won", "contracts fee staked pnl edge edge_z", 5))
def _(spark, folder):
    return rounded(_bets(spark, folder).select("play_number", "side", "won", "contracts", "fee", "staked", "pnl", "edge", "edge_z"), 5)


@query("backtest_summary", f"""WITH {FULL}, x AS ({' UNION ALL '.join(f"SELECT '{v}' AS view, {e} AS bucket, game_id, staked, pnl, contracts FROM labelled" for v, e in BET_VIEWS.items())})
SELECT view, bucket, {SUMMARY} FROM (SELECT view, CASE WHEN grouping(bucket) = 1 THEN 'TOTAL' ELSE bucket END AS bucket, count(*) AS bets, count(DISTINCT game_id) AS games, sum(staked) AS staked, sum(pnl) AS pnl, avg(contracts) AS avg_size FROM x GROUP BY GROUPING SETS ((view, bucket), (view)))""")
def _(spark, folder):
    return _sum_cols(reports.summarise_views(cut_lineage(_bets(spark, folder))))


@query("diagnose_latest_month", shown(f"""WITH {FULL} SELECT role, count(*) AS bets, count(DISTINCT game_id) AS games, sum(staked) AS staked, sum(pnl) AS pnl, avg(p_win) AS model_p, avg(price) / 100 AS market_p, avg(won) AS actual, 100 * sum(pnl) / sum(staked) AS roi_pct,
  avg(p_win) - avg(won) AS model_err, avg(price) / 100 - avg(won) AS market_err FROM labelled WHERE month = (SELECT max(month) FROM labelled) GROUP BY 1""", "role bets games", "staked pnl model_p market_p actual roi_pct model_err market_err", 4))
def _(spark, folder):
    return rounded(reports.diagnose(cut_lineage(_bets(spark, folder)))["latest_month_role"], 4)


_TABLES = {"role": ("role", "true"), "month": ("month", "true"), **{f"road_fav_{by}": (by, "role = 'road fav'") for by in ("quarter", "price_bucket", "margin_bucket", "month")},
           **{f"latest_month_{by}": (by, "month = (SELECT max(month) FROM labelled)") for by in ("role", "price_bucket")}}
_ERRORS = """count(*) AS bets, count(DISTINCT game_id) AS games, sum(staked) AS staked, sum(pnl) AS pnl, avg(p_win) AS model_p, avg(price) / 100 AS market_p, avg(won) AS actual,
  100 * sum(pnl) / nullif(sum(staked), 0) AS roi_pct, avg(p_win) - avg(won) AS model_err, avg(price) / 100 - avg(won) AS market_err"""
_BROAD = {"road_fav_concentration": "role = 'road fav'", "latest_month_concentration": "month = (SELECT max(month) FROM labelled)"}


@query("diagnose_errors", shown(f"WITH {FULL} " + " UNION ALL ".join(f"SELECT '{name}' AS of_table, CAST({by} AS VARCHAR) AS bucket, {_ERRORS} FROM labelled WHERE {rows} GROUP BY {by}" for name, (by, rows) in _TABLES.items()),
                                "of_table bucket bets games", "staked pnl model_p market_p actual roi_pct model_err market_err", 9))
def _(spark, folder):
    found = reports.diagnose(cut_lineage(_bets(spark, folder)))
    out = None
    for name, (by, _) in _TABLES.items():
        part = found[name].withColumnRenamed(by, "bucket").withColumns({"bucket": F.col("bucket").cast("string"), "of_table": F.lit(name)})
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("of_table", "bucket", "bets", "games", "staked", "pnl", "model_p", "market_p", "actual", "roi_pct", "model_err", "market_err"), 9)


@query("diagnose_concentration", shown(f"WITH {FULL} " + " UNION ALL ".join(
    f"""SELECT '{name}' AS of_table, count(*) AS games, sum(pnl) AS total_pnl, (SELECT sum(pnl) FROM (SELECT sum(pnl) AS pnl, game_id FROM labelled WHERE {rows} GROUP BY game_id ORDER BY 1, 2 LIMIT 15) w) AS worst_n_pnl,
  quantile_cont(pnl, 0.5) AS median_pnl, 100 * avg(CAST(pnl < 0 AS DOUBLE)) AS losing_pct FROM (SELECT sum(pnl) AS pnl FROM labelled WHERE {rows} GROUP BY game_id) g""" for name, rows in _BROAD.items()),
    "of_table games", "total_pnl worst_n_pnl median_pnl losing_pct", 4))
def _(spark, folder):
    found = reports.diagnose(cut_lineage(_bets(spark, folder)))
    first, second = (found[name].withColumn("of_table", F.lit(name)) for name in _BROAD)
    return rounded(first.unionByName(second).select("of_table", "games", "total_pnl", "worst_n_pnl", "median_pnl", "losing_pct"), 4)
