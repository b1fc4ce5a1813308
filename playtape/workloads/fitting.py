"""Fits, splits, metrics, the state surface and the whole feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtape.operators.quantiles import rank_auc
from playtape.plans import box, features, fits, priors
from playtape.session import cut_lineage
from playtape.workloads.base import (
    ODDS_SQL,
    PLAYS_SQL,
    RATES_SQL,
    ROSTERS_SQL,
    game_bound,
    odds,
    plays,
    query,
    rates,
    rosters,
    rounded,
    shown,
    table,
)
from playtape.workloads.boxes import (
    CLOCK_SQL,
    LINEUP,
    LINEUP_SQL,
    LUCK,
    PREGAME,
    PREGAME_SQL,
    SEGMENTS,
    STRICT,
    _luck_sql,
)

LINES = "li AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS a, l_discount * 100 AS b, l_tax + 0.01 AS w, l_orderkey FROM lineitem)"


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"),
        (F.col("l_tax") + 0.01).alias("w"), "l_orderkey")


@query("cross_products", shown(f"WITH {LINES} " + " UNION ALL ".join(
    f"SELECT '{i}' AS i, '{j}' AS j, sum(w * {p} * {q}) / 1e6 AS value, {'sum(' + p + ' * ' + q + ') / 1e6' if i in ('1', j) else 'NULL'} AS plain FROM li"
    for n, (i, p) in enumerate((("1", "1"), ("a", "a"), ("b", "b"), ("y", "y"))) for j, q in (("1", "1"), ("a", "a"), ("b", "b"), ("y", "y"))[n:]), "i j", "value plain", 5))
def _(spark, folder):
    out = fits.cross_products(_lines(spark, folder), "y", ["a", "b"], "w")
    return rounded(out.select("i", "j", (F.col("value") / 1e6).alias("value"), (F.col("plain") / 1e6).alias("plain")), 5)


WLS = """m AS (SELECT sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * y) / sum(w) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM {rows}),
c AS (SELECT sum(w * (a - ma) * (a - ma)) AS aa, sum(w * (b - mb) * (b - mb)) AS bb, sum(w * (a - ma) * (b - mb)) AS ab, sum(w * (a - ma) * (y - my)) AS ay, sum(w * (b - mb) * (y - my)) AS byy FROM {rows}, m),
coef AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM c),
beta AS (SELECT my - ca * ma - cb * mb AS c0, ca, cb, sa, sb FROM coef, m)"""


@query("wls_ridge", shown(f"WITH {LINES}, {WLS.format(rows='li')} SELECT 'intercept' AS term, c0 AS coef, NULL AS sd_x, abs(c0) AS contrib_sd FROM beta UNION ALL SELECT 'a', ca, sa, abs(ca) * sa FROM beta UNION ALL SELECT 'b', cb, sb, abs(cb) * sb FROM beta", "term", "coef sd_x contrib_sd"))
def _(spark, folder):
    return rounded(fits.wls_ridge(_lines(spark, folder), "y", ["a", "b"], "w"))


HELD = "hold AS (SELECT *, l_orderkey % 5 = 0 AS held FROM li), train AS (SELECT * FROM hold WHERE NOT held), test AS (SELECT * FROM hold WHERE held)"


@query("select_alpha", shown(f"WITH {LINES}, {HELD}, {WLS.format(rows='train')} SELECT 1 - sum(w * pow(y - (c0 + ca * a + cb * b), 2)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)) AS r2_holdout, any_value(c0) AS c0, any_value(ca) AS ca, any_value(cb) AS cb FROM test, beta", "", "r2_holdout c0 ca cb"))
def _(spark, folder):
    df = _lines(spark, folder).withColumn("held", F.col("l_orderkey") % 5 == 0)
    out = fits.select_alpha(df, "y", ["a", "b"], "w", "held", [0.0])
    row = (out["r2_holdout"], *out["holdout_beta"])
    return rounded(spark.createDataFrame([row], "r2_holdout double, c0 double, ca double, cb double"))


@query("weighted_r2_by_band", shown(f"WITH {LINES}, p AS (SELECT *, a + 2 * b AS pred, CASE WHEN a < 15 THEN 'late' WHEN a < 40 THEN 'mid' ELSE 'early' END AS band FROM li) SELECT band, count(*) AS n, CASE WHEN count(*) >= 1000 THEN 1 - sum(pow(y - pred, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) END AS r2 FROM p GROUP BY band", "band n", "r2", 5))
def _(spark, folder):
    df = _lines(spark, folder).withColumn("pred", F.col("a") + 2 * F.col("b"))
    return rounded(fits.band_r2(df, "y", "pred", "a"), 5)


@query("log_loss_and_error", shown("WITH c AS (SELECT greatest(0.001, least(0.999, o_totalprice / 500000)) AS p, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders) SELECT -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss, avg(abs(p - y)) AS abs_error FROM c", "", "log_loss abs_error"))
def _(spark, folder):
    p, y = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("o_totalprice") / 500000)), (F.col("o_orderstatus") == "F").cast("int")
    df = table(spark, folder, "orders").select(p.alias("p"), y.alias("y"))
    return rounded(df.agg(fits.log_loss(F.col("p"), F.col("y")).alias("log_loss"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("abs_error")))


@query("rank_auc", shown("""WITH c AS (SELECT round(o_totalprice / 5000) AS p, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders), r AS (SELECT y, avg(n) OVER (PARTITION BY p) AS mr FROM (SELECT *, row_number() OVER (ORDER BY p) AS n FROM c))
SELECT (sum(CASE WHEN y = 1 THEN mr END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r""", "", "auc"))
def _(spark, folder):
    df = table(spark, folder, "orders").select(F.round(F.col("o_totalprice") / 5000).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(rank_auc(df, "p", "y"))


@query("group_split", """WITH g AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS layer FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY md5(concat(o_custkey, '|17'))) AS i, count(*) OVER (PARTITION BY layer) AS n FROM g) SELECT o_custkey, i <= round_even(n * 0.15, 0) AS picked FROM r""")
def _(spark, folder):
    g = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("layer"))
    return fits.group_split(g, "o_custkey", 0.15, 17, "layer")


@query("simple_line", shown("SELECT count(*) AS n, regr_intercept(l_extendedprice / 1000, l_quantity) AS intercept, regr_slope(l_extendedprice / 1000, l_quantity) AS slope, corr(l_extendedprice / 1000, l_quantity) AS corr FROM lineitem", "n", "intercept slope corr"))
def _(spark, folder):
    df = table(spark, folder, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"))
    return rounded(priors.simple_line(df, "y", "x", 50))


DECAY = """st AS (SELECT l_extendedprice / 1000 AS y, l_discount * 100 AS s, l_tax * 100 AS e0, l_quantity / 50 AS fl FROM lineitem)"""


def _fit_sql(ks, out):
    return f"""{out}_m AS (SELECT k, count(*) AS n, avg(y) AS my, avg(s) AS ms, avg(e) AS me, var_pop(y) AS yy, var_pop(s) AS ss, var_pop(e) AS ee, covar_pop(e, y) AS ey, covar_pop(s, y) AS sy, covar_pop(e, s) AS es FROM (SELECT k, y, s, e0 * pow(fl, k) AS e FROM st, {ks}) GROUP BY k),
{out}_b AS (SELECT *, (ey * ss - sy * es) / (ee * ss - es * es) AS b, (sy * ee - ey * es) / (ee * ss - es * es) AS c FROM {out}_m),
{out} AS (SELECT k, n, my - b * me - c * ms AS a, b, c, n * (yy - b * ey - c * sy) AS sse FROM {out}_b)"""


def _decay_states(spark, folder):
    return table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("rest_margin"), (F.col("l_discount") * 100).alias("score_margin"),
        (F.col("l_tax") * 100).alias("exp_margin"), (F.col("l_quantity") / 50).alias("frac_left"))


@query("decay_errors", shown(f"WITH {DECAY}, ks(k) AS (VALUES (0.3e0), (0.5e0), (0.75e0), (1e0), (1.25e0), (1.8e0)), {_fit_sql('ks', 'f')} SELECT k, n, a, b, c, sse / 1e6 AS sse FROM f", "n", "k a b c sse", 5))
def _(spark, folder):
    out = priors.decay_errors(_decay_states(spark, folder), [0.3, 0.5, 0.75, 1.0, 1.25, 1.8])
    return rounded(out.withColumn("sse", F.col("sse") / 1e6), 5)


@query("fit_decay_power", shown(f"""WITH {DECAY}, ks(k) AS (SELECT round(0.3e0 + 0.05e0 * i, 4) FROM generate_series(0, 30) t(i)), {_fit_sql('ks', 'f')}, best AS (SELECT k FROM f ORDER BY sse, k LIMIT 1),
fine(k) AS (SELECT DISTINCT greatest(0.3e0, least(1.8e0, round((SELECT k FROM best) - 0.05e0 + 0.01e0 * i, 4))) FROM generate_series(0, 10) t(i)), {_fit_sql('fine', 'g')}
SELECT round(k, 4) AS k, n, a, b, c FROM (SELECT * FROM g UNION ALL SELECT * FROM f) ORDER BY sse LIMIT 1""", "n", "k a b c", 5))
def _(spark, folder):
    out = priors.fit_decay_power(_decay_states(spark, folder), min_states=1000)
    row = (out["sim_decay_pow"], out["sim_decay_n"], out["sim_decay_home_resid"], out["sim_decay_b"], out["sim_decay_score_coef"])
    return rounded(spark.createDataFrame([row], "k double, n bigint, a double, b double, c double"), 5)


@query("fit_state_surface", shown("""WITH s AS (SELECT CAST(floor(l_quantity / 10) AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS d, CAST(l_linestatus = 'F' AS INT) AS y FROM lineitem),
c AS (SELECT q, d, avg(y) AS mean, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT d, avg(y) AS block FROM s GROUP BY 1) SELECT d, q, n, CASE WHEN n >= 1000 THEN mean ELSE block END AS wp FROM c JOIN b USING (d)""", "d q n", "wp"))
def _(spark, folder):
    s = table(spark, folder, "lineitem").select(
        F.floor(F.col("l_quantity") / 10).cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return rounded(priors.fit_state_surface(s, ["q", "d"], ["d"], "y", 1000))


@query("binned_mean", """WITH b AS (SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 WHEN l_quantity < 45 THEN 2 END AS tl, CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.2 THEN 1 END AS mg, l_tax FROM lineitem),
c AS (SELECT tl, mg, avg(l_tax) AS mean, count(*) AS n FROM b GROUP BY 1, 2)
SELECT CAST(t AS INT) AS tl, CAST(g AS INT) AS mg, CAST(coalesce(n, 0) AS BIGINT) AS n, round(CASE WHEN n >= 4000 THEN mean ELSE (SELECT avg(l_tax) FROM lineitem) END, 6) AS value FROM generate_series(0, 2) a(t) CROSS JOIN generate_series(0, 1) x(g) LEFT JOIN c ON tl = t AND mg = g""")
def _(spark, folder):
    return rounded(priors.binned_mean(table(spark, folder, "lineitem"), F.col("l_quantity"), [0, 10, 30, 45], F.col("l_discount"), [0, 0.03, 0.2], "l_tax", 4000))


@query("decay_states", shown(f"""WITH {PLAYS_SQL}, {ODDS_SQL} SELECT play_number, greatest(0, least(1, seconds_left_reg / 2880)) AS frac_left, score_margin, home_final - away_final - score_margin AS rest_margin, -home_spread_close AS exp_margin
 FROM plays JOIN odds ON plays.game_id = odds.espn_game_id WHERE period <= 4 AND home_final <> away_final AND home_spread_close IS NOT NULL""".replace("SELECT play_number, ", "SELECT plays.game_id, "), "game_id", "frac_left score_margin rest_margin exp_margin", 8))
def _(spark, folder):
    return rounded(priors.decay_states(plays(spark, folder), odds(spark, folder)), 8)


@query("edge_target", shown(f"""WITH {PLAYS_SQL}, {ODDS_SQL}, t AS (SELECT play_number, home_final - away_final - score_margin AS rest_margin, (1 + k) / 2e0 AS n_half, -home_spread_close AS ex FROM plays JOIN odds ON plays.game_id = odds.espn_game_id)
SELECT play_number, rest_margin / n_half AS realized_edge, pow(n_half, 0.5) AS fit_weight, ex AS exp_margin_full FROM t WHERE n_half >= 5 AND ex IS NOT NULL""", "play_number", "realized_edge fit_weight exp_margin_full"))
def _(spark, folder):
    o = odds(spark, folder).withColumnRenamed("espn_game_id", "game_id")
    df = plays(spark, folder).join(o, "game_id").withColumn("sim_n_poss", (1 + F.col("k")).cast("double"))
    out = fits.edge_target(df, predictors=["exp_margin_full", "value"])
    return rounded(out.select("play_number", "realized_edge", "fit_weight", "exp_margin_full"))


# -- surface and the whole feature table ---------------------------------------------------------

PRIORS = features.Priors(0.36, 0.52, 0.78, 0.8, 14.5, [0.5, 0.2, 0.2, 0.1, 0.0], None, 0.001, {"exp_margin_full": 0.01, "frac_left": 0.02})
SIM_SQL = f"""{SEGMENTS.split(STRICT + ',')[1]},
seg_cells AS (SELECT duration, CASE WHEN seconds_left_reg < 0 THEN NULL WHEN seconds_left_reg < 30 THEN 0 WHEN seconds_left_reg < 60 THEN 1 WHEN seconds_left_reg < 120 THEN 2 WHEN seconds_left_reg < 300 THEN 3 WHEN seconds_left_reg < 720 THEN 4 WHEN seconds_left_reg < 3000 THEN 5 END AS tl,
  CASE WHEN m < -15 THEN 0 WHEN m < -9 THEN 1 WHEN m < -5 THEN 2 WHEN m < -2 THEN 3 WHEN m < 0 THEN 4 WHEN m < 2 THEN 5 WHEN m < 5 THEN 6 WHEN m < 9 THEN 7 WHEN m < 15 THEN 8 ELSE 9 END AS mg
  FROM (SELECT *, CASE WHEN possession > 0 THEN margin_start ELSE -margin_start END AS m FROM segments WHERE period <= 4)),
cell_means AS (SELECT tl, mg, avg(duration) AS mean, count(*) AS n FROM seg_cells GROUP BY 1, 2),
sim0 AS (SELECT *, CASE WHEN h < 30 THEN 0 WHEN h < 60 THEN 1 WHEN h < 120 THEN 2 WHEN h < 300 THEN 3 WHEN h < 720 THEN 4 ELSE 5 END AS tl, CASE WHEN om < -15 THEN 0 WHEN om < -9 THEN 1 WHEN om < -5 THEN 2 WHEN om < -2 THEN 3 WHEN om < 0 THEN 4 WHEN om < 2 THEN 5 WHEN om < 5 THEN 6 WHEN om < 9 THEN 7 WHEN om < 15 THEN 8 ELSE 9 END AS mg
  FROM (SELECT *, seconds_left_horizon AS h, CASE WHEN possession > 0 THEN score_margin ELSE -score_margin END AS om FROM clocked)),
sim1 AS (SELECT s.*, CASE WHEN total_close / 0.9e0 > 40 THEN total_close / 0.9e0 ELSE 2880 / 14.5e0 END AS expected, CASE WHEN c.n >= 20 THEN c.mean ELSE (SELECT avg(duration) FROM seg_cells) END AS sec FROM sim0 s LEFT JOIN cell_means c ON s.tl = c.tl AND s.mg = c.mg),
sim2 AS (SELECT *, greatest(0, least(250, h / greatest(sec * greatest(0.75e0, least(1.35e0, (2880 / 14.5e0) / expected)), 1))) AS sim_n_poss, greatest(-0.3e0, least(0.3e0, 0.001e0 + 0.01e0 * coalesce(-home_spread_close, 0) + 0.02e0 * coalesce(frac_left, 0))) AS sim_adv FROM sim1),
sim3 AS (SELECT *, CAST(greatest(0, least(30, round_even((sim_adv - (-0.3e0)) / 0.02e0, 0))) AS INT) AS ec, CAST(round_even(sim_n_poss, 0) AS INT) AS pc, CAST(greatest(-60, least(60, score_margin)) AS INT) AS mc, CAST(possession > 0 AS INT) AS ball FROM sim2),
surf_cells AS (SELECT ec, pc, mc, ball, avg(home_won) AS mean, count(*) AS n FROM sim3 GROUP BY 1, 2, 3, 4), surf_blocks AS (SELECT mc, ball, avg(home_won) AS block FROM sim3 GROUP BY 1, 2),
surface AS (SELECT c.*, CASE WHEN n >= 2 THEN mean ELSE block END AS wp FROM surf_cells c JOIN surf_blocks b ON c.mc = b.mc AND c.ball = b.ball),
sim4 AS (SELECT s.play_number, s.sim_n_poss, s.sim_adv, a.wp AS sim_wp, o.wp AS other, z.wp AS sim_wp_neutral FROM sim3 s LEFT JOIN surface a ON s.ec = a.ec AND s.pc = a.pc AND s.mc = a.mc AND s.ball = a.ball
  LEFT JOIN surface o ON s.ec = o.ec AND s.pc = o.pc AND s.mc = o.mc AND 1 - s.ball = o.ball LEFT JOIN surface z ON z.ec = 15 AND s.pc = z.pc AND s.mc = z.mc AND s.ball = z.ball),
sim AS (SELECT *, CASE WHEN sim_wp IS NOT NULL THEN ln(greatest(1e-6, least(1 - 1e-6, sim_wp)) / (1 - greatest(1e-6, least(1 - 1e-6, sim_wp)))) END AS sim_logit, sim_wp - other AS sim_ball_value, sim_wp - sim_wp_neutral AS sim_pregame_lift FROM sim4)"""
SIM = "sim_n_poss sim_adv sim_wp sim_logit sim_ball_value sim_pregame_lift"


def _sim_inputs(spark, folder, pbp=None):
    """(states with clock, odds and possession; seconds grid; surface measured on the same states).

    The grid and the surface are parameter tables, written once like those of earlier seasons would be.
    """
    bound = game_bound(spark, folder)
    states = features.possession_state(features.parse_events(plays(spark, folder) if pbp is None else pbp), at_most=bound)
    # read by the grid, the surface and the caller: the columns they take are stored once
    states = cut_lineage(states.select(
        "game_id", "play_number", "possession", "home_score", "away_score", "score_margin", "home_won", "period", "seconds_elapsed",
        "seconds_left_reg", "pc_seconds_left"))
    grid = cut_lineage(priors.possession_seconds(box.possession_segments(states, at_most=bound), 20))
    df = features.clock_features(states).join(odds(spark, folder).withColumnRenamed("espn_game_id", "game_id"), "game_id", "left")
    df = features.possessions_left(df.withColumn("exp_margin_left", F.lit(0.0)), grid, PRIORS)
    df = df.withColumn("sim_adv", features.per_possession_edge(df, PRIORS))
    cells = features.surface_keys(F.col("sim_adv"), F.col("sim_n_poss"), F.col("score_margin"))
    keyed = cut_lineage(df.select("home_won", *[v.alias(k) for k, v in cells.items()], (F.col("possession") > 0).cast("int").alias("ball")))
    surface = cut_lineage(priors.fit_state_surface(keyed, [*cells, "ball"], ["margin_cell", "ball"], "home_won", 2))
    return df, grid, surface


@query("possessions_left", shown(f"WITH {STRICT}, {ODDS_SQL}, {CLOCK_SQL}, {SIM_SQL} SELECT * FROM sim", "play_number", "sim_n_poss sim_adv", 8))
def _(spark, folder):
    df, _, _ = _sim_inputs(spark, folder)
    return rounded(df.select("play_number", "sim_n_poss", "sim_adv"), 8)


@query("surface_features", shown(f"WITH {STRICT}, {ODDS_SQL}, {CLOCK_SQL}, {SIM_SQL} SELECT * FROM sim", "play_number", SIM, 8))
def _(spark, folder):
    df, _, surface = _sim_inputs(spark, folder)
    return rounded(features.surface_features(df, surface).select("play_number", *SIM.split()), 8)


TABLE_FEATURES = [c for c in PREGAME + LUCK.split() + LINEUP.split() + SIM.split() if c not in ("rest_rapm_resid", "fg3_luck_home_pts", "fg3_luck_away_pts")]


@query("build_features", shown(f"""WITH {STRICT}, {ODDS_SQL}, {RATES_SQL}, {ROSTERS_SQL}, {CLOCK_SQL}, {PREGAME_SQL}, {_luck_sql()}, {LINEUP_SQL}, {SIM_SQL}
SELECT p.play_number, p.home_won, {', '.join(f"{'p' if c in PREGAME else 'l' if c in LUCK.split() else 'n' if c in LINEUP.split() else 's'}.{c}" for c in TABLE_FEATURES)}
FROM pregame p JOIN luck l USING (play_number) JOIN line n USING (play_number) JOIN sim s USING (play_number) WHERE p.season_type = 2 AND p.home_final <> p.away_final""", "play_number home_won", " ".join(TABLE_FEATURES), 8))
def _(spark, folder):
    stored = cut_lineage(plays(spark, folder))
    _, grid, surface = _sim_inputs(spark, folder, stored)
    p = stored.withColumn("wallclock", F.col("ts").cast("string"))
    codes = p.select("home_team").distinct()
    out = features.build_features(p, odds(spark, folder), rates(spark, folder), rosters(spark, folder), grid, surface, PRIORS, teams=codes, min_games=10, at_most=game_bound(spark, folder))
    return rounded(out.select("play_number", "home_won", *TABLE_FEATURES), 8)
