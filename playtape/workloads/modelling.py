"""Calibrators and boosted models on a probability made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtape.plans import fits
from playtape.workloads.base import query, rounded, shown, table

POOLED = "c AS (SELECT round(greatest(0.0, least(1.0, o_totalprice / 500000)), 2) AS p, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders)"


def _pooled(spark, folder):
    p = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("o_totalprice") / 500000)), 2)
    return table(spark, folder, "orders").select(
        p.alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_custkey") % 2 == 0).alias("half"),
        "o_custkey", F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 7).cast("double").alias("x1"))


@query("isotonic", shown(f"""WITH {POOLED}, g AS (SELECT p, sum(y) AS s, count(*) AS n, row_number() OVER (ORDER BY p) AS i FROM c GROUP BY p), cum AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn FROM g),
pair AS (SELECT a.i AS lo, b.i AS hi, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM cum a JOIN cum b ON a.i <= b.i),
low AS (SELECT k.i AS i, x.lo AS lo, min(x.mean) AS m FROM g k JOIN pair x ON x.lo <= k.i AND x.hi >= k.i GROUP BY 1, 2)
SELECT g.p, max(m) AS fitted FROM low JOIN g ON g.i = low.i GROUP BY g.p""", "", "p fitted"))
def _(spark, folder):
    df = _pooled(spark, folder)
    cal = fits.fit_calibrator(df, "isotonic", "p", "y")
    return rounded(df.select("p").distinct().select("p", fits.apply_calibrator(cal, F.col("p")).alias("fitted")))


@query("tail_blend", shown(f"""WITH {POOLED} SELECT p, w * iso + (1 - w) * p AS fitted FROM (SELECT DISTINCT p, greatest(greatest(0, least(1, (0.2e0 - p) / 0.1e0)), greatest(0, least(1, (p - 0.8e0) / 0.1e0))) AS w,
 CASE WHEN p <= 0.1 THEN 0.02e0 WHEN p <= 0.5 THEN 0.02e0 + 0.38e0 * (p - 0.1e0) / 0.4e0 WHEN p <= 0.9 THEN 0.4e0 + 0.55e0 * (p - 0.5e0) / 0.4e0 ELSE 0.95e0 END AS iso FROM c)""", "", "p fitted"))
def _(spark, folder):
    cal = {"kind": "tail_iso", "lo": 0.1, "hi": 0.9, "x": [0.1, 0.5, 0.9], "y": [0.02, 0.4, 0.95]}
    return rounded(_pooled(spark, folder).select("p").distinct().select("p", fits.apply_calibrator(cal, F.col("p")).alias("fitted")))


_Z = "ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))"


def _newton(cells: str) -> str:
    """CTE ``line``: slope and intercept per half by thirty Newton steps on ``cells`` (half, z, s, n)."""
    return f"""line AS (SELECT half, 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM {cells} GROUP BY half UNION ALL
  SELECT half, k + 1, a + (ga * hbb - gb * hab) / (haa * hbb - hab * hab), b + (gb * haa - ga * hab) / (haa * hbb - hab * hab) FROM (
    SELECT half, k, a, b, sum(z * (s - n * q)) AS ga, sum(s - n * q) AS gb, sum(n * q * (1 - q) * z * z) AS haa, sum(n * q * (1 - q) * z) AS hab, sum(n * q * (1 - q)) AS hbb
    FROM (SELECT l.*, c.z, c.s, c.n, 1 / (1 + exp(-(a * z + b))) AS q FROM line l JOIN {cells} c ON l.half = c.half WHERE k < 30) x GROUP BY half, k, a, b) y)"""


@query("platt", shown(f"""WITH RECURSIVE {POOLED}, cells AS (SELECT 0 AS half, {_Z} AS z, sum(y) AS s, count(*) AS n FROM c GROUP BY p), {_newton('cells')}
SELECT DISTINCT p, 1 / (1 + exp(-(a * {_Z} + b))) AS fitted FROM c, line WHERE k = 30""", "", "p fitted", 4))
def _(spark, folder):
    df = _pooled(spark, folder)
    cal = fits.fit_calibrator(df, "platt", "p", "y")
    return rounded(df.select("p").distinct().select("p", fits.apply_calibrator(cal, F.col("p")).alias("fitted")), 4)


TAIL_CUTS = [0.05, 0.1, 0.2]
_BLEND = "greatest(greatest(0, least(1, (2 * {c}e0 - p) / {c}e0)), greatest(0, least(1, (p - 1 + 2 * {c}e0) / {c}e0)))"


@query("choose_calibrator", shown(f"""WITH RECURSIVE c AS (SELECT round(greatest(0.0, least(1.0, o_totalprice / 500000)), 2) AS p, CAST(o_orderstatus = 'F' AS INT) AS y, o_custkey % 2 = 0 AS half FROM orders),
cells AS (SELECT half, p, {_Z} AS z, sum(y) AS s, count(*) AS n, row_number() OVER (PARTITION BY half ORDER BY p) AS i FROM c GROUP BY half, p), {_newton('cells')},
cum AS (SELECT *, sum(s) OVER (PARTITION BY half ORDER BY i) AS cs, sum(n) OVER (PARTITION BY half ORDER BY i) AS cn FROM cells),
pair AS (SELECT a.half, a.i AS lo, b.i AS hi, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM cum a JOIN cum b ON a.half = b.half AND a.i <= b.i),
low AS (SELECT k.half, k.p, x.lo, min(x.mean) AS m FROM cells k JOIN pair x ON x.half = k.half AND x.lo <= k.i AND x.hi >= k.i GROUP BY 1, 2, 3),
iso AS (SELECT half, p, max(m) AS v FROM low GROUP BY 1, 2),
asked AS (SELECT NOT half AS half, p, y FROM c),
ends AS (SELECT a.half, a.p, max(i.p) FILTER (i.p <= a.p) AS x0, min(i.p) FILTER (i.p >= a.p) AS x1 FROM (SELECT DISTINCT half, p FROM asked) a JOIN iso i ON i.half = a.half GROUP BY 1, 2),
curve AS (SELECT e.half, e.p, CASE WHEN x0 IS NULL THEN u.v WHEN x1 IS NULL OR x0 = x1 THEN l.v ELSE l.v + (u.v - l.v) * (e.p - x0) / (x1 - x0) END AS iso
  FROM ends e LEFT JOIN iso l ON l.half = e.half AND l.p = x0 LEFT JOIN iso u ON u.half = e.half AND u.p = x1),
scored AS (SELECT a.half, a.p, a.y, iso, 1 / (1 + exp(-(l.a * {_Z.replace('p)', 'a.p)')} + l.b))) AS platt FROM asked a JOIN curve k ON k.half = a.half AND k.p = a.p JOIN line l ON l.half = a.half AND l.k = 30),
kinds AS (SELECT half, y, 'raw' AS kind, p AS q FROM scored UNION ALL SELECT half, y, 'platt', platt FROM scored UNION ALL SELECT half, y, 'isotonic', iso FROM scored
  {' '.join(f"UNION ALL SELECT half, y, 'tail_iso_{c}', {_BLEND.format(c=c)} * iso + (1 - {_BLEND.format(c=c)}) * p FROM scored" for c in TAIL_CUTS)}),
losses AS (SELECT kind, -avg(y * ln(greatest(1e-6, least(1 - 1e-6, q))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, q)))) AS log_loss FROM kinds GROUP BY 1)
SELECT kind, log_loss, log_loss = min(log_loss) OVER () AS chosen FROM losses""", "kind chosen", "log_loss"))
def _(spark, folder):
    out = fits.choose_calibrator(_pooled(spark, folder), "p", "y", "half", TAIL_CUTS)
    rows = [(k, v, k == out["chosen"]) for k, v in out["scores"].items()]
    return rounded(spark.createDataFrame(rows, "kind string, log_loss double, chosen boolean"))


@query("boosted_ensemble")
def _(spark, folder):
    df = _pooled(spark, folder).withColumn("base", F.lit(0.0))
    members = fits.boosted_ensemble(df, ["p", "x1", "base"], "y", "o_custkey", "base")
    scored = fits.predict_ensemble(df, members, ["p", "x1", "base"], "base")
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), fits.log_loss(F.col("p_home"), F.col("y")).alias("log_loss"), F.avg("p_home").alias("mean_p")))


@query("edge_gbm")
def _(spark, folder):
    df = _pooled(spark, folder).select(F.col("y").cast("double").alias("y"), "p", "x1", F.lit(1.0).alias("w"), (F.col("o_custkey") % 5 == 0).alias("held"))
    linear = fits.select_alpha(df, "y", ["p", "x1"], "w", "held", [0.0, 1.0, 10.0])["scores"]
    _, report = fits.edge_gbm(df, "y", ["p", "x1"], "w", "held", max(linear.values()), depth=3, eta=0.2, rounds=20, min_child=20)
    row = (report["r2_holdout_gbm"], report["r2_holdout_linear"], report["beats_linear"])
    return rounded(spark.createDataFrame([row], "r2_holdout_gbm double, r2_holdout_linear double, beats_linear boolean"))
