"""Least-squares fits from cross-products, splits, metrics, calibrators and the boosted models."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.fixed_values import CALIBRATOR_KINDS, EDGE_PREDICTORS
from playtape.functions.numeric import clip, finite_or, logit, sigmoid
from playtape.operators.filters import drop_names, require_columns
from playtape.operators.ordered import constants, ordered, row_number, running_sum, scan
from playtape.session import cut_lineage, ensure_checkpoint_dir

# -- regression target ---------------------------------------------------------------------------


def edge_target(features: DataFrame, min_poss: float = 5.0, weight_pow: float = 0.5,
                predictors: Sequence[str] = EDGE_PREDICTORS, dropped: Sequence[str] = ()) -> DataFrame:
    """Realised edge per possession, its fit weight, and complete predictors."""
    names, _ = drop_names(list(predictors), list(dropped), strict=True)
    df = require_columns(features, ["home_final", "away_final", "score_margin", "sim_n_poss", "home_spread_close"])
    df = df.withColumns({
        "exp_margin_full": -F.col("home_spread_close"),
        "rest_margin": (F.col("home_final") - F.col("away_final")) - F.col("score_margin"),
        "n_half": F.col("sim_n_poss") / 2.0,
    }).where(F.col("n_half") >= min_poss)
    df = df.withColumns({
        "realized_edge": F.col("rest_margin") / F.col("n_half"),
        "fit_weight": F.pow("n_half", F.lit(float(weight_pow))),
    })
    whole = {c: finite_or(F.col(c).cast("double"), None) for c in ["realized_edge", *names]}
    return df.withColumns(whole).dropna(subset=list(whole))


# -- weighted ridge from one aggregate -----------------------------------------------------------


def cross_products(df: DataFrame, y: str, xs: Sequence[str], w: str, by: Sequence[str] = ()) -> DataFrame:
    """Long table (i, j, value) of weighted cross-products, plus the unweighted sums used to standardise.

    Variables are the intercept ``1``, the predictors and the target. ``value`` is sum(w*i*j); ``plain`` is
    sum(i*j), kept only for sums and squares. One map-side combined aggregate, sized by the predictors.
    """
    names = ["1", *xs, y]

    def v(n: str) -> Column:
        return F.lit(1.0) if n == "1" else F.col(n).cast("double")

    sums, labels = [], []
    for a, i in enumerate(names):
        for j in names[a:]:
            k = len(labels)
            sums.append(F.sum(F.col(w) * v(i) * v(j)).alias(f"w{k}"))
            if i == "1" or i == j:
                sums.append(F.sum(v(i) * v(j)).alias(f"p{k}"))
            labels.append((i, j))
    one = df.groupBy(*by).agg(*sums)
    entries = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"w{k}").alias("value"),
            (F.col(f"p{k}") if i == "1" or i == j else F.lit(None).cast("double")).alias("plain"),
        )
        for k, (i, j) in enumerate(labels)
    ])).alias("e")
    return one.select(*by, entries).select(*by, "e.*")


class Gram:
    """Cross-products of one set of rows, collected: predictors-by-predictors numbers."""

    def __init__(self, rows, y: str, xs: Sequence[str]):
        self.xs, names = list(xs), ["1", *xs, y]
        place = {n: k for k, n in enumerate(names)}
        self.w = np.zeros((len(names), len(names)))
        self.p = np.zeros_like(self.w)
        for r in rows:
            a, b = place[r.i], place[r.j]
            self.w[a, b] = self.w[b, a] = r.value
            self.p[a, b] = self.p[b, a] = r.plain or 0.0

    def __add__(self, other: Gram) -> Gram:
        out = Gram([], "_y", self.xs)
        out.w, out.p = self.w + other.w, self.p + other.p
        return out

    def scale(self) -> tuple[np.ndarray, np.ndarray]:
        """Unweighted mean and population deviation of each predictor."""
        n = self.p[0, 0]
        mean = self.p[0, 1:-1] / n
        var = np.maximum(np.diag(self.p)[1:-1] / n - mean**2, 0.0)
        sd = np.sqrt(var)
        return mean, np.where(sd > 1e-9, sd, 1.0)

    def fit(self, alpha: float = 0.0) -> np.ndarray:
        """Coefficients in raw units, intercept first; the penalty acts on standardised predictors."""
        mean, sd = self.scale()
        k = len(self.xs) + 1
        to_z = np.eye(k)
        to_z[1:, 0] = -mean / sd
        to_z[1:, 1:] = np.diag(1.0 / sd)
        a = to_z @ self.w[:k, :k] @ to_z.T + alpha * np.diag([0.0] + [1.0] * (k - 1))
        beta_z = np.linalg.lstsq(a, to_z @ self.w[:k, -1], rcond=None)[0]
        beta = beta_z.copy()
        beta[1:] = beta_z[1:] / sd
        beta[0] = beta_z[0] - beta[1:] @ mean
        return beta

    def r2(self, beta: np.ndarray) -> float:
        """Weighted R squared of given coefficients on these rows."""
        k, w = len(beta), self.w
        rss = w[-1, -1] - 2 * beta @ w[:k, -1] + beta @ w[:k, :k] @ beta
        tss = w[-1, -1] - w[0, -1] ** 2 / w[0, 0]
        return float(1.0 - rss / tss)


def wls_ridge(df: DataFrame, y: str, xs: Sequence[str], w: str, alpha: float = 0.0) -> DataFrame:
    """(term, coef, sd_x, contrib_sd) of a weighted ridge fit, largest contribution first."""
    gram = Gram(cross_products(df, y, xs, w).collect(), y, xs)
    return coef_table(df.sparkSession, gram, gram.fit(alpha))


def coef_table(spark, gram: Gram, beta: np.ndarray) -> DataFrame:
    n = gram.p[0, 0]
    sd = np.sqrt(np.maximum(np.diag(gram.p)[1:-1] / n - (gram.p[0, 1:-1] / n) ** 2, 0.0))
    rows = [("intercept", float(beta[0]), None, abs(float(beta[0])))]
    rows += [(x, float(b), float(s), abs(float(b)) * float(s)) for x, b, s in zip(gram.xs, beta[1:], sd)]
    rows.sort(key=lambda r: -r[3])
    return spark.createDataFrame(rows, "term string, coef double, sd_x double, contrib_sd double")


def linear_score(beta: Sequence[float], xs: Sequence[str]) -> Column:
    out = F.lit(float(beta[0]))
    for x, b in zip(xs, beta[1:]):
        out = out + F.lit(float(b)) * F.col(x)
    return out


def select_alpha(df: DataFrame, y: str, xs: Sequence[str], w: str, holdout: str, alphas: Sequence[float] = (0.0,)) -> dict:
    """Penalty with the best weighted R squared on held-out games, refitted on everything.

    One pass gives the cross-products of both folds; every penalty is solved from them.
    """
    rows = cross_products(df, y, xs, w, [holdout]).collect()
    train = Gram([r for r in rows if not r[holdout]], y, xs)
    held = Gram([r for r in rows if r[holdout]], y, xs)
    scores = {a: held.r2(train.fit(a)) for a in alphas}
    alpha = max(scores, key=scores.get)
    both = train + held
    beta = both.fit(alpha)
    return {
        "alpha": alpha, "r2_holdout": scores[alpha], "scores": scores, "r2": both.r2(beta),
        "intercept": float(beta[0]), "coefs": {x: float(b) for x, b in zip(xs, beta[1:])},
        "holdout_beta": [float(b) for b in train.fit(alpha)],
    }


def weighted_r2(df: DataFrame, y: str, pred: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - weighted residual over weighted total sum of squares."""
    rows = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(w) * F.pow(F.col(y) - F.col(pred), 2)).alias("rss"),
        F.sum(w).alias("w"), F.sum(F.col(w) * F.col(y)).alias("wy"), F.sum(F.col(w) * F.col(y) * F.col(y)).alias("wyy"),
    )
    total = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")
    return rows.select(*by, "n", (1.0 - F.try_divide(F.col("rss"), total)).alias("r2"))


def possession_band(n_half: Column) -> Column:
    return F.when(n_half < 15, "late").when(n_half < 40, "mid").otherwise("early")


def band_r2(df: DataFrame, y: str, pred: str, n_half: str = "n_half", min_rows: int = 1000) -> DataFrame:
    """Unweighted R squared inside each possession band, null where a band is thin."""
    banded = df.withColumns({"band": possession_band(F.col(n_half)), "_w": F.lit(1.0)})
    out = weighted_r2(banded, y, pred, "_w", ["band"])
    return out.select("band", "n", F.when(F.col("n") >= min_rows, F.col("r2")).alias("r2"))


# -- split by game -------------------------------------------------------------------------------


def group_split(groups: DataFrame, key: str, frac: float, seed: int, strata: str | None = None,
                hot_rows: int | None = None) -> DataFrame:
    """Distinct groups with ``picked``: the exact rounded share per stratum, in the order of a seeded hash."""
    layer = F.coalesce(F.col(strata).cast("string"), F.lit("-1")) if strata else F.lit("all")
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    rows = groups.select(key, layer.alias("_layer")).distinct()
    rows = rows.withColumns({
        "_hash": F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"),
        "_rest": F.conv(F.substring(digest, 13, 12), 16, 10).cast("bigint"),
    })
    o = scan(ordered(rows, ["_layer"], ["_hash", "_rest"], hot_rows), _i=row_number())
    sizes = cut_lineage(rows.groupBy("_layer").agg(F.count(F.lit(1)).alias("_n")))
    out = o.result().join(sizes, "_layer")
    return out.select(key, (F.col("_i") <= F.rint(F.col("_n") * F.lit(float(frac)))).alias("picked"))


def log_loss(p: Column, y: Column) -> Column:
    q = clip(p, 1e-15, 1 - 1e-15)
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


# -- calibrators ---------------------------------------------------------------------------------


def fit_calibrator(df: DataFrame, kind: str, p: str, y: str) -> dict:
    """Parameters of one calibrator: nothing for raw, a line on the logit, or isotonic knots."""
    if kind.startswith("tail_iso"):
        low = float(kind.split("_")[-1])
        return {"kind": "tail_iso", "lo": low, "hi": 1.0 - low, **_isotonic_knots(df, p, y)}
    if kind == "isotonic":
        return {"kind": "isotonic", **_isotonic_knots(df, p, y)}
    if kind == "platt":
        rows = VectorAssembler(inputCols=["_z"], outputCol="_f").transform(
            df.select(logit(F.col(p)).alias("_z"), F.col(y).cast("double").alias("_y"))
        )
        fit = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=0.0, standardization=False, tol=1e-10,
                                 maxIter=200).fit(rows)
        return {"kind": "platt", "a": float(fit.coefficients[0]), "b": float(fit.intercept)}
    if kind == "raw":
        return {"kind": "raw"}
    raise ValueError(f"unknown calibrator {kind!r}")


def _isotonic_knots(df: DataFrame, p: str, y: str) -> dict:
    # equal scores are pooled first, so the solver sees each score once
    pooled = df.groupBy(F.col(p).alias("_p")).agg(F.avg(F.col(y).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    fit = IsotonicRegression(featuresCol="_p", labelCol="_y", weightCol="_w").fit(pooled)
    return {"x": [float(v) for v in fit.boundaries], "y": [float(v) for v in fit.predictions]}


def interpolate(p: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear curve through the knots, flat outside, found by bisection over a literal array."""
    if len(xs) == 1:
        return F.lit(float(ys[0]))
    x, y = constants(xs), constants(ys)
    strides = [1 << i for i in range(len(xs).bit_length() - 1, -1, -1)]

    def advance(at: Column, stride: Column) -> Column:
        probe = at + stride
        return F.when((probe <= len(xs)) & (F.get(x, probe - 1) <= p), probe).otherwise(at)

    below = F.aggregate(F.array(*[F.lit(i) for i in strides]), F.lit(0), advance)
    i = F.greatest(F.least(below, F.lit(len(xs) - 1)), F.lit(1))
    x0, x1, y0, y1 = F.get(x, i - 1), F.get(x, i), F.get(y, i - 1), F.get(y, i)
    inside = y0 + (y1 - y0) * F.try_divide(p - x0, x1 - x0)
    return F.when(p <= float(xs[0]), float(ys[0])).when(p >= float(xs[-1]), float(ys[-1])).otherwise(
        F.coalesce(inside, y1)
    )


def apply_calibrator(cal: dict, p: Column) -> Column:
    kind = cal["kind"]
    if kind not in CALIBRATOR_KINDS:
        raise ValueError(f"calibrator kind {kind!r} is not known; refusing to score uncalibrated")
    if kind == "platt":
        return sigmoid(F.lit(cal["a"]) * logit(p) + F.lit(cal["b"]))
    if kind == "isotonic":
        return interpolate(p, cal["x"], cal["y"])
    if kind == "tail_iso":
        low, high = cal["lo"], cal["hi"]
        share = F.greatest(
            clip((2.0 * low - p) / max(low, 1e-9), 0.0, 1.0),
            clip((p - (2.0 * high - 1.0)) / max(1.0 - high, 1e-9), 0.0, 1.0),
        )
        return share * interpolate(p, cal["x"], cal["y"]) + (1.0 - share) * p
    return p


def choose_calibrator(df: DataFrame, p: str, y: str, half: str, tail_cuts: Sequence[float] = (0.05, 0.10, 0.20)) -> dict:
    """Cross-fit every kind on the two halves of the games; the lowest log loss is refitted on all rows."""
    df, scores = cut_lineage(df.select(p, y, half)), {}
    for kind in ["raw", "platt", "isotonic", *[f"tail_iso_{c}" for c in tail_cuts]]:
        total, rows = 0.0, 0
        for fit_half in (True, False):
            cal = fit_calibrator(df.where(F.col(half) == fit_half), kind, p, y)
            scored = df.where(F.col(half) != fit_half).agg(
                log_loss(clip(apply_calibrator(cal, F.col(p)), 1e-6, 1 - 1e-6), F.col(y)).alias("l"),
                F.count(F.lit(1)).alias("n"),
            ).first()
            total, rows = total + scored.l * scored.n, rows + scored.n
        scores[kind] = total / rows
    chosen = min(scores, key=scores.get)
    return {"chosen": chosen, "scores": scores, "calibrator": fit_calibrator(df, chosen, p, y)}


# -- boosted models ------------------------------------------------------------------------------


def edge_gbm(df: DataFrame, y: str, xs: Sequence[str], w: str, holdout: str, linear_r2: float, depth: int = 5,
             eta: float = 0.05, rounds: int = 2000, min_child: int = 2000, seed: int = 11):
    """Boosted regression stopped on the held-out games; ``beats_linear`` says whether it may ship."""
    rows = VectorAssembler(inputCols=list(xs), outputCol="_features", handleInvalid="keep").transform(df)
    model = GBTRegressor(
        featuresCol="_features", labelCol=y, weightCol=w, validationIndicatorCol=holdout, maxDepth=depth, stepSize=eta,
        maxIter=rounds, minInstancesPerNode=min_child, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
        predictionCol="_gbm",
    ).fit(rows)
    score = weighted_r2(model.transform(rows.where(F.col(holdout))), y, "_gbm", w).first().r2
    return model, {"predictors": list(xs), "r2_holdout_gbm": score, "r2_holdout_linear": linear_r2,
                   "beats_linear": score > linear_r2}


def edge_scorer(model, report: dict):
    """A function adding ``_edge`` from the boosted edge model, or None when it lost to the linear one."""
    if not report["beats_linear"]:
        return None

    def score(df: DataFrame) -> DataFrame:
        derived = {"exp_margin_full": -F.col("home_spread_close")}
        columns = {f"_e_{c}": finite_or(derived.get(c, F.col(c)).cast("double"), 0.0) for c in report["predictors"]}
        rows = VectorAssembler(inputCols=list(columns), outputCol="_features").transform(df.withColumns(columns))
        return model.transform(rows).withColumnRenamed("_gbm", "_edge").drop("_features", *columns)

    return score


ROWS_PER_TASK = 250_000
BINS = 256  # of a feature, at most: a row's bin is one byte
CELLS = 1 << 16  # up to so many different rows of bins are summed as cells
ROWS_HERE = 4_000_000  # in cells, at most 27 to 37 bytes each, that one task holds
PIECE = 1 << 15
TO_DRIVER = 1 << 26  # bytes of sums that the driver adds itself
NODE = np.dtype([("feature", "i4"), ("threshold", "f8"), ("below", "i4"), ("above", "i4"), ("value", "f8")])


class Tree(NamedTuple):
    """A fitted tree, the root first and what is below a split before what is above: a leaf has feature -1.

    Features are numbered among those that the tree saw; a node keeps the sums of its rows' gradients and hessians.
    """

    feature: list[int]
    threshold: list[float]
    below: list[int]
    above: list[int]
    g: list[float]
    h: list[float]

    @property
    def toDebugString(self) -> str:  # noqa: N802
        def lines(at: int, depth: int) -> list[str]:
            if self.feature[at] < 0:
                return [f"{' ' * depth}Predict: {-self.g[at] / self.h[at] if self.h[at] else 0.0}"]
            one, name = self.threshold[at], f"(feature {self.feature[at]}"
            return [f"{' ' * depth}If {name} <= {one})", *lines(self.below[at], depth + 1),
                    f"{' ' * depth}Else {name} > {one})", *lines(self.above[at], depth + 1)]

        return "\n".join(lines(0, 0))


def tree_nodes(tree: Tree, values: dict[int, float], places: Sequence[int]) -> np.ndarray:
    """A fitted tree as rows of ``NODE``, the root first: a leaf has feature -1 and its value, a split its two children.

    Leaves are numbered from left to right, as they come in the tree.
    """
    leaf = {at: k for k, at in enumerate(i for i, f in enumerate(tree.feature) if f < 0)}
    return np.array([
        (-1, 0.0, -1, -1, values.get(leaf[at], 0.0)) if f < 0 else (places[f], tree.threshold[at], tree.below[at], tree.above[at], 0.0)
        for at, f in enumerate(tree.feature)], NODE)


class BoostedMember:
    """Trees fitted on top of a base logit, as node tables; leaf values are re-derived with the ridge term.

    Every tree sees its own share of the features, whose places it keeps.
    """

    def __init__(self, eta: float):
        self.eta, self.trees, self.nodes, self.places, self.best = eta, [], [], [], 0


class Forest:
    """The trees of all members in one node table, walked once for a batch of rows."""

    def __init__(self, members: Sequence[BoostedMember]):
        used = [(i, nodes) for i, m in enumerate(members) for nodes in m.nodes[: m.best]]
        begins = np.cumsum([0, *[len(nodes) for _, nodes in used]])
        self.members, self.roots = len(members), [(i, int(begin)) for (i, _), begin in zip(used, begins, strict=False)]
        self.nodes = np.concatenate([nodes for _, nodes in used]) if used else np.empty(0, NODE)
        shift = np.repeat(begins[:-1], np.diff(begins))
        leaf = self.nodes["feature"] < 0
        for side in ("below", "above"):  # a leaf leads to itself
            self.nodes[side] = np.where(leaf, np.arange(len(self.nodes)), self.nodes[side] + shift)
        self.nodes["feature"][leaf] = 0

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Rows by members: the sum of the leaves that each row falls into."""
        out, rows = np.zeros((len(x), self.members)), np.arange(len(x))
        feature, threshold, value = (np.ascontiguousarray(self.nodes[c]) for c in ("feature", "threshold", "value"))
        ways = np.stack([self.nodes["below"], self.nodes["above"]], 1).ravel()
        for member, root in self.roots:
            at = np.full(len(x), root)
            while True:
                on = ways[2 * at + (x[rows, feature[at]] > threshold[at])]
                if (on == at).all():
                    break
                at = on
            out[:, member] += value[at]
        return out


def leaf_values(tree: Tree, reg_lambda: float) -> dict[int, float]:
    """Newton step of every leaf from left to right, out of the sums that the fitted tree keeps."""
    leaves = [at for at, f in enumerate(tree.feature) if f < 0]
    return {k: -tree.g[at] / (tree.h[at] + reg_lambda) for k, at in enumerate(leaves)}


def _add_tree(df: DataFrame, tree, values: dict[int, float], places: Sequence[int], eta: float) -> DataFrame:
    return _add_nodes(df, tree_nodes(tree, values, places), eta)


def _add_nodes(df: DataFrame, nodes: np.ndarray, eta: float) -> DataFrame:
    """A tree's step as one conditional over the features."""
    def below(at: int) -> Column:
        node = nodes[at]
        if node["feature"] < 0:
            return F.lit(float(node["value"]))
        under = F.get("_x", F.lit(int(node["feature"]))) <= float(node["threshold"])
        return F.when(under, below(node["below"])).otherwise(below(node["above"]))

    kept = df.columns
    stepped = df if "_x" in kept else df.withColumn("_x", vector_to_array("_features"))
    return stepped.withColumn("_logit", F.col("_logit") + eta * below(0)).select(*kept)


def split_points(rows: DataFrame) -> list[np.ndarray]:
    """The thresholds of each of ``_features``: between all its values, or, of more than ``BINS``, between those at which
    another share of 1 / ``BINS`` of the rows is full. Counted on all rows, so the files' layout does not matter."""
    each = rows.select(F.posexplode(vector_to_array("_features")).alias("_feature", "_x"))
    values = cut_lineage(each.groupBy("_feature", "_x").agg(F.count(F.lit(1)).alias("_n")))
    sizes = values.groupBy("_feature").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_kinds"))
    known = values.join(F.broadcast(sizes), "_feature")  # a row for each feature
    share = lambda n: F.floor(n * BINS / F.col("_all"))
    many = scan(ordered(known.where(F.col("_kinds") > BINS), ["_feature"], ["_x"]), _upto=running_sum(F.col("_n"))).result()
    ends = known.where(F.col("_kinds") <= BINS).select("_feature", "_x").union(
        many.where(share(F.col("_upto")) > share(F.col("_upto") - F.col("_n"))).select("_feature", "_x"))
    found: dict[int, list[float]] = {}
    for feature, x in sorted(map(tuple, ends.collect())):  # at most BINS values of a feature
        found.setdefault(feature, []).append(x)
    edges = [np.array(found.get(f, [])) for f in range(max(found, default=-1) + 1)]
    return [e[:-1] / 2 + e[1:] / 2 for e in edges]


class Block(NamedTuple):
    """Rows by columns: the bins of their features (features by rows) or their cell, and what a round needs."""

    bins: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    logit: np.ndarray


def _blocks(df: DataFrame, edges: Sequence[np.ndarray]) -> RDD:
    """Rows (_x, y, weight, stop, row, logit) as an RDD of ``Block``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            x = np.concatenate([c.flatten().to_numpy() for c in table.column("_x").chunks]).reshape(table.num_rows, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, f]).astype(np.uint8) for f, e in enumerate(edges)])
            y, weight, stop, row, logits = (table.column(c).to_numpy() for c in table.column_names[1:])
            taught = ~stop.astype(bool)
            if np.isnan(y[taught]).any() or not (weight[taught] >= 0).all():
                raise ValueError("labels must not be null or NaN, nor weights null, NaN or negative")
            y, weight = (v.astype("f4") if np.array_equal(v, v.astype("f4")) else v for v in (y, weight))
            packed = pickle.dumps(Block(bins, y, weight, ~taught, row, logits), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["block"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(b.num_rows for b in held) + batch.num_rows > ROWS_PER_TASK:
                yield block(held)
                held = []
            if batch.num_rows:
                held.append(batch)
        if held:
            yield block(held)

    return df.mapInArrow(cut, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def _added(blocks: Iterable[Block], sums: Callable[[Block], np.ndarray], size: int) -> np.ndarray:
    """The sums over blocks, taken in pieces that stay in the processor's cache."""
    total, rows = np.zeros(size), max(PIECE, size)
    for b in blocks:
        for at in range(0, len(b.y), rows):
            total += sums(Block(*(v[..., at:at + rows] for v in b)))
    return total


class _Here:
    """Blocks in this process."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    def step(self, change: Callable[[Block], Block]) -> None:
        self.blocks = [change(b) for b in self.blocks]

    def ask(self, sums: Callable[[Block], np.ndarray], size: int) -> np.ndarray:
        return _added(self.blocks, sums, size)


class _Spread:
    """Blocks in the tasks' cache, written to the shared folder each ``every`` steps to cut the lineage."""

    def __init__(self, blocks: RDD, every: int):
        self.blocks, self.every, self.steps, self.before, self.file = blocks, every, 0, None, None

    def step(self, change: Callable[[Block], Block]) -> None:
        self.before, self.blocks = self.blocks, self.blocks.map(change).persist(StorageLevel.MEMORY_AND_DISK)
        self.steps += 1
        if self.steps % self.every == 0:
            self.blocks.checkpoint()

    def ask(self, sums: Callable[[Block], np.ndarray], size: int) -> np.ndarray:
        parts = self.blocks.mapPartitions(lambda held: [_added(held, sums, size)])
        large = 8 * size * parts.getNumPartitions() > TO_DRIVER
        out = parts.treeReduce(np.add) if large else reduce(np.add, parts.collect())
        if self.before is not None:
            self.before.unpersist()
            self.before, file = None, self.blocks.getCheckpointFile()
            if file:
                self._drop()
                self.file = file
        return out

    def _drop(self) -> None:
        """The folder written before is not needed once a later one is whole."""
        if self.file:
            context = self.blocks.context
            path = context._jvm.org.apache.hadoop.fs.Path(self.file)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.blocks.unpersist()
        self._drop()


def _taught(b: Block, salt: int, subsample: float) -> np.ndarray:
    mixed = b.row.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(times)
    return ~b.stop & ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(1000) < int(subsample * 1000))


def _fall(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, ways: np.ndarray, levels: int) -> np.ndarray:
    """The node of every row; a node that is not split leads to itself."""
    at, rows = np.zeros(bins.shape[1], np.intp), np.arange(bins.shape[1])
    for _ in range(levels):
        at = ways[2 * at + (bins[feature[at], rows] > cut[at])]
    return at


def _cells(blocks: RDD, edges: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """What rows of bins there are: the bins (features by cells), their sorted numbers, the features' strides. None if many."""
    kinds = [len(e) + 1 for e in edges]
    strides = [1]
    for n in kinds:
        strides.append(strides[-1] * n)
    if strides[-1] >= 1 << 62:
        return None

    def either(one: np.ndarray | None, other: np.ndarray | None) -> np.ndarray | None:
        both = None if one is None or other is None else np.union1d(one, other)
        return None if both is None or len(both) > CELLS else both

    numbers = np.array(strides[:-1])
    none = np.empty(0, np.int64)
    known = blocks.map(lambda b: np.unique(numbers @ b.bins)).treeAggregate(none, either, either)
    return None if known is None else (known // numbers[:, None] % np.array(kinds)[:, None], known, numbers)


def _in_cells(b: Block, known: np.ndarray, numbers: np.ndarray) -> Block:
    return b._replace(bins=np.searchsorted(known, numbers @ b.bins).astype(np.uint16))


def _kinds(b: Block, salt: int, subsample: float) -> list[np.ndarray]:
    """Gradients and hessians of the rows that a round learns from, zero for the others."""
    with np.errstate(over="ignore"):
        p = 1.0 / (1.0 + np.exp(-b.logit))
    taught = _taught(b, salt, subsample)
    return [np.where(taught, b.weight * v, 0.0) for v in (p - b.y, np.maximum(p * (1 - p), 1e-9))]


def _stop_loss(b: Block) -> list[float]:
    """The loss and the weight of the stopping rows."""
    y, w, z = b.y[b.stop], b.weight[b.stop], b.logit[b.stop]
    return [np.nansum(w * (np.logaddexp(0.0, z) - y * z)), np.nansum(w)]


def _by_bin(bins: np.ndarray, kinds: Sequence[np.ndarray], grown: tuple, levels: int, asked: Sequence[int], places: Sequence[int],
            most: int) -> np.ndarray:
    """Sums by place, kind, asked node and bin."""
    slot = np.full(len(grown[0]), len(asked))
    slot[list(asked)] = np.arange(len(asked))
    begin, size = slot[_fall(bins, *grown, levels)] * most, len(asked) * most
    return np.concatenate([np.bincount(begin + bins[f], v, size + most)[:size] for f in places for v in kinds])


def _bin_sums(b: Block, salt: int, subsample: float, **at) -> np.ndarray:
    return np.concatenate([_by_bin(b.bins, _kinds(b, salt, subsample), **at), _stop_loss(b)])


def _cell_sums(b: Block, salt: int, subsample: float, by: np.ndarray) -> np.ndarray:
    """Sums by cell, where the trees have moved each cell by ``by``."""
    b = b._replace(logit=b.logit + by[b.bins])
    return np.concatenate([*(np.bincount(b.bins, v, len(by)) for v in _kinds(b, salt, subsample)), _stop_loss(b)])


def _grow(first: np.ndarray, ask: Callable, places: Sequence[int], edges: Sequence[np.ndarray], depth: int, least: float) -> tuple[int, Tree]:
    """The levels of one tree, and the tree: the best split of every node whose children keep
    at least ``least`` of hessian, by the gain of the Newton step."""
    g, h = ([float(v)] for v in first[0, :, 0].sum(axis=1))
    feature, cut, ways, asked, levels, sums = [-1], [0], [0, 0], [0], 0, first

    def arrays() -> tuple:
        split = np.array(feature) >= 0
        chosen = np.where(split, np.array([places[f] for f in feature]), 0)
        return chosen, np.where(split, cut, BINS), np.array(ways)

    while asked and levels < depth:
        upto = sums.cumsum(axis=3)
        low, high = upto[..., :-1], upto[..., -1:] - upto[..., :-1]
        fits = (low[:, 1] >= least) & (high[:, 1] >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low[:, 0] ** 2 / low[:, 1] + high[:, 0] ** 2 / high[:, 1] - upto[:, 0, :, -1:] ** 2 / upto[:, 1, :, -1:]
        gain = np.where(fits, gain, -np.inf)
        more: list[int] = []
        for k, node in enumerate(asked):
            f, c = np.unravel_index(np.argmax(gain[:, k]), gain[:, k].shape) if gain[:, k].size else (0, 0)
            if not gain[:, k].size or not gain[f, k, c] > 1e-9:
                continue
            feature[node], cut[node] = int(f), int(c)
            for side, part in enumerate((low, high)):
                ways[2 * node + side] = child = len(feature)
                feature.append(-1)
                cut.append(0)
                ways += [child, child]
                g.append(float(part[f, 0, k, c]))
                h.append(float(part[f, 1, k, c]))
                if h[child] >= 2 * least:
                    more.append(child)
        levels, asked = levels + 1, more
        if asked and levels < depth:
            sums = ask(arrays(), levels, asked)
    tree = Tree([], [], [], [], [], [])

    def add(node: int) -> int:
        at, f = len(tree.feature), feature[node]
        for column, v in zip(tree, (f, float(edges[places[f]][cut[node]]) if f >= 0 else 0.0, -1, -1, g[node], h[node]), strict=True):
            column.append(v)
        if f >= 0:
            tree.below[at], tree.above[at] = add(ways[2 * node]), add(ways[2 * node + 1])
        return at

    add(0)
    return levels, tree


def _values(bins: np.ndarray, nodes: np.ndarray, edges: Sequence[np.ndarray], levels: int) -> np.ndarray:
    """The leaf values that rows of bins fall into."""
    leaf, at = nodes["feature"] < 0, np.arange(len(nodes))
    cut = [BINS if f < 0 else int(np.searchsorted(edges[f], t)) for f, t in zip(nodes["feature"], nodes["threshold"], strict=True)]
    ways = np.stack([np.where(leaf, at, nodes["below"]), np.where(leaf, at, nodes["above"])], 1).ravel()
    return nodes["value"][_fall(bins, np.where(leaf, 0, nodes["feature"]), np.array(cut), ways, levels)]


def _stepped(b: Block, eta: float, **tree) -> Block:
    return b._replace(logit=b.logit + eta * _values(b.bins, **tree))


def _boost(held: _Here | _Spread, cells: np.ndarray | None, edges: Sequence[np.ndarray], seed: int, depth: int, eta: float, rounds: int,
           reg_lambda: float, subsample: float, colsample: float, min_child_weight: float, patience: int) -> BoostedMember:
    member, width, most = BoostedMember(eta), len(edges), max(map(len, edges), default=0) + 1
    root = ((np.zeros(1, int), np.full(1, BINS), np.zeros(2, int)), 0, [0])
    kinds, by = None, np.zeros(0 if cells is None else cells.shape[1])  # of the cells

    def places_of(r: int) -> list[int]:
        chosen = np.random.default_rng([seed, r]).permutation(width)[: max(1, round(colsample * width))]
        return sorted(int(i) for i in chosen)

    def begin(r: int) -> tuple[np.ndarray, float | None]:
        """The sums of the root and the stopping loss before round ``r``."""
        nonlocal kinds
        if cells is None:
            return level(r, *root)
        out = held.ask(partial(_cell_sums, salt=seed * 1009 + r, subsample=subsample, by=by), 2 * len(by) + 2)
        kinds = out[:-2].reshape(2, -1)
        return level(r, *root)[0], out[-2] / out[-1] if out[-1] else None

    def level(r: int, grown: tuple, levels: int, asked: Sequence[int]) -> tuple[np.ndarray, float | None]:
        at = {"grown": grown, "levels": levels, "asked": asked, "places": places_of(r), "most": most}
        shape = (len(at["places"]), 2, len(asked), most)
        if cells is not None:
            return _by_bin(cells, kinds, **at).reshape(shape), None
        out = held.ask(partial(_bin_sums, salt=seed * 1009 + r, subsample=subsample, **at), int(np.prod(shape)) + 2)
        return out[:-2].reshape(shape), out[-2] / out[-1] if out[-1] else None

    best, since, (first, _) = None, 0, begin(0)
    for r in range(rounds):
        places, total = places_of(r), first[0, 1].sum()
        if not total:
            break
        levels, tree = _grow(first, lambda *at: level(r, *at)[0], places, edges, depth, max(min_child_weight, 1e-9 * total))  # noqa: B023
        member.trees.append(tree)
        member.nodes.append(tree_nodes(tree, leaf_values(tree, reg_lambda), places))
        member.places.append(places)
        fell = {"nodes": member.nodes[-1], "edges": edges, "levels": levels}
        if cells is None:
            held.step(partial(_stepped, eta=eta, **fell))
        else:
            by = by + eta * _values(cells, **fell)
        first, loss = begin(r + 1)
        if best is None or (loss is not None and loss < best - 1e-9):
            best, since, member.best = loss, 0, r + 1
        else:
            since += 1
            if since >= patience:
                break
    return member


def boost_member(df: DataFrame, width: int, base: Column, label: str, weight: str, stop: str, seed: int, depth: int = 6,
                 eta: float = 0.05, rounds: int = 3000, reg_lambda: float = 1.0, subsample: float = 0.8, colsample: float = 0.8,
                 min_child_weight: float = 200.0, patience: int = 50, checkpoint_every: int = 8,
                 edges: Sequence[np.ndarray] | None = None) -> BoostedMember:
    """Newton boosting of the log loss on a base margin, stopped by the weighted loss of the stopping rows.

    Each round fits -g/h with weight h*w on a share of the rows and of the features, so the weighted variance
    gain is the Newton gain; ``df`` has ``width`` assembled ``_features``; a child keeps at least ``min_child_weight`` of hessian.
    Rows are held by the bins of ``edges`` (``split_points`` where none are given). A round sums g and h by bin once a level,
    and the pass over the roots gives the stopping loss as well; where the rows have up to ``CELLS`` different bins, one pass
    sums them by these cells, the tree is grown on the cells, and the rows are not written again. A table of up to two tasks'
    rows, or of ``ROWS_HERE`` in cells, is fitted in one task, with no job a round. Rows are sampled by the hash of ``_row``,
    which stands for their contents, so the model does not depend on files or partitions.
    """
    edges = split_points(df) if edges is None else edges
    edges = [*edges, *[np.empty(0)] * (width - len(edges))]
    rows = df.select(vector_to_array("_features").alias("_x"), F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"),
                     F.col(stop).alias("_stopping"), "_row", base.cast("double").alias("_logit"))
    read = blocks = _blocks(rows, edges).persist(StorageLevel.MEMORY_AND_DISK)
    cells = _cells(blocks, edges)
    if cells is not None:
        blocks = blocks.map(partial(_in_cells, known=cells[1], numbers=cells[2])).persist(StorageLevel.MEMORY_AND_DISK)
    fit = partial(_boost, cells=cells and cells[0], edges=edges, seed=seed, depth=depth, eta=eta, rounds=rounds, reg_lambda=reg_lambda,
                  subsample=subsample, colsample=colsample, min_child_weight=min_child_weight, patience=patience)
    if blocks.map(lambda b: len(b.y)).sum() <= (2 * ROWS_PER_TASK if cells is None else ROWS_HERE):
        fitted = blocks.coalesce(1).mapPartitions(lambda held: [fit(_Here(list(held)))]).collect()
        member = fitted[0] if fitted else BoostedMember(eta)  # no rows, no task
        blocks.unpersist()
    else:
        ensure_checkpoint_dir(df.sparkSession)
        held = _Spread(blocks, checkpoint_every)
        member = fit(held)
        held.close()
    read.unpersist()
    return member


def boosted_ensemble(df: DataFrame, features: Sequence[str], label: str, game: str, base_margin: str | None,
                     seeds: Sequence[int] = (17, 41, 99, 123, 271), stop_frac: float = 0.15, weight: str | None = None,
                     **boost_args) -> list[BoostedMember]:
    """One member per seed, each with its own stopping games (stratified on the outcome)."""
    names = [f for f in features if f != base_margin]
    rows = assemble_features(df, names)
    if weight is None:
        weight, rows = "_weight", rows.withColumn("_weight", F.lit(1.0))
    rows = rows.withColumn("_row", F.xxhash64(game, label, *names))
    base = base_logit(base_margin)
    edges = split_points(rows)
    # dealt by number: adaptive execution goes by compressed bytes, and few tasks would walk all rounds
    n = df.count()
    tasks = -(-n // ROWS_PER_TASK)

    def member(seed: int) -> BoostedMember:
        split = group_split(rows, game, stop_frac, seed, label).withColumnRenamed("picked", "_stop")
        state = rows.join(split, game)
        if tasks > 1:
            state = state.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), "_row")
        return boost_member(state, len(names), base, label, weight, "_stop", seed, **{"edges": edges, **boost_args})

    # members that may be of one task each are fitted side by side
    with ThreadPoolExecutor(1 if n > ROWS_HERE else max(1, len(seeds))) as pool:
        return list(pool.map(inheritable_thread_target(df.sparkSession)(member), seeds))


def base_logit(base_margin: str | None) -> Column:
    if not base_margin or base_margin == "none":
        return F.lit(0.0)
    return finite_or(F.col(base_margin).cast("double"), 0.0, above=8.0, below=-8.0)


def assemble_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Feature vector of doubles; a missing value becomes a value below every split."""
    filled = df.withColumns({f"_x_{n}": finite_or(F.col(n).cast("double"), -1e9) for n in names})
    out = VectorAssembler(inputCols=[f"_x_{n}" for n in names], outputCol="_features").transform(filled)
    return out.drop(*[f"_x_{n}" for n in names])


def predict_ensemble(df: DataFrame, members: Sequence[BoostedMember], features: Sequence[str],
                     base_margin: str | None, out: str = "p_home") -> DataFrame:
    """Probability of the mean member logit. All trees are one node table and one step of the plan, however many they are.

    The table, at most a tree's nodes for each round and member, is sent to the tasks.
    """
    names = [f for f in features if f != base_margin]
    sent = df.sparkSession.sparkContext.broadcast(Forest(members))

    @F.pandas_udf("array<double>")
    def walked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.empty((0, len(names)))
            yield pd.Series(list(sent.value.sums(x)))

    df = assemble_features(df, names).withColumn("_sums", walked(vector_to_array("_features")))
    base = base_logit(base_margin)
    total = [logit(sigmoid(base + m.eta * F.get("_sums", F.lit(i)))) for i, m in enumerate(members)]
    mean = sum(total[1:], total[0]) / len(total)
    return df.withColumn(out, sigmoid(mean)).drop("_features", "_sums")
