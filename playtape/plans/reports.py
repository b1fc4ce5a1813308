"""Grouped reports: views with totals, calibration tables, concentration, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.functions.text import foul_class, has
from playtape.operators.dedupe import top_k
from playtape.operators.quantiles import exact_quantiles

VIEWS = ["edge_bucket", "side_label", "favdog", "price_bucket", "quarter", "margin_bucket", "role", "month", "season"]


def summarise_by(bets: DataFrame, column: str, game: str = "game_id") -> DataFrame:
    """Bets, games, stake, profit and return per bucket, and a TOTAL row."""
    return summarise_views(bets, [column], game).drop("view")


def summarise_views(bets: DataFrame, views: Sequence[str] = tuple(VIEWS), game: str = "game_id") -> DataFrame:
    """Every view in one long table (view, bucket, metrics), each with its TOTAL.

    All views and totals come from one grouping over the stacked dimensions. Distinct games are counted by
    first reducing to (view, bucket, game), so no group collects its games.
    """
    stacked = F.explode(F.array(*[
        F.struct(F.lit(v).alias("view"), F.col(v).cast("string").alias("bucket"))
        for v in views
    ])).alias("_v")
    per_game = bets.select("staked", "pnl", "contracts", F.col(game).alias("_game"), stacked).groupBy(
        "_v.view", "_v.bucket", "_game"
    ).agg(
        F.count(F.lit(1)).alias("bets"), F.sum("staked").alias("staked"), F.sum("pnl").alias("pnl"),
        F.sum("contracts").alias("contracts"),
    )
    sums = per_game.groupBy("view", "bucket").agg(
        F.sum("bets").alias("bets"), F.count("_game").alias("games"), F.sum("staked").alias("staked"),
        F.sum("pnl").alias("pnl"), F.sum("contracts").alias("contracts"),
    )
    games = bets.agg(F.countDistinct(game).alias("g")).scalar()
    totals = sums.groupBy("view").agg(
        F.sum("bets").alias("bets"), F.sum("staked").alias("staked"), F.sum("pnl").alias("pnl"),
        F.sum("contracts").alias("contracts"),
    ).select("view", F.lit("TOTAL").alias("bucket"), "bets", games.alias("games"), "staked", "pnl", "contracts")
    return sums.unionByName(totals).select(
        "view", "bucket", "bets", "games", "staked", "pnl", (F.col("contracts") / F.col("bets")).alias("avg_size"),
        (100.0 * F.try_divide(F.col("pnl"), F.col("staked"))).alias("roi_pct"),
    )


def error_table(bets: DataFrame, by: str, game: str = "game_id") -> DataFrame:
    """Model and market probability against the outcome, per bucket."""
    model, market, actual = F.avg("p_win"), F.avg("price") / 100.0, F.avg("won")
    return bets.groupBy(by).agg(
        F.count(F.lit(1)).alias("bets"), F.countDistinct(game).alias("games"), F.sum("staked").alias("staked"),
        F.sum("pnl").alias("pnl"), model.alias("model_p"), market.alias("market_p"), actual.alias("actual"),
        (100.0 * F.try_divide(F.sum("pnl"), F.sum("staked"))).alias("roi_pct"),
        (model - actual).alias("model_err"), (market - actual).alias("market_err"),
    )


def concentration(bets: DataFrame, n: int = 15, game: str = "game_id", hot_rows: int | None = None) -> DataFrame:
    """Is the loss broad? Total, worst-n games, median game and the share of games losing."""
    per_game = bets.groupBy(game).agg(F.sum("pnl").alias("pnl"))
    worst = per_game.orderBy("pnl", game).limit(n).agg(F.sum("pnl").alias("worst"))
    base = per_game.agg(
        F.count(F.lit(1)).alias("games"), F.sum("pnl").alias("total_pnl"),
        (100.0 * F.avg((F.col("pnl") < 0).cast("double"))).alias("losing_pct"),
    )
    median = exact_quantiles(per_game, "pnl", [0.5], ["median_pnl"], hot_rows=hot_rows)
    return base.select(
        "games", "total_pnl", worst.select("worst").scalar().alias("worst_n_pnl"),
        median.select("median_pnl").scalar().alias("median_pnl"), "losing_pct",
    )


def diagnose(bets: DataFrame) -> dict[str, DataFrame]:
    """Error tables by role, for road favourites, by month and for the latest month."""
    road = bets.where(F.col("role") == "road fav")
    latest = bets.agg(F.max("month").alias("m")).scalar()
    last = bets.where(F.col("month") == latest)
    out = {"role": error_table(bets, "role"), "month": error_table(bets, "month")}
    for by in ("quarter", "price_bucket", "margin_bucket", "month"):
        out[f"road_fav_{by}"] = error_table(road, by)
    for by in ("role", "price_bucket"):
        out[f"latest_month_{by}"] = error_table(last, by)
    out["road_fav_concentration"] = concentration(road)
    out["latest_month_concentration"] = concentration(last)
    return out


def quantile_bins(df: DataFrame, p: str, bins: int = 10, out: str = "q", hot_rows: int | None = None) -> DataFrame:
    """Right-closed quantile bin of every row; equal edges collapse, the lowest value joins bin 0."""
    names = [f"_e{i}" for i in range(bins + 1)]
    edges = exact_quantiles(df, p, [i / bins for i in range(bins + 1)], names, hot_rows=hot_rows).first()
    kept = sorted({edges[n] for n in names if edges[n] is not None})
    label = F.lit(None).cast("int")
    for i in range(len(kept) - 1, 0, -1):
        label = F.when(F.col(p) <= kept[i], F.lit(i - 1)).otherwise(label)
    return df.withColumn(out, F.when(F.col(p).isNotNull(), label))


def calibration_deciles(df: DataFrame, p: str, y: str, market: str | None = None, bins: int = 10,
                        hot_rows: int | None = None) -> DataFrame:
    """Rows, mean prediction, outcome rate and gap per quantile bin; the market's alongside if given."""
    binned = quantile_bins(df, p, bins, hot_rows=hot_rows)
    aggs = [F.count(y).alias("n"), F.avg(p).alias("pred"), F.avg(y).alias("actual"), (F.avg(y) - F.avg(p)).alias("gap")]
    if market:
        aggs += [F.avg(market).alias("market"), (F.avg(y) - F.avg(market)).alias("market_gap")]
    return binned.groupBy("q").agg(*aggs)


def tail_calibration(df: DataFrame, p: str, y: str, cuts: Sequence[float] = (0.02, 0.05, 0.10)) -> DataFrame:
    """Rows, mean prediction and outcome below each cut and above its mirror."""
    tails = F.explode(F.array(*[
        F.struct(F.lit(side).alias("tail"), F.lit(float(c)).alias("cut")) for c in cuts for side in ("low", "high")
    ])).alias("_t")
    rows = df.select(F.col(p).alias("p"), F.col(y).alias("y"), tails).select("p", "y", "_t.*")
    low = (F.col("tail") == "low") & (F.col("p") < F.col("cut"))
    high = (F.col("tail") == "high") & (F.col("p") > 1 - F.col("cut"))
    return rows.where(low | high).groupBy("tail", "cut").agg(
        F.count("y").alias("n"), F.avg("p").alias("pred"), F.avg("y").alias("actual")
    )


def unit_bin(p: Column, bins: int = 20) -> Column:
    """Equal-width bin of a probability, the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def weighted_histogram(df: DataFrame, p: str, weight: str | None = None, bins: int = 20) -> DataFrame:
    """Weight per equal-width bin; empty bins included."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    filled = df.where(F.col(p).between(0.0, 1.0)).groupBy(unit_bin(F.col(p), bins).alias("bin")).agg(w.cast("double").alias("w"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(filled, "bin", "left").select("bin", F.coalesce("w", F.lit(0.0)).alias("w"))


def bet_region_weights(rows: DataFrame, p: str, bets: DataFrame, bet_p: str, stake: str, strength: float = 1.0,
                       bins: int = 20, out: str = "bet_weight") -> DataFrame:
    """Row weights that pull the rows' probability histogram towards where the stakes went."""
    base = weighted_histogram(rows.withColumn(p, F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))), p, None, bins)
    staked = weighted_histogram(bets, bet_p, stake, bins).withColumnRenamed("w", "stake")
    ratio = base.join(staked, "bin").withColumn(
        "ratio", F.when(F.col("w") > 0, F.col("stake") / F.greatest("w", F.lit(1.0))).otherwise(0.0)
    )
    mean = ratio.agg(F.greatest(F.avg("ratio"), F.lit(1e-9)).alias("m")).scalar()
    table = ratio.select("bin", (F.col("ratio") / mean).alias("_r"))
    binned = rows.withColumn("bin", unit_bin(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)), bins))
    weight = F.coalesce(1.0 + strength * (F.col("_r") - 1.0), F.lit(1.0))
    return binned.join(table, "bin", "left").withColumn(
        out, F.greatest(F.lit(0.05), F.least(F.lit(20.0), weight))
    ).drop("bin", "_r")


def label_audit(events: DataFrame) -> DataFrame:
    """Every foul-like label seen and how it is classified."""
    labels = events.select("type_text").where(has(F.col("type_text"), "foul|technical")).distinct()
    return labels.select("type_text", foul_class(F.col("type_text")).alias("class"))


def scoring_check(box: DataFrame) -> DataFrame:
    """Rebuilt against official points per game: mean ratio and the share that match exactly."""
    games = box.groupBy("game_id").agg(F.sum("pts").alias("built"), F.sum("team_final").alias("official"))
    return games.agg(
        F.avg(F.try_divide(F.col("built").cast("double"), F.col("official").cast("double"))).alias("ratio"),
        F.avg((F.col("built") == F.col("official")).cast("double")).alias("exact_share"),
    )


def shooting_check(box: DataFrame) -> DataFrame:
    """Field-goal share, blocks and attempts per team-game."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return box.agg(
        (F.sum("fgm") / F.greatest(F.sum("fga"), F.lit(1))).alias("fg_pct"),
        (F.sum("blk") / n).alias("blk_per_game"), (F.sum("fga") / n).alias("fga_per_game"),
    )


def worst_games(bets: DataFrame, by: str, n: int, game: str = "game_id") -> DataFrame:
    """The n games with the lowest profit within each bucket."""
    per_game = bets.groupBy(by, game).agg(F.sum("pnl").alias("pnl"))
    return top_k(per_game, [by], ["pnl", game], n)
