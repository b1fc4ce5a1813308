"""States against the tape: fills, edges, prior-only sizing, settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.fixed_values import (
    BET_COLUMNS,
    EDGE_EDGES,
    EDGE_LABELS,
    LEAD_EDGES,
    LEAD_LABELS,
    PRICE_EDGES,
    PRICE_LABELS,
)
from playtape.functions.clock import instant, month_label, quarter_label, whole_second
from playtape.functions.numeric import bucket_left, bucket_right, clip, taker_fee
from playtape.operators.asof import asof_forward
from playtape.operators.dedupe import keep_last
from playtape.operators.ordered import Ordered, lag, ordered, prior_count, prior_sum, scan
from playtape.operators.quantiles import exact_quantiles
from playtape.session import cut_lineage


def state_grid(features: DataFrame) -> DataFrame:
    """One state per game and wall second that has an event: the last event of that second."""
    stamp = F.col("wallclock")
    if dict(features.dtypes)["wallclock"] == "string":
        stamp = instant(stamp)
    timed = features.withColumn("grid_unix", whole_second(stamp.cast("timestamp")))
    return keep_last(timed.where(F.col("grid_unix").isNotNull()), ["game_id", "grid_unix"], ["play_number"])


def state_gaps(grid: DataFrame, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Median, mean and 90th percentile of the seconds between consecutive states of a game."""
    o = ordered(grid.select("game_id", "grid_unix"), ["game_id"], ["grid_unix"], hot_rows, at_most)
    o = scan(o, _was=lag(F.col("grid_unix")))
    gaps = o.result().where(F.col("_was").isNotNull()).select((F.col("grid_unix") - F.col("_was")).alias("gap"))
    spread = exact_quantiles(gaps, "gap", [0.5, 0.9], ["median", "p90"], hot_rows=hot_rows)
    mean = gaps.agg(F.avg("gap").alias("m"), F.count("gap").alias("n"))
    return spread.select(mean.select("n").scalar().alias("n"), mean.select("m").scalar().alias("mean"), "median", "p90")


def fill_states(grid: DataFrame, prints: DataFrame, lag_seconds: int = 10, window: int = 5,
                take=("px_home", "px_away", "count_fp"), hot_rows: int | None = None,
                at_most: int | None = None) -> DataFrame:
    """Each state with the first print from ``lag_seconds`` after it, at most ``window`` seconds later."""
    anchored = grid.withColumn("anchor", F.col("grid_unix") + lag_seconds)
    return asof_forward(anchored, prints, ["game_id"], "anchor", "ts", list(take), window, hot_rows=hot_rows,
                        at_most=at_most)


def fill_report(filled: DataFrame) -> DataFrame:
    """States, fills and the share filled on the exact second."""
    got = F.col("fill_delay").isNotNull()
    return filled.agg(
        F.count(F.lit(1)).alias("states"), F.count_if(got).alias("fills"),
        F.try_divide(F.count_if(F.col("fill_delay") == 0).cast("double"), F.count_if(got)).alias("exact_share"),
        F.avg("fill_delay").alias("mean_delay"),
    )


def select_bets(filled: DataFrame, contracts: int = 100, min_edge: float = 0.02) -> DataFrame:
    """Both sides of every filled state whose edge after fees reaches the minimum."""
    won = F.col("home_final") > F.col("away_final")
    lost = F.col("away_final") > F.col("home_final")

    def leg(side: str, number: int, price: Column, p: Column, hit: Column) -> Column:
        return F.struct(
            F.lit(side).alias("side"), F.lit(number).alias("leg"), price.alias("price"), p.alias("p_win"),
            hit.cast("int").alias("won"),
        )

    legs = F.array(
        leg("home", 0, F.col("px_home"), F.col("p_home"), won),
        leg("away", 1, F.col("px_away"), 1.0 - F.col("p_home"), lost),
    )
    out = filled.where(F.col("px_home").isNotNull()).withColumn("_leg", F.explode(legs)).select("*", "_leg.*").drop("_leg")
    dollars = F.col("price") / 100.0
    edge = F.col("p_win") - dollars - taker_fee(F.lit(contracts), dollars) / contracts
    return out.withColumn("edge", edge).where(F.col("edge") >= min_edge)


BET_ORDER = ["grid_unix", "leg", "game_id", "play_number"]


def prior_moments(o: Ordered, value: str) -> Ordered:
    """Number, mean and population deviation of strictly earlier values."""
    x = F.col(value)
    o = scan(o, _n=prior_count(), _s1=prior_sum(x, F.lit(0.0)), _s2=prior_sum(x * x, F.lit(0.0)))
    many = F.greatest(F.col("_n"), F.lit(1))
    mean = F.col("_s1") / many
    o = o.with_columns({"prior_n": F.col("_n"), "prior_mean": mean,
                        "prior_sd": F.sqrt(F.greatest(F.col("_s2") / many - mean * mean, F.lit(0.0)))})
    return Ordered(o.df.drop("_n", "_s1", "_s2"), o.part, o.order, o.split, o.largest)


def expanding_zscore(df: DataFrame, value: str, part: list[str], order: list[str], out: str = "z",
                     hot_rows: int | None = None) -> DataFrame:
    """(x - mean) / deviation of strictly earlier rows; null where they do not vary."""
    o = prior_moments(ordered(df, part, order, hot_rows), value)
    z = F.when(F.col("prior_sd") > 1e-12, (F.col(value) - F.col("prior_mean")) / F.col("prior_sd"))
    return o.with_columns({out: z}).result()


def size_expanding(bets: DataFrame, contracts: float = 100, slope: float = 1.0, low: float = 0.2, high: float = 3.0,
                   warmup: int = 100, group: str = "season", order: list[str] | None = None, edge: str = "edge",
                   hot_rows: int | None = None) -> DataFrame:
    """Contracts scaled by how unusual an edge is among the earlier bets of its season.

    The multiplier is normalised by the mean of earlier multipliers; the first ``warmup`` bets are flat.
    Two scans share one shuffle; a season larger than a task is cut into pieces.
    """
    o = prior_moments(ordered(bets, [group], order or BET_ORDER, hot_rows), edge)
    live = (F.col("prior_n") >= warmup) & (F.col("prior_sd") > 1e-12) & F.lit(slope != 0.0)
    o = o.with_columns({"edge_z": F.when(live, (F.col(edge) - F.col("prior_mean")) / F.col("prior_sd")).otherwise(0.0)})
    o = o.with_columns({"_mult": F.when(live, clip(1.0 + slope * F.col("edge_z"), low, high)).otherwise(1.0)})
    o = scan(o, _msum=prior_sum(F.col("_mult"), F.lit(0.0)))
    mean = F.col("_msum") / F.greatest(F.col("prior_n"), F.lit(1))
    norm = F.when((F.col("prior_n") > 0) & (mean > 1e-6), mean).otherwise(1.0)
    size = F.greatest(F.lit(1.0), F.rint(F.lit(float(contracts)) * F.col("_mult") / norm))
    return o.with_columns({"contracts": size}).result().drop("_mult", "_msum", "prior_n", "prior_mean", "prior_sd")


def size_whole_book(bets: DataFrame, target: float = 100, slope: float = 1.0, low: float = 0.2, high: float = 3.0,
                    edge: str = "edge") -> DataFrame:
    """Contracts scaled by the z-score within the whole book, the rounded mean pinned to the target.

    The scale is solved on the driver; every probe is one distributed aggregate returning two numbers.
    """
    stats = bets.agg(F.avg(edge).alias("m"), F.stddev_pop(edge).alias("s")).first()
    flat = slope == 0.0 or not stats.s or stats.s <= 0.0
    z = F.lit(0.0) if flat else (F.col(edge) - F.lit(stats.m)) / F.lit(stats.s)
    raw = clip(1.0 + slope * z, low, high)
    mean = bets.agg(F.avg(raw).alias("m")).first().m or 1.0
    mult = raw / F.lit(mean) if mean > 0 else F.lit(1.0)
    histogram = cut_lineage(bets.groupBy(mult.alias("mult")).agg(F.count(F.lit(1)).alias("n")))

    def rounded(scale: float) -> Column:
        return F.greatest(F.lit(1.0), F.rint(F.lit(scale) * F.col("mult")))

    scale, used = float(target), float(target)
    for _ in range(41):
        step = histogram.agg(
            (F.sum(rounded(scale) * F.col("n")) / F.sum("n")).alias("mean"),
            F.count_if(rounded(scale) != rounded(used)).alias("changed"),
        ).first()
        if scale != used and step.changed == 0:
            break
        used = scale
        if not step.mean or abs(step.mean - target) < 1e-9:
            break
        scale *= target / step.mean
    sized = bets.withColumns({"edge_z": z, "mult": mult})
    return sized.withColumn("contracts", rounded(used)).drop("mult")


def settle(bets: DataFrame) -> DataFrame:
    """Fee, stake and profit of sized bets."""
    n, price = F.col("contracts"), F.col("price") / 100.0
    fee = taker_fee(n, price)
    return bets.withColumns({
        "fee": fee, "staked": n * price,
        "pnl": F.when(F.col("won") == 1, n * (1.0 - price)).otherwise(-n * price) - fee,
    })


def bucket_bets(bets: DataFrame) -> DataFrame:
    """Month, quarter, edge, price, lead and role labels."""
    home = F.col("side") == "home"
    fav = F.when(home, F.col("logit_close") >= 0).otherwise(~(F.coalesce(F.col("logit_close") >= 0, F.lit(False))))
    fav = F.coalesce(fav, F.lit(False))
    lead = F.when(home, F.col("score_margin")).otherwise(-F.col("score_margin"))
    return bets.withColumns({
        "month": month_label(F.col("game_date")), "quarter": quarter_label(F.col("period")),
        "edge_bucket": bucket_left(F.col("edge"), EDGE_EDGES, EDGE_LABELS),
        "price_bucket": bucket_left(F.col("price"), PRICE_EDGES, PRICE_LABELS),
        "margin_bucket": bucket_right(lead, LEAD_EDGES, LEAD_LABELS),
        "side_label": F.col("side"),
        "favdog": F.when(fav, "pregame fav").otherwise("pregame dog"),
        "role": F.concat(F.when(home, "home ").otherwise("road "), F.when(fav, "fav").otherwise("dog")),
    })


def backtest(scored: DataFrame, prints: DataFrame, lag_seconds: int = 10, window: int = 5, contracts: int = 100,
             size_slope: float = 1.0, size_min: float = 0.2, size_max: float = 3.0, size_warmup: int = 100,
             min_edge: float = 0.02, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Scored states and prints to settled, labelled bets; ``at_most`` bounds states plus prints of a game."""
    filled = fill_states(state_grid(scored), prints, lag_seconds, window, hot_rows=hot_rows, at_most=at_most)
    bets = select_bets(filled, contracts, min_edge)
    sized = size_expanding(bets, contracts, size_slope, size_min, size_max, size_warmup, hot_rows=hot_rows)
    return bucket_bets(settle(sized))


def bet_columns(bets: DataFrame) -> DataFrame:
    """The published bet columns that are present, in order."""
    return bets.select(*[c for c in BET_COLUMNS if c in bets.columns])
