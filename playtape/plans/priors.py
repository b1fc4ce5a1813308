"""What earlier seasons teach: shooting rates, possession measurement, pregame decay, state surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.fixed_values import (
    DURATION_CELL_MIN,
    MARGIN_EDGES,
    MAX_POINTS,
    REGULATION_PERIODS,
    REGULATION_SECONDS,
    SHOT_CELL_MIN,
    TIME_LEFT_EDGES,
)
from playtape.functions.numeric import bin_index, clip, safe_ratio


def shot_quality_table(events: DataFrame, min_attempts: int = SHOT_CELL_MIN) -> DataFrame:
    """Make rate per (family, distance bin, three) cell with enough attempts, with the league rate beside it."""
    shots = events.where("is_fga").select(
        "shot_family", "dist_bin", F.col("is_fg3a").cast("int").alias("is3"),
        (F.col("is_fg3m") | F.col("is_fg2m")).cast("int").alias("made"),
    )
    league = shots.groupBy("is3").agg(F.avg("made").alias("fallback"))
    cells = shots.groupBy("shot_family", "dist_bin", "is3").agg(F.avg("made").alias("rate"), F.count("made").alias("n"))
    return cells.where(F.col("n") >= min_attempts).join(league, "is3")


def league_rates(events: DataFrame) -> DataFrame:
    """Pooled percentages and volumes."""
    def total(flag: str) -> Column:
        return F.coalesce(F.sum(F.col(flag).cast("bigint")), F.lit(0))

    sums = events.agg(*[total(f).alias(f) for f in
                        ("is_fg3a", "is_fg3m", "is_fg2a", "is_fg2m", "is_fta", "is_ftm", "is_foul")])
    return sums.select(
        safe_ratio(F.col("is_fg3m"), F.col("is_fg3a")).alias("league_fg3_pct"),
        safe_ratio(F.col("is_fg2m"), F.col("is_fg2a")).alias("league_fg2_pct"),
        safe_ratio(F.col("is_ftm"), F.col("is_fta")).alias("league_ft_pct"),
        F.col("is_fg3a").alias("n_prior_fg3a"), F.col("is_foul").alias("n_fouls"),
    )


def points_distribution(segments: DataFrame) -> DataFrame:
    """Share of possessions by points scored, 0 to the maximum, zeros included."""
    counts = segments.groupBy(F.col("points").cast("int").alias("points")).agg(F.count(F.lit(1)).alias("n"))
    grid = segments.sparkSession.range(MAX_POINTS + 1).select(F.col("id").cast("int").alias("points"))
    filled = grid.join(counts, "points", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = filled.agg(F.sum("n").alias("t")).scalar()
    return filled.select("points", "n", (F.col("n") / total).alias("share"))


def binned_mean(df: DataFrame, x: Column, x_edges: list, y: Column, y_edges: list, value: str, min_n: int,
                x_name: str = "tl", y_name: str = "mg") -> DataFrame:
    """Mean of a value on a two-way grid; thin or empty cells take the overall mean."""
    spark = df.sparkSession
    placed = df.select(bin_index(x, x_edges).alias(x_name), bin_index(y, y_edges).alias(y_name), F.col(value).alias("_v"))
    cells = placed.groupBy(x_name, y_name).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    overall = df.agg(F.avg(value).alias("m")).scalar()
    width = len(y_edges) - 1
    grid = spark.range((len(x_edges) - 1) * width).select(
        F.floor(F.col("id") / width).cast("int").alias(x_name), (F.col("id") % width).cast("int").alias(y_name)
    )
    filled = grid.join(cells, [x_name, y_name], "left")
    return filled.select(
        x_name, y_name, F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("n") >= min_n, F.col("mean")).otherwise(overall).alias("value"),
    )


def possession_seconds(segments: DataFrame, min_n: int = DURATION_CELL_MIN) -> DataFrame:
    """Mean possession length by time left and the offence's margin, regulation only."""
    regulation = segments.where(F.col("period") <= REGULATION_PERIODS)
    off_margin = F.when(F.col("possession") > 0, F.col("margin_start")).otherwise(-F.col("margin_start"))
    return binned_mean(regulation, F.col("seconds_left_reg"), TIME_LEFT_EDGES, off_margin, MARGIN_EDGES, "duration", min_n)


def pace_fit(segments: DataFrame, odds: DataFrame, more_than: int = 200) -> DataFrame:
    """Possessions per game as a line in the closing total; null when too few games carry a total."""
    per_game = segments.groupBy("game_id").agg(F.count(F.lit(1)).alias("poss"))
    joined = per_game.join(
        odds.select(F.col("espn_game_id").alias("game_id"), "total_close").where(F.col("total_close").isNotNull()),
        "game_id",
    )
    return simple_line(joined, "poss", "total_close", more_than + 1)


def simple_line(df: DataFrame, y: str, x: str, min_rows: int = 0) -> DataFrame:
    """(n, intercept, slope, corr) of one least-squares line; nulls below ``min_rows``."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    both = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = both.agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept(a, b).alias("intercept"), F.regr_slope(a, b).alias("slope"),
        F.corr(a, b).alias("corr"),
    )
    enough = F.col("n") >= min_rows
    return fit.select("n", *[F.when(enough, F.col(c)).alias(c) for c in ("intercept", "slope", "corr")])


def decay_states(pbp: DataFrame, spreads: DataFrame) -> DataFrame:
    """Regulation states of decided games that carry a closing spread."""
    states = pbp.where(
        (F.col("period") <= REGULATION_PERIODS) & (F.col("home_final") != F.col("away_final"))
    ).select(
        F.col("game_id").cast("string").alias("game_id"),
        clip(F.col("seconds_left_reg").cast("double") / REGULATION_SECONDS, 0.0, 1.0).alias("frac_left"),
        F.col("score_margin").cast("double").alias("score_margin"),
        ((F.col("home_final") - F.col("away_final")) - F.col("score_margin")).cast("double").alias("rest_margin"),
    )
    lines = spreads.where(F.col("home_spread_close").isNotNull()).select(
        F.col("espn_game_id").cast("string").alias("game_id"),
        (-F.col("home_spread_close").cast("double")).alias("exp_margin"),
    )
    return states.join(lines, "game_id")


def decay_errors(states: DataFrame, powers: list[float]) -> DataFrame:
    """For every power: the least-squares fit of the rest margin on (decayed line, current score) and its error.

    One aggregation of centred cross-products serves all powers.
    """
    known = states.dropna(subset=["rest_margin", "exp_margin", "score_margin", "frac_left"])
    known = known.where(F.col("frac_left").between(0.0, 1.0))
    k = F.explode(F.array(*[F.lit(float(p)) for p in powers])).alias("k")
    rows = known.select("rest_margin", "score_margin", "exp_margin", "frac_left", k).select(
        "k", F.col("rest_margin").alias("y"), F.col("score_margin").alias("s"),
        (F.col("exp_margin") * F.pow("frac_left", "k")).alias("e"),
    )
    m = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), F.avg("s").alias("ms"), F.avg("e").alias("me"),
        F.var_pop("y").alias("yy"), F.var_pop("s").alias("ss"), F.var_pop("e").alias("ee"),
        F.covar_pop("e", "y").alias("ey"), F.covar_pop("s", "y").alias("sy"), F.covar_pop("e", "s").alias("es"),
    )
    det = F.col("ee") * F.col("ss") - F.col("es") * F.col("es")
    b = F.try_divide(F.col("ey") * F.col("ss") - F.col("sy") * F.col("es"), det)
    c = F.try_divide(F.col("sy") * F.col("ee") - F.col("ey") * F.col("es"), det)
    m = m.withColumns({"b": b, "c": c})
    return m.select(
        "k", "n", (F.col("my") - F.col("b") * F.col("me") - F.col("c") * F.col("ms")).alias("a"), "b", "c",
        (F.col("n") * (F.col("yy") - F.col("b") * F.col("ey") - F.col("c") * F.col("sy"))).alias("sse"),
    )


def fit_decay_power(states: DataFrame, low: float = 0.30, high: float = 1.80, min_states: int = 50_000) -> dict:
    """Grid then refine the power that minimises the error. Returns plain parameters."""
    steps = round((high - low) / 0.05)
    coarse = decay_errors(states, [round(low + 0.05 * i, 4) for i in range(steps + 1)])
    best = coarse.orderBy("sse", "k").first()
    if best is None or best["n"] < min_states:
        raise ValueError(f"only {0 if best is None else best['n']} states carry a spread and a result")
    near = sorted({min(max(round(best["k"] - 0.05 + 0.01 * i, 4), low), high) for i in range(11)})
    fine = decay_errors(states, near).orderBy("sse", "k").first()
    if fine["sse"] < best["sse"]:
        best = fine
    return {
        "sim_decay_pow": round(best["k"], 4), "sim_decay_b": best["b"], "sim_decay_home_resid": best["a"],
        "sim_decay_score_coef": best["c"], "sim_decay_n": best["n"],
        "at_edge": best["k"] <= low + 1e-9 or best["k"] >= high - 1e-9,
    }


def fit_state_surface(states: DataFrame, keys: list[str], coarse: list[str], outcome: str, min_n: int = 30) -> DataFrame:
    """Mean outcome per cell of the state grid; thin cells take their coarse cell's mean.

    An empirical surface over measured states.
    """
    cells = states.groupBy(*keys).agg(F.avg(outcome).alias("mean"), F.count(outcome).alias("n"))
    blocks = states.groupBy(*coarse).agg(F.avg(outcome).alias("block_mean"))
    joined = cells.join(blocks, coarse)
    return joined.select(*keys, "n", F.when(F.col("n") >= min_n, F.col("mean")).otherwise(F.col("block_mean")).alias("wp"))

