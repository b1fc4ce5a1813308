"""Strictly-prior player and team rates, and the regularised adjusted plus-minus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtape.fixed_values import BOX_SHRINK, LEAGUE_DEFAULTS, SHOT_SHRINK
from playtape.functions.numeric import safe_ratio
from playtape.operators.asof import asof_forward
from playtape.operators.ordered import (
    CALENDAR_DAYS,
    ordered,
    prior_count,
    prior_sum,
    row_number,
    running_max,
    running_sum,
    scan,
    whole,
)
from playtape.session import cut_lineage, shuffle_width

TOLERANCE, MOST_TURNS = 1e-12, 5_000  # of a solve: residual against the right-hand side, and steps
PLAYER_TOTALS = [
    "pts", "fga", "fgm", "fg3a", "fg3m", "fg2a", "fg2m", "fta", "ftm", "tov", "oreb", "dreb", "fouls", "poss_off",
    "minutes", "pts_gap",
]
TEAM_TOTALS = [
    "pts", "fga", "fgm", "fg3a", "fg3m", "fta", "ftm", "oreb", "dreb", "reb", "tov", "ast", "fouls", "stl", "blk",
    "poss",
]
TEAM_EXTRA = ["game_seconds", "poss_seg", "pts_gap", "sum_poss_sec", "n_poss_sec", "sum_shot_sec", "n_shot_sec"]
PER_100 = [
    "pts", "fga", "fgm", "fg3a", "fg3m", "fta", "ftm", "oreb", "dreb", "reb", "tov", "ast", "stl", "blk", "fouls",
]


def prior_totals(df: DataFrame, entity: list[str], order: list[str], columns: list[str], prefix: str = "prior_",
                 count: str = "prior_gp", hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Running totals over strictly earlier rows of the entity, and how many there were."""
    sums = {f"{prefix}{c}": prior_sum(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    return scan(ordered(df, entity, order, hot_rows, at_most), **sums, **{count: prior_count()}).result()


def every_nth_date(days: DataFrame, day: str, n: int) -> DataFrame:
    """Every n-th distinct date starting with the first, plus the last. Sized by the calendar."""
    o = scan(ordered(whole(days.select(day).where(F.col(day).isNotNull()).distinct()), ["_all"], [day], at_most=CALENDAR_DAYS), _i=row_number())
    last = days.agg(F.max(day).alias("d")).scalar()
    return o.result().where(((F.col("_i") - 1) % max(n, 1) == 0) | (F.col(day) == last)).select(day)


def prior_daily_league(box: DataFrame, day: str = "game_date") -> DataFrame:
    """League rates from all strictly earlier dates; fixed defaults before anything was played."""
    names = ["pts", "poss_off", "fg3m", "fg3a", "fg2m", "fg2a", "ftm", "fta"]
    daily = box.groupBy(day).agg(*[F.sum(c).cast("double").alias(c) for c in names])
    o = scan(ordered(whole(daily), ["_all"], [day], at_most=CALENDAR_DAYS), **{f"p_{c}": prior_sum(F.col(c), F.lit(0.0)) for c in names})

    def rate(num: str, den: str, scale: float, default: float) -> Column:
        value = scale * F.col(f"p_{num}") / F.greatest(F.col(f"p_{den}"), F.lit(1.0))
        return F.when(value != 0.0, value).otherwise(default)

    return o.result().select(
        day,
        rate("pts", "poss_off", 100.0, LEAGUE_DEFAULTS["pts"]).alias("lg_pts"),
        rate("fg3m", "fg3a", 1.0, LEAGUE_DEFAULTS["fg3"]).alias("lg_fg3"),
        rate("fg2m", "fg2a", 1.0, LEAGUE_DEFAULTS["fg2"]).alias("lg_fg2"),
        rate("ftm", "fta", 1.0, LEAGUE_DEFAULTS["ft"]).alias("lg_ft"),
    )


def player_rates(box: DataFrame, seasons: list[int] | None = None, min_prior_poss: float = 50.0,
                 shrink: float = BOX_SHRINK, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Shrunk and per-100 rates of each player before each game, over the whole history in ``box``.

    A player has one row per game, so the number of games is a valid ``at_most``.
    """
    totals = prior_totals(box, ["athlete_id"], ["game_date", "game_id"], PLAYER_TOTALS, hot_rows=hot_rows,
                          at_most=at_most)
    if seasons is not None:
        totals = totals.where(F.col("season").isin(*seasons))
    out = totals.join(F.broadcast(prior_daily_league(box)), "game_date", "left")  # one row per calendar day
    c = {name: F.col(f"prior_{name}") for name in PLAYER_TOTALS}
    poss, k, ks = c["poss_off"], F.lit(shrink), F.lit(shrink * SHOT_SHRINK)
    floor = F.greatest(poss, F.lit(1.0))
    attempts = F.greatest(c["fga"], F.lit(1.0))
    true_attempts = F.greatest(2.0 * (c["fga"] + 0.44 * c["fta"]), F.lit(1.0))
    known = poss >= min_prior_poss
    rates = {
        "pts_per100": (100.0 * c["pts"] + k * F.col("lg_pts") * 0.2) / (poss + k),
        "usage_per100": 100.0 * (c["fga"] + 0.44 * c["fta"] + c["tov"]) / floor,
        "ts_pct": c["pts"] / true_attempts,
        "fg3a_rate": c["fg3a"] / attempts,
        "fg2a_rate": c["fg2a"] / attempts,
        "ft_rate": c["fta"] / attempts,
        "tov_per100": 100.0 * c["tov"] / floor,
        "foul_per100": 100.0 * c["fouls"] / floor,
        "reb_per100": 100.0 * (c["oreb"] + c["dreb"]) / floor,
    }
    shots = {
        "fg3_pct": ((c["fg3m"] + ks * F.col("lg_fg3")) / (c["fg3a"] + ks), F.col("lg_fg3")),
        "fg2_pct": ((c["fg2m"] + ks * F.col("lg_fg2")) / (c["fg2a"] + ks), F.col("lg_fg2")),
        "ft_pct": ((c["ftm"] + ks * F.col("lg_ft")) / (c["fta"] + ks), F.col("lg_ft")),
    }
    return out.select(
        "game_id", "athlete_id", "game_date", "is_home", "season", "prior_gp",
        c["minutes"].alias("prior_min"), poss.alias("prior_poss"),
        *[F.when(known, v).alias(n) for n, v in rates.items()],
        *[F.when(known, v).otherwise(league).alias(n) for n, (v, league) in shots.items()],
        c["pts_gap"].alias("prior_pts_missing"),
        (100.0 * safe_ratio(c["pts_gap"], c["pts"] + c["pts_gap"])).alias("pts_missing_pct"),
    )


def team_ytd(box: DataFrame, timing: DataFrame, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Season-to-date team rates before each game."""
    joined = box.join(timing, ["game_id", "team_id"], "left")
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in TEAM_EXTRA if c in timing.columns}
    joined = joined.withColumns(zero)
    sums = TEAM_TOTALS + [f"opp_{c}" for c in TEAM_TOTALS] + TEAM_EXTRA
    df = prior_totals(joined, ["season", "team_id"], ["game_date", "game_id"], sums, "c_", "games_played", hot_rows,
                      at_most)
    c = {name: F.col(f"c_{name}") for name in sums}
    poss, opp = F.nullif(c["poss"], F.lit(0.0)), F.nullif(c["opp_poss"], F.lit(0.0))
    minutes = F.nullif(c["game_seconds"] / 60.0, F.lit(0.0))
    out = {
        "off_ppp": c["pts"] / poss,
        "def_ppp": c["opp_pts"] / opp,
        "net_ppp": c["pts"] / poss - c["opp_pts"] / opp,
        "poss_per_48": ((poss + opp) / 2.0) / minutes * 48.0,
        "sec_per_poss": safe_ratio(c["sum_poss_sec"], c["n_poss_sec"]),
        "sec_to_first_shot": safe_ratio(c["sum_shot_sec"], c["n_shot_sec"]),
        "poss_segmented": c["poss_seg"],
        "poss_formula": c["poss"],
        "prior_pts_missing": c["pts_gap"],
        "pts_missing_pct": 100.0 * safe_ratio(c["pts_gap"], c["pts"] + c["pts_gap"]),
    }
    for side, mine, my_poss in (("", "", poss), ("opp_", "opp_", opp)):
        out |= {
            f"{side}fg_pct": safe_ratio(c[f"{mine}fgm"], c[f"{mine}fga"]),
            f"{side}fg3_pct": safe_ratio(c[f"{mine}fg3m"], c[f"{mine}fg3a"]),
            f"{side}ft_pct": safe_ratio(c[f"{mine}ftm"], c[f"{mine}fta"]),
            f"{side}efg_pct": safe_ratio(c[f"{mine}fgm"] + 0.5 * c[f"{mine}fg3m"], c[f"{mine}fga"]),
            f"{side}fg3a_rate": safe_ratio(c[f"{mine}fg3a"], c[f"{mine}fga"]),
            f"{side}ft_rate": safe_ratio(c[f"{mine}fta"], c[f"{mine}fga"]),
            f"{side}tov_pct": 100.0 * c[f"{mine}tov"] / my_poss,
        }
    out |= {
        "oreb_pct": safe_ratio(c["oreb"], c["oreb"] + c["opp_dreb"]),
        "dreb_pct": safe_ratio(c["dreb"], c["dreb"] + c["opp_oreb"]),
        "reb_pct": safe_ratio(c["reb"], c["reb"] + c["opp_reb"]),
    }
    for name in PER_100:
        out[f"off_{name}_per100"] = 100.0 * c[name] / poss
        out[f"def_{name}_per100"] = 100.0 * c[f"opp_{name}"] / opp
    return df.select(
        "game_id", "season", "game_date", "team", "team_id", "opponent", "opp_team_id", "is_home", "games_played",
        *[v.alias(n) for n, v in out.items()],
    )


def index_refits(refits: DataFrame) -> DataFrame:
    """Refit dates numbered from 1."""
    days = ordered(whole(refits.select("refit_date").distinct()), ["_all"], ["refit_date"], at_most=CALENDAR_DAYS)
    return scan(days, refit_ix=row_number()).result()


def rapm_observations(stint: DataFrame, indexed: DataFrame) -> DataFrame:
    """Two weighted observations per stint, summed over stints that share season, bucket and lineups.

    The bucket is the number of the first refit strictly after the stint's date, so the history of a
    refit is the union of the buckets up to it.
    """
    days = whole(stint.select("game_date").distinct()).withColumn("_from", F.date_add("game_date", 1))
    after = asof_forward(days, indexed, ["_all"], "_from", "refit_date", ["refit_ix"], at_most=2 * CALENDAR_DAYS)
    after = after.where(F.col("refit_ix").isNotNull()).select("game_date", F.col("refit_ix").alias("bucket"))
    placed = stint.join(after, "game_date", "inner")
    parts = None
    for off, dfn, home in (("home", "away", 1), ("away", "home", 0)):
        part = placed.where(F.col(f"poss_{off}") > 0).select(
            "season", "bucket", F.col(f"{off}_lineup").alias("off"), F.col(f"{dfn}_lineup").alias("def"),
            F.lit(home).alias("is_home"), F.col(f"poss_{off}").alias("w"), (100.0 * F.col(f"pts_{off}")).alias("wy"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("season", "bucket", "off", "def", "is_home").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))


def refit_history(stint: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per refit: how many stints lie strictly before it and the newest season among them."""
    days = stint.groupBy(F.col("game_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("season").alias("season")
    ).withColumn("_late", F.lit(1))
    line = indexed.select(F.col("refit_date").alias("day"), "refit_ix", F.lit(0).alias("_late")).unionByName(
        days, allowMissingColumns=True
    )
    o = ordered(whole(line), ["_all"], ["day", "_late"], at_most=2 * CALENDAR_DAYS)
    o = scan(o, stints=running_sum(F.col("n")), newest=running_max(F.col("season")))
    return o.result().where(F.col("refit_ix").isNotNull()).select(
        "refit_ix", F.col("day").alias("refit_date"), F.coalesce("stints", F.lit(0)).alias("stints"), "newest"
    )


def rapm_gram(observations: DataFrame) -> DataFrame:
    """Upper-triangle Gram entries and right-hand sides per season and refit bucket.

    Features are strings: ``o<id>`` and ``d<id>`` per player block, ``h`` for home offence, ``i`` for the
    intercept and ``y`` for the target. Each observation has a fixed dozen features.
    """
    def block(prefix: str, column: str) -> Column:
        ids = F.filter(F.split(column, ","), lambda x: F.length(x) > 0)
        return F.transform(ids, lambda x: F.concat(F.lit(prefix), x))

    extra = F.when(F.col("is_home") == 1, F.array(F.lit("h"), F.lit("i"))).otherwise(F.array(F.lit("i")))
    features = F.array_sort(F.concat(block("o", "off"), block("d", "def"), extra))
    rows = observations.select("season", "bucket", "w", "wy", features.alias("f"))
    left = rows.select("season", "bucket", "w", "wy", "f", F.posexplode("f").alias("p", "i"))
    pairs = left.select(
        "season", "bucket", "w", "i", F.explode(F.slice("f", F.col("p") + 1, F.size("f") - F.col("p"))).alias("j")
    ).groupBy("season", "bucket", "i", "j").agg(F.sum("w").alias("v"))
    rhs = left.groupBy("season", "bucket", "i", F.lit("y").alias("j")).agg(F.sum("wy").alias("v"))
    return pairs.unionByName(rhs)


class RunningGram:
    """Gram entries summed so far by pair of features, and the solution before, from which the next one starts."""

    def __init__(self, ridge: float) -> None:
        self.ridge = ridge
        self.names: dict[str, int] = {}
        self.pairs, self.values = np.empty(0, np.int64), np.empty(0)
        self.rhs, self.solution = np.empty(0), np.empty(0)

    def add(self, entries: pd.DataFrame) -> None:
        number = lambda names: np.fromiter((self.names.setdefault(n, len(self.names)) for n in names), np.int64, len(names))
        target = entries["j"].to_numpy() == "y"
        i = number(entries["i"])
        j = number(entries["j"][~target])
        grown = len(self.names) - len(self.rhs)
        self.rhs, self.solution = np.pad(self.rhs, (0, grown)), np.pad(self.solution, (0, grown))
        np.add.at(self.rhs, i[target], entries["v"].to_numpy()[target])
        pairs = np.concatenate([self.pairs, (i[~target] << 32) | j])
        self.pairs, at = np.unique(pairs, return_inverse=True)
        self.values = np.bincount(at, np.concatenate([self.values, entries["v"].to_numpy()[~target]]), len(self.pairs))

    def solve(self, scale: float) -> np.ndarray:
        """Conjugate gradients over the entries, preconditioned by the diagonal, from the solution before."""
        n, i, j = len(self.rhs), self.pairs >> 32, self.pairs & ((1 << 32) - 1)
        own = i == j
        free = np.array([name in ("h", "i") for name in self.names])
        diagonal = np.bincount(i[own], self.values[own] * scale, n) + np.where(free, 0.0, self.ridge)
        i, j, v = i[~own], j[~own], self.values[~own] * scale
        product = lambda x: diagonal * x + np.bincount(i, v * x[j], n) + np.bincount(j, v * x[i], n)
        x, inverse = self.solution.copy(), 1.0 / np.where(diagonal > 0, diagonal, 1.0)
        rest = self.rhs * scale - product(x)
        limit = TOLERANCE * max(np.linalg.norm(self.rhs * scale), 1e-300)
        z = inverse * rest
        way, size = z.copy(), rest @ z
        for _ in range(MOST_TURNS):
            if np.linalg.norm(rest) <= limit or not size:
                break
            moved = product(way)
            step = size / (way @ moved)
            x, rest = x + step * way, rest - step * moved
            z = inverse * rest
            before, size = size, rest @ z
            way = z + size / before * way
        self.solution = x
        return x

    def ratings(self, refit_date, scale: float) -> pd.DataFrame:
        coef = dict(zip(self.names, self.solve(scale).tolist(), strict=True))
        players = sorted({int(n[1:]) for n in self.names if n[0] in "od" and len(n) > 1})
        return pd.DataFrame({
            "refit_date": refit_date, "athlete_id": np.array(players, np.int64),
            "rapm_off": [coef.get(f"o{p}", 0.0) for p in players], "rapm_def": [coef.get(f"d{p}", 0.0) for p in players]})


def rapm(stint: DataFrame, refits: DataFrame, ridge_lambda: float = 2000.0, season_decay: float = 0.75,
         min_stints: int = 5000, segments: int | None = None) -> DataFrame:
    """Offensive and defensive ratings per refit date from strictly earlier stints.

    Spark sums the Gram entries per refit bucket. The refits are cut into ``segments`` in order of date; a task begins with
    the entries summed up to its segment, then adds each bucket's entries and solves, so an entry is copied once for each
    later segment and not for each later refit. What a task holds grows with the pairs of players that met,
    not with stints or refits. Seasons fade by one factor for each season; entries are kept in the first season's scale.
    """
    indexed = cut_lineage(index_refits(refits))
    bounds = indexed.agg(F.max("refit_ix").alias("last")).first()
    first_season = stint.agg(F.min("season").alias("s")).first().s
    last, base = bounds.last or 0, first_season or 0
    segments = max(1, min(segments or shuffle_width(stint.sparkSession), -(-last // 4)))
    place = lambda ix: F.floor((ix - 1) * segments / max(1, last)).cast("long")
    grown = F.pow(F.lit(season_decay), (F.lit(base) - F.col("season")).cast("double"))
    scaled = rapm_gram(rapm_observations(stint, indexed)).groupBy("bucket", "i", "j").agg(F.sum(F.col("v") * grown).alias("v"))
    scaled = cut_lineage(scaled.withColumn("segment", place(F.col("bucket"))))
    summed = scan(ordered(scaled.groupBy("i", "j", "segment").agg(F.sum("v").alias("v")), ["i", "j"], ["segment"], at_most=segments),
                  v=running_sum(F.col("v"))).result()
    following = F.lead("segment", 1, segments - 1).over(Window.partitionBy("i", "j").orderBy("segment"))
    begun = summed.withColumn("_until", following).where(F.col("_until") > F.col("segment")).select(
        F.explode(F.sequence(F.col("segment") + 1, "_until")).alias("segment"), F.lit(0).cast("long").alias("bucket"), "i", "j", "v")
    faded = F.pow(F.lit(season_decay), (F.col("newest") - F.lit(base)).cast("double"))
    due = refit_history(stint, indexed).where((F.col("stints") >= min_stints) & F.col("newest").isNotNull()).select(
        place(F.col("refit_ix")).alias("segment"), F.col("refit_ix").alias("bucket"), faded.alias("v"), "refit_date")
    line = begun.unionByName(scaled.select("segment", "bucket", "i", "j", "v")).unionByName(due, allowMissingColumns=True)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, gram, waiting = None, None, []
        for batch in batches:
            cuts = np.flatnonzero(batch["refit_date"].notna().to_numpy() | (batch["segment"] != batch["segment"].shift()).to_numpy())
            for part in np.split(np.arange(len(batch)), cuts):
                rows = batch.iloc[part]
                if not len(rows):
                    continue
                if rows["segment"].iloc[0] != segment:
                    segment, gram, waiting = rows["segment"].iloc[0], RunningGram(ridge_lambda), []
                marker = rows["refit_date"].notna().to_numpy()
                if marker[0]:
                    if waiting:
                        gram.add(pd.concat(waiting))
                        waiting = []
                    if gram.names:
                        yield gram.ratings(rows["refit_date"].iloc[0], rows["v"].iloc[0])
                    rows = rows.iloc[1:]
                if len(rows):
                    waiting.append(rows[["i", "j", "v"]])

    # A refit comes behind its own bucket's entries.
    sorted_line = line.repartition("segment").sortWithinPartitions("segment", "bucket", F.col("refit_date").asc_nulls_first())
    out = sorted_line.select("segment", "i", "j", "v", "refit_date").mapInPandas(
        walk, "refit_date date, athlete_id bigint, rapm_off double, rapm_def double")
    return out.withColumn("rapm_net", F.col("rapm_off") - F.col("rapm_def"))


def season_refits(box: DataFrame, seasons: list[int], every: int) -> DataFrame:
    """(season, refit_date): every n-th game date of each season, counted from its first, and its last."""
    parts = [every_nth_date(box.where(F.col("season") == s), "game_date", every).select(
        F.lit(s).cast(box.schema["season"].dataType).alias("season"), F.col("game_date").alias("refit_date")) for s in sorted(set(seasons))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_rapm(rates: DataFrame, ratings: DataFrame, refits: DataFrame) -> DataFrame:
    """Each row's rating as of its season's last refit on or before its date (before that, the season's first refit).

    Works on the distinct days of a season, so the lookup has one row per season and day.
    """
    days = rates.select("season", "game_date").distinct()
    versions = days.join(refits, "season").groupBy("season", "game_date").agg(
        F.coalesce(F.max(F.when(F.col("refit_date") <= F.col("game_date"), F.col("refit_date"))), F.min("refit_date")).alias("refit_date"))
    dated = rates.join(F.broadcast(versions), ["season", "game_date"], "left")
    return dated.join(ratings, ["refit_date", "athlete_id"], "left")


def rate_build(stint: DataFrame, box: DataFrame, seasons: list[int], refit_every: int = 7, history_seasons: int = 2,
               at_most: int | None = None, **rapm_args) -> DataFrame:
    """Player rates of the seasons, with ratings refitted every ``refit_every`` game dates of each season.

    Nothing older than ``history_seasons`` before the first asked season counts. ``refit_date`` says which refit
    a row's ratings are from.
    """
    if not seasons:
        raise ValueError("no seasons are asked for")
    known = F.col("season").between(min(seasons) - history_seasons, max(seasons))
    stint, box = stint.where(known), box.where(known)
    refits = season_refits(box, seasons, refit_every)
    ratings = rapm(stint, refits.select("refit_date").distinct(), **rapm_args)
    return with_rapm(player_rates(box, seasons, at_most=at_most), ratings, refits)
