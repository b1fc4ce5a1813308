"""Row filters, key normalisation and schema conformance."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtape.fixed_values import EXHIBITION_CODES, FORMER_FRANCHISES, FRANCHISES


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Refuse a table that lacks columns the work needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}")
    return df


def select_in_order(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Final projection: named columns, each once, in the order given."""
    wanted = list(dict.fromkeys(columns))
    return require_columns(df, wanted).select(*wanted)


def conform(df: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """The declared columns in the declared types: missing ones null, unknown ones dropped."""
    require_columns(df, required)
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def normalise_keys(df: DataFrame, text_ids: Sequence[str] = (), number_ids: Sequence[str] = (),
                   required: Sequence[str] = ()) -> DataFrame:
    """Join keys in one type each; rows without a required id are dropped."""
    casts = {c: F.col(c).cast("string") for c in text_ids}
    casts |= {c: F.col(c).cast("string").try_cast("double").cast("bigint") for c in number_ids}
    return df.withColumns(casts).dropna(subset=list(required)) if required else df.withColumns(casts)


def regular_season(df: DataFrame, types: Sequence[int] = (2,), column: str = "season_type") -> DataFrame:
    return df.where(F.col(column).isin(*types))


def franchise_games(df: DataFrame, teams: Sequence[str] | DataFrame | None = None,
                    home: str = "home_team", away: str = "away_team", former: bool = False) -> DataFrame:
    """Games between two known franchises; ``teams`` is a list of codes or a one-column table."""
    if isinstance(teams, DataFrame):
        code = teams.columns[0]
        for side in (home, away):
            df = df.join(teams.select(F.col(code).alias(side)).distinct(), side, "left_semi")
        return df
    codes = list(teams) if teams is not None else FRANCHISES + (FORMER_FRANCHISES if former else [])
    return df.where(F.col(home).isin(codes) & F.col(away).isin(codes))


def drop_exhibitions(df: DataFrame, home: str = "home_team", away: str = "away_team",
                     codes: Sequence[str] = tuple(EXHIBITION_CODES)) -> DataFrame:
    return df.where(~F.col(home).isin(*codes) & ~F.col(away).isin(*codes))


def drop_groups_with(df: DataFrame, key: Sequence[str], bad: Column) -> DataFrame:
    """Remove every group that has at least one bad row."""
    return df.join(df.where(bad).select(*key).distinct(), list(key), "left_anti")


def undecided(home: str = "home_final", away: str = "away_final", won: str = "home_won") -> Column:
    """A game row without a result, or with a tied one."""
    missing = F.col(won).isNull() | F.col(home).isNull()
    return missing | F.coalesce(F.col(home) == F.col(away), F.lit(False))


def price_band(df: DataFrame, columns: Sequence[str] = ("px_home", "px_away"), low=0, high=101) -> DataFrame:
    test = F.lit(True)
    for c in columns:
        test = test & (F.col(c) > low) & (F.col(c) < high)
    return df.where(test)


def date_window(df: DataFrame, column: str, start, end) -> DataFrame:
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def near_days(df: DataFrame, day: str, games: DataFrame, game_day: str, days: int = 1) -> DataFrame:
    """Rows dated within ``days`` of any game."""
    near = F.explode(F.sequence(F.date_sub(game_day, days), F.date_add(game_day, days))).alias(day)
    return df.join(F.broadcast(games.select(near).distinct()), day, "left_semi")  # calendar days only


def null_below_volume(df: DataFrame, columns: Sequence[str], volume: str, minimum: float,
                      fallback: dict[str, Column] | None = None) -> DataFrame:
    """Rates built on too little volume become null, or the given fallback."""
    thin = F.col(volume) < minimum
    fallback = fallback or {}
    new = {c: F.when(~thin, F.col(c)) for c in columns}
    new |= {c: F.when(thin, value).otherwise(F.col(c)) for c, value in fallback.items()}
    return df.withColumns(new)


def in_range(x: Column, low: float, high: float) -> Column:
    """x where it lies in [low, high], else null."""
    return F.when(x.between(low, high), x)


def drop_names(names: Sequence[str], dropped: Sequence[str], strict: bool = False,
               keep_at_least: int = 2) -> tuple[list[str], list[str]]:
    """(kept, unknown) after removing named inputs; strict refuses unknown names."""
    unknown = [c for c in dropped if c not in names]
    if unknown and strict:
        raise ValueError(f"not in the input list: {unknown}")
    kept = [c for c in names if c not in set(dropped)]
    if len(kept) < keep_at_least:
        raise ValueError(f"only {len(kept)} inputs would remain")
    return kept, unknown


def anti(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left rows whose key the right side lacks."""
    return left.join(right.select(*key).distinct(), list(key), "left_anti")


def semi(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    return left.join(right.select(*key).distinct(), list(key), "left_semi")


def thin_groups(df: DataFrame, key: Sequence[str], minimum: int) -> DataFrame:
    """Groups with fewer than ``minimum`` rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < minimum)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
