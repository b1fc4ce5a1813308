"""Event flags and identifiers read out of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.fixed_values import (
    DISTANCE_EDGES,
    EXCHANGE_ALIASES,
    EXCHANGE_CODES,
    MONTHS,
    PERSONAL_ONLY_FOULS,
    SHOT_FAMILIES,
    SUBSTITUTION,
    TAPE_ALIASES,
    TEAM_FOULS,
    TECHNICAL_FOULS,
)

TICKER = r"^[A-Z0-9]+-(\d{2})([A-Z]{3})(\d{2})(\d{4})?([A-Z]{4,10})-([A-Z]{2,4})$"


def has(text: Column, pattern: str) -> Column:
    """Case-insensitive search; null text is no match."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def lookup(code: Column, table: dict) -> Column:
    """Value of a small fixed table, null when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)


def extract_number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit("")).try_cast("int")


def shot_family(type_text: Column, text: Column) -> Column:
    """First family, in order, whose words occur in the type or the text."""
    out = None
    for name, words in SHOT_FAMILIES.items():
        hit = has(type_text, words) | has(text, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise("other")


def distance_bin(distance: Column) -> Column:
    """Index of the distance range; -1 when the distance is unknown, the last range when beyond."""
    out = F.lit(-1)
    for i, edge in enumerate(DISTANCE_EDGES[:-1]):
        out = F.when(distance >= edge, F.lit(i)).otherwise(out)
    return out


def shot_flags(type_text: Column, text: Column) -> dict[str, Column]:
    """Strict event reading: attempts need "makes" or "misses"; possession ends are told apart."""
    free = F.coalesce(type_text.startswith("Free Throw"), F.lit(False))
    makes, misses = has(text, r"\bmakes\b"), has(text, r"\bmisses\b")
    shot, three = makes | misses, has(text, "three point")
    turnover = has(type_text, "turnover") | has(text, "turnover")
    number = extract_number(text, r"free throw (\d+) of (\d+)", 1)
    of = extract_number(text, r"free throw (\d+) of (\d+)", 2)
    distance = extract_number(text, r"(\d+)-foot")
    return {
        "is_fga": ~free & shot,
        "is_fg3a": ~free & shot & three,
        "is_fg3m": ~free & three & makes,
        "is_fg2a": ~free & shot & ~three,
        "is_fg2m": ~free & ~three & makes,
        "is_fta": free & shot,
        "is_ftm": free & makes,
        "is_ft_last": free & shot & F.coalesce(number == of, F.lit(False)),
        "shot_dist": distance,
        "shot_family": shot_family(type_text, text),
        "dist_bin": distance_bin(distance),
        "is_turnover": turnover,
        "is_steal": has(text, "steal"),
        "is_def_reb": has(type_text, "defensive rebound"),
        "is_off_reb": has(type_text, "offensive rebound"),
        "is_foul": has(type_text, "foul") & ~turnover,
    }


def box_flags(type_text: Column, text: Column, score_value: Column, value_is_points: Column, actor: Column):
    """Box-score event reading: a blocked shot is an attempt of its own row and never a make.

    ``value_is_points`` says whether ``score_value`` holds points per play in this season, so that a
    three there may break the tie.
    """
    free = has(type_text, "free throw")
    made, missed = has(text, "makes"), has(text, "misses")
    blocked = ~free & ~made & ~missed & has(text, "block")
    attempt = ~free & (made | missed | blocked)
    by_value = F.coalesce(value_is_points, F.lit(False)) & F.coalesce(score_value == 3, F.lit(False))
    three = has(text, "three point") | by_value
    turnover = has(type_text, "turnover")
    rebound, known = has(type_text, "rebound"), actor.isNotNull()
    offensive, defensive = rebound & has(type_text, "offensive"), rebound & has(type_text, "defensive")
    return {
        "is_ft": free,
        "is_ft_made": free & made,
        "is_ft_att": free & (made | missed),
        "is_fga": attempt,
        "is_fgm": attempt & made,
        "is_fg3a": attempt & three,
        "is_fg3m": attempt & three & made,
        "is_fg2a": attempt & ~three,
        "is_fg2m": attempt & made & ~three,
        "is_tov": turnover,
        "is_foul": has(type_text, "foul") & ~turnover,
        "is_oreb": offensive,
        "is_dreb": defensive,
        "is_oreb_player": offensive & known,
        "is_dreb_player": defensive & known,
        "is_team_reb": rebound & ~known,
        "is_ast": has(text, "assists"),
        "is_sub": F.coalesce(F.lower(type_text) == SUBSTITUTION.lower(), F.lit(False)),
        "tov_stolen": turnover & (has(text, "steal") | has(type_text, "steal")),
        "fga_blocked": blocked,
    }


def rebuilt_points(made: Column, made_three: Column, made_free: Column) -> Column:
    """Points from makes, not from the recorded play value."""
    return (
        3.0 * made_three.cast("double")
        + 2.0 * (made.cast("double") - made_three.cast("double"))
        + made_free.cast("double")
    )


def foul_class(type_text: Column) -> Column:
    return (
        F.when(type_text.isin(TEAM_FOULS), "team and personal")
        .when(type_text.isin(PERSONAL_ONLY_FOULS), "personal only")
        .when(type_text.isin(TECHNICAL_FOULS), "technical")
        .otherwise("unrecognised")
    )


def is_team_foul(type_text: Column) -> Column:
    return F.coalesce(type_text.isin(TEAM_FOULS), F.lit(False))


def is_personal_foul(type_text: Column) -> Column:
    return F.coalesce(type_text.isin(TEAM_FOULS + PERSONAL_ONLY_FOULS), F.lit(False))


def substitution_direction(first: Column, second: Column, text: Column) -> tuple[Column, Column]:
    """(entering, leaving) without knowledge of who is playing.

    Both named: documented order. One named: leaving when the text opens with the verb, else entering.
    """
    lone = F.coalesce(first, second)
    verb_first = F.coalesce(F.lower(F.trim(text)).startswith("enters the game for"), F.lit(False))
    both = first.isNotNull() & second.isNotNull()
    entering = F.when(both, first).when(~verb_first, lone)
    leaving = F.when(both, second).when(verb_first, lone)
    return entering, leaving


def tape_team(code: Column) -> Column:
    """Team code stripped to letters, upper-cased, and mapped to its one canonical form."""
    letters = F.regexp_replace(F.upper(F.trim(code)), "[^A-Z]", "")
    return F.coalesce(lookup(letters, TAPE_ALIASES), letters)


EXCHANGE_TABLE = {**{c: c for c in EXCHANGE_CODES}, **EXCHANGE_ALIASES}


def exchange_team(code: Column) -> Column:
    """Exchange code after aliases, null when it is no team."""
    return lookup(F.upper(code), EXCHANGE_TABLE)


def split_team_blob(blob: Column, normalise=exchange_team) -> Column:
    """struct(away, home) when exactly one split of the blob names two teams, else null."""
    cuts = F.sequence(F.lit(2), F.greatest(F.length(blob) - 2, F.lit(2)))
    pairs = F.transform(
        cuts,
        lambda i: F.struct(
            normalise(F.substring(blob, F.lit(1), i)).alias("away"),
            normalise(F.substring(blob, i + 1, F.length(blob))).alias("home"),
        ),
    )
    valid = F.filter(pairs, lambda p: p["away"].isNotNull() & p["home"].isNotNull())
    return F.when((F.size(valid) == 1) & (F.length(blob) >= 4), F.get(valid, 0))


def parse_ticker(df: DataFrame, ticker: str) -> DataFrame:
    """Add game_date, away_team, home_team and is_home_yes; null where the ticker does not parse."""
    t = F.upper(F.trim(F.col(ticker)))
    month = lookup(F.regexp_extract(t, TICKER, 2), {k: f"{v:02d}" for k, v in MONTHS.items()})
    day = F.concat_ws("-", F.concat(F.lit("20"), F.regexp_extract(t, TICKER, 1)), month, F.regexp_extract(t, TICKER, 3))
    teams = split_team_blob(F.regexp_extract(t, TICKER, 5))
    yes = exchange_team(F.regexp_extract(t, TICKER, 6))
    df = df.withColumns({"_day": F.when(month.isNotNull(), day.try_cast("date")), "_teams": teams, "_yes": yes})
    away, home = F.col("_teams.away"), F.col("_teams.home")
    ok = F.coalesce(
        F.col("_day").isNotNull() & ((F.col("_yes") == away) | (F.col("_yes") == home)), F.lit(False)
    )
    return df.withColumns({
        "game_date": F.when(ok, F.col("_day")),
        "away_team": F.when(ok, away),
        "home_team": F.when(ok, home),
        "is_home_yes": F.when(ok, (F.col("_yes") == home).cast("int")),
    }).drop("_day", "_teams", "_yes")


def any_word(text: Column, words: Sequence[str]) -> Column:
    return has(text, "|".join(words))
