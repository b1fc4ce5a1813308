"""Exchange trade tape: typed rows, both-side prices, joins to games, quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.functions.clock import instant
from playtape.functions.numeric import dollars_to_cents, home_price
from playtape.functions.text import parse_ticker, tape_team
from playtape.operators.asof import join_nearby_day
from playtape.operators.dedupe import keep_first
from playtape.operators.filters import near_days, price_band


def typed_trades(raw: DataFrame) -> DataFrame:
    """Raw trade rows with instant, prices in cents, count and game parsed from the ticker; nothing dropped yet.

    Tickers are parsed once each and joined back: a tape has few tickers and very many trades. Parsing an
    aggregate's result keeps later filters on the parsed columns above that aggregate.
    """
    once = raw.groupBy("ticker").agg(F.max("ticker").alias("_ticker"))
    df = raw.join(parse_ticker(once, "_ticker").drop("_ticker"), "ticker", "left")
    ts = instant(F.col("created_time"))
    yes = F.coalesce(dollars_to_cents(F.col("yes_price_dollars")), F.col("yes_price").cast("double"))
    return df.withColumns({
        "timestamp": ts,
        "timestamp_unix": F.unix_micros(ts) / 1e6,
        "yes_price_cents": yes,
        "home_yes_price_cents": home_price(yes, F.col("is_home_yes")),
        "no_price_cents": dollars_to_cents(F.col("no_price_dollars")),
        "count_fp": F.col("count_fp").try_cast("double"),
        "is_block_trade": F.coalesce("is_block_trade", F.lit(False)),
    })


def usable_trades(typed: DataFrame) -> DataFrame:
    """Rows with a parsed game, an instant and a price."""
    return typed.where(
        F.col("game_date").isNotNull() & F.col("timestamp").isNotNull() & F.col("yes_price_cents").isNotNull()
    )


def trade_report(typed: DataFrame) -> DataFrame:
    """(metric, value) counts of what the typing could not use."""
    blank = F.coalesce(F.trim("created_time"), F.lit("")) == ""
    counters = {
        "no_timestamp": blank,
        "no_price": ~blank & F.col("yes_price_cents").isNull(),
        "bad_timestamp": ~blank & F.col("yes_price_cents").isNotNull() & F.col("timestamp").isNull(),
        "no_count": F.col("timestamp").isNotNull() & F.col("yes_price_cents").isNotNull() & F.col("count_fp").isNull(),
        "unparsed_ticker": F.col("game_date").isNull(),
    }
    return counters_table(typed, counters)


def counters_table(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One pass over the rows, one (metric, value) row per counter."""
    one = df.agg(*[F.count_if(test).alias(name) for name, test in counters.items()])
    return one.unpivot([], list(counters), "metric", "value")


def assemble(shards: DataFrame) -> DataFrame:
    """Union of shards without blank ids, one row per trade id."""
    return keep_first(shards.where(F.coalesce("trade_id", F.lit("")) != ""), ["trade_id"], ["timestamp_unix", "ticker"])


def in_tape_order(tape: DataFrame) -> DataFrame:
    """Tape rows of a game together and in time order inside each task, for the sink."""
    return tape.repartition("game_date", "home_team").sortWithinPartitions("game_date", "home_team", "timestamp_unix")


def price_sides(tape: DataFrame, spread: float = 1.0, mode: str = "taker") -> DataFrame:
    """What either side would have had to pay at each print.

    A taker who bought paid the ask of the printed side; one who sold hit its bid. ``legacy`` reads every
    print as the home ask.
    """
    if mode not in ("taker", "legacy"):
        raise ValueError(f"unknown price mode {mode!r}")
    price = F.col("yes_price_cents").cast("double")
    home_yes = F.col("is_home_yes") == 1
    if mode == "legacy":
        home = F.coalesce(
            F.col("home_yes_price_cents").cast("double"), F.when(home_yes, price).otherwise(101.0 - price)
        )
        return tape.withColumns({"px_home": home, "px_away": 101.0 - home})
    bought = F.coalesce(F.lower(F.trim("taker_side")) == "yes", F.lit(False))
    printed = F.when(bought, price).otherwise(price + spread)
    other = F.when(bought, 100.0 + spread - price).otherwise(100.0 - price)
    return tape.withColumns({
        "px_home": F.when(home_yes, printed).otherwise(other),
        "px_away": F.when(home_yes, other).otherwise(printed),
    })


def load_tape(tape: DataFrame, games: DataFrame, spread: float = 1.0, mode: str = "taker") -> DataFrame:
    """Priced prints near the games' dates, with whole-second stamps and canonical teams."""
    near = near_days(tape, "game_date", games, "game_date")
    priced = price_sides(near, spread, mode).withColumns({
        "ts": F.rint(F.col("timestamp_unix").cast("double")).cast("bigint"),
        "home_team_n": tape_team(F.col("home_team")), "away_team_n": tape_team(F.col("away_team")),
    })
    return price_band(priced.where(F.col("ts").isNotNull()))


def tape_of_games(priced: DataFrame, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) prints; a print joins the game of its pair on the nearest day."""
    keyed = games.select(
        "game_id", "game_date", tape_team(F.col("home_team")).alias("home_team_n"),
        tape_team(F.col("away_team")).alias("away_team_n"),
    )
    return join_nearby_day(priced, keyed, "game_date", ["home_team_n", "away_team_n"], "game_id")


def one_print_per_second(tape: DataFrame) -> DataFrame:
    """First print of each (game, second)."""
    return keep_first(tape, ["game_id", "ts"], ["timestamp_unix", "trade_id"])


def leg_check(tape: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows carrying both legs, and how many of them add up to 100 cents."""
    both = F.col("no_price_cents").isNotNull()
    off = F.abs(F.col("yes_price_cents") + F.col("no_price_cents") - 100.0) > tolerance
    return tape.agg(F.count_if(both).alias("rows"), F.count_if(both & ~off).alias("consistent"))
