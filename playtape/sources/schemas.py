"""Declared input schemas."""

from pyspark.sql import types as T

S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


OUTCOME = _struct(name=S, price=D, point=D)
MARKET = _struct(key=S, outcomes=T.ArrayType(OUTCOME))
BOOK = _struct(key=S, markets=T.ArrayType(MARKET))
EVENT = _struct(id=S, home_team=S, away_team=S, commence_time=S, bookmakers=T.ArrayType(BOOK))
SNAPSHOT = _struct(timestamp=S, previous_timestamp=S, next_timestamp=S, data=T.ArrayType(EVENT))

RAW_TRADE = _struct(
    ticker=S, event_ticker=S, trade_id=S, created_time=S, yes_price_dollars=S, no_price_dollars=S, yes_price=I,
    count_fp=S, taker_side=S, taker_outcome_side=S, taker_book_side=S, is_block_trade=B,
)
RAW_PBP = _struct(
    game_id=I, season=I, season_type=I, game_date=T.DateType(), home_team_id=I, away_team_id=I, home_team_abbrev=S,
    away_team_abbrev=S, period_number=I, game_play_number=I, clock_display_value=S, type_text=S, text=S, team_id=L,
    athlete_id_1=L, athlete_id_2=L, athlete_id_3=L, home_score=I, away_score=I, scoring_play=B, score_value=I,
    wallclock=S, home_team_spread=D,
)
ROSTER = _struct(game_id=S, team_id=L, athlete_id=L, starter=B, did_not_play=B, reason=S)
SCHEDULE = _struct(
    game_id=S, season=I, game_date=T.DateType(), game_date_time=S, home_abbreviation=S, away_abbreviation=S,
    home_score=D, away_score=D,
)
BETS = _struct(
    game_id=S, game_date=T.DateType(), home_team=S, away_team=S, season=I, period=I, pc_seconds_left=D, grid_unix=L,
    anchor=L, side=S, price=D, p_win=D, edge=D, edge_z=D, contracts=D, fee=D, staked=D, won=I, pnl=D,
    score_margin=L, logit_close=D, fill_delay=L, edge_bucket=S, price_bucket=S, margin_bucket=S, role=S, quarter=S,
    month=S,
)
