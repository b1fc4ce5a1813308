"""A hand-written game: every lineup below was worked out on paper."""

import datetime

import pytest
from pyspark.sql import functions as F

from playtape.plans import pbp
from playtape.sources import schemas

HOME, AWAY = [1, 2, 3, 4, 5], [11, 12, 13, 14, 15]
SUB = "Substitution"


def _row(n, period, clock, kind, text, team, a1=None, a2=None, a3=None, hs=0, as_=0, made=False, value=0, game=1):
    return (game, 2024, 2, datetime.date(2024, 1, 1), 100, 200, "BOS", "DEN", period, n, clock, kind, text, team, a1, a2, a3, hs, as_, made, value, None, -3.5)


RAW = [
    _row(1, 1, "11:40", "Jump Shot", "P1 makes 20-foot jumper", 100, 1, hs=2, made=True, value=2),
    _row(2, 1, "11:20", "Shooting Foul", "P11 shooting foul", 200, 11, hs=2),
    _row(3, 1, "11:10", SUB, "P6 enters the game for P2", 100, 6, 2, hs=1),           # score falls: repaired
    _row(4, 1, "11:00", SUB, "enters the game for P12", 200, 12, hs=2),               # truncated: 12 leaves, away short
    _row(5, 1, None, "Defensive Rebound", "P16 defensive rebound", 200, 16, hs=2),    # 16 acts: away repaired
    _row(6, 1, "10:30", SUB, "P2 enters the game for ", 100, 2, hs=2),                # truncated: 2 enters, home has six
    _row(7, 2, "11:50", "Jump Shot", "P11 misses jumper", 200, 11, hs=2),
    _row(8, 2, "11:40", "Personal Foul", "P1 personal foul", 100, 1, 2, 3, hs=2),
    _row(9, 2, "11:30", "Personal Foul", "P4 personal foul", 100, 4, 5, hs=2),
    _row(10, 2, "11:20", "Pass", "pass", 200, 12, 13, 14, hs=2),
    _row(11, 2, "11:10", "Pass", "pass", 200, 15, hs=2),
    _row(12, 2, "11:00", SUB, "P7 enters the game for P1", 100, 7, 1, hs=2),
    _row(13, 2, "10:50", SUB, "P1 enters the game for P7", 100, 7, 1, hs=2),          # reversed order: 7 is on the floor
    _row(14, 3, "11:00", "Jump Shot", "P11 makes three point jumper", 200, 11, hs=2, as_=3, made=True, value=3),
]


@pytest.fixture(scope="module")
def tables(spark):
    raw = spark.createDataFrame(RAW + [_row(1, 1, "12:00", "Jump Shot", "x", 100, 1, game=2)], schemas.RAW_PBP)
    people = [("1", 100, p, p in HOME, False, None) for p in range(1, 9)] + [("1", 200, p, p in AWAY, False, None) for p in range(11, 18)]
    roster = spark.createDataFrame(people, schemas.ROSTER)
    day = datetime.date(2024, 1, 1)
    schedule = spark.createDataFrame([("1", 2024, day, "2024-01-01T20:00Z", "BOS", "DEN", 2.0, 5.0), ("2", 2024, day, "", "BOS", "DEN", 1.0, 2.0)], schemas.SCHEDULE)
    return raw, roster, schedule


@pytest.fixture(scope="module")
def clean(tables):
    return {r.play_number: r for r in pbp.build_pbp(*tables).collect()}


def _ids(*players):
    return ",".join(str(p) for p in sorted(players))


def test_games_without_roster_are_dropped(clean):
    assert {r.game_id for r in clean.values()} == {"1"}


def test_first_period_walk(clean):
    assert clean[1].home_lineup == _ids(*HOME) and clean[1].away_lineup == _ids(*AWAY) and clean[1].lineup_ok
    assert clean[3].home_lineup == _ids(1, 3, 4, 5, 6)
    assert clean[4].away_lineup == _ids(11, 13, 14, 15) and not clean[4].lineup_ok
    assert clean[5].away_lineup == _ids(11, 13, 14, 15, 16) and clean[5].lineup_ok
    assert clean[6].home_lineup == _ids(1, 2, 3, 4, 5, 6) and not clean[6].lineup_ok


def test_second_period_opens_by_first_touch(clean):
    assert clean[7].home_lineup == _ids(*HOME) and clean[7].away_lineup == _ids(*AWAY) and clean[7].lineup_ok
    assert clean[12].home_lineup == _ids(2, 3, 4, 5, 7)
    assert clean[13].home_lineup == _ids(*HOME)


def test_third_period_carries_the_previous_five(clean):
    assert clean[14].home_lineup == _ids(*HOME) and clean[14].away_lineup == _ids(*AWAY)


def test_clock_scores_fouls_and_labels(clean):
    assert clean[1].seconds_elapsed == 20.0 and clean[7].seconds_left_reg == 2150.0
    assert clean[5].pc_seconds_left is None
    assert [clean[n].home_score for n in (2, 3, 4)] == [2, 2, 2]
    assert (clean[2].away_team_fouls_period, clean[9].home_team_fouls_period, clean[9].away_team_fouls_period) == (1, 2, 0)
    assert clean[9].player_fouls == "1:1,4:1,11:1"
    assert clean[1].home_final == 2.0 and clean[1].home_won == 0


def test_quality_report(tables):
    report = {r.metric: r.value for r in pbp.quality_report(*tables).collect()}
    assert report["no_roster"] == 1 and report["score_corrections"] == 1 and report["repaired_short_lineup"] == 1
    assert report["carried_forward"] == 1 and report["final_score_disagreement"] == 1 and report["winner_would_have_flipped"] == 0


def test_state_survives_small_arrow_batches(spark, tables, clean):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        again = {r.play_number: r for r in pbp.build_pbp(*tables).collect()}
    finally:
        spark.conf.set(key, before)
    assert {n: (r.home_lineup, r.away_lineup, r.player_fouls) for n, r in again.items()} == {
        n: (r.home_lineup, r.away_lineup, r.player_fouls) for n, r in clean.items()}


def test_scores_never_fall(spark, tables):
    df = pbp.build_pbp(*tables)
    from pyspark.sql import Window
    was = F.lag("home_score").over(Window.partitionBy("game_id").orderBy("play_number"))
    assert df.withColumn("was", was).where("home_score < was").count() == 0
