"""Streaming forms against their batch twins, drained with availableNow."""

import datetime
import json
import random

from pyspark.sql import functions as F

from playtape.plans.features import parse_events, possession_state
from playtape.plans.lineups import resolve_lineups, roster_sides
from playtape.streaming import live

T0 = datetime.datetime(2024, 1, 1, 20, 0, 0)


def _at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def _drain(df, name, mode="append", tmp=None):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def _files(df, path, order, parts=3):
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        df.sparkSession.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(path))


def test_landing_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text(json.dumps({"a": 1}))
    def go():
        live.land(live.landed_stream(spark, str(src), spark.createDataFrame([], "a int").schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert go() == [1]
    (src / "2.json").write_text(json.dumps({"a": 2}))
    assert go() == [1, 2]


def test_dedupe_and_minutes(spark, tmp_path):
    rows = [("x", _at(1), "g", 1.0), ("x", _at(2), "g", 1.0), ("y", _at(3), "g", 2.0), ("z", _at(70), "g", 3.0), ("w", _at(4000), "g", 1.0)]
    df = spark.createDataFrame(rows, "trade_id string, timestamp timestamp, game_id string, count_fp double")
    _files(df, tmp_path / "in", "timestamp")
    stream = live.landed_stream(spark, str(tmp_path / "in"), df.schema, "parquet", 1)
    got = _drain(live.dedupe_trades(stream), "deduped", tmp=tmp_path / "c1")
    assert sorted(r.trade_id for r in got.collect()) == ["w", "x", "y", "z"]
    minutes = _drain(live.trades_per_minute(stream), "minutes", tmp=tmp_path / "c2")
    assert {(r.minute, r.trades, r.contracts) for r in minutes.collect()} >= {(T0, 3, 4.0), (_at(60), 1, 3.0)}


def test_versions_keep_the_newest(spark, tmp_path):
    for i, v in enumerate(("old", "new")):
        spark.createDataFrame([("g", v), (f"g{i}", v)], "k string, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.landed_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "k string, v string").schema, "parquet")
        live.append_versions(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.k: r.v for r in live.latest_version(spark, str(tmp_path / "out"), ["k"]).collect()}
    assert got == {"g": "new", "g0": "old", "g1": "new"}


def test_live_fills_take_the_first_print(spark, tmp_path):
    states = spark.createDataFrame([("g", 1, _at(0)), ("g", 2, _at(100)), ("g", 9, _at(9000))], "game_id string, play_number int, state_time timestamp")
    prints = spark.createDataFrame([("g", _at(9), 1.0, 2.0), ("g", _at(12), 3.0, 4.0), ("g", _at(13), 5.0, 6.0), ("g", _at(120), 7.0, 8.0), ("g", _at(9000), 1.0, 1.0)],
                                   "game_id string, print_time timestamp, px_home double, px_away double")
    _files(states, tmp_path / "s", "state_time")
    _files(prints, tmp_path / "p", "print_time")
    out = live.live_fills(live.landed_stream(spark, str(tmp_path / "s"), states.schema, "parquet", 1), live.landed_stream(spark, str(tmp_path / "p"), prints.schema, "parquet", 1))
    got = _drain(out, "fills", tmp=tmp_path / "cp")
    assert [(r.play_number, r.px_home) for r in got.collect()] == [(1, 3.0)]
    assert [(r.play_number, r.px_home) for r in live.landed_fills(states, prints).collect()] == [(1, 3.0)]


def test_live_fills_of_a_feed_out_of_order_hold_no_pairs(spark, tmp_path):
    rng = random.Random(8)
    states = [(g, n, _at(rng.randrange(0, 4000))) for g in ("g", "h") for n in range(150)]
    prints = [(g, _at(rng.randrange(0, 4000)), float(rng.randrange(5)), rng.choice([None, 1.0])) for g in ("g", "h") for _ in range(60)]
    s = spark.createDataFrame(states, "game_id string, play_number int, state_time timestamp")
    p = spark.createDataFrame([*prints, ("beat", _at(9000), 0.0, 0.0)], "game_id string, print_time timestamp, px_home double, px_away double")
    for name, df, order in (("s", s, "play_number"), ("p", p, "px_home")):
        _files(df, tmp_path / name, order, 3)
    beat = spark.createDataFrame([("beat", _at(20_000), 0.0, 0.0)], p.schema)
    beat.coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    out = live.live_fills(live.landed_stream(spark, str(tmp_path / "s"), s.schema, "parquet", 1), live.landed_stream(spark, str(tmp_path / "p"), p.schema, "parquet", 1),
                          10, 40, "3 hours")
    got = sorted(map(str, map(tuple, _drain(out, "unordered", tmp=tmp_path / "cp").collect())))
    first = lambda g, at: min(((t, a, b) for h, t, a, b in prints if h == g and at + datetime.timedelta(seconds=10) <= t <= at + datetime.timedelta(seconds=50)),
                              key=lambda x: (x[0], x[1], x[2] is not None), default=None)
    want = sorted(str((g, n, at, *first(g, at))) for g, n, at in states if first(g, at))
    assert [x.replace("nan", "None") for x in got] == want
    landed = live.landed_fills(s, p, 10, 40).select("game_id", "play_number", "state_time", "print_time", "px_home", "px_away")
    assert sorted(map(str, map(tuple, landed.collect()))) == want


def _drained_puts(df, name, tmp):
    """The drained rows, and how many rows all triggers together wrote into the state store."""
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect(), sum(o.customMetrics["rocksdbPutCount"] for p in q.recentProgress for o in p.stateOperators)


def test_live_fills_call_the_state_by_the_batch_and_pass_over_rows_without_a_game(spark, tmp_path):
    states = [(g, n, _at(n * 7)) for g in ("g", "h") for n in range(400)] + [(None, 5, _at(100)), ("g", None, _at(100)), ("g", 6, None)]
    prints = [(g, _at(n * 11), float(n), None) for g in ("g", "h") for n in range(200)] + [(None, _at(112), 1.0, 1.0), ("beat", _at(20_000), 0.0, 0.0)]
    s = spark.createDataFrame(states, "game_id string, play_number int, state_time timestamp")
    p = spark.createDataFrame(prints, "game_id string, print_time timestamp, px_home double, px_away double")
    _files(s, tmp_path / "s", "play_number", 1)
    _files(p, tmp_path / "p", "print_time", 1)
    out = live.live_fills(live.landed_stream(spark, str(tmp_path / "s"), s.schema, "parquet"), live.landed_stream(spark, str(tmp_path / "p"), p.schema, "parquet"))
    got, puts = _drained_puts(out, "batched", tmp_path / "cp")
    first = lambda n: next((i for i in range(200) if n * 7 + 10 <= i * 11 <= n * 7 + 15), None)
    want = [(g, n, float(first(n))) for g in ("g", "h") for n in range(400) if first(n) is not None] + [("g", None, 10.0)]
    assert sorted(((r.game_id, r.play_number, r.px_home) for r in got), key=str) == sorted(want, key=str)
    assert puts < 200  # 1,200 rows


def test_live_possession_matches_batch(spark, tmp_path):
    def row(n, kind, text, team):
        return ("g", n, kind, text, team, 1, 2)
    rows = [row(1, "Jump Shot", "A makes jumper", 1), row(2, "Timeout", "timeout", None), row(3, "Jump Shot", "B misses jumper", 2),
            row(4, "Defensive Rebound", "C rebound", 1), row(5, "Bad Pass Turnover", "bad pass", 1), row(6, "Timeout", "", None)]
    df = spark.createDataFrame(rows, "game_id string, play_number bigint, type_text string, text string, actor_team_id bigint, home_team_id bigint, away_team_id bigint")
    _files(df, tmp_path / "in", "play_number")
    out = live.live_possession(live.landed_stream(spark, str(tmp_path / "in"), df.schema, "parquet", 1))
    got = _drain(out, "balls", tmp=tmp_path / "cp")
    want = possession_state(parse_events(df)).select("play_number", "possession", "poss_known")
    assert sorted(map(tuple, got.select("play_number", "possession", "poss_known").collect())) == sorted(map(tuple, want.collect()))


def _walked(spark, rows, roster):
    df = spark.createDataFrame(rows, "game_id string, period int, play_number bigint, type_text string, text string, team_id bigint, "
                               "athlete_id_1 bigint, athlete_id_2 bigint, athlete_id_3 bigint, at timestamp")
    people = spark.createDataFrame(roster, "game_id string, athlete_id bigint, team_id bigint, starter boolean")
    teams = df.select("game_id").distinct().selectExpr("game_id", "1L AS home_team_id", "2L AS away_team_id")
    return df, people, roster_sides(people, teams)


def test_live_lineups_equal_the_batch_walk_whatever_the_order(spark, tmp_path):
    rng = random.Random(6)
    rows, roster = [], []
    for g in ("g1", "g2"):
        people = list(range(1, 17))
        roster += [(g, p, 1 + p % 2, p <= 10) for p in people]
        n = 0
        for period in (1, 2, 3, 5):
            for _ in range(25):
                n += 1
                kind = rng.choice(["Substitution", "Personal Foul", "Jump Shot", "Jump Shot"])
                one, two = rng.sample(people, 2)
                two = rng.choice([two, None])
                text = rng.choice(["A enters the game for B", "enters the game for B", "makes", None])
                rows.append((g, period, n, kind, text, 1 + one % 2, rng.choice([one, one, None]), two, None, _at(period * 1000 + n * 5)))
    df, people, sides = _walked(spark, rows, roster)
    beat = ("beat", 1, 0, None, None, None, None, None, None, _at(90_000))
    shuffled = rng.sample(rows, len(rows))
    for i, part in enumerate((shuffled[:120], shuffled[120:], [beat])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    landed = live.landed_stream(spark, str(tmp_path / "in"), df.schema, "parquet", 1)
    got = _drain(live.live_lineups(landed, sides, "3 hours", "4 hours"), "lineups", tmp=tmp_path / "cp")
    want = resolve_lineups(df.withColumns({"home_team_id": F.lit(1), "away_team_id": F.lit(2)}), people)
    names = ["game_id", "period", "play_number", "home_lineup", "away_lineup", "lineup_ok", "player_fouls"]
    assert sorted(map(tuple, got.where("game_id <> 'beat'").select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    assert got.where("late = 1").count() == 0


def test_live_lineups_release_periods_and_mark_late_plays(spark, tmp_path):
    def play(period, n, at):
        return ("g", period, n, "Jump Shot", "makes", 1, 1, None, None, _at(at))

    df, _, sides = _walked(spark, [play(1, 1, 0)], [("g", p, 1 + p % 2, p <= 10) for p in range(1, 13)])
    triggers = [[play(1, 1, 0), play(1, 3, 20)], [play(1, 2, 10), play(2, 4, 2000)], [play(3, 6, 6000)], [play(3, 7, 6001)], [play(1, 9, 6002)]]
    for part in triggers:
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = _drain(live.live_lineups(live.landed_stream(spark, str(tmp_path / "in"), df.schema, "parquet", 1), sides, "60 seconds", "1 hour"), "released", tmp=tmp_path / "cp")
    rows = sorted((r.period, r.play_number, r.late) for r in got.collect())
    assert rows == [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 9, 1)]  # later periods are still open


def test_live_lineups_call_the_state_by_the_batch(spark, tmp_path):
    rows = [(g, period, 100 * period + n, "Jump Shot", "makes", 1, 1, None, None, _at(1000 * period + n)) for g in ("g", "h") for period in (1, 2, 3) for n in range(90)]
    df, _, sides = _walked(spark, rows, [(g, p, 1 + p % 2, p <= 10) for g in ("g", "h") for p in range(1, 13)])
    _files(df, tmp_path / "in", "play_number", 1)
    spark.createDataFrame([("beat", 1, 0, *[None] * 6, _at(90_000))], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    landed = live.landed_stream(spark, str(tmp_path / "in"), df.schema, "parquet", 1)
    got, puts = _drained_puts(live.live_lineups(landed, sides, "3 hours", "4 hours"), "walked", tmp_path / "cp")
    assert sorted((r.game_id, r.period, r.play_number) for r in got if r.game_id != "beat") == sorted(r[:3] for r in rows)
    assert puts < 100  # 541 rows
