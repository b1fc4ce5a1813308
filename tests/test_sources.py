import json

import pytest
from pyspark.sql import functions as F

from playtape.functions import sql
from playtape.functions.text import parse_ticker
from playtape.operators import filters
from playtape.plans import lines, tape
from playtape.sources import io, schemas


def _quote(name, price=None, point=None):
    return {"name": name, "price": price, "point": point}


SNAPSHOT = {
    "timestamp": "2024-01-01T23:50:00Z", "previous_timestamp": "2024-01-01T23:45:02Z", "next_timestamp": None,
    "data": [
        {"id": "e1", "home_team": "Boston Celtics", "away_team": "Denver Nuggets", "commence_time": "2024-01-02T00:00:00Z", "bookmakers": [
            {"key": "slow", "markets": [{"key": "spreads", "outcomes": [_quote("Denver Nuggets", -105, 4.5)]}]},
            {"key": "pinnacle", "markets": [
                {"key": "h2h", "outcomes": [_quote("Boston Celtics", -150), _quote("Denver Nuggets", 130)]},
                {"key": "totals", "outcomes": [_quote("Under", -110, 221.5)]}]}]},
        {"id": "e2", "home_team": "Nowhere FC", "away_team": "Denver Nuggets", "commence_time": "2024-01-02T00:00:00Z", "bookmakers": []},
    ],
}


@pytest.fixture()
def snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(SNAPSHOT, indent=1))
    return io.read_snapshots(spark, str(tmp_path))


@pytest.fixture()
def games(spark):
    rows = [("7", 2024, "2024-01-01", "2024-01-02T00:00Z", "BOS", "DEN", None, None), ("8", 2024, "2024-01-01", "2024-01-01T19:00-05:00", "LAL", "NY", None, None),
            ("9", 2024, "2024-01-01", "2024-01-02T00:00Z", "EAST", "WEST", None, None)]
    df = spark.createDataFrame(rows, "game_id string, season int, game_date string, game_date_time string, home_abbreviation string, away_abbreviation string, h double, a double")
    return lines.load_schedule(df.withColumn("game_date", F.to_date("game_date")))


def test_three_markets_close(spark, snapshots, games):
    assert games.count() == 2
    ml = lines.closing_moneyline(games, lines.moneyline_quotes(snapshots))
    row = ml.first()
    assert ml.count() == 1 and row.espn_game_id == "7" and row.snapshot_lag_seconds == 600.0
    assert abs(row.p_home_close - 0.6 / (0.6 + 100 / 230)) < 1e-12
    sp, to = lines.closing_spread(ml, snapshots).first(), lines.closing_total(ml, snapshots).first()
    assert (sp.home_spread_close, sp.away_spread_close, sp.book, sp.home_spread_price) == (-4.5, 4.5, "slow", None)
    assert (to.total_close, to.over_price, to.under_price) == (221.5, None, -110.0)
    audit = {r.metric: r.value for r in lines.moneyline_audit(games, lines.moneyline_quotes(snapshots)).collect()}
    assert audit == {"no_snapshot_before_tip": 1, "too_stale": 0}
    assert [r.name for r in lines.unmapped_names(snapshots).collect()] == ["Nowhere FC"]
    grid = lines.snapshot_grid(snapshots).first()
    assert (grid.step, grid.phase) == (300, 0)


def test_season_table_replaces_only_its_seasons(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 2023, 1), ("b", 2024, 2)], "game_id string, season int, v int")
    io.write_season_table(df, root, ["game_id"])
    io.write_season_table(spark.createDataFrame([("c", 2024, 3)], "game_id string, season int, v int"), root)
    assert sorted(r.game_id for r in io.scan_seasons(spark, root).collect()) == ["a", "c"]
    pruned = io.scan_seasons(spark, root, [2023])
    assert "PartitionFilters: [isnotnull(season" in pruned._jdf.queryExecution().executedPlan().toString() or pruned.count() == 1


def test_resume_and_upsert(spark, tmp_path):
    sink = str(tmp_path / "sink")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    io.incremental_append(first, sink, ["k"])
    io.incremental_append(spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), sink, ["k"])
    assert {r.k: r.v for r in spark.read.parquet(sink).collect()} == {"a": 1, "b": 1, "c": 2}


def test_params_csv_and_required_columns(spark, tmp_path):
    io.write_params(spark, {"decay": 0.8, "names": ["a"]}, str(tmp_path / "p"))
    assert io.read_params(spark, str(tmp_path / "p"), ["decay"]) == {"decay": 0.8, "names": ["a"]}
    with pytest.raises(ValueError):
        io.read_params(spark, str(tmp_path / "p"), ["missing"])
    bets = spark.createDataFrame([("g", 50.0, 0.6, "home")], "game_id string, price double, p_win double, side string")
    io.write_bets_csv(filters.conform(bets, schemas.BETS), str(tmp_path / "csv"))
    assert io.read_bets_csv(spark, str(tmp_path / "csv"), ["game_id", "p_win"]).first() == ("g", 0.6)
    spark.range(3).write.parquet(str(tmp_path / "q"))
    (tmp_path / "q" / "broken.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="broken"):
        io.read_required(spark, str(tmp_path / "q"), ["id"]).count()
    rows, losses = io.read_required(spark, str(tmp_path / "q"), ["id"], tolerate=True)
    found = losses.collect()
    assert len(found) == 1, found
    (lost,) = found
    assert rows.count() == 3 and lost.file.endswith("broken.parquet") and (lost.expected, lost.given, lost.lost) == (None, 0, None)
    with pytest.raises(ValueError):
        io.read_required(spark, str(tmp_path / "q"), ["other"], tolerate=True)


def test_rows_lost_inside_a_file_are_counted(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "t"
    folder.mkdir()
    good = pa.table({"id": np.arange(1000), "v": np.random.default_rng(0).normal(size=1000)})
    pq.write_table(good, folder / "good.parquet")
    large = pa.table({"id": np.arange(200_000), "v": np.random.default_rng(1).normal(size=200_000)})
    pq.write_table(large, folder / "half.parquet", row_group_size=20_000, compression="snappy")
    data = bytearray((folder / "half.parquet").read_bytes())
    group = pq.ParquetFile(folder / "half.parquet").metadata.row_group(7).column(1)
    for i in range(group.data_page_offset, group.data_page_offset + group.total_compressed_size - 100):
        data[i] ^= 0x5A
    (folder / "half.parquet").write_bytes(bytes(data))
    with pytest.raises(Exception):
        io.read_required(spark, str(folder), ["id"]).agg(F.sum("v")).collect()
    rows, losses = io.read_required(spark, str(folder), ["id"], tolerate=True)
    found = losses.collect()
    assert len(found) == 1, found
    (lost,) = found
    assert lost.file.endswith("half.parquet") and lost.expected == 200_000 and 0 < lost.lost <= 200_000 and lost.given + lost.lost == lost.expected
    assert rows.select("id", "v").where("v IS NOT NULL").count() == 1000 + lost.given


def test_landed_documents_that_do_not_parse_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    (tmp_path / "b.json").write_text('{"a": 4}\n')
    shape = spark.createDataFrame([], "a int").schema
    got = {r.file.rsplit("/", 1)[1]: (r.documents, r.broken) for r in io.landed_losses(spark, str(tmp_path), shape).collect()}
    assert got == {"a.json": (3, 1), "b.json": (1, 0)}


def test_ticker_corner_cases(spark):
    cases = {"S-26JUN13NYKSAS-SAS": ("NYK", "SAS", 1), "S-26JUN13NYSA-NY": ("NYK", "SAS", 0), "S-26FEB30NYKSAS-SAS": None, "S-26JUN13NYKSAS-LAL": None, "junk": None, "": None}
    df = spark.createDataFrame([(t,) for t in cases], "ticker string")
    got = {r.ticker: (r.away_team, r.home_team, r.is_home_yes) if r.game_date else None for r in parse_ticker(df, "ticker").collect()}
    assert got == cases


def test_trades_are_typed_and_counted(spark, tmp_path):
    rows = [
        {"ticker": "S-26JUN13NYKSAS-SAS", "trade_id": "1", "created_time": "2026-06-13T23:50:01.25Z", "yes_price_dollars": "0.6500", "no_price_dollars": "0.3500", "count_fp": "45.05"},
        {"ticker": "S-26JUN13NYKSAS-NYK", "trade_id": "1", "created_time": "2026-06-13T23:50:02Z", "yes_price": 40, "count_fp": "x"},
        {"ticker": "S-26JUN13NYKSAS-NYK", "trade_id": "2", "created_time": "soon", "yes_price": 40},
        {"ticker": "S-26JUN13NYKSAS-NYK", "trade_id": "3", "created_time": "", "yes_price": 40},
        {"ticker": "junk", "trade_id": "4", "created_time": "2026-06-13T23:50:02Z"},
    ]
    (tmp_path / "t.json").write_text("\n".join(json.dumps(r) for r in rows))
    typed = tape.typed_trades(io.read_trades(spark, str(tmp_path)))
    usable = tape.usable_trades(typed).orderBy("timestamp_unix").collect()
    assert [(r.yes_price_cents, r.home_yes_price_cents, r.count_fp) for r in usable] == [(65.0, 65.0, 45.05), (40.0, 60.0, None)]
    report = {r.metric: r.value for r in tape.trade_report(typed).collect()}
    assert report == {"no_timestamp": 1, "no_price": 1, "bad_timestamp": 1, "no_count": 1, "unparsed_ticker": 1}
    assert tape.assemble(tape.usable_trades(typed)).count() == 1
    assert tape.leg_check(tape.usable_trades(typed)).first() == (1, 1)


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT clock_seconds('11:34') c, clock_seconds('x') n, american_probability(-150D) p, floor_to_grid(1000, 300, 100) g, taker_fee(10D, 0.4D) f").first()
    assert (row.c, row.n, row.p, row.g, row.f) == (694.0, None, 0.6, 1000, 0.17)
