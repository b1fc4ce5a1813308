"""The play view: dealt by rows, whatever the bytes that they compress to."""

from pyspark.sql import functions as F

from playtape.workloads import base


def test_plays_of_a_larger_table_are_dealt_over_more_tasks(spark, tmp_path, monkeypatch):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).cast("timestamp_ntz")
    spark.range(2000).select(
        F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 150).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        F.format_string('{"k": %d}', F.col("id") % 50).alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    few = base.plays(spark, str(tmp_path))
    monkeypatch.setattr(base, "PLAYS_PER_TASK", 100)
    many = base.plays(spark, str(tmp_path))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 20
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and many.count() == 2000


def test_rate_build_tags_the_plays_once(spark, monkeypatch):
    from playtape.workloads import boxes

    calls, tagged = [], boxes._tagged
    monkeypatch.setattr(boxes, "_tagged", lambda *given: calls.append(given) or tagged(*given))
    assert base.REGISTRY["rate_build"].run(spark, "/root/testdata/sf0.001").columns and len(calls) == 1


def test_plays_are_dealt_as_parsed_rows(spark, tmp_path):
    import datetime as dt

    from playtape.workloads import base

    rows = [(i, dt.datetime(2024, 1, 1 + i % 28, i % 24), i % 5, ("click", "purchase", "error", "view", "signup")[i % 5], 1.0, f'{{"k": {i % 50}}}') for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    df = base.plays(spark, str(tmp_path))
    # each reader of the table takes a play's number out of its text once, not once a column
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 2
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    want = spark.sql(base.PLAY_ROWS.replace("{events}", "{source}"), source=base.table(spark, str(tmp_path), "events"))
    shared = want.columns
    assert sorted(map(str, df.select(shared).collect())) == sorted(map(str, want.collect()))
