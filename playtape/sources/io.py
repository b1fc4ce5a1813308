"""Tables in and out: season tables, landed JSON, CSV, parameters, resume."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtape.operators.dedupe import upsert_latest
from playtape.operators.filters import require_columns
from playtape.sources import schemas

EMPTY_FILE = 1 << 20  # bytes; a file without rows is a schema and a footer


def scan_seasons(spark: SparkSession, root: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """A season-partitioned table; the season filter prunes partitions."""
    df = spark.read.parquet(root)
    return df if seasons is None else df.where(F.col("season").isin(*seasons))


def scan_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_season_table(df: DataFrame, root: str, sort: Sequence[str] = (), buckets: int | None = None) -> None:
    """Replace only the seasons present in ``df``. A season is spread over ``buckets`` files by game."""
    spread = [F.col("season")]
    if "game_id" in df.columns:
        width = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread.append(F.pmod(F.xxhash64("game_id"), F.lit(width)))
    out = df.repartition(*spread)
    if sort:
        out = out.sortWithinPartitions("season", *sort)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(root)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Landed line snapshots, one JSON document per file."""
    return spark.read.schema(schemas.SNAPSHOT).json(path, multiLine=True).withColumn(
        "source_file", F.col("_metadata.file_path")
    )


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Landed trades as raw rows; typing happens in the tape plan."""
    return spark.read.schema(schemas.RAW_TRADE).json(path)


def landed_losses(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """(file, documents, broken): how many landed JSON documents each file has, and how many of them don't parse."""
    corrupt = "_corrupt_record"
    shape = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    docs = spark.read.schema(shape).option("columnNameOfCorruptRecord", corrupt).json(path, multiLine=multi_line)
    # Spark parses only for a declared column: a count of one, never above the count of documents, asks for it.
    seen = docs.select(F.col("_metadata.file_path").alias("file"), F.col(corrupt).isNotNull().cast("long").alias("_broken"), F.col(schema.fields[0].name).alias("_first"))
    return seen.groupBy("file").agg(F.greatest(F.count(F.lit(1)), F.count("_first")).alias("documents"), F.sum("_broken").alias("broken"))


def read_required(spark: SparkSession, path: str, columns: Sequence[str], what: str = "table",
                  tolerate: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Parquet under a path, required columns asserted. A file that cannot be read fails the read.

    With ``tolerate`` the result is (rows, losses): what could be read, and ``file_losses`` of it, so that every lost row is
    in sight.
    """
    reader = spark.read.option("mergeSchema", "true")
    if not tolerate:
        return require_columns(reader.option("ignoreCorruptFiles", "false").parquet(path), columns, what)
    rows = require_columns(reader.option("ignoreCorruptFiles", "true").parquet(path), columns, what)
    return rows, file_losses(spark, path, rows)


def file_losses(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """(file, expected, given, lost) of every file that gave fewer rows than its footer counts.

    ``rows`` is a tolerant read of the path. A file whose footer can't be read has null ``expected`` and ``lost``. The footers'
    counts come from a scan without columns, which reads no data; the rows given are counted by a scan of all columns, as
    damage shows only where a column is read.
    """
    at = F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    named = F.regexp_replace("path", "^file:/+", "/").alias("file")
    listed = files.select(named)
    footers = rows.groupBy(at).agg(F.count(F.lit(1)).alias("expected"))
    # Maps have no hash; as JSON they are read all the same.
    read = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in rows.schema.fields]
    given = rows.groupBy(at).agg(F.count(F.lit(1)).alias("given"), F.bit_xor(F.xxhash64(*read)).alias("_read"))
    # A file without rows is small, and only such files are opened again to tell it from one without a footer.
    silent = files.where(F.col("length") <= EMPTY_FILE).select(named, "content").join(footers, "file", "left_anti")
    empty = silent.mapInArrow(_footers_of_none, "file string")
    counted = listed.join(empty, "file", "left_anti").join(footers, "file", "left").join(given.where(F.col("_read").isNotNull()), "file", "left")
    found = F.coalesce("given", F.lit(0).cast("long"))
    return counted.where(F.col("expected").isNull() | (found < F.col("expected"))).select(
        "file", "expected", found.alias("given"), (F.col("expected") - found).alias("lost"))


def _footers_of_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files whose footer says that they have no rows."""
    for batch in batches:
        keep = []
        for content in batch.column("content"):
            try:
                keep.append(pq.read_metadata(pa.BufferReader(content.as_buffer())).num_rows == 0)
            except (pa.ArrowException, OSError):
                keep.append(False)
        yield batch.select(["file"]).filter(pa.array(keep, pa.bool_()))


def rows_per_file(df: DataFrame) -> DataFrame:
    """How many rows each file gave."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def read_bets_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema(schemas.BETS).csv(path, header=True)
    return df.select(*columns) if columns else df


def write_bets_csv(bets: DataFrame, path: str) -> None:
    bets.write.mode("overwrite").csv(path, header=True)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """Parameters as rows (name, JSON value): they travel with the data and stay readable."""
    rows = [(k, json.dumps(v)) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str, required: Sequence[str] = ()) -> dict:
    rows = spark.read.schema("name string, value string").json(path).collect()
    params = {r.name: json.loads(r.value) for r in rows}
    missing = [n for n in required if n not in params]
    if missing:
        raise ValueError(f"parameters at {path} lack {missing}; rebuild them")
    return params


def unprocessed(source: DataFrame, sink: DataFrame, key: Sequence[str]) -> DataFrame:
    """Source rows whose key the sink does not hold yet."""
    return source.join(sink.select(*key).distinct(), list(key), "left_anti")


def incremental_append(source: DataFrame, sink_path: str, key: Sequence[str]) -> None:
    """Append only keys the sink lacks; the first run writes everything."""
    spark = source.sparkSession
    try:
        source = unprocessed(source, spark.read.parquet(sink_path), key)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    source.write.mode("append").parquet(sink_path)


def merge_into_season_table(fresh: DataFrame, root: str, key: Sequence[str]) -> DataFrame:
    """Existing seasons of the fresh rows with the fresh rows winning, ready to be written."""
    spark = fresh.sparkSession
    old = spark.read.parquet(root).join(fresh.select("season").distinct(), "season", "left_semi")
    return upsert_latest(old, fresh, key)

