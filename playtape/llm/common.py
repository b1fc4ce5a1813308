"""What the text operators share: row digests, folds by id, bounded training samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.session import ensure_checkpoint_dir

SPACE_WORDS = r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; null for a null id, which no fold learns from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int")


def held_out(doc_id: Column, parts: int, kept_back: int) -> Column:
    """Whether the row is in the fold that is never learned from; true for a null id."""
    return F.coalesce(fold(doc_id, parts) == kept_back, F.lit(True))


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256: one key for all rows that say the same; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def labelled_ids(labels: DataFrame, label: str, bound: int, parts: int = 0, kept_back: int = 0) -> DataFrame:
    """At most ``bound`` labelled ids as (doc_id, y), outside the held-out fold if there is one.

    Ids are taken in the order of their hash, so the choice does not depend on the layout of the files. An id that is
    labelled both ways is not learned from.
    """
    given = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    if parts:
        given = given.where(~held_out(F.col("doc_id"), parts, kept_back))
    agreed = given.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where(F.col("y") == F.col("_most"))
    return agreed.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, kept_back: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled texts outside the held-out fold, as (doc_id, y, text).

    Of several rows with one id the smallest text stands. Only the chosen ids, never more than ``bound``, are broadcast.
    """
    ids = labelled_ids(labels, label, bound, parts, kept_back)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table in the shared folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
