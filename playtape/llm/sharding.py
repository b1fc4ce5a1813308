"""Sharding by extendible hashing: a directory of hash prefixes whose oversized buckets split on one more bit.

A row's hash is 60 bits of the MD5 of its id and its text. The directory starts with one bucket; a bucket that holds
more bytes than a shard may is split by the next bit of the hash, the others are left alone, until all fit. The bytes
of a row are those of its text in UTF-8.

Rows that a hash cannot part (repeated rows) may fill a bucket at full depth beyond the limit. Such a bucket is cut
into pages: its rows have one size, so each page takes as many as fit, at least one. Only a text that is longer than the
limit by itself makes a shard over it.

Defined cases: null text has no bytes; a null id hashes as empty text; an empty table has no shards; rows of one id but
different texts hash apart; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtape.session import cut_lineage

DEPTH = 60
STEP = 4  # bits looked at in one pass over the open buckets
SPREAD = 64  # pieces in which repeated rows are numbered


def hash_bits(doc_id: Column, text: Column) -> Column:
    """Sixty bits as text of zeros and ones."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    digits = F.substring(F.md5(said.cast("binary")), 1, DEPTH // 4)
    return F.lpad(F.conv(digits, 16, 2), DEPTH, "0")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth, shard_bytes) of every bucket, from rows with ``bits`` and ``bytes``; no prefix heads another.

    Each pass sums the open buckets by ``STEP`` further bits and closes every bucket at the first depth at which it
    fits. Only open buckets are looked at again, so work falls off as they fit. A bucket has at most 2^(STEP + 1)
    cells in a pass, so the windows below stay small.
    """
    open_rows, found, at = cut_lineage(rows.groupBy("bits").agg(F.sum("bytes").alias("bytes"))), None, 0
    while True:
        deepest = min(at + STEP, DEPTH)
        cells = open_rows.groupBy(F.substring("bits", 1, at).alias("_head"), F.substring("bits", 1, deepest).alias("cell")).agg(
            F.sum("bytes").alias("bytes"))
        depth, held = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        for d in range(deepest, at - 1, -1):
            cells = cells.withColumn(f"_at{d}", F.sum("bytes").over(Window.partitionBy("_head", F.substring("cell", 1, d))))
            fits = (F.col(f"_at{d}") <= limit) | F.lit(d == DEPTH)
            depth = F.when(fits, F.lit(d)).otherwise(depth)
            held = F.when(fits, F.col(f"_at{d}")).otherwise(held)
        cells = cut_lineage(cells.select("cell", depth.alias("depth"), held.alias("shard_bytes")))
        closed = cells.where(F.col("depth").isNotNull()).select(
            F.expr("substring(cell, 1, depth)").alias("prefix"), "depth", "shard_bytes").distinct()
        found = closed if found is None else found.unionByName(closed)
        still = cells.where(F.col("depth").isNull()).select("cell")
        if still.isEmpty():
            return found
        open_rows = cut_lineage(open_rows.join(still, F.substring("bits", 1, deepest) == F.col("cell"), "left_semi"))
        at = deepest + 1


def assign(docs: DataFrame, limit: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, bytes, shard (hash prefix), page, depth and the shard's bytes for every row; ``carry`` rides along."""
    if limit < 1:
        raise ValueError("a shard must be allowed at least one byte")
    rows = docs.select(
        "doc_id", *carry, hash_bits(F.col("doc_id"), F.col("text")).alias("bits"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
    )
    buckets = cut_lineage(directory(rows.select("bits", "bytes"), limit))
    depths = [r.depth for r in buckets.select("depth").distinct().collect()]  # at most DEPTH + 1
    # A row has one bucket: the one whose prefix heads its bits.
    prefixes = F.explode(F.array(*[F.substring("bits", 1, d) for d in sorted(depths)] or [F.lit("")]))
    tried = rows.withColumn("_prefix", prefixes)
    placed = tried.join(buckets, F.col("_prefix") == F.col("prefix")).drop("_prefix", "bits")
    over = (F.col("shard_bytes") > limit) & (F.col("depth") == DEPTH)
    paged = pages(placed.where(over), limit)
    return placed.where(~over).withColumn("page", F.lit(0).cast("bigint")).unionByName(paged).select(
        "doc_id", *carry, "bytes", F.col("prefix").alias("shard"), "page", "depth", "shard_bytes")


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Number the equal rows of full-depth buckets and cut them into pages of at most ``limit`` bytes.

    Rows are numbered inside pieces of a bucket, and the pieces after each other, so no task sees a whole bucket.
    """
    each = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))), F.lit(1))
    dealt = cut_lineage(rows.withColumn("_piece", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")))
    sizes = dealt.groupBy("prefix", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy("prefix").orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("_skip", F.sum("_n").over(up_to) - F.col("_n")).drop("_n")
    order = F.row_number().over(Window.partitionBy("prefix", "_piece").orderBy("doc_id")) - 1
    numbered = dealt.withColumn("_at", order).join(sizes, ["prefix", "_piece"])
    page = F.floor((F.col("_skip") + F.col("_at")) / each).cast("bigint")
    shared = numbered.withColumn("page", page)
    total = shared.groupBy("prefix", "page").agg(F.sum("bytes").alias("_page_bytes"))
    return shared.join(total, ["prefix", "page"]).withColumn("shard_bytes", F.col("_page_bytes")).drop(
        "_piece", "_skip", "_at", "_page_bytes")


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """Write doc_id and text under ``path``, a folder per shard and page."""
    name = F.concat_ws("_", F.when(F.col("shard") == "", "all").otherwise(F.col("shard")), F.col("page").cast("string"))
    assign(docs, limit, ("text",)).select(name.alias("shard"), "doc_id", "text").repartition("shard").write.mode(
        "overwrite").partitionBy("shard").parquet(path)
