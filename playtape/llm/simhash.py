"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verify the Hamming distance, connect.

A fingerprint of 64 bits is cut into five blocks. Two fingerprints that differ in at most two bits agree on at least
three blocks, so they meet in one of the ten choices of three blocks (38 or 39 bits). Fingerprints are reduced to
distinct ones first: thousands of copies are one fingerprint.

A block shared by at most ``crowd`` distinct fingerprints is joined with itself and its pairs are verified. Families of
near copies can crowd a block with so many fingerprints that its pairs would grow with the square of the family. Every
fingerprint of a crowded block instead emits itself and its 64 neighbours at one bit: two fingerprints differ in at
most two bits exactly if they emit a common value, so it is enough to tie every emitter of a value to the least one.
That is as exact as pairs, and linear. A pair of which only one side is in a crowded block shares no crowded block, so
the join of the others finds it.

Links are connected in rounds that tie larger and then smaller neighbours to the least one, until only stars are left. Every
round is written to the shared checkpoint folder and told from the one before by its count and sum of hashes.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; repeated rows each give a row; a component without any non-null doc_id has a null id; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from playtape.llm.common import SPACE_WORDS, free_name, stored
from playtape.session import cut_lineage

WORDS = re.compile(SPACE_WORDS.encode())
SHINGLE = 3
FAR = 2
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, bits
CROWD = 64
_CHUNK = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """Of a text in UTF-8: bit b is one if it is set in over half of the shingles' hashes.

    On bytes, lower() turns A-Z alone, and white space never cuts a code point.
    """
    import xxhash

    words = WORDS.findall(text.lower()) if text else []
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if n > 1 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):  # a long text is counted in pieces
        bits = np.unpackbits(hashes[at:at + _CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, print): the fingerprint as a signed long, and a digest of the row's id and text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(prints.astype(np.int64))], names=["doc_id", "key", "print"])

    rows = docs.select("doc_id", row_key(docs).alias("key"), "text")
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, print long")


def row_key(docs: DataFrame) -> Column:
    """128 bits that stand for a row's id and text."""
    said = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(docs["text"], F.lit("")))
    return F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32))


def block_keys(value: Column) -> Column:
    """Ten keys of a fingerprint: its bits on each choice of three blocks, and which choice that is."""
    masks = []
    for chosen in combinations(BLOCKS, len(BLOCKS) - FAR):
        mask = sum(((1 << bits) - 1) << first for first, bits in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), value.bitwiseAND(F.lit(m)).alias("bits"))
                               for i, m in enumerate(masks)]))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b), a below b: enough links between distinct fingerprints to connect all that differ in at most two bits.

    ``prints`` has one column ``print`` of distinct values.
    """
    keyed = prints.select("print", block_keys(F.col("print")).alias("key")).select("print", "key.choice", "key.bits")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = cut_lineage(keyed.join(sizes.hint("merge"), ["choice", "bits"]))
    quiet = shared.where(F.col("n") <= crowd).select("choice", "bits", "print")
    other = quiet.withColumnRenamed("print", "b")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = quiet.withColumnRenamed("print", "a").join(other, ["choice", "bits"]).where(
        (F.col("a") < F.col("b")) & (differ <= FAR)).select("a", "b")
    crowded = shared.where(F.col("n") > crowd).select("print").distinct()
    ones = [1 << b for b in range(63)] + [-(1 << 63)]
    spots = F.explode(F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(one)) for one in ones]))
    spread = crowded.select("print", spots.alias("spot"))
    least = spread.groupBy("spot").agg(F.min("print").alias("a"), F.collect_set("print").alias("all"))
    # At most 65 fingerprints can emit one value: itself and its neighbours at one bit.
    tied = least.select("a", F.explode("all").alias("b")).where(F.col("a") < F.col("b"))
    return near.unionByName(tied).distinct()


def connect(edges: DataFrame) -> DataFrame:
    """(print, root) for every fingerprint that occurs in ``edges``; the root is the least of its component.

    In a round, every larger neighbour of a node is tied to the node's least neighbour instead, and then every smaller
    neighbour of a node, and the node, to the least of these. Stars around their least node are what does not change.
    """
    def round_of(ties: DataFrame) -> DataFrame:
        both = ties.select(F.col("a").alias("u"), F.col("b").alias("v")).union(ties.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("a"), F.least("u", "least").alias("least"))
        larger = ties.join(least.hint("merge"), "a").select(F.col("least").alias("a"), "b").distinct()
        first = larger.groupBy("b").agg(F.min("a").alias("least"))
        smaller = larger.join(first.hint("merge"), "b")
        return smaller.where(F.col("a") != F.col("least")).select(F.col("least").alias("a"), F.col("a").alias("b")).union(
            first.select("least", "b")).distinct()

    def kept(ties: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        out = stored(ties.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")), "ties")
        return out, (seen.get["n"], seen.get["mark"])

    ties, mark = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    while mark[0]:
        again, now = kept(round_of(ties))
        if now == mark:
            break
        ties, mark = again, now
    stars = ties.select(F.col("b").alias("print"), F.col("a").alias("root"))
    return stars.union(ties.select("a", "a").distinct())


def classes(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(print, n, root, first, component_id) of distinct fingerprints.

    ``first`` is the fingerprint's first row by id (null last) and key, ``root`` names the component.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    each = cut_lineage(prints.groupBy("print").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    rooted = each.join(connect(links(each.select("print"), crowd)).hint("merge"), "print", "left").withColumn(
        "root", F.coalesce("root", "print"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("_first"))
    return rooted.join(ids.hint("merge"), "root").select("print", "n", "root", "first", F.col("_first.doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, and the least doc_id that links reach, for every row."""
    prints = cut_lineage(fingerprints(docs))
    found = classes(prints, crowd).select("print", "component_id")
    return prints.join(found.hint("merge"), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The documents, all columns, thinned to one row for each component: that of its least doc_id."""
    found = classes(cut_lineage(fingerprints(docs)), crowd)
    return rows_chosen(docs, found.groupBy("root").agg(F.min("first").alias("first")))


def rows_chosen(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The documents, all columns, whose key is that of a row of ``firsts``.

    Of rows with one id and one text a single one stays: the first by the SHA-256 of its other columns.
    """
    key, number = free_name(docs, "_row_key"), free_name(docs, "_row_number")
    others = [docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.sha2(F.to_json(F.struct(*others)).cast("binary"), 256) if others else F.lit(0)
    keyed = docs.withColumn(key, row_key(docs))
    # The limit is applied before the shuffle as well.
    kept = keyed.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(rest))).where(F.col(number) == 1)
    return kept.join(firsts.select(F.col("first.key").alias(key)), key, "left_semi").select(*[f"`{c}`" for c in docs.columns])
