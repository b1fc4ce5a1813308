"""Benchmark decontamination by winnowing.

Texts are reduced to words (ASCII letters and digits in lower case, and everything outside ASCII). Of the hashes of
every ``K`` consecutive words, winnowing keeps the least in each run of ``W`` neighbours, the rightmost on a tie. Two
texts that share ``K + W - 1 = SPAN`` consecutive words therefore keep a common fingerprint inside that span. An item
of fewer than ``SPAN`` words is one window of its own length, and gets a fingerprint of that same length: documents are
fingerprinted again at each such length that occurs in the benchmark, at most ``SPAN - 1`` of them.

Document fingerprints that pass a Bloom filter of the benchmark's (a broadcast of fixed size; what passes wrongly only costs
work) are joined with the benchmark's fingerprints. A hit is extended to the windows of ``SPAN`` words around it, and
these are joined with the benchmark's windows as texts, so a match is exact. Both joins meet distinct keys on the
benchmark side: no pairs of occurrences are formed, whatever passage many documents share. Equal texts are looked
at once.

Defined cases: a null text has no words; null item ids are reported as the text ``null``; an item without words has no
window; items with equal windows are all reported; repeated rows each give their own row; an empty benchmark
contaminates nothing; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.llm.common import free_name, text_key
from playtape.session import cut_lineage

SPAN = 10
K = 7
W = SPAN - K + 1
BLOOM_BITS = 1 << 25  # four megabytes, sent to every executor
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8. On bytes, lower() turns A-Z alone, and no word is cut inside a code point."""
    return WORDS.findall(text.lower()) if text else []


def gram_hashes(words: list[bytes], k: int, seen: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive words; ``seen`` remembers the hashes of words."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    single = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ single[j:j + n]) * _ODD
            out ^= out >> np.uint64(29)
    return out


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash in each run of ``w`` neighbours, the rightmost on a tie; the least of all in a shorter list."""
    n = len(hashes)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.empty(0, np.int64)
    runs = [hashes[j:n - w + 1 + j] for j in range(w)]
    least = np.minimum.reduce(runs)
    at = np.arange(n - w + 1)
    for j, run in enumerate(runs):
        at[run == least] = np.flatnonzero(run == least) + j
    return at[np.concatenate([[True], at[1:] > at[:-1]])]  # the places rise with the runs


def _places(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    first, second = hashes & np.uint64(BLOOM_BITS - 1), (hashes >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)
    one = lambda at: (bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return (one(first) & one(second)).astype(bool)


def _bloom(parts: list[np.ndarray]) -> np.ndarray:
    return np.bitwise_or.reduce([np.zeros(BLOOM_BITS // 8, np.uint8), *parts])


ITEM_ROWS = "item string, length int, print long, window string"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, length, print, window): every fingerprint and every window of the benchmark, side by side.

    A row has either a fingerprint or a window.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                size = min(len(words), SPAN)
                k = K if size == SPAN else size
                hashes = gram_hashes(words, k, seen)
                prints = hashes[winnow(hashes, W if size == SPAN else 1)].astype(np.int64)
                out += [(item, size, int(p), None) for p in prints]
                out += [(item, size, None, b" ".join(words[i:i + size]).decode()) for i in range(len(words) - size + 1)]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)],
                names=["item", "length", "print", "window"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").mapInArrow(cut, ITEM_ROWS)


def bloom_of(prints: DataFrame) -> np.ndarray:
    """The benchmark's fingerprints as a Bloom filter of fixed size: every task fills one, and they are or-ed in Spark."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for at in (hashes & np.uint64(BLOOM_BITS - 1), (hashes >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)):
                np.bitwise_or.at(bits, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        words = bits.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], names=["at", "bits"])

    filled = prints.select("print").mapInArrow(fill, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    rows = filled.toArrow()  # at most BLOOM_BITS / 64 rows
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


DOC_ROWS = ("n_words long, hits array<struct<print: bigint, length: int, starts: array<int>, windows: array<string>>>")


def marked(docs: DataFrame, bloom: np.ndarray, lengths: list[int]) -> DataFrame:
    """(doc_id, key, n_words, hits): fingerprints that may be the benchmark's, each with the windows around it."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)
    hit = pa.struct([("print", pa.int64()), ("length", pa.int32()), ("starts", pa.list_(pa.int32())), ("windows", pa.list_(pa.string()))])

    def hits_of(words: list[bytes], seen: dict[bytes, int], bits: np.ndarray) -> list[dict]:
        found = []
        for size in lengths:
            k, w = (K, W) if size == SPAN else (size, 1)
            if len(words) < size:
                continue
            hashes = gram_hashes(words, k, seen)
            at = winnow(hashes, w)
            at = at[_places(bits, hashes[at])]
            for p in at.tolist():
                first, last = max(0, p - (size - k)), min(p, len(words) - size)
                starts = list(range(first, last + 1))
                found.append({"print": int(hashes[p].astype(np.int64)), "length": size, "starts": starts,
                              "windows": [b" ".join(words[i:i + size]).decode() for i in starts]})
        return found

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = WordHashes(), sent.value
        for batch in batches:
            counts, hits = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                hits.append(hits_of(words, seen, bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(hit))],
                names=["doc_id", "key", "n_words", "hits"])

    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(mark, f"doc_id {kind}, key binary, {DOC_ROWS}")


def covered(windows: Column) -> Column:
    """How many words lie in a sorted array of (start, length) windows."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    def add(a: Column, w: Column) -> Column:
        end = w["start"] + w["length"]
        return F.struct((a["n"] + F.greatest(end - F.greatest(w["start"], a["end"]), F.lit(0))).cast("bigint").alias("n"),
                        F.greatest(end, a["end"]).alias("end"))
    return F.aggregate(windows, start, add, lambda a: a["n"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents as (doc_id, key, n_words, marked), and per key with a leak (key, n_hit, items)."""
    listed = cut_lineage(item_windows(benchmark))
    prints = listed.where(F.col("print").isNotNull()).select("length", "print").distinct()
    lengths = sorted(r.length for r in prints.select("length").distinct().collect())  # at most SPAN
    rows = cut_lineage(marked(docs, bloom_of(prints), lengths))
    hits = rows.where(F.size("hits") > 0).select("key", F.explode("hits").alias("hit"))
    hits = hits.select("key", "hit.*").dropDuplicates(["key", "length", "print", "starts"])
    extended = (
        hits.join(prints, ["length", "print"], "left_semi")
        .select("key", "length", F.explode(F.arrays_zip("starts", "windows")).alias("at"))
        .select("key", "length", F.col("at.starts").alias("start"), F.col("at.windows").alias("window"))
        .distinct()
    )
    windows = listed.where(F.col("window").isNotNull()).groupBy("window").agg(F.collect_set("item").alias("in_items"))
    matched = cut_lineage(extended.join(windows, "window").select("key", "start", "length", "in_items"))
    spans = matched.groupBy("key").agg(covered(F.array_sort(F.collect_set(F.struct("start", "length")))).alias("n_hit"))
    items = matched.select("key", F.explode("in_items").alias("item")).groupBy("key").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    return rows, spans.join(items, "key")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words inside a benchmark window, the items found, and whether any was."""
    rows, found = leaks(docs, benchmark)
    hit, none = F.size("hits") > 0, F.array().cast("array<string>")
    narrow = rows.where(hit).select("doc_id", "key", "n_words").join(found, "key", "left")
    clean = rows.where(~hit).select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), none.alias("items"))
    both = narrow.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                         F.coalesce("items", none).alias("items")).unionByName(clean)
    return both.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no benchmark window."""
    _, found = leaks(docs, benchmark)
    name = free_name(docs, "_leak_key")
    keyed = docs.withColumn(name, text_key(F.col("text")))
    return keyed.join(found.select(F.col("key").alias(name)), name, "left_anti").select(*[f"`{c}`" for c in docs.columns])
