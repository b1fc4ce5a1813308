"""Substring dedup by relative Lempel-Ziv parsing: repeated passages of ``SPAN`` words or more leave all but their first document.

A window is ``SPAN`` consecutive words of one document. A word goes if a window over it also starts in a document with a
smaller doc_id. No index of all windows is made; documents are parsed against reference blocks:

1. Every window is named by its anchor, the least hash among its ``K``-word grams (about one in five words is an anchor).
   Equal windows have equal anchors. The first holder of an anchor is the least doc_id that has it: an aggregate of
   narrow rows, combined before the shuffle. Anchors of one document only are dropped.
2. A document's runs of windows whose anchors it holds first are its reference block. Its runs whose anchors another
   document holds first are pieces, and each goes to that document's block alone. Blocks with many pieces are copied
   to salts, by the words of their pieces.
3. A piece is parsed greedily against the sorted suffixes of its block. Each factor is the longest match there; factors of
   ``SPAN`` words or more are duplicate spans. Windows over a factor's end, which a greedy parse can miss, are looked
   up in the block.
4. A window that is not in its block is in no first holder: other documents may share it. These few are met by the hash of
   their words, again by an aggregate of the least doc_id.

A window with anchor ``a`` can start in no document below a's first holder F, so a window found in F is a repeat in every
later document, and one not found there is left in all its documents alike. So the result is exact (word hashes of 64
bits, compared word by word; windows of step 4 by 128 bits).

Equal texts are one document with the least of their ids; every later copy loses all its words if it has a window.

Defined cases: a null text has no words; a null doc_id comes after all others, and null ids never take words from each
other; several texts under one doc_id are parts of one document; repeated rows each give their row; a text under ``SPAN``
words keeps all; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.llm.common import SPACE_WORDS, stored, text_key
from playtape.llm.decontam import WordHashes

SPAN = 13
K = 5
BLOCK_WORDS = 1 << 13  # words of pieces that one copy of a block is asked for
WORDS = re.compile(SPACE_WORDS.encode())
_SUFFIX = 32 * 8  # bytes by which suffixes are put in order
_WINDOW = SPAN * 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of every window of a sequence of word hashes: the least of its gram hashes."""
    n = len(hashes) - K + 1
    if len(hashes) < SPAN:
        return np.empty(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for j in range(K):
        grams = (grams ^ hashes[j:j + n]) * _ODD
        grams ^= grams >> np.uint64(29)
    windows = len(hashes) - SPAN + 1
    width, least = 1, grams
    while width * 2 <= SPAN - K + 1:  # minima over twice the width, again and again
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - K + 1 - width
    return np.minimum(least[:windows], least[rest:rest + windows]).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, row, text): the text's digest, and 64 bits that name the id with the text."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return keyed.select("doc_id", "key", row_name("doc_id").alias("row"), "text")


def row_name(doc_id: str) -> Column:
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, "key")


def anchored(docs: DataFrame) -> DataFrame:
    """(doc_id, key, row, n_words, whole, anchors): the distinct anchors, and the digest of all words joined by a space."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            counts, whole, anchors = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = WORDS.findall(text) if text else []
                counts.append(len(words))
                whole.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(np.unique(window_anchors(word_hashes(words, seen))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key", "row")), pa.array(counts, pa.int64()), pa.array(whole), pa.array(anchors, pa.list_(pa.int64()))],
                names=["doc_id", "key", "row", "n_words", "whole", "anchors"])

    rows = _rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, key binary, row long, n_words long, whole string, anchors array<long>")


def _first_holders(held: DataFrame, by: str) -> DataFrame:
    """(by, first): the least doc_id, where more than one document holds it."""
    least = held.groupBy(by).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"), F.max(F.col("doc_id").isNull()).alias("_null"))
    return least.where((F.col("first") != F.col("_last")) | (F.col("_null") & F.col("first").isNotNull())).select(by, "first")


def runs(same: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each unbroken run of equal values."""
    ends = np.flatnonzero(same[1:] != same[:-1]) + 1
    return list(zip([0, *ends.tolist()], [*ends.tolist(), len(same)], strict=True)) if len(same) else []


def pieces(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """(of, doc_id, row, start, words): pieces for the block of document ``of``; the row is null in a part of that block.

    ``holders`` has (row, held), held an array of (anchor, first).
    """
    rows = _rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            texts, own, names = batch.column("text").cast(pa.binary()), batch.column("doc_id"), batch.column("row").to_pylist()
            for i, name in enumerate(names):
                text, held = texts[i].as_py(), batch.column("held")[i].values
                words = word_hashes(WORDS.findall(text or b""), seen)
                anchors = held.field("anchor").to_numpy()
                firsts, codes = np.unique(held.field("first").to_numpy(zero_copy_only=False), return_inverse=True)
                order = np.argsort(anchors)
                asked = window_anchors(words)
                at = order[np.minimum(np.searchsorted(anchors, asked, sorter=order), len(order) - 1)]
                block = np.where(anchors[at] == asked, codes[at], -1)
                me = own[i].as_py()
                for begin, end in runs(block):
                    if block[begin] >= 0:
                        of = firsts[block[begin]].item() if isinstance(firsts[block[begin]], np.generic) else firsts[block[begin]]
                        out.append((of, me, None if of == me else name, begin, words[begin:end + SPAN - 1].view(np.int64)))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            types = (own.type, own.type, pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["of", "doc_id", "row", "start", "words"])

    found = rows.select("doc_id", "row", "text").join(holders, "row").select("doc_id", "row", "text", "held")
    return found.mapInArrow(cut, f"of {kind}, doc_id {kind}, row long, start int, words array<long>")


class Block:
    """The words that a document holds first: its suffixes in order, and its windows."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        gaps = [np.array([hash(("gap", i)) & (1 << 63) - 1], np.int64) for i in range(len(parts))]
        self.words = np.concatenate([x for pair in zip(parts, gaps, strict=True) for x in pair]) if parts else np.empty(0, np.int64)
        self.data = self.words.tobytes()
        self.windows = {part[i:i + _WINDOW] for part in map(np.ndarray.tobytes, parts) for i in range(0, len(part) - _WINDOW + 8, 8)}
        self._order: list[int] | None = None

    def _suffix(self, at: int) -> bytes:
        return self.data[8 * at:8 * at + _SUFFIX]

    def longest(self, piece: np.ndarray, data: bytes, at: int) -> int:
        """Words of the longest match of ``piece[at:]`` in the block: next to its place among the suffixes."""
        if self._order is None:
            self._order = sorted(range(len(self.words)), key=self._suffix)
        order = self._order
        place = bisect_left(order, data[8 * at:8 * at + _SUFFIX], key=self._suffix)
        return max(self._common(piece, at, order[p]) for p in (place - 1, place) if 0 <= p < len(order))

    def _common(self, piece: np.ndarray, at: int, there: int) -> int:
        length, step, most = 0, 64, min(len(piece) - at, len(self.words) - there)
        while length < most:
            differ = piece[at + length:at + min(length + step, most)] != self.words[there + length:there + min(length + step, most)]
            if differ.any():
                return length + int(differ.argmax())
            length, step = length + len(differ), step * 2
        return most


def parsed(piece: np.ndarray, block: Block) -> tuple[list[tuple[int, int]], list[int]]:
    """Duplicate spans (begin, end) of a piece, and the begins of windows that are not in the block."""
    data, spans, missed = piece.tobytes(), [], []
    last = len(piece) - SPAN

    def there(at: int) -> bool:
        return data[8 * at:8 * at + _WINDOW] in block.windows

    at = 0
    while at <= last:
        if not there(at):  # the factor from here is short
            missed.append(at)
            at += 1
            continue
        end = at + block.longest(piece, data, at)
        spans.append((at, end))
        # The greedy parse goes on behind the factor; a window over its end may be elsewhere in the block.
        for begin in range(end - SPAN + 1, min(end, last + 1)):
            if there(begin):
                spans.append((begin, begin + SPAN))
            else:
                missed.append(begin)
        at = end
    return spans, missed


def factored(cut: DataFrame) -> DataFrame:
    """(doc_id, row, spans, missed) for every piece: spans (start, stop) found in its block, other windows (start, print)."""
    import xxhash

    asked = cut.where(F.col("row").isNotNull()).groupBy("of").agg(F.sum(F.size("words")).alias("_asked"))
    sized = cut.join(asked.hint("merge"), "of").withColumn("_copies", F.ceil(F.col("_asked") / BLOCK_WORDS).cast("int"))
    salt = F.when(F.col("row").isNull(), F.sequence(F.lit(0), F.col("_copies") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("row", "start"), F.col("_copies")).cast("int")))
    dealt = sized.select("of", F.explode(salt).alias("salt"), F.col("row").isNotNull().alias("asks"), "doc_id", "row", "start", "words")
    kind = cut.schema["doc_id"].dataType.simpleString()
    span, miss = pa.struct([("start", pa.int32()), ("stop", pa.int32())]), pa.struct([("start", pa.int32()), ("print", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, block = None, [], None
        for batch in batches:
            rows, spans, missed = [], [], []
            values = batch.column("words")
            for i, (of, salt, asks, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("of", "salt", "asks", "start")), strict=True)):
                words = values[i].values.to_numpy()
                if (of, salt) != name:
                    name, parts, block = (of, salt), [], None
                if not asks:
                    parts.append(words)
                    continue
                if block is None:
                    block, parts = Block(parts), []
                found, other = parsed(words, block)
                if found or other:
                    data = words.tobytes()
                    rows.append(i)
                    spans.append([{"start": start + a, "stop": start + b} for a, b in found])
                    missed.append([{"start": start + a, "print": xxhash.xxh3_128_digest(data[8 * a:8 * a + _WINDOW])} for a in other])
            own = batch.select(["doc_id", "row"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(spans, pa.list_(span)), pa.array(missed, pa.list_(miss))], names=["doc_id", "row", "spans", "missed"])

    return dealt.repartition("of", "salt").sortWithinPartitions("of", "salt", "asks").mapInArrow(
        parse, f"doc_id {kind}, row long, spans array<struct<start: int, stop: int>>, missed array<struct<start: int, print: binary>>")


def repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, spans): where each text, once for all its copies, repeats an earlier document. ``rows`` is ``anchored(docs)``."""
    held = rows.select("row", "doc_id", F.explode("anchors").alias("anchor"))
    shared = _first_holders(held.select("anchor", "doc_id"), "anchor")
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select(row_name("doc_id").alias("row"))
    holders = held.select("anchor", "row").join(shared.hint("merge"), "anchor").groupBy("row").agg(
        F.collect_set(F.struct("anchor", "first")).alias("held"))
    cut = stored(pieces(docs, holders.join(firsts.hint("merge"), "row", "left_semi")), "pieces")
    found = stored(factored(cut), "factors")
    missed = found.where(F.size("missed") > 0).select("doc_id", "row", F.explode("missed").alias("at")).select("doc_id", "row", "at.*")
    again = missed.join(_first_holders(missed.select("print", "doc_id"), "print").hint("merge"), "print")
    again = again.where(F.col("doc_id").isNull() | (F.col("first") < F.col("doc_id"))).select(
        "row", F.array(F.struct("start", (F.col("start") + SPAN).alias("stop"))).alias("spans"))
    spans = found.where(F.size("spans") > 0).select("row", "spans").unionByName(again)
    return spans.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def _kept(docs: DataFrame, spans: DataFrame, out: Callable[[bytes], object], kind: pa.DataType) -> DataFrame:
    """(row, n_removed, kept) of the texts that lose words; ``out`` makes ``kept`` of the kept words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept, texts = [], [], batch.column("text").cast(pa.binary())
            for i, spans in enumerate(batch.column("spans")):
                words, left = WORDS.findall(texts[i].as_py() or b""), []
                at = 0
                for start, stop in zip(spans.values.field("start").to_pylist(), spans.values.field("stop").to_pylist(), strict=True):
                    left += words[at:start]
                    at = max(at, stop)
                left += words[at:]
                gone.append(len(words) - len(left))
                kept.append(out(b" ".join(left)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(gone, pa.int64()), pa.array(kept, kind)], names=["row", "n_removed", "kept"])

    found = _rows(docs).select("row", "text").join(spans, "row").select("row", "text", "spans")
    return found.mapInArrow(cut, "row long, n_removed long, kept string").dropDuplicates(["row"])


def _judged(docs: DataFrame, out: Callable[[bytes], object]) -> DataFrame:
    """(doc_id, key, row, n_words, whole, n_removed, kept) for every row; kept is null where nothing goes."""
    rows = stored(anchored(docs), "anchors")
    kept = _kept(docs, repeats(docs, rows), out, pa.string())
    first = rows.groupBy("key").agg(F.min("doc_id").alias("_first"))
    judged = rows.drop("anchors").join(first.hint("merge"), "key").join(kept.hint("merge"), "row", "left")
    later = (F.col("doc_id") > F.col("_first")) | (F.col("doc_id").isNull() & F.col("_first").isNotNull())
    copy = F.coalesce(later, F.lit(False)) & (F.col("n_words") >= SPAN)
    return judged.select(
        "doc_id", "key", "row", "n_words", "whole", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(copy, F.lit(out(b""))).otherwise(F.col("kept")).alias("kept"))


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, words, words removed, and the SHA-256 of the kept words joined by one space."""
    judged = _judged(docs, lambda words: hashlib.sha256(words).hexdigest())
    return judged.select("doc_id", "n_words", "n_removed", F.coalesce("kept", "whole").alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, all columns; a text that loses words becomes its kept words joined by one space."""
    judged = _judged(docs, bytes.decode).where(F.col("n_removed") > 0).select("row", "kept").dropDuplicates(["row"])
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("given"), text_key(F.col("text")).alias("key"), "doc_id")
    both = keyed.select("given", row_name("doc_id").alias("row")).join(judged, "row", "left")
    return both.select(*[(F.coalesce("kept", "given.text") if c == "text" else F.col(f"given.`{c}`")).alias(c) for c in docs.columns])
