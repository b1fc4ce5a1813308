"""Byte-pair encoding through a table of distinct words, and decoding through the pieces of ids.

Texts are split into the vocabulary's words in Spark tasks, distinct words are counted, and each distinct word is encoded
once. Ids come back to the texts by position: the ``HOT`` commonest words, a bounded table, are sent to the tasks, which
write a text as one character for each such word and a gap for any other; the words in the gaps are joined with the
table of distinct words and return to their text by the number of their gap. So common words are never shuffled, and
rare ones cannot crowd a key. Equal texts are encoded once.

The splitting rules are those of the vocabulary file: control tokens first, then NFC, lower case, white space dropped, and
the file's word pattern; words are mapped to bytes and merged by the file's own merges.

Decoding looks every id's piece up in the table of pieces (as many as the vocabulary has ids) and joins them the way the file's
decoder does: with single spaces.

Defined cases: a null or empty text has no ids and decodes to nothing; repeated rows each give a row; an empty table gives
no rows; a text in which every word is rare is a row of gaps; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtape.llm.common import stored, text_key

HOT = 400_000
GAP = "\x00"
_FLUSH = 200_000
_TOGETHER = 512  # texts assembled at once
# The vocabulary's word pattern, for any text and for one of Latin letters below U+0250.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-zªµºß-öø-ɏ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACES = "\t-\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Splitter:
    """Cuts a text into the vocabulary's words; a control token is a word of its own."""

    def __init__(self, path: str) -> None:
        import regex

        self.own = tokenizer(path)
        self.control = sorted((t.content for t in self.own.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.at_control = re.compile("(" + "|".join(map(re.escape, self.control)) + ")") if self.control else None
        self.words = regex.compile(PATTERN.replace(r"\s", " "))

    def plain(self, text: str) -> list[str]:
        if BEYOND_LATIN.search(text):
            return self.words.findall(self.own.normalizer.normalize_str(text))
        return LATIN.findall(text.lower())

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.at_control is None or not self.at_control.search(text):
            return self.plain(text)
        out: list[str] = []
        for i, part in enumerate(self.at_control.split(text)):
            out += [part] if i % 2 else self.plain(part)
        return out


class WordEncoder:
    """Ids of one word, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        self.own = tokenizer(path)
        self.control = {t.content: i for i, t in self.own.get_added_tokens_decoder().items()}
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __call__(self, word: str) -> bytes:
        if word in self.control:
            return np.array([self.control[word]], "<u4").tobytes()
        ids = [t.id for piece, _ in self.to_bytes.pre_tokenize_str(word) for t in self.own.model.tokenize(piece)]
        return np.array(ids, "<u4").tobytes()


def pieces_of(path: str) -> list[str]:
    """The piece of every id."""
    own = tokenizer(path)
    return [own.id_to_token(i) for i in range(own.get_vocab_size(with_added_tokens=True))]


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) over all texts, counted inside tasks before they are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Splitter(path), Counter()
        def flushed() -> pa.RecordBatch:
            words = sorted(seen)  # neighbours share their beginnings, which compresses well
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split(text))
                if len(seen) > _FLUSH:
                    yield flushed()
                    seen.clear()
        yield flushed()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): each distinct word encoded once."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordEncoder(path)
        for batch in batches:
            made = pa.array([ids(w) for w in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(encode, "word string, n long, ids binary")


def least_count(words: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words are that common."""
    sizes = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect()
    least, have = None, 0
    for row in sizes:
        if have + row.words > most:
            break
        least, have = row.n, have + row.words
    return least if least is not None else (sizes[0].n + 1 if sizes else 1)


def sign(code: int) -> str:
    """A character for a code; zero is the gap, and surrogates are left out."""
    at = code + 1
    return chr(at if at < 0xD800 else at + 0x800)


class Signs(dict):
    """Sign of each hot word; a word without one is put down in ``gaps``."""

    def __init__(self, words: Iterable[str]) -> None:
        super().__init__((w, sign(i)) for i, w in enumerate(words))
        self.gaps: list[str] = []

    def __missing__(self, word: str) -> str:
        self.gaps.append(word)
        return GAP


_KEPT: dict[str, Signs] = {}


def signs_of(run: str, hot: pa.Table) -> Signs:
    """A worker makes the signs of a run once, not for every task."""
    if run not in _KEPT:
        _KEPT.clear()
        _KEPT[run] = Signs(w.as_py() for w in hot.column("word"))
    return _KEPT[run]


def id_lists(ids: pa.Array) -> pa.ListArray:
    """Binary ids as lists of integers, without a copy of the values."""
    ids = pa.concat_arrays([ids])  # its offsets begin at zero
    offsets = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1) // 4
    values = np.frombuffer(ids.buffers()[2], "<u4", offsets[-1]) if len(ids) and offsets[-1] else np.empty(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def filled_in(written: list[bytes], hot: pa.ListArray, gaps: pa.Array) -> pa.ListArray:
    """The ids of every text: signs become the ids of their words, gaps take the given ids in their order."""
    codes = [np.frombuffer(w.decode().encode("utf-32-le"), "<u4").astype(np.int64) for w in written]
    ends = np.cumsum([0, *map(len, codes)])
    all_codes = np.concatenate([np.empty(0, np.int64), *codes])
    holes = all_codes == 0
    if holes.sum() != len(gaps):
        raise ValueError(f"{int(holes.sum())} gaps are left for {len(gaps)} words")
    at = np.where(all_codes < 0xD800, all_codes, all_codes - 0x800) - 1
    at[holes] = len(hot) + np.arange(len(gaps))
    words = pa.concat_arrays([hot, id_lists(gaps)]).take(pa.array(at))
    sizes = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes[ends]), words.flatten())


def as_bytes(ids: pa.ListArray) -> list[memoryview]:
    """Each list's ids as little-endian unsigned 32-bit integers."""
    flat, offsets = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B"), ids.offsets.to_numpy()
    return [flat[4 * a:4 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def joined_pieces(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """Every id's piece, joined by single spaces."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pieces.take(ids.values)), " ")


Finish = Callable[[pa.Array, pa.ListArray], pa.RecordBatch]


def _assembled(docs: DataFrame, path: str, hot: int, finish: Callable[[], Finish], schema: str) -> DataFrame:
    """Ids of every distinct text, handed to ``finish`` with the texts' keys."""
    spark, run = docs.sparkSession, uuid.uuid4().hex
    table = stored(encoded_words(distinct_words(docs, path), path), "words")
    least = least_count(table, hot)
    common = table.where(F.col("n") >= least).toArrow()  # at most ``hot`` rows
    # The commonest words get the lowest signs, which are the shortest.
    common = common.sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids"])
    sent = spark.sparkContext.broadcast(common)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, signs = Splitter(path), signs_of(run, sent.value)
        for batch in batches:
            written, gaps = [], []
            for text in batch.column("text").to_pylist():
                signs.gaps = []
                written.append("".join(map(signs.__getitem__, split(text))).encode())
                gaps.append(signs.gaps)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(written, pa.binary()), pa.array(gaps, pa.list_(pa.string()))], names=["key", "written", "gaps"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = id_lists(sent.value.column("ids").combine_chunks()), finish()
        for whole in batches:
            for at in range(0, whole.num_rows, _TOGETHER):
                batch = whole.slice(at, _TOGETHER)
                gaps = batch.column("filled").flatten().field("ids")
                yield made(batch.column("key"), filled_in(batch.column("written").to_pylist(), known, gaps))

    texts = docs.select(text_key(F.col("text")).alias("key"), "text")
    rows = texts.mapInArrow(write, "key binary, written binary, gaps array<string>")
    rare = table.where(F.col("n") < least).select("word", "ids")
    gaps = rows.select("key", F.posexplode("gaps").alias("gap", "word")).join(rare, "word")
    filled = gaps.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("gap", "ids"))).alias("filled"))
    each = rows.groupBy("key").agg(F.first("written").alias("written"))
    return each.join(filled, "key", "left").select("key", "written", "filled").mapInArrow(assemble, schema)


def encode(docs: DataFrame, path: str, hot: int = HOT) -> DataFrame:
    """(key, ids) for every distinct text: ids as little-endian unsigned 32-bit integers."""
    def finish() -> Finish:
        return lambda keys, ids: pa.RecordBatch.from_arrays([keys, pa.array(as_bytes(ids), pa.binary())], names=["key", "ids"])

    return _assembled(docs, path, hot, finish, "key binary, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(key, decoded) from (key, ids)."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(pieces_of(path), pa.string())
        for batch in batches:
            texts = joined_pieces(id_lists(batch.column("ids")), pieces)
            yield pa.RecordBatch.from_arrays([batch.column("key"), texts], names=["key", "decoded"])

    return encoded.select("key", "ids").mapInArrow(join, "key binary, decoded string")


def digests(docs: DataFrame, path: str, hot: int = HOT) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the decoded text, for every row."""
    def finish() -> Finish:
        pieces = pa.array(pieces_of(path), pa.string())

        def digest(keys: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
            back = joined_pieces(ids, pieces).cast(pa.binary()).to_pylist()
            sha = [hashlib.sha256(x).hexdigest() for x in as_bytes(ids)]
            return pa.RecordBatch.from_arrays(
                [keys, ids.value_lengths().cast(pa.int64()), pa.array(sha, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        return digest

    made = _assembled(docs, path, hot, finish, "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", text_key(F.col("text")).alias("key")).join(made, "key").select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
