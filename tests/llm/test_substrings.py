"""Substring dedup against a plain table of all windows."""

import hashlib
import random
import re

import pytest

from playtape.llm import substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, row long, anchors string, _first long"


def order(doc_id):
    return float("inf") if doc_id is None else doc_id


def brute(rows):
    """(doc_id, n_words, n_removed, kept words) of every row."""
    first, split = {}, [WORDS.findall(text or "") for _, text in rows]
    windows = [[tuple(w[i:i + 13]) for i in range(len(w) - 12)] for w in split]
    for (doc_id, _), found in zip(rows, windows, strict=True):
        for window in found:
            first[window] = min(first.get(window, float("inf")), order(doc_id))
    for (doc_id, _), words, found in zip(rows, split, windows, strict=True):
        gone = {i + j for i, window in enumerate(found) if first[window] < order(doc_id) for j in range(13)}
        yield doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)


def rows_with_repeats(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 40]))]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([13, 14, 20, 60]))] for _ in range(8)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            new = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            words += rng.choice(passages)[rng.randint(0, 5):] if rng.random() < 0.6 else new
        rows.append((rng.choice([i, i, i, 3, None]), "  ".join(words)))
    rows += [(100, None), (101, ""), (102, " \n\t"), (5, rows[7][1]), (None, rows[7][1]), rows[9], rows[9], (103, "É" + "\x00 é" * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_table_of_all_windows(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "BLOCK_WORDS", [1 << 13, 50][seed % 2])
    rows = rows_with_repeats(seed)
    docs = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA)
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute(rows)]
    assert sorted(map(str, map(tuple, substrings.digests(docs).collect()))) == sorted(map(str, want))


def test_texts_keep_their_rows_and_columns(spark):
    rows = rows_with_repeats(9)
    docs = spark.createDataFrame([(*r, i, f"a{i}", None) for i, r in enumerate(rows)], SCHEMA)
    out = substrings.deduplicated(docs)
    assert out.columns == docs.columns
    got = {r.row: r for r in out.collect()}
    for i, (given, (doc_id, _, gone, kept)) in enumerate(zip(rows, brute(rows), strict=True)):
        assert (got[i].doc_id, got[i].text, got[i].anchors) == (doc_id, kept if gone else given[1], f"a{i}")


def test_a_long_text_and_no_rows(spark):
    rng = random.Random(3)
    long = [str(rng.randint(0, 10**6)) for _ in range(30_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["new", *long[100:25_000], "end"])), (3, " ".join(long[5:17])), (4, " ".join(long[5:18]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substrings.digests(docs).collect()} == {(1, 0), (2, 24_900), (3, 0), (4, 13)}
    assert substrings.digests(docs.limit(0)).collect() == [] and substrings.deduplicated(docs.limit(0)).collect() == []


def test_ids_of_text(spark):
    words = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([("b", words), ("a", words + " x"), (None, words)], "doc_id string, text string")
    assert {(r.doc_id, r.n_removed) for r in substrings.digests(docs).collect()} == {("a", 0), ("b", 20), (None, 20)}
