"""The prefix trie against a plain dictionary of prefixes, with every component split and with none."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from playtape.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a long"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(rows, share=5, most=9):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = turns.get(c - int(np.fmod(c, share)), [])[:h] + own[h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    for node, held in members.items():
        ended = ",".join(map(str, sorted(c for c in held if len(built[c]) == len(node))))
        yield (min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children.get(node, [])),
               leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest())


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 70), 20_000, 10**12]:
        if c % 11 == 4:
            continue  # bases that are not there
        for turn in range(rng.choice([1, 2, 5, 9, 12])):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["é", "b", "", None, "long one"])))
    deep = [(1000 + i, t, "user", str(t) if t < 40 + i else f"{i}") for i in range(3) for t in range(60)]
    rows += [*deep, *rows[:3], (None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,local", [(0, 1 << 14), (1, 60), (2, 8)])
def test_equals_a_dictionary_of_prefixes(spark, seed, local):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    got = sorted(map(str, map(tuple, prefix_trie.prefix_trie(df, local=local).collect())))
    assert got == sorted(map(str, brute(rows)))


def test_hot_conversation_is_cut(spark):
    rows = conversations(5)
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    spark.conf.set("spark.playtape.hotRows", "20")
    try:
        got = sorted(map(str, map(tuple, prefix_trie.prefix_trie(df).collect())))
    finally:
        spark.conf.unset("spark.playtape.hotRows")
    assert got == sorted(map(str, brute(rows)))


def test_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ends_of_many_conversations(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 9000, 3)]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    assert sorted(map(str, map(tuple, prefix_trie.prefix_trie(df).collect()))) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize("shape", ["chain", "star", "random", "two trees"])
def test_local_decomposition(shape):
    rng = random.Random(1)
    n = 300
    parents = {"chain": [i - 1 for i in range(n)], "star": [-1] + [0] * (n - 1), "random": [-1] + [rng.randrange(i) for i in range(1, n)],
               "two trees": [-1, -1] + [rng.randrange(i) for i in range(2, n)]}[shape]
    value = np.array([rng.randint(0, 9) for _ in parents])
    own = [rng.randint(1, 5) for _ in parents]
    want, mass = value.copy(), list(own)
    for i in range(n - 1, -1, -1):
        if parents[i] >= 0:
            want[parents[i]] += want[i]
            mass[parents[i]] += mass[i]
    assert (prefix_trie.decomposed(parents, mass, [value])[0] == want).all()
