"""Hard negatives against the scores of all pairs."""

import random

import numpy as np
import pytest

from playtape.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, one string"


def brute(rows):
    kept = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not np.isfinite(x) or abs(x) >= 1 << 20 for x in vector):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, np.floor(256 * np.array(vector, np.float32).astype(float)).astype(np.int64)))
    sizes = [len(v) for _, _, v in kept]
    usual = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    kept = [x for x in kept if len(x[2]) == usual]
    for i, (anchor, label, query) in enumerate(kept):
        if anchor % 50:
            continue
        scored = sorted((-int(v @ query), vec_id, other == label) for j, (vec_id, other, v) in enumerate(kept) if j != i)
        for score, positive, _ in [x for x in scored if x[2]][:5]:
            inside = [(s, n) for s, n, alike in scored if not alike and 50 * -score <= 100 * -s <= 95 * -score]
            yield from ((anchor, positive, rank, n, -score, -s) for rank, (s, n) in enumerate(inside[:3], 1))


def vectors(seed, n=700, size=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    rows = [(i, (centres[i % 4] * (i % 3) + rng.normal(size=size) * 0.6).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(60)]  # one vector many times
    rows += [rows[50], rows[50], rows[100], (50, [0.0] * size, 1), (150, rows[1][1], 2), (None, [1.0] * size, 1), (2000, None, 1), (2050, [1.0] * size, None),
             (2100, [float("nan")] + [1.0] * (size - 1), 1), (2150, [float("inf")] * size, 1), (2200, [None] * size, 1), (2250, [1.0], 1), (2300, [2.0**21] * size, 1), (2350, [-2.0**20 + 1] + [0.0] * (size - 1), 2), (2351, [-2.0**20 + 1] + [0.3] * (size - 1), 2), (2353, [-2.0**19] + [0.3] * (size - 1), 3)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shard,block", [(0, 1 << 14, 1 << 10), (1, 90, 5), (2, 200, 3)])
def test_equals_all_pairs(spark, seed, shard, block):
    rows = vectors(seed, size=[9, 1, 2][seed])
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, hard_negatives.mined(df, shard, block).collect()))
    assert got == sorted(brute(rows)) and got


def test_walk_stops_before_the_end():
    """The bounds prune: clustered vectors leave most cells unvisited."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    data = (rng.normal(size=(16, 1, 8)) * 300 + rng.normal(size=(16, 100, 8))).reshape(-1, 8).astype(np.int32)
    books = [hard_negatives.codebook(data[:, :4].astype(float)), hard_negatives.codebook(data[:, 4:].astype(float))]
    n = len(data)
    table = pa.table({"vec_id": np.arange(n), "label": np.zeros(n, int), "mark": np.arange(n), "copy": np.ones(n, np.int32), "vector": pa.array(data.tolist(), pa.list_(pa.int32())),
                      "one": hard_negatives.nearest(data[:, :4], books[0]), "two": hard_negatives.nearest(data[:, 4:], books[1])})
    shard = hard_negatives.Shard(table, books)
    bounds = [b for b, _ in shard.visited(data[0].astype(np.int64))]
    assert bounds == sorted(bounds, reverse=True)
    assert sum(r.stop - r.start for _, r in shard.visited(data[0].astype(np.int64))) == n
    best = np.sort(data @ data[0])[-6]
    assert sum(r.stop - r.start for b, r in shard.visited(data[0].astype(np.int64)) if b >= best) < n / 2


def test_no_rows(spark):
    assert hard_negatives.mined(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives.mined(spark.createDataFrame([(1, [1.0], None, 1.0, "x"), (50, [1.0], 1, 1.0, "x")], SCHEMA)).collect() == []
