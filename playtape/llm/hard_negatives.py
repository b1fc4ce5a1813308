"""Hard negatives over an inverted multi-index: cells of two half-space codebooks, visited in the order of their bounds.

Vectors are cut into two halves, and each half has a codebook of ``CODES`` centres, fitted on at most ``SAMPLE`` rows in the
order of their hash. A row's cell is its pair of nearest centres; every row is indexed. Rows are dealt evenly into shards of
about ``SHARD_ROWS``, whatever cell or label is crowded, and anchors into blocks of about ``ANCHORS``; a task holds one shard
against one block.

For an anchor, a half's score in a cell is at most ``q . centre + |q| radius``, the radius being that of the shard's rows around
the centre. The multi-sequence heap takes cells by the sum of both bounds, greatest first, and scores their rows exactly. It
stops once no unvisited cell can hold a row that is wanted: below the fifth positive so far, or, for negatives, below
what every window still needs (its third row, or its lower end). Tasks return at most ``POSITIVES`` or ``NEGATIVES`` rows
for each anchor and window, and these are ranked again over all shards. So the answer is exact, whatever the sample was.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component take no part, nor do those with a
component of ``LARGEST`` or more in size, whose scores might not fit in 64 bits, or of another length than most rows (the
longer on a tie); equal rows are rows of their own, and equal anchors each give their rows; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtape.llm.common import stored


CODES, SAMPLE, TURNS = 16, 4096, 8
SHARD_ROWS, ANCHORS = 1 << 16, 1 << 8
POSITIVES, NEGATIVES = 5, 3
EVERY, MOVED, LABELS = 50, 7, 10
LOW, HIGH = 50, 95  # percent of the positive's score
SCALE, LARGEST = 256, 1 << 20


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector, n): each distinct row that takes part, and how many rows are like it."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(whole, F.lit(False)))
    label = F.col("label").cast("long")
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % MOVED == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("vector"))
    rows = stored(rows.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("n")), "vectors")
    usual = rows.groupBy(F.size("vector").alias("size")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("vector") == (usual.size if usual else 0))


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (((centres ** 2).sum(axis=1) - 2 * half @ centres.T)).argmin(axis=1)


def codebook(half: np.ndarray) -> np.ndarray:
    """Centres of a half by Lloyd's turns, begun at rows spread over the sample."""
    centres = half[np.linspace(0, len(half) - 1, min(CODES, len(half))).astype(int)]
    for _ in range(TURNS if len(half) else 0):
        code = nearest(half, centres)
        centres = np.array([half[code == i].mean(axis=0) if (code == i).any() else c for i, c in enumerate(centres)])
    return centres


def codebooks(rows: DataFrame) -> list[np.ndarray]:
    """Both codebooks, from at most ``SAMPLE`` rows."""
    drawn = rows.select("vector").orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "label").limit(SAMPLE).toArrow()
    vectors = matrix(drawn.column("vector").combine_chunks()).astype(float)
    middle = vectors.shape[1] // 2
    return [codebook(vectors[:, :middle]), codebook(vectors[:, middle:])]


def matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), len(vectors[0]) if len(vectors) else 0).astype(np.int64)


def celled(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The rows with the code of either half; a row like others is repeated as often as an answer could need it."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("vector"))
                middle = vectors.shape[1] // 2
                codes = [nearest(vectors[:, :middle], books[0]), nearest(vectors[:, middle:], books[1])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in codes)], names=[*batch.schema.names, "one", "two"])

    coded = rows.mapInArrow(code, "vec_id long, label long, vector array<int>, n long, one int, two int")
    copies = F.sequence(F.lit(1), F.least("n", F.lit(1 + POSITIVES)).cast("int"))
    return coded.select("vec_id", "label", "vector", "n", "one", "two", F.explode(copies).alias("copy")).withColumn("mark", F.xxhash64("label", "vector"))


class Shard:
    """A shard's rows in the order of their cells, and the radius of its rows around each centre."""

    def __init__(self, rows: pa.Table, books: list[np.ndarray]) -> None:
        codes = [rows.column(c).to_numpy().astype(np.int64) for c in ("one", "two")]
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1)).tolist()
        vectors = matrix(rows.column("vector").combine_chunks())[order]
        self.ids, self.labels, self.marks, self.copies = (rows.column(c).to_numpy()[order] for c in ("vec_id", "label", "mark", "copy"))
        self.whole, self.doubles, self.largest = vectors, vectors.astype(float), float(np.abs(vectors).max(initial=1))
        middle = vectors.shape[1] // 2
        self.halves = [slice(None, middle), slice(middle, None)]
        self.books, self.radii = books, []
        for half, book, code in zip(self.halves, books, codes, strict=True):
            far, radius = np.sqrt(((vectors[:, half] - book[code[order]]) ** 2).sum(axis=1)), np.full(len(book), -1.0)
            np.maximum.at(radius, code[order], far)
            self.radii.append(radius)

    def query(self, anchor: dict) -> np.ndarray:
        """The anchor's vector: as doubles, which hold all its products exactly, unless components are very large."""
        vector = np.array(anchor["vector"], np.int64)
        exact = float(np.abs(vector).max(initial=1)) * self.largest * max(1, len(vector)) < 2.0 ** 52
        return vector.astype(float) if exact else vector

    def scores(self, cell: slice, query: np.ndarray) -> np.ndarray:
        return (self.doubles if query.dtype == float else self.whole)[cell] @ query

    def visited(self, query: np.ndarray) -> Iterator[tuple[float, slice]]:
        """(bound, rows) of the cells with rows, greatest bound first: the multi-sequence walk over both halves."""
        bounds, orders = [], []
        for half, book, radius in zip(self.halves, self.books, self.radii, strict=True):
            q = query[half].astype(float)
            inner, reach = book @ q, np.sqrt((q ** 2).sum()) * radius
            above = inner + reach + 1e-9 * (np.abs(inner) + np.abs(reach)) + 1e-6  # above any rounding
            bounds.append(np.where(radius < 0, -np.inf, above))  # no row has this code
            orders.append(np.argsort(-bounds[-1]).tolist())
        one, two = (b[o].tolist() for b, o in zip(bounds, orders, strict=True))
        heap = [(-(one[0] + two[0]), 0, 0)]
        while heap and heap[0][0] < np.inf:
            low, i, j = heappop(heap)
            if j + 1 < len(two):
                heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if not j and i + 1 < len(one):
                heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))
            cell = orders[0][i] * len(two) + orders[1][j]
            if self.starts[cell] < self.starts[cell + 1]:
                yield -low, slice(self.starts[cell], self.starts[cell + 1])

    def best(self, scores: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.lexsort((self.ids[rows], -scores))[:most]
        return scores[first], rows[first]


def positives_in(shard: Shard, anchor: dict) -> list[tuple]:
    """(positive_id, score) of the best rows of the anchor's label in the shard."""
    query = shard.query(anchor)
    scores, rows, need = np.empty(0, query.dtype), np.empty(0, np.int64), -np.inf
    for bound, cell in shard.visited(query):
        if bound < need:
            break
        found = shard.scores(cell, query)
        like = np.flatnonzero((shard.labels[cell] == anchor["label"]) & (found >= need))
        if len(like):
            found, like = found[like], like + cell.start
            other = (shard.ids[like] != anchor["vec_id"]) | (shard.marks[like] != anchor["mark"]) | (shard.copies[like] != 1)
            scores, rows = shard.best(np.concatenate([scores, found[other]]), np.concatenate([rows, like[other]]), POSITIVES)
            need = scores[-1] if len(scores) == POSITIVES else -np.inf
    return [(None, int(shard.ids[r]), None, int(s)) for s, r in zip(scores, rows, strict=True)]


def negatives_in(shard: Shard, anchor: dict) -> list[tuple]:
    """(place, positive_id, negative_id, score): the best rows of other labels inside each positive's window."""
    query = shard.query(anchor)
    windows = [(w, -(-LOW * w["score"] // 100), HIGH * w["score"] // 100) for w in anchor["windows"]]
    windows = [x for x in windows if x[1] <= x[2]]
    found = [(np.empty(0, query.dtype), np.empty(0, np.int64)) for _ in windows]
    need, high = np.array([x[1] for x in windows])[:, None], np.array([x[2] for x in windows])[:, None]
    least = need.min(initial=1 << 62)
    for bound, cell in shard.visited(query):
        if bound < least:
            break
        scores = shard.scores(cell, query)
        if scores.max() < least:
            continue
        inside = (scores >= need) & (scores <= high) & (shard.labels[cell] != anchor["label"])
        for i in np.flatnonzero(inside.any(axis=1)).tolist():
            at = np.flatnonzero(inside[i])
            found[i] = shard.best(np.concatenate([found[i][0], scores[at]]), np.concatenate([found[i][1], at + cell.start]), NEGATIVES)
            if len(found[i][0]) == NEGATIVES:
                need[i] = found[i][0][-1]
        least = need.min(initial=1 << 62)
    return [(w["place"], w["positive_id"], int(shard.ids[r]), int(s)) for (w, _, _), (scores, rows) in zip(windows, found, strict=True)
            for s, r in zip(scores, rows, strict=True)]


OUT = {"vec_id": pa.int64(), "mark": pa.int64(), "place": pa.int32(), "positive_id": pa.int64(), "negative_id": pa.int64(), "score": pa.int64()}


def _asked(rows: DataFrame, anchors: DataFrame, books: list[np.ndarray], shards: int, blocks: int, answer: Callable[[Shard, dict], list[tuple]]) -> DataFrame:
    """Every shard's answers to every anchor, one task for a shard and a block of anchors."""
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            shard = Shard(left, books)
            for asked in right.to_pylist():
                anchor = {name.removeprefix("q_"): value for name, value in asked.items()}
                out += [(anchor["vec_id"], anchor["mark"], *row) for row in answer(shard, anchor)]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in OUT]
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(OUT.items(), columns, strict=True)})

    shard, block = F.pmod(F.xxhash64("vec_id", "mark", "copy"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = rows.drop("n").withColumn("shard", shard).withColumn("block", every(blocks))
    # Names of their own: both sides come from one table.
    asking = anchors.select(*[F.col(c).alias(f"q_{c}") for c in anchors.columns], block.alias("q_block"), every(shards).alias("q_shard"))
    return held.groupBy("shard", "block").cogroup(asking.groupBy("q_shard", "q_block")).applyInArrow(
        meet, "vec_id long, mark long, place int, positive_id long, negative_id long, score long")


def mined(embeddings: DataFrame, shard_rows: int = SHARD_ROWS, block_rows: int = ANCHORS) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives inside the positive's window, ranked."""
    rows = usable(embeddings)
    books = codebooks(rows)
    rows = stored(celled(rows, books), "cells")
    anchors = rows.where((F.col("vec_id") % EVERY == 0) & (F.col("copy") == 1)).select("vec_id", "mark", "label", "vector", "n")
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when((F.col("vec_id") % EVERY == 0) & (F.col("copy") == 1), 1)).alias("anchors")).first()
    shards, blocks = max(1, -(-sizes.rows // shard_rows)), max(1, -(-sizes.anchors // block_rows))
    name = ["vec_id", "mark"]
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.coalesce("negative_id", "positive_id"))
    near = _asked(rows, anchors.drop("n"), books, shards, blocks, positives_in)
    near = near.withColumn("place", F.row_number().over(order(*name))).where(F.col("place") <= POSITIVES)
    windows = near.groupBy(*name).agg(F.collect_list(F.struct("place", "positive_id", "score")).alias("windows"))  # at most POSITIVES
    windowed = stored(anchors.join(windows.hint("merge"), name), "windows")
    found = _asked(rows, windowed.drop("n"), books, shards, blocks, negatives_in)
    found = found.withColumn("rank", F.row_number().over(order(*name, "place"))).where(F.col("rank") <= NEGATIVES)
    positive = windowed.select(*name, F.explode(F.array_repeat("windows", F.col("n").cast("int"))).alias("windows")).select(*name, F.explode("windows").alias("w"))
    positive = positive.select(*name, F.col("w.place").alias("place"), F.col("w.score").alias("positive_score"))
    return found.join(positive.hint("merge"), [*name, "place"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
