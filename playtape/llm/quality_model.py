"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

A text's tokens (runs of word characters, and runs of other visible characters, in their own case) and neighbouring pairs of
tokens are hashed to ``SLOTS`` slots; a pair of equal tokens is one feature of its own, whatever the token. A feature
weighs the logarithm of its count, and a text's weights have unit length. Training rows, at most ``FIT_ROWS`` labelled
texts outside the held-out fold, are dealt to ``SHARDS`` tasks by a hash of their ids; each task runs the per-coordinate
updates over its rows, and the slots' weights are averaged, weighted by how often each task met the slot. A score is a
sparse dot product passed through the logistic function.

Defined cases: a null or empty text has the score of the intercept; without labelled rows every score is 0.5; repeated rows each
get a score; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.llm.common import held_out, labelled_sample

TOKENS = re.compile(r"\w+|[^\w\s]+")
SLOTS = 1 << 18
FIT_ROWS = 16_000
SHARDS = 8
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 0.1, 0.02, 0.02
FOLDS, KEPT_BACK = 5, 0
CUT = 0.3


class TokenHashes(dict):
    """CRC-32 of tokens, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[token] = value = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


def features(text: str | None, seen: dict[str, int], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's features, each once, and their weights; slot 0 is the intercept."""
    tokens = TOKENS.findall(text) if text else []
    hashes = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
    pairs = (hashes[:-1] * 0x9E3779B1 + hashes[1:] * 0x85EBCA6B + 1) & 0x7FFFFFFFFFFF
    pairs = np.where(hashes[:-1] == hashes[1:], 7, pairs ^ (pairs >> 21))
    at, counts = np.unique(np.concatenate([hashes, pairs]) % (slots - 1) + 1, return_counts=True)
    weights = 1.0 + np.log(counts)
    norm = np.sqrt((weights ** 2).sum()) or 1.0
    return np.concatenate([[0], at]), np.concatenate([[1.0], weights / norm])


def logistic(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], slots: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and how often each slot was met, from (slots, weights, label) rows in their order."""
    z, n, met = np.zeros(slots), np.zeros(slots), np.zeros(slots)

    def weight(at: np.ndarray) -> np.ndarray:
        shrunk = np.maximum(np.abs(z[at]) - L1, 0.0)
        return -np.sign(z[at]) * shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2 * (at > 0))

    for epoch in range(epochs):
        for at, x, y in rows:
            w = weight(at)
            g = (logistic(float(w @ x)) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            if epoch == 0:
                met[at] += 1
    return weight(np.arange(slots)), met


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS, parts: int = FOLDS, kept_back: int = KEPT_BACK,
        slots: int = SLOTS, shards: int = SHARDS) -> np.ndarray:
    """One weight per slot. Tasks train in parallel; what comes back is never longer than ``slots``."""
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        seen = TokenHashes()
        ordered = rows.sort_values("_order")
        made = [(*features(t, seen, slots), y) for t, y in zip(ordered["text"], ordered["y"], strict=True)]
        w, met = follow_leader(made, slots)
        at = np.flatnonzero(met)
        return pd.DataFrame({"slot": at.astype(np.int32), "w": w[at] * met[at], "met": met[at]})

    sample = labelled_sample(docs, labels, "quality", parts, kept_back, bound)
    dealt = sample.withColumn("_order", F.xxhash64("doc_id", F.lit(2))).withColumn("_shard", F.pmod("_order", F.lit(shards)))
    means = dealt.groupBy("_shard").applyInPandas(train, "slot int, w double, met double").groupBy("slot").agg(
        (F.sum("w") / F.sum("met")).alias("w")).where(F.col("w") != 0).toArrow()
    out = np.zeros(slots, np.float32)
    out[means.column("slot").to_numpy()] = means.column("w").to_numpy()
    return out


def scorer(docs: DataFrame, weights: np.ndarray):
    """A column function from text to score; the weights, one per slot, are sent to the executors once."""
    sent, slots = docs.sparkSession.sparkContext.broadcast(weights), len(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen, w = TokenHashes(), sent.value
        for text in texts:
            out = []
            for t in text:
                at, x = features(t, seen, slots)
                out.append(logistic(float(w[at] @ x)))
            yield pd.Series(out, dtype="float64")

    return score


def scored(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and the prediction at ``CUT`` for every document."""
    score = scorer(docs, fit(docs, labels, bound))
    rows = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, KEPT_BACK).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", predicted(F.col("score")))


def predicted(score: Column) -> Column:
    return F.when(score >= CUT, 1).otherwise(0)


def good_documents(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """The documents, all columns, that score at least ``CUT``."""
    score = scorer(docs, fit(docs, labels, bound))
    return docs.where(score(F.col("text")) >= CUT)
