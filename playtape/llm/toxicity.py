"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words in lower case and the heads (3 to 6 characters) of its words, hashed to ``SLOTS`` slots.
Of the slots, those whose presence tells the labels apart are kept: a log likelihood ratio of at least ``LEAST_TOLD`` on the
training rows, counted in Spark, and of these the ``TERMS`` with the greatest. The machine scores an intercept, a weight for every kept term that is present, and
the dot product of two terms' factors for every pair that is present together; pairs are summed in linear time. So it can
learn that two harmless terms are toxic together, or that one tames the other.

The machine is fitted on at most ``FIT_ROWS`` labelled texts outside the held-out fold. Texts that say nearly the same
(equal least hash over their shingles of three words) share the weight of one, so a group of copies is not learned by heart.

Defined cases: a null or empty text has the score of the intercept; without labelled rows or with one label only every score
is the share of toxic rows, 0 if there are none; ties between terms go to the lower slot; repeated rows each get a score;
further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtape.llm.common import held_out, labelled_sample
from playtape.session import cut_lineage

WORDS = re.compile(r"[^\W_]+")
HEADS = (3, 4, 5, 6)
SLOTS = 1 << 22
TERMS = 4_096
LEAST_TOLD = 6.0
FACTORS = 4
FIT_ROWS = 20_000
EPOCHS = 30
BATCH = 256
FOLDS, KEPT_BACK = 3, 1
CUT = 0.7


class WordSlots(dict):
    """Slots of a word and of its heads, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 50_000:
            self.clear()
        raw = ["=" + word, *["^" + word[:n] for n in HEADS if len(word) > n]]
        self[word] = slots = tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % SLOTS for t in raw)
        return slots


def terms(text: str | None, seen: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The distinct slots of a text's terms."""
    found: set[int] = set()
    for word in set(WORDS.findall(text.lower())) if text else ():
        found.update(seen[word])
    return np.fromiter(found, np.int64, len(found))


def sketch(text: str) -> int:
    """The least hash over a text's shingles of three words; near copies mostly share it."""
    words = WORDS.findall(text.lower())
    return min((zlib.crc32(" ".join(words[i:i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0)


class Machine:
    """Intercept, weights and factors of the kept slots."""

    def __init__(self, slots: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.slots, self.bias, self.w, self.v = slots, bias, w, v

    def raw(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.slots, found)
        at = at[at < len(self.slots)] if len(self.slots) == 0 else np.minimum(at, len(self.slots) - 1)
        at = at[self.slots[at] == found] if len(at) else at
        if not len(at):
            return self.bias
        v = self.v[at]
        return self.bias + float(self.w[at].sum()) + 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())

    def score(self, found: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(found), -35, 35))))


def train(slots: np.ndarray, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS,
          factors: int = FACTORS, rate: float = 0.2, l2_weights: float = 1e-6, l2_factors: float = 1e-4, seed: int = 7) -> Machine:
    """Adaptive gradient steps on the weighted log loss; ``rows`` hold places in ``slots``.

    Both labels weigh the same in all. The first half of the epochs fits single terms alone, so that the factors
    are left with what those miss: a word and its own heads always stand together, and their pairs would otherwise
    take the place of the weights.
    """
    rng = np.random.default_rng(seed)
    m = len(slots)
    v = rng.normal(0, 0.05, (m + 1, factors))
    v[m] = 0.0  # the padding term
    weight = weight * np.where(y == 1, 1 / max((weight * y).sum(), 1e-9), 1 / max((weight * (1 - y)).sum(), 1e-9))
    weight = weight / weight.mean()
    # Weights begin at half the log odds of their terms.
    seen = [np.full(m + 1, 1e-3 * (weight * side).sum()) for side in (y, 1 - y)]
    for row, toxic, each in zip(rows, y, weight, strict=True):
        seen[0][row] += each * toxic
        seen[1][row] += each * (1 - toxic)
    w = 0.5 * np.log(seen[0] / seen[1])
    w[m], bias = 0.0, 0.0
    gw, gv, gb = np.full(m + 1, 1e-3), np.full((m + 1, factors), 1e-3), 1e-3
    for epoch in range(epochs):
        pairs = float(2 * epoch >= epochs)
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            chosen = order[start:start + BATCH]
            width = max(1, max(len(rows[i]) for i in chosen))
            at = np.full((len(chosen), width), m)
            for r, i in enumerate(chosen):
                at[r, :len(rows[i])] = rows[i]
            vs = v[at]
            total = vs.sum(axis=1)
            raw = bias + w[at].sum(axis=1) + pairs * 0.5 * (total ** 2 - (vs ** 2).sum(axis=1)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y[chosen]) * weight[chosen]
            flat = at.ravel()
            dw = np.bincount(flat, np.repeat(error, width), minlength=m + 1) + l2_weights * len(chosen) * w
            dv_rows = (error[:, None, None] * (total[:, None, :] - vs)).reshape(-1, factors)
            dv = np.stack([np.bincount(flat, dv_rows[:, f], minlength=m + 1) for f in range(factors)], axis=1) + l2_factors * len(chosen) * v
            dw[m], dv[m] = 0.0, 0.0
            gw += dw ** 2
            gb += error.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            if pairs:
                gv += dv ** 2
                v -= rate * dv / np.sqrt(gv)
            bias -= rate * error.sum() / np.sqrt(gb)
    return Machine(slots, bias, w[:m], v[:m])


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS, kept: int = TERMS) -> Machine:
    """Terms are counted and chosen in Spark; the driver sees kept terms of the sampled rows only."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordSlots()
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype(str), "y": rows["y"], "sketch": [sketch(t) for t in rows["text"]],
                                "slots": [terms(t, seen) for t in rows["text"]]})

    sample = labelled_sample(docs, labels, "toxic", FOLDS, KEPT_BACK, bound)
    made = sample.mapInPandas(cut, "doc_id string, y int, sketch long, slots array<long>")
    made = cut_lineage(made)
    same = made.groupBy("sketch").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    made = made.join(F.broadcast(same), "sketch")  # at most ``bound`` rows
    totals = made.agg(F.sum(F.when(F.col("y") == 1, F.col("weight"))).alias("toxic"), F.sum("weight").alias("all")).first()
    toxic, everything = totals.toxic or 0.0, totals["all"] or 0.0
    if not toxic or toxic >= everything:
        share = np.clip(toxic / everything if everything else 0.0, 1e-9, 1 - 1e-9)
        return Machine(np.empty(0, np.int64), float(np.log(share / (1 - share))), np.empty(0), np.empty((0, FACTORS)))
    counts = made.select(F.explode("slots").alias("slot"), "y", "weight").groupBy("slot").agg(
        F.sum(F.when(F.col("y") == 1, F.col("weight")).otherwise(0.0)).alias("a"), F.sum("weight").alias("n"))
    expected = F.col("n") * (toxic / everything)
    rest, other = F.col("n") - F.col("a"), F.col("n") * (1 - toxic / everything)
    part = lambda seen, due: F.when(seen > 1e-9, seen * F.log(seen / due)).otherwise(0.0)
    told = counts.withColumn("told", F.round(part(F.col("a"), expected) + part(rest, other), 6))
    top = told.where(F.col("told") >= LEAST_TOLD).orderBy(F.desc("told"), "slot").limit(kept).select("slot")
    slots = np.sort(np.array([r.slot for r in top.collect()], np.int64))  # at most ``kept``
    sent = made.sparkSession.sparkContext.broadcast(slots)

    @F.pandas_udf("array<int>")
    def places(found: pd.Series) -> pd.Series:
        keep = sent.value
        def of(x: np.ndarray) -> np.ndarray:
            if not len(keep):
                return np.empty(0, np.int32)
            at = np.minimum(np.searchsorted(keep, x), len(keep) - 1)
            return np.sort(at[keep[at] == x]).astype(np.int32)
        return found.map(of)

    rows = made.select("doc_id", "y", "weight", places("slots").alias("at")).toPandas().sort_values("doc_id")  # at most ``bound``
    return train(slots, [np.asarray(a, np.int64) for a in rows["at"]], rows["y"].to_numpy(float), rows["weight"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and the prediction at ``CUT`` for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen, machine = WordSlots(), sent.value
        for text in texts:
            yield pd.Series([machine.score(terms(t, seen)) for t in text], dtype="float64")

    rows = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, KEPT_BACK).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
