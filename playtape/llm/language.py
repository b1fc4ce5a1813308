"""Language identification: words first, then shorter and shorter character n-grams.

A word that training met is scored by its log frequency in every language. A word that it did not meet falls back to its
character n-grams of five letters (the word's ends marked), and as long as none of these was met, to those of four,
three, two and one; their mean log frequency stands for the word. A text's scores are the sums over its words, and the
posterior of the best language (all alike beforehand) is the score.

Words and n-grams are counted in Spark. The model is fitted on at most ``FIT_ROWS`` rows of each language outside the held-out
fold, taken in the order of their ids' hashes, and keeps the ``MOST_WORDS`` commonest words and the ``MOST_GRAMS``
commonest n-grams of each length: its size, and so its broadcast, is bounded. Every row is scored by its whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language that sorts first; rows
without lang teach nothing; without any taught language everything is ``und`` with score 0; repeated rows each get a
row; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtape.llm.common import held_out
from playtape.session import cut_lineage

RUNS = re.compile(r"[^\W\d_]+")
LENGTHS = (5, 4, 3, 2, 1)
FIT_ROWS = 8_000
MOST_WORDS = 1 << 17
MOST_GRAMS = 1 << 16
FOLDS, KEPT_BACK = 5, 0
NONE = "und"
_FLUSH = 200_000
_REMEMBERED = 50_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    runs = RUNS.findall(text.lower()) if text else []
    return [w for w in runs if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of words and n-grams per language."""

    def __init__(self, languages: list[str], words: dict[str, int], word_logs: np.ndarray,
                 grams: dict[int, dict[str, int]], gram_logs: dict[int, np.ndarray]) -> None:
        self.languages, self.words, self.word_logs = languages, words, word_logs
        self.grams, self.gram_logs = grams, gram_logs

    def backed_off(self, word: str) -> np.ndarray:
        for n in LENGTHS:
            known = [i for g in grams_of(word, n) if (i := self.grams[n].get(g)) is not None]
            if known:
                return self.gram_logs[n][known].mean(axis=0)
        return np.zeros(len(self.languages))


class Rows(dict):
    """Row of each word in a matrix of log frequencies; unseen words get rows behind the model's, up to a bound."""

    def __init__(self, model: Model) -> None:
        super().__init__(model.words)
        self.model, self.base = model, len(model.words)
        self.at = self.base
        self.logs = np.vstack([model.word_logs, np.zeros((_REMEMBERED, len(model.languages)))])

    def __missing__(self, word: str) -> int:
        if self.at == len(self.logs):  # longer than any memory: make room, rows in use stay valid as they are copied
            self.logs = np.vstack([self.logs, np.zeros((_REMEMBERED, self.logs.shape[1]))])
        self.logs[self.at] = self.model.backed_off(word)
        self[word] = self.at
        self.at += 1
        return self[word]

    def forget(self) -> None:
        """Between texts: drop unseen words once there are too many."""
        if self.at - self.base > _REMEMBERED:
            self.clear()
            self.update(self.model.words)
            self.at = self.base
            self.logs = self.logs[:self.base + _REMEMBERED]


def judge(text: str | None, rows: Rows) -> tuple[str, float]:
    words = words_of(text)
    if not words or not rows.model.languages:
        return NONE, 0.0
    places = list(map(rows.__getitem__, words))
    logs = rows.logs[places].sum(axis=0)
    best = int(np.argmax(logs))
    return rows.model.languages[best], float(1.0 / np.exp(logs - logs[best]).sum())


def taught(docs: DataFrame, bound: int, parts: int, kept_back: int) -> DataFrame:
    """(lang, text) of at most ``bound`` ids of each language."""
    given = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), parts, kept_back)).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = given.withColumn("_first", first).where(F.col("_first") <= bound).select("doc_id", "lang")
    texts = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull())
    # One text for an id, so that a repeated id is not counted over and over.
    return texts.join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) from (lang, text), counted inside tasks before they are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            langs, words = zip(*seen, strict=True) if seen else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["lang", "word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                name = lang.as_py()
                seen.update((name, w) for w in words_of(text.as_py()))
                if len(seen) > _FLUSH:
                    yield flushed()
                    seen.clear()
        yield flushed()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame, key: str, most: int, languages: list[str], totals: dict[str, float]) -> tuple[dict[str, int], np.ndarray]:
    """The ``most`` commonest keys and their smoothed log frequencies per language."""
    wide = counts.groupBy(key).agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}")
                                     for i, lang in enumerate(languages)], F.sum("n").alias("n"))
    # Fewer than ``most`` keys are as common as the count that is looked for: counts of counts find it. Keys of the first
    # count that does not fit whole are taken in their own order.
    sizes = wide.groupBy("n").agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("n")).limit(most).collect()
    have, tie = 0, None
    for row in sizes:
        if have + row["keys"] > most:
            tie = row.n
            break
        have += row["keys"]
    kept = wide if tie is None else wide.where(F.col("n") > tie).unionByName(wide.where(F.col("n") == tie).orderBy(key).limit(most - have))
    kept = kept.toPandas().sort_values(key)  # at most ``most``
    n = kept[[f"n{i}" for i in range(len(languages))]].to_numpy(float)
    logs = np.log((n + 0.1) / (np.array([totals[x] for x in languages]) + 0.1 * (len(kept) + 1)))
    return {k: i for i, k in enumerate(kept[key])}, logs


def fit(docs: DataFrame, bound: int = FIT_ROWS, parts: int = FOLDS, kept_back: int = KEPT_BACK) -> Model:
    words = cut_lineage(word_counts(taught(docs, bound, parts, kept_back)))
    totals = {r.lang: float(r.n) for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {n: {} for n in LENGTHS}, {n: np.zeros((0, 0)) for n in LENGTHS})
    index, logs = _table(words, "word", MOST_WORDS, languages, totals)
    grams, gram_logs = {}, {}
    for n in LENGTHS:
        marked = F.concat(F.lit("^"), "word", F.lit("$")) if n > 1 else F.col("word")
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))
        counts = words.select("lang", "n", F.explode(pieces).alias("gram")).where(F.length("gram") == n).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        counts = cut_lineage(counts)
        sums = {r.lang: float(r.n) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        grams[n], gram_logs[n] = _table(counts, "gram", MOST_GRAMS, languages, {x: sums.get(x, 0.0) for x in languages})
    return Model(languages, index, logs, grams, gram_logs)


def predicted(docs: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, bound))

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = Rows(sent.value)
        for text in texts:
            out = []
            for t in text:
                out.append(judge(t, rows))
                rows.forget()
            yield pd.DataFrame(out, columns=["lang_pred", "score"]).astype({"lang_pred": "object", "score": "float64"})

    return docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, KEPT_BACK).alias("held_out"), judged(F.col("text")).alias("_j")).select(
        "doc_id", "held_out", "_j.lang_pred", "_j.score")
