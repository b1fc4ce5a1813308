"""Quality rules: decision lists learned by sequential covering over document statistics.

Statistics of every text are counted once. On labelled rows, rules are grown one condition at a time: the threshold
condition that most raises the weighted gain of the rule is added until the rule covers no good row of its growing
half, or gains nothing. A rule is then pruned from its end on the other half, kept if it holds its precision there, and the
rows that it covers are taken out before the next rule is grown. The list is emitted as one ordered Spark
conditional: the first rule that fires rejects a row, a row that no rule covers is kept.

The list is fitted on at most ``FIT_ROWS`` labelled rows (taken in the order of their ids' hashes); statistics and verdicts
cover every row and whole texts.

Defined cases: a null or wordless text has zero statistics and fails the base rule; without labelled rows, or with one label
only, the list is empty and the base rule decides alone; repeated rows each get a verdict; ties between conditions go
to the first statistic by name, then to the lower threshold; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtape.llm.common import SPACE_WORDS, free_name, labelled_ids
from playtape.session import cut_lineage

WORDS = re.compile(SPACE_WORDS)
SYMBOLS = re.compile(r"[#*$%&|<>]")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
MARKS = re.compile(r"[!?]")
DIGITS = re.compile(r"[0-9]")
REPEAT = 5  # words in a window that may be found again
FEW_WORDS = 10
REPEAT_PERCENT = 20
FIT_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_digits", "n_distinct")


def repeated_words(words: list[str]) -> int:
    """Words inside windows of ``REPEAT`` words that are found twice or more in the text, the first one included."""
    n = len(words) - REPEAT + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Two names make one number, which is named anew: no number is over the square of the words.
    base = len(number)
    _, twos = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
    _, fours = np.unique(twos[:-2] * len(words) + twos[2:], return_inverse=True)
    _, windows = np.unique(fours[:n] * base + ids[4:], return_inverse=True)
    often = np.bincount(windows)[windows] > 1
    if not often.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + REPEAT, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    words = WORDS.findall(text) if text else []
    if not words:
        return (0, 0, len(SYMBOLS.findall(text or "")), *[0] * (len(COUNTS) - 3))
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return (
        len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(CAPITALS.findall(text)), len(MARKS.findall(text)), len(DIGITS.findall(text)), len(set(words)),
    )


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, counts): the statistics of every text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts_of(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows.T)], names=["doc_id", *COUNTS])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < FEW_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def ratios(counts: dict[str, Column]) -> dict[str, Column]:
    """The statistics that conditions are put on."""
    c = {k: v.cast("double") for k, v in counts.items()}
    some = {k: F.greatest(c[k], F.lit(1.0)) for k in ("n_words", "word_chars", "n_lines")}
    return {
        "capitals_per_char": c["n_capitals"] / some["word_chars"],
        "chars_per_word": c["word_chars"] / some["n_words"],
        "digits_per_char": c["n_digits"] / some["word_chars"],
        "distinct_per_word": c["n_distinct"] / some["n_words"],
        "dup_lines_per_line": c["n_dup_lines"] / some["n_lines"],
        "marks_per_word": c["n_marks"] / some["n_words"],
        "repeats_per_word": c["n_repeat_words"] / some["n_words"],
        "symbols_per_word": c["n_symbols"] / some["n_words"],
        "words": c["n_words"],
        "words_per_line": c["n_words"] / some["n_lines"],
    }


@dataclass(frozen=True)
class Condition:
    """``statistic > threshold`` if ``above``, else ``statistic <= threshold``."""

    statistic: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.statistic]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, stats: dict[str, Column]) -> Column:
        x = stats[self.statistic]
        return x > self.threshold if self.above else x <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[float, Condition | None]:
    """The condition with the greatest gain: covered bad rows times the growth of their log share."""
    p0, n0 = bad.sum(), (~bad).sum()
    before, best, chosen = np.log2(p0 / (p0 + n0)), 0.0, None
    for name, x in table.items():
        at = np.searchsorted(cuts[name], x, side="left")  # x <= cuts[at]
        pos = np.bincount(at[bad], minlength=len(cuts[name]) + 1).cumsum()[:-1]
        neg = np.bincount(at[~bad], minlength=len(cuts[name]) + 1).cumsum()[:-1]
        for above, p, n in ((False, pos, neg), (True, p0 - pos, n0 - neg)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -np.inf)
            i = int(np.argmax(gain)) if len(gain) else -1
            if i >= 0 and gain[i] > best + 1e-9:
                best, chosen = float(gain[i]), Condition(name, above, float(cuts[name][i]))
    return best, chosen


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    """Share by which covered bad rows outweigh covered good ones."""
    hit = _covers(rule, table)
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn_list(table: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray, precision: float = 0.95,
               least: int = 5, longest: int = 3, most: int = 12, bins: int = 64) -> list[Rule]:
    """Sequential covering: rules that reject bad rows, each grown on ``grow`` rows and pruned on the others."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    cuts = {k: np.unique(np.quantile(x, np.linspace(0, 1, bins + 1))) if len(x) else x for k, x in table.items()}
    # Rare junk lies above most quantiles: thresholds along the bad rows alone as well.
    cuts = {k: np.unique(np.concatenate([c, np.quantile(table[k][bad], np.linspace(0, 1, bins + 1))])) if bad.any() else c
            for k, c in cuts.items()}
    while len(rules) < most and (bad & left & grow).sum() >= least:
        rule: Rule = ()
        inside = left & grow
        while len(rule) < longest and (~bad & inside).any() and (bad & inside).any():
            _, condition = _best_condition({k: x[inside] for k, x in table.items()}, bad[inside], cuts)
            if condition is None:
                break
            rule += (condition,)
            inside &= condition.holds(table)
        pruning = left & ~grow
        rest, judged = {k: x[pruning] for k, x in table.items()}, bad[pruning]
        heads = [rule[:i] for i in range(1, len(rule) + 1)]
        if not heads:
            break
        rule = max(heads, key=lambda r: _worth(r, rest, judged))  # the shortest on a tie
        hit = _covers(rule, rest)
        if hit.sum() < least or judged[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, table)
    return rules


def fit(stats: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> list[Rule]:
    """A list from the statistics (doc_id, counts) of labelled rows that pass the base rule."""
    ids = labelled_ids(labels, "quality", bound)
    passed = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    named = passed.select("doc_id", *[v.alias(k) for k, v in ratios({c: F.col(c) for c in COUNTS}).items()])
    each = named.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(*[F.min(c).alias(c) for c in named.columns[1:]])
    rows = each.withColumn("_half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).toPandas()  # at most ``bound``
    rows = rows.sort_values("doc_id")
    table = {k: rows[k].to_numpy(float) for k in named.columns[1:]}
    return learn_list(table, rows["y"].to_numpy() == 0, rows["_half"].to_numpy(bool))


def verdict(rules: list[Rule], counts: dict[str, Column]) -> Column:
    """Number of the first rule that rejects a row, counted from one: an ordered conditional. Zero: none does."""
    stats, out = ratios(counts), F.lit(0)
    for i in range(len(rules) - 1, -1, -1):
        fires = F.lit(True)
        for condition in rules[i]:
            fires = fires & condition.column(stats)
        out = F.when(fires, F.lit(i + 1)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """Counts, the base rule and the verdict for every document."""
    stats = cut_lineage(counted(docs))
    rules = fit(stats, labels, bound)
    counts = {c: F.col(c) for c in COUNTS}
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules, counts)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def counts_column(text: Column) -> Column:
    """``COUNTS`` of a text as a struct."""
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame.from_records([counts_of(t) for t in texts], columns=list(COUNTS)).astype("int64")

    return count(text)


def kept_documents(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """The documents, all columns, that pass the base rule and the list."""
    labelled = docs.join(F.broadcast(labelled_ids(labels, "quality", bound)), "doc_id", "left_semi")
    rules = fit(counted(labelled), labels, bound)
    name = free_name(docs, "_counts")
    counts = {c: F.col(f"{name}.{c}") for c in COUNTS}
    good = ~base_failed(counts["n_words"], counts["n_repeat_words"]) & (verdict(rules, counts) == 0)
    return docs.withColumn(name, counts_column(F.col("text"))).where(good).select(*[f"`{c}`" for c in docs.columns])
