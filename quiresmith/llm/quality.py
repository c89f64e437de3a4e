"""Quality rules: a decision list learned by sequential covering, emitted as Spark conditions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import Shelf, map_texts, sample_rows

#: Labelled documents that rules are learned from at most (a random sample of them).
MAX_TRAIN_DOCS = 50_000
#: Share of low-quality documents among those that a rule takes from the pruning part, at least.
MIN_PRECISION = 0.95

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = {c: None for c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)}


def statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct_words, n_stops, n_upper, n_digits.

    Words are runs of characters other than space and U+0009-U+000D. n_repeat_words counts the words
    that stand in a three-word window which occurs twice or more, the first occurrence included.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0  # one past the last word counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeats += i + 3 - max(end, i)
                    end = i + 3
    lines = [line for line in text.split("\n") if line.translate(_BLANKS)]
    return (
        n,
        len(text.translate(_BLANKS)),
        len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        len(set(words)),
        sum(map(text.count, ".!?")),
        sum(map(str.isupper, text)),
        sum(map(str.isdigit, text)),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_stops", "n_upper", "n_digits")
FIELDS = [T.StructField(n, T.LongType()) for n in NAMES]
#: What rules test: each is a statistic or a share, as (name, numerator, denominator or None).
MEASURES = (
    ("words", "n_words", None),
    ("word_length", "word_chars", "n_words"),
    ("symbol_share", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
    ("distinct_share", "n_distinct_words", "n_words"),
    ("stop_share", "n_stops", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
)


def measurer() -> Callable:
    def run(texts):
        return dict(zip(NAMES, map(list, zip(*map(statistics, texts), strict=True)), strict=True))

    return run


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the statistics of each whole text, each long). Null texts count as empty."""
    return map_texts(docs, [F.col(id_col).alias("doc_id")], F.col(text_col), measurer, FIELDS)


def measure_column(name: str) -> Column:
    _, top, bottom = next(m for m in MEASURES if m[0] == name)
    return F.col(top).cast("double") if bottom is None else F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Limits:
    """How rules are learned: ``precision``, the share of low-quality documents among those that a rule
    takes from the pruning part, at least; ``cover``, documents that it takes from the growing part, at
    least; ``rules`` of a list and ``conditions`` of a rule, at most; ``cuts``, thresholds tried per
    statistic (its quantiles). They bound the model, never the documents that it judges."""

    precision: float = MIN_PRECISION
    cover: int = 8
    rules: int = 24
    conditions: int = 4
    cuts: int = 32


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool  # above: value > cut, else value <= cut
    cut: float

    def column(self) -> Column:
        c = measure_column(self.measure)
        return c > self.cut if self.above else c <= self.cut

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, [m[0] for m in MEASURES].index(self.measure)]
        return v > self.cut if self.above else v <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Sequence[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, limits: Limits) -> list[Condition]:
    """Add the condition of the best information gain until only low-quality documents are taken."""
    rule: list[Condition] = []
    taken = np.ones(len(x), bool)
    while len(rule) < limits.conditions and (bad & taken).sum() and (~bad & taken).sum():
        p0, n0 = (bad & taken).sum(), (~bad & taken).sum()
        best, gain = None, 1e-9
        for j, (name, _, _) in enumerate(MEASURES):
            v = x[taken, j]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, limits.cuts + 1)[:-1])):
                over = v > cut
                for above, inside in ((True, over), (False, ~over)):
                    p = (bad[taken] & inside).sum()
                    n = inside.sum() - p
                    if p < limits.cover:
                        continue
                    g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain = Condition(name, above, float(cut)), g
        if best is None:
            break
        # halfway between the values on both sides: unseen documents near the good ones stay good
        v = x[taken, [m[0] for m in MEASURES].index(best.measure)]
        best = Condition(best.measure, best.above, float((v[v <= best.cut].max() + v[v > best.cut].min()) / 2))
        rule.append(best)
        taken &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Drop final conditions while (p - n) / (p + n) over the pruning part does not fall."""

    def worth(r: Sequence[Condition]) -> float:
        inside = _holds(r, x)
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7, limits: Limits | None = None) -> list[Rule]:
    """Ordered rules that take low-quality documents: grown on two thirds, pruned on one third.

    Each accepted rule removes what it takes. A rule of less than the precision of ``limits`` on the
    pruning part ends the list, as do its other limits.
    """
    limits = limits or Limits()
    rules: list[Rule] = []
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    while len(rules) < limits.rules:
        grow, prune = left & part, left & ~part
        if bad[grow].sum() < limits.cover or not bad[prune].sum():
            break
        rule = _grow(x[grow], bad[grow], limits)
        if not rule:
            break
        rule = _prune(rule, x[prune], bad[prune])
        inside = _holds(rule, x)
        p, n = (bad & inside & prune).sum(), (~bad & inside & prune).sum()
        if not p or p / (p + n) < limits.precision:
            break
        rules.append(tuple(rule))
        left &= ~inside
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that takes a row, else null."""
    out = None
    for i, rule in enumerate(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_DOCS, limits: Limits | None = None) -> list[Rule]:
    """Rules from measured documents that have a label (doc_id, quality 0 or 1; 0 is low).

    The bounded sample of labelled rows is collected; everything else about a document stays in
    Spark. Labels that are null or name no document are ignored, as are documents whose labels
    disagree. Documents that the base rule rejects teach nothing.
    """
    marked = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    marked = sample_rows(marked, most, F.col("doc_id"), seed=8)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).where("quality = high")
    rows = (
        stats.where(~base_failed())
        .join(marked, "doc_id")
        .select("doc_id", (F.col("quality") == 0).alias("bad"), *(measure_column(m[0]).alias(m[0]) for m in MEASURES))
        .dropDuplicates(["doc_id"])
        .toPandas()
        .sort_values("doc_id")
    )
    return learn(rows[[m[0] for m in MEASURES]].to_numpy(float), rows["bad"].to_numpy(bool), limits=limits)


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN_DOCS, limits: Limits | None = None
) -> DataFrame:
    """(doc_id, statistics, base_failed, rule, kept) for every row of ``docs``.

    Low: fewer than 50 words, or more than half of them in repeated windows (base_failed), else
    taken by a learned rule, whose number is in ``rule``. The rules are learned from at most about
    ``most`` labelled documents under ``limits``; every document is judged. Without usable labels no rule is learned
    and the base decides alone. A null text counts as empty and fails the base. Repeated rows and
    null ids are judged like any others; other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    stats = Shelf(docs.sparkSession, "quality").put(measure(docs, id_col, text_col))
    rules = fit(stats, labels, most, limits)
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
