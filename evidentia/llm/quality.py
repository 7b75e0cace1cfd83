"""Quality rules: decision lists learned by sequential covering, applied as Spark conditional expressions.

Documents become a few statistics. From labelled statistics, rules that reject are grown one condition
(statistic above or below a threshold) at a time by information gain on two thirds of the rows,
pruned on the other third, and kept while they are right more often than not; each rule
covers what it catches and the next is learned from the rest. The list becomes an ordered chain of
F.when conditions over the statistics' columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._sample import labelled

#: Labelled documents that the rules are learned from at most.
TRAIN_DOCS = 10_000
#: Fixed values of the base rules, and the words in a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Rules in a list, conditions in a rule, thresholds tried for a statistic, least precision and least rows of a rule.
MAX_RULES, MAX_CONDITIONS, CUTS, LEAST_PRECISION, LEAST_ROWS = 12, 4, 64, 0.9, 8
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may test, as expressions over the counted columns.
SHARES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "ends_share": "n_ends / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more, the first one's included."""
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    width = 1
    while width < window:  # numbers for windows of twice the width: exact, without hashing
        step = min(width, window - width)
        _, ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
        width += step
    counts = np.bincount(ids)
    twice = counts[ids] > 1
    if not twice.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The counts of a text, in the order of STATISTICS."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(codes, minlength=256)
    chars = len(codes) - int(kinds[128:192].sum()) - int(kinds[[9, 10, 11, 12, 13, 32]].sum())
    upper = sum(map(str.isupper, text)) if text and not text.isascii() else int(kinds[65:91].sum())
    ends = int(kinds[[33, 46, 63]].sum())
    return (len(words), chars, int(kinds[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, int(kinds[48:58].sum()), ends, len(set(words)))


STATISTICS = [*BASE, "n_lines", "n_upper", "n_digits", "n_ends", "n_distinct"]


def statistics(text: Column | str) -> Column:
    """struct of STATISTICS (long) of a text column; null counts as empty."""

    @F.pandas_udf(", ".join(f"{name} long" for name in STATISTICS))
    def count(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in blocks:
            yield pd.DataFrame([statistics_of(t) for t in s], columns=STATISTICS, dtype="int64")

    return count(text)


@dataclass(frozen=True)
class Condition:
    """statistic > threshold if `above`, else statistic <= threshold."""

    statistic: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] > self.threshold if self.above else x[self.statistic] <= self.threshold

    def column(self) -> Column:
        value = F.expr(SHARES[self.statistic])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Add the condition with the largest FOIL gain until no rejected row is missed or nothing gains."""
    rule: Rule = ()
    inside = np.ones(len(y), bool)
    while len(rule) < MAX_CONDITIONS and not y[inside].all():
        p0, n0 = int(y[inside].sum()), int(inside.sum())
        best, best_gain = None, 1e-9
        for name, at in cuts.items():
            if not len(at):  # one value only
                continue
            v, yes = x[name][inside], y[inside]
            order = np.searchsorted(at, v, side="left")  # v <= at[k] for k >= order
            below_n = np.cumsum(np.bincount(order, minlength=len(at) + 1))[: len(at)]
            below_p = np.cumsum(np.bincount(order, weights=yes, minlength=len(at) + 1))[: len(at)]
            for above, n, p in ((False, below_n, below_p), (True, n0 - below_n, p0 - below_p)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - math.log2(p0 / n0)), -1.0)
                gain[n >= n0] = -1.0
                alike = np.flatnonzero(gain >= gain.max() - 1e-9)  # of thresholds that do alike, the middle one
                k = int(alike[len(alike) // 2])
                if gain[k] > best_gain:
                    best, best_gain = Condition(name, above, float(at[k])), float(gain[k])
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _between(values: np.ndarray) -> np.ndarray:
    """Thresholds in the middle between neighbouring values."""
    return (values[:-1] + values[1:]) / 2


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """The leading conditions that do best on rows the rule was not grown on."""

    def worth(r: Rule) -> float:
        hit = _covered(r, x, len(y))
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: dict[str, np.ndarray], rejected: np.ndarray) -> list[Rule]:
    """Ordered rules that catch rejected rows; the same rows give the same rules. No rejected rows give no rules."""
    rejected = rejected.astype(bool)
    n = len(rejected)
    left, rules = np.ones(n, bool), []
    held = np.arange(n) % 3 == 2
    while len(rules) < MAX_RULES and rejected[left].sum() >= LEAST_ROWS:
        grow, prune = left & ~held, left & held
        part = lambda m: {k: v[m] for k, v in x.items()}
        cuts = {k: np.unique(np.quantile(v[grow], np.linspace(0, 1, CUTS))) for k, v in x.items()} if grow.any() else {}
        extra = {k: np.unique(np.quantile(v[grow & rejected], np.linspace(0, 1, CUTS // 2))) for k, v in x.items()} if (grow & rejected).any() else {}
        cuts = {k: _between(np.union1d(v, extra.get(k, v))) for k, v in cuts.items()}
        rule = _grow(part(grow), rejected[grow], cuts)
        if not rule:
            break
        rule = _prune(rule, part(prune), rejected[prune]) if prune.any() else rule
        hit = _covered(rule, x, n) & left
        if hit.sum() < LEAST_ROWS or rejected[hit].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, else null, as an ordered chain of conditions over STATISTICS' columns."""
    if not rules:
        return F.lit(None).cast("int")
    chain = None
    for i, rule in enumerate(rules):
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        chain = F.when(condition, F.lit(i)) if chain is None else chain.when(condition, F.lit(i))
    return chain


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> list[Rule]:
    """Rules from the documents that `labels` (doc_id, quality 0 or 1) marks, at most about `most` of them."""
    rows = labelled(docs, labels, "quality", most).select("doc_id", "label", statistics(F.col("text").cast("string")).alias("s")).select("doc_id", "label", "s.*")
    got = rows.select("doc_id", "label", *[F.expr(e).cast("double").alias(k) for k, e in SHARES.items()]).toPandas().sort_values(["doc_id", "label", *SHARES]).reset_index(drop=True)
    return learn({k: got[k].to_numpy(float) for k in SHARES}, got["label"].to_numpy() == 0)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rule, the text of the learned rule that rejects.

    Null and empty texts have no words and so fail; repeated rows and null ids stay; other columns are ignored;
    an empty table gives an empty result; without labels no rule is learned and the base rules decide.
    """
    rules = train(docs, labels)
    counted = docs.select("doc_id", statistics(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    number = verdict(rules)
    names = F.array(*[F.lit(" and ".join(map(str, r))) for r in rules]) if rules else F.array().cast("array<string>")
    judged = counted.withColumn("base_failed", failed).withColumn("_rule", number)
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("_rule").isNull()).alias("kept"), F.get(names, F.col("_rule")).alias("rule"))
