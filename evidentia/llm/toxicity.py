"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashes of its words, of pairs of words next to each other and with one
word between, and of the first letters of its words, so that inflected forms share a feature; each counts once.
Per-coordinate rates adapt to how often a feature was seen, and the L1 term keeps the weight of a
feature at zero until its evidence outweighs it, so what is broadcast is a short list of weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import durable, forget, give_back
from evidentia.llm._sample import labelled

#: Labelled documents trained on at most, hash bits, letters of the prefix features, passes.
TRAIN_DOCS, HASH_BITS, STEMS, PASSES = 8000, 20, (4, 5), 5
#: Bytes of the sample's features that are in the driver at once, about.
PART_BYTES = 8 << 20
#: FTRL-proximal: rate, its smoothing, L1, L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
#: Folds of crc32(doc_id as text); the first is held out.
FOLDS = 5
_MASK = (1 << HASH_BITS) - 1
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_"
_MEMORY: dict[bytes, tuple[int, ...]] = {}
_REMEMBERED = 250_000


def _hashes(word: bytes) -> tuple[int, ...]:
    core = word.strip(_STRIP) or word
    text = core.decode("utf-8", "surrogatepass")
    stems = (zlib.crc32(b"^" + text[:k].encode("utf-8", "surrogatepass")) if len(text) >= k else 0 for k in STEMS)
    return (zlib.crc32(core), *stems)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text, ascending; the last number of all, always there, is the constant."""
    return np.unique(np.concatenate(([_MASK], *_parts(text))))


def _parts(text: str | None) -> list[np.ndarray]:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return []
    if len(_MEMORY) > _REMEMBERED:
        _MEMORY.clear()
    rows = []
    for w in words:
        h = _MEMORY.get(w)
        if h is None:
            h = _MEMORY[w] = _hashes(w)
        rows.append(h)
    h = np.array(rows, np.uint64)
    one, mult = h[:, 0], np.uint64(0x9E3779B97F4A7C15)
    two = lambda gap, salt: ((one[:-gap] * mult ^ one[gap:] + np.uint64(salt)) * mult) >> np.uint64(64 - HASH_BITS)
    parts = [(one * mult) >> np.uint64(64 - HASH_BITS)]
    for i in range(1, h.shape[1]):
        stem = h[:, i][h[:, i] > 0]
        parts.append((stem * mult + np.uint64(i)) >> np.uint64(64 - HASH_BITS))
    parts += [two(gap, gap) for gap in (1, 2) if len(one) > gap]
    return [p.astype(np.int64) for p in parts]


@dataclass(frozen=True)
class Weights:
    """The features with a weight, ascending, and their weights."""

    numbers: np.ndarray
    values: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << HASH_BITS, np.float64)
        out[self.numbers] = self.values
        return out


def fit(rows: Callable[[], Iterable[tuple[np.ndarray, int]]], passes: int = PASSES) -> Weights:
    """Weights from (features, label) rows, asked for once a pass, in their order; the same rows give the same weights. No rows score all alike, low."""
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == _MASK, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    seen = False
    for _ in range(passes):
        for i, y in rows():
            seen = True
            i = i.astype(np.int64)
            w = weights(i)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - y
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    every = np.arange(1 << HASH_BITS)
    w = weights(every)
    if not seen:
        w[_MASK] = -2.0
    keep = np.flatnonzero(w)
    return Weights(keep, w[keep])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Weights:
    """Weights from labelled documents (label column toxic) outside the held-out fold, at most about `most` of them."""

    @F.pandas_udf("binary")
    def packed(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in blocks:
            yield pd.Series([features(t).astype("<u4").tobytes() for t in s], dtype=object)
        _MEMORY.clear()
        give_back()

    seen = labelled(docs, labels, "toxic", most, where=F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    packs = durable(seen.select(F.crc32(F.col("doc_id").cast("string")).alias("at"), "doc_id", "label", packed(F.col("text")).alias("f")))
    try:
        parts = -(-(packs.agg(F.sum(F.length("f"))).first()[0] or 0) // PART_BYTES)
        # the driver holds the model and one part of the sample at a time, whatever its texts' lengths
        part = lambda i: packs.where(F.floor(F.col("at") * parts / (1 << 32)) == i).collect()
        rows = lambda: (r for i in range(parts) for r in sorted(part(i), key=lambda r: (r["at"], r["doc_id"])))
        return fit(lambda: ((np.frombuffer(r["f"], "<u4"), int(r["label"])) for r in rows()))
    finally:
        forget(packs)


def score(text: Column | str, weights: Weights) -> Column:
    """Probability of the label for a text column; null counts as empty."""

    @F.pandas_udf("double")
    def scores(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = weights.table()
        for s in blocks:
            out = []
            for text in s:
                total = float(table[_MASK])
                if parts := _parts(text):
                    numbers = np.concatenate(parts)
                    used = numbers[table[numbers] != 0]
                    if len(used):
                        used = np.unique(used)
                        total += float(table[used[used != _MASK]].sum())
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, total)))))
            yield pd.Series(out, dtype="float64")
        _MEMORY.clear()
        give_back()

    return scores(text)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with score and predicted, which replace columns of these names.

    Null and empty texts get the constant's score; rows stay as they are, repeated ones too; an empty table stays empty.
    """
    weights = train(docs, labels)
    return docs.drop("score", "predicted").withColumn("score", score(F.col("text").cast("string"), weights)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return judge(docs.select("doc_id", "text"), labels).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"), "score", "predicted")
