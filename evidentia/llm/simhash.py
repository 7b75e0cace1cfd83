"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most `2 * half` bits have a common variant within `half`
bits of each. So every distinct fingerprint emits its ball of variants, equal variants meet,
and fingerprints that met are linked. Whole variants are not shuffled one by one: what is
shuffled is, for each value that the lowest bits of a fingerprint's variants can take, one
entry under that value. The variants' remaining bits are enumerated where entries of one value
have met. Each variant of each fingerprint so exists in exactly one bucket, and the shuffle
carries C(b,0)+C(b,1)+C(b,2) entries of 8 bytes a fingerprint (37 at b=8) instead of 2,081.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import durable, forget, tidy
from evidentia.llm.components import components
from evidentia.llm.components import forest as _forest

BITS, SEED = 64, 42
#: Fingerprints that a bucket should hold before its neighbours' entries, variants expanded at once, and pairs kept before they are reduced to a forest.
BUCKET, EXPAND, PAIRS = 1024, 1 << 19, 1 << 17
#: Shingles hashed and counted at once, so that very long texts need bounded memory.
BLOCK = 1 << 16


def fingerprint_of(text: str | None, size: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; zero without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() is A-Z, split() the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[: 1 - size], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprint(text: Column | str, size: int = 4) -> Column:
    """The SimHash of a text column as a bigint with the same 64 bits; null counts as empty."""

    @F.pandas_udf("long")
    def fingerprints(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in blocks:
            yield pd.Series(np.fromiter((fingerprint_of(t, size) for t in s), np.uint64, len(s)).view(np.int64))

    return fingerprints(text)


@lru_cache(maxsize=256)
def _flips(low: int, high: int, most: int) -> np.ndarray:
    """All masks over bits low..high-1 with at most `most` bits set."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(low, high), k)], np.uint64)


def _ball(bits: int, most: int) -> int:
    return sum(1 if k == 0 else bits if k == 1 else bits * (bits - 1) // 2 for k in range(most + 1))


class _Links:
    """Pairs of n numbers, reduced to a forest that connects the same ones whenever they are many: a tight group of copies meets in very many variants."""

    def __init__(self, prints: np.ndarray, most: int) -> None:
        self.prints, self.most, self.n, self.size, self.parts = prints, most, len(prints), 0, []

    def add(self, pairs: np.ndarray) -> None:
        """Pairs count once they are verified to differ in at most `most` bits."""
        pairs = pairs[np.bitwise_count(self.prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]) <= self.most]
        self.parts.append(pairs)
        self.size += len(pairs)
        if self.size > max(PAIRS, 4 * self.n):
            label = self.labels()
            linked = np.flatnonzero(label != np.arange(self.n))
            self.parts = [np.stack([label[linked], linked], 1)]
            self.size = len(linked)

    def labels(self) -> np.ndarray:
        """The smallest number connected to each."""
        return _forest(self.n, np.concatenate(self.parts)) if self.parts else np.arange(self.n)


def _meet(origin: np.ndarray, value: np.ndarray, left: np.ndarray, low: int, found: _Links) -> None:
    """Pairs of origins with an equal variant; `left` bits may still be flipped among the bits from `low` on.

    Each is within its own flips of the variant, so the two are within twice as many of each other.
    """
    counts = np.bincount(left, minlength=3)
    if len(origin) < 2:
        return
    if low < BITS and sum(int(n) * _ball(BITS - low, r) for r, n in enumerate(counts)) > EXPAND:  # deal them out by the next bits first
        step = min(4, BITS - low)
        o, v, r = [], [], []
        for mask in _flips(low, low + step, 2):
            n = int(mask).bit_count()
            fit = left >= n
            o.append(origin[fit])
            v.append(value[fit] ^ mask)
            r.append(left[fit] - n)
        o, v, r = map(np.concatenate, (o, v, r))
        part = (v >> np.uint64(low)) & np.uint64((1 << step) - 1)
        for p in range(1 << step):
            fit = part == p
            _meet(o[fit], v[fit], r[fit], low + step, found)
        return
    os, vs = [], []
    for r in range(3):
        if counts[r]:
            masks, fit = _flips(low, BITS, r), left == r
            vs.append((value[fit][:, None] ^ masks[None, :]).ravel())
            os.append(np.repeat(origin[fit], len(masks)))
    v, o = np.concatenate(vs), np.concatenate(os)
    order = np.argsort(v)
    v, o = v[order], o[order]
    same = v[1:] == v[:-1]
    if same.any():
        a, b = o[:-1][same], o[1:][same]
        pairs = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b))
        found.add(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1))


def link_bucket(prints: np.ndarray, bucket: int, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints whose variants have `bucket` as their lowest bits, as few as keep them connected."""
    prints = np.unique(prints)
    used = np.bitwise_count((prints ^ np.uint64(bucket)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = (prints & ~np.uint64((1 << bits) - 1)) | np.uint64(bucket)
    found = _Links(prints, 2 * half)
    _meet(np.arange(len(prints)), value, half - used, bits, found)
    label = found.labels()
    linked = label != np.arange(len(prints))
    return prints[linked], prints[label[linked]]


def ball_links(prints: DataFrame, n_prints: int, half: int = 2) -> DataFrame:
    """Links (a, b) that connect every two fingerprints of `prints` (column fp, distinct) within 2 * half bits.

    n_prints sets how many bits deal the variants out, so that a bucket's size stays the same at any scale.
    """
    if half > 2:
        raise ValueError("balls of more than two bits are not enumerated")
    bits = min(28, max(4, (n_prints // BUCKET).bit_length()))

    def emit(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = _flips(0, bits, half)
        for block in blocks:
            fp = block["fp"].to_numpy(np.int64).view(np.uint64)
            buckets = ((fp & np.uint64((1 << bits) - 1))[None, :] ^ masks[:, None]).ravel().astype(np.int64)
            order = np.argsort(buckets, kind="stable")
            buckets, entries = buckets[order], np.tile(fp, len(masks))[order]
            heads = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
            tails = [*heads[1:].tolist(), len(buckets)]
            yield pd.DataFrame({"bucket": buckets[heads], "prints": [entries[a:b].tobytes() for a, b in zip(heads.tolist(), tails, strict=True)]})

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = link_bucket(np.frombuffer(b"".join(rows["prints"]), np.uint64), int(key[0]), bits, half)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    buckets = prints.select("fp").mapInPandas(emit, "bucket long, prints binary")
    return buckets.groupBy("bucket").applyInPandas(meet, "a long, b long").distinct()


@tidy
def near_duplicates(docs: DataFrame, size: int = 4, half: int = 2) -> DataFrame:
    """Per row of `docs`: doc_id, fp (bigint) and component_id, the smallest doc_id reachable by links of at most 2 * half bits.

    Null and empty texts have fingerprint zero, which links like any other. A null doc_id is never
    a component_id unless no row of the component has another. Repeated rows stay; an empty table
    gives an empty result; other columns are ignored. Equal fingerprints are one node, however many rows share it.
    """
    prints = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text").cast("string"), size).alias("fp")))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = durable(ball_links(nodes, nodes.count(), half))
    roots = components(links)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = durable(named.join(smallest, "root").select("fp", "component_id"))
    forget(nodes, links, roots)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
