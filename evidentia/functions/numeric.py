"""Scalar functions over numbers, vectors and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up at `digits` decimals, by floor, so that every engine gives the same number."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def quantize(a: Column | str) -> Column:
    """A vector as signed 8-bit levels of its largest magnitude."""
    top = F.greatest(F.aggregate(F.transform(a, lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda m, x: F.greatest(m, x)), F.lit(1e-12))
    return F.transform(a, lambda x: F.floor(x.cast("double") * 127 / top + 0.5).cast("int"))


def windows(length: Column, size: int, overlap: int) -> Column:
    """array<struct<start, stop>> of sliding windows; the last is clipped, none starts once one has reached the end."""
    step = size - overlap
    count = F.when(length <= 0, 0).otherwise(F.when(length <= size, 1).otherwise(1 + F.ceil((length - size) / F.lit(step))))
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, length.cast("int")).alias("stop")))


def scoring_windows(length: Column, limit: int = 512, size: int = 480, overlap: int = 64) -> Column:
    """One window up to `limit`, else sliding windows of `size`."""
    return F.when(length <= limit, windows(length, limit, 0)).otherwise(windows(length, size, overlap))


def merge_intervals(intervals: Column, gap: int = 0) -> Column:
    """Sorted union of array<struct<start, stop>>; intervals at most `gap` apart merge (0: touching ones, 1: neighbouring lines)."""
    ordered = F.array_sort(intervals)

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (x["start"] <= last["stop"] + gap), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(done, F.array(x)))

    # element_at of an empty array is never read: size is tested first
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda d, x: F.when(F.size(d) == 0, F.array(x)).otherwise(step(d, x)))


def intervals_length(intervals: Column) -> Column:
    return F.aggregate(merge_intervals(intervals), F.lit(0), lambda s, x: s + x["stop"] - x["start"])


def common_prefix(paths: Column) -> Column:
    """Common prefix of an array of arrays; the first array if nothing is common."""
    first = F.get(paths, F.lit(0))
    both = F.aggregate(paths, first, lambda a, b: F.slice(a, F.lit(1), F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")))["n"]))
    return F.when(F.size(both) > 0, both).otherwise(first)
