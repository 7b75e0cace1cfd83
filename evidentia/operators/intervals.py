"""Joins of ranges that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(start: Column, stop: Column, width: int) -> Column:
    """Numbers of the bins of `width` that a range reaches into; an empty range is where it starts."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, stop - 1) / width))


def bin_width(*sides: DataFrame) -> int:
    """Twice the mean length of the ranges (start, stop) of both sides: a range reaches into two bins or so."""
    means = [side.agg(F.avg(F.greatest(F.lit(1), F.col("stop") - F.col("start")))).first()[0] for side in sides]
    return max(1, round(2 * max(m or 1 for m in means)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """(keys, left, right): every pair of ranges of one key with left.start < right.stop and right.start < left.stop, as structs of each side's columns.

    Ranges (start, stop, whole numbers) are dealt into bins of `width`, long ones into several; ranges of one bin are joined on (keys, bin), and a
    pair is given in the first bin that both reach, so it comes once. Hot keys spread over their bins; many ranges in one bin are a join key
    that the engine splits when it is large. Rows with a null key, start or stop overlap with nothing; repeated rows give repeated pairs.
    """
    width = width or bin_width(left, right)

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.where(F.col("start").isNotNull() & F.col("stop").isNotNull())
        start, stop = F.col("start").cast("long"), F.col("stop").cast("long")
        return rows.select(*keys, F.struct(*rows.columns).alias(name), F.floor(start / width).alias(f"{name}_first"), F.explode(_bins(start, stop, width)).alias("bin"))

    met = side(left, "left").join(side(right, "right"), [*keys, "bin"])
    once = F.col("bin") == F.greatest("left_first", "right_first")
    return met.where(once & (F.col("left.start") < F.col("right.stop")) & (F.col("right.start") < F.col("left.stop"))).select(*keys, "left", "right")
