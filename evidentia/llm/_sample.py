"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None, seed: int = 5) -> DataFrame:
    """About `most` rows (doc_id, text, label) at most, one for each chosen id, chosen by a hash of their ids; null ids and labels are left out.

    The chosen labels are few by construction, so they are broadcast. Of several texts of one id the smallest is taken,
    of several labels the largest.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows if where is None else rows.where(where)
    share = min(1.0, most / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 30))
    chosen = rows.where(draw < F.lit(int(share * (1 << 30)))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(draw, "doc_id").limit(2 * most)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
