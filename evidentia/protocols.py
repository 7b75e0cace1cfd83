"""Extension points: what a caller can put in place of the built-in analyzer, encoder, reranker and chunker.

All are functions of columns or DataFrames, so that built-in expressions and Arrow functions serve alike.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import retrieval as R


class Analyzer(Protocol):
    def __call__(self, text: Column | str) -> Column:
        """array<string> of a text's tokens."""


class Encoder(Protocol):
    def __call__(self, text: Column | str) -> Column:
        """array<float> of a text, of unit length."""


class Reranker(Protocol):
    def __call__(self, query: Column | str, text: Column | str) -> Column:
        """double: how well a text answers a query."""


class Chunker(Protocol):
    def __call__(self, units: DataFrame) -> DataFrame:
        """Fragments (doc_id, chunk, ordinal, section, parent, unit_start, unit_stop, chunk_start) of units."""


def dense_search(items: DataFrame, queries: DataFrame, encoder: Encoder, k: int, instruction: str = "") -> DataFrame:
    """A dense ranking of texts: items (item_id, window_id, text), one or more windows each, and queries (query_id, text), before which `instruction` is put.

    An item's score is its best window's.
    """
    window = F.struct("item_id", "window_id")
    nobody = F.lit(None).cast(items.schema["window_id"].dataType).alias("window_id")  # a query is no item, so none is left out
    asked = queries.select(F.struct(F.col("query_id").alias("item_id"), nobody).alias("query_id"), encoder(F.concat(F.lit(instruction), F.col("text"))).alias("vector"))
    scores = R.dense_scores(items.select(window.alias("item_id"), encoder("text").alias("vector")), asked)
    best = scores.groupBy(F.col("query_id.item_id").alias("query_id"), F.col("item_id.item_id").alias("item_id")).agg(F.max("score").alias("score"))
    return R.top_k(best, k)


def rerank(ranking: DataFrame, queries: DataFrame, windows: DataFrame, reranker: Reranker, pool: int, tail: bool = False) -> DataFrame:
    """A ranking's first `pool` items in order of a reranker's best score over their windows (item_id, window_id, text)."""
    head = ranking.where(F.col("rank") <= pool).select("query_id", "item_id").join(R.near(queries.select("query_id", F.col("text").alias("query"))), "query_id").join(windows, "item_id")
    scores = head.select("query_id", "item_id", reranker("query", "text").alias("score")).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return R.rerank(ranking, scores, pool, tail)
