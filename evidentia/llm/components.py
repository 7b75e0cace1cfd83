"""Connected components of a link table: parts of bounded size are each reduced to a forest in one task, alternating large-star and small-star steps join what several parts have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import durable, forget

#: Links of a part, about, 16 bytes each.
PART = 1 << 18


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest index linked to each index, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        np.minimum.at(new, label[pairs[:, 0]], low)
        np.minimum.at(new, label[pairs[:, 1]], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contract(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a part as (node, smallest node connected to it within the part)."""
    pairs = [block[["a", "b"]].to_numpy(np.int64) for block in blocks]
    if not sum(map(len, pairs)):
        return
    names, ends = np.unique(np.concatenate(pairs), return_inverse=True)
    label = forest(len(names), ends.reshape(-1, 2))
    linked = label != np.arange(len(names))
    yield pd.DataFrame({"a": names[linked], "b": names[label[linked]]})


def _star(pairs: DataFrame) -> DataFrame:
    """Every pair (node, other) with the smallest node of node's star, itself included."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return pairs.join(least, "node")


def _large(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the smallest node of its star."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return _star(both).where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    star = _star(down)
    moved = star.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(star.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b) but the roots, root being its component's smallest node.

    Links are dealt into even parts of about PART at most, whatever their nodes, and each part is reduced to a forest; one part is done then, without the
    rounds of jobs whose plans and tasks fill the driver. The forests of several parts are joined by star steps: an aggregation, which combines before it shuffles,
    and a join of all links on their node: a hub's links meet in one join key, which the engine's skew handling splits when it is large.
    Links are counted, never collected. Links of a node to itself and repeated links change nothing; nulls are dropped; no links give an empty table.
    """
    links = durable(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if parts := -(-links.count() // PART):
        new = durable(links.repartition(parts).mapInPandas(_contract, "a long, b long"))
        forget(links)
        links = new
    if parts < 2:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = _state(links)
    for _ in range(most):
        new = durable(_small(_large(links)))
        forget(links)
        links, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
