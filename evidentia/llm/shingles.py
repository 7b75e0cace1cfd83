"""Near-duplicates by word shingles: SimHash balls and MinHash bands find candidates, the exact Jaccard similarity of the shingle sets decides.

Texts with the same set of shingles are one node. Each node has a SimHash fingerprint of its shingles, linked by ball hashing
as in simhash.py, and BANDS keys of ROWS minimum hashes each: fingerprints of texts of similarity 0.8 differ in some 10 of 64
bits, further than a ball reaches, while such a pair shares a key with probability 1 - (1 - 0.8^ROWS)^BANDS, all but 3 in a million.

Every two nodes that share a key are compared or known to be connected already, in three steps. First the pairs that ball
hashing gives are verified. Then each node is compared with one pivot of each of its keys, the one with the smallest hash, so that
keys of one group mostly share it; many members of a group of copies are connected after that, at a cost in proportion to the nodes. What is left are keys with nodes of different
components: all others are compared with the component that has most of the key's nodes, and with each other. They are
dealt into blocks, a set travels once for each two blocks, not for each two nodes, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import durable, forget, give_back, tidy
from evidentia.llm.components import components
from evidentia.llm.simhash import _forest, ball_links

#: Words of a shingle, and the similarity from which two texts are linked, in fifths (4 of 5).
SIZE, FIFTHS = 5, 4
BANDS, ROWS, SEED, BLOCK = 32, 5, 42, 256
#: Nodes that are compared with one pivot in one task.
PART = 256
#: Shingles hashed, and columns multiplied, at once.
STEP, COLUMNS = 1 << 10, 1 << 12
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = (a ^ b) * _MIX
    return a ^ (a >> np.uint64(29))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # the words of simhash.fingerprint_of
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, out = max(1, len(words) - size + 1), np.full(max(1, len(words) - size + 1), min(len(words), size), np.uint64)
    for i in range(min(len(words), size)):
        out = _mix(out, hashes[i : i + n])
    return np.unique(out)


def bands(shingles: np.ndarray) -> np.ndarray:
    """The BANDS keys of a shingle set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), STEP):
        np.minimum(least, ((shingles[at : at + STEP, None] * _TIMES + _PLUS) >> np.uint64(32)).min(0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mix(keys, row)
    return keys


def print_of(shingles: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of a shingle set; zero without shingles."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        mixed = _mix(shingles[at : at + (1 << 16)], np.uint64(SEED))
        counts += np.unpackbits(mixed.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def _alike(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b that share so many shingles are similar enough; two empty sets are."""
    return 5 * both >= FIFTHS * (a + b - both)


def similar(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the sets whose Jaccard similarity is FIFTHS / 5 or more; two empty sets are alike."""
    sets = [*left, *right]
    sizes = np.array([len(s) for s in sets], np.int64)
    known, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), sizes), (counts > 1)[column]
    order = np.argsort(column[shared], kind="stable")
    row, column = row[shared][order], (np.cumsum(counts > 1) - 1)[column[shared][order]]
    both = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        both += (has[: len(left)] @ has[len(left) :].T).astype(np.int64)
    return np.nonzero(_alike(both, sizes[: len(left), None], sizes[None, len(left) :]))


def _prints(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for block in texts:
        nodes, prints, keys = np.zeros(len(block), np.uint64), np.zeros(len(block), np.uint64), []
        for i, text in enumerate(block):  # one set at a time: a block holds many texts
            s = shingle_set(text)
            nodes[i] = xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0
            prints[i] = print_of(s)
            keys.append(bands(s).view(np.int64))
        yield pd.DataFrame({"node": nodes.view(np.int64), "fp": prints.view(np.int64), "bands": keys})
    give_back()


def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for block in texts:
        yield pd.Series([shingle_set(t).tobytes() for t in block])
    give_back()


def _with_pivot(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) of the pivot, key's first part, with the nodes that are similar to it."""
    give_back()
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    nodes = rows["node"].to_numpy(np.int64)
    at = int(np.flatnonzero(nodes == key[0])[0])
    pivot, sizes = sets[at], np.array([len(s) for s in sets], np.int64)
    both = np.array([np.isin(s, pivot, assume_unique=True).sum() if 5 * min(len(s), len(pivot)) >= FIFTHS * max(len(s), len(pivot)) else 0 for s in sets], np.int64)
    found = nodes[_alike(both, sizes, np.int64(len(pivot))) & (nodes != key[0])]
    return pd.DataFrame({"a": found, "b": np.full(len(found), key[0], np.int64)})


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of `key`, or inside one, as few as keep them connected."""
    give_back()
    parts = [rows[rows["block"] == k].drop_duplicates("node") for k in key]
    sets = [[np.frombuffer(s, np.uint64) for s in p["shingles"]] for p in parts]
    nodes = np.concatenate([p["node"].to_numpy(np.int64) for p in parts])
    i, j = similar(*sets)
    j = j + len(sets[0])
    names, same = np.unique(nodes, return_inverse=True)
    label = _forest(len(names), np.stack([same[i], same[j]], 1)) if len(i) else np.arange(len(names))
    linked = label != np.arange(len(names))
    return pd.DataFrame({"a": names[linked], "b": names[label[linked]]})


_LINKS = "a long, b long"


def _star_links(pairs: DataFrame, shingles: DataFrame, with_pivot=_with_pivot) -> DataFrame:
    """Links (a, b) among the pairs (node, pivot) whose sets are similar. A pivot's nodes are dealt into parts of about PART, the pivot goes to each."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node")
    every = dealt.unionByName(dealt.select("pivot", "part", F.col("pivot").alias("node")).distinct())
    return every.join(shingles, "node").groupBy("pivot", "part").applyInPandas(with_pivot, _LINKS)


def _hopped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): nodes with one label are connected by `links`; a node's label is two hops away at most, so one component may still have several."""
    to = links.groupBy("a").agg(F.min("b").alias("b"))
    once = nodes.select("node").join(to.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("label"))
    return once.join(to.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("b", "label").alias("label"))


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the component of each node so far."""
    roots = components(links)
    out = durable(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")))
    forget(roots)
    return out


def _rest_links(members: DataFrame, shingles: DataFrame, compare=_compare) -> DataFrame:
    """Links that connect every two similar nodes of different components that share a key. members: (node, key, label).

    In each key the component with most nodes is the main one, the other nodes are strays. Strays of a main component are
    compared with all its nodes and with each other, block by block.
    """
    held = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = held.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1").select("key", "main")
    strays = durable(members.join(main, "key").where("label <> main").select("main", "node").distinct())
    mains = strays.select(F.col("main").alias("label")).distinct()
    cores = members.join(mains, "label", "left_semi").select(F.col("label").alias("main"), "node").distinct()
    sides = durable(cores.withColumn("stray", F.lit(0)).unionByName(strays.withColumn("stray", F.lit(1))))
    parts = durable(sides.groupBy("main", "stray").agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
    blocks = durable(sides.join(parts, ["main", "stray"]).select("node", F.xxhash64("main", "stray", F.pmod(F.xxhash64("node"), "parts")).alias("block")))
    names = parts.select("main", "stray", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("main", "stray", F.xxhash64("main", "stray", F.col("part").cast("long")).alias("block"))
    left, right = names.where("stray = 1").select("main", F.col("block").alias("x")), names.select("main", F.col("block").alias("y"), "stray")
    pairs = durable(left.join(right, "main").where("stray = 0 or x <= y").select("x", "y").distinct())
    sides_of = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    found = durable(sides_of.join(blocks, "block").join(shingles, "node").groupBy("x", "y").applyInPandas(compare, _LINKS).distinct())
    forget(strays, sides, parts, blocks, pairs)
    return found


def _links(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Links (a, b) that connect every two similar ones of `nodes` (node, first, fp) that share a key of `keys` (node, key) or whose fingerprints meet in a ball."""
    prints = durable(nodes.select("fp").distinct())
    balls = ball_links(prints, prints.count())
    same = nodes.groupBy("fp").agg(F.min("node").alias("pivot"))
    chains = nodes.select("fp", "node").join(same, "fp").where("node <> pivot").select("node", "pivot")
    named = same.select(F.col("fp").alias("a"), F.col("pivot").alias("node")).join(balls, "a").join(same.select(F.col("fp").alias("b"), "pivot"), "b").select("node", "pivot")
    near = durable(chains.unionByName(named).distinct())
    forget(prints)

    common = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = durable(keys.join(common, "key"))
    wanted = members.select("node").unionByName(near.select("node")).unionByName(near.select(F.col("pivot").alias("node"))).distinct()
    # one row's text for each node, found by its id and print, so that many copies of a text don't meet in one task
    wanted = nodes.select("node", "first.*").join(wanted, "node", "left_semi")
    texts = _identified(docs).join(wanted, ["none", "id", "print"]).groupBy("node").agg(F.min("text").alias("text"))
    shingles = durable(texts.select("node", F.pandas_udf(_sets, "binary")("text").alias("shingles")))

    found = durable(_star_links(near, shingles))
    forget(near)
    open_ = members.join(_hopped(nodes, found), "node")
    pivots = open_.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(SEED))).alias("p"))
    pairs = open_.join(pivots, "key").where(F.col("label") != F.col("p.label")).select("node", F.col("p.node").alias("pivot")).distinct()
    more = durable(found.unionByName(_star_links(pairs, shingles)))
    forget(found)
    found = more
    labels = _labelled(nodes, found)
    rest = _rest_links(members.join(labels, "node"), shingles)
    every = durable(found.unionByName(rest))
    forget(found, rest, labels, members, shingles)
    return every


def _identified(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, text) with (none, id, print), by which rows are told apart: whether the id is null, the id, and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.withColumn("none", F.col("doc_id").isNull()).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("print", F.xxhash64(text))


@tidy
def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, print (a hash of its text), component_id, the smallest doc_id reachable by links of
    similarity FIFTHS / 5 or more, and `first`, the print of the text that stands for the component.

    Null, empty and blank texts are one node. A null doc_id is never a component_id unless no row of the component
    has another. Repeated rows stay; an empty table gives an empty result; other columns are ignored. The text that stands for
    a component is that of its smallest doc_id, of several texts of that id the one with the smallest print.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    prints = _identified(docs).select("doc_id", "none", "id", "print", F.pandas_udf(_prints, "node long, fp long, bands array<long>")("text").alias("p"))
    prints = durable(prints.select("doc_id", "none", "id", "print", "p.*"))
    nodes = durable(prints.groupBy("node").agg(F.min(F.struct("none", "id", "print")).alias("first"), F.min("fp").alias("fp")))
    keys = durable(prints.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("key")))
    links = _links(docs, nodes, keys)
    roots = components(links)
    named = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    smallest = named.groupBy("root").agg(F.min("first").alias("least"))
    component = F.when(~F.col("least.none"), F.col("least.id"))
    classes = durable(named.join(smallest, "root").select("node", component.alias("component_id"), F.col("least.print").alias("first")))
    forget(nodes, keys, links, roots)
    return prints.join(classes, "node").select("doc_id", "print", "component_id", "first")


@tidy
def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row for each component of near_duplicates(): a row of the text that stands for it, under its smallest doc_id.

    Rows are told apart by id and text: several texts of one id are rows of their own, and so are those without an id.
    Equal rows are one; which one of them stays is open where their other columns differ. Columns stay as they are.
    """
    classes = near_duplicates(docs)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("print") == F.col("first"))).select(F.col("doc_id").isNull().alias("_ev_none"), F.coalesce("doc_id", F.lit(0)).alias("_ev_id"), F.col("print").alias("_ev_print")).distinct()
    keys = ["_ev_none", "_ev_id", "_ev_print"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_ev_none", F.col("doc_id").isNull()).withColumn("_ev_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_ev_print", F.xxhash64(text))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
