"""Ranking: BM25, BM25F, exact dense search, fusion and reranking.

A ranking is (query_id, item_id, score, rank): rank counts from one by score, descending, then item id.
Scores are rounded before they are ranked, so that ties are ties on every engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from evidentia.functions import text as T
from evidentia.functions.numeric import idf, rounded
from evidentia.sources.tables import materialize

K1, B, RRF_K, DEPTH = 1.5, 0.75, 60, 100
#: Query-side rows broadcast at most; a benchmark's query set is far below.
MAX_QUERY_TERMS = 200_000
#: Vectors of a block of items and of queries.
ITEM_BLOCK, QUERY_BLOCK = 1024, 2048
#: Query terms that become part of the plan at most.
MAX_LITERALS = 10_000
#: Scores, and terms met by queries, of a block of items at most.
BLOCK_SCORES, BLOCK_TERMS = 1 << 22, 1 << 23


def top_k(scores: DataFrame, k: int | None = None, tie: Column | None = None) -> DataFrame:
    """A ranking of (query_id, item_id, score); `tie` orders equal scores before the item id."""
    order = [F.col("score").desc(), *([] if tie is None else [tie]), F.col("item_id").asc()]
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each term of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct(T.analyze("text"))).alias("term"))


def near(small: DataFrame) -> DataFrame:
    """A query-side table, broadcast if its rows are few enough."""
    return F.broadcast(small) if small.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS else small


def postings(items: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, term, tf, length) for the given terms only; length counts all of an item's tokens."""
    tokens = items.select("item_id", T.analyze(text).alias("tokens")).withColumn("length", F.size("tokens"))
    hits = tokens.select("item_id", "length", F.explode("tokens").alias("term")).join(near(terms.select("term").distinct()), "term", "left_semi")
    return hits.groupBy("item_id", "term", "length").agg(F.count("*").alias("tf"))


class Matches(NamedTuple):
    """Items read once for a set of queries: terms (query_id, term), hits (item_id, length, term, tf, df), totals, one row (n, average).

    rows (item_id, length, found), the items once each with the queries' terms in them, and df, the items of each term, are there where terms and items allow best_of() blocks.
    """

    terms: DataFrame
    hits: DataFrame
    totals: DataFrame
    rows: DataFrame | None = None
    df: dict[str, int] | None = None
    rankings: dict | None = None


def matches(items: DataFrame, queries: DataFrame) -> Matches:
    """What items (item_id, text) and queries (query_id, text) have in common. Every ranking of the same two can use it.

    Items are analysed once. Where the queries' terms are few, an item's other tokens go before its tokens become rows.
    """
    terms = query_terms(queries)
    wanted = [r["term"] for r in terms.select("term").distinct().limit(MAX_LITERALS + 1).collect()]
    tokens = items.select("item_id", T.analyze("text").alias("tokens"))
    few = 0 < len(wanted) <= MAX_LITERALS
    found = F.filter("tokens", lambda t: t.isin(wanted)) if few else F.col("tokens")
    base = materialize(tokens.select("item_id", F.size("tokens").alias("length"), found.alias("found")))
    rows = base.select("item_id", "length", F.explode("found").alias("term"))
    if len(wanted) > MAX_LITERALS:
        rows = rows.join(near(terms.select("term").distinct()), "term", "left_semi")
    counted = rows.groupBy("item_id", "length", "term").agg(F.count("*").alias("tf"))
    counted = counted if few else materialize(counted)
    totals = base.agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    if few and not base.groupBy("item_id").count().where("count > 1").limit(1).count():
        df = {r["term"]: r["df"] for r in base.select(F.explode(F.array_distinct("found")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # MAX_LITERALS at most
        known = items.sparkSession.createDataFrame(sorted(df.items()), "term string, df long")
        return Matches(terms, counted.join(F.broadcast(known), "term"), totals, base, df, {})
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    return Matches(terms, counted.join(near(df), "term"), totals)


def _met(m: Matches, columns: list[str], pairs: DataFrame | None) -> DataFrame:
    """(query_id, item_id, term, ...) of the terms that queries and items share; of `pairs` (query_id, item_id) only, if given."""
    if pairs is None:
        return m.hits.select("item_id", *columns).join(near(m.terms), "term")
    asked = pairs.select("query_id", "item_id").distinct()
    hits = m.hits.join(near(asked.select("item_id").distinct()), "item_id", "left_semi").select("item_id", *columns)
    return asked.join(hits, "item_id").join(near(m.terms), ["query_id", "term"])


def bm25_of(m: Matches, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score) of items that share a term with a query; of `pairs` (query_id, item_id) only, if given. For a query's best items see best_of()."""
    part = idf(F.col("n"), F.col("df")) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    weighted = _met(m, ["term", "length", "tf", "df"], pairs).crossJoin(F.broadcast(m.totals))  # one row
    return weighted.groupBy("query_id", "item_id").agg(rounded(F.sum(part)).alias("score"))


def _ids(values: pa.Array) -> list[np.ndarray]:
    """Arrays that order ids as the engine does: nulls first, structs field by field."""
    if pa.types.is_struct(values.type):
        return [np.asarray(values.is_valid()), *[key for field in values.flatten() for key in _ids(field)]]
    if pa.types.is_integer(values.type):
        return [np.asarray(values.is_valid()), values.fill_null(0).to_numpy(zero_copy_only=False)]
    return [pc.rank(values, null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)]


class Best:
    """The best k items of each query among rows that come block by block: by score, then item id, an item by its best row. It holds some times k rows a query."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.most, self.held, self.rows = k, max(1 << 16, 3 * k * queries), [], 0
        #: The lowest score of a query's best k so far.
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, items: pa.Array, scores: np.ndarray) -> None:
        """Rows of scores not below `least`: query numbers, item ids, scores."""
        self.held.append((query, items, scores))
        self.rows += len(query)
        if self.rows > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
        if not self.held:
            return None
        query, scores = (np.concatenate([h[c] for h in self.held]) for c in (0, 2))
        items = pa.concat_arrays([h[1] for h in self.held])
        keys = _ids(items)
        by = np.lexsort((-scores, *reversed(keys), query))
        same = np.ones(max(0, len(by) - 1), bool)
        for key in (query, *keys):
            same &= key[by][1:] == key[by][:-1]
        by = by[np.concatenate(([True], ~same))] if len(by) else by  # an item's best row
        by = by[np.lexsort((*(key[by] for key in reversed(keys)), -scores[by], query[by]))]
        starts = np.searchsorted(query[by], np.arange(len(self.least)))
        place = np.arange(len(by)) - starts[query[by]]
        full = by[place == self.k - 1]
        self.least[query[full]] = scores[full]
        by = by[place < self.k]
        self.held, self.rows = [(query[by], items.take(pa.array(by)), scores[by])], len(by)
        return self.held[0]


def best_of(m: Matches, k: int, kind: str = "bm25", owner: Column | None = None) -> DataFrame:
    """(query_id, item_id, score) with every query's best k items, by `kind` bm25 or overlap, and others, for top_k(); `owner`, an expression over item_id, ranks owners
    of items by their best item.

    Each task scores blocks of items against all queries at once and gives its best k of each query, so that no pair of a query and an item is shuffled otherwise.
    """
    if m.rows is None:
        scores = bm25_of(m) if kind == "bm25" else overlap_of(m)
        return scores if owner is None else scores.groupBy("query_id", owner.alias("item_id")).agg(F.max("score").alias("score"))
    asked = m.terms.limit(MAX_QUERY_TERMS + 1).toArrow()
    if asked.num_rows > MAX_QUERY_TERMS:
        return best_of(m._replace(rows=None), k, kind, owner)
    n, average = m.totals.first()
    words = pa.array(sorted(m.df), pa.string())
    spark, owned = m.rows.sparkSession, m.rows.select((F.col("item_id") if owner is None else owner).alias("item_id"), "length", "found")
    schema = StructType([StructField("query_id", m.terms.schema["query_id"].dataType), StructField("item_id", owned.schema["item_id"].dataType), StructField("score", DoubleType())])
    if not len(words):
        return spark.createDataFrame([], schema)
    names = asked.column("query_id").combine_chunks()
    order = np.lexsort(tuple(reversed(_ids(names))))
    keys = [key[order] for key in _ids(names)]
    new = np.concatenate(([True], np.any([key[1:] != key[:-1] for key in keys], axis=0)))
    query_of, queries = np.cumsum(new) - 1, names.take(pa.array(order[new]))
    terms_of = np.bincount(query_of)  # a query's terms, those in no item too
    at = pc.index_in(asked.column("term").combine_chunks(), value_set=words).take(pa.array(order))
    there = np.asarray(at.is_valid())
    at, query_of = at.fill_null(0).to_numpy(zero_copy_only=False)[there], query_of[there]
    by = np.lexsort((query_of, at))
    query_of, starts = query_of[by], np.searchsorted(at[by], np.arange(len(words) + 1))
    df = np.array([m.df[w] for w in words.to_pylist()], np.float64)
    idfs = np.log1p((n - df + 0.5) / (df + 0.5))
    size = max(1, min(BLOCK_SCORES // len(queries), BLOCK_TERMS // max(1, len(query_of))))
    to_round = lambda x: np.floor(x * 1e6 + 0.5) / 1e6  # noqa: E731 -- as rounded() does

    def scored(rows: pa.RecordBatch, best: Best) -> None:
        found, length = rows.column("found"), rows.column("length").fill_null(0).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False)
        word = pc.index_in(found.flatten(), value_set=words).to_numpy(zero_copy_only=False)
        met, tf = np.unique(np.repeat(np.arange(rows.num_rows), sizes) * len(words) + word, return_counts=True)
        row, word = met // len(words), met % len(words)
        many = starts[word + 1] - starts[word]
        cell = np.repeat(row, many) * len(queries) + query_of[np.repeat(starts[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        cells = rows.num_rows * len(queries)
        hits = np.bincount(cell, minlength=cells).reshape(rows.num_rows, -1)
        if kind == "overlap":
            scores = to_round(hits / terms_of)
        else:
            part = idfs[word] * tf / (tf + K1 * (1 - B + B * length[row] / average))
            scores = to_round(np.bincount(cell, np.repeat(part, many), cells).reshape(rows.num_rows, -1))
        i, q = np.nonzero((hits > 0) & (scores >= best.least))
        best.add(q, rows.column("item_id").take(pa.array(i)), scores[i, q])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), k)
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                scored(batch.slice(i, size), best)
        if (held := best.cut()) is not None:
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(held[0])), held[1], pa.array(held[2])], names=["query_id", "item_id", "score"])

    found = owned.mapInArrow(blocks, schema)
    return found if owner is None else found.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))  # an owner's items may be in several tasks


def bm25_scores(items: DataFrame, queries: DataFrame) -> DataFrame:
    return bm25_of(matches(items, queries))


def bm25f_scores(items: DataFrame, queries: DataFrame, boosts: dict[str, float], b: dict[str, float]) -> DataFrame:
    """Field-weighted BM25: items (item_id, one text column for each key of `boosts`)."""
    terms = query_terms(queries)
    fields = [postings(items, terms, f).withColumn("field", F.lit(f)) for f in boosts]
    averages = items.agg(F.count("*").alias("n"), *[F.greatest(F.lit(1.0), F.avg(F.coalesce(F.size(T.analyze(f)), F.lit(0)))).alias(f"average_{f}") for f in boosts])
    every = reduce(DataFrame.unionByName, fields).crossJoin(F.broadcast(averages))  # one row
    weight = reduce(lambda c, f: c.when(F.col("field") == f, boosts[f] * F.col("tf") / (1 - b[f] + b[f] * F.col("length") / F.col(f"average_{f}"))), boosts, F)
    wtf = every.groupBy("item_id", "term", "n").agg(F.sum(weight).alias("wtf"))
    df = wtf.groupBy("term").agg(F.count("*").alias("df"))
    part = idf(F.col("n"), F.col("df")) * (K1 + 1) * F.col("wtf") / (K1 + F.col("wtf"))
    return wtf.join(df, "term").select("item_id", "term", part.alias("part")).join(near(terms), "term").groupBy("query_id", "item_id").agg(rounded(F.sum("part")).alias("score"))


def _packed(rows: DataFrame, name: str, blocks: int | None = None) -> DataFrame:
    """Rows (id, vector) in blocks, one a row: (name, name_ids, name_matrix, name_width). A block's vectors are one string of bytes, 32-bit numbers as they are and others
    with 64, so that the engine moves it as a whole and not number by number. Blocks are dealt by a hash of the id, or hold the next ITEM_BLOCK rows of a partition."""
    numbers = F.col("vector").cast("array<float>" if _kind(rows) == np.float32 else "array<double>")
    listed = rows.select(F.struct("id", numbers.alias("vector")).alias("r"))
    if blocks is None:
        lists, together = listed.select(F.lit(0).cast("long").alias(name), F.array("r").alias("r")), ITEM_BLOCK
    else:
        lists, together = listed.groupBy(F.pmod(F.xxhash64("r.id"), F.lit(blocks)).alias(name)).agg(F.collect_list("r").alias("r")), 1
    kind, id_ = _kind(rows), rows.schema["id"].dataType
    schema = StructType([StructField(name, LongType()), StructField(f"{name}_ids", ArrayType(id_)), StructField(f"{name}_matrix", BinaryType()), StructField(f"{name}_width", IntegerType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                some = batch.slice(at, together).column("r").flatten()
                ids, matrix = some.field("id"), _matrix(some.field("vector"), len(some), kind)
                block = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([batch.column(name).slice(at, 1), block, pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32())], names=schema.names)

    return lists.mapInArrow(pack, schema)


def _kind(rows: DataFrame) -> type:
    return np.float32 if rows.schema["vector"].dataType.elementType == FloatType() else np.float64


def _matrix(vectors: pa.Array, rows: int, kind: type = np.float64) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros; a null vector counts as zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if rows and (lengths == lengths[0]).all():
        return flat.reshape(rows, -1)
    out, at = np.zeros((rows, int(lengths.max(initial=0))), kind), np.concatenate(([0], np.cumsum(lengths)))
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at[i] : at[i + 1]]
    return out


def _best(scores: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """Which finite scores (queries times items) are among the k highest of their query and not below `least`; equal ones with the last of them are kept."""
    if (least > -np.inf).all():
        return (scores >= least[:, None]) & np.isfinite(scores)
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    return (scores >= least[:, None]) & np.isfinite(scores)


def dense_scores(items: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Exact inner products (query_id, item_id, score) of items (item_id, vector) and queries (query_id, vector), an item not with itself; with k only those that
    can be among a query's best k. A null vector counts as zeros; scores that are not finite are left out.

    Blocks of items are sent to each block of queries and sorted behind it; each pair of blocks is one matrix product, and with k the best k of each query
    over all of a task's blocks are all that leaves it. A block of queries is sent to several groups of item blocks, so that few query blocks still keep all cores busy.
    """
    spark, ids = items.sparkSession, (queries.schema["query_id"].dataType, items.schema["item_id"].dataType)
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    left, right = _packed(items.select(F.col("item_id").alias("id"), "vector"), "i"), _packed(queries.select(F.col("query_id").alias("id"), "vector"), "q", n)
    kinds = {"i": _kind(items), "q": _kind(queries)}
    salts = max(1, 4 * spark.sparkContext.defaultParallelism // n)
    sent = left.withColumn("salt", F.pmod(F.xxhash64("i_ids"), F.lit(salts))).drop("i").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    asked = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    # a task's rows: for each block of queries and group that block, then the group's blocks of items
    met = asked.unionByName(sent, allowMissingColumns=True).repartition(n * salts, "q", "salt").sortWithinPartitions("q", "salt", F.col("i_width").isNotNull())
    schema = StructType([StructField("query_id", ids[0]), StructField("item_id", ids[1]), StructField("raw", DoubleType())])

    def product(item_ids: pa.Array, y: np.ndarray, query_ids: pa.Array, x: np.ndarray) -> np.ndarray:
        width = min(x.shape[1], y.shape[1])
        scores = x[:, :width] @ y[:, :width].T
        if query_ids.type == item_ids.type and not pa.types.is_nested(item_ids.type):
            place = {name: j for j, name in enumerate(item_ids.to_pylist())}
            for i, name in enumerate(query_ids.to_pylist()):
                if (j := place.get(name)) is not None:
                    scores[i, j] = -np.inf
        return scores

    def matrix(row: pa.RecordBatch, name: str) -> np.ndarray:
        width = row.column(f"{name}_width")[0].as_py()
        return np.frombuffer(row.column(f"{name}_matrix")[0].as_buffer(), kinds[name]).astype(np.float64).reshape(-1, width) if width else np.zeros((len(row.column(f"{name}_ids")[0]), 0))

    def rows(query_ids: pa.Array, item_ids: pa.Array, raw: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([query_ids, item_ids, pa.array(raw)], names=["query_id", "item_id", "raw"])

    def given(best: Best | None, query_ids: pa.Array | None) -> Iterator[pa.RecordBatch]:
        if best is not None and (held := best.cut()) is not None:
            yield rows(query_ids.take(pa.array(held[0])), held[1], held[2])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at, query_ids, x = None, None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                q = one.column("q")[0].as_py()
                if one.column("i_width").null_count:
                    if at != q:
                        yield from given(best, query_ids)
                        at, query_ids, x = q, one.column("q_ids").flatten(), matrix(one, "q")
                        best = None if k is None else Best(len(query_ids), k)
                    continue
                if at != q:  # a block without queries
                    continue
                item_ids = one.column("i_ids").flatten()
                scores = product(item_ids, matrix(one, "i"), query_ids, x)
                if k is None:
                    i, j = np.nonzero(np.isfinite(scores))
                    yield rows(query_ids.take(pa.array(i)), item_ids.take(pa.array(j)), scores[i, j])
                else:
                    scores = np.floor(scores * 1e6 + 0.5) / 1e6
                    i, j = np.nonzero(_best(scores, k, best.least))
                    best.add(i, item_ids.take(pa.array(j)), scores[i, j])
        yield from given(best, query_ids)

    met = met.select("q", *(f"{c}_{part}" for c in "iq" for part in ("ids", "matrix", "width"))).mapInArrow(products, schema)
    return met.select("query_id", "item_id", (rounded(F.col("raw")) if k is None else F.col("raw")).alias("score"))


def max_over_windows(scores: DataFrame, windows: DataFrame) -> DataFrame:
    """An item's score is its best window's: scores by window id, windows (window_id, item_id)."""
    return scores.withColumnRenamed("item_id", "window_id").join(windows, "window_id").groupBy("query_id", "item_id").agg(F.max("score").alias("score"))


def rrf(rankings: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """Weighted reciprocal-rank fusion of rankings' first `depth` rows."""
    weights = weights or [1.0] * len(rankings)
    parts = [r.where(F.col("rank") <= depth).select("query_id", "item_id", (F.lit(w) / (k + F.col("rank"))).alias("part"), F.lit(i).alias("i")) for i, (r, w) in enumerate(zip(rankings, weights, strict=True))]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "item_id").agg(rounded(F.sum("part"), 9).alias("score"))


def rrf_many(rankings: list[DataFrame], k: int = RRF_K, depth: int = DEPTH) -> DataFrame:
    """Fusion of many rankings: the first has weight one, the others share one."""
    rest = len(rankings) - 1
    return rrf(rankings, [1.0] + [1.0 / rest] * rest, k, depth)


def tmm(sparse: DataFrame, dense: DataFrame, alpha: float, depth: int = DEPTH, union: DataFrame | None = None) -> DataFrame:
    """Convex fusion of scores scaled by their theoretical minimum and largest value, over the union of both first `depth` rows.

    sparse, dense: all scores (query_id, item_id, score); an item outside one list's first rows keeps its true score there, zero if it has none.
    With `union` (query_id, item_id), both lists' first rows each once, the scores of its items are enough.
    """
    if union is None:
        tops = [top_k(s, depth).select("query_id", "item_id") for s in (sparse, dense)]
        union = tops[0].unionByName(tops[1]).distinct()
    both = union.join(sparse.withColumnRenamed("score", "s"), ["query_id", "item_id"], "left").join(dense.withColumnRenamed("score", "d"), ["query_id", "item_id"], "left").fillna(0.0, ["s", "d"])
    q, eps = Window.partitionBy("query_id"), F.lit(2.0**-23)
    scaled = lambda c, low: (F.col(c) - low) / F.greatest(F.max(c).over(q) - low, eps)
    return both.select("query_id", "item_id", rounded(alpha * scaled("d", F.lit(-1.0)) + (1 - alpha) * scaled("s", F.lit(0.0))).alias("score"))


def rerank(ranking: DataFrame, scores: DataFrame, pool: int, tail: bool = False) -> DataFrame:
    """The first `pool` rows in order of new scores (query_id, item_id, score), then old rank; with `tail` the others follow as they were.

    Scores of the result with a tail count down from its length; rerank_score is null in the tail.
    """
    head = ranking.where(F.col("rank") <= pool).select("query_id", "item_id", F.col("rank").alias("before")).join(scores.select("query_id", "item_id", F.col("score").alias("rerank_score")), ["query_id", "item_id"], "left").fillna(0.0, ["rerank_score"])
    if not tail:
        return top_k(head.withColumnRenamed("rerank_score", "score"), None, F.col("before")).select("query_id", "item_id", "score", "rank")
    rest = ranking.where(F.col("rank") > pool).select("query_id", "item_id", F.col("rank").alias("before"), F.lit(None).cast("double").alias("rerank_score"))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "before", "item_id")
    n = F.count("*").over(Window.partitionBy("query_id"))
    ranked = head.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("score", (n - F.col("rank") + 1).cast("double")).select("query_id", "item_id", "score", "rerank_score", "rank")


def overlap_of(m: Matches, pairs: DataFrame | None = None) -> DataFrame:
    """A transparent reranking score: share of a query's distinct terms that an item has; of `pairs` (query_id, item_id) only, if given."""
    n = m.terms.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = _met(m, ["term"], pairs).groupBy("query_id", "item_id").agg(F.count("*").alias("hits"))
    return hits.join(near(n), "query_id").select("query_id", "item_id", rounded(F.col("hits") / F.col("n")).alias("score"))


def overlap_scores(items: DataFrame, queries: DataFrame) -> DataFrame:
    return overlap_of(matches(items, queries))


def rank_agreement(left: DataFrame, right: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, agreement) over the items both rankings have in their first `depth` rows; zero where they share none."""
    a = left.where(F.col("rank") <= depth).select("query_id", "item_id", F.col("rank").alias("l"))
    b = right.where(F.col("rank") <= depth).select("query_id", "item_id", F.col("rank").alias("r"))
    part = (depth + 1 - F.abs(F.col("l") - F.col("r"))) / F.lit(float(depth))
    both = a.join(b, ["query_id", "item_id"]).groupBy("query_id").agg(rounded(F.sum(part) / depth).alias("agreement"))
    return left.select("query_id").union(right.select("query_id")).distinct().join(both, "query_id", "left").fillna(0.0, ["agreement"])


def features(ranking: DataFrame) -> DataFrame:
    """(query_id, top_score, margin) of a ranking: its best score and that less the second."""
    second = F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0))
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    return ranking.groupBy("query_id").agg(first.alias("top_score"), rounded(first - second).alias("margin"))
