"""A persisted sparse index: postings and frequencies dealt by term, item lengths and totals as Parquet, with a manifest that loading checks."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators.retrieval import MAX_LITERALS, Matches, near, query_terms
from evidentia.sources.tables import materialize

#: Folders that postings are dealt into by a hash of their term; a query set reads those of its terms only.
BUCKETS = 64
TABLES = ("postings", "frequencies", "lengths", "totals")


class Index(NamedTuple):
    """postings (bucket, term, item_id, length, tf), frequencies (bucket, term, df), lengths (item_id, length), totals, one row (n, average)."""

    postings: DataFrame
    frequencies: DataFrame
    lengths: DataFrame
    totals: DataFrame


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _sum(rows: DataFrame) -> dict:
    """Number of rows and sum of their 64-bit hashes, columns in order of name, nulls marked; for damage, not for forgers, so that a large index is soon read over."""
    parts = [x for c in sorted(rows.columns) for x in (F.col(c), F.col(c).isNull())]
    total = F.sum(F.xxhash64(*parts).cast("decimal(20,0)"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(total.cast("string"), F.lit("0")).alias("hashes")).first().asDict()


def save(items: DataFrame, path: str) -> dict[str, dict]:
    """Write the index of items (item_id, text) below `path` and return its manifest, the rows of each table and the sum of their hashes.

    Items are analysed once. Postings are sorted by term within a folder's files, so that a scan for some terms skips the others' pages.
    """
    spark = items.sparkSession
    tokens = materialize(items.select("item_id", T.analyze("text").alias("tokens")))
    lengths = tokens.select("item_id", F.size("tokens").alias("length"))
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    terms = tokens.select("item_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    # one shuffle: tokens are dealt as their postings will be, and counted where they lie
    dealt = terms.withColumn("bucket", _bucket("term")).withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(8))).repartition("bucket", "part")
    rows = dealt.groupBy("bucket", "part", "term", "item_id", "length").agg(F.count("*").alias("tf")).drop("part")
    rows.sortWithinPartitions("bucket", "term", "item_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    df = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    df.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/frequencies")
    spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("length").alias("average")).write.mode("overwrite").parquet(f"{path}/totals")
    manifest = {name: _sum(spark.read.parquet(f"{path}/{name}").drop("bucket")) for name in TABLES}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def manifest(spark: SparkSession, path: str) -> dict[str, dict]:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def load(spark: SparkSession, path: str, check: bool = True) -> Index:
    """The index below `path`; raises if `check` finds that a table is not what the manifest says."""
    tables = [spark.read.parquet(f"{path}/{name}") for name in TABLES]
    if check:
        known = manifest(spark, path)
        if wrong := [name for name, t in zip(TABLES, tables, strict=True) if _sum(t.drop("bucket")) != known.get(name)]:
            raise ValueError(f"the index differs from its manifest: {', '.join(wrong)}")
    return Index(*tables)


def matches(index: Index, queries: DataFrame) -> Matches:
    """What an index and queries (query_id, text) have in common; only the folders of the queries' terms are read. Where terms are few, their postings meet by item for best_of()."""
    terms = query_terms(queries)
    wanted = terms.select("term").distinct()
    buckets = [r["b"] for r in wanted.select(_bucket("term").alias("b")).distinct().collect()]  # BUCKETS at most
    words = [r["term"] for r in wanted.limit(MAX_LITERALS + 1).collect()]
    few = 0 < len(words) <= MAX_LITERALS

    def some(table: DataFrame) -> DataFrame:
        rows = table.where(F.col("bucket").isin(buckets)) if buckets else table.limit(0)
        return rows.where(F.col("term").isin(words)) if few else rows.join(near(wanted), "term", "left_semi")

    rows, known = some(index.postings), some(index.frequencies).select("term", "df")
    hits = rows.join(near(known), "term").select("item_id", "length", "term", "tf", "df")
    if not few or index.lengths.groupBy("item_id").count().where("count > 1").limit(1).count():
        return Matches(terms, hits, index.totals)
    df = {r["term"]: r["df"] for r in known.collect()}  # MAX_LITERALS at most
    found = rows.groupBy("item_id", "length").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("found"))
    return Matches(terms, hits, index.totals, found, df, {})
