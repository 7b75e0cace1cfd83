"""Line dedup by distinct-site spread.

How many sites a line stands on is counted by a HyperLogLog sketch of its sites for each line
hash, merged by aggregation. Lines whose estimate is near the threshold are counted
again exactly. Lines on so many sites are boilerplate: they stay in the document with the
smallest id that has them and go from all others, so that no text is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import durable, forget, tidy

#: Sites that make a line boilerplate, sketch size (log2 of its registers), and the band around the threshold that is counted exactly.
SITES, LOG_K, BAND = 10, 12, 0.25
#: Line hashes broadcast at most, 16 bytes each in a row; beyond it joins shuffle.
MAX_BROADCAST = 100_000


def _site(source: Column) -> Column:
    """Null is a site of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, site, hash) for every line with anything but ASCII white space."""
    text = F.col("text").cast("string")
    rows = docs.where(text.isNotNull()).select("doc_id", _site(F.col("source")).alias("site"), F.explode(F.split(text, "\n")).alias("line"))
    return rows.where(_has_word(F.col("line"))).select("doc_id", "site", F.xxhash64("line").alias("hash"))


def boilerplate(every: DataFrame, sites: int = SITES) -> DataFrame:
    """(hash, keeper) of the lines of `every` that stand on at least `sites` sites; keeper: the smallest doc_id with the line."""
    spread = every.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("about"), F.min("doc_id").alias("keeper"))
    candidates = durable(spread.where(F.col("about") >= sites * (1 - BAND)))
    sure = candidates.where(F.col("about") > sites * (1 + BAND)).select("hash", "keeper")
    near = candidates.where(F.col("about") <= sites * (1 + BAND)).select("hash", "keeper")
    near = F.broadcast(near) if near.count() <= MAX_BROADCAST else near
    counted = every.select("hash", "site").join(near, "hash").groupBy("hash", "keeper", "site").agg(F.lit(1).alias("one")).groupBy("hash", "keeper").agg(F.count("*").alias("exact"))
    found = durable(sure.unionByName(counted.where(F.col("exact") >= sites).select("hash", "keeper")))
    forget(candidates)
    return found


@tidy
def drop_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """`docs` without boilerplate lines, with the number of lines removed in n_removed_lines, which replaces a column of that name.

    Null texts stay null, and a text of boilerplate alone becomes empty; blank lines stay. A null source is a site
    of its own; a row with a null doc_id never keeps a line that a row with an id has. Rows of one doc_id
    keep or lose a line together; repeated rows stay. An empty table stays empty.
    """
    every = durable(lines(docs))
    found = boilerplate(every, sites)
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST else found
    gone = every.join(found, "hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc_id").alias("_ev_id")).agg(F.collect_set("hash").alias("_ev_gone"))
    rows = docs.drop("n_removed_lines").join(gone, F.col("doc_id").eqNullSafe(F.col("_ev_id")), "left")
    before = F.split(F.col("text").cast("string"), "\n")
    after = F.filter(before, lambda line: ~(F.array_contains("_ev_gone", F.xxhash64(line)) & _has_word(line)))
    hit = F.col("_ev_gone").isNotNull() & F.col("text").isNotNull()
    return (
        rows.withColumn("_ev_after", F.when(hit, after))
        .withColumn("n_removed_lines", F.when(hit, F.size(before) - F.size("_ev_after")).otherwise(0).cast("long"))
        .withColumn("text", F.when(hit, F.array_join("_ev_after", "\n")).otherwise(F.col("text").cast("string")))
        .drop("_ev_id", "_ev_gone", "_ev_after")
    )


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines left, n_removed, text_sha256 of the text left.

    Nulls, empty texts, repeated rows, other columns and empty tables are treated as drop_boilerplate() says; a null text has
    no lines and the digest of an empty one.
    """
    cleaned = drop_boilerplate(docs.select("doc_id", "text", "source"))
    return cleaned.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.col("n_removed_lines").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def sql(docs: str = "documents", sites: int = SITES) -> str:
    """The same for DuckDB, of ids that are not null."""
    return rf"""
    with l as (select doc_id, coalesce('s' || source, 'n') as site, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from {docs}),
    w as (select *, regexp_matches(line, '[^\x20\x09-\x0D]') as word from l),
    b as (select line, min(doc_id) as keeper from w where word group by line having count(distinct site) >= {sites}),
    k as (select w.doc_id, w.i, w.line, b.line is not null and w.doc_id <> b.keeper as gone from w left join b on w.line = b.line and w.word),
    g as (select doc_id, string_agg(line, chr(10) order by i) filter (not gone) as text, count(*) filter (not gone) as n_lines, count(*) filter (gone) as n_removed from k group by doc_id)
    select d.doc_id, case when d.text is null then 0 else greatest(coalesce(g.n_lines, 0), 1) end::bigint as n_lines, coalesce(g.n_removed, 0)::bigint as n_removed,
           sha256(coalesce(g.text, '')) as text_sha256
    from {docs} d left join g on d.doc_id = g.doc_id"""
