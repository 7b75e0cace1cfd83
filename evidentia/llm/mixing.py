"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws an exponential key, its rate the document's quality weight, from a hash of
its id; sorted by key within its source, documents are taken until their sizes reach the
source's token budget. Whole epochs come first, the sorted selection fills what is left.

No source is sorted in one task. Keys fall into buckets by their logarithm, so that a bucket holds four in a thousand of a
source at most whatever the weights; the buckets' sizes are summed, the one in which a source's budget ends is cut into
as many again, and only the documents of the part in which it ends, some millionths of the source, are ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm._common import durable, forget, n_words, tidy

#: Weights of the sources in order of their names, repeating; share of all words to take; most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), (3, 2), 2
#: Buckets of a key's doubling and their number in all; parts of the bucket in which a budget ends; sources whose budgets are broadcast (some 100 bytes each).
OCTAVE, BUCKETS, PARTS, MAX_BROADCAST = 64, 4096, 4096, 50_000


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id, the text and the seed alone; null is no text's digest and no id."""
    head = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null")))), 1, 13)
    return (F.conv(head, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _bucket(key: Column) -> Column:
    """A bucket's number grows with the key; keys lie between 2^-53 and 2^10."""
    return F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(F.log2(key) * OCTAVE) + 54 * OCTAVE)).cast("int")


def _part(key: Column, bucket: Column) -> Column:
    """Where a key lies within its bucket, in PARTS."""
    low, high = (F.pow(F.lit(2.0), (bucket + n) / float(OCTAVE) - 54.0) for n in (0, 1))
    return F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor((key - low) / (high - low) * PARTS))).cast("int")


def _ends(sums: DataFrame, place: str) -> DataFrame:
    """(s, end, before) of `sums` (s, place, held, budget, before): the first place at which a source's sum passes its budget, and the sum before it."""
    running = Window.partitionBy("s").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)  # BUCKETS or PARTS rows a source
    upto = sums.withColumn("upto", F.col("before") + F.sum("held").over(running)).where("upto > budget")
    return upto.groupBy("s").agg(F.min(F.struct(place, "upto", "held")).alias("e")).select("s", F.col(f"e.{place}").alias("end"), (F.col("e.upto") - F.col("e.held")).alias("before"))


def quality_weight(text: Column, size: Column) -> Column:
    """Share of words without a mark of `#*$%&|<>` for each, at least 0.05."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.coalesce(marks, F.lit(0)) / F.greatest(size, F.lit(1)))


def source_targets(totals: DataFrame) -> DataFrame:
    """Targets of sources (source, source_size): SHARE of all words by weight, capped at EPOCHS times a source's size.

    What a capped source cannot take is shared again by weight. With sources in order of cap / weight,
    all before some place are capped and the rest share alike; one pass of running sums finds the place.
    A table of sources is small next to the documents, one row each.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.expr("cast(source as binary)"))
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)).withColumn("cap", EPOCHS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.expr("cast(source as binary)"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("wanted", F.sum("source_size").over(everything) * SHARE[0] / SHARE[1])
        .withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(after))
        .withColumn("fits", (F.col("wanted") - F.col("used")) * F.col("weight") <= F.col("cap") * F.col("rest"))
        .withColumn("used_at", F.min(F.when(F.col("fits"), F.col("used"))).over(everything))
        .withColumn("rest_at", F.max(F.when(F.col("fits"), F.col("rest"))).over(everything))
    )
    # every source from the first that fits on shares one level; those before it are capped
    open_ = F.col("rest") <= F.col("rest_at")
    target = F.when(open_, (F.col("wanted") - F.col("used_at")) * F.col("weight") / F.col("rest_at")).otherwise(F.col("cap").cast("double"))
    return level.select("source", "source_size", target.cast("double").alias("target"))


@tidy
def mix(docs: DataFrame, weight: Column | None = None, seed: int = 7) -> DataFrame:
    """Per row of `docs`: doc_id, print (a hash of the text), source, size, source_size, target and copies (0 to 2), how often the mix takes it.

    A null text has size zero; a null source is a source of its own, last in order. The document in which
    a budget ends is taken if that brings the source nearer to its target. Rows of one id, or without one, that differ in text
    draw keys of their own. Ties of keys go by id and size; repeated rows are taken row by row; reruns agree.
    No rows give no rows; other columns are ignored.
    """
    text = F.col("text").cast("string")
    size = n_words(text)
    weight = quality_weight(text, size) if weight is None else weight
    key = -F.log(uniform(F.col("doc_id"), text, seed)) / weight
    keyed = docs.select("doc_id", F.xxhash64(text).alias("print"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"))
    base = durable(keyed.withColumn("bucket", _bucket(F.col("key"))))

    held = durable(base.groupBy("source", "bucket").agg(F.sum("size").alias("held")))
    targets = source_targets(held.groupBy("source").agg(F.sum("held").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = durable(targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s"))
    near = F.broadcast if plan.count() <= MAX_BROADCAST else (lambda x: x)
    of = lambda rows, more: rows.join(near(more), F.col("source").eqNullSafe(F.col("s")))
    same = lambda more, name: more.withColumnRenamed("s", name)

    budgets = plan.select("s", "budget")
    first = durable(_ends(of(held, budgets).withColumn("before", F.lit(0)), "bucket"))
    inner = of(base, budgets.join(same(first, "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")).where(F.col("bucket") == F.col("end")).withColumn("part", _part(F.col("key"), F.col("bucket")))
    second = durable(_ends(inner.groupBy("s", "budget", "before", "part").agg(F.sum("size").alias("held")), "part"))

    both = same(first, "t").select("t", F.col("end").alias("end_bucket")).join(same(second, "u").select("u", F.col("end").alias("end_part"), F.col("before").alias("end_before")), F.col("t").eqNullSafe(F.col("u"))).drop("u")
    every = durable(plan.join(both, F.col("s").eqNullSafe(F.col("t")), "left").drop("t"))
    forget(held, plan, first, second)
    rows = of(base, every).drop("s").withColumn("part", F.when(F.col("bucket") == F.col("end_bucket"), _part(F.col("key"), F.col("bucket"))))
    inside = F.coalesce(F.col("part") == F.col("end_part"), F.lit(False))
    before = F.coalesce((F.col("bucket") < F.col("end_bucket")) | (F.col("part") < F.col("end_part")), F.col("end_bucket").isNull())
    sure = rows.where(~inside).withColumn("extra", before.cast("int"))
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        rows.where(inside)
        .withColumn("upto", F.col("end_before") + F.sum("size").over(in_order))
        .withColumn("extra", ((F.col("upto") <= F.col("budget")) | ((F.col("upto") - F.col("size") < F.col("budget")) & (F.col("upto") - F.col("budget") < F.col("budget") - F.col("upto") + F.col("size")))).cast("int"))
        .drop("upto")
    )
    copies = F.least(F.lit(EPOCHS), F.col("epochs") + F.when(F.col("budget") > 0, F.col("extra")).otherwise(0))
    return sure.unionByName(edge).select("doc_id", "print", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


@tidy
def repeat(docs: DataFrame) -> DataFrame:
    """`docs` with every row as often as the mix takes it, none to twice; rows of equal id, text and source are alike, and are taken as often as the mix takes them together."""
    keys = ["_ev_none", "_ev_id", "_ev_print", "_ev_source"]
    named = lambda rows, text: rows.withColumn("_ev_none", F.col("doc_id").isNull()).withColumn("_ev_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_ev_print", text).withColumn("_ev_source", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    copies = named(mix(docs).withColumnRenamed("copies", "_ev_copies"), F.col("print")).groupBy(*keys).agg(F.sum("_ev_copies").cast("int").alias("_ev_copies")).where("_ev_copies > 0")
    rows = named(docs, F.xxhash64(F.col("text").cast("string"))).join(copies, keys).dropDuplicates(keys)
    return rows.withColumn("_ev_copy", F.explode(F.sequence(F.lit(1), F.col("_ev_copies")))).select(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken. Nulls, ties, repeated rows, other columns and empty tables are treated as mix() says."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


#: The same in SQL for DuckDB, the table given.
def mix_sql(docs: str = "documents", seed: int = 7) -> str:
    return rf"""
    with base as (
      select doc_id, source, size, -ln((('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(digest, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double)
             / greatest(0.05::double, 1.0::double - coalesce(marks, 0) / greatest(size, 1)::double) as key
      from (select doc_id, source, md5(text) as digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                   length(text) - length(translate(text, '#*$%&|<>', '')) as marks from {docs})),
    totals as (select source, sum(size)::bigint as source_size from base group by source),
    ranked as (select *, [5, 2, 1][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::bigint] as weight, 2 * source_size as cap from totals),
    placed as (
      select *, (select sum(source_size)::bigint from totals) * 3 / 2::double as wanted,
        coalesce(sum(cap) over (order by cap / weight::double, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0)::bigint as used,
        (sum(weight) over (order by cap / weight::double, source is null, encode(source) rows between current row and unbounded following))::bigint as rest from ranked),
    level as (select min(used) filter (fits) as used_at, max(rest) filter (fits) as rest_at from (select *, (wanted - used) * weight <= cap::double * rest as fits from placed)),
    targets as (select source, source_size, case when rest <= rest_at then (wanted - used_at) * weight / rest_at else cap::double end as target from placed, level),
    plans as (select *, target - epochs * source_size as budget from (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from targets)),
    run as (select b.doc_id, b.size, p.source_size, p.target, p.epochs, p.budget,
              (sum(b.size) over (partition by b.source order by b.key, b.doc_id, b.size rows unbounded preceding))::bigint as upto
            from base b join plans p on b.source is not distinct from p.source)
    select doc_id, size, source_size, target,
      size * least(2, epochs + case when budget > 0 and (upto <= budget or (upto - size < budget and upto - budget < budget - upto + size)) then 1 else 0 end)::bigint as taken
    from run"""
