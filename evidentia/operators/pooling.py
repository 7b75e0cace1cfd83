"""Judgment projection, pooling, review queues and benchmark construction."""

from __future__ import annotations


from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.judging import grade, negative_classes, provenance, wrong_version
from evidentia.functions.numeric import rounded
from evidentia.functions.text import stable_id
from evidentia.operators.metrics import ranking_metrics
from evidentia.sources.tables import materialize

#: Pool depths, and what makes a pool stable.
DEPTHS, LEAST_YIELD, LEAST_TAU = (20, 30, 40, 50), 0.01, 0.95


def project(fragments: DataFrame, judgments: DataFrame, nuggets: DataFrame) -> DataFrame:
    """(query_id, chunk_id, grade, partial_hits) of span judgments seen through a chunking.

    fragments: (chunk_id, span_id, is_full); judgments: (query_id, span_id, topical, hits array); nuggets: (query_id, nugget_id).
    A fragment that holds part of a span makes its chunk topical but carries no nugget.
    """
    need = nuggets.groupBy("query_id").agg(F.array_sort(F.collect_set("nugget_id")).alias("need"))
    rows = fragments.join(judgments, "span_id")
    full = F.when(F.col("is_full"), F.col("hits")).otherwise(F.array().cast("array<string>"))
    state = rows.groupBy("query_id", "chunk_id").agg(F.bool_or("topical").alias("topical"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(full)))).alias("got"), F.count(F.when(~F.col("is_full") & (F.size("hits") > 0), 1)).alias("partial_hits"))
    return state.join(F.broadcast(need), "query_id").select("query_id", "chunk_id", grade(F.col("topical"), F.col("got"), F.col("need")).alias("grade"), "partial_hits")  # one row a query


def pool(runs: dict[str, DataFrame], depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(query_id, item_id, first_depth, minimum_rank, provenance, run_hits) of the union of runs' first items.

    runs: ranking by system; run_hits lists system:rank in order of system.
    """
    last = max(depths)
    rows = reduce(DataFrame.unionByName, [r.where(F.col("rank") <= last).select("query_id", "item_id", "rank", F.lit(s).alias("system")) for s, r in sorted(runs.items())])
    bucket = reduce(lambda c, k: c.when(F.col("rank") <= k, k), sorted(depths), F)
    hits = F.array_sort(F.collect_list(F.struct("system", "rank")))
    return rows.withColumn("depth", bucket).groupBy("query_id", "item_id").agg(
        F.min("depth").alias("first_depth"),
        F.min("rank").alias("minimum_rank"),
        F.array_join(F.array_sort(F.collect_set(provenance(F.col("system")))), ",").alias("provenance"),
        F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["system"], h["rank"].cast("string"))), ",").alias("run_hits"),
    )


def depth_report(pooled: DataFrame, qrels: DataFrame) -> DataFrame:
    """(depth, new_items, items, judged, unjudged, new_positive, yield): what each depth adds; yield is its share of relevant items."""
    rows = pooled.join(qrels.select("query_id", "item_id", "grade"), ["query_id", "item_id"], "left")
    each = rows.groupBy(F.col("first_depth").alias("depth")).agg(F.count("*").alias("new_items"), F.count("grade").alias("j"), F.count(F.when(F.col("grade") >= 2, 1)).alias("new_positive"))
    up = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # four rows
    return each.select("depth", "new_items", F.sum("new_items").over(up).alias("items"), F.sum("j").over(up).alias("judged"), (F.sum("new_items").over(up) - F.sum("j").over(up)).alias("unjudged"), "new_positive", rounded(F.col("new_positive") / F.col("new_items")).alias("yield"))


def is_stable(report: DataFrame) -> DataFrame:
    """One row (stable): three depths at least, and the last two yield little and keep the systems' order. report: (depth, yield, tau)."""
    last = Window.orderBy(F.col("depth").desc())
    k = report.withColumn("k", F.row_number().over(last))  # one row a depth
    ok = (F.col("k") > 2) | ((F.col("yield") < LEAST_YIELD) & (F.col("tau") >= LEAST_TAU))
    return k.agg((F.bool_and(ok) & (F.count("*") >= 3)).alias("stable"))


def exclusive(runs: dict[str, DataFrame], depth: int) -> DataFrame:
    """(system, query_id, item_id) of items that only one run has in its first `depth`."""
    rows = reduce(DataFrame.unionByName, [r.where(F.col("rank") <= depth).select("query_id", "item_id", F.lit(s).alias("system")) for s, r in runs.items()])
    return rows.groupBy("query_id", "item_id").agg(F.count("*").alias("n"), F.min("system").alias("system")).where("n = 1").select("system", "query_id", "item_id")


def hard_negatives(candidates: DataFrame, per_query: int = 3) -> DataFrame:
    """(query_id, item_id, negative_class) chosen from (query_id, item_id, grade, minimum_rank, provenance array, no_answer_reason).

    One for each class in order of its name, the best by grade, rank and id, an item once; then by id up to `per_query`.
    The choice in one query hangs on earlier ones, so each query's pool, some hundreds of rows, is one group.
    """
    classed = candidates.where("grade <= 1").withColumn("classes", negative_classes(F.col("provenance"), F.col("no_answer_reason"))).where("size(classes) > 0").select("query_id", "item_id", "grade", "minimum_rank", "classes")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        listed = [(-g, r, i, set(c)) for g, r, i, c in zip(rows["grade"], rows["minimum_rank"], rows["item_id"], rows["classes"], strict=True)]
        used: dict[int, str] = {}
        for name in sorted(set().union(*(c for *_, c in listed))):
            if best := min(((g, r, i) for g, r, i, c in listed if name in c and i not in used), default=None):
                used[best[2]] = name
        for i, c in sorted((i, min(c)) for _, _, i, c in listed):
            if len(used) >= per_query:
                break
            used.setdefault(i, c)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "item_id": list(used), "negative_class": list(used.values())})

    return classed.groupBy("query_id").applyInPandas(choose, "query_id long, item_id long, negative_class string")


def round_robin(rows: DataFrame, stratum: Column, key: str, n: int) -> DataFrame:
    """`n` rows, one of each stratum in order of strata, then the next of each; within a stratum by `key`."""
    turn = F.row_number().over(Window.partitionBy("_stratum").orderBy(key))
    turned = rows.withColumn("_stratum", stratum).withColumn("_turn", turn).where(F.col("_turn") <= n)  # a limit of each stratum before it is shuffled
    return turned.orderBy("_turn", "_stratum").limit(n).drop("_turn").withColumnRenamed("_stratum", "stratum")


def review_queue(pairs: DataFrame, no_answer: DataFrame, least: int = 15) -> DataFrame:
    """(id, reasons) of disagreements, rows without an answer, and agreed rows in order of id up to `least` in all.

    pairs: (id, l, r); no_answer: (id).
    """
    marked = pairs.join(no_answer.select("id", F.lit(True).alias("none")), "id", "left")
    reasons = F.array_join(F.array_compact(F.array(F.when(~F.col("l").eqNullSafe(F.col("r")), "disagreement"), F.when(F.col("none"), "no_answer"))), ",")
    rows = marked.select("id", reasons.alias("reasons"))
    sure = rows.where("reasons <> ''")
    have = sure.agg(F.count("*").alias("have"))
    agreed = rows.where("reasons = ''").orderBy("id").limit(least).withColumn("k", F.row_number().over(Window.orderBy("id")))  # `least` rows
    padded = agreed.crossJoin(have).where(F.col("k") <= least - F.col("have")).select("id", F.lit("agreed_sample").alias("reasons"))  # one row
    return sure.unionByName(padded)


def canonical(rows: DataFrame, key: Column) -> DataFrame:
    """(canonical_id, item_id, first_id, items, sources): every row (item_id, source) with its group: the smallest id of one key, its members and their sources counted.

    Members are rows, never lists, so a group may have any number of them.
    """
    named = rows.withColumn("_k", key)
    groups = named.groupBy("_k").agg(F.min("item_id").alias("first_id"), F.countDistinct("item_id").alias("items"), F.countDistinct("source").alias("sources"))
    return named.join(groups, "_k").select(stable_id("_k").alias("canonical_id"), "item_id", "first_id", "items", "sources")


def expert_candidates(judgments: DataFrame, siblings: DataFrame, reasons: DataFrame) -> DataFrame:
    """(query_id, span_id, grade, provenance) of judged spans (query_id, span_id, grade), and of those before and after a positive one: siblings (span_id, before, after).

    provenance joins sorted labels; a span judged 0 or 1 of a query (query_id, reason) without an answer for its version is marked.
    """
    seeded = judgments.select("query_id", "span_id", F.when(F.col("grade") >= 2, "seeded_positive").otherwise("seeded_agent_candidate").alias("label"))
    around = judgments.where("grade >= 2").join(siblings, "span_id").select("query_id", F.explode(F.array_compact(F.array("before", "after"))).alias("span_id")).withColumn("label", F.lit("sibling_heading"))
    known = judgments.select("query_id", "span_id", "grade")
    rows = seeded.unionByName(around).distinct().join(known, ["query_id", "span_id"], "left").join(reasons, "query_id", "left")
    marked = rows.unionByName(rows.where(wrong_version(F.col("reason"), F.col("grade"))).withColumn("label", F.lit("wrong_version")))
    return marked.groupBy("query_id", "span_id").agg(F.max("grade").alias("grade"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("provenance"))


def annotation_templates(pooled: DataFrame, judgments: DataFrame, depth: int = DEPTHS[0]) -> DataFrame:
    """(query_id, item_id, topical, grade, hits, status) to annotate: a pool's items of one frontier, filled in where judgments (query_id, item_id, grade, hits array) know them."""
    rows = frontier(pooled, depth).join(judgments, ["query_id", "item_id"], "left")
    on = F.col("grade") >= 1
    return rows.select("query_id", "item_id", on.alias("topical"), "grade", F.when(on, F.array_join(F.array_sort("hits"), ";")).otherwise("").alias("hits"), F.when(F.col("grade").isNull(), "pending").otherwise("prepopulated").alias("status"))


def frontier(pooled: DataFrame, depth: int) -> DataFrame:
    """A pool's items that one depth adds."""
    return pooled.where(F.col("first_depth") == depth)


def annotation_row_checks(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """(query_id, item_id, rule) of broken rules of pool annotations (query_id, item_id, topical, hits, nuggets, grade, spans, visible); needs: (query_id, need array).

    The grade is derived, both nugget fields agree, a grade of 0 binds no span and any other does, and all spans were visible.
    """
    joined = rows.join(needs, "query_id", "left").withColumn("need", F.coalesce("need", F.array().cast("array<string>")))
    sound = (F.size(F.array_except("hits", "need")) == 0) & (F.col("topical") | (F.size("hits") == 0))
    derived = F.when(sound, grade(F.col("topical"), F.col("hits"), F.col("need")))
    rules = {
        "grade": F.col("grade") == derived,
        "nugget_fields": F.array_sort("hits") == F.array_sort("nuggets"),
        "span_off_topic": ~F.coalesce(derived == 0, F.lit(False)) | (F.size("spans") == 0),
        "no_span": ~F.coalesce(derived >= 1, F.lit(False)) | (F.size("spans") > 0),
        "invisible_span": F.size(F.array_except("spans", "visible")) == 0,
    }
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return joined.select("query_id", "item_id", F.explode(names).alias("rule"))


def seal(expected: DataFrame, submitted: DataFrame, keys: list[str]) -> DataFrame:
    """One row (expected, submitted, missing, extra, repeated, complete): whether an annotation package has each expected row exactly once."""
    held = submitted.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.select(*keys).distinct().withColumn("known", F.lit(1)).join(held, keys, "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    rows = both.agg(F.count("known").alias("expected"), F.coalesce(F.sum("n"), F.lit(0)).alias("submitted"), count(F.col("n").isNull()).alias("missing"), count(F.col("known").isNull()).alias("extra"), count(F.col("n") > 1).alias("repeated"))
    return rows.withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("repeated") == 0))


def depth_counts(pooled: DataFrame) -> DataFrame:
    """(query_id, one column depth_k for each depth): a query's pool items up to each depth."""
    return pooled.groupBy("query_id").agg(*[F.count(F.when(F.col("first_depth") <= k, 1)).alias(f"depth_{k}") for k in DEPTHS])


def negative_coverage(candidates: DataFrame, chosen: DataFrame, queries: DataFrame, least: int = 3, classes: int = 2, unanswered: int = 5) -> DataFrame:
    """(query_id, nonpositive, chosen, classes, negatives_met, judgments_met) for queries (query_id, answerable): whether a query with an answer has enough hard
    negatives of enough classes, and one without enough judged items; null where a rule does not apply."""
    held = candidates.where("grade <= 1").groupBy("query_id").agg(F.count("*").alias("nonpositive"))
    picked = chosen.groupBy("query_id").agg(F.count("*").alias("chosen"), F.countDistinct("negative_class").alias("classes"))
    rows = queries.join(held, "query_id", "left").join(picked, "query_id", "left").fillna(0, ["nonpositive", "chosen", "classes"])
    return rows.select("query_id", "nonpositive", "chosen", "classes", F.when(F.col("answerable"), (F.col("chosen") >= least) & (F.col("classes") >= classes)).alias("negatives_met"), F.when(~F.col("answerable"), F.col("nonpositive") >= unanswered).alias("judgments_met"))


def stability(runs: dict[str, DataFrame], pooled: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(depth, judged, positive, yield, tau): for each depth the judged items it adds, the relevant ones' share, and the least Kendall tau between the
    systems' order by nDCG@10 over the judgments so far and over those without what one run alone found.

    All depths and held-out runs are scored in one plan: a query's name carries depth, held-out run and system, which are a few each.
    """
    names = sorted(runs)
    held = ["none", *names]
    levels = qrels.sparkSession.createDataFrame([(k,) for k in depths], "depth int")
    known = qrels.join(pooled.select("query_id", "item_id", "first_depth"), ["query_id", "item_id"])
    rows = reduce(DataFrame.unionByName, [r.where(F.col("rank") <= max(depths)).select("query_id", "item_id", "rank", F.lit(s).alias("system")) for s, r in runs.items()])
    found = rows.join(F.broadcast(levels), F.col("rank") <= F.col("depth")).groupBy("depth", "query_id", "item_id").agg(F.count("*").alias("n"), F.min("system").alias("alone")).where("n = 1")
    judged = known.join(F.broadcast(levels), F.col("first_depth") <= F.col("depth")).join(found.select("depth", "query_id", "item_id", "alone"), ["depth", "query_id", "item_id"], "left")
    out = judged.withColumn("held", F.explode(F.array(*map(F.lit, held)))).where(~F.coalesce(F.col("alone") == F.col("held"), F.lit(False)))
    named = lambda df: df.withColumn("query_id", F.concat_ws("|", F.col("depth").cast("string"), "held", "name", F.col("query_id").cast("string")))
    rels = named(out.withColumn("name", F.explode(F.array(*map(F.lit, names))))).select("query_id", "item_id", "grade")
    run = named(rows.withColumnRenamed("system", "name").withColumn("held", F.explode(F.array(*map(F.lit, held)))).crossJoin(F.broadcast(levels))).select("query_id", "item_id", "rank")  # a few depths
    part = F.split("query_id", r"\|")
    scores = ranking_metrics(run, materialize(rels)).groupBy(part[0].cast("int").alias("depth"), part[1].alias("held"), part[2].alias("name")).agg(rounded(F.avg("ndcg_10")).alias("score"))
    placed = materialize(scores.withColumn("place", F.row_number().over(Window.partitionBy("depth", "held").orderBy(F.col("score").desc(), "name"))))
    full = placed.where("held = 'none'").select("depth", "name", F.col("place").alias("full"))
    x, y = (placed.where("held <> 'none'").join(full, ["depth", "name"]).alias(a) for a in "xy")
    pairs = x.join(y, (F.col("x.depth") == F.col("y.depth")) & (F.col("x.held") == F.col("y.held")) & (F.col("x.name") < F.col("y.name")))  # a few systems
    sign = F.signum(F.col("x.place") - F.col("y.place")) * F.signum(F.col("x.full") - F.col("y.full"))
    taus = pairs.groupBy(F.col("x.depth").alias("depth"), F.col("x.held").alias("held")).agg(rounded(F.avg(sign)).alias("t")).groupBy("depth").agg(F.min("t").alias("tau"))
    new = known.groupBy(F.col("first_depth").alias("depth")).agg(F.count("*").alias("judged"), F.count(F.when(F.col("grade") >= 2, 1)).alias("positive"))
    return new.join(taus, "depth").select("depth", "judged", "positive", rounded(F.col("positive") / F.col("judged")).alias("yield"), "tau")


def quota_slots(spark, quotas: dict[str, dict[str, int]], split: str) -> DataFrame:
    """(slot, one column for each attribute): each attribute's values as often as its quota says, each in an order that
    hashes give, joined by place. A benchmark has a few hundred slots."""
    columns = []
    for attribute, counts in quotas.items():
        values = spark.createDataFrame(sorted(counts.items()), "value string, n int").select("value", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        order = Window.orderBy(stable_id(F.lit(f"{split}:{attribute}"), "value", F.col("k").cast("string"), length=64))
        columns.append(values.select((F.row_number().over(order) - 1).alias("slot"), F.col("value").alias(attribute)))
    return reduce(lambda a, b: a.join(b, "slot"), columns)


def adjudication(left: DataFrame, right: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Rows of two annotators whose labels differ, nulls compared as values."""
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in labels])
    return a.join(b, keys).where(~same).select(*keys, *[F.col(f"a.{c}").alias(f"{c}_a") for c in labels], *[F.col(f"b.{c}").alias(f"{c}_b") for c in labels])


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, broken): rows that break each rule; null counts as broken."""
    counts = rows.agg(*[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "broken"))
