"""Ranking, evidence and answerability metrics.

run: (query_id, item_id, rank); qrels: (query_id, item_id, grade). Queries are those of the qrels.
Unjudged items count as retrieved, not as judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.judging import grade
from evidentia.functions.numeric import rounded

RELEVANT = 2


def ranking_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query: ndcg_3, ndcg_10, p_3, recall_1/3/5/10/20/100, rr_10, ap, judged_10, bpref."""
    counts = qrels.groupBy("query_id", "grade").agg(F.count("*").alias("n"))
    return graded_metrics(run.select("query_id", "item_id", "rank").join(qrels.select("query_id", "item_id", "grade"), ["query_id", "item_id"], "left"), counts)


def graded_metrics(graded: DataFrame, counts: DataFrame) -> DataFrame:
    """ranking_metrics() of a run with its items' grades (query_id, rank, grade) and the number of judged items by query and grade (query_id, grade, n).

    The ideal ranking hangs on the numbers alone, so judgments never become rows here.
    """
    relevant = F.col("grade") >= RELEVANT
    gain = lambda c, at: F.coalesce(c, F.lit(0)) * F.log(F.lit(2.0)) / F.log(at + 1.0)
    by_grade = Window.partitionBy("query_id").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # a grade's items stand from place `after` + 1 to place `stop`
    placed = counts.withColumn("stop", F.sum("n").over(by_grade)).withColumn("after", F.col("stop") - F.col("n"))
    at = lambda k: reduce(lambda a, b: a + b, [F.when((F.col("after") < i) & (F.col("stop") >= i), gain(F.col("grade"), F.lit(i))).otherwise(0.0) for i in range(1, k + 1)])
    ideal = placed.groupBy("query_id").agg(
        *[F.sum(at(k)).alias(f"ideal_{k}") for k in (3, 10)],
        F.coalesce(F.sum(F.when(relevant, F.col("n"))), F.lit(0)).alias("n_relevant"),
        F.coalesce(F.sum(F.when(~relevant, F.col("n"))), F.lit(0)).alias("n_other"),
    )
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        graded.withColumn("hit", F.coalesce(relevant, F.lit(False)).cast("int"))
        .withColumn("other", F.coalesce(~relevant, F.lit(False)).cast("int"))
        .withColumn("hits", F.sum("hit").over(order))
        .withColumn("others", F.sum("other").over(order))
        .join(ideal, "query_id")
    )
    within = lambda k: F.col("rank") <= k
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    bpref = F.when(F.col("hit") == 1, F.lit(1.0) - F.when(F.col("others") == 0, 0.0).otherwise(F.least("others", "n_relevant") / F.least("n_relevant", "n_other")))
    agg = rows.groupBy("query_id").agg(
        *[total(F.when(within(k), gain(F.col("grade"), F.col("rank")))).alias(f"dcg_{k}") for k in (3, 10)],
        (total(F.when(within(3), F.col("hit"))) / 3.0).alias("p_3"),
        *[total(F.when(within(k), F.col("hit"))).alias(f"hits_{k}") for k in (1, 3, 5, 10, 20, 100)],
        F.coalesce(F.max(F.when(within(10) & (F.col("hit") == 1), 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr_10"),
        total(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("precisions"),
        total(F.when(within(10) & F.col("grade").isNotNull(), 1.0)).alias("judged"),
        F.count(F.when(within(10), 1)).alias("retrieved"),
        total(bpref).alias("bprefs"),
    )
    every = ideal.join(agg, "query_id", "left").fillna(0)
    share = lambda a, b: rounded(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0))
    return every.select(
        "query_id",
        *[share(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_{k}") for k in (3, 10)],
        rounded(F.col("p_3")).alias("p_3"),
        *[share(f"hits_{k}", "n_relevant").alias(f"recall_{k}") for k in (1, 3, 5, 10, 20, 100)],
        rounded(F.col("rr_10")).alias("rr_10"),
        share("precisions", "n_relevant").alias("ap"),
        share("judged", "retrieved").alias("judged_10"),
        share("bprefs", "n_relevant").alias("bpref"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    """(metric, value, n_queries): each metric's mean over queries."""
    names = [c for c in per_query.columns if c != "query_id"]
    means = per_query.agg(F.count("*").alias("n"), *[rounded(F.avg(c)).alias(c) for c in names])
    return means.select("n", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("metric", "value")).select("metric", "value", F.col("n").alias("n_queries"))


def first_by_document(run: DataFrame, documents: DataFrame) -> DataFrame:
    """A run of chunks as a run of their documents (item_id, document_id): a document stands at its first chunk."""
    best = run.join(documents, "item_id").groupBy("query_id", "document_id").agg(F.min("rank").alias("place"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "document_id"))
    return best.select("query_id", F.col("document_id").alias("item_id"), rank.alias("rank"))


def exposure(run: DataFrame, negatives: DataFrame, spans: DataFrame, depth: int) -> DataFrame:
    """(query_id, judged_negatives, hits, exposure): share of a query's negatives (query_id, span_id, grade) in its first `depth` items.

    spans: (item_id, span_id). A negative of grade 2 or more raises.
    """
    checked = negatives.withColumn("grade", F.when(F.col("grade").between(0, 1), F.col("grade")).otherwise(F.raise_error(F.lit("a negative's grade is above 1")).cast("int")))
    top = run.where(F.col("rank") <= depth).select("query_id", "item_id").join(spans, "item_id").select("query_id", "span_id", F.lit(1).alias("seen")).distinct()
    rows = checked.join(top, ["query_id", "span_id"], "left")
    return rows.groupBy("query_id").agg(F.count("*").alias("judged_negatives"), F.count("seen").alias("hits"), F.sum("grade").alias("_g")).select("query_id", "judged_negatives", "hits", rounded(F.col("hits") / F.col("judged_negatives")).alias("exposure"))


def exposure_of(graded: DataFrame, counts: DataFrame, depth: int) -> DataFrame:
    """exposure() where every item is a span: of a run with its items' grades (query_id, rank, grade) and the number of judged items by query and grade (query_id, grade, n)."""
    negatives = counts.where("grade <= 1").groupBy("query_id").agg(F.sum("n").alias("judged_negatives"))
    top = graded.where((F.col("rank") <= depth) & (F.col("grade") <= 1)).groupBy("query_id").agg(F.count("*").alias("hits"))
    return negatives.join(top, "query_id", "left").fillna(0, ["hits"]).select("query_id", "judged_negatives", "hits", rounded(F.col("hits") / F.col("judged_negatives")).alias("exposure"))


def auroc_ap(rows: DataFrame) -> DataFrame:
    """One row (auroc, ap, ap_by_rank) of (id, label 0/1, score): ties count a half; ap takes tied rows together,
    ap_by_rank one by one in order of id. Scores are grouped before they are ordered."""
    by_score = rows.groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    up = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = by_score.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("pos")).over(up), F.lit(0))).withColumn("seen", F.sum("n").over(down)).withColumn("hits", F.sum("pos").over(down))
    total = placed.agg(
        F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2.0)).alias("wins"),
        F.sum(F.col("pos") * F.col("hits") / F.col("seen")).alias("precision"),
        F.sum("pos").alias("p"),
        F.sum(F.col("n") - F.col("pos")).alias("q"),
    )
    one = Window.orderBy(F.col("score").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    strict = rows.withColumn("k", F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))).withColumn("h", F.sum("label").over(one)).agg(F.sum(F.when(F.col("label") == 1, F.col("h") / F.col("k"))).alias("strict"))
    return total.crossJoin(strict).select(rounded(F.try_divide("wins", F.col("p") * F.col("q"))).alias("auroc"), rounded(F.try_divide("precision", "p")).alias("ap"), rounded(F.try_divide("strict", "p")).alias("ap_by_rank"))  # one row each


def risk_coverage(rows: DataFrame) -> DataFrame:
    """(threshold, coverage, risk) for each distinct score: share of rows at or above it, and of those the share labelled 0."""
    by_score = rows.groupBy("score").agg(F.sum(1 - F.col("label")).alias("bad"), F.count("*").alias("n"))
    down = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return by_score.select(F.col("score").alias("threshold"), rounded(F.sum("n").over(down) / F.sum("n").over(every)).alias("coverage"), rounded(F.sum("bad").over(down) / F.sum("n").over(down)).alias("risk"))


def evidence(cards: DataFrame, gold: DataFrame, nuggets: DataFrame) -> DataFrame:
    """Per query: evidence_recall, nugget_recall, complete, irrelevant_ratio.

    cards: fragments (query_id, span_id, tokens, is_full); gold: (query_id, span_id); nuggets: (query_id, nugget_id, span_id).
    Only whole spans count; a query without cards has recall zero and ratio one.
    """
    found = cards.where("is_full").join(gold, ["query_id", "span_id"], "left_semi").select("query_id", "span_id").distinct().withColumn("found", F.lit(1))
    recall = gold.distinct().join(found, ["query_id", "span_id"], "left").groupBy("query_id").agg((F.count("found") / F.count("*")).alias("evidence_recall"))
    covered = nuggets.distinct().join(found, ["query_id", "span_id"], "left").groupBy("query_id", "nugget_id").agg(F.min(F.coalesce("found", F.lit(0))).alias("covered"))
    per_query = covered.groupBy("query_id").agg(F.avg("covered").alias("nugget_recall"), F.min("covered").cast("double").alias("complete"))
    marked = cards.join(gold.distinct().withColumn("g", F.lit(1)), ["query_id", "span_id"], "left")
    waste = marked.groupBy("query_id").agg((1 - F.sum(F.when(F.col("is_full") & F.col("g").isNotNull(), F.col("tokens")).otherwise(0)) / F.sum("tokens")).alias("irrelevant_ratio"))
    return recall.join(per_query, "query_id", "left").join(waste, "query_id", "left").fillna(1.0, ["irrelevant_ratio"]).select("query_id", *[rounded(F.col(c)).alias(c) for c in ("evidence_recall", "nugget_recall", "complete", "irrelevant_ratio")])


def percentiles(values: Column) -> list[Column]:
    """p50, p90, p95, p99 by linear interpolation, and the same by nearest rank."""
    names = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return [rounded(F.percentile(values, F.lit(p))).alias(n) for n, p in names.items()]


def source_document_qrels(judgments: DataFrame, nuggets: DataFrame) -> DataFrame:
    """(query_id, item_id, grade) of documents from span judgments (query_id, document_id, topical, hits array) and nuggets (query_id, nugget_id): a document has what its spans have."""
    need = nuggets.groupBy("query_id").agg(F.array_sort(F.collect_set("nugget_id")).alias("need"))
    state = judgments.groupBy("query_id", F.col("document_id").alias("item_id")).agg(F.bool_or("topical").alias("topical"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("got"))
    return state.join(need, "query_id").select("query_id", "item_id", grade(F.col("topical"), F.col("got"), F.col("need")).alias("grade"))


def hit_rates(run: DataFrame, negatives: DataFrame, spans: DataFrame, depths: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(provenance, negatives, hit_rate_k for each depth): share of hard negatives (query_id, span_id, provenance) some item of which stands in the first k; provenance null is all of them.

    spans: (item_id, span_id).
    """
    top = run.where(F.col("rank") <= max(depths)).select("query_id", "item_id", "rank").join(spans, "item_id").groupBy("query_id", "span_id").agg(F.min("rank").alias("best"))
    rows = negatives.join(top, ["query_id", "span_id"], "left")
    rates = [rounded(F.count(F.when(F.col("best") <= k, 1)) / F.count("*")).alias(f"hit_rate_{k}") for k in depths]
    return rows.rollup("provenance").agg(F.count("*").alias("negatives"), *rates)


def bundle(run: DataFrame, qrels: DataFrame, negatives: DataFrame, spans: DataFrame, label: str) -> DataFrame:
    """One row of a run's macro metrics and its hard-negative exposure at five, under `label`."""
    per_query = ranking_metrics(run, qrels)
    names = [c for c in per_query.columns if c != "query_id"]
    means = per_query.agg(F.count("*").alias("queries"), *[rounded(F.avg(c)).alias(c) for c in names])
    risk = exposure(run, negatives, spans, 5).agg(rounded(F.avg("exposure")).alias("exposure_5"))
    return means.crossJoin(risk).select(F.lit(label).alias("system"), *means.columns, "exposure_5")  # one row each
