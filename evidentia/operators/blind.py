"""The double-blind workflow: canonical review items, calibration picks, packets, templates, isolation of hidden topics, submission rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.judging import grade
from evidentia.functions.text import stable_id
from evidentia.operators.benchmark import broken, union
from evidentia.operators.retrieval import near


def canonical_reviews(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (id, query_id, first_item, items, minimum_depth, reasons) and members (id, item_id) of review rows (query_id, spans array, item_id, depth, reasons array).

    Rows of one query with the same set of spans are one item, named by a hash of both. Members are rows of their own,
    so a group may have any number of them; reasons are a few labels.
    """
    spans = F.array_sort(F.array_distinct("spans"))
    checked = F.when(F.size("spans") > 0, spans).otherwise(F.raise_error(F.lit("a review row has no span")).cast("array<string>"))
    named = rows.withColumn("spans", checked).withColumn("id", F.concat(F.lit("canonical-review-"), stable_id("query_id", F.array_join("spans", ";"))))
    reasons = named.select("id", F.explode_outer("reasons").alias("reason")).where("reason is not null").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    groups = named.groupBy("id", "query_id").agg(F.min("item_id").alias("first_item"), F.countDistinct("item_id").alias("items"), F.min("depth").alias("minimum_depth"))
    return groups.join(reasons, "id", "left").fillna("", ["reasons"]), named.select("id", "item_id").distinct()


def calibration(rows: DataFrame, quotas: dict[str, int], allowed: dict[str, Column] | None = None) -> DataFrame:
    """(bucket, id) picked from rows (id, reasons array, stratum): for each bucket in the given order as many as its quota says, one of each stratum
    in turn, by id within a stratum; a row picked for one bucket is no candidate for the next. `allowed` restricts a bucket further.
    """
    used, picks = rows.select("id").limit(0), []
    for bucket, n in quotas.items():
        fit = rows.where(F.array_contains("reasons", bucket) & (allowed or {}).get(bucket, F.lit(True))).join(used, "id", "left_anti")
        turn = F.row_number().over(Window.partitionBy("stratum").orderBy("id"))
        chosen = fit.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", "stratum").limit(n).select(F.lit(bucket).alias("bucket"), "id")
        picks.append(chosen)
        used = used.union(chosen.select("id"))
    return union(picks)


def packet(items: DataFrame, queries: DataFrame, nuggets: DataFrame, evidence: DataFrame, packet_id: str) -> DataFrame:
    """(packet_id, id, query_id, query_text, answerability, required_nuggets, evidence) of items (id, query_id, spans array).

    evidence: (span_id, text), one row a span; an item with a span that it lacks raises. An item's spans are a chunk's, and so few.
    """
    need = nuggets.groupBy("query_id").agg(F.array_sort(F.collect_set("nugget_id")).alias("required_nuggets"))
    spans = items.select("id", F.posexplode("spans").alias("at", "span_id")).join(evidence, "span_id", "left")
    text = F.coalesce("text", F.raise_error(F.concat(F.lit("no evidence for span "), "span_id")).cast("string"))
    shown = spans.select("id", "at", "span_id", text.alias("text")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "span_id", "text"))), lambda e: F.struct(e["span_id"].alias("span_id"), e["text"].alias("text"))).alias("evidence"))
    rows = items.join(queries.select("query_id", "query_text", "answerability"), "query_id").join(need, "query_id", "left").join(shown, "id")
    return rows.select(F.lit(packet_id).alias("packet_id"), "id", "query_id", "query_text", "answerability", F.coalesce("required_nuggets", F.array().cast("array<string>")).alias("required_nuggets"), "evidence")


def submission_id(annotator: Column | str, item: Column | str) -> Column:
    return F.concat(F.lit("review-submission-"), stable_id(annotator, item))


def templates(items: DataFrame, annotator: str) -> DataFrame:
    """Empty submissions (id, packet_id, item_id, annotator_id, status) of an annotator for items (packet_id, id)."""
    who = F.lit(annotator)
    return items.select(submission_id(who, F.col("id")).alias("id"), "packet_id", F.col("id").alias("item_id"), who.alias("annotator_id"), F.lit("PENDING").alias("status"))


def leaks(public: DataFrame, hidden: DataFrame, pattern: str) -> DataFrame:
    """(source, hidden_id) of hidden ids (hidden_id) that stand in public texts (source, text); ids look like `pattern`."""
    found = public.select("source", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("hidden_id"))
    return found.join(near(hidden.select("hidden_id").distinct()), "hidden_id", "left_semi").select("source", "hidden_id")


def submission_checks(items: DataFrame, submissions: DataFrame, annotator: str) -> DataFrame:
    """(id, rule) of broken rules, by item, of submissions (id, packet_id, item_id, annotator_id, status, rationale, answerability, topical, hits, grade, spans, topic_issue)
    for items (id, packet_id, answerability, required array, spans array): exactly one each, bound to item, packet and annotator, complete, its grade derived.

    A topic issue stands alone: it excludes a label.
    """
    what = items.select(F.col("id").alias("item_id"), F.col("packet_id").alias("_packet"), F.col("answerability").alias("_answerability"), F.col("required").alias("_required"), F.col("spans").alias("_spans"))
    rows = submissions.join(what, "item_id")
    hits, spans = F.coalesce("hits", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast("array<string>"))
    issue = F.col("topic_issue").isNotNull()
    known = F.size(F.array_except(hits, "_required")) == 0
    sound = known & (F.col("topical") | (F.size(hits) == 0))
    derived = F.when(sound, grade(F.col("topical"), hits, F.col("_required")))
    empty = F.col("answerability").isNull() & F.col("topical").isNull() & (F.size(hits) == 0) & F.col("grade").isNull() & (F.size(spans) == 0)
    rules = {
        "annotator": F.col("annotator_id") == annotator,
        "id": F.col("id") == submission_id(F.lit(annotator), F.col("item_id")),
        "packet": F.col("packet_id") == F.col("_packet"),
        "status": F.col("status") == "SUBMITTED",
        "rationale": F.trim(F.coalesce("rationale", F.lit(""))) != "",
        "outside_span": F.size(F.array_except(spans, "_spans")) == 0,
        "issue_mixed": ~issue | empty,
        "answerability": issue | (F.col("answerability") == F.col("_answerability")),
        "no_topic": issue | F.col("topical").isNotNull(),
        "grade": issue | F.col("topical").isNull() | F.coalesce(F.col("grade") == derived, F.lit(False)),
        "span_off_topic": issue | ~F.coalesce(derived == 0, F.lit(False)) | (F.size(spans) == 0),
        "no_span": issue | ~F.coalesce(derived >= 1, F.lit(False)) | (F.size(spans) > 0),
    }
    found = broken(rows.withColumnRenamed("id", "_sid").withColumn("id", F.col("_sid")), "item_id", rules).distinct()
    held = submissions.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("n"))
    counts = items.select("id", F.lit(1).alias("known")).join(held, "id", "full_outer")
    number = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return found.unionByName(counts.where(number.isNotNull()).select("id", number.alias("rule")))


def disagreements(left: DataFrame, right: DataFrame) -> DataFrame:
    """(item_id) of items whose labels differ between two annotators' submissions, nulls compared as values; only items both have."""
    label = F.struct("answerability", "topical", "hits", "grade", "spans", "topic_issue")
    a, b = left.select("item_id", label.alias("a")), right.select("item_id", label.alias("b"))
    return a.join(b, "item_id").where(~F.col("a").eqNullSafe(F.col("b"))).select("item_id")


def adjudication_checks(items: DataFrame, left: DataFrame, right: DataFrame, adjudicated: DataFrame, annotator: str = "adjudicator") -> DataFrame:
    """(id, rule) of an adjudicator's submissions: those rules of submission_checks() over exactly the disagreement set."""
    open_ = disagreements(left, right).select(F.col("item_id").alias("id"))
    return submission_checks(items.join(open_, "id", "left_semi"), adjudicated, annotator)
