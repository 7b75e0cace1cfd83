"""Topic briefs and span annotations: their rules, agreement, and the benchmark built of them.

A submission is (brief_id, annotator_id, answerability, no_answer_reason, topology, nuggets array<struct<local_id, text, required, spans>>,
judgments array<struct<span_id, grade, local_ids>>). Checks return one row for each broken rule, (id, rule), so that a count of zero is a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.judging import grade
from evidentia.functions.numeric import rounded
from evidentia.functions.text import duplicate_key, jaccard, stable_id

#: How many spans and documents the positives of each evidence topology have.
TOPOLOGIES = {"single_span": "spans = 1", "same_page_multi_span": "spans >= 2 and documents = 1", "cross_page": "spans >= 2 and documents >= 2"}


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for every rule that a row breaks; a null condition counts as broken. One pass over the rows."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.col(key).alias("id"), F.explode(names).alias("rule"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def quota_differences(rows: DataFrame, quotas: dict[str, dict[str, int]]) -> DataFrame:
    """(attribute, value, expected, actual) where a value's rows differ from its quota; values without a quota are expected never."""
    spark = rows.sparkSession
    parts = []
    for attribute, counts in quotas.items():
        wanted = spark.createDataFrame(sorted(counts.items()), "value string, expected long")
        held = rows.where(F.col(attribute).isNotNull()).groupBy(F.col(attribute).cast("string").alias("value")).agg(F.count("*").alias("actual"))
        parts.append(wanted.join(held, "value", "full_outer").select(F.lit(attribute).alias("attribute"), "value", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).where("expected <> actual"))
    return union(parts)


def quota_sums(quotas: dict[str, dict[str, int]], totals: dict[str, int]) -> list[tuple[str, int, int]]:
    """(attribute, expected, actual) of attributes whose quotas don't add up to their total."""
    return [(a, totals[a], sum(q.values())) for a, q in sorted(quotas.items()) if sum(q.values()) != totals[a]]


def brief_checks(briefs: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, rule) of broken rules of briefs (brief_id, number, query_text, answerability, no_answer_reason, topology, hints array, smoke, smoke_slice).

    documents: (hint), the known ones. Briefs are numbered without a gap, texts differ in more than case and white space.
    """
    order = Window.orderBy("number")  # a benchmark's briefs
    same = Window.partitionBy(duplicate_key("query_text")).orderBy("number")
    answerable = F.col("answerability") == "answerable"
    rows = briefs.withColumn("_k", F.row_number().over(order) - 1 + F.min("number").over(Window.partitionBy())).withColumn("_same", F.row_number().over(same))
    rules = {
        "numbering": F.col("number") == F.col("_k"),
        "repeated_text": F.col("_same") == 1,
        "sidecar": answerable == (F.col("no_answer_reason").isNull() & F.col("topology").isNotNull()),
        "no_hint": ~answerable | (F.size("hints") > 0),
        "smoke": F.col("smoke") == F.col("smoke_slice").isNotNull(),
    }
    unknown = briefs.select("brief_id", F.explode("hints").alias("hint")).join(documents, "hint", "left_anti").select(F.col("brief_id").alias("id"), F.lit("unknown_hint").alias("rule")).distinct()
    return broken(rows, "brief_id", rules).unionByName(unknown)


def annotation_checks(submissions: DataFrame, briefs: DataFrame, spans: DataFrame, reasons: list[str]) -> DataFrame:
    """(id, rule) of broken rules of submissions for briefs (brief_id) over spans (span_id, document_id)."""
    local, judged = F.transform("nuggets", lambda n: n["local_id"]), F.transform("judgments", lambda j: j["span_id"])
    used = F.flatten(F.transform("judgments", lambda j: j["local_ids"]))
    evidence = F.flatten(F.transform("nuggets", lambda n: n["spans"]))
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    positives = submissions.select("brief_id", F.explode(F.filter("judgments", lambda j: j["grade"] >= 2)).alias("j")).select("brief_id", "j.span_id").distinct()
    reach = positives.join(spans, "span_id").groupBy("brief_id").agg(F.count("*").alias("spans"), F.countDistinct("document_id").alias("documents"))
    rows = submissions.join(reach, "brief_id", "left").fillna(0, ["spans", "documents"])
    answerable = F.col("answerability") == "answerable"
    fits = reduce(lambda c, t: c.when(F.col("topology") == t, F.expr(TOPOLOGIES[t])), TOPOLOGIES, F).otherwise(False)
    rules = {
        "repeated_nugget": F.size(local) == F.size(F.array_distinct(local)),
        "repeated_span": F.size(judged) == F.size(F.array_distinct(judged)),
        "unknown_nugget": inside(used, local),
        "unjudged_evidence": inside(evidence, judged),
        "sidecar": F.when(answerable, F.col("no_answer_reason").isNull() & F.col("topology").isNotNull()).otherwise(F.col("no_answer_reason").isin(reasons) & F.col("topology").isNull()),
        "evidence": F.when(answerable, F.exists("nuggets", lambda n: n["required"]) & (F.col("spans") > 0)).otherwise((F.size("nuggets") == 0) & (F.col("spans") == 0)),
        "topology": ~answerable | F.col("topology").isNull() | fits,
    }
    held = submissions.groupBy("brief_id").agg(F.count("*").alias("n"))
    counts = briefs.select("brief_id").join(held, "brief_id", "full_outer")
    number = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    unknown = submissions.select("brief_id", F.explode(judged).alias("span_id")).join(spans, "span_id", "left_anti").select(F.col("brief_id").alias("id"), F.lit("unknown_span").alias("rule")).distinct()
    return union([broken(rows, "brief_id", rules).distinct(), counts.where(number.isNotNull()).select(F.col("brief_id").alias("id"), number.alias("rule")), unknown])


def agreement(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """(brief_id, jaccard, common, equal_grades, same_fields, differs) of two annotators' submissions, by brief.

    jaccard compares the spans of grade 2 and above, 1 where neither has any; grades are compared on spans that both judged.
    """
    flat = lambda s: s.select("brief_id", *fields, F.transform(F.filter("judgments", lambda j: j["grade"] >= 2), lambda j: j["span_id"]).alias("positive"), F.map_from_entries(F.transform("judgments", lambda j: F.struct(j["span_id"], j["grade"]))).alias("grades"))
    a, b = flat(left).alias("a"), flat(right).alias("b")
    both = a.join(b, "brief_id")
    shared = F.array_intersect(F.map_keys("a.grades"), F.map_keys("b.grades"))
    equal = F.filter(shared, lambda s: F.try_element_at(F.col("a.grades"), s) == F.try_element_at(F.col("b.grades"), s))
    fields_equal = reduce(lambda x, y: x & y, [F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields], F.lit(True))
    rows = both.select("brief_id", rounded(jaccard("a.positive", "b.positive")).alias("jaccard"), F.size(shared).alias("common"), F.size(equal).alias("equal_grades"), fields_equal.alias("same_fields"))
    return rows.withColumn("differs", ~F.col("same_fields") | (F.col("jaccard") < 1) | (F.col("equal_grades") < F.col("common")))


def build(submissions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nuggets (id, query_id, text, required, spans), judgments (id, query_id, span_id, topical, hits, grade) and hard negatives (id, query_id, span_id, grade) of adjudicated submissions.

    Ids hash what they name; grades are derived from topic and required nuggets, not taken over; hits are sorted ids.
    """
    query = F.concat(F.lit("seed-"), F.col("brief_id"))
    n = submissions.select(query.alias("query_id"), F.explode("nuggets").alias("n")).select("query_id", "n.*")
    named = n.withColumn("id", F.concat(F.lit("nugget-"), stable_id("query_id", "local_id", "text", F.array_join(F.array_sort("spans"), ";"))))
    ids = named.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("local_id", "id"))).alias("names"), F.array_sort(F.collect_list(F.when(F.col("required"), F.col("id")))).alias("need"))
    j = submissions.select(query.alias("query_id"), F.explode("judgments").alias("j")).select("query_id", "j.span_id", F.col("j.grade").alias("given"), "j.local_ids").join(ids, "query_id", "left")
    hits = F.array_sort(F.array_distinct(F.array_compact(F.transform("local_ids", lambda x: F.try_element_at(F.col("names"), x)))))
    need = F.coalesce("need", F.array().cast("array<string>"))
    found = F.coalesce(F.array_intersect(hits, need), F.array().cast("array<string>"))
    rows = j.withColumn("topical", F.col("given") >= 1).withColumn("hits", found).withColumn("grade", grade(F.col("topical"), F.col("hits"), need))
    judged = rows.select(F.concat(F.lit("judgment-"), stable_id("query_id", "span_id", "topical", F.array_join("hits", ";"))).alias("id"), "query_id", "span_id", "topical", "hits", "grade")
    negatives = rows.where("given <= 1").select(F.concat(F.lit("negative-"), stable_id("query_id", "span_id")).alias("id"), "query_id", "span_id", F.col("given").alias("grade"))
    return named.select("id", "query_id", "text", "required", "spans"), judged, negatives
