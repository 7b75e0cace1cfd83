"""Record rules, table digests, double runs, manifests and approval gates."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import overlap_ratio, token_set

#: Digests of tables are below this number.
DIGESTS = (1 << 61) - 1
#: Rules for record kinds: column -> condition that every row must meet.
RECORDS: dict[str, dict[str, Column | str]] = {
    "query": {"id": "id is not null", "text": "length(text) > 0", "answerability": "answerability in ('answerable', 'no_answer')", "reason": "(no_answer_reason is null) = (answerability = 'answerable')"},
    "judgment": {"grade": "grade between 0 and 3", "topical": "topic_relevance or size(required_nugget_hits) = 0"},
    "chunk": {"tokens": "token_count between 1 and 512", "text": "length(text) > 0"},
    "card": {"rank": "rank >= 1", "tokens": "token_count between 1 and 2048", "cumulative": "cumulative_token_count >= token_count"},
    "ranking": {"rank": "rank >= 1", "item": "item_id is not null", "score": "score is not null"},
}


def violations(rows: DataFrame, kind: str) -> DataFrame:
    """(rule, broken) for the rules of a record kind; a null condition counts as broken. One pass over the rows."""
    rules = RECORDS[kind]
    counts = rows.agg(*[F.count(F.when(~F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)), 1)).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "broken"))


def digest(rows: DataFrame) -> DataFrame:
    """One row (n, digest) that doesn't depend on the order of rows: the sum of 48 bits of each row's MD5, modulo DIGESTS, columns in order of name, nulls marked."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]
    bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce((F.sum(bits) % F.lit(DIGESTS).cast("decimal(20,0)")).cast("long"), F.lit(0)).alias("digest"))


def same_twice(run: Callable[[], DataFrame]) -> bool:
    """Whether two runs give the same rows."""
    return digest(run()).first() == digest(run()).first()


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys of `rows` that `known` lacks."""
    return rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def manifest(spark: SparkSession, paths: dict[str, str]) -> dict[str, dict]:
    """Name -> rows and digest of each Parquet output; small enough to keep beside it."""
    return {name: digest(spark.read.parquet(path)).first().asDict() for name, path in sorted(paths.items())}


def check_manifest(spark: SparkSession, paths: dict[str, str], expected: dict[str, dict]) -> None:
    """Raise for outputs that differ from a manifest."""
    if wrong := [n for n, now in manifest(spark, paths).items() if now != expected.get(n)]:
        raise ValueError(f"outputs differ from the manifest: {', '.join(wrong)}")


def approval_id(subject: dict) -> str:
    """What an approval binds to: SHA-256 of the subject as canonical JSON."""
    return hashlib.sha256(json.dumps(subject, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def require_approval(approval: dict, subject: dict) -> None:
    """Raise unless the approval is given and bound to exactly this subject."""
    if approval.get("status") != "approved" or approval.get("subject_sha256") != approval_id(subject):
        raise PermissionError("no approval for this subject")


def extraction_checks(pages: DataFrame, units: DataFrame, excluded: DataFrame, types: list[str], least: float = 0.8) -> DataFrame:
    """(rule, broken) on units (page_id, ordinal, node_type, text, unit_id) of pages (page_id, html): repeated ids and places, units of no page, pages
    without units that aren't excluded (page_id), types that never occur, headings that share fewer than `least` of their words with their page, empty texts."""
    count = lambda rows, rule: rows.agg(F.count("*").alias("broken")).select(F.lit(rule).alias("rule"), "broken")
    twice = lambda *keys: units.groupBy(*keys).count().where("count > 1")
    lacking = pages.select("page_id").join(units.select("page_id").distinct(), "page_id", "left_anti").join(excluded.select("page_id"), "page_id", "left_anti")
    kinds = units.select(F.substring_index("node_type", ":", 1).alias("t")).distinct()
    unseen = units.sparkSession.createDataFrame([(t,) for t in types], "t string").join(kinds, "t", "left_anti")
    headings = units.where("node_type = 'heading'").join(pages.select("page_id", token_set("html").alias("known")), "page_id")
    poor = headings.where(overlap_ratio(token_set("text"), "known") < least)
    rows = [count(twice("unit_id"), "repeated_id"), count(twice("page_id", "ordinal"), "repeated_place"), count(units.join(pages, "page_id", "left_anti"), "unknown_page"), count(lacking, "page_without_units"), count(unseen, "missing_type"), count(poor, "heading_off_source"), count(units.where("trim(text) = ''"), "empty_text")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often."""
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def reported_digest(report: Column) -> Column:
    """The annotation's digest in a report's JSON text: under one of four names, or that of the adjudicator's file among the bound outputs; null if none has it."""
    at = lambda p: F.get_json_object(report, p)
    outputs = F.from_json(at("$.bound_outputs"), "array<struct<path:string,sha256:string>>")
    bound = F.get(F.filter(outputs, lambda o: o["path"].endswith("/adjudicator.jsonl")), F.lit(0))["sha256"]
    return F.coalesce(at("$.annotation_sha256"), at("$.annotation_file_sha256"), at("$.adjudicator_sha256"), at("$.input_hashes.annotation"), bound)
