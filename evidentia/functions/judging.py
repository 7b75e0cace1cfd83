"""Grades and other conditional labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grade(topical: Column, hits: Column, required: Column) -> Column:
    """0 off topic, 1 on topic without a required fact, 2 with some, 3 with all; impossible input raises.

    hits, required: arrays of distinct nugget ids.
    """
    unknown = F.size(F.array_except(hits, required)) > 0
    none = F.size(hits) == 0
    every = (F.size(required) > 0) & (F.size(F.array_except(required, hits)) == 0)
    return (
        F.when(unknown, F.raise_error(F.lit("a hit is not a required nugget")).cast("int"))
        .when(~topical & ~none, F.raise_error(F.lit("hits off topic")).cast("int"))
        .when(~topical, 0)
        .when(none, 1)
        .when(every, 3)
        .otherwise(2)
    )


def wrong_version(reason: Column, judged: Column) -> Column:
    """A query without an answer for its version, and a judged grade of 0 or 1."""
    return F.coalesce((reason == "wrong_version") & (judged <= 1), F.lit(False))


#: What each provenance makes of a negative; others have no class.
NEGATIVE_CLASSES = {
    "wrong_module_candidate": "wrong_module",
    "lexical_candidate": "lexical_collision",
    "semantic_candidate": "semantic_nearest",
    "hybrid_candidate": "baseline_false_positive",
    "rerank_candidate": "baseline_false_positive",
}
#: The provenance of what each kind of run finds.
PROVENANCE = {"bm25": "lexical_candidate", "dense": "semantic_candidate", "hybrid": "hybrid_candidate", "rerank": "rerank_candidate"}


def provenance(system: Column) -> Column:
    """The provenance label of a run's system; unknown systems raise."""
    known = F.create_map(*[F.lit(x) for kv in PROVENANCE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, system), F.raise_error(F.concat(F.lit("unknown system "), system)).cast("string"))


def negative_classes(provenance: Column, reason: Column) -> Column:
    """Sorted distinct classes of a negative; a wrong-version query has that class alone."""
    known = F.create_map(*[F.lit(x) for kv in NEGATIVE_CLASSES.items() for x in kv])
    classes = F.array_sort(F.array_distinct(F.array_compact(F.transform(provenance, lambda p: F.try_element_at(known, p)))))
    return F.when(reason == "wrong_version", F.array(F.lit("wrong_version"))).otherwise(classes)
