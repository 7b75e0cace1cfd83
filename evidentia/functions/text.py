"""Scalar functions over text columns: analysis, normalising, identifiers, query decomposition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The analyzer's token pattern, the same in Java and RE2.
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: One character of white space, Unicode's and the four separators below the space; the same in Java and RE2.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
#: Words that the analyzer leaves out.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]
#: The clause borders of a query, the least words of a clause, and the most subqueries.
CLAUSES, CLAUSE_WORDS, SUBQUERIES = r"(?i)\s*(?:;|,\s*(?:and\s+|then\s+)?|\bthen\b)\s*", 2, 4


def analyze(text: Column | str, stopwords: list[str] | None = None) -> Column:
    """Lower-cased tokens in order, stopwords left out; null gives null."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    drop = STOPWORDS if stopwords is None else stopwords
    return F.filter(tokens, lambda t: ~t.isin(drop)) if drop else tokens


def token_set(text: Column | str) -> Column:
    """Distinct lower-cased word tokens of any length, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def overlap_ratio(wanted: Column | str, found: Column | str) -> Column:
    """Share of `wanted`'s elements that `found` has; arrays of distinct elements, zero for no elements."""
    return F.size(F.array_intersect(wanted, found)) / F.greatest(F.lit(1), F.size(wanted))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two arrays as sets; one if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def normalize_rendered(text: Column | str) -> Column:
    """LF line ends, no white space at line ends, no blank lines at either end, one blank line at most between others."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    stripped = F.regexp_replace(lf, r"(?m)[ \t\f\x0b]+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, r"^\n+|\n+$", ""), r"\n{3,}", "\n\n")


def collapse(text: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def lexical(headings: Column | str, text: Column | str) -> Column:
    """Headings joined by ` > ` before the text, white space collapsed."""
    return collapse(F.concat_ws(" ", F.concat_ws(" > ", headings), text))


def stable_id(*parts: Column | str, length: int = 32) -> Column:
    """The first `length` hexadecimal digits of SHA-256 over NUL-joined parts; null parts count as empty."""
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\0", *columns), 256), 1, length)


def strip_ansi(text: Column | str) -> Column:
    """Text without terminal colours. Fixed value: the pattern of their escapes."""
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def substitutions(text: Column | str) -> Column:
    """Names between bars, as in `|name|`."""
    return F.regexp_extract_all(text, F.lit(r"\|([^|\n]+)\|"), F.lit(1))


def duplicate_key(text: Column | str) -> Column:
    """Queries that differ in case and white space alone share this key."""
    return F.lower(collapse(text))


def subqueries(text: Column | str) -> Column:
    """A query, then its first clause, then each later clause after the first one; a query of fewer than two clauses alone.

    Clauses have CLAUSE_WORDS words or more; repeats that differ in case alone go; at most SUBQUERIES remain.
    """
    query = collapse(text)
    clauses = F.filter(F.transform(F.split(query, CLAUSES), lambda c: F.regexp_replace(c, r"^[ ,;?.]+|[ ,;?.]+$", "")), lambda c: F.size(F.split(c, " ")) >= CLAUSE_WORDS)
    anchor = F.get(clauses, F.lit(0))
    rest = F.transform(F.slice(clauses, F.lit(2), F.greatest(F.size(clauses) - 1, F.lit(0))), lambda c: F.concat(anchor, F.lit(" "), c))
    every = F.concat(F.array(query, anchor), rest)
    seen = F.transform(every, lambda c: F.lower(c))
    first = F.filter(every, lambda c, i: F.array_position(seen, F.lower(c)) == i + 1)
    return F.when(F.size(clauses) < 2, F.array(query)).otherwise(F.slice(first, 1, SUBQUERIES))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order, nulls kept, no spaces."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
