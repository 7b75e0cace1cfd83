"""Documents and pages into ordered evidence units."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.html import walk

#: Lines in a section and in a parent section of a plain document.
SECTION, PARENT = 8, 32

_LINKS = "array<struct<text:string,target:string>>"
_PAGE = f"units array<struct<tag:string,node_type:string,text:string,anchors:array<string>,tab:string,links:{_LINKS}>>, links {_LINKS}"


def source_lines(text: Column | str) -> Column:
    """A text's lines: a byte-order mark at its start goes, CR LF and CR end lines as LF does."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r\n?", "\n"), "\n")


def parent_section(parent: Column | str) -> Column:
    """The section that stands for a parent of units_from_documents(): its first one."""
    return (F.col(parent) if isinstance(parent, str) else parent) * (PARENT // SECTION)


def units_from_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, section, parent, text, n_tokens): the lines of each document, in order.

    A document has no headings, so its sections are runs of SECTION lines under parents of PARENT lines.
    """
    lines = docs.select("doc_id", F.posexplode(source_lines("text")).alias("ordinal", "text"))
    return lines.select("doc_id", "ordinal", F.floor(F.col("ordinal") / SECTION).cast("int").alias("section"), F.floor(F.col("ordinal") / PARENT).cast("int").alias("parent"), "text", F.size(T.analyze("text", [])).alias("n_tokens"))


def _walked(html: str) -> Column:
    """struct<units, links> of a column of pages."""
    names = ("tag", "node_type", "text", "anchors", "tab")
    linked = lambda found: [{"text": t, "target": to} for t, to in found]

    @F.pandas_udf(_PAGE)
    def walked(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in blocks:
            rows = [walk(html) for html in pages]
            yield pd.DataFrame({"units": [[dict(zip(names, u[:5], strict=True)) | {"links": linked(u[5])} for u in units] for units, _ in rows], "links": [linked(links) for _, links in rows]})

    return walked(html)


def units_from_pages(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, node_type, heading, heading_path, section_id, parent_id, text, unit_id, anchors, tab, links): the units of each page, in order.

    Every character of text outside scripts, styles and comments is in one unit, that of the innermost tag that makes one (functions/html.py): headings, paragraphs, list
    items less their nested lists, rows as their cells joined by " | ", terms and definitions, quotes, captions, code, admonitions by kind; images give their alternative text, text in no
    such tag is a paragraph up to the next block tag. White space is collapsed, units without text are left out. anchors are ids in the unit, or on blocks before it; tab is the label
    of the panel that the unit is in. heading is the nearest heading at or before the unit; heading_path are those open there, a heading being open
    until one of its level or above comes. A section's id hashes its heading's place, the place -1 standing for the page itself.
    """
    nodes = pages.select("page_id", F.posexplode(_walked("html")["units"]).alias("ordinal", "node")).select("page_id", "ordinal", "node.*")
    rows = nodes.withColumn("text", T.collapse("text")).where("text <> ''")
    return _sections(rows).withColumn("unit_id", T.stable_id("page_id", "ordinal", "text"))


def _sections(rows: DataFrame) -> DataFrame:
    """`rows` (page_id, ordinal, tag, node_type, text) with the headings open at each row."""
    before = Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    at_level = lambda k, c: F.last(F.when(F.col("tag") == f"h{k}", F.col(c)), True).over(before)
    seen = rows.withColumn("heading", F.last(F.when(F.col("node_type") == "heading", F.col("text")), True).over(before))
    for k in range(1, 7):
        seen = seen.withColumn(f"_o{k}", at_level(k, "ordinal")).withColumn(f"_t{k}", at_level(k, "text"))
    last = lambda k: F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_o{j}"), F.lit(-1)) for j in range(1, k)], F.lit(-1))
    open_ = F.array_compact(F.array(*[F.when(F.col(f"_o{k}") > last(k), F.struct(F.col(f"_o{k}").alias("at"), F.col(f"_t{k}").alias("text"))) for k in range(1, 7)]))
    place = lambda i: F.coalesce(F.get(F.reverse(F.col("_open")), F.lit(i))["at"], F.lit(-1))
    placed = seen.withColumn("_open", open_).withColumn("heading_path", F.when(F.size("_open") > 0, F.array_join(F.transform("_open", lambda h: h["text"]), " > ")))
    return placed.withColumn("section_id", T.stable_id("page_id", place(0))).withColumn("parent_id", T.stable_id("page_id", place(1))).select("page_id", "ordinal", "node_type", "text", "heading", "heading_path", "section_id", "parent_id", "anchors", "tab", "links")


def cross_references(pages: DataFrame) -> DataFrame:
    """(page_id, position, text, target) of every link, its text with white space collapsed."""
    return pages.select("page_id", F.posexplode(_walked("html")["links"]).alias("position", "link")).select("page_id", "position", T.collapse("link.text").alias("text"), "link.target")


def include_sites(docs: DataFrame) -> DataFrame:
    """(doc_id, line, target) of include and literalinclude directives, lines counted from one. A target goes to the line's end, blanks in it included; quotes around it go."""
    lines = docs.select("doc_id", F.posexplode(source_lines("text")).alias("line", "text"))
    target = F.regexp_replace(F.regexp_extract("text", r"^[ \t]*\.\.[ \t]+(?:literal)?include::[ \t]*([^ \t].*?)[ \t]*$", 1), "^[\"']+|[\"']+$", "")
    return lines.select("doc_id", (F.col("line") + 1).alias("line"), target.alias("target")).where("target <> ''")


def sibling_headings(headings: DataFrame) -> DataFrame:
    """`headings` (doc_id, parent, ordinal, heading_id) with the heading before and after under the same parent."""
    order = Window.partitionBy("doc_id", "parent").orderBy("ordinal")
    return headings.withColumn("before", F.lag("heading_id").over(order)).withColumn("after", F.lead("heading_id").over(order))


def _lines_of(text: str, quotes: list[tuple[str, int]]) -> list[int | None]:
    """The line of each quote (text, hint), the text's lines and their starts looked up once for all of them."""
    lines = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    bare = [x.strip() for x in lines]
    by_line: dict[str, list[int]] = {}
    for i, x in enumerate(bare):
        by_line.setdefault(x, []).append(i)
    found: list[int | None] = []
    for quote, hint in quotes:
        at, places = text.find(quote), []
        while at >= 0:
            line = bisect_right(starts, at)
            places.append(line)
            # the next that matters starts after this one, as a plain search from left to right finds it
            at = text.find(quote, at + len(quote))
        if not places:
            wanted = [x.strip() for x in quote.split("\n")]
            places = [i + 1 for i in by_line.get(wanted[0], ()) if bare[i : i + len(wanted)] == wanted]
        found.append(min(places, key=lambda x: (abs(x - hint), x), default=None))
    return found


def locate_lines(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, quote, hint, line): for each quote (doc_id, quote, hint) the line on which its text starts that is nearest to the hint, counted from one.

    Where the exact text is nowhere, runs of lines that equal the quote's but for white space at their ends count, found by their first line. Of two equally
    near lines the first wins. Empty quotes and those found nowhere are left out. A document's text travels and is cut into lines once for all its quotes, which are one row.
    """
    asked = quotes.where("quote <> ''").groupBy("doc_id").agg(F.collect_set(F.struct("quote", "hint")).alias("quotes"))
    rows = asked.join(docs.select("doc_id", F.array_join(source_lines("text"), "\n").alias("text")), "doc_id")

    @F.pandas_udf("array<int>")
    def located(blocks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, asked_of in blocks:
            yield pd.Series([_lines_of(t or "", [(q["quote"], q["hint"]) for q in some]) for t, some in zip(texts, asked_of, strict=True)], dtype=object)

    found = rows.withColumn("lines", located("text", "quotes")).select("doc_id", F.explode(F.arrays_zip("quotes", "lines")).alias("f"))
    return found.select("doc_id", "f.quotes.quote", "f.quotes.hint", F.col("f.lines").alias("line")).where("line is not null")


def source_refs(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line, start_column, end_column, quote_sha256, origin) of line ranges (doc_id, start_line, end_line, origin) of documents.

    Ranges that start outside their document are left out; ends are clamped to it. Columns count from one: the first line's
    first character that isn't white space, and one past the last line's end. Equal references of one document are one.
    """
    n = F.size("_lines")
    rows = ranges.join(docs.select("doc_id", source_lines("text").alias("_lines")), "doc_id").where((F.col("start_line") >= 1) & (F.col("start_line") <= n))
    clamped = rows.withColumn("end_line", F.greatest("start_line", F.least("end_line", n)))
    first, last = F.get("_lines", F.col("start_line") - 1), F.get("_lines", F.col("end_line") - 1)
    quote = F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return clamped.select("doc_id", "start_line", "end_line", (F.length(first) - F.length(F.regexp_replace(first, f"^{T.SPACE}+", "")) + 1).alias("start_column"), (F.length(last) + 1).alias("end_column"), F.sha2(quote, 256).alias("quote_sha256"), "origin").distinct()


def merge_line_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (doc_id, start_line, end_line, origin) merged where they touch, overlap or follow each other line by line, for each document and origin."""
    order = Window.partitionBy("doc_id", "origin").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.col("start_line") > reach + 1, F.lit(True)).cast("int")
    runs = ranges.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "origin", "_run").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_run")
