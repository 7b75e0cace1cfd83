"""Chunking policies over evidence units, with fragments that trace each chunk back to its units."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.numeric import common_prefix, intervals_length, scoring_windows

#: Fixed values of the policies: hard limit, target and minimum of a chunk; overlaps of fixed windows and of an overlong unit's.
LIMIT, TARGET, MINIMUM, FIXED_OVERLAP, UNIT_OVERLAP = 512, 384, 128, 100, 64


def _placed(units: DataFrame) -> DataFrame:
    """Units with the number of their first token in the document and the document's token count."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    total = F.sum("n_tokens").over(Window.partitionBy("doc_id"))
    return units.withColumn("first", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("total", total.cast("int"))


def fixed(units: DataFrame, size: int = LIMIT, overlap: int = FIXED_OVERLAP) -> DataFrame:
    """Fragments (doc_id, chunk, ordinal, section, parent, unit_start, unit_stop, chunk_start) of sliding token windows over each document.

    A unit's windows follow from its place alone, so units are not joined with windows.
    """
    step = size - overlap
    last = F.when(F.col("total") <= size, 0).otherwise(F.ceil((F.col("total") - size) / F.lit(step))).cast("int")
    lowest = F.greatest(F.lit(0), F.floor((F.col("first") - size) / F.lit(step)) + 1).cast("int")
    highest = F.least(last, F.floor((F.col("first") + F.col("n_tokens") - 1) / F.lit(step))).cast("int")
    rows = _placed(units).where("n_tokens > 0").withColumn("chunk", F.explode(F.sequence(lowest, highest)))
    begin = F.col("chunk") * step
    end = F.least(begin + size, F.col("total"))
    return rows.select(
        "doc_id",
        "chunk",
        "ordinal",
        "section",
        "parent",
        F.greatest(F.lit(0), begin - F.col("first")).cast("int").alias("unit_start"),
        F.least(F.col("n_tokens"), end - F.col("first")).cast("int").alias("unit_stop"),
        F.greatest(F.lit(0), F.col("first") - begin).cast("int").alias("chunk_start"),
    )


def _islands(units: DataFrame, key: str) -> DataFrame:
    """Units with the number of the consecutive run of equal `key` that they are in."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    new = (~F.lag(key).over(order).eqNullSafe(F.col(key))) | (F.row_number().over(order) == 1)
    return units.withColumn("run", (F.sum(new.cast("int")).over(order) - 1).cast("int"))


def sections(units: DataFrame) -> DataFrame:
    """(doc_id, chunk, section, first_ordinal, n_units, n_tokens, windows): one chunk for each run of a section, never cut."""
    runs = _islands(units, "section").groupBy("doc_id", F.col("run").alias("chunk"), "section").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("n_units"), F.sum("n_tokens").cast("int").alias("n_tokens"))
    return runs.withColumn("windows", scoring_windows(F.col("n_tokens")))


def _pack_step(state: Column, n: Column) -> Column:
    """One unit of n tokens: (bins, bin, pending tokens). An overlong unit closes the bin and takes as many as it has windows."""
    over = n > LIMIT
    closes = (state["held"] > 0) & ((state["pending"] >= TARGET) | (state["pending"] + n > LIMIT) | over)
    bin_ = state["bin"] + closes.cast("int")
    took = F.when(over, (1 + F.ceil((n - LIMIT) / F.lit(LIMIT - UNIT_OVERLAP))).cast("int")).otherwise(0)
    return F.struct(
        F.concat(state["bins"], F.array(bin_)).alias("bins"),
        (bin_ + took).alias("bin"),
        F.when(over, 0).otherwise(F.when(closes, n).otherwise(state["pending"] + n)).cast("int").alias("pending"),
        F.when(over, 0).otherwise(F.when(closes, 1).otherwise(state["held"] + 1)).cast("int").alias("held"),
    )


def packed(units: DataFrame) -> DataFrame:
    """Fragments of whole units packed in order within a section: a chunk closes at TARGET tokens, or where the next
    unit would pass LIMIT; a unit beyond LIMIT is cut alone into overlapping windows. chunk counts within the document."""
    runs = _islands(units, "section").groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("ordinal", "n_tokens", "section", "parent"))).alias("u"))
    start = F.struct(F.array().cast("array<int>").alias("bins"), F.lit(0).alias("bin"), F.lit(0).alias("pending"), F.lit(0).alias("held"))
    bins = runs.withColumn("bins", F.aggregate("u", start, lambda s, x: _pack_step(s, x["n_tokens"]), lambda s: s["bins"]))
    rows = bins.select("doc_id", "run", F.explode(F.arrays_zip("u", "bins")).alias("x")).select("doc_id", "run", F.col("x.u.ordinal").alias("ordinal"), F.col("x.u.n_tokens").alias("n"), F.col("x.u.section").alias("section"), F.col("x.u.parent").alias("parent"), F.col("x.bins").alias("bin"))
    step = LIMIT - UNIT_OVERLAP
    windows = F.when(F.col("n") > LIMIT, F.ceil((F.col("n") - LIMIT) / F.lit(step)).cast("int")).otherwise(0)
    cut = rows.withColumn("w", F.explode(F.sequence(F.lit(0), windows)))
    begin = F.when(F.col("n") > LIMIT, F.col("w") * step).otherwise(0)
    placed = cut.select("doc_id", "run", (F.col("bin") + F.col("w")).alias("bin"), "ordinal", "section", "parent", begin.cast("int").alias("unit_start"), F.when(F.col("n") > LIMIT, F.least(begin + LIMIT, F.col("n"))).otherwise(F.col("n")).cast("int").alias("unit_stop"))
    # number of the chunk in the document, and of the fragment's first token in the chunk
    chunk = (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("run", "bin")) - 1).cast("int")
    before = F.coalesce(F.sum(F.col("unit_stop") - F.col("unit_start")).over(Window.partitionBy("doc_id", "run", "bin").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return placed.withColumn("chunk", chunk).withColumn("chunk_start", before).select("doc_id", "chunk", "ordinal", "section", "parent", "unit_start", "unit_stop", "chunk_start")


def chunk_table(fragments: DataFrame) -> DataFrame:
    """(doc_id, chunk, parent, first_ordinal, last_ordinal, n_tokens, n_fragments) of a policy's fragments."""
    return fragments.groupBy("doc_id", "chunk").agg(
        F.min_by("parent", "ordinal").alias("parent"),
        F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
        F.sum(F.col("unit_stop") - F.col("unit_start")).cast("int").alias("n_tokens"),
        F.count("*").alias("n_fragments"),
    )


def best_partition(sizes: list[int]) -> list[int]:
    """Ends of the bins that put `sizes`, in order, into bins of at most LIMIT: fewest below MINIMUM, then nearest to
    TARGET in sum, then fewest, then the earliest cuts.

    Costs add up over bins, so the least cost of what is left after a cut does not depend on what came before it: those are
    found from the end backwards, and the bins are then read off from the front, the nearest end first where several do alike.
    """
    edges = [0, *accumulate(sizes)]
    rest: dict[int, tuple[tuple[int, int, int], int]] = {len(sizes): ((0, 0, 0), 0)}
    for begin in reversed(range(len(sizes))):
        ends = range(begin + 1, bisect_right(edges, edges[begin] + LIMIT))
        costs = []
        for end in filter(rest.__contains__, ends):
            n, (short, off, bins) = edges[end] - edges[begin], rest[end][0]
            costs.append(((short + (n < MINIMUM), off + abs(n - TARGET), bins + 1), end))
        if costs:
            rest[begin] = min(costs)
    if 0 not in rest:
        raise ValueError(f"a size is above {LIMIT}")
    out, at = [], 0
    while at < len(sizes):
        at = rest[at][1]
        out.append(at)
    return out


def merged(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk, parent, component): components (a packed policy's chunk_table) merged under each parent as best_partition() says.

    Components of one parent that follow each other and share a unit are never merged: they start new segments.
    A segment is a parent section's chunks, a few dozen; segments are rows, of which a call in Python takes a whole batch.
    """
    order = Window.partitionBy("doc_id", "parent").orderBy("chunk")
    breaks = (F.lag("last_ordinal").over(order) == F.col("first_ordinal")) | (F.row_number().over(order) == 1)
    segmented = chunks.withColumn("segment", F.sum(breaks.cast("int")).over(order))

    @F.pandas_udf("array<int>")
    def cut(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for segments in blocks:
            yield pd.Series([[n for n, (start, end) in enumerate(pairwise([0, *best_partition(list(map(int, sizes)))])) for _ in range(start, end)] for sizes in segments], dtype=object)

    held = segmented.groupBy("doc_id", "parent", "segment").agg(F.array_sort(F.collect_list(F.struct("chunk", F.col("n_tokens").cast("int").alias("n_tokens")))).alias("c"))
    bins = held.withColumn("bins", cut("c.n_tokens")).select("doc_id", "parent", "segment", F.explode(F.arrays_zip(F.col("c.chunk").alias("component"), F.col("c.n_tokens").alias("n_tokens"), F.col("bins").alias("bin"))).alias("e")).select("doc_id", "parent", "segment", "e.component", "e.bin", "e.n_tokens")
    chunk = (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("parent", "segment", "bin")) - 1).cast("int")
    return bins.withColumn("chunk", chunk).select("doc_id", "chunk", "parent", "component", "n_tokens")


def piece(start: Column, stop: Column, tokens: Column) -> Column:
    """Tokens start to stop of a unit, as text."""
    return F.array_join(F.slice(tokens, start + 1, stop - start), " ")


def _in_order(order: list[str], text: str, sep: str) -> Column:
    """Texts of a group joined in order, an empty or null one leaving no separator."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.filter(F.transform(rows, lambda r: r[text]), lambda t: t.isNotNull() & (t != "")), sep)


def chunk_records(fragments: DataFrame, units: DataFrame, policy: str) -> DataFrame:
    """(doc_id, chunk, id, title, text, text_sha256, lexical, body, n_tokens) of a policy's fragments.

    units: (doc_id, ordinal, text, n_tokens, heading, is_heading), heading being the unit's heading path or null. text joins the
    fragments; title is the path that all the chunk's units share, or the first one's; lexical starts with the title
    and has a whole unit's heading and text, of a part of a unit its heading and that part alone; body leaves headings out. A fragment
    found twice in a chunk counts once. The id hashes the policy, the document, the text's digest and the fragments.
    """
    parts = fragments.select("doc_id", "chunk", "ordinal", "unit_start", "unit_stop").distinct().join(units, ["doc_id", "ordinal"])
    whole = (F.col("unit_start") == 0) & (F.col("unit_stop") == F.col("n_tokens"))
    cut = F.when(whole, F.col("text")).otherwise(piece(F.col("unit_start"), F.col("unit_stop"), T.analyze("text", [])))
    rows = parts.withColumn("part", cut).withColumn("lexical", T.collapse(F.concat_ws(" ", "heading", "part"))).withColumn("body", F.when(~F.col("is_heading"), F.col("part")))
    place = ["ordinal", "unit_start"]
    trail = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "unit_start", "unit_stop"))), lambda f: F.concat_ws(":", f["ordinal"].cast("string"), f["unit_start"].cast("string"), f["unit_stop"].cast("string"))))
    paths = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.split(F.coalesce("heading", F.lit("")), " > ").alias("path")))), lambda p: p["path"])
    made = rows.groupBy("doc_id", "chunk").agg(_in_order(place, "part", "\n").alias("text"), _in_order(place, "lexical", "\n").alias("inner"), _in_order(place, "body", "\n").alias("body"), F.sum(F.col("unit_stop") - F.col("unit_start")).cast("int").alias("n_tokens"), trail.alias("trail"), F.array_join(common_prefix(paths), " > ").alias("title"))
    digest = F.sha2("text", 256)
    return made.select("doc_id", "chunk", T.stable_id(F.lit(policy), "doc_id", digest, "trail").alias("id"), "title", "text", digest.alias("text_sha256"), F.concat_ws("\n", F.when(F.col("title") != "", F.col("title")), "inner").alias("lexical"), "body", "n_tokens")


def integrity(fragments: DataFrame, units: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """One row of checks that must all be zero: units without a fragment, fragments of no unit, fragments out of bounds,
    chunks above the limit, repeated fragments, documents without a chunk, tokens of a unit that no fragment of it has,
    chunk numbers that leave a gap in their document, chunks whose fragments leave a gap or overlap in the chunk."""
    known = units.where("n_tokens > 0")
    ids = ["doc_id", "ordinal"]
    one = lambda df, name: df.agg(F.count("*").alias(name))
    size = F.col("unit_stop") - F.col("unit_start")
    merged = fragments.groupBy(*ids).agg(intervals_length(F.collect_list(F.struct(F.col("unit_start").alias("start"), F.col("unit_stop").alias("stop")))).alias("held"))
    numbers = fragments.groupBy("doc_id").agg(F.max("chunk").alias("last"), F.countDistinct("chunk").alias("n"))
    chunks = fragments.groupBy("doc_id", "chunk").agg(F.max(F.col("chunk_start") + size).alias("end"), F.sum(size).alias("sum"), F.min("chunk_start").alias("begin"))
    checks = [
        one(known.join(fragments, ids, "left_anti"), "uncovered_units"),
        one(fragments.join(units, ids, "left_anti"), "unknown_units"),
        one(fragments.join(units.select(*ids, "n_tokens"), ids).where("unit_start < 0 or unit_stop > n_tokens or unit_start >= unit_stop and n_tokens > 0"), "out_of_bounds"),
        one(chunk_table(fragments).where(F.col("n_tokens") > (1 << 30 if limit is None else limit)), "overlong_chunks"),
        one(fragments.groupBy("doc_id", "chunk", "ordinal", "unit_start").count().where("count > 1"), "repeated_fragments"),
        one(known.select("doc_id").distinct().join(fragments.select("doc_id").distinct(), "doc_id", "left_anti"), "uncovered_documents"),
        one(known.join(merged, ids).where("held <> n_tokens"), "uncovered_tokens"),
        one(numbers.where("n <> last + 1"), "chunk_number_gaps"),
        one(chunks.where("begin <> 0 or end <> sum"), "chunk_token_gaps"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.crossJoin(c)  # one row each
    return out


def section_windows_ok(chunks: DataFrame, overlap: int = 64, size: int = 480) -> DataFrame:
    """One row (broken) of a section policy's chunks (n_tokens, windows) whose scoring windows do not cover them, are too long, or overlap otherwise than they should."""
    w, n = F.col("windows"), F.size("windows")
    steps = F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n), lambda a, b: a["stop"] - b["start"] == overlap)
    long = (n > 1) & (F.get(w, F.lit(0))["start"] == 0) & (F.get(w, n - 1)["stop"] == F.col("n_tokens")) & F.forall(w, lambda x: x["stop"] - x["start"] <= size) & F.forall(steps, lambda ok: ok)
    one = (n == 1) & (F.get(w, F.lit(0))["start"] == 0) & (F.get(w, F.lit(0))["stop"] == F.col("n_tokens"))
    return chunks.where("n_tokens > 0").where(~F.coalesce(F.when(F.col("n_tokens") <= LIMIT, one).otherwise(long), F.lit(False))).agg(F.count("*").alias("broken"))


def merged_ok(merged_rows: DataFrame, components: DataFrame) -> DataFrame:
    """One row of checks on merged() of `components` that must be zero: chunks of several parents, components lost or repeated, chunks above LIMIT."""
    per = merged_rows.groupBy("doc_id", "chunk").agg(F.countDistinct("parent").alias("parents"), F.sum("n_tokens").alias("n"))
    ids = components.select("doc_id", F.col("chunk").alias("component"))
    lost = ids.exceptAll(merged_rows.select("doc_id", "component")).agg(F.count("*").alias("lost_components"))
    extra = merged_rows.select("doc_id", "component").exceptAll(ids).agg(F.count("*").alias("extra_components"))
    return per.agg(F.count(F.when(F.col("parents") > 1, 1)).alias("several_parents"), F.count(F.when(F.col("n") > LIMIT, 1)).alias("overlong")).crossJoin(lost).crossJoin(extra)  # one row each


def owned_sections(fragments: DataFrame) -> DataFrame:
    """(doc_id, chunk, section): the sections that a chunk's fragments are in."""
    return fragments.select("doc_id", "chunk", "section").distinct()


def expand(chunks: DataFrame, owned: DataFrame, mode: str = "neighbor", asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk, supplement, distance) of a `mode`: neighbor, the chunks before and after under the same parent; parent, the chunks of the parent
    section itself; parent_neighbor, both; leaf, none.

    chunks: (doc_id, chunk, parent, first_ordinal), parent being the section that a chunk's first section is in, or null; owned: owned_sections().
    With `asked` (doc_id, chunk) only these chunks are expanded. Both modes are joins on (document, section) and on (document, parent,
    place), so a parent may have any number of chunks. Distance counts the document's chunks in source order.
    """
    by_source = ("first_ordinal", "chunk")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*by_source))
    among = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy(*by_source))
    placed = chunks.select("doc_id", "chunk", "parent", place.alias("place"), among.alias("among"))
    leaves = placed.where("parent is not null")
    leaves = leaves if asked is None else leaves.join(asked.select("doc_id", "chunk").distinct(), ["doc_id", "chunk"], "left_semi")
    found = []
    if mode in ("parent", "parent_neighbor"):
        own = owned.select("doc_id", F.col("section").alias("parent"), F.col("chunk").alias("supplement"))
        found.append(leaves.select("doc_id", "chunk", "parent").join(own, ["doc_id", "parent"]).where("chunk <> supplement").select("doc_id", "chunk", "supplement"))
    if mode in ("neighbor", "parent_neighbor"):
        beside = leaves.select("doc_id", "chunk", "parent", F.explode(F.array(F.col("among") - 1, F.col("among") + 1)).alias("among"))
        found.append(beside.join(placed.select("doc_id", "parent", "among", F.col("chunk").alias("supplement")), ["doc_id", "parent", "among"]).select("doc_id", "chunk", "supplement"))
    every = found[0] if found else leaves.select("doc_id", "chunk", F.col("chunk").alias("supplement")).where("false")
    for more in found[1:]:
        every = every.unionByName(more).distinct()
    here, there = placed.select("doc_id", "chunk", "place"), placed.select("doc_id", F.col("chunk").alias("supplement"), F.col("place").alias("there"))
    return every.join(here, ["doc_id", "chunk"]).join(there, ["doc_id", "supplement"]).select("doc_id", "chunk", "supplement", F.abs(F.col("place") - F.col("there")).alias("distance"))


def expanded_fragments(fragments: DataFrame, supplements: DataFrame) -> DataFrame:
    """(doc_id, chunk, place, ordinal, unit_start, unit_stop): a chunk's fragments, then those of its supplements by distance and source order, each fragment once, at its first place."""
    own = fragments.select("doc_id", "chunk", F.lit(0).alias("distance"), F.col("chunk").alias("of"), "ordinal", "unit_start", "unit_stop")
    theirs = supplements.join(fragments.select("doc_id", F.col("chunk").alias("supplement"), "ordinal", "unit_start", "unit_stop"), ["doc_id", "supplement"])
    rows = own.unionByName(theirs.select("doc_id", "chunk", "distance", F.col("supplement").alias("of"), "ordinal", "unit_start", "unit_stop"))
    first = rows.groupBy("doc_id", "chunk", "ordinal", "unit_start", "unit_stop").agg(F.min(F.struct("distance", "of")).alias("f"))
    order = Window.partitionBy("doc_id", "chunk").orderBy("f", "ordinal", "unit_start", "unit_stop")
    return first.select("doc_id", "chunk", (F.row_number().over(order) - 1).alias("place"), "ordinal", "unit_start", "unit_stop")
