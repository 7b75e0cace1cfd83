"""Extraction, text functions and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import numeric as N
from evidentia.functions import text as T
from evidentia.functions.html import BLOCKS
from evidentia.operators import chunking as C
from evidentia.operators import extraction as X
from evidentia.operators import intervals as I
from evidentia.operators import retrieval as R
from evidentia.plans import _data as D


def _units(spark, d):
    return X.units_from_documents(D.table(spark, d, "documents"))


def units_from_documents(spark, d):
    u = _units(spark, d)
    return u.select("doc_id", "ordinal", "section", "parent", "n_tokens", T.stable_id("doc_id", "ordinal", "text").alias("unit_id"), F.sha2("text", 256).alias("text_sha256"))


def units_from_pages(spark, d):
    return X.units_from_pages(D.table(spark, d, "pages")).drop("anchors", "tab", "links")


def cross_references(spark, d):
    return X.cross_references(D.table(spark, d, "pages"))


def family_histogram(spark, d):
    """Pages by the first part of their path and by scheme."""
    p = D.table(spark, d, "pages")
    return p.groupBy(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]+)", 1).alias("family"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme")).agg(F.count("*").alias("pages"))


def context_header(spark, d):
    """A header for each page: its module, path and node types in order of appearance."""
    units = X.units_from_pages(D.table(spark, d, "pages"))
    types = units.groupBy("page_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "node_type"))), lambda x: x["node_type"])).alias("types"))
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), r"\.html$", "")
    pages = D.table(spark, d, "pages").select("page_id", path.alias("page"))
    module = F.concat_ws("/", F.slice(F.split("page", "/"), 1, 2))
    return pages.join(types, "page_id").select("page_id", F.concat(F.lit("corpus | module="), module, F.lit(" | page="), "page", F.lit(" | types="), F.concat_ws(",", "types")).alias("header"))


def analyzer_term_stats(spark, d):
    tokens = D.items(spark, d).select("item_id", F.explode(T.analyze("text")).alias("term"))
    return tokens.groupBy("term", "item_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").cast("long").alias("max_tf"))


def token_set_overlap(spark, d):
    """For each query's best document, share of the query's word tokens that it has, and their Jaccard similarity."""
    best = D.bm25(spark, d, 1).select("query_id", "item_id")
    rows = best.join(R.near(D.queries(spark, d).select("query_id", T.token_set("text").alias("q"))), "query_id").join(D.items(spark, d), "item_id")
    found = rows.select("query_id", "item_id", "q", T.token_set("text").alias("found"))
    ratio = T.overlap_ratio("q", "found")
    return found.select("query_id", "item_id", N.rounded(ratio).alias("ratio"), N.rounded(T.jaccard("q", "found")).alias("jaccard"), (ratio >= 0.8).alias("passes"))


def normalized_text(spark, d):
    rows = D.table(spark, d, "documents").select("doc_id", F.concat(F.lit("\r\n"), F.replace("text", F.lit("\n"), F.lit("  \r\n\r\n\r\n"))).alias("text"))
    n = T.normalize_rendered("text")
    return rows.select("doc_id", F.sha2(n, 256).alias("normalized_sha256"), F.length(T.collapse("text")).cast("long").alias("collapsed_chars"), T.stable_id("doc_id", n, length=16).alias("id"))


def windows_c0(spark, d):
    return C.fixed(_units(spark, d))


def sections_c1(spark, d):
    return C.sections(_units(spark, d)).drop("windows")


def c1_scoring_windows(spark, d):
    w = C.sections(_units(spark, d)).select("doc_id", "chunk", F.posexplode("windows").alias("window", "w"))
    return w.select("doc_id", "chunk", "window", "w.start", "w.stop")


def packed_c2(spark, d):
    return C.packed(_units(spark, d))


def merged_c3(spark, d):
    return C.merged(C.chunk_table(C.packed(_units(spark, d))))


def chunk_token_stats(spark, d):
    c = C.chunk_table(C.fixed(_units(spark, d)))
    return c.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.min("n_tokens").alias("least"), N.rounded(F.avg("n_tokens")).alias("mean"), *[F.expr(f"percentile_disc({p}) within group (order by n_tokens)").cast("int").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))], F.max("n_tokens").alias("most"))


def chunk_integrity(spark, d):
    u = _units(spark, d)
    return C.integrity(C.fixed(u), u).unionByName(C.integrity(C.packed(u), u))


def unit_token_counts(spark, d):
    """A unit's tokens as the largest end of its fragments over all windows."""
    return C.fixed(_units(spark, d)).groupBy("doc_id", "ordinal").agg(F.max("unit_stop").alias("n_tokens"))


def interval_overlap(spark, d):
    """Tokens that neighbouring fixed windows share in each unit, and all windows' tokens of a document merged and not."""
    f = C.fixed(_units(spark, d))
    a, b = f.alias("a"), f.alias("b")
    shared = F.greatest(F.lit(0), F.least("a.unit_stop", "b.unit_stop") - F.greatest("a.unit_start", "b.unit_start"))
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.ordinal") == F.col("b.ordinal")) & (F.col("b.chunk") == F.col("a.chunk") + 1))
    overlap = pairs.groupBy(F.col("a.doc_id").alias("doc_id")).agg(F.sum(shared).alias("shared"))
    spans = f.groupBy("doc_id", "ordinal").agg(N.intervals_length(F.collect_list(F.struct(F.col("unit_start").alias("start"), F.col("unit_stop").alias("stop")))).alias("merged"), F.sum(F.col("unit_stop") - F.col("unit_start")).alias("plain"))
    total = spans.groupBy("doc_id").agg(F.sum("merged").alias("merged"), F.sum("plain").alias("plain"))
    return total.join(overlap, "doc_id", "left").select("doc_id", "merged", "plain", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


def _expansion(spark, d, mode):
    fragments = C.packed(_units(spark, d))
    chunks = C.chunk_table(fragments).withColumn("parent", X.parent_section("parent"))
    return C.expand(chunks, C.owned_sections(fragments), mode)


def neighbor_expansion(spark, d):
    return _expansion(spark, d, "neighbor")


def parent_expansion(spark, d):
    """For each chunk the chunks of its parent's own section, however many."""
    return _expansion(spark, d, "parent")


def parent_neighbor_expansion(spark, d):
    return _expansion(spark, d, "parent_neighbor")


def marked_texts(spark, d):
    """Documents with a coloured word and two names between bars, one of them with a blank: colours stripped, names listed, and the lexical text under two headings."""
    k = F.col("doc_id").cast("string")
    docs = D.table(spark, d, "documents").select("doc_id", F.concat(F.lit("\x1b[1;31mred\x1b[0m |name "), k, F.lit("| | "), k, F.lit("|\n"), "text").alias("text"), F.array("source", "lang").alias("path"))
    names = F.array_join(F.slice(T.substitutions("text"), 1, 2), ";")
    return docs.select("doc_id", F.sha2(T.strip_ansi("text"), 256).alias("plain_sha256"), names.alias("names"), F.sha2(T.lexical("path", T.strip_ansi("text")), 256).alias("lexical_sha256"))


def policy_overlap(spark, d):
    """Tokens that each window of the fixed policy shares with each packed chunk, as ranges of the document's tokens."""
    units = _units(spark, d)
    placed = C._placed(units).select("doc_id", "ordinal", "first")
    ranges = [policy(units).join(placed, ["doc_id", "ordinal"]).groupBy("doc_id", "chunk").agg(F.min(F.col("first") + F.col("unit_start")).alias("start"), F.max(F.col("first") + F.col("unit_stop")).alias("stop")) for policy in (C.fixed, C.packed)]
    pairs = I.overlap_join(ranges[0], ranges[1], ["doc_id"])
    shared = F.least("left.stop", "right.stop") - F.greatest("left.start", "right.start")
    return pairs.select("doc_id", F.col("left.chunk").alias("window"), F.col("right.chunk").alias("chunk"), shared.alias("shared"))


def sibling_headings(spark, d):
    """Each page's units with those before and after them in their section."""
    u = X.units_from_pages(D.table(spark, d, "pages"))
    return X.sibling_headings(u.select(F.col("page_id").alias("doc_id"), F.col("section_id").alias("parent"), "ordinal", F.col("unit_id").alias("heading_id"))).select("doc_id", "ordinal", "before", "after")


QUERIES = {f.__name__: f for f in [units_from_documents, units_from_pages, cross_references, family_histogram, context_header, analyzer_term_stats, token_set_overlap, normalized_text, windows_c0, sections_c1, c1_scoring_windows, packed_c2, merged_c3, chunk_token_stats, chunk_integrity, unit_token_counts, interval_overlap, marked_texts, policy_overlap, neighbor_expansion, parent_expansion, parent_neighbor_expansion, sibling_headings]}

_ID = "substr(sha256({}), 1, {})"
#: Block tags and entities of the tables' pages, for their SQL.
_BLOCKS = ", ".join(f"'{b}'" for b in sorted(BLOCKS))
_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0", "middot": "\u00b7", "copy": "\u00a9", "amp": "&"}


def _decoded(text: str) -> str:
    for name, char in _ENTITIES.items():
        text = f"replace({text}, '&{name};', chr({ord(char)}))"
    return text


D.CTES |= {
    # a page as its text between tags: pieces begin with a tag's name; a block tag opens a segment, tags inside add their text to it
    "pc": (
        "",
        f"""select page_id, i, case when tag then lower(regexp_extract(p, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) end as name, tag and not starts_with(p, '/') as opens, lower(regexp_extract(p, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) in ({_BLOCKS}) and tag as block,
          case when i = 0 then p when not tag then '<' || p when regexp_matches(p, '^[bB][rR][^A-Za-z0-9]') then ' ' || substr(p, instr(p, '>') + 1) else substr(p, instr(p, '>') + 1) end as after
        from (select page_id, i, p, i > 0 and regexp_matches(p, '^[A-Za-z/!?]') as tag from (select page_id, unnest(ps) as p, unnest(range(len(ps))) as i
          from (select page_id, string_split(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis'), '<!--.*?-->', '', 'gs'), '<') as ps from pages)))""",
    ),
    "nd": (
        "pc",
        f"""select page_id, seg, case when opens then tag else '' end as tag, {_decoded("raw")} as raw
        from (select page_id, seg, arg_min(name, i) as tag, arg_min(opens, i) as opens, string_agg(after, '' order by i) as raw from (select *, sum(block::int) over (partition by page_id order by i) as seg from pc) group by page_id, seg)
        where seg > 0""",
    ),
    "nt": ("nd", f"""select page_id, (row_number() over (partition by page_id order by seg) - 1)::int as ordinal, case when regexp_matches(tag, '^h[1-6]$') then 'heading' when tag = 'li' then 'list_item' when tag = 'title' then 'title' else 'paragraph' end as node_type,
        case when regexp_matches(tag, '^h[1-6]$') then tag[2]::int end as level, text from (select page_id, seg, tag, {D.collapsed("raw")} as text from nd) where text <> ''"""),
    # a heading is open at a unit unless one of its level or above has come since
    "pu": (
        "nt",
        f"""select u.page_id, u.ordinal, u.node_type, u.text, last_value(case when node_type = 'heading' then text end ignore nulls) over (partition by u.page_id order by u.ordinal) as heading, o.heading_path,
          {_ID.format("u.page_id || chr(0) || coalesce(o.at, -1)", 32)} as section_id, {_ID.format("u.page_id || chr(0) || coalesce(o.above, -1)", 32)} as parent_id, {_ID.format("u.page_id || chr(0) || u.ordinal || chr(0) || u.text", 32)} as unit_id
        from nt u left join (select u.page_id, u.ordinal, string_agg(h.text, ' > ' order by h.ordinal) as heading_path, max(h.ordinal) as at, max(h.ordinal, 2)[2] as above from nt u join nt h on h.page_id = u.page_id and h.level is not null and h.ordinal <= u.ordinal
          where not exists (from nt g where g.page_id = u.page_id and g.level <= h.level and g.ordinal > h.ordinal and g.ordinal <= u.ordinal) group by u.page_id, u.ordinal) o on o.page_id = u.page_id and o.ordinal = u.ordinal""",
    ),
    "isl": ("units", "select *, (sum((case when prev is distinct from section or pos = 1 then 1 else 0 end)) over (partition by doc_id order by ordinal) - 1)::int as run from (select *, lag(section) over (partition by doc_id order by ordinal) as prev, row_number() over (partition by doc_id order by ordinal) as pos from units)"),
    "ord": ("isl", "select *, row_number() over (partition by doc_id, run order by ordinal) as k from isl"),
    "pk": (
        "ord",
        """select doc_id, run, k, ordinal, section, parent, n_tokens as n, 0 as bin, (0 + case when n_tokens > 512 then 1 + ceil((n_tokens - 512) / 448.0)::int else 0 end) as nxt, case when n_tokens > 512 then 0 else n_tokens end as pending, case when n_tokens > 512 then 0 else 1 end as held from ord where k = 1
        union all
        select doc_id, run, k, ordinal, section, parent, n, was + c, was + c + case when n > 512 then 1 + ceil((n - 512) / 448.0)::int else 0 end,
          case when n > 512 then 0 when c = 1 then n else pending + n end, case when n > 512 then 0 when c = 1 then 1 else held + 1 end
        from (select o.doc_id, o.run, o.k, o.ordinal, o.section, o.parent, o.n_tokens as n, p.nxt as was, p.pending, p.held, case when p.held > 0 and (p.pending >= 384 or p.pending + o.n_tokens > 512 or o.n_tokens > 512) then 1 else 0 end as c
          from pk p join ord o on o.doc_id = p.doc_id and o.run = p.run and o.k = p.k + 1)""",
    ),
    "c2": (
        "pk",
        """select doc_id, (dense_rank() over (partition by doc_id order by run, bin) - 1)::int as chunk, ordinal, section, parent, unit_start, unit_stop, (coalesce(sum(unit_stop - unit_start) over (partition by doc_id, run, bin order by ordinal rows between unbounded preceding and 1 preceding), 0))::int as chunk_start
        from (select doc_id, run, bin + w as bin, ordinal, section, parent, (w * 448)::int as unit_start, (case when n > 512 then least(w * 448 + 512, n) else n end)::int as unit_stop
          from (select *, unnest(range(0, case when n > 512 then 1 + ceil((n - 512) / 448.0)::int else 1 end)) as w from pk))""",
    ),
    "ct0": ("c0", "select doc_id, chunk, sum(unit_stop - unit_start)::int as n_tokens from c0 group by all"),
    "ct2": ("c2", "select doc_id, chunk, arg_min(parent, ordinal) as parent, min(ordinal) as first_ordinal, max(ordinal) as last_ordinal, sum(unit_stop - unit_start)::int as n_tokens from c2 group by doc_id, chunk"),
    "pl2": ("ct2", "select *, row_number() over (partition by doc_id order by first_ordinal, chunk) as place from ct2"),
    # a parent of 32 lines is the section of its first 8
    "px": ("pl2 c2", "select distinct a.doc_id, a.chunk, o.chunk as supplement from pl2 a join c2 o on o.doc_id = a.doc_id and o.section = a.parent * 4 and o.chunk <> a.chunk"),
    "nx": ("pl2", "select a.doc_id, a.chunk, b.chunk as supplement from (select *, row_number() over (partition by doc_id, parent order by first_ordinal, chunk) as k from pl2) a join (select *, row_number() over (partition by doc_id, parent order by first_ordinal, chunk) as k from pl2) b on a.doc_id = b.doc_id and a.parent = b.parent and abs(a.k - b.k) = 1"),
    "wr0": ("c0 placed", "select c.doc_id, c.chunk, min(first + unit_start) as start, max(first + unit_stop) as stop from c0 c join placed p using (doc_id, ordinal) group by all"),
    "wr2": ("c2 placed", "select c.doc_id, c.chunk, min(first + unit_start) as start, max(first + unit_stop) as stop from c2 c join placed p using (doc_id, ordinal) group by all"),
}

_AWAY = "abs((select place from pl2 p where p.doc_id = e.doc_id and p.chunk = e.chunk) - (select place from pl2 p where p.doc_id = e.doc_id and p.chunk = e.supplement))::int"
_ISL_AGG = "select doc_id, run as chunk, section, min(ordinal) as first_ordinal, count(*) as n_units, sum(n_tokens)::int as n_tokens from isl group by doc_id, run, section"
_ZERO = "select 0::bigint as uncovered_units, 0::bigint as unknown_units, 0::bigint as out_of_bounds, {}::bigint as overlong_chunks, 0::bigint as repeated_fragments, 0::bigint as uncovered_documents, 0::bigint as uncovered_tokens, 0::bigint as chunk_number_gaps, 0::bigint as chunk_token_gaps"
_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
ORACLE = {
    "units_from_documents": D.sql(f"select doc_id, ordinal, section, parent, n_tokens, {_ID.format('doc_id || chr(0) || ordinal || chr(0) || text', 32)} as unit_id, sha256(text) as text_sha256 from units", "units"),
    "units_from_pages": D.sql("select * from pu", "pu"),
    "cross_references": f"""select page_id, position::int as position, {D.collapsed(_decoded("text"))} as text, {_decoded("target")} as target from (select page_id, unnest(range(len(ts))) as position, unnest(ts) as text, unnest(gs) as target
      from (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as ts, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as gs from pages))""",
    "family_histogram": "select regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) as family, regexp_extract(url, '^([a-z]+)://', 1) as scheme, count(*) as pages from pages group by all",
    "context_header": D.sql(
        r"""select page_id, 'corpus | module=' || array_to_string(string_split(page, '/')[1:2], '/') || ' | page=' || page || ' | types=' || types as header from (select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '\.html$', '') as page from pages)
        join (select page_id, string_agg(node_type, ',' order by o) as types from (select page_id, node_type, min(ordinal) as o from pu group by all) group by page_id) using (page_id)""",
        "pu",
    ),
    "analyzer_term_stats": f"select term, count(*) as df, sum(tf)::bigint as cf, max(tf)::bigint as max_tf from (select term, item_id, count(*) as tf from (select doc_id as item_id, unnest({D.analyzed('text')}) as term from documents) group by all) group by term",
    "token_set_overlap": D.sql(
        f"select query_id, item_id, {D.r('common / greatest(1, len(q))::double')} as ratio, {D.r('common / (len(q) + len(f) - common)::double')} as jaccard, common / greatest(1, len(q))::double >= 0.8 as passes from (select *, len(list_intersect(q, f)) as common from (select query_id, item_id, {_WORDS.format('qs.text')} as q, {_WORDS.format('items.text')} as f from bm100 join qs using (query_id) join items using (item_id) where rank = 1))",
        "bm100",
    ),
    "normalized_text": r"""with t as (select doc_id, chr(13) || chr(10) || replace(text, chr(10), '  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10)) as text from documents),
      l as (select doc_id, text, list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: rtrim(x)) as ls from t),
      n as (select doc_id, text, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '^\n+|\n+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as n from l)
      select doc_id, sha256(n) as normalized_sha256, length(COLLAPSED) as collapsed_chars, substr(sha256(doc_id || chr(0) || n), 1, 16) as id from n""".replace("COLLAPSED", D.collapsed("text")),
    "windows_c0": D.sql("select * from c0", "c0"),
    "sections_c1": D.sql(_ISL_AGG, "isl"),
    "c1_scoring_windows": D.sql(
        f"select doc_id, chunk, w::int as window, (w * step)::int as start, least(w * step + size, n_tokens)::int as stop from (select doc_id, chunk, n_tokens, case when n_tokens <= 512 then 512 else 480 end as size, case when n_tokens <= 512 then 512 else 416 end as step, unnest(range(0, case when n_tokens <= 0 then 0 when n_tokens <= 512 then 1 else 1 + ceil((n_tokens - 480) / 416.0)::int end)) as w from ({_ISL_AGG}))",
        "isl",
    ),
    "packed_c2": D.sql("select * from c2", "c2"),
    "chunk_token_stats": D.sql(f"select count(*) as chunks, count(distinct doc_id) as documents, min(n_tokens) as least, {D.r('avg(n_tokens)')} as mean, percentile_disc(0.5) within group (order by n_tokens) as p50, percentile_disc(0.95) within group (order by n_tokens) as p95, max(n_tokens) as most from ct0", "ct0"),
    "chunk_integrity": _ZERO.format(0) + " union all " + _ZERO.format(0),
    "unit_token_counts": D.sql("select doc_id, ordinal, n_tokens from units where n_tokens > 0", "units"),
    "interval_overlap": D.sql(
        "select doc_id, merged, plain, coalesce(shared, 0)::bigint as shared from (select doc_id, sum(n_tokens)::bigint as merged from units where n_tokens > 0 group by doc_id) join (select doc_id, sum(n_tokens)::bigint as plain from ct0 group by doc_id) using (doc_id) left join (select a.doc_id, sum(greatest(0, least(a.unit_stop, b.unit_stop) - greatest(a.unit_start, b.unit_start))) as shared from c0 a join c0 b on a.doc_id = b.doc_id and a.ordinal = b.ordinal and b.chunk = a.chunk + 1 group by a.doc_id) using (doc_id)",
        "units ct0 c0",
    ),
    "marked_texts": f"""select doc_id, sha256(t) as plain_sha256, 'name ' || doc_id || '; ' || doc_id as names, sha256({D.collapsed("source || ' > ' || lang || ' ' || t")}) as lexical_sha256
      from (select doc_id, source, lang, 'red |name ' || doc_id || '| | ' || doc_id || '|' || chr(10) || text as t from documents)""",
    "policy_overlap": D.sql(
        "select a.doc_id, a.chunk as window, b.chunk, least(a.stop, b.stop) - greatest(a.start, b.start) as shared from wr0 a join wr2 b on a.doc_id = b.doc_id and a.start < b.stop and b.start < a.stop", "wr0 wr2"
    ),
    "neighbor_expansion": D.sql(f"select doc_id, chunk, supplement, {_AWAY} as distance from nx e", "nx pl2"),
    "parent_expansion": D.sql(f"select doc_id, chunk, supplement, {_AWAY} as distance from px e", "px pl2"),
    "parent_neighbor_expansion": D.sql(f"select doc_id, chunk, supplement, {_AWAY} as distance from (select * from px union select * from nx) e", "px nx pl2"),
    "sibling_headings": D.sql("select page_id as doc_id, ordinal, lag(unit_id) over w as before, lead(unit_id) over w as after from pu window w as (partition by page_id, section_id order by ordinal)", "pu"),
}
