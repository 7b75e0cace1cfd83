"""Validation, include-site, location and pool-stability queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.numeric import rounded
from evidentia.operators import chunking as C
from evidentia.operators import extraction as X
from evidentia.operators import metrics as M
from evidentia.operators import pooling as P
from evidentia.operators import schema as S
from evidentia.operators import validation as V
from evidentia.plans import _data as D
from evidentia.plans.evaluation import metrics_sql
from evidentia.plans.judging import _runs
from evidentia.sources.tables import materialize


def table_digest(spark, d):
    return V.digest(D.table(spark, d, "labels"))


def ranking_violations(spark, d):
    return V.violations(D.bm25(spark, d, 10), "ranking")


def _records(spark, d):
    """Chunks of all documents as records, with faults planted by document number: a digest in capitals, no fragments, a fragment before its unit, too many tokens, no text."""
    units = X.units_from_documents(D.table(spark, d, "documents"))
    fragments = C.packed(units)
    k = lambda n, wrong, right: F.when(F.col("doc_id") % n == 0, wrong).otherwise(right)
    held = fragments.join(units.select("doc_id", "ordinal", "text"), ["doc_id", "ordinal"]).groupBy("doc_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "unit_start", "unit_stop", "chunk_start", "text"))).alias("f"), F.sum(F.col("unit_stop") - F.col("unit_start")).alias("n")
    )
    text = F.array_join(F.transform("f", lambda f: f["text"]), "\n")
    parts = F.transform("f", lambda f: F.struct(F.concat_ws(":", F.col("doc_id").cast("string"), f["ordinal"].cast("string")).alias("evidence_unit_id"), k(13, f["unit_start"] - 1, f["unit_start"]).alias("unit_token_start"), f["unit_stop"].alias("unit_token_end"), f["chunk_start"].alias("chunk_token_start")))
    return held.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("id"),
        F.col("doc_id").cast("string").alias("source_document_id"),
        k(19, F.lit(None), text).alias("text"),
        k(7, F.upper(F.sha2(text, 256)), F.sha2(text, 256)).alias("text_sha256"),
        k(17, F.col("n") + 512, F.col("n")).alias("token_count"),
        k(11, F.slice(parts, 1, 0), parts).alias("span_fragments"),
    )


def record_schema(spark, d):
    """How many chunk records break each rule of their schema, nested fragments included."""
    return S.broken(_records(spark, d), S.KINDS["chunk"], S.KINDS)


def include_sites(spark, d):
    """Include directives of all documents; every fifth document is given one more, every other one of these with a blank and quotes."""
    number = F.col("doc_id").cast("string")
    planted = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\n.. include:: part/"), number, F.lit(".rst"))).otherwise(F.concat("text", F.lit("\n  .. literalinclude:: \"my part/"), number, F.lit(".rst\" ")))
    docs = D.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, planted).otherwise(F.col("text")).alias("text"))
    return X.include_sites(docs)


def _quotes(spark, d):
    """Whole lines of every document with their own numbers: the first, the middle and the last that aren't blank."""
    lines = X.source_lines("text")
    rows = D.table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("ordinal", "quote")).where("trim(quote) <> ''")
    order = D.Window.partitionBy("doc_id").orderBy("ordinal")
    k, n = F.row_number().over(order), F.count("*").over(D.Window.partitionBy("doc_id"))
    chosen = rows.withColumn("k", k).withColumn("n", n).where((F.col("k") == 1) | (F.col("k") == F.col("n")) | (F.col("k") == F.floor((F.col("n") + 1) / 2)))
    return chosen.select("doc_id", "quote", (F.col("ordinal") + 1).alias("hint"))


def quote_lines(spark, d):
    """Where the quotes of every document are found, nearest to the line they were taken from; each once more with other white space around it, which is found loosely."""
    quotes = _quotes(spark, d)
    loose = quotes.withColumn("quote", F.concat(F.lit("\t "), "quote", F.lit("  ")))
    return X.locate_lines(D.table(spark, d, "documents"), quotes.unionByName(loose))


def source_refs(spark, d):
    """References to each document's quotes with the line after them, neighbouring ranges merged."""
    ranges = quote_lines(spark, d).select("doc_id", F.col("line").alias("start_line"), (F.col("line") + 1).alias("end_line"), F.lit("direct").alias("origin"))
    return X.source_refs(D.table(spark, d, "documents"), X.merge_line_ranges(ranges))


def pool_stability(spark, d):
    """For each held-out run Kendall's tau of the systems' order without the judgments that it alone found, against the order with all."""
    m = D.matched(spark, d)
    runs, qrels, depth = {s: materialize(r) for s, r in _runs(spark, d, m=m).items()}, materialize(D.qrels(spark, d, m)), 20
    alone = P.exclusive(runs, depth)
    names = sorted(runs)
    key = lambda held, s: F.concat_ws("|", F.lit(held), F.lit(s), F.col("query_id").cast("string")).alias("query_id")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    judged = {h: qrels if h == "none" else qrels.join(alone.where(F.col("system") == h), ["query_id", "item_id"], "left_anti") for h in ["none", *names]}
    run = union([r.select(key(h, s), "item_id", "rank") for h in judged for s, r in runs.items()])
    rels = union([q.select(key(h, s), "item_id", "grade") for h, q in judged.items() for s in names])
    parts = F.split("query_id", r"\|")
    scores = M.ranking_metrics(run, materialize(rels)).groupBy(parts[0].alias("held"), parts[1].alias("name")).agg(rounded(F.avg("ndcg_10")).alias("score"))
    place = F.row_number().over(D.Window.partitionBy("held").orderBy(F.col("score").desc(), "name"))
    placed = materialize(scores.withColumn("place", place))
    x, y = (placed.where("held <> 'none'").join(placed.where("held = 'none'").select("name", F.col("place").alias("full")), "name").alias(a) for a in "xy")
    pairs = x.join(y, (F.col("x.held") == F.col("y.held")) & (F.col("x.name") < F.col("y.name")))  # a few systems
    sign = F.signum(F.col("x.place") - F.col("y.place")) * F.signum(F.col("x.full") - F.col("y.full"))
    return pairs.groupBy(F.col("x.held").alias("held_out")).agg(rounded(F.avg(sign)).alias("tau"))


QUERIES = {f.__name__: f for f in [table_digest, ranking_violations, include_sites, quote_lines, source_refs, pool_stability, record_schema]}


def _stability() -> str:
    """SQL for pool_stability(), and its relations."""
    held = ["none", "bm25", "dense", "hybrid"]
    systems = {"bm25": "bm100", "dense": "ov100", "hybrid": "rf100"}
    run = " union all ".join(f"select '{h}|{s}|' || query_id as query_id, item_id, rank from {t} where rank <= 50" for h in held for s, t in systems.items())
    rel = " union all ".join(f"select '{h}|{s}|' || query_id as query_id, item_id, grade from qr where not exists (from xj where xj.system = '{h}' and xj.query_id = qr.query_id and xj.item_id = qr.item_id)" for h in held for s in systems)
    D.CTES["xj"] = ("rn", "select min(system) as system, query_id, item_id from rn where rank <= 20 group by query_id, item_id having count(*) = 1")
    D.CTES["prun"], D.CTES["prel"] = ("bm100 ov100 rf100", run), ("qr xj", rel)
    D.CTES["pm"] = ("prun prel", metrics_sql("prun", "prel"))
    D.CTES["pp"] = ("pm", f"select *, row_number() over (partition by held order by score desc, name) as place from (select split_part(query_id, '|', 1) as held, split_part(query_id, '|', 2) as name, {D.r('avg(ndcg_10)')} as score from pm group by all)")
    return D.sql(
        f"select x.held as held_out, {D.r('avg(sign(x.place - y.place) * sign(fx.place - fy.place))')} as tau from pp x join pp y on x.held = y.held and x.name < y.name join pp fx on fx.held = 'none' and fx.name = x.name join pp fy on fy.held = 'none' and fy.name = y.name where x.held <> 'none' group by x.held",
        "pp",
    )


_FOUND = """with l as (select doc_id, unnest(ls) as x, unnest(range(1, len(ls) + 1)) as n from (select doc_id, string_split(text, chr(10)) as ls from documents)),
      k as (select *, row_number() over (partition by doc_id order by n) as k, count(*) over (partition by doc_id) as c from l where trim(x) <> ''),
      q as (select distinct doc_id, x as quote, n as hint from k where k = 1 or k = c or k = (c + 1) // 2),
      found as (select q.doc_id, quote, hint::int as hint, arg_min(l.n, abs(l.n - hint) * 1000000000 + l.n)::int as line from q join l on l.doc_id = q.doc_id and contains(l.x, q.quote) group by all)
      """
ORACLE = {
    "table_digest": "select count(*) as n, coalesce(sum(('0x' || substr(md5(doc_id || chr(31) || quality || chr(31) || toxic), 1, 12))::hugeint) % 2305843009213693951, 0)::bigint as digest from labels",
    "ranking_violations": "select unnest(['rank', 'item', 'score']) as rule, 0::bigint as broken",
    "include_sites": r"""select doc_id, line::int as line, regexp_replace(target, '^["'']+|["'']+$', '', 'g') as target
      from (select doc_id, line, regexp_extract(x, '^[ \t]*\.\.[ \t]+(literal)?include::[ \t]*([^ \t].*?)[ \t]*$', 2) as target from (select doc_id, unnest(ls) as x, unnest(range(1, len(ls) + 1)) as line
        from (select doc_id, string_split(text || case when doc_id % 10 = 0 then chr(10) || '.. include:: part/' || doc_id || '.rst' when doc_id % 5 = 0 then chr(10) || '  .. literalinclude:: "my part/' || doc_id || '.rst" ' else '' end, chr(10)) as ls from documents))) where target <> ''""",
    "record_schema": D.sql(
        """select unnest(['id.required', 'id.minLength', 'source_document_id.required', 'source_document_id.minLength', 'text.required', 'text_sha256.required', 'text_sha256.pattern', 'token_count.required', 'token_count.minimum', 'token_count.maximum', 'span_fragments.required', 'span_fragments.minItems',
          'span_fragments[].required', 'span_fragments[].evidence_unit_id.required', 'span_fragments[].evidence_unit_id.minLength', 'span_fragments[].unit_token_start.required', 'span_fragments[].unit_token_start.minimum', 'span_fragments[].unit_token_end.required', 'span_fragments[].unit_token_end.minimum', 'span_fragments[].chunk_token_start.required', 'span_fragments[].chunk_token_start.minimum']) as rule,
          unnest([0, 0, 0, 0, count(*) filter (doc_id % 19 = 0), 0, count(*) filter (doc_id % 7 = 0), 0, 0, count(*) filter (n + case when doc_id % 17 = 0 then 512 else 0 end > 512), 0, count(*) filter (doc_id % 11 = 0),
          0, 0, 0, 0, count(*) filter (doc_id % 11 <> 0 and doc_id % 13 = 0 and low = 0), 0, count(*) filter (doc_id % 11 <> 0 and stop < 1), 0, count(*) filter (doc_id % 11 <> 0 and start < 0)]) as broken
        from (select doc_id, chunk, sum(unit_stop - unit_start) as n, min(unit_start) as low, min(unit_stop) as stop, min(chunk_start) as start from c2 group by all)""",
        "c2",
    ),
    # a whole line is found at each line that contains it
    "quote_lines": (
        _FOUND
        + """select doc_id, quote, hint, line from found union all
      select q.doc_id, chr(9) || ' ' || quote || '  ' as quote, hint::int as hint, arg_min(l.n, abs(l.n - hint) * 1000000000 + l.n)::int as line
      from q join (select doc_id, n, regexp_replace(x, '^SPACE+|SPACE+$', '', 'g') as y from l) l on l.doc_id = q.doc_id and l.y = regexp_replace(q.quote, '^SPACE+|SPACE+$', '', 'g') group by all""".replace("SPACE", T.SPACE)
    ),
    "source_refs": _FOUND + """, r as (select distinct doc_id, line as a, line + 1 as b from found),
      o as (select *, coalesce(a > max(b) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding) + 1, true) as new from r),
      m as (select doc_id, min(a) as a, max(b) as b from (select *, sum(new::int) over (partition by doc_id order by a) as run from o) group by doc_id, run),
      t as (select m.doc_id, a, least(b, len(ls))::int as b, ls from m join (select doc_id, string_split(text, chr(10)) as ls from documents) using (doc_id))
      select doc_id, a::int as start_line, b as end_line, (length(ls[a]) - length(regexp_replace(ls[a], '^SPACE+', '')) + 1)::int as start_column, (length(ls[b]) + 1)::int as end_column, sha256(array_to_string(ls[a:b], chr(10))) as quote_sha256, 'direct' as origin from t""".replace("SPACE", T.SPACE),
    "pool_stability": _stability(),
}
