"""Index, chunk text, hybrid ranking, evaluation and comparison queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.numeric import rounded
from evidentia.operators import chunking as C
from evidentia.operators import extraction as X
from evidentia.operators import index as I
from evidentia.operators import metrics as M
from evidentia.operators import retrieval as R
from evidentia.operators import statistics as S
from evidentia.operators import validation as V
from evidentia.plans import _data as D
from evidentia.plans import units as _units  # noqa: F401 -- its SQL relations
from evidentia.plans.evaluation import _hash, metrics_sql
from evidentia.plans.judging import _runs
from evidentia.sources import files, trec
from evidentia.sources.tables import materialize, scratch


def index_build(spark, d):
    """The tables of the documents' index, with their rows and digests."""
    path = scratch(spark)
    I.save(D.items(spark, d), path)
    index = I.load(spark, path, check=False)
    tables = {"lengths": index.lengths, "postings": index.postings.join(index.frequencies, ["bucket", "term"]).drop("bucket")}
    return reduce(DataFrame.unionByName, [V.digest(t).select(F.lit(name).alias("name"), "n", "digest") for name, t in tables.items()])


def bm25_from_index_top10(spark, d):
    """BM25 from a saved and loaded index."""
    path = scratch(spark)
    I.save(D.items(spark, d), path)
    return R.top_k(R.best_of(I.matches(I.load(spark, path), D.queries(spark, d)), 10), 10)


def headed_units(spark, d):
    """Lines of documents with their section's first line as heading."""
    u = X.units_from_documents(D.table(spark, d, "documents"))
    first = F.first(T.collapse("text")).over(D.Window.partitionBy("doc_id", "section").orderBy("ordinal"))
    return u.withColumn("heading", F.when(first != "", first)).withColumn("is_heading", F.col("ordinal") % X.SECTION == 0)


def chunk_texts(spark, d):
    """Packed chunks with their ids, titles, and digests of their text, lexical text and body."""
    units = headed_units(spark, d)
    rows = C.chunk_records(C.packed(units), units.select("doc_id", "ordinal", "text", "n_tokens", "heading", "is_heading"), "c2")
    return rows.select("doc_id", "chunk", "id", "title", "text_sha256", F.sha2("lexical", 256).alias("lexical_sha256"), F.sha2("body", 256).alias("body_sha256"), "n_tokens")


def policy_integrity(spark, d):
    """Scoring windows of sections and merged components that break their policy's rules."""
    u = X.units_from_documents(D.table(spark, d, "documents"))
    components = materialize(C.chunk_table(C.packed(u)))
    return C.section_windows_ok(C.sections(u)).crossJoin(C.merged_ok(C.merged(components), components))  # one row each


def _dense_for_benchmark(spark, d, k):
    """Items of the embeddings table for every benchmark item, whose vector is the one of its number."""
    e = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    q = e.join(R.near(D.queries(spark, d).select(F.col("query_id").alias("item_id"))), "item_id", "left_semi").withColumnRenamed("item_id", "query_id")
    return R.top_k(R.dense_scores(e, q, k), k)


def hybrid_dense_top10(spark, d):
    """Reciprocal-rank fusion of BM25 and exact dense search."""
    return R.top_k(R.rrf([D.bm25(spark, d, 100), _dense_for_benchmark(spark, d, 100)]), 10)


def _document_qrels(spark, d):
    hits = D.hits(spark, d).select("query_id", F.col("item_id").alias("document_id"), F.lit(True).alias("topical"), F.array("sentence").alias("hits"))
    return M.source_document_qrels(hits, D.nuggets(spark, d).select("query_id", F.col("sentence").alias("nugget_id")))


def source_doc_ndcg(spark, d):
    """nDCG of documents, each at its best window's place in a ranking of windows."""
    from evidentia.plans.ranking import source_doc_ranking

    return M.ranking_metrics(source_doc_ranking(spark, d), _document_qrels(spark, d)).select("query_id", "ndcg_10")


def _negatives(spark, d, m, runs):
    """Judged documents without a nugget, by the first run that has them in its first ten."""
    q = D.qrels(spark, d, m).where("grade <= 1")
    tops = [r.where("rank <= 10").select("query_id", "item_id", F.lit(s).alias("system")) for s, r in runs.items()]
    first = reduce(DataFrame.unionByName, tops).groupBy("query_id", "item_id").agg(F.min("system").alias("provenance"))
    return q.join(first, ["query_id", "item_id"], "left").select("query_id", F.col("item_id").alias("span_id"), "grade", F.coalesce("provenance", F.lit("none")).alias("provenance"))


def hit_rate_by_provenance(spark, d):
    """How often the hybrid ranking's first items are hard negatives, in all and by where those come from."""
    m = D.matched(spark, d)
    runs = {s: materialize(r) for s, r in _runs(spark, d, m=m).items()}
    spans = D.items(spark, d).select("item_id", F.col("item_id").alias("span_id"))
    return M.hit_rates(runs["hybrid"], _negatives(spark, d, m, runs), spans)


def evaluation_bundle(spark, d):
    """All macro metrics and the exposure to hard negatives of three systems."""
    m = D.matched(spark, d)
    runs = {s: materialize(r) for s, r in _runs(spark, d, 100, m).items()}
    qrels, spans = materialize(D.qrels(spark, d, m)), D.items(spark, d).select("item_id", F.col("item_id").alias("span_id"))
    negatives = qrels.where("grade <= 1").select("query_id", F.col("item_id").alias("span_id"), "grade")
    return reduce(DataFrame.unionByName, [M.bundle(r, qrels, negatives, spans, s) for s, r in runs.items()])


def answerability_oof(spark, d):
    """Answerability of the benchmark's queries from features of two rankings, calibrated out of fold."""
    m = D.matched(spark, d)
    a, b = materialize(D.bm25(spark, d, 10, m)), materialize(D.overlap(spark, d, 10, m))
    named = lambda r, p: R.features(r).select("query_id", F.col("top_score").alias(f"{p}_top"), F.col("margin").alias(f"{p}_margin"))
    has = D.hits(spark, d).select("query_id").distinct().withColumn("label", F.lit(1))
    rows = D.queries(spark, d).select("query_id").join(has, "query_id", "left").join(named(a, "s"), "query_id", "left").join(named(b, "d"), "query_id", "left").join(R.rank_agreement(a, b), "query_id", "left").fillna(0)
    rows = rows.select(F.col("query_id").alias("id"), (F.col("query_id") % 8).alias("group"), (F.col("query_id") % 8 % 5).cast("int").alias("fold"), F.col("label"), "s_top", "s_margin", "d_top", "d_margin", "agreement")
    return S.answerability_oof(materialize(rows), ["s_top", "s_margin", "d_top", "d_margin", "agreement"], 0.75)


def system_comparisons(spark, d):
    """Three systems' nDCG against BM25's: resampled differences, adjusted over all comparisons."""
    m = D.matched(spark, d)
    qrels = materialize(D.qrels(spark, d, m))
    rows = [M.ranking_metrics(r, qrels).select(F.lit(s).alias("name"), "query_id", (F.col("query_id") % 8).alias("group"), F.col("ndcg_10").alias("score")) for s, r in _runs(spark, d, 100, m).items()]
    return S.comparisons(materialize(reduce(DataFrame.unionByName, rows)), "bm25")


def backend_gate(spark, d):
    """Sources as candidates whose length and count may not fall."""
    rows = D.table(spark, d, "documents").groupBy(F.col("source").alias("candidate")).agg(rounded(F.avg("n_chars") / 2400 - 1, 4).alias("size"), rounded(F.count("*") / 50.0 - 1, 4).alias("rows"))
    return S.backend_gate(rows, {"size": -0.2, "rows": -0.1})


def run_bundle(spark, d):
    """The run of a written bundle, read back by its matrix entry, with the grades that its first ten items were written with."""
    m = D.matched(spark, d)
    run, qrels = materialize(D.bm25(spark, d, 20, m)), materialize(D.qrels(spark, d, m))
    root = scratch(spark)
    manifest = files.write_run_bundle(run, qrels, M.macro(M.ranking_metrics(run, qrels)), {"k1": R.K1, "b": R.B}, "bm25", root)
    matrix = files.matrix_manifest([manifest])
    back = files.read_matrix(spark, root, matrix, run.select("query_id").distinct())["bm25"]
    top = trec.read_json_lines(spark, f"{root}/{manifest['id']}/top10", "query_id long, item_id long, rank int, score double, grade int")
    rows = back.select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id"), "rank", "score", "tag")
    return rows.join(top.select("query_id", "item_id", "grade"), ["query_id", "item_id"], "left")


def qrels_last_line(spark, d):
    """Judgments read from two files, of which the later one lowers every third grade: the last line counts."""
    q, path = D.qrels(spark, d), scratch(spark)
    q = materialize(q)
    trec.write_qrels(q.coalesce(1), f"{path}/a")
    trec.write_qrels(q.where("item_id % 3 = 0").withColumn("grade", F.lit(0)).coalesce(1), f"{path}/b")
    rows = trec.read_qrels(spark, [f"{path}/a", f"{path}/b"])
    return rows.select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id"), "grade")


def json_lines_roundtrip(spark, d):
    path = scratch(spark)
    trec.write_json_lines(D.table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path, "conv_id")
    return trec.read_json_lines(spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


def extraction_checks(spark, d):
    pages = D.table(spark, d, "pages")
    return V.extraction_checks(pages, X.units_from_pages(pages), pages.select("page_id").limit(0), ["heading", "paragraph", "list_item", "table_row", "code", "image_alt"])


QUERIES = {f.__name__: f for f in [index_build, bm25_from_index_top10, chunk_texts, policy_integrity, hybrid_dense_top10, source_doc_ndcg, hit_rate_by_provenance, evaluation_bundle, answerability_oof, system_comparisons, backend_gate, run_bundle, qrels_last_line, json_lines_roundtrip, extraction_checks]}

D.CTES |= {
    "hw": ("pu", r"select pu.page_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as t, list_distinct(regexp_extract_all(lower(html), '[\p{L}\p{N}_]+')) as known from pu join pages using (page_id) where node_type = 'heading'"),
    "tk": ("items", f"select item_id, {D.analyzed('text')} as toks from items"),
    "po": ("tk", "select term, item_id, length, count(*) as tf, count(*) over (partition by term) as df from (select item_id, len(toks)::int as length, unnest(toks) as term from tk) group by term, item_id, length"),
    "hu": ("units", f"select *, first_value({D.collapsed('text')}) over (partition by doc_id, section order by ordinal) as h from units"),
    "fr": ("c2 hu", f"""select doc_id, chunk, ordinal, unit_start, unit_stop, case when h <> '' then h end as heading, ordinal % 8 = 0 as is_heading,
        case when unit_start = 0 and unit_stop = n_tokens then text else array_to_string(({D.analyzed('text', False)})[unit_start + 1:unit_stop], ' ') end as part from c2 join hu using (doc_id, ordinal)"""),
    "fl2": ("fr", f"select *, {D.collapsed('concat_ws($$ $$, heading, part)')} as lex from fr"),
    "ck": (
        "fl2",
        """select doc_id, chunk, coalesce(arg_min(heading, ordinal), '') as title, coalesce(string_agg(part, chr(10) order by ordinal, unit_start) filter (part <> ''), '') as text, coalesce(string_agg(lex, chr(10) order by ordinal, unit_start) filter (lex <> ''), '') as inner_text,
        coalesce(string_agg(part, chr(10) order by ordinal, unit_start) filter (part <> '' and not is_heading), '') as body, sum(unit_stop - unit_start)::int as n_tokens, string_agg(ordinal || ':' || unit_start || ':' || unit_stop, ';' order by ordinal, unit_start, unit_stop) as trail from fl2 group by doc_id, chunk""",
    ),
    "bd": ("qs", f"select q.vec_id as query_id, e.vec_id as item_id, {D.r('list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::double * p[2]::double))')} as score from embeddings e join (select * from embeddings semi join qs on vec_id = query_id) q on e.vec_id <> q.vec_id"),
    "bd100": ("bd", D.ranked("bd", 100)),
    "hyb": ("bm100 bd100", f"select query_id, item_id, {D.r('sum(1.0::double / (60 + rank))', 9)} as score from (select query_id, item_id, rank from bm100 union all select query_id, item_id, rank from bd100) group by all"),
    "sdr": ("wbm wt", f"select query_id, item_id, (row_number() over (partition by query_id order by place, item_id))::int as rank from (select query_id, doc_id as item_id, min(rank) as place from ({D.ranked('wbm', 20)}) join wt using (item_id) group by all)"),
    "sdm": ("sdr pos", metrics_sql("sdr", "pos")),
    "ng": ("qr rn", "select q.query_id, q.item_id, grade, coalesce(prov, 'none') as provenance from qr q left join (select query_id, item_id, min(system) as prov from rn where rank <= 10 group by all) using (query_id, item_id) where grade <= 1"),
    "oo": (
        "bm100 ov100 hit qs",
        f"""select qs.query_id as id, (qs.query_id % 8 % 5)::int as fold, (qs.query_id in (select query_id from hit))::int as label, coalesce(a.t, 0)::double as s_top, coalesce(a.m, 0)::double as s_margin, coalesce(b.t, 0)::double as d_top, coalesce(b.m, 0)::double as d_margin, coalesce(g.agreement, 0)::double as agreement
        from qs left join (select query_id, max(score) filter (rank = 1) as t, {D.r("max(score) filter (rank = 1) - coalesce(max(score) filter (rank = 2), 0)")} as m from bm100 group by query_id) a on a.query_id = qs.query_id
        left join (select query_id, max(score) filter (rank = 1) as t, {D.r("max(score) filter (rank = 1) - coalesce(max(score) filter (rank = 2), 0)")} as m from ov100 group by query_id) b on b.query_id = qs.query_id
        left join (select l.query_id, {D.r("sum((11 - abs(l.rank - r.rank)) / 10.0::double) / 10")} as agreement from bm100 l join ov100 r using (query_id, item_id) where l.rank <= 10 and r.rank <= 10 group by l.query_id) g on g.query_id = qs.query_id""",
    ),
}
_FEATURES = ("s_top", "s_margin", "d_top", "d_margin", "agreement")
_Z = D.r(" + ".join(f"(o.{c} - m.m_{c}) / case when abs(m.s_{c}) < 1e-12 then 1 else m.s_{c} end" for c in _FEATURES))
D.CTES |= {
    "om": ("oo", "select t.test, " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _FEATURES) + " from oo join (select distinct fold as test from oo) t on fold <> t.test group by t.test"),
    "oz": ("oo om", f"select m.test, o.id, o.fold, o.label, {_Z} as score from oo o, om m"),
    "ob": ("oz", "select test, score, lead(score) over w as nx, lag(score) over w as pr, sum(p) over w as lp, sum(q) over w as lq, sum(p) over (partition by test) as tp, sum(q) over (partition by test) as tq from (select test, score, sum(label) as p, sum(1 - label) as q from oz where fold <> test group by test, score) window w as (partition by test order by score)"),
    "oc": ("ob", f"select test, -b.t as threshold from (select test, max({{'a': {D.r('((tp - lp) / tp::double + lq / tq::double) / 2', 12)}, 's': tp - lp + tq - lq, 't': -t}}) as b from (select test, tp, tq, coalesce((score + nx) / 2, score + 1) as t, lp, lq from ob union all select test, tp, tq, score - 1, 0, 0 from ob where pr is null) group by test)"),
    "os": ("oz", "select id, label, score, fold, row_number() over (order by score desc, id) as k, count(*) over () as n from oz where fold = test"),
    "oj": ("os oc", "select os.*, score >= threshold as yes from os join oc on fold = test"),
    "ox": ("os", "select round, slot, ('0x' || substr(md5('c:' || round || ':' || slot), 1, 13))::bigint % n + 1 as pick, round_even(n * 0.75, 0) as take from (select k - 1 as slot, n from os), (select unnest(range(10000)) as round)"),
    "or1": ("ox os", "select x.round, sum(1 - label) / max(take)::double as m from (select *, row_number() over (partition by round order by pick, slot) as place from ox) x join os on os.k = x.pick where place <= take group by x.round"),
}


def _compare(name: str, table: str) -> str:
    """SQL for a row of comparisons()."""
    delta = f"(select b.query_id % 8 as g, {D.r('o.ndcg_10 - b.ndcg_10')} as delta from bmm b join {table} o using (query_id))"
    groups = f"(select g, sum(delta) as s, count(*) as n, row_number() over (order by g) - 1 as k from {delta} group by g)"
    slots = f"(select *, count(*) over (partition by round) as total from {groups}, (select unnest(range(10000)) as round))"
    boot = f"(select c.round, sum(x.s) / sum(x.n) as m from (select round, {_hash('b')} % total as pick from {slots}) c join {groups} x on x.k = c.pick group by c.round)"
    flips = f"(select round, sum(case when {_hash('p')} % 2 = 0 then 1 else -1 end * s) / sum(n) as m from {slots} group by round)"
    return f"""select '{name}' as name, {D.r(f"(select avg(delta) from {delta})")} as mean, {D.r(f"(select quantile_cont(m, 0.025) from {boot})")} as low, {D.r(f"(select quantile_cont(m, 0.975) from {boot})")} as high,
      {D.r(f"((select count(*) from {flips} where abs(m) >= abs((select avg(delta) from {delta})) - 1e-12) + 1) / 10001.0::double")} as p, {D.r(f"coalesce((select avg(delta) / nullif(stddev_samp(delta), 0) from {delta}), 0)")} as effect"""


_DIGEST = "sum(('0x' || substr(md5({}), 1, 12))::hugeint) % 2305843009213693951"
_MACRO = ["ndcg_3", "ndcg_10", "p_3", *[f"recall_{k}" for k in (1, 3, 5, 10, 20, 100)], "rr_10", "ap", "judged_10", "bpref"]
_EXPOSED = "(select avg(x) from (select q.query_id, " + D.r("count(r.rank) / count(*)::double") + " as x from (select * from qr where grade <= 1) q left join (select * from {} where rank <= 5) r using (query_id, item_id) group by q.query_id))"
ORACLE = {
    "index_build": D.sql(
        f"select 'postings' as name, count(*) as n, ({_DIGEST.format('concat_ws(chr(31), df, item_id, length, term, tf)')})::bigint as digest from po union all select 'lengths', count(*), ({_DIGEST.format('concat_ws(chr(31), item_id, len(toks))')})::bigint from tk", "po tk"
    ),
    "bm25_from_index_top10": D.sql("select * from bm100 where rank <= 10", "bm100"),
    "chunk_texts": D.sql(
        "select doc_id, chunk, substr(sha256(concat_ws(chr(0), 'c2', doc_id, sha256(text), trail)), 1, 32) as id, title, sha256(text) as text_sha256, sha256(concat_ws(chr(10), case when title <> '' then title end, inner_text)) as lexical_sha256, sha256(body) as body_sha256, n_tokens from ck", "ck"
    ),
    "policy_integrity": "select 0::bigint as broken, 0::bigint as several_parents, 0::bigint as overlong, 0::bigint as lost_components, 0::bigint as extra_components",
    "hybrid_dense_top10": D.sql(D.ranked("hyb", 10), "hyb"),
    "source_doc_ndcg": D.sql("select query_id, ndcg_10 from sdm", "sdm"),
    "hit_rate_by_provenance": D.sql("select provenance, count(*) as negatives, " + ", ".join(f"{D.r(f'count(*) filter (rank <= {k}) / count(*)::double')} as hit_rate_{k}" for k in (1, 3, 5, 10)) + " from ng left join (select query_id, item_id, rank from rf100) using (query_id, item_id) group by rollup (provenance)", "ng rf100"),
    "evaluation_bundle": D.sql(" union all ".join(f"select '{s}' as system, (select count(*) from {m}) as queries, " + ", ".join(f"{D.r(f'(select avg({c}) from {m})')} as {c}" for c in _MACRO) + f", {D.r(_EXPOSED.format(run))} as exposure_5" for s, m, run in (("bm25", "bmm", "bm100"), ("dense", "ovm", "ov100"), ("hybrid", "rfm", "rf100"))), "bmm ovm rfm bm100 ov100 rf100 qr"),
    "answerability_oof": D.sql(
        f"""select {D.r("(select sum(case when a.score > b.score then 1 when a.score = b.score then 0.5 else 0 end) / count(*)::double from os a, os b where a.label = 1 and b.label = 0)")} as auroc,
        {D.r("(select avg((select count(*) filter (label = 1) / count(*)::double from os b where b.score >= a.score)) from os a where label = 1)")} as ap,
        {D.r("(select count(*) filter (yes) / count(*)::double from oj)")} as coverage, {D.r("(select count(*) filter (yes and label = 0) / nullif(count(*) filter (yes), 0)::double from oj)")} as selective_risk,
        {D.r("(select count(*) filter (not yes and label = 0) / nullif(count(*) filter (not yes), 0)::double from oj)")} as abstention_precision, (select count(*) from os where k <= round_even(n * 0.75, 0) and label = 0) as fixed_errors,
        {D.r("(select quantile_cont(m, 0.025) from or1)")} as low, {D.r("(select quantile_cont(m, 0.975) from or1)")} as high""",
        "os oj or1",
    ),
    "system_comparisons": D.sql(f"select name, mean, low, high, p, effect, {D.r('max(a) over (order by p, name rows unbounded preceding)')} as adjusted from (select *, least(1.0::double, p * (count(*) over () - row_number() over (order by p, name) + 1)) as a from ({_compare('dense', 'ovm')} union all {_compare('hybrid', 'rfm')}))", "bmm ovm rfm"),
    "backend_gate": f"with m as (select source as candidate, {D.r('avg(n_chars) / 2400 - 1', 4)} as size, {D.r('count(*) / 50.0 - 1', 4)} as n from documents group by source) select candidate, size >= -0.2 and n >= -0.1 as guarded, size >= -0.2 and n >= -0.1 as passes from m",
    "run_bundle": D.sql("select b.query_id, b.item_id, b.rank, b.score, 'bm25' as tag, case when b.rank <= 10 then grade end as grade from bm100 b left join qr using (query_id, item_id) where b.rank <= 20", "bm100 qr"),
    "qrels_last_line": D.sql("select query_id, item_id, case when item_id % 3 = 0 then 0 else grade end as grade from qr", "qr"),
    "json_lines_roundtrip": "select conv_id, turn, role, sha256(text) as text_sha256 from conversations",
    "extraction_checks": D.sql(
        """select unnest(['repeated_id', 'repeated_place', 'unknown_page', 'page_without_units', 'missing_type', 'heading_off_source', 'empty_text']) as rule, unnest([(select count(*) - count(distinct unit_id) from pu), (select count(*) - count(distinct page_id || ':' || ordinal) from pu), 0,
          (select count(*) from pages where page_id not in (select page_id from pu)), (select count(*) from (select unnest(['heading', 'paragraph', 'list_item', 'table_row', 'code', 'image_alt']) as t) where t not in (select node_type from pu)),
          (select count(*) from hw where len(list_intersect(t, known)) / greatest(1, len(t))::double < 0.8), 0])::bigint as broken""",
        "pu hw",
    ),
}
