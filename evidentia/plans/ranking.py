"""Ranking queries: BM25, BM25F, dense, fusion, reranking, decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.numeric import norm, quantize, rounded
from evidentia.operators import chunking as C
from evidentia.operators import extraction as X
from evidentia.operators import metrics as M
from evidentia.operators import retrieval as R
from evidentia.plans import _data as D
from evidentia.sources.tables import materialize


def bm25_top10(spark, d):
    return D.bm25(spark, d, 10)


def _window_texts(spark, d, policy=C.fixed):
    """(window_id, item_id, text): the C0 windows of documents, or another policy's chunks, as texts, unit by unit."""
    units = X.units_from_documents(D.table(spark, d, "documents"))
    pieces = policy(units).join(units.select("doc_id", "ordinal", "text"), ["doc_id", "ordinal"])
    tokens = F.slice(T.analyze("text", []), F.col("unit_start") + 1, F.col("unit_stop") - F.col("unit_start"))
    texts = pieces.select("doc_id", "chunk", "ordinal", F.array_join(tokens, " ").alias("piece")).groupBy("doc_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return texts.select(F.struct("doc_id", "chunk").alias("window_id"), F.col("doc_id").alias("item_id"), "text")


def bm25_window_max(spark, d):
    found = R.matches(_window_texts(spark, d).select(F.col("window_id").alias("item_id"), "text"), D.queries(spark, d))
    return R.top_k(R.best_of(found, 10, owner=F.col("item_id.doc_id")), 10)


def _fields(spark, d):
    text = F.col("text")
    return D.items(spark, d).select("item_id", F.split(text, "\n", 2)[0].alias("heading"), F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit("")).alias("body"))


def bm25f_top10(spark, d):
    return R.top_k(R.bm25f_scores(_fields(spark, d), D.queries(spark, d), {"heading": 2.0, "body": 1.0}, {"heading": 0.5, "body": 0.75}), 10)


def dense_top10(spark, d):
    return D.dense(spark, d, 10)


def dense_int8_agreement(spark, d):
    """Exact dense rankings against those of vectors of 8-bit levels, cosine similarity."""
    items, queries = D.vectors(spark, d)
    unit = lambda rows, id_: rows.select(id_, quantize("vector").alias("v")).select(id_, F.transform("v", lambda x: x / norm("v")).alias("vector"))
    scores = R.dense_scores(unit(items, "item_id"), unit(queries, "query_id"), 10)
    return R.rank_agreement(D.dense(spark, d, 10), R.top_k(scores, 10))


def rrf_top10(spark, d):
    return D.hybrid(spark, d, 10)


def weighted_rrf_top10(spark, d):
    m = D.matched(spark, d)
    return R.top_k(R.rrf([D.bm25(spark, d, 50, m), D.overlap(spark, d, 50, m)], [2.0, 1.0], 10, 50), 10)


def nway_rrf_top10(spark, d):
    m, window = D.matched(spark, d), bm25_window_max(spark, d)
    return R.top_k(R.rrf_many([D.bm25(spark, d, 100, m), D.overlap(spark, d, 100, m), window]), 10)


def tmm_convex_top10(spark, d):
    m = D.matched(spark, d)
    union = materialize(D.bm25(spark, d, R.DEPTH, m).select("query_id", "item_id").union(D.overlap(spark, d, R.DEPTH, m).select("query_id", "item_id")).distinct())
    return R.top_k(R.tmm(R.bm25_of(m, union), R.overlap_of(m, union), 0.8, union=union), 10)


def rerank_top50(spark, d):
    m = D.matched(spark, d)
    return R.rerank(D.bm25(spark, d, 100, m), R.overlap_of(m, D.bm25(spark, d, 50, m)), 50)


def rerank_with_tail(spark, d):
    m = D.matched(spark, d)
    return R.rerank(D.bm25(spark, d, 100, m), R.overlap_of(m, D.bm25(spark, d, 20, m)), 20, True)


def query_decomposition(spark, d):
    c = D.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(T.subqueries("text")).alias("position", "subquery"))


def decomposed_bm25_top10(spark, d):
    """BM25 for each part of a decomposed query, the whole included, the first list counting as much as the others together."""
    asked = D.queries(spark, d).select("query_id", F.posexplode(T.subqueries("text")).alias("position", "text"))
    key = F.struct("query_id", "position").alias("key")
    scores = R.best_of(R.matches(D.items(spark, d), asked.select(key.alias("query_id"), "text")), 100)
    n = asked.groupBy("query_id").agg(F.count("*").alias("parts"))
    ranked = R.top_k(scores, 100).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.position").alias("position"), "item_id", "rank").join(R.near(n), "query_id")
    weight = F.when(F.col("position") == 0, 1.0).otherwise(1.0 / F.greatest(F.col("parts") - 1, F.lit(1)))
    fused = ranked.groupBy("query_id", "item_id").agg(rounded(F.sum(weight / (R.RRF_K + F.col("rank"))), 9).alias("score"))
    return R.top_k(fused, 10)


def contextual_bm25_top10(spark, d):
    """BM25 over documents with a header of where they come from."""
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("corpus | module="), "source", F.lit(" | page="), "lang", F.lit("\n"), "text").alias("text"))
    return R.top_k(R.best_of(R.matches(docs, D.queries(spark, d)), 10), 10)


def rank_agreement(spark, d):
    m = D.matched(spark, d)
    return R.rank_agreement(D.bm25(spark, d, 10, m), D.overlap(spark, d, 10, m))


def ranking_features(spark, d):
    return R.features(D.bm25(spark, d, 2))


def source_doc_ranking(spark, d):
    """A chunk ranking as a document ranking, each document at its first chunk."""
    windows = _window_texts(spark, d)
    run = R.top_k(R.best_of(R.matches(windows.select(F.col("window_id").alias("item_id"), "text"), D.queries(spark, d)), 20), 20)
    return M.first_by_document(run, run.select("item_id", F.col("item_id.doc_id").alias("document_id")).distinct())


QUERIES = {f.__name__: f for f in [bm25_top10, bm25_window_max, bm25f_top10, dense_top10, dense_int8_agreement, rrf_top10, weighted_rrf_top10, nway_rrf_top10, tmm_convex_top10, rerank_top50, rerank_with_tail, query_decomposition, decomposed_bm25_top10, contextual_bm25_top10, rank_agreement, ranking_features, source_doc_ranking]}

_AN = D.analyzed("text", False)
D.CTES |= {
    "wt": (
        "c0 units",
        f"select doc_id * 100000 + chunk as item_id, doc_id, string_agg(piece, ' ' order by ordinal) as text from (select c.doc_id, c.chunk, c.ordinal, array_to_string(({_AN})[unit_start + 1:unit_stop], ' ') as piece from c0 c join units u on c.doc_id = u.doc_id and c.ordinal = u.ordinal) group by doc_id, chunk",
    ),
    "wbm": ("wt qs", D.bm25_sql("wt", "qs")),
    "wmax": ("wbm wt", "select query_id, doc_id as item_id, max(score) as score from wbm join wt using (item_id) group by all"),
    "fl": ("", "select doc_id as item_id, string_split(text, chr(10))[1] as heading, case when contains(text, chr(10)) then substr(text, instr(text, chr(10)) + 1) else '' end as body from documents"),
    "qt": ("qs", f"select query_id, unnest(list_distinct({D.analyzed('text')})) as term from qs"),
    "fp": (
        "fl qt",
        " union all ".join(
            f"select item_id, term, sum({boost} * tf / (1 - {b} + {b} * length / average))::double as w from (select item_id, term, length, count(*) as tf from (select item_id, len(toks) as length, unnest(toks) as term from (select item_id, {D.analyzed(f)} as toks from fl)) where term in (select term from qt) group by all), (select greatest(1, avg(len({D.analyzed(f)}))) as average from fl) group by all"
            for f, boost, b in (("heading", 2.0, 0.5), ("body", 1.0, 0.75))
        ),
    ),
    "bmf": (
        "fp qt",
        f"select query_id, item_id, {D.r('sum(ln(1 + ((select count(*) from documents) - df + 0.5) / (df + 0.5)) * 2.5 * wtf / (1.5 + wtf))')} as score from (select item_id, term, wtf, count(*) over (partition by term) as df from (select item_id, term, sum(w) as wtf from fp group by all)) join qt using (term) group by query_id, item_id",
    ),
    "e8": ("", "select vec_id, list_transform(embedding, lambda x: floor(x::double * 127 / greatest(list_max(list_transform(embedding, lambda y: abs(y::double))), 1e-12) + 0.5)::int) as v from embeddings"),
    "d8": ("e8", f"select q.vec_id as query_id, e.vec_id as item_id, {D.r('list_sum(list_transform(list_zip(e.v, q.v), lambda p: (p[1] * p[2])::double)) / (sqrt(list_sum(list_transform(e.v, lambda x: (x * x)::double))) * sqrt(list_sum(list_transform(q.v, lambda x: (x * x)::double))))')} as score from e8 e join e8 q on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id"),
    "cx": ("", "select doc_id as item_id, 'corpus | module=' || source || ' | page=' || lang || chr(10) || text as text from documents"),
    "cbm": ("cx qs", D.bm25_sql("cx", "qs")),
    "dq": (
        "qs",
        r"""select query_id as of, position, query_id * 16 + position as query_id, text from (select query_id, (row_number() over (partition by query_id order by i) - 1)::int as position, s as text from (
          select query_id, s, i, row_number() over (partition by query_id, lower(s) order by i) as k from (select query_id, unnest(es) as s, unnest(range(len(es))) as i from (
            select query_id, case when len(cs) < 2 then [q] else list_concat([q, cs[1]], list_transform(cs[2:], lambda x: cs[1] || ' ' || x)) end as es from (
              select *, list_filter(list_transform(regexp_split_to_array(q, '(?i)\s*(?:;|,\s*(?:and\s+|then\s+)?|\bthen\b)\s*'), lambda x: regexp_replace(x, '^[ ,;?.]+|[ ,;?.]+$', '', 'g')), lambda x: len(string_split(x, ' ')) >= 2) as cs
              from (select query_id, COLLAPSED as q from qs))))) where k = 1) where position < 4""".replace("COLLAPSED", D.collapsed("text")),
    ),
    "dqs": ("items dq", D.bm25_sql("items", "dq")),
}


def _agreement(a: str, b: str) -> str:
    return f"select query_id, coalesce(agreement, 0)::double as agreement from (select distinct query_id from (select query_id from {a} union all select query_id from {b})) left join (select l.query_id, {D.r('sum((11 - abs(l.rank - r.rank)) / 10.0::double) / 10')} as agreement from {a} l join {b} r using (query_id, item_id) where l.rank <= 10 and r.rank <= 10 group by l.query_id) using (query_id)"


_FUSED = "select query_id, item_id, {r} as score from ({parts}) group by all"
ORACLE = {
    "bm25_top10": D.sql("select * from bm100 where rank <= 10", "bm100"),
    "bm25_window_max": D.sql(D.ranked("wmax", 10), "wmax"),
    "bm25f_top10": D.sql(D.ranked("bmf", 10), "bmf"),
    "dense_top10": D.sql("select * from dn100 where rank <= 10", "dn100"),
    "dense_int8_agreement": D.sql(_agreement("dn100", f"({D.ranked('d8', 10)})"), "dn100 d8"),
    "rrf_top10": D.sql("select * from rf100 where rank <= 10", "rf100"),
    "weighted_rrf_top10": D.sql(D.ranked("(" + _FUSED.format(r=D.r("sum(w / (10 + rank))", 9), parts="select query_id, item_id, rank, 2.0::double as w from bm100 where rank <= 50 union all select query_id, item_id, rank, 1.0 from ov100 where rank <= 50") + ")", 10), "bm100 ov100"),
    "nway_rrf_top10": D.sql(D.ranked("(" + _FUSED.format(r=D.r("sum(w / (60 + rank))", 9), parts=f"select query_id, item_id, rank, 1.0::double as w from bm100 union all select query_id, item_id, rank, 0.5 from ov100 union all select query_id, item_id, rank, 0.5 from ({D.ranked('wmax', 10)})") + ")", 10), "bm100 ov100 wmax"),
    "tmm_convex_top10": D.sql(
        D.ranked(
            f"(select query_id, item_id, {D.r('0.8 * (d + 1) / greatest(max(d) over (partition by query_id) + 1, 2.0::double ** -23) + 0.2 * s / greatest(max(s) over (partition by query_id), 2.0::double ** -23)')} as score from (select u.query_id, u.item_id, coalesce(bm.score, 0)::double as s, coalesce(ov.score, 0)::double as d from (select query_id, item_id from bm100 union select query_id, item_id from ov100) u left join bm using (query_id, item_id) left join ov using (query_id, item_id)))",
            10,
        ),
        "bm bm100 ov ov100",
    ),
    "rerank_top50": D.sql(D.ranked("(select b.query_id, b.item_id, b.rank as prior, coalesce(ov.score, 0)::double as score from bm100 b left join ov using (query_id, item_id) where rank <= 50)", None, "prior,"), "bm100 ov"),
    "rerank_with_tail": D.sql(
        "select query_id, item_id, (count(*) over (partition by query_id) - rank + 1)::double as score, rerank_score, rank from (select *, (row_number() over (partition by query_id order by rerank_score desc nulls last, prior, item_id))::int as rank from (select b.query_id, b.item_id, b.rank as prior, case when rank <= 20 then coalesce(ov.score, 0)::double end as rerank_score from bm100 b left join ov using (query_id, item_id)))",
        "bm100 ov",
    ),
    "query_decomposition": r"""with n as (select conv_id, turn, COLLAPSED as q from conversations),
      c as (select *, list_filter(list_transform(regexp_split_to_array(q, '(?i)\s*(?:;|,\s*(?:and\s+|then\s+)?|\bthen\b)\s*'), lambda x: regexp_replace(x, '^[ ,;?.]+|[ ,;?.]+$', '', 'g')), lambda x: len(string_split(x, ' ')) >= 2) as cs from n),
      e as (select conv_id, turn, case when len(cs) < 2 then [q] else list_concat([q, cs[1]], list_transform(cs[2:], lambda x: cs[1] || ' ' || x)) end as es from c),
      f as (select conv_id, turn, unnest(es) as s, unnest(range(len(es))) as i from e),
      g as (select conv_id, turn, s, i, row_number() over (partition by conv_id, turn, lower(s) order by i) as k from f)
      select conv_id, turn, position, subquery from (select conv_id, turn, (row_number() over (partition by conv_id, turn order by i) - 1)::int as position, s as subquery from g where k = 1) where position < 4""".replace("COLLAPSED", D.collapsed("text")),
    "decomposed_bm25_top10": D.sql(
        D.ranked("(" + _FUSED.format(r=D.r("sum(w / (60 + rank))", 9), parts=f"select dq.of as query_id, k.item_id, k.rank, case when position = 0 then 1 else 1.0::double / greatest(1, n - 1) end as w from ({D.ranked('dqs', 100)}) k join dq using (query_id) join (select of, count(*) as n from dq group by of) using (of)") + ")", 10), "dqs dq"
    ),
    "contextual_bm25_top10": D.sql(D.ranked("cbm", 10), "cbm"),
    "rank_agreement": D.sql(_agreement("bm100", "ov100").replace("from bm100 union", "from bm100 where rank <= 10 union"), "bm100 ov100"),
    "ranking_features": D.sql(f"select query_id, max(score) filter (rank = 1) as top_score, {D.r('max(score) filter (rank = 1) - coalesce(max(score) filter (rank = 2), 0)')} as margin from bm100 where rank <= 2 group by query_id", "bm100"),
    "source_doc_ranking": D.sql(f"select query_id, item_id, (row_number() over (partition by query_id order by place, item_id))::int as rank from (select query_id, doc_id as item_id, min(rank) as place from ({D.ranked('wbm', 20)}) join wt using (item_id) group by all)", "wbm wt"),
}
