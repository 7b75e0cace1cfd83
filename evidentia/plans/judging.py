"""Judgment, pooling, review, sink and request-log queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.numeric import rounded
from evidentia.functions.text import duplicate_key
from evidentia.operators import cards as K
from evidentia.operators import chunking as C
from evidentia.operators import extraction as X
from evidentia.operators import metrics as M
from evidentia.operators import pooling as P
from evidentia.operators import retrieval as R
from evidentia.plans import _data as D
from evidentia.plans.evaluation import _labelers, metrics_sql
from evidentia.plans.ranking import _window_texts
from evidentia.sources import trec
from evidentia.sources.tables import materialize, scratch
from evidentia.streaming import windows as W

_SLOTS = {"intent": {"fact": 10, "howto": 14, "compare": 6, "why": 2}, "difficulty": {"easy": 12, "medium": 12, "hard": 8}, "answerability": {"answerable": 24, "no_answer": 8}}


def _runs(spark, d, k=50, m=None):
    m = m or D.matched(spark, d)
    return {"bm25": D.bm25(spark, d, k, m), "dense": D.overlap(spark, d, k, m), "hybrid": D.hybrid(spark, d, k, m)}


def grade_projection(spark, d):
    """Sentence judgments of documents projected onto fixed windows by the units that hold the sentences."""
    units = X.units_from_documents(D.table(spark, d, "documents"))
    nuggets = D.nuggets(spark, d)
    sentences = D._sentences(units.select("doc_id", "ordinal", "text"), "doc_id", "ordinal").join(nuggets, "sentence")
    span = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"))
    judgments = sentences.groupBy("query_id", span.alias("span_id")).agg(F.lit(True).alias("topical"), F.collect_set("sentence").alias("hits"))
    pieces = C.fixed(units).join(units.select("doc_id", "ordinal", "n_tokens"), ["doc_id", "ordinal"])
    fragments = pieces.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("chunk_id"), span.alias("span_id"), ((F.col("unit_start") == 0) & (F.col("unit_stop") == F.col("n_tokens"))).alias("is_full"))
    return P.project(fragments, judgments, nuggets.select("query_id", F.col("sentence").alias("nugget_id")))


def pool_build(spark, d):
    return P.pool(_runs(spark, d))


def depth_report(spark, d):
    m = D.matched(spark, d)
    return P.depth_report(P.pool(_runs(spark, d, m=m)), D.qrels(spark, d, m))


def exclusive_judgments(spark, d):
    return P.exclusive(_runs(spark, d), 20)


def system_order(spark, d):
    """Systems by mean nDCG@10, then name."""
    m = D.matched(spark, d)
    q = D.qrels(spark, d, m)
    rows = [M.ranking_metrics(r, q).agg(rounded(F.avg("ndcg_10")).alias("score")).select(F.lit(s).alias("system"), "score") for s, r in _runs(spark, d, m=m).items()]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.withColumn("place", F.row_number().over(D.Window.orderBy(F.col("score").desc(), "system")))


def hard_negative_selection(spark, d):
    m = D.matched(spark, d)
    pooled = P.pool(_runs(spark, d, m=m)).join(D.qrels(spark, d, m), ["query_id", "item_id"])
    return P.hard_negatives(pooled.select("query_id", "item_id", "grade", "minimum_rank", F.split("provenance", ",").alias("provenance"), F.lit(None).cast("string").alias("no_answer_reason")))


def review_queue(spark, d):
    rows = _labelers(spark, d)
    return P.review_queue(rows.select("id", F.least("l", F.lit(1)).alias("l"), F.least("r", F.lit(1)).alias("r")), rows.where("l = 0 and r = 0").select("id"))


def round_robin_sample(spark, d):
    docs = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id").select("doc_id", "source", "lang", "quality")
    return P.round_robin(docs.select("doc_id", "lang", "quality"), F.concat_ws("/", "lang", F.col("quality").cast("string")), "doc_id", 60)


def canonical_dedupe(spark, d):
    docs = D.table(spark, d, "documents")
    return P.canonical(docs.select(F.col("doc_id").alias("item_id"), "source", F.sha2(duplicate_key("text"), 256).alias("k")), F.col("k"))


def quota_slots(spark, d):
    return P.quota_slots(spark, _SLOTS, "dev")


def adjudication_diff(spark, d):
    rows = _labelers(spark, d)
    label = lambda c: rows.select("id", F.when(F.col(c) > 0, F.col(c)).alias("grade"), (F.col(c) >= 2).alias("relevant"))
    return P.adjudication(label("l"), label("r"), ["id"], ["grade", "relevant"])


def submission_validation(spark, d):
    rows = D.table(spark, d, "labels").join(D.table(spark, d, "documents"), "doc_id")
    return P.violations(rows, {"quality_known": F.col("quality").isin(0, 1), "text_present": F.length("text") > 0, "chars_match": F.length("text") == F.col("n_chars"), "long_enough": F.col("n_chars") >= 100, "source_named": F.col("source").rlike("^src[0-9]+$")})


def anti_join_missing(spark, d):
    """Documents without a label, by language."""
    return D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("unlabelled"))


def trec_roundtrip(spark, d):
    path = scratch(spark)
    trec.write_run(D.bm25(spark, d, 10), path, "bm25")
    return trec.read_run(spark, path).select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id"), "rank", "score", "tag")


def beir_roundtrip(spark, d):
    path = scratch(spark)
    corpus = D.items(spark, d).select(F.col("item_id").cast("string").alias("_id"), F.lit("").alias("title"), "text")
    trec.write_beir(corpus, D.queries(spark, d).select(F.col("query_id").cast("string").alias("_id"), "text"), D.qrels(spark, d), path)
    back, queries, qrels = trec.read_beir(spark, path)
    return qrels.join(back.select(F.col("_id").alias("item_id"), F.sha2("text", 256).alias("text_sha256")), "item_id").join(queries.select(F.col("_id").alias("query_id")), "query_id", "left_semi").select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").cast("long").alias("item_id"), "grade", "text_sha256")


def canonical_json(spark, d):
    rows = D.table(spark, d, "labels").select("toxic", "doc_id", F.when(F.col("quality") == 1, 1).alias("quality"))
    return rows.select("doc_id").join(trec.json_lines(rows).select("value", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id")), "doc_id").select("doc_id", "value", F.sha2("value", 256).alias("digest"))


def latency_percentiles(spark, d):
    return D.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("requests"), *M.percentiles(F.col("value")), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95_nearest"), F.max("value").alias("most"))


def stage_overhead(spark, d):
    """A user's time in each stage and the rest of the loop's, whose share must stay within a twentieth."""
    e = D.table(spark, d, "events").groupBy("user_id").agg(rounded(F.sum(F.when(F.col("event_type") == "view", F.col("value")))).alias("service"), rounded(F.sum("value")).alias("loop"))
    return e.select("user_id", "service", "loop", rounded(F.try_divide(F.col("loop") - F.col("service"), "loop"), 4).alias("overhead"))


def determinism_check(spark, d):
    """For each query the number of different first tens that two runs give, the documents dealt into partitions otherwise in each; one everywhere."""
    queries, runs, cores = D.queries(spark, d), [], spark.sparkContext.defaultParallelism
    for i, parts in enumerate((3 * cores, 7 * cores)):
        run = R.top_k(R.best_of(R.matches(D.items(spark, d).repartition(parts), queries.repartition(parts)), 10), 10)
        runs.append(materialize(run.withColumn("run", F.lit(i))))
    tops = runs[0].unionByName(runs[1]).groupBy("query_id", "run").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("top"))
    return tops.groupBy("query_id").agg(F.countDistinct("top").alias("different"))


def event_windows_stream(spark, d):
    return W.tumbling_counts(spark, f"{d}/events.parquet")


def chunk_ranking(spark, d):
    """(query_id, rank, doc_id, chunk) of each query's hundred best packed chunks by BM25 over all chunks' texts."""
    chunks = _window_texts(spark, d, C.packed)
    chosen = R.top_k(R.best_of(R.matches(chunks.select(F.col("window_id").alias("item_id"), "text"), D.queries(spark, d)), 100), 100)
    return materialize(chosen.select("query_id", "rank", "item_id.doc_id", "item_id.chunk"))


def card_inputs(spark, d):
    """The chunk ranking, its documents' fragments and their units."""
    ranking = chunk_ranking(spark, d)
    units = materialize(X.units_from_documents(D.table(spark, d, "documents")).join(R.near(ranking.select("doc_id").distinct()), "doc_id", "left_semi"))
    return ranking, materialize(C.packed(units)), units


def with_stops(fragments, units):
    return fragments.join(units.select("doc_id", "ordinal", K.sentence_stops("text").alias("stops")), ["doc_id", "ordinal"])


def expanded(ranking, fragments, mode):
    """The ranked chunks' fragments, with those that a mode of expansion adds."""
    chunks = C.chunk_table(fragments).withColumn("parent", X.parent_section("parent"))
    return C.expanded_fragments(fragments, C.expand(chunks, C.owned_sections(fragments), mode, ranking))


def evidence_cards(spark, d):
    """Token-budgeted cards of each query's best packed chunks."""
    ranking, fragments, units = card_inputs(spark, d)
    return K.assemble(ranking, with_stops(fragments, units))


def card_diagnostics(spark, d):
    return K.diagnostics(evidence_cards(spark, d))


def expanded_cards(spark, d):
    """Diagnostics of the cards that each way of expanding a chunk gives, over one ranking."""
    ranking, fragments, units = card_inputs(spark, d)
    rows = [K.diagnostics(K.assemble(ranking, with_stops(expanded(ranking, fragments, mode), units))).withColumn("mode", F.lit(mode)) for mode in ("leaf", "neighbor", "parent", "parent_neighbor")]
    return reduce(DataFrame.unionByName, rows)


def evidence_at_budget(spark, d):
    """Evidence and nugget recall, completeness and waste of each query's cards, sentences in whole units as gold, with the cards' duplicate rate."""
    ranking, fragments, units = card_inputs(spark, d)
    cards = materialize(K.assemble(ranking, with_stops(fragments, units)))
    shown = cards.select("query_id", "doc_id", F.explode("fragments").alias("f")).select("query_id", "doc_id", "f.*")
    nuggets = D.nuggets(spark, d)
    spans = D._sentences(units.select("doc_id", "ordinal", "text"), "doc_id", "ordinal").join(nuggets, "sentence")
    whole = shown.join(units.select("doc_id", "ordinal", "n_tokens"), ["doc_id", "ordinal"]).withColumn("is_full", (F.col("start") == 0) & (F.col("stop") == F.col("n_tokens")))
    marked = whole.join(spans, ["query_id", "doc_id", "ordinal"], "left").select("query_id", F.coalesce("sentence", F.lit("")).alias("span_id"), (F.col("stop") - F.col("start")).alias("tokens"), "is_full")
    gold = D.hits(spark, d).select("query_id", F.col("sentence").alias("span_id")).distinct()
    need = nuggets.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    scored = M.evidence(marked, gold, need.select("query_id", F.col("sentence").alias("nugget_id"), F.col("sentence").alias("span_id")))
    return scored.join(K.diagnostics(cards).select("query_id", "cards", "tokens", "duplicate_rate"), "query_id", "left")


QUERIES = {f.__name__: f for f in [grade_projection, pool_build, depth_report, exclusive_judgments, system_order, hard_negative_selection, review_queue, round_robin_sample, canonical_dedupe, quota_slots, adjudication_diff, submission_validation, anti_join_missing, trec_roundtrip, beir_roundtrip, canonical_json, latency_percentiles, stage_overhead, determinism_check, event_windows_stream, evidence_cards, card_diagnostics, expanded_cards, evidence_at_budget]}

D.CTES |= {
    "rn": ("bm100 ov100 rf100", "select query_id, item_id, rank, 'bm25' as system, 'lexical_candidate' as prov from bm100 where rank <= 50 union all select query_id, item_id, rank, 'dense', 'semantic_candidate' from ov100 where rank <= 50 union all select query_id, item_id, rank, 'hybrid', 'hybrid_candidate' from rf100 where rank <= 50"),
    "pool": ("rn", "select query_id, item_id, min(case when rank <= 20 then 20 when rank <= 30 then 30 when rank <= 40 then 40 else 50 end)::int as first_depth, min(rank)::int as minimum_rank, string_agg(distinct prov, ',' order by prov) as provenance, string_agg(system || ':' || rank, ',' order by system) as run_hits from rn group by query_id, item_id"),
    "rfm": ("rf100 qr", metrics_sql("rf100", "qr")),
    "us": ("units nug", r"select distinct query_id, doc_id, ordinal, sentence from (select doc_id, ordinal, trim(unnest(regexp_split_to_array(text, '[.\n]+'))) as sentence from units) join nug using (sentence)"),
}


def _slots() -> str:
    parts = []
    for a, counts in _SLOTS.items():
        rows = ", ".join(f"('{v}', {n})" for v, n in counts.items())
        parts.append(f"(select (row_number() over (order by sha256('dev:{a}' || chr(0) || value || chr(0) || k)) - 1)::int as slot, value as {a} from (select value, unnest(range(n)) as k from (values {rows}) t(value, n)))")
    return "select * from " + " join ".join(f"{p} {chr(97 + i)}" + (" using (slot)" if i else "") for i, p in enumerate(parts))


_NDCG = "select '{}' as system, " + D.r("avg(ndcg_10)") + " as score from {}"
_LG = "select id, case when {0} > 0 then {0} end as grade, {0} >= 2 as relevant from lb"
ORACLE = {
    "grade_projection": D.sql(
        """select query_id, chunk_id, case when got = 0 then 1 when got >= (select count(*) from nug n where n.query_id = x.query_id) then 3 else 2 end as grade, partial_hits
        from (select query_id, doc_id || ':' || chunk as chunk_id, count(distinct sentence) filter (is_full) as got, count(distinct ordinal) filter (not is_full) as partial_hits
          from (select us.query_id, c0.doc_id, c0.chunk, c0.ordinal, us.sentence, c0.unit_start = 0 and c0.unit_stop = u.n_tokens as is_full from us join c0 using (doc_id, ordinal) join units u using (doc_id, ordinal)) group by query_id, doc_id, chunk) x""",
        "us c0 units nug",
    ),
    "pool_build": D.sql("select * from pool", "pool"),
    "depth_report": D.sql(
        f"select depth, new_items, (sum(new_items) over w)::bigint as items, (sum(j) over w)::bigint as judged, (sum(new_items - j) over w)::bigint as unjudged, new_positive, {D.r('new_positive / new_items::double')} as yield from (select first_depth as depth, count(*) as new_items, count(grade) as j, count(*) filter (grade >= 2) as new_positive from pool left join qr using (query_id, item_id) group by first_depth) window w as (order by depth)",
        "pool qr",
    ),
    "exclusive_judgments": D.sql("select min(system) as system, query_id, item_id from rn where rank <= 20 group by query_id, item_id having count(*) = 1", "rn"),
    "system_order": D.sql(f"select system, score, (row_number() over (order by score desc, system))::int as place from ({_NDCG.format('bm25', 'bmm')} union all {_NDCG.format('dense', 'ovm')} union all {_NDCG.format('hybrid', 'rfm')})", "bmm ovm rfm"),
    "review_queue": D.sql(
        "select * from (with k as (select id, concat_ws(',', case when least(l, 1) <> least(r, 1) then 'disagreement' end, case when l = 0 and r = 0 then 'no_answer' end) as reasons from lb), a as (select id, row_number() over (order by id) as n from k where reasons = '') select id, reasons from k where reasons <> '' union all select id, 'agreed_sample' from a where n <= 15 - (select count(*) from k where reasons <> ''))",
        "lb",
    ),
    "round_robin_sample": "select doc_id, lang, quality, stratum from (select doc_id, lang, quality, lang || '/' || quality as stratum, row_number() over (partition by lang || '/' || quality order by doc_id) as turn from documents join labels using (doc_id)) order by turn, stratum limit 60",
    "canonical_dedupe": "select substr(sha256(k), 1, 32) as canonical_id, doc_id as item_id, min(doc_id) over (partition by k) as first_id, count(distinct doc_id) over (partition by k) as items, count(distinct source) over (partition by k) as sources from (select doc_id, source, sha256(lower(COLLAPSED)) as k from documents)".replace("COLLAPSED", D.collapsed("text")),
    "quota_slots": _slots(),
    "adjudication_diff": D.sql(f"select id, a.grade as grade_a, a.relevant as relevant_a, b.grade as grade_b, b.relevant as relevant_b from ({_LG.format('l')}) a join ({_LG.format('r')}) b using (id) where a.grade is distinct from b.grade or a.relevant is distinct from b.relevant", "lb"),
    "submission_validation": "with r as (select * from labels join documents using (doc_id)) " + " union all ".join(f"select '{n}' as rule, count(*) filter (not ({c})) as broken from r" for n, c in {"quality_known": "quality in (0, 1)", "text_present": "length(text) > 0", "chars_match": "length(text) = n_chars", "long_enough": "n_chars >= 100", "source_named": "regexp_matches(source, '^src[0-9]+$')"}.items()),
    "anti_join_missing": "select lang, count(*) as unlabelled from documents where doc_id not in (select doc_id from labels) group by lang",
    "trec_roundtrip": D.sql("select *, 'bm25' as tag from bm100 where rank <= 10", "bm100"),
    "beir_roundtrip": D.sql("select query_id, item_id, grade, sha256(text) as text_sha256 from qr join items using (item_id)", "qr items"),
    "canonical_json": """select doc_id, value, sha256(value) as digest from (select doc_id, '{"doc_id":' || doc_id || ',"quality":' || case when quality = 1 then '1' else 'null' end || ',"toxic":' || toxic || '}' as value from labels)""",
    "latency_percentiles": "select event_type, count(*) as requests, " + ", ".join(f"{D.r(f'quantile_cont(value, {p})')} as {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + ", quantile_disc(value, 0.95) as p95_nearest, max(value) as most from events group by event_type",
    "stage_overhead": f"select user_id, service, loop, {D.r('(loop - service) / nullif(loop, 0)', 4)} as overhead from (select user_id, {D.r('sum(value) filter (event_type = $$view$$)')} as service, {D.r('sum(value)')} as loop from events group by user_id)",
    "determinism_check": D.sql("select distinct query_id, 1::bigint as different from bm100", "bm100"),
    "event_windows_stream": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, " + D.r("sum(value)", 4) + " as total from events group by all",
}
