"""Benchmark building, pooling and double-blind queries, over the driver's tables with some faults planted for the checks to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.text import duplicate_key
from evidentia.operators import benchmark as B
from evidentia.operators import blind as V
from evidentia.operators import extraction as X
from evidentia.operators import pooling as P
from evidentia.plans import _data as D
from evidentia.plans.evaluation import metrics_sql
from evidentia.plans.judging import _runs
from evidentia.sources.tables import materialize

INTENTS, REASONS = ("fact", "howto", "compare", "why"), ("absent", "wrong_version")


def _of(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _briefs(spark, d):
    """Benchmark items as briefs, their documents as hints. Faults: every 11th text is the first one's in capitals, every 13th has a reason, every
    17th the first intent, every 19th a hint that nobody knows, every 23rd no smoke slice."""
    q = F.col("query_id")
    hints = D.hits(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("hints"))
    rows = D.queries(spark, d).join(hints, "query_id", "left").withColumn("hints", F.coalesce("hints", F.array().cast("array<string>")))
    first = rows.agg(F.min_by("text", "query_id").alias("first"))
    has = F.size("hints") > 0
    return rows.crossJoin(F.broadcast(first)).select(  # one row
        F.concat(F.lit("S"), F.lpad(q.cast("string"), 4, "0")).alias("brief_id"),
        q.alias("number"),
        F.when(q % 11 == 3, F.upper("first")).otherwise(F.col("text")).alias("query_text"),
        F.when(q % 17 == 2, INTENTS[0]).otherwise(_of(INTENTS, q)).alias("intent"),
        F.when(has, "answerable").otherwise("no_answer").alias("answerability"),
        F.when(~has | (q % 13 == 5), _of(REASONS, q)).alias("no_answer_reason"),
        F.when(has, F.when(F.size("hints") == 1, "single_span").otherwise("cross_page")).alias("topology"),
        F.when(q % 19 == 7, F.array_append("hints", F.lit("nowhere"))).otherwise(F.col("hints")).alias("hints"),
        (q % 5 == 0).alias("smoke"),
        F.when((q % 5 == 0) & (q % 23 != 0), _of(("lexical", "semantic", "multi_evidence", "no_answer"), q)).alias("smoke_slice"),
    )


def brief_checks(spark, d):
    return B.brief_checks(_briefs(spark, d), D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("hint")))


def brief_quotas(spark, d):
    """Intents whose number differs from an even share of all briefs."""
    n = D.queries(spark, d).count()
    return B.quota_differences(_briefs(spark, d), {"intent": {v: (n + len(INTENTS) - 1 - i) // len(INTENTS) for i, v in enumerate(INTENTS)}})


def _submissions(spark, d, faults=True):
    """Each benchmark item's sentences as nuggets, its judged documents as spans. Faults by number: every 7th claims a single span, the next adds an
    unknown nugget, the next has no nuggets, the next a reason, the next is missing, the next comes twice."""
    m = D.matched(spark, d)
    hits = materialize(D.hits(spark, d))
    order = D.Window.partitionBy("query_id").orderBy("sentence")
    named = D.nuggets(spark, d).join(hits.select("query_id").distinct(), "query_id", "left_semi").withColumn("local_id", F.concat(F.lit("n"), F.row_number().over(order).cast("string")))
    spans = hits.groupBy("query_id", "sentence").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("spans"))
    nugget = F.struct("local_id", F.col("sentence").alias("text"), F.lit(True).alias("required"), F.coalesce("spans", F.array().cast("array<string>")).alias("spans"))
    nuggets = named.join(spans, ["query_id", "sentence"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(nugget)).alias("nuggets"))
    local = hits.join(named, ["query_id", "sentence"]).groupBy("query_id", "item_id").agg(F.array_sort(F.collect_set("local_id")).alias("local_ids"))
    judged = D.qrels(spark, d, m).join(local, ["query_id", "item_id"], "left")
    judgment = F.struct(F.col("item_id").cast("string").alias("span_id"), "grade", F.coalesce("local_ids", F.array().cast("array<string>")).alias("local_ids"))
    judgments = judged.groupBy("query_id").agg(F.array_sort(F.collect_list(judgment)).alias("judgments"))
    pages = judged.where("grade >= 2").join(D.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source"), "item_id").groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("pages"))
    q, has = F.col("query_id"), F.col("n").isNotNull()
    rows = D.queries(spark, d).join(nuggets, "query_id", "left").join(judgments, "query_id", "left").join(pages, "query_id", "left")
    fits = F.when(F.col("n") == 1, "single_span").when(F.col("pages") == 1, "same_page_multi_span").otherwise("cross_page")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    n_type, j_type = "array<struct<local_id:string,text:string,required:boolean,spans:array<string>>>", "array<struct<span_id:string,grade:int,local_ids:array<string>>>"
    fault = lambda k: F.lit(faults) & (q % 7 == k)
    told = F.when(fault(1), F.transform(none(F.col("judgments"), j_type), lambda j: j.withField("local_ids", F.array_append(j["local_ids"], F.lit("zz"))))).otherwise(none(F.col("judgments"), j_type))
    out = rows.select(
        F.concat(F.lit("S"), F.lpad(q.cast("string"), 4, "0")).alias("brief_id"),
        q.alias("query_id"),
        F.lit("adjudicator").alias("annotator_id"),
        F.when(has, "answerable").otherwise("no_answer").alias("answerability"),
        F.when(~has | fault(3), "absent").alias("no_answer_reason"),
        F.when(has, F.when(fault(0), "single_span").otherwise(fits)).alias("topology"),
        F.when(fault(2), F.array().cast(n_type)).otherwise(none(F.col("nuggets"), n_type)).alias("nuggets"),
        told.alias("judgments"),
        F.explode(F.when(fault(4), F.array().cast("array<int>")).when(fault(5), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return out.drop("copy")


def annotation_checks(spark, d):
    spans = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("span_id"), F.col("source").alias("document_id"))
    return B.annotation_checks(materialize(_submissions(spark, d)), _briefs(spark, d), spans, list(REASONS))


def benchmark_build(spark, d):
    """Judgments of the benchmark built of submissions without faults."""
    judged = B.build(_submissions(spark, d, False))[1]
    return judged.select("id", "query_id", "span_id", "topical", F.array_join("hits", ";").alias("hits"), "grade")


def benchmark_nuggets(spark, d):
    nuggets, _, negatives = B.build(materialize(_submissions(spark, d, False)))
    n = negatives.groupBy("query_id").agg(F.count("*").alias("negatives"))
    return nuggets.select("id", "query_id", F.size("spans").alias("spans")).join(n, "query_id", "left").fillna(0, ["negatives"])


def annotation_agreement(spark, d):
    """Two annotators by brief: the second judges one grade lower where item and query numbers add up to a multiple of three."""
    a = materialize(_submissions(spark, d, False))
    lower = lambda j: j.withField("grade", F.when((j["span_id"].cast("long") + F.col("query_id")) % 3 == 0, F.greatest(F.lit(0), j["grade"] - 1)).otherwise(j["grade"]))
    b = a.withColumn("judgments", F.transform("judgments", lower)).withColumn("topology", F.when(F.col("query_id") % 4 != 0, F.col("topology")))
    return B.agreement(a, b, ["answerability", "topology"])


def expert_candidates(spark, d):
    """Judged documents, and the documents before and after positives in their source."""
    docs = D.table(spark, d, "documents").select(F.lit(0).alias("doc_id"), F.col("source").alias("parent"), F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("heading_id"))
    siblings = X.sibling_headings(docs).select(F.col("heading_id").alias("span_id"), "before", "after")
    reasons = D.queries(spark, d).select("query_id", F.when(F.col("query_id") % 3 == 0, "wrong_version").alias("reason"))
    return P.expert_candidates(D.qrels(spark, d).withColumnRenamed("item_id", "span_id"), siblings, reasons)


def _judged_hits(spark, d, m):
    """(query_id, item_id, grade, hits) of judged documents with the digests of the sentences they have."""
    hits = D.hits(spark, d).groupBy("query_id", "item_id").agg(F.array_sort(F.collect_set(F.sha2("sentence", 256))).alias("hits"))
    return D.qrels(spark, d, m).join(hits, ["query_id", "item_id"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))


def annotation_templates(spark, d):
    m = D.matched(spark, d)
    return P.annotation_templates(P.pool(_runs(spark, d, m=m)), _judged_hits(spark, d, m))


def frontier_sizes(spark, d):
    """Items and queries that each depth adds to the pool."""
    pooled = materialize(P.pool(_runs(spark, d)))
    return B.union([P.frontier(pooled, k).agg(F.lit(k).alias("depth"), F.count("*").alias("items"), F.countDistinct("query_id").alias("queries")) for k in P.DEPTHS])


def depth_counts(spark, d):
    return P.depth_counts(P.pool(_runs(spark, d)))


def _annotations(spark, d, m):
    """Annotations of the judged pool by number of item and query: some with a wrong grade, without a span, with one that wasn't visible, or with other nuggets."""
    known = _judged_hits(spark, d, m)
    k = (F.col("item_id") + F.col("query_id")) % 10
    span = F.array(F.col("item_id").cast("string"))
    right = F.when(F.col("grade") >= 1, span).otherwise(F.array().cast("array<string>"))
    return known.select(
        "query_id", "item_id", (F.col("grade") >= 1).alias("topical"), "hits", F.when(k == 3, F.array(F.lit("other"))).otherwise(F.col("hits")).alias("nuggets"),
        F.when(k == 0, (F.col("grade") + 1) % 4).otherwise(F.col("grade")).cast("int").alias("grade"),
        F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("unseen"))).otherwise(right).alias("spans"), span.alias("visible"),
    )


def annotation_row_checks(spark, d):
    needs = D.nuggets(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set(F.sha2("sentence", 256))).alias("need"))
    return P.annotation_row_checks(_annotations(spark, d, D.matched(spark, d)), needs)


def annotation_seal(spark, d):
    """The judged pool as a package in which every tenth item is missing, every tenth comes twice, and one is nobody's."""
    keys, k = ["query_id", "item_id"], (F.col("item_id") + F.col("query_id")) % 10
    expected = materialize(D.qrels(spark, d).select(*keys))
    sent = expected.withColumn("copy", F.explode(F.when(k == 4, F.array().cast("array<int>")).when(k == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(*keys)
    stray = spark.createDataFrame([(-1, -1)], "query_id long, item_id long")
    return P.seal(expected, sent.unionByName(stray), keys)


def stability_by_depth(spark, d):
    m = D.matched(spark, d)
    runs = {s: materialize(r) for s, r in _runs(spark, d, m=m).items()}
    return P.stability(runs, P.pool(runs), D.qrels(spark, d, m))


def pool_is_stable(spark, d):
    return P.is_stable(stability_by_depth(spark, d))


def negative_coverage(spark, d):
    m = D.matched(spark, d)
    pooled = P.pool(_runs(spark, d, m=m)).join(D.qrels(spark, d, m), ["query_id", "item_id"])
    rows = materialize(pooled.select("query_id", "item_id", "grade", "minimum_rank", F.split("provenance", ",").alias("provenance"), F.lit(None).cast("string").alias("no_answer_reason")))
    asked = D.queries(spark, d).select("query_id").join(D.hits(spark, d).select("query_id").distinct().withColumn("answerable", F.lit(True)), "query_id", "left").fillna(False)
    return P.negative_coverage(rows, P.hard_negatives(rows), asked)


def _reviews(spark, d, m):
    """Pool items whose span is their text: equal texts are one review item."""
    span = D.items(spark, d).select("item_id", F.sha2(duplicate_key("text"), 256).alias("span"))
    pooled = P.pool(_runs(spark, d, m=m)).select("query_id", "item_id", F.col("first_depth").alias("depth")).join(span, "item_id")
    q = (F.col("item_id") + F.col("query_id")) % 4
    reasons = F.array_compact(F.array(F.when(q < 2, "agent_disagreement"), F.when(q == 2, "no_answer"), F.when(q != 2, "agreed_sample")))
    return pooled.select("query_id", F.array("span").alias("spans"), "item_id", "depth", reasons.alias("reasons"))


def canonical_reviews(spark, d):
    return V.canonical_reviews(_reviews(spark, d, D.matched(spark, d)))[0]


def calibration_picks(spark, d):
    """Review items for calibration: agreed ones, then some without an answer, then disagreements, each in turn over intents."""
    groups = materialize(V.canonical_reviews(_reviews(spark, d, D.matched(spark, d)))[0])
    rows = groups.select("id", F.split("reasons", ",").alias("reasons"), _of(INTENTS, F.col("query_id")).alias("stratum"), "query_id")
    return V.calibration(rows, {"agreed_sample": 12, "no_answer": 9, "agent_disagreement": 15})


def review_packets(spark, d):
    """Every judged document as a packet item with its query, nuggets and text."""
    rows = D.qrels(spark, d).select(F.concat_ws(":", F.col("query_id").cast("string"), F.col("item_id").cast("string")).alias("id"), "query_id", F.array(F.col("item_id").cast("string")).alias("spans"))
    queries = D.queries(spark, d).select("query_id", F.col("text").alias("query_text"), F.lit("answerable").alias("answerability"))
    nuggets = D.nuggets(spark, d).select("query_id", F.sha2("sentence", 256).alias("nugget_id"))
    made = V.packet(rows, queries, nuggets, D.items(spark, d).select(F.col("item_id").cast("string").alias("span_id"), "text"), "p1")
    return made.select("packet_id", "id", F.size("required_nuggets").alias("nuggets"), F.sha2("query_text", 256).alias("query_sha256"), F.sha2(F.array_join(F.transform("evidence", lambda e: e["text"]), ";"), 256).alias("evidence_sha256")).join(V.templates(made, "annotator_a").select(F.col("item_id").alias("id"), F.col("id").alias("template"), "status"), "id")


def hidden_leaks(spark, d):
    """Hidden topic ids that stand in documents, of which every other one is given one."""
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" see v0-"), F.lpad((F.col("doc_id") / 2 % 200).cast("int").cast("string"), 3, "0"))).otherwise(F.col("text")).alias("text"))
    hidden = spark.range(97, 161).select(F.concat(F.lit("v0-"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("hidden_id"))
    return V.leaks(docs, hidden, "v0-[0-9]{3}")


def _calibrated(spark, d, annotator):
    """Labelled documents as packet items and an annotator's submissions for them, with faults by number."""
    rows = D.table(spark, d, "labels")
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 20
    items = rows.select(i.alias("id"), F.lit("p1").alias("packet_id"), F.lit("answerable").alias("answerability"), F.array(F.lit("q")).alias("required"), F.array(i).alias("spans"))
    none = F.array().cast("array<string>")
    on, full = F.col("quality") == 1, (F.col("quality") == 1) & (F.col("toxic") == 0)
    right = F.when(full, 3).when(on, 1).otherwise(0)
    submissions = rows.select(
        V.submission_id(F.lit(annotator), i).alias("id"), F.when(k == 9, "p2").otherwise("p1").alias("packet_id"), i.alias("item_id"), F.when(k == 8, "someone").otherwise(annotator).alias("annotator_id"),
        F.when(k == 1, "PENDING").otherwise("SUBMITTED").alias("status"), F.when(k == 0, " ").otherwise("seen").alias("rationale"),
        F.lit("answerable").alias("answerability"), on.alias("topical"), F.when(full, F.array(F.lit("q"))).otherwise(none).alias("hits"),
        F.when(k == 2, right + 1).otherwise(right).alias("grade"), F.when(k == 3, F.array(F.lit("elsewhere"))).when(on & (k != 4), F.array(i)).otherwise(none).alias("spans"),
        F.when(k == 5, "unclear").alias("topic_issue"), F.explode(F.when(k == 6, F.array().cast("array<int>")).when(k == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return items, submissions.drop("copy")


def blind_submission_checks(spark, d):
    return V.submission_checks(*_calibrated(spark, d, "annotator_a"), "annotator_a")


def adjudication_checks(spark, d):
    """The second annotator's submissions taken for the adjudicator's, though the first two differ only in every third item."""
    items, left = _calibrated(spark, d, "annotator_a")
    right = left.withColumn("topical", F.when(F.col("item_id").cast("long") % 3 == 0, ~F.col("topical")).otherwise(F.col("topical")))
    return V.adjudication_checks(items, left, right, _calibrated(spark, d, "adjudicator")[1])


QUERIES = {
    f.__name__: f
    for f in [brief_checks, brief_quotas, annotation_checks, benchmark_build, benchmark_nuggets, annotation_agreement, expert_candidates, annotation_templates, frontier_sizes, depth_counts, annotation_row_checks, annotation_seal, stability_by_depth, pool_is_stable, negative_coverage, canonical_reviews, calibration_picks, review_packets, hidden_leaks, blind_submission_checks, adjudication_checks]
}

_ID = "substr(sha256(concat_ws(chr(0), {})), 1, 32)"
_BRIEF = "'S' || lpad({}::varchar, 4, '0')"
_N = "(select count(*) from qs)"
D.CTES |= {
    "has": ("hit", "select distinct query_id from hit"),
    "sp": ("pos documents_", "select p.query_id, count(*) as n, count(distinct source) as pages from pos p join documents_ on doc_id = p.item_id group by p.query_id"),
    "documents_": ("", "select * from documents"),
    "ln": ("nug has", "select query_id, sentence, 'n' || row_number() over (partition by query_id order by encode(sentence)) as local_id from nug semi join has using (query_id)"),
    "nid": ("ln hit", f"select ln.query_id as qn, 'seed-' || {_BRIEF.format('ln.query_id')} as query_id, sentence, count(distinct item_id) as spans, 'nugget-' || {_ID.format(chr(39) + 'seed-' + chr(39) + ' || ' + _BRIEF.format('ln.query_id') + ', local_id, sentence, coalesce(string_agg(distinct item_id::varchar, $$;$$ order by item_id::varchar), $$$$)')} as id from ln left join hit using (query_id, sentence) group by ln.query_id, sentence, local_id"),
    "jd": ("qr hit nid", "select q.query_id as qn, 'seed-' || " + _BRIEF.format("q.query_id") + " as query_id, q.item_id::varchar as span_id, q.grade >= 1 as topical, q.grade, coalesce(string_agg(distinct nid.id, ';' order by nid.id), '') as hits from qr q left join hit h using (query_id, item_id) left join nid on nid.qn = q.query_id and nid.sentence = h.sentence group by q.query_id, q.item_id, q.grade"),
    "gb": ("qr qs", "select q.query_id, q.item_id, q.grade as a, case when (q.item_id + q.query_id) % 3 = 0 then greatest(0, q.grade - 1) else q.grade end as b from qr q"),
    "jh": ("qr hit", "select q.query_id, q.item_id, q.grade, list_sort(list_distinct(list(sha256(h.sentence)) filter (h.sentence is not null))) as hits from qr q left join hit h using (query_id, item_id) group by q.query_id, q.item_id, q.grade"),
    "an": ("qr", "select query_id, item_id, (item_id + query_id) % 10 as k, grade from qr"),
    "sg": ("documents_", "select doc_id, lag(doc_id) over w as before, lead(doc_id) over w as after from documents_ window w as (partition by source order by doc_id)"),
    "xl": ("qr sg", "select query_id, item_id as span_id, case when grade >= 2 then 'seeded_positive' else 'seeded_agent_candidate' end as label from qr union select q.query_id, s.before, 'sibling_heading' from qr q join sg s on s.doc_id = q.item_id where grade >= 2 and s.before is not null union select q.query_id, s.after, 'sibling_heading' from qr q join sg s on s.doc_id = q.item_id where grade >= 2 and s.after is not null union select query_id, item_id, 'wrong_version' from qr where query_id % 3 = 0 and grade <= 1"),
    "rv": ("pool documents_", f"select 'canonical-review-' || {_ID.format('p.query_id, s')} as id, p.query_id, p.item_id, first_depth as depth, (p.item_id + p.query_id) % 4 as q from pool p join (select doc_id, sha256(lower({D.collapsed('text')})) as s from documents_) t on t.doc_id = p.item_id"),
    "rx": ("rv", "select id, 'agent_disagreement' as reason from rv where q < 2 union select id, 'no_answer' from rv where q = 2 union select id, 'agreed_sample' from rv where q <> 2"),
    "rg": ("rv rx", "select id, query_id, min(item_id) as first_item, count(distinct item_id) as items, min(depth)::int as minimum_depth, (select string_agg(reason, ',' order by reason) from rx where rx.id = rv.id) as reasons, (['fact', 'howto', 'compare', 'why'])[query_id % 4 + 1] as stratum from rv group by id, query_id"),
}


def _pick(bucket: str, n: int, used: str, more: str = "") -> str:
    """SQL for one bucket of calibration()."""
    return f"select '{bucket}' as bucket, id from (select id, stratum, row_number() over (partition by stratum order by id) as turn from rg where list_contains(string_split(reasons, ','), '{bucket}') {more} and id not in ({used})) order by turn, stratum limit {n}"


D.CTES |= {
    "c1": ("rg", _pick("agreed_sample", 12, "select ''")),
    "c2p": ("rg c1", _pick("no_answer", 9, "select id from c1")),
    "c3p": ("rg c1 c2p", _pick("agent_disagreement", 15, "select id from c1 union all select id from c2p")),
    "sys": ("bm100 ov100 rf100", "select query_id, item_id, rank, 'bm25' as name from bm100 where rank <= 50 union all select query_id, item_id, rank, 'dense' from ov100 where rank <= 50 union all select query_id, item_id, rank, 'hybrid' from rf100 where rank <= 50"),
    "dp": ("", "select unnest([20, 30, 40, 50]) as depth, ['none', 'bm25', 'dense', 'hybrid'] as helds, ['bm25', 'dense', 'hybrid'] as names"),
    "al": ("sys dp", "select depth, query_id, item_id, min(name) as alone from sys join dp on rank <= depth group by depth, query_id, item_id having count(*) = 1"),
    "sd": ("dp", "select depth, held, unnest(names) as name from (select depth, unnest(helds) as held, names from dp)"),
    "srun": ("sys sd", "select depth || '|' || held || '|' || s.name || '|' || query_id as query_id, item_id, rank from sys s join sd using (name)"),
    "srel": ("qr pool al sd", "select d.depth || '|' || held || '|' || name || '|' || q.query_id as query_id, q.item_id, grade from qr q join pool p using (query_id, item_id) join sd d on p.first_depth <= d.depth where not exists (from al where al.depth = d.depth and al.query_id = q.query_id and al.item_id = q.item_id and al.alone = d.held)"),
    "sm": ("srun srel", metrics_sql("srun", "srel")),
    "spl": ("sm", f"select *, row_number() over (partition by depth, held order by score desc, name) as place from (select split_part(query_id, '|', 1)::int as depth, split_part(query_id, '|', 2) as held, split_part(query_id, '|', 3) as name, {D.r('avg(ndcg_10)')} as score from sm group by all)"),
    "stau": ("spl", f"select depth, min(t) as tau from (select x.depth, x.held, {D.r('avg(sign(x.place - y.place) * sign(fx.place - fy.place))')} as t from spl x join spl y on x.depth = y.depth and x.held = y.held and x.name < y.name join spl fx on fx.depth = x.depth and fx.held = 'none' and fx.name = x.name join spl fy on fy.depth = x.depth and fy.held = 'none' and fy.name = y.name where x.held <> 'none' group by x.depth, x.held) group by depth"),
    "sdep": ("qr pool stau", f"select first_depth as depth, judged, positive, {D.r('positive / judged::double')} as yield, tau from (select first_depth, count(*) as judged, count(*) filter (grade >= 2) as positive from qr join pool using (query_id, item_id) group by first_depth) join stau on depth = first_depth"),
    "lk": ("", "select *, doc_id % 20 as k, quality = 1 as topical, case when quality = 1 and toxic = 0 then 3 when quality = 1 then 1 else 0 end as g from labels"),
}


def _blind(rows: str, who: str) -> str:
    """SQL for the faults of _calibrated()."""
    rules = {
        "rationale": "k = 0", "status": "k = 1", "grade": "k = 2", "outside_span": "k = 3", "span_off_topic": "k = 3 and g = 0", "no_span": "k = 4 and g >= 1",
        "issue_mixed": "k = 5", "missing": "k = 6", "repeated": "k = 7", "annotator": "k = 8", "packet": "k = 9",
    }
    return " union all ".join(f"select doc_id::varchar as id, '{r}' as rule from {rows} where {c}" for r, c in rules.items())


ORACLE = {
    "brief_checks": D.sql(
        f"""select {_BRIEF.format("query_id")} as id, rule from (select query_id, 'repeated_text' as rule from qs where query_id % 11 = 3 and query_id > (select min(query_id) from qs)
        union all select query_id, 'sidecar' from qs where query_id % 13 = 5 and query_id in (select query_id from has) union all select query_id, 'smoke' from qs where query_id % 5 = 0 and query_id % 23 = 0
        union all select query_id, 'unknown_hint' from qs where query_id % 19 = 7
        union all select q.query_id, 'repeated_text' from qs q where query_id % 11 <> 3 and exists (from qs p where p.query_id < q.query_id and lower({D.collapsed('p.text')}) = lower({D.collapsed('q.text')})))""",
        "qs has",
    ),
    "brief_quotas": D.sql(
        f"""select 'intent' as attribute, value, expected, coalesce(actual, 0) as actual from (select unnest(['fact', 'howto', 'compare', 'why']) as value, unnest([({_N} + 3) // 4, ({_N} + 2) // 4, ({_N} + 1) // 4, {_N} // 4]) as expected)
        left join (select case when query_id % 17 = 2 then 'fact' else (['fact', 'howto', 'compare', 'why'])[query_id % 4 + 1] end as value, count(*) as actual from qs group by value) using (value) where expected <> coalesce(actual, 0)""",
        "qs",
    ),
    "annotation_checks": D.sql(
        f"""select {_BRIEF.format("query_id")} as id, rule from (select query_id, 'topology' as rule from sp where query_id % 7 = 0 and n <> 1 union all select query_id, 'unknown_nugget' from sp where query_id % 7 = 1
        union all select query_id, unnest(['unknown_nugget', 'evidence']) from sp where query_id % 7 = 2 union all select query_id, 'sidecar' from sp where query_id % 7 = 3
        union all select query_id, 'missing' from qs where query_id % 7 = 4 union all select query_id, 'repeated' from qs where query_id % 7 = 5)""",
        "sp qs",
    ),
    "benchmark_build": D.sql(f"select 'judgment-' || {_ID.format('query_id, span_id, topical, hits')} as id, query_id, span_id, topical, hits, grade from jd", "jd"),
    "benchmark_nuggets": D.sql("select id, query_id, spans::int as spans, coalesce(n, 0) as negatives from nid left join (select query_id as qn, count(*) as n from qr where grade <= 1 group by query_id) using (qn)", "nid qr"),
    "annotation_agreement": D.sql(
        f"""select *, not same_fields or jaccard < 1 or equal_grades < common as differs from (select {_BRIEF.format("query_id")} as brief_id, {D.r("case when u = 0 then 1.0 else i / u::double end")} as jaccard, common, equal_grades, (query_id % 4 <> 0 or not has_topology) as same_fields
        from (select qs.query_id, qs.query_id in (select query_id from has) as has_topology, count(*) filter (a >= 2 and b >= 2) as i, count(*) filter (a >= 2 or b >= 2) as u, count(gb.item_id)::int as common, (count(*) filter (a = b))::int as equal_grades from qs left join gb using (query_id) group by qs.query_id))""",
        "qs gb has",
    ),
    "expert_candidates": D.sql("select x.query_id, x.span_id, max(q.grade) as grade, string_agg(distinct label, ',' order by label) as provenance from xl x left join qr q on q.query_id = x.query_id and q.item_id = x.span_id group by x.query_id, x.span_id", "xl qr"),
    "annotation_templates": D.sql("select p.query_id, p.item_id, grade >= 1 as topical, grade, case when grade >= 1 then array_to_string(hits, ';') else '' end as hits, case when grade is null then 'pending' else 'prepopulated' end as status from pool p left join jh using (query_id, item_id) where first_depth = 20", "pool jh"),
    "frontier_sizes": D.sql("select first_depth as depth, count(*) as items, count(distinct query_id) as queries from pool group by first_depth", "pool"),
    "depth_counts": D.sql("select query_id, " + ", ".join(f"count(*) filter (first_depth <= {k}) as depth_{k}" for k in P.DEPTHS) + " from pool group by query_id", "pool"),
    "annotation_row_checks": D.sql(
        "select query_id, item_id, rule from (select query_id, item_id, 'grade' as rule from an where k = 0 union all select query_id, item_id, 'no_span' from an where k = 1 and grade >= 1 union all select query_id, item_id, 'invisible_span' from an where k = 2 union all select query_id, item_id, 'span_off_topic' from an where k = 2 and grade = 0 union all select query_id, item_id, 'nugget_fields' from an where k = 3)", "an"
    ),
    "annotation_seal": D.sql("select count(*) as expected, count(*) + 1 - count(*) filter (k = 4) + count(*) filter (k = 5) as submitted, count(*) filter (k = 4) as missing, 1::bigint as extra, count(*) filter (k = 5) as repeated, false as complete from an", "an"),
    "stability_by_depth": D.sql("select * from sdep", "sdep"),
    "pool_is_stable": D.sql("select count(*) >= 3 and (select bool_and(yield < 0.01 and tau >= 0.95) from (from sdep order by depth desc limit 2)) as stable from sdep", "sdep"),
    "canonical_reviews": D.sql("select id, query_id, first_item, items, minimum_depth, reasons from rg", "rg"),
    "calibration_picks": D.sql("select * from c1 union all select * from c2p union all select * from c3p", "c1 c2p c3p"),
    "review_packets": D.sql(
        f"select id, 'p1' as packet_id, nuggets, query_sha256, evidence_sha256, 'review-submission-' || {_ID.format('$$annotator_a$$, id')} as template, 'PENDING' as status from (select q.query_id || ':' || q.item_id as id, (select count(distinct sha256(sentence))::int from nug n where n.query_id = q.query_id) as nuggets, sha256(qs.text) as query_sha256, sha256(d.text) as evidence_sha256 from qr q join qs using (query_id) join documents_ d on d.doc_id = q.item_id)",
        "qr qs documents_ nug",
    ),
    "hidden_leaks": "select doc_id as source, h as hidden_id from (select doc_id, 'v0-' || lpad((doc_id // 2 % 200)::varchar, 3, '0') as h from documents where doc_id % 2 = 0) where substr(h, 4)::int between 97 and 160",
    "blind_submission_checks": D.sql(_blind("lk", "annotator_a"), "lk"),
    "adjudication_checks": D.sql(f"select id, rule from ({_blind('(select * from lk where doc_id % 3 = 0 and k <> 6)', 'adjudicator')}) union all select doc_id::varchar, 'unknown' from lk where (doc_id % 3 <> 0 or k = 6) and k <> 6", "lk"),
}
