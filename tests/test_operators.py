"""Golden values and small brute-force checks of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import cards, chunking, intervals, metrics, pooling, retrieval, statistics
from evidentia.operators import extraction as X
from evidentia.sources import trec


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_metrics_golden(spark):
    qrels = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "c", 0)], "query_id int, item_id string, grade int")
    run = retrieval.top_k(spark.createDataFrame([(1, "a", 2.0), (1, "x", 1.0), (1, "b", 0.5)], "query_id int, item_id string, score double"))
    m = metrics.ranking_metrics(run, qrels).first()
    assert (m["ndcg_10"], m["p_3"], m["recall_3"], m["rr_10"], m["ap"], m["judged_10"], m["bpref"]) == pytest.approx((0.963940, 1 / 3, 1, 1, 1, 2 / 3, 1), abs=1e-6)


def test_ties_go_by_id(spark):
    run = retrieval.top_k(spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "query_id int, item_id string, score double"), 2)
    assert [r[1] for r in rows(run, "rank")] == ["c", "a"]


def test_rrf_and_weights(spark):
    make = lambda ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id int, item_id string, rank int")
    fused = retrieval.top_k(retrieval.rrf([make("ba"), make("ab")]))
    assert [(r[1], r[2]) for r in rows(fused, "rank")] == [("a", pytest.approx(1 / 61 + 1 / 62, abs=1e-8)), ("b", pytest.approx(1 / 61 + 1 / 62, abs=1e-8))]
    assert rows(retrieval.top_k(retrieval.rrf([make("a"), make("b")], [2.0, 1.0])), "rank")[0][1] == "a"


def test_tmm(spark):
    s = spark.createDataFrame([(1, "a", 3.0), (1, "b", 0.0)], "query_id int, item_id string, score double")
    d = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.9)], "query_id int, item_id string, score double")
    assert [r[1] for r in rows(retrieval.top_k(retrieval.tmm(s, d, 0.8)), "rank")] == ["b", "a"]


def test_best_partition():
    assert chunking.best_partition([380, 100]) == [2]
    assert chunking.best_partition([380, 80, 450]) == [2, 3]
    rnd = random.Random(3)
    for _ in range(60):
        sizes = [rnd.randint(20, 512) for _ in range(rnd.randint(1, 7))]
        options = []
        for k in range(len(sizes)):
            for cuts in itertools.combinations(range(1, len(sizes)), k):
                ends = (*cuts, len(sizes))
                totals = [sum(sizes[a:b]) for a, b in zip((0, *cuts), ends, strict=True)]
                if max(totals) <= 512:
                    options.append((sum(t < 128 for t in totals), sum(abs(t - 384) for t in totals), len(totals), ends))
        assert tuple(chunking.best_partition(sizes)) == min(options)[3]


def test_packing_and_integrity(spark):
    rnd = random.Random(5)
    units = [(d, o, o // 8, o // 32, rnd.choice([3, 50, 200, 380, 500, 700, 1300])) for d in range(6) for o in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(units, "doc_id long, ordinal int, section int, parent int, n_tokens int")
    packed = chunking.packed(df)
    for fragments in (packed, chunking.fixed(df)):
        assert set(chunking.integrity(fragments, df).first()) == {0}
    expected = []
    for d in range(6):
        number = -1
        for _, group in itertools.groupby([u for u in units if u[0] == d], key=lambda u: u[2]):
            pending, held = 0, 0
            for _, o, _, _, n in group:
                if n > 512:
                    starts = [0]
                    while starts[-1] + 512 < n:
                        starts.append(starts[-1] + 448)
                    for s in starts:
                        number += 1
                        expected.append((d, number, o, s, min(s + 512, n)))
                    pending, held = 0, 0
                    continue
                if not held or pending >= 384 or pending + n > 512:
                    number, pending, held = number + 1, 0, 0
                pending, held = pending + n, held + 1
                expected.append((d, number, o, 0, n))
    assert rows(packed.select("doc_id", "chunk", "ordinal", "unit_start", "unit_stop")) == sorted(expected)


def card_twin(ranked, stops, most=4, budget=2048):
    """Cards by intervals: ranked (rank, doc, chunk, [(unit, start, stop)])."""
    seen, exact, used, out = {}, [], 0, []
    for rank, doc, chunk, fragments in ranked:
        cover = {}
        for u, a, b in fragments:
            cover.setdefault(u, set()).update(range(a, b))
        size = sum(map(len, cover.values()))
        shared = sum(len(c & seen.get((doc, u), set())) for u, c in cover.items())
        if size and shared / size > 0.8:
            continue
        left, taken, cut = budget - used, [], None
        for u, a, b in [f for f in fragments if (doc, *f) not in exact]:
            if b - a <= left:
                taken.append((u, a, b))
                left -= b - a
                continue
            ends = [e for e in stops[doc, u] if a < e <= min(a + left, b)]
            if taken:
                cut = "unit"
            elif ends:
                taken, cut = [(u, a, ends[-1])], "sentence"
            break
        if taken:
            n = sum(b - a for _, a, b in taken)
            used += n
            out.append((rank, doc, chunk, len(taken), n, used, shared, size, cut, taken))
            for u, a, b in taken:
                seen.setdefault((doc, u), set()).update(range(a, b))
                exact.append((doc, u, a, b))
        if cut or len(out) == most:
            break
    return out


def test_cards_match_a_plain_version(spark):
    rnd = random.Random(31)
    kinds = set()
    for _ in range(400):
        stops = {(d, u): sorted(rnd.sample(range(1, 60), rnd.randint(0, 4))) for d in range(2) for u in range(12)}
        ranked = []
        for rank in range(1, rnd.randint(2, 9)):
            d, first = rnd.randrange(2), rnd.randrange(10)
            fragments = [(u, a := rnd.choice([0, 0, 10]), a + rnd.randint(1, 50)) for u in range(first, min(12, first + rnd.randint(1, 4)))]
            ranked.append((rank, d, rank, fragments))
        if ranked and rnd.random() < 0.5:
            ranked.append((len(ranked) + 1, *ranked[0][1:]))
        made = cards.cards_of([(r, d, c, [cards.Fragment(d, u, a, b, tuple(stops[d, u])) for u, a, b in f]) for r, d, c, f in ranked], budget=(budget := rnd.choice([5, 40, 90, 400])))
        assert made == card_twin(ranked, stops, budget=budget)
        kinds |= {m[8] for m in made}
    assert kinds == {None, "unit", "sentence"}
    ranking = spark.createDataFrame([(7, r, d, c) for r, d, c, _ in ranked], "query_id long, rank int, doc_id long, chunk int")
    fragments = spark.createDataFrame([(d, c, u, a, b, stops[d, u]) for _, d, c, f in {x[2]: x for x in ranked}.values() for u, a, b in f], "doc_id long, chunk int, ordinal int, unit_start int, unit_stop int, stops array<int>")
    got = cards.assemble(ranking, fragments, budget=budget).orderBy("rank").collect()
    assert [(*tuple(r)[1:10], [tuple(f) for f in r["fragments"]]) for r in got] == made
    total = cards.diagnostics(cards.assemble(ranking, fragments, budget=budget)).first()
    assert (total["cards"], total["tokens"], total["overlap"], total["raw"]) == (len(made), made[-1][5], sum(m[6] for m in made), sum(m[7] for m in made))


def test_sentence_stops(spark):
    got = spark.createDataFrame([("One two. three four! five\nsix seven",), ("no stop here",), ("v1.5 is. x",)], "text string").select(cards.sentence_stops("text").alias("s")).collect()
    assert [r["s"] for r in got] == [[2, 4, 5, 7], [3], [2]]


def test_expansion(spark):
    # sections 0..5 of one chunk each under parents 0 and 3, a chunk in two sections, a document of its own, a chunk without a parent
    chunks = spark.createDataFrame([(1, i, i // 3 * 3, i) for i in range(6)] + [(2, 0, 0, 0), (2, 1, None, 1)], "doc_id long, chunk int, parent int, first_ordinal int")
    owned = spark.createDataFrame([(1, i, i) for i in range(6)] + [(1, 5, 3), (2, 0, 0), (2, 1, 0)], "doc_id long, chunk int, section int")
    pairs = {m: {(r["doc_id"], r["chunk"], r["supplement"], r["distance"]) for r in chunking.expand(chunks, owned, m).collect()} for m in ("leaf", "neighbor", "parent", "parent_neighbor")}
    near = {(1, a, b, 1) for a in range(6) for b in (a - 1, a + 1) if 0 <= b < 6 and a // 3 == b // 3}
    above = {(1, a, b, abs(a - b)) for a in range(6) for b in ((0,) if a < 3 else (3, 5)) if a != b} | {(2, 0, 1, 1)}
    assert pairs["leaf"] == set() and pairs["neighbor"] == near and pairs["parent"] == above and pairs["parent_neighbor"] == near | above
    asked = spark.createDataFrame([(1, 4)], "doc_id long, chunk int")
    assert {tuple(r) for r in chunking.expand(chunks, owned, "parent", asked).collect()} == {x for x in above if x[:2] == (1, 4)}
    fragments = spark.createDataFrame([(1, i, i // 2, 0, 5) for i in range(6)], "doc_id long, chunk int, ordinal int, unit_start int, unit_stop int")
    got = chunking.expanded_fragments(fragments, chunking.expand(chunks, owned, "neighbor")).where("chunk = 1").orderBy("place").collect()
    assert [(r["place"], r["ordinal"]) for r in got] == [(0, 0), (1, 1)]


def test_expansion_of_a_parent_with_many_chunks(spark):
    chunks = spark.range(500).selectExpr("1L as doc_id", "cast(id as int) as chunk", "0 as parent", "cast(id as int) as first_ordinal")
    owned = chunks.selectExpr("doc_id", "chunk", "0 as section")
    got = chunking.expand(chunks, owned, "parent")
    assert got.count() == got.distinct().count() == 500 * 499 and got.where("distance <> abs(chunk - supplement)").count() == 0


def test_overlap_join_equals_all_pairs(spark):
    rnd = random.Random(5)
    make = lambda n, key: [(rnd.choice(key), i, (a := rnd.randint(-20, 400)), rnd.choice([a, a + 1, a + rnd.randint(-3, 9), a + rnd.randint(0, 150)])) for i in range(n)]
    left, right = make(150, ["a", "b", None]) + [("a", 900, None, 3)], make(120, ["a", "a", "b"]) + [("hot", i, i % 7, 9) for i in range(200)]
    left += [("hot", i, 3, 9) for i in range(1000, 1040)]
    want = {(k, i, j) for k, i, a, b in left for m, j, c, d in right if k == m and a is not None and a < d and c < b}
    schema = "unit string, id int, start int, stop int"
    for width in (None, 1, 37, 10_000):
        pairs = intervals.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["unit"], width)
        got = [(r["unit"], r["left"]["id"], r["right"]["id"]) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_of_vectors_equal_all_pairs(spark, monkeypatch):
    rnd = random.Random(6)
    for name, value in (("ITEM_BLOCK", 7), ("QUERY_BLOCK", 3)):
        monkeypatch.setattr(retrieval, name, value)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(4)] if i % 9 else [1.0, 1.0, 0.0, 0.0]) for i in range(60)]
    items, queries = spark.createDataFrame(rows, "item_id long, vector array<float>"), spark.createDataFrame(rows[:20], "query_id long, vector array<float>")
    full = {(q, i): sum(a * b for a, b in zip(u, v, strict=True)) for q, u in rows[:20] for i, v in rows if i != q}
    assert {(r["query_id"], r["item_id"]): r["score"] for r in retrieval.dense_scores(items, queries).collect()} == full
    best = retrieval.top_k(retrieval.dense_scores(items, queries, 5), 5)
    want = {(q, i, n) for q, _ in rows[:20] for n, (i, _) in enumerate(sorted(((i, s) for (p, i), s in full.items() if p == q), key=lambda x: (-x[1], x[0]))[:5], 1)}
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in best.collect()} == want
    assert retrieval.dense_scores(items, queries, 5).count() < 20 * 9 * 6
    named = retrieval.dense_scores(items.selectExpr("struct(item_id, 1 as k) as item_id", "vector"), queries.selectExpr("struct(query_id as item_id, 1 as k) as query_id", "vector"), 5)
    assert retrieval.top_k(named, 5).count() == 100


def test_blocks_of_items_equal_all_pairs(spark, monkeypatch):
    """Tasks give their best items alone, ties and owners included; repeated items take the way of rows."""
    rnd = random.Random(8)
    monkeypatch.setattr(retrieval, "BLOCK_SCORES", 60)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 2, 3, 30])))) for i in range(200)] + [(None, "w1 w2"), (900, None)]
    items = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(rnd.sample([*words, "nowhere"], 4))) for q in range(6)] + [(7, "unknown")], "query_id long, text string")
    m = retrieval.matches(items, queries)
    plain = lambda df: sorted(map(tuple, df.select("query_id", "item_id", "score", "rank").collect()), key=repr)
    for kind, every in (("bm25", retrieval.bm25_of(m)), ("overlap", retrieval.overlap_of(m))):
        best = retrieval.best_of(m, 5, kind)
        assert plain(retrieval.top_k(best, 5)) == plain(retrieval.top_k(every, 5))
        assert best.count() <= 6 * 5 * m.rows.rdd.getNumPartitions() < every.count()
        owner = F.col("item_id") % 7
        owners = every.groupBy("query_id", owner.alias("item_id")).agg(F.max("score").alias("score"))
        assert plain(retrieval.top_k(retrieval.best_of(m, 3, kind, owner), 3)) == plain(retrieval.top_k(owners, 3))
    some = retrieval.top_k(retrieval.best_of(m, 4), 4).select("query_id", "item_id").where("item_id is not null")
    wanted = retrieval.bm25_of(m).join(some, ["query_id", "item_id"], "left_semi")
    assert sorted(map(tuple, retrieval.bm25_of(m, some).collect())) == sorted(map(tuple, wanted.select("query_id", "item_id", "score").collect()))
    twice = retrieval.matches(items.union(items.limit(3)), queries)
    assert twice.rows is None and plain(retrieval.top_k(retrieval.best_of(twice, 5), 5)) == plain(retrieval.top_k(retrieval.bm25_of(twice), 5))


def test_a_task_gives_its_best_vectors_alone(spark, monkeypatch):
    """What leaves a task does not grow with the blocks of items that it sees."""
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 10)
    rnd = random.Random(9)
    rows = [(i, [rnd.random(), rnd.random()]) for i in range(2000)]
    items, queries = spark.createDataFrame(rows, "item_id long, vector array<float>"), spark.createDataFrame(rows[:10], "query_id long, vector array<float>")
    assert retrieval.dense_scores(items, queries, 5).count() <= 10 * 5 * 4 * spark.sparkContext.defaultParallelism


def test_segments_are_cut_in_batches(spark):
    """Components merged as best_partition() says, segment by segment; no segment is a call of its own."""
    rnd = random.Random(10)
    rows = [(d, c, c // 9, 3 * c - (c % 4 == 3), 3 * c + 2, rnd.randint(1, 512)) for d in range(40) for c in range(rnd.choice([1, 5, 30]))]
    got = chunking.merged(spark.createDataFrame(rows, "doc_id long, chunk int, parent int, first_ordinal int, last_ordinal int, n_tokens int"))
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    want, place = [], {}
    for (d, parent, _), segment in itertools.groupby(((r, n) for r, n in zip(rows, itertools.accumulate(int(i == 0 or rows[i - 1][0] != r[0] or rows[i - 1][2] != r[2] or rows[i - 1][4] == r[3]) for i, r in enumerate(rows)), strict=True)), lambda x: (x[0][0], x[0][2], x[1])):
        held, start = [r for r, _ in segment], 0
        for end in chunking.best_partition([r[5] for r in held]):
            place[d] = place.get(d, -1) + 1
            want += [(d, place[d], parent, r[1], r[5]) for r in held[start:end]]
            start = end
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_draws_are_hashes(spark):
    import hashlib

    got = statistics.draws("b", 3, 2, 4)
    assert got.tolist() == [[int(hashlib.md5(f"b:{r}:{k}".encode()).hexdigest()[:13], 16) for k in range(4)] for r in (3, 4)]
    deltas = spark.createDataFrame([(f"g{i % 7}", (i % 5 - 2) / 10) for i in range(60)], "group string, delta double")
    few, many = (statistics.resample(deltas, n).first() for n in (100, 3000))
    assert few["mean"] == many["mean"] and few["low"] <= few["mean"] <= few["high"] and 0 < many["p"] <= 1
    assert statistics.resample(deltas.limit(0), 50).first()["mean"] is None


def test_integrity_finds_faults(spark):
    units = spark.createDataFrame([(1, o, 0, 0, 10) for o in range(3)], "doc_id long, ordinal int, section int, parent int, n_tokens int")
    schema = "doc_id long, chunk int, ordinal int, section int, parent int, unit_start int, unit_stop int, chunk_start int"
    check = lambda rows: {k: v for k, v in chunking.integrity(spark.createDataFrame(rows, schema), units).first().asDict().items() if v}
    good = [(1, 0, o, 0, 0, 0, 10, 10 * o) for o in range(3)]
    assert check(good) == {}
    assert check(good[:2]) == {"uncovered_units": 1}
    assert check([*good[:2], (1, 0, 2, 0, 0, 0, 9, 20)]) == {"uncovered_tokens": 1}
    assert check([*good[:2], (1, 2, 2, 0, 0, 0, 10, 0)]) == {"chunk_number_gaps": 1}
    assert check([*good[:2], (1, 0, 2, 0, 0, 0, 10, 21)]) == {"chunk_token_gaps": 1}
    assert check([*good, (1, 1, 9, 0, 0, 0, 10, 0)]) == {"unknown_units": 1}
    sections = chunking.sections(units)
    assert chunking.section_windows_ok(sections).first()[0] == 0
    assert chunking.section_windows_ok(sections.withColumn("windows", F.array(F.struct(F.lit(0).alias("start"), F.lit(29).alias("stop"))))).first()[0] == 1


def test_chunk_records(spark):
    units = spark.createDataFrame([(1, 0, "Head one", 2, "Head one", True), (1, 1, "alpha beta  gamma", 3, "Head one", False), (1, 2, "delta", 1, None, False)], "doc_id long, ordinal int, text string, n_tokens int, heading string, is_heading boolean")
    fragments = spark.createDataFrame([(1, 0, 0, 0, 2), (1, 0, 1, 0, 3), (1, 0, 1, 0, 3), (1, 1, 1, 1, 3), (1, 1, 2, 0, 1)], "doc_id long, chunk int, ordinal int, unit_start int, unit_stop int")
    a, b = chunking.chunk_records(fragments, units, "p").orderBy("chunk").collect()
    assert (a["title"], a["text"], a["body"], a["n_tokens"]) == ("Head one", "Head one\nalpha beta  gamma", "alpha beta  gamma", 5)
    assert a["lexical"] == "Head one\nHead one Head one\nHead one alpha beta gamma"
    assert (b["lexical"], b["body"]) == ("Head one\nHead one beta gamma\ndelta", "beta gamma\ndelta") and a["id"] != b["id"]


def test_statistics(spark):
    h = statistics.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double"))
    assert {r["name"]: r["adjusted"] for r in h.collect()} == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})
    t = statistics.kendall_tau(spark.createDataFrame([("x", 1, 1), ("y", 2, 2), ("z", 3, 3)], "name string, a int, b int"))
    assert t.first()["tau"] == 1
    a = metrics.auroc_ap(spark.createDataFrame([(1, 1, 1.0), (2, 0, 1.0)], "id int, label int, score double")).first()
    assert (a["auroc"], a["ap"]) == (0.5, 0.5)
    groups = [(f"g{i:02}", (i * 7 + j) % 2) for i in range(10) for j in range(2)]
    folds = rows(statistics.group_folds(spark.createDataFrame(groups, "group string, label int")))
    assert sorted({f for _, f in folds}) == [0, 1, 2, 3, 4] and len(folds) == 10


def test_pool_stability(spark):
    make = lambda taus: spark.createDataFrame([(20, 0.02, 1.0), (30, 0.009, 1.0), (40, 0.008, taus)], "depth int, yield double, tau double")
    assert pooling.is_stable(make(1.0)).first()[0] is True
    assert pooling.is_stable(make(0.94)).first()[0] is False


def test_projection_counts_whole_fragments_only(spark):
    fragments = spark.createDataFrame([("c1", "s", True), ("c2", "s", False)], "chunk_id string, span_id string, is_full boolean")
    judgments = spark.createDataFrame([(1, "s", True, ["n"])], "query_id int, span_id string, topical boolean, hits array<string>")
    nuggets = spark.createDataFrame([(1, "n")], "query_id int, nugget_id string")
    assert rows(pooling.project(fragments, judgments, nuggets)) == [(1, "c1", 3, 0), (1, "c2", 1, 1)]


def test_siblings_and_lines(spark):
    h = spark.createDataFrame([(1, "p", 1, "left"), (1, "p", 2, "middle"), (1, "p", 3, "right")], "doc_id int, parent string, ordinal int, heading_id string")
    assert {r["heading_id"]: (r["before"], r["after"]) for r in X.sibling_headings(h).collect()}["middle"] == ("left", "right")
    docs = spark.createDataFrame([(1, "a\nb x\nc\nb x")], "doc_id int, text string")
    got = X.locate_lines(docs, spark.createDataFrame([(1, "b x", 1), (1, "b x", 4)], "doc_id int, quote string, hint int"))
    assert sorted(r["line"] for r in got.collect()) == [2, 4]


def test_trec_files(spark, tmp_path):
    run = spark.createDataFrame([("q1", "b", 1, 2.5), ("q1", "a", 2, 1.0)], "query_id string, item_id string, rank int, score double")
    trec.write_run(run, str(tmp_path / "run"), "t")
    assert [r[:4] for r in rows(trec.read_run(spark, str(tmp_path / "run")), "rank")] == [("q1", "b", 1, 2.5), ("q1", "a", 2, 1.0)]
    trec.write_run(run.withColumn("rank", F.col("rank") + 1), str(tmp_path / "bad"), "t")
    with pytest.raises(Exception, match="not a run"):
        trec.read_run(spark, str(tmp_path / "bad")).collect()


def test_hard_negatives_one_of_each_class_then_by_id(spark):
    candidates = [(1, 10, 0, 5, ["lexical_candidate"]), (1, 11, 1, 9, ["lexical_candidate", "semantic_candidate"]), (1, 12, 0, 1, ["semantic_candidate"]), (1, 9, 0, 40, ["semantic_candidate"]), (1, 13, 3, 1, ["lexical_candidate"]), (1, 14, 0, 1, ["other"])]
    df = spark.createDataFrame([(*c, None) for c in candidates], "query_id long, item_id long, grade int, minimum_rank int, provenance array<string>, no_answer_reason string")
    # lexical_collision takes 11 (grade 1), semantic_nearest then 12 (rank 1), and 9 is the smallest id left
    assert rows(pooling.hard_negatives(df), "item_id") == [(1, 9, "semantic_nearest"), (1, 11, "lexical_collision"), (1, 12, "semantic_nearest")]
    asked = df.withColumn("no_answer_reason", F.lit("wrong_version"))
    assert {r["negative_class"] for r in pooling.hard_negatives(asked).collect()} == {"wrong_version"}


def test_group_folds_greedy(spark):
    rnd = random.Random(19)
    data = [(f"g{rnd.randrange(14):02}", rnd.randrange(2)) for _ in range(90)]
    groups = {}
    for g, y in data:
        groups.setdefault(g, [0, 0])[y] += 1
    held, want = [[0, 0] for _ in range(5)], {}
    for g in sorted(groups, key=lambda g: (-sum(groups[g]), g)):
        major = 1 if groups[g][1] >= groups[g][0] else 0
        f = min(range(5), key=lambda i: (held[i][major], sum(held[i]), i))
        want[g] = f
        held[f] = [held[f][0] + groups[g][0], held[f][1] + groups[g][1]]
    assert dict(rows(statistics.group_folds(spark.createDataFrame(data, "group string, label int")))) == want


def test_page_units_hold_the_text_of_inline_tags(spark):
    html = '<ul><li><a href="/x">x</a></li><li>a <i>b</i> c</li></ul><p><b>y.<br>z<p>one<!-- ad --> two 1 < 2 &amp;lt;</p><PRE><code>q</code></PRE><p></p>'
    rows = sorted(X.units_from_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).select("ordinal", "node_type", "text").collect())
    assert [tuple(r)[1:] for r in rows] == [("list_item", "x"), ("list_item", "a b c"), ("paragraph", "y. z"), ("paragraph", "one two 1 < 2 &lt;"), ("code", "q")]


def test_only_whole_references_are_decoded():
    """A title cut off inside a reference keeps what is left of it, as the SQL of units_from_pages does."""
    from evidentia.functions.html import walk

    units, links = walk('<title>a &amp; b&amp</title><h1>c&am</h1><p>d &lt e &copy;&copyx; &#65;&#66 &nope; &amp;lt; &</p><a href="?a=1&copy=2&amp;d">l</a>')
    assert [u[2] for u in units] == ["a & b&amp", "c&am", "d &lt e \u00a9&copyx; A&#66 &nope; &lt; &", "l"]
    assert links == [("l", "?a=1&copy=2&d")]


PAGE = """<!doctype html><title>T &amp; x</title><body id=top>bare <b>bold</b><div id=s1><h2 id=h>Head</h2>text in div<p>para <a class=x href="/a?b&amp;c"><i>link</i> one</a></div>
<table><caption>Cap</caption><tr><th>A<th>B<tr><td><p>1</p><p>2</p></td><td>3 <img src=x alt="an image"></td></tr></table>
<ul><li>one<ul><li>inner a<li>inner b</ul> after<li><p>two</p><pre>code
 here</pre></ul><dl><dt>term<dd>def <p>more</dl><blockquote><p>q1<p>q2</blockquote>
<div class="admonition warning"><p>Warning</p><p>Mind &#8364; &eacute;</p></div><div role=tablist><span role=tab id=t1>First tab</span></div><div role=tabpanel aria-labelledby=t1><p>in tab</div>
<script>var x="<p>no</p>"</script>tail<br>end 1 < 2"""


def test_page_units_of_nested_tags(spark):
    page = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p")], "page_id long, html string")
    got = [tuple(r) for r in X.units_from_pages(page).orderBy("page_id", "ordinal").select("node_type", "text", "anchors", "tab").collect()]
    want = [("title", "T & x"), ("paragraph", "bare bold", ["top"]), ("heading", "Head", ["s1", "h"]), ("paragraph", "text in div"), ("paragraph", "para link one"), ("caption", "Cap")]
    want += [("table_row", "A | B"), ("table_row", "1 2 | 3"), ("image_alt", "an image"), ("list_item", "one after"), ("list_item", "inner a"), ("list_item", "inner b"), ("list_item", "two"), ("code", "code here")]
    want += [("term", "term"), ("definition", "def more"), ("quote", "q1 q2"), ("admonition:warning", "Warning Mind € é"), ("paragraph", "First tab", ["t1"]), ("paragraph", "in tab", [], "First tab"), ("paragraph", "tail end 1 < 2"), ("paragraph", "<p")]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [(g[2], g[3]) for g in got] == [((*w, [], None)[2:4] if len(w) == 2 else (w[2], w[3] if len(w) > 3 else None)) for w in want]
    assert [tuple(r) for r in X.cross_references(page).collect()] == [(1, 0, "link one", "/a?b&c")]


def test_page_text_is_in_one_unit_each():
    """The units' characters are the page's, as a parser that knows no units reads them, whatever is nested or left open."""
    from collections import Counter
    from html.parser import HTMLParser

    from evidentia.functions.html import walk

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.text, self.silent = [], False

        def handle_starttag(self, tag, attrs):
            self.silent = self.silent or tag in ("script", "style")
            self.text += [v for k, v in attrs if tag == "img" and k == "alt" and v]

        def handle_endtag(self, tag):
            self.silent = self.silent and tag not in ("script", "style")

        def handle_data(self, data):
            self.text += [] if self.silent else [data]

    rnd = random.Random(9)
    tags = "p div li ul ol table tr td th dl dt dd blockquote pre h1 h3 section a b i span figure figcaption caption".split()
    for _ in range(1500):
        parts, n = [], 0
        for _ in range(rnd.randint(1, 40)):
            roll = rnd.random()
            tag = rnd.choice(tags)
            if roll < 0.4:
                parts.append(f"<{tag}{rnd.choice(['', ' class=note', ' id=x', ' role=tabpanel aria-labelledby=x'])}>")
            elif roll < 0.6:
                parts.append(f"</{tag}>")
            elif roll < 0.65:
                parts.append(rnd.choice(["<br>", "<img alt=pic>", "<script>no</script>", "<!-- no -->", "&amp;", "<style>no</style>", "<hr>"]))
            else:
                n += 1
                parts.append(f" w{n} ")
        plain = Plain()
        plain.feed("".join(parts))
        plain.close()
        letters = lambda text: Counter("".join(text.split()))
        units = "".join(u[2].replace(" | ", " ") for u in walk("".join(parts))[0])
        assert letters(units) == letters("".join(plain.text)), "".join(parts)


def test_sections_of_nested_headings(spark):
    html = "<p>o</p><h1>A</h1><p>a</p><h3>B</h3><p>b</p><h2>C</h2><p>c</p><h1>D</h1><p>d</p>"
    rows = {r["text"]: r for r in X.units_from_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert {k: rows[k]["heading_path"] for k in "oabcd"} == {"o": None, "a": "A", "b": "A > B", "c": "A > C", "d": "D"}
    assert rows["b"]["parent_id"] == rows["a"]["section_id"] == rows["c"]["parent_id"] and rows["d"]["parent_id"] == rows["o"]["section_id"]


def test_lines_references_and_ranges(spark):
    docs = spark.createDataFrame([(1, "\ufeffa\r\n  b x \rc\n b x"), (2, "q\\Er\nq")], "doc_id int, text string")
    quotes = [(1, "b x", 4), (1, "b x \nc", 1), (1, "  b x\nc ", 9), (1, "none", 1), (1, "", 1), (2, "q\\Er", 2), (2, "q", 2)]
    got = X.locate_lines(docs, spark.createDataFrame(quotes, "doc_id int, quote string, hint int"))
    assert {(r["doc_id"], r["quote"]): r["line"] for r in got.collect()} == {(1, "b x"): 4, (1, "b x \nc"): 2, (1, "  b x\nc "): 2, (2, "q\\Er"): 1, (2, "q"): 2}
    refs = X.source_refs(docs, spark.createDataFrame([(1, 2, 9, "direct"), (1, 5, 6, "direct"), (1, 0, 1, "direct")], "doc_id int, start_line int, end_line int, origin string")).collect()
    assert [(r["start_line"], r["end_line"], r["start_column"], r["end_column"]) for r in refs] == [(2, 4, 3, 5)]
    ranges = spark.createDataFrame([(1, 1, 2, "a"), (1, 3, 3, "a"), (1, 2, 2, "a"), (1, 6, 7, "a"), (1, 3, 4, "b")], "doc_id int, start_line int, end_line int, origin string")
    assert rows_of(X.merge_line_ranges(ranges)) == [(1, "a", 1, 3), (1, "a", 6, 7), (1, "b", 3, 4)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_index_saves_loads_and_finds_damage(spark, tmp_path):
    from evidentia.operators import index

    items = spark.createDataFrame([(1, "red apple apple"), (2, "green apple tree"), (3, ""), (4, None)], "item_id long, text string")
    queries = spark.createDataFrame([(7, "the apple"), (8, "tree nothing"), (9, "")], "query_id long, text string")
    path = str(tmp_path / "index")
    index.save(items, path)
    got = retrieval.bm25_of(index.matches(index.load(spark, path), queries))
    assert rows(got) == rows(retrieval.bm25_scores(items, queries)) and got.count() == 3
    spark.read.parquet(f"{path}/lengths").limit(2).write.parquet(f"{path}/other")
    spark.read.parquet(f"{path}/other").write.mode("overwrite").parquet(f"{path}/lengths")
    with pytest.raises(ValueError, match="lengths"):
        index.load(spark, path)


def test_fixed_coverage_and_gates(spark):
    rnd = random.Random(41)
    data = [(i, i % 6, i % 6 % 5, int(rnd.random() < 0.6), rnd.random()) for i in range(30)]
    df = spark.createDataFrame(data, "id long, group int, fold int, label int, x double")
    got = statistics.answerability_oof(df, ["x"], 0.75, 20).first()
    z = {}
    for i, _, f, _, x in data:
        other = [r[4] for r in data if r[2] != f]
        mean = sum(other) / len(other)
        z[i] = round((x - mean) / (sum((o - mean) ** 2 for o in other) / len(other)) ** 0.5, 6)
    best = sorted(data, key=lambda r: (-z[r[0]], r[0]))[:22]  # 22.5, half to even
    assert got["fixed_errors"] == sum(1 - r[3] for r in best) and 0 <= got["low"] <= got["high"] <= 1
    m = spark.createDataFrame([("a", 0.1, -0.3), ("b", -0.2, 0.4)], "candidate string, gain double, loss double")
    assert rows(statistics.backend_gate(m, {"loss": -0.1})) == [("a", False, False), ("b", True, True)]


def test_a_task_takes_each_block_of_queries_once(spark, monkeypatch):
    """With many blocks of queries a task gives its best of each query once for a group of item blocks, and a query block without queries gives nothing."""
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 10)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rnd = random.Random(10)
    rows = [(i, [rnd.random(), rnd.random()]) for i in range(2000)]
    items, queries = spark.createDataFrame(rows, "item_id long, vector array<float>"), spark.createDataFrame(rows[:40], "query_id long, vector array<float>")
    found, groups = retrieval.dense_scores(items, queries, 5), max(1, 4 * spark.sparkContext.defaultParallelism // 20)
    assert found.count() <= 40 * 5 * groups
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # a block of queries does not go with every block of items
    want = {(q, i) for q, u in rows[:40] for i, _ in sorted(((i, float(np.float32(u[0])) * float(np.float32(v[0])) + float(np.float32(u[1])) * float(np.float32(v[1]))) for i, v in rows if i != q), key=lambda x: (-math.floor(x[1] * 1e6 + 0.5), x[0]))[:5]}
    assert {(r["query_id"], r["item_id"]) for r in retrieval.top_k(found, 5).collect()} == want
    assert retrieval.dense_scores(items, queries.limit(0), 5).count() == 0 == retrieval.dense_scores(items.limit(0), queries, 5).count()
    empty = spark.createDataFrame([(i, None if i % 2 else []) for i in range(4)], "item_id long, vector array<double>")
    assert {r["score"] for r in retrieval.dense_scores(empty, queries.limit(1)).collect()} == {0.0}


def test_an_index_gives_each_task_its_best_items(spark, tmp_path):
    """Postings of the queries' terms meet by item, and no pair of a query and an item is a row; items that repeat take the way of rows."""
    from evidentia.operators import index

    rnd = random.Random(12)
    data = [(i, " ".join(rnd.choice(["apple", "pear", "tree", "red"]) for _ in range(rnd.choice([0, 1, 3, 9])))) for i in range(50)]
    items = spark.createDataFrame(data, "item_id long, text string")
    queries = spark.createDataFrame([(7, "the red apple"), (8, "tree nothing"), (9, "")], "query_id long, text string")
    for name, some in (("once", items), ("twice", items.union(items.limit(9)))):
        index.save(some, path := str(tmp_path / name))
        m = index.matches(index.load(spark, path), queries)
        assert (m.rows is None) == (name == "twice")
        best = retrieval.top_k(retrieval.best_of(m, 5), 5)
        assert best.count() == 10 and rows(best) == rows(retrieval.top_k(retrieval.bm25_scores(some, queries), 5))
    assert retrieval.best_of(index.matches(index.load(spark, path), queries.where("query_id = 9")), 5).count() == 0
