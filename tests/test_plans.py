"""Queries against their SQL on the smallest tables, and the driver's contract."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["units_from_documents", "units_from_pages", "cross_references", "family_histogram", "normalized_text", "windows_c0", "sections_c1", "c1_scoring_windows", "packed_c2", "unit_token_counts", "dense_top10", "bm25_top10", "query_decomposition", "weighted_kappa", "balanced_threshold", "kendall_tau", "canonical_dedupe", "round_robin_sample", "canonical_json", "latency_percentiles", "stage_overhead", "adjudication_diff", "quote_lines", "include_sites"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(rows):
    return sorted((tuple(None if x is None else float(x) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, duck, name):
    from evidentia.plans import catalog

    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    assert plain(map(tuple, df.select(columns).collect())) == plain(relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_oracle_has_a_query():
    from evidentia.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_without_the_training_data_package(tmp_path):
    """The rest of the repository imports and lists its queries when that subpackage is gone."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_top10' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_dense_search_takes_every_twentieth_row_against_all(spark):
    from evidentia.plans import _data as D

    e = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    wanted = {r["vec_id"] for r in e if r["vec_id"] % 20 == 0}
    label = {r["vec_id"]: r["label"] for r in e}
    assert {r["query_id"] for r in D.dense(spark, DATA, 1).collect()} == wanted and len(wanted) > 20
    grades = {(r["query_id"], r["item_id"]): r["grade"] for r in D.label_qrels(spark, DATA).collect()}
    assert grades == {(q, i): (3 - i % 2 if label[i] == label[q] else 0) for q in wanted for i in label if i != q}


def test_label_judgments_are_counted_without_pairs(spark, tmp_path):
    """Numbers of judged items by grade, and grades of a run's items, equal those of all pairs; labels may be null. No pair is a row."""
    from evidentia.plans import _data as D
    from evidentia.plans import evaluation

    spark.createDataFrame([(i, [float(i % 5), float(i % 3)], None if i % 7 == 0 else i % 4) for i in range(100)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = D.label_qrels(spark, str(tmp_path))
    assert sorted(map(tuple, D.label_counts(spark, str(tmp_path)).collect())) == sorted(map(tuple, pairs.groupBy("query_id", "grade").count().collect()))
    run = D.dense(spark, str(tmp_path), 10)
    assert sorted(map(tuple, D.label_graded(spark, str(tmp_path), run).select("query_id", "item_id", "grade").collect())) == sorted(map(tuple, pairs.join(run, ["query_id", "item_id"], "left_semi").select("query_id", "item_id", "grade").collect()))
    for plan in (evaluation.ir_metrics(spark, str(tmp_path)), evaluation.hard_negative_exposure(spark, str(tmp_path))):
        assert "NestedLoop" not in plan._jdf.queryExecution().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_evidence_cards_reach_later_chunks(spark, tmp_path):
    """A term that stands only after a document's first section gets a card of the chunk that holds it."""
    from evidentia.plans import _data as D
    from evidentia.plans import judging

    term = D.queries(spark, DATA).orderBy("query_id").first()
    lines = [f"filler number {i} of plain words" for i in range(40)]
    lines[30] = term["text"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "other words here")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    cards = judging.evidence_cards(spark, str(tmp_path)).where(F.col("query_id") == term["query_id"]).collect()
    assert min(cards, key=lambda r: r["rank"])["chunk"] > 0


def test_include_sites_of_all_documents(spark, tmp_path):
    from evidentia.plans import checks

    spark.createDataFrame([(1, "a\n.. include:: x.rst\nb"), (5, "c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, checks.include_sites(spark, str(tmp_path)).collect())) == [(1, 2, "x.rst"), (5, 2, "my part/5.rst")]


def test_determinism_check_uses_all_cores(spark, monkeypatch):
    """Both runs deal documents into more partitions than there are cores, into different ones."""
    from evidentia.plans import catalog
    from evidentia.plans.judging import R

    parts, matches = [], R.matches
    monkeypatch.setattr(R, "matches", lambda items, queries: parts.append(items.rdd.getNumPartitions()) or matches(items, queries))
    assert {r["different"] for r in catalog.queries()["determinism_check"](spark, DATA).collect()} == {1}
    assert len(set(parts)) == 2 and min(parts) > spark.sparkContext.defaultParallelism
