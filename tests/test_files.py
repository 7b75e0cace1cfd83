"""Files, bundles, gates, load and extension points."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia import protocols
from evidentia.operators import load, retrieval
from evidentia.operators import validation as V
from evidentia.sources import files, tables, trec


def test_write_paths():
    roots = ["/data/out", "s3a://b/runs"]
    assert files.require_write_path("/data/out/a//b", roots) == "/data/out/a/b"
    assert files.require_write_path("s3a://b/runs/x", roots) == "s3a://b/runs/x"
    for bad in ("/data/other", "/data/out2/x", "/data/out/../x", "s3a://b/runs2", "/etc"):
        with pytest.raises(files.PathBoundaryError):
            files.require_write_path(bad, roots)
    with pytest.raises(files.PathBoundaryError):
        files.require_write_path("/data/out/source/x", roots, ["/data/out/source"])


def test_documents_and_snapshots(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.rst").write_bytes("\ufeffone".encode())
    (tmp_path / "d/sub/b.rst").write_text("two")
    (tmp_path / "d/c.txt").write_text("three")
    rows = {r["name"]: r["text"] for r in files.documents(spark, str(tmp_path / "d"), "*.rst").collect()}
    assert rows == {"a.rst": "one", "sub/b.rst": "two"}
    known = files.snapshot(spark, str(tmp_path / "d"))
    files.check_snapshot(spark, str(tmp_path / "d"), known)
    (tmp_path / "d/c.txt").write_text("other")
    with pytest.raises(ValueError, match="c.txt"):
        files.check_snapshot(spark, str(tmp_path / "d"), known)
    (tmp_path / "x.json").write_text('{"a":\n 1}')
    assert files.read_json(spark, str(tmp_path / "x.json")) == {"a": 1}
    (tmp_path / "y.json").write_text("[1]")
    with pytest.raises(ValueError, match="no object"):
        files.read_json(spark, str(tmp_path / "y.json"))


def test_run_bundles_are_bound_to_their_files(spark, tmp_path):
    run = spark.createDataFrame([(1, 5, 1, 0.123456789123), (1, 6, 2, 1e-7), (2, 5, 1, 123456.789)], "query_id long, item_id long, rank int, score double")
    qrels = spark.createDataFrame([(1, 5, 3)], "query_id long, item_id long, grade int")
    metrics = spark.createDataFrame([("ap", 0.5)], "metric string, value double")
    root = str(tmp_path / "runs")
    manifest = files.write_run_bundle(run, qrels, metrics, {"k": 1}, "s", root)
    assert files.write_run_bundle(run, qrels, metrics, {"k": 1}, "s", root) == manifest
    matrix = files.matrix_manifest([manifest])
    back = files.read_matrix(spark, root, matrix, run.select("query_id"))["s"]
    assert sorted((r["query_id"], r["rank"], r["score"]) for r in back.collect()) == [("1", 1, 0.123456789), ("1", 2, 1e-7), ("2", 1, 123456.789)]
    assert {r["grade"] for r in trec.read_json_lines(spark, f"{root}/{manifest['id']}/top10", "query_id long, grade int").collect()} == {3, None}
    with pytest.raises(ValueError, match="other queries"):
        files.read_matrix(spark, root, matrix, run.select("query_id").where("query_id = 1"))
    with pytest.raises(ValueError, match="manifest of run"):
        files.read_approved_run(spark, root, {**matrix["runs"][0], "manifest_sha256": "0"})
    trec.write_run(run.where("query_id = 1"), f"{root}/{manifest['id']}/run.trec", "s")
    with pytest.raises(ValueError, match="file of run"):
        files.read_approved_run(spark, root, matrix["runs"][0])


def test_reports_and_receipts(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0), ("a|c", None)], "name string, value double")
    text = files.write_report(spark, "T", {"one": rows}, {"one": "name"}, str(tmp_path / "r"))
    assert text == "# T\n\n## one\n\n| name | value |\n|-|-|\n| a\\|c |  |\n| b | 2.0 |\n"
    with pytest.raises(ValueError, match="more than"):
        files.markdown_table(rows, "name", 1)
    assert files.receipt(spark, "x")["time_zone"] == "UTC"


def test_trec_judgments_last_line_wins(spark, tmp_path):
    (tmp_path / "a").write_text("q1 0 x 1\nq1 0 y 2\n\nq1 0 x 3\n")
    (tmp_path / "b").write_text("q1  0\ty 0\n")
    got = {r["item_id"]: r["grade"] for r in trec.read_qrels(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()}
    assert got == {"x": 3, "y": 0}
    (tmp_path / "c").write_text("q1 0 x 1 more\n")
    with pytest.raises(Exception, match="fields"):
        trec.read_qrels(spark, str(tmp_path / "c")).collect()


def test_json_lines_are_canonical_and_sorted(spark, tmp_path):
    rows = spark.createDataFrame([(2, "é", None), (10, "b", 1.5), (2, "a", 2.0)], "id int, b string, a double")
    trec.write_json_lines(rows.repartition(3), str(tmp_path / "j"), "id")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "j")).coalesce(1).collect()]
    assert sorted(lines) == ['{"a":1.5,"b":"b","id":10}', '{"a":2.0,"b":"a","id":2}', '{"a":null,"b":"é","id":2}']
    (tmp_path / "bad").write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        trec.read_json_lines(spark, str(tmp_path / "bad"), "id int").collect()


def test_beir_ids_are_compared(spark, tmp_path):
    corpus = spark.createDataFrame([("1", "", "x"), ("2", "", "y")], "_id string, title string, text string")
    queries = spark.createDataFrame([("7", "q"), ("8", "r")], "_id string, text string")
    qrels = spark.createDataFrame([(7, 1, 2)], "query_id long, item_id long, grade int")
    trec.write_beir(corpus, queries, qrels, str(tmp_path))
    trec.check_beir(spark, str(tmp_path), corpus, queries, qrels)
    with pytest.raises(ValueError, match="corpus"):
        trec.check_beir(spark, str(tmp_path), corpus.limit(1), queries, qrels)


def test_gates_manifests_and_doubles(spark, tmp_path):
    rows = spark.range(5)
    rows.write.parquet(str(tmp_path / "t"))
    paths = {"t": str(tmp_path / "t")}
    known = V.manifest(spark, paths)
    V.check_manifest(spark, paths, known)
    rows.limit(2).write.mode("overwrite").parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="t"):
        V.check_manifest(spark, paths, known)
    subject = {"b": 1, "a": "x"}
    V.require_approval({"status": "approved", "subject_sha256": V.approval_id(subject)}, subject)
    for wrong in ({"status": "pending", "subject_sha256": V.approval_id(subject)}, {"status": "approved", "subject_sha256": V.approval_id({"a": "x"})}, {}):
        with pytest.raises(PermissionError):
            V.require_approval(wrong, subject)
    many = V.digest(spark.range(200_000)).first()  # beyond a long's sum
    assert many["n"] == 200_000 and 0 <= many["digest"] < V.DIGESTS and V.digest(spark.range(0)).first()["digest"] == 0
    assert V.same_twice(lambda: spark.range(9).repartition(3)) and not V.same_twice(lambda it=iter((1, 2)): spark.range(next(it)))
    assert [r["id"] for r in V.missing(spark.range(4), spark.range(3), "id").collect()] == [3]
    assert V.same_rows(spark.range(3), spark.range(3).repartition(2)) and not V.same_rows(spark.range(3), spark.range(2))
    reports = [{"annotation_sha256": "a"}, {"input_hashes": {"annotation": "b"}}, {"bound_outputs": [{"path": "x/y.jsonl", "sha256": "n"}, {"path": "x/adjudicator.jsonl", "sha256": "c"}]}, {}]
    got = spark.createDataFrame([(json.dumps(r),) for r in reports], "r string").select(V.reported_digest(F.col("r")).alias("d")).collect()
    assert [r["d"] for r in got] == ["a", "b", "c", None]


def test_records_that_break_rules(spark):
    cards = spark.createDataFrame([(1, 5, 5), (0, 3000, 1), (2, None, 4)], "rank int, token_count int, cumulative_token_count int")
    assert {r["rule"]: r["broken"] for r in V.violations(cards, "card").collect()} == {"rank": 1, "tokens": 2, "cumulative": 2}
    queries = spark.createDataFrame([("a", "x", "answerable", None), (None, "", "no_answer", None)], "id string, text string, answerability string, no_answer_reason string")
    assert {r["rule"]: r["broken"] for r in V.violations(queries, "query").collect()} == {"id": 1, "text": 1, "answerability": 0, "reason": 1}


def test_outputs_appear_whole(spark, tmp_path):
    from evidentia.sources.publish import publish

    path = f"file://{tmp_path}/out/lines"
    held = lambda: sorted(r["value"] for r in spark.read.text(path).collect())
    rows = spark.createDataFrame([(i, f"x{i}") for i in range(20)], "k int, text string").repartition(4)
    trec.write_json_lines(rows, path, "k")
    first = held()
    failing = rows.withColumn("text", F.when(F.col("k") < 15, F.col("text")).otherwise(F.raise_error(F.lit("late"))))
    with pytest.raises(Exception, match="late"):
        trec.write_json_lines(failing, path, "k")
    with pytest.raises(ValueError, match="wrong"):
        publish(spark, path, rows.select("text").write.text, lambda at: (_ for _ in ()).throw(ValueError("wrong")))
    assert held() == first and len(first) == 20
    trec.write_json_lines(rows.where("k < 3"), path, "k")
    assert len(held()) == 3 and [p.name for p in (tmp_path / "out").iterdir()] == ["lines"]


def test_scores_have_nine_digits(spark):
    rnd = random.Random(3)
    values = [0.0, -0.0, 1.0, -2.5, 1e-4, 1e-5, 123456789.0, 1e9, 999999999.6, 0.1 + 0.2, 1.7e308, *[rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 14) for _ in range(400)]]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", trec.nine_digits(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['x']:.9g}" for r in got]


def test_quotas_add_up():
    from evidentia.operators import benchmark

    assert benchmark.quota_sums({"a": {"x": 2, "y": 3}, "b": {"z": 4}}, {"a": 5, "b": 5}) == [("b", 5, 4)]


def plain_faults(schema, value, defs, name="", required=True):
    """Rules that a value breaks, by the words of the schema."""
    while "$ref" in schema:
        schema = defs[schema["$ref"].rpartition("/")[2]]
    kinds = schema.get("type", "string")
    at = lambda k: f"{name}.{k}".lstrip(".")
    if value is None:
        return {at("required")} if required and name and "null" not in kinds else set()
    tests = {"enum": lambda v: value in v, "const": lambda v: value == v, "minimum": lambda v: value >= v, "maximum": lambda v: value <= v, "minLength": lambda v: len(value) >= v, "pattern": lambda v: re.search(v, value), "minItems": lambda v: len(value) >= v, "uniqueItems": lambda v: not v or len(set(value)) == len(value)}
    found = {at(k) for k, ok in tests.items() if k in schema and not ok(schema[k])}
    for part, of in schema.get("properties", {}).items():
        found |= plain_faults(of, value.get(part), defs, at(part), part in schema.get("required", []))
    for x in value if "items" in schema else []:
        found |= plain_faults(schema["items"], x, defs, f"{name}[]")
    return found


def test_schemas_equal_a_plain_validator(spark):
    """Random records of every kind, right and wrong in every field, break the rules that a validator by the schema's words finds."""
    from evidentia.operators import schema as S

    rnd = random.Random(12)

    def value(of):
        while "$ref" in of:
            of = S.KINDS[of["$ref"].rpartition("/")[2]]
        kinds = of.get("type", "integer" if of.get("const") == 0 else "string")
        if rnd.random() < 0.15:
            return None
        if "array" in kinds:
            return [value(of["items"]) for _ in range(rnd.randint(0, 3))]
        if "object" in kinds:
            return {k: value(p) for k, p in of["properties"].items()}
        if "integer" in kinds:
            return rnd.choice([-1, 0, 1, 3, 4, 512, 513, 2048, 2049])
        return rnd.choice([True, False]) if "boolean" in kinds else rnd.choice(["", "x", "ab" * 32, "AB" * 32, "y\n", *of.get("enum", [])])

    for kind, schema in S.KINDS.items():
        records = [{k: value(p) for k, p in schema["properties"].items()} for _ in range(60)]
        want = Counter(rule for r in records for rule in plain_faults(schema, r, S.KINDS))
        got = {r["rule"]: r["broken"] for r in S.broken(spark.createDataFrame(records, S.spark_type(schema, S.KINDS)), schema, S.KINDS).collect()}
        assert {k: n for k, n in got.items() if n} == dict(want) and set(want) <= set(got), kind
    rows = spark.createDataFrame([("a", 1)], "id string, more int")
    assert {r["rule"] for r in S.broken(rows, S.KINDS["nugget"]).where("broken > 0").collect()} == {f"{c}.required" for c in ("query_id", "text", "required", "source_span_ids")}
    assert S.broken(rows.limit(0), S.KINDS["nugget"]).where("broken > 0").count() == 0
    with pytest.raises(ValueError, match="query_id.required: 1 rows"):
        S.require(rows, S.KINDS["nugget"])


def test_extraction_checks_find_faults(spark):
    from evidentia.operators import extraction as X

    pages = spark.createDataFrame([(1, "<h1>One two</h1><p>x</p>"), (2, "<div><!-- no units --></div>"), (3, "<script>none</script>")], "page_id long, html string")
    units = X.units_from_pages(pages)
    faulty = units.unionByName(units.where("ordinal = 1")).unionByName(units.where("ordinal = 0").withColumn("page_id", F.lit(9)).withColumn("unit_id", F.lit("u"))).unionByName(units.where("ordinal = 0").withColumn("ordinal", F.lit(7)).withColumn("unit_id", F.lit("v")).withColumn("text", F.lit("other words")))
    check = lambda u: {r["rule"]: r["broken"] for r in V.extraction_checks(pages, u, spark.createDataFrame([(3,)], "page_id long"), ["heading", "code"]).collect() if r["broken"]}
    assert check(units) == {"page_without_units": 1, "missing_type": 1}
    assert check(faulty) == {"page_without_units": 1, "missing_type": 1, "repeated_id": 1, "repeated_place": 1, "unknown_page": 1, "heading_off_source": 1}


def test_closed_loop_and_matrix(spark):
    calls = []
    log = load.closed_loop(spark, calls.append, 3, requests=20, seconds=0.0, warm_up=2)
    assert log.count() == 20 and len(calls) == 22 and sorted(r["request"] for r in log.collect()) == list(range(20))
    row = load.summary(log).first()
    assert row["requests"] == 20 and row["p50"] <= row["p99"]
    bounds = {"requests": 5, "seconds": 0.0, "warm_up": 0}
    first = load.matrix(spark, {"a": lambda i: None, "b": lambda i: None}, [1, 2], {}, **bounds)
    again = load.matrix(spark, {"a": lambda i: 1 / 0}, [1, 2], first, **bounds)  # nothing is run again
    assert set(first) == {"a@1", "a@2", "b@1", "b@2"} and again == {k: first[k] for k in ("a@1", "a@2")}
    slow = {**first["a@1"], "p50": 50.0}
    assert load.promoted({"a@1": slow, "b@1": first["b@1"], "b@2": first["b@2"]}, {"a": 0.9, "b": 0.899}, "a") == ["b@1", "b@2"]
    assert load.promoted({"b@1": first["b@1"]}, {"a": 0.9, "b": 0.8}, "a") == []


def test_runtime_answers_from_an_index(spark, tmp_path):
    from evidentia.operators import index

    index.save(spark.createDataFrame([(1, "red apple"), (2, "green pear")], "item_id long, text string"), str(tmp_path / "i"))
    runtime = load.Runtime(index.load(spark, str(tmp_path / "i")))
    rows, stages = runtime.query("a green apple")
    assert [r["item_id"] for r in rows] == [1, 2] and min(stages.values()) > 0
    runtime.close()


def test_own_encoder_and_reranker(spark):
    items = spark.createDataFrame([(1, 0, "aa"), (1, 1, "b"), (2, 0, "ab"), (0, 0, "a")], "item_id long, window_id int, text string")
    queries = spark.createDataFrame([(0, "a")], "query_id long, text string")
    share = lambda t: F.array(*[((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) / F.length(t)).cast("float") for c in "ab"])
    encoder = lambda t: share(F.col(t) if isinstance(t, str) else t)
    run = protocols.dense_search(items, queries, encoder, 3)
    assert [(r["item_id"], r["score"]) for r in run.orderBy("rank").collect()] == [(0, 1.0), (1, 1.0), (2, 0.5)]
    longest = lambda q, t: F.length(t).cast("double")
    got = protocols.rerank(run, queries, items, longest, 2)
    assert [r["item_id"] for r in got.orderBy("rank").collect()] == [1, 0]
    assert [r["item_id"] for r in protocols.rerank(run, queries, items, longest, 2, True).orderBy("rank").collect()] == [1, 0, 2]


def test_shared_folder_is_emptied(spark, monkeypatch):
    before = set(tables._held)
    rows = tables.materialize(spark.range(4))
    assert rows.count() == 4 and len(set(tables._held) - before) == 1
    tables.release(rows.where("id > 1"))
    assert set(tables._held) == before

    @tables.tidy
    def fails():
        tables.materialize(spark.range(2))
        raise KeyError("x")

    with pytest.raises(KeyError):
        fails()
    assert set(tables._held) == before
    run = retrieval.top_k(retrieval.bm25_scores(spark.createDataFrame([(1, "aa bb")], "item_id long, text string"), spark.createDataFrame([(1, "aa")], "query_id long, text string")))
    assert run.count() == 1
    tables.release(run)


def test_a_cluster_without_a_shared_folder_raises():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Fake)
    Fake.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert tables.shared_dir(Fake) == "hdfs://x/y"


def test_commands(capsys):
    from evidentia import cli

    assert cli.main(["list"]) == 0 and "bm25_top10" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing"])
    with pytest.raises(SystemExit):
        cli.main(["search", "x"])
