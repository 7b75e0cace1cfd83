"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidentia.functions import judging as J
from evidentia.functions import numeric as N
from evidentia.functions import text as T


def one(spark, column, **values):
    """The value of a column over one row of `values`."""
    return spark.createDataFrame([Row(x=0, **values)]).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("n", "size", "overlap", "expected"),
    [(1000, 512, 100, [(0, 512), (412, 924), (824, 1000)]), (845, 512, 100, [(0, 512), (412, 845)]), (832, 512, 100, [(0, 512), (412, 832)]), (833, 512, 100, [(0, 512), (412, 833)]), (128, 512, 100, [(0, 128)]), (0, 512, 100, [])],
)
def test_windows(spark, n, size, overlap, expected):
    assert [tuple(w) for w in one(spark, N.windows(F.col("n"), size, overlap), n=n)] == expected


@pytest.mark.parametrize(("n", "expected"), [(512, [(0, 512)]), (513, [(0, 480), (416, 513)])])
def test_scoring_windows(spark, n, expected):
    assert [tuple(w) for w in one(spark, N.scoring_windows(F.col("n")), n=n)] == expected


def test_normalize(spark):
    assert one(spark, T.normalize_rendered("t"), t="\n\r\n x1 \t\r y2\r\n\n \n\r\nz3\n\n") == " x1\n y2\n\nz3"
    assert one(spark, T.collapse("t"), t="\u00a0a\u2003\u2028b\x1c\x85c\t") == "a b c"


@pytest.mark.parametrize(("gap", "expected"), [(1, [(447, 449), (1536, 1536)]), (0, [(447, 447), (448, 449), (1536, 1536)])])
def test_merge_intervals(spark, gap, expected):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in [(448, 449), (447, 447), (1536, 1536)]])
    assert [tuple(x) for x in one(spark, N.merge_intervals(spans, gap))] == expected


def test_subqueries(spark):
    text = "Peel the apples,  and slice them; then boil all slowly, Slice them, now"
    assert one(spark, T.subqueries("t"), t=text) == [" ".join(text.split()), "Peel the apples", "Peel the apples slice them", "Peel the apples boil all slowly"]
    assert one(spark, T.subqueries("t"), t="Why do apples float?") == ["Why do apples float?"]


@pytest.mark.parametrize(("topical", "hits", "expected"), [(False, [], 0), (True, [], 1), (True, ["a"], 2), (True, ["a", "b"], 3)])
def test_grade(spark, topical, hits, expected):
    c = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert one(spark, J.grade(F.lit(topical), c(hits), c(["a", "b"]))) == expected


def test_grade_rejects_unknown_hits(spark):
    with pytest.raises(Exception, match="not a required nugget"):
        one(spark, J.grade(F.lit(True), F.array(F.lit("z")), F.array(F.lit("a"))))


def test_wrong_version(spark):
    rows = [("wrong_version", 0, True), ("wrong_version", 1, True), ("wrong_version", None, False), ("wrong_version", 2, False), ("other", 0, False)]
    df = spark.createDataFrame(rows, "reason string, grade int, want boolean")
    assert all(r["got"] == r["want"] for r in df.select(J.wrong_version(F.col("reason"), F.col("grade")).alias("got"), "want").collect())


def test_negative_classes(spark):
    p = F.array(*map(F.lit, ["rerank_candidate", "semantic_candidate", "wrong_module_candidate", "other"]))
    assert one(spark, J.negative_classes(p, F.lit(None).cast("string"))) == ["baseline_false_positive", "semantic_nearest", "wrong_module"]
    assert one(spark, J.negative_classes(p, F.lit("wrong_version"))) == ["wrong_version"]


def test_stable_id(spark):
    import hashlib

    assert one(spark, T.stable_id("a", "b", length=16), a="x", b="y") == hashlib.sha256(b"x\0y").hexdigest()[:16]


def test_common_prefix(spark):
    paths = F.array(*[F.array(*map(F.lit, p)) for p in (["a", "b", "c"], ["a", "b"], ["a", "b", "d"])])
    assert one(spark, N.common_prefix(paths)) == ["a", "b"]
    assert one(spark, N.common_prefix(F.array(F.array(F.lit("a")), F.array(F.lit("b"))))) == ["a"]


def test_canonical_json(spark):
    assert one(spark, T.canonical_json(id=F.lit("a"), value=F.lit(1), none=F.lit(None).cast("string"))) == '{"id":"a","none":null,"value":1}'
