"""TREC, BEIR and canonical JSON files; rows that break a format's rules raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.text import canonical_json
from evidentia.sources.publish import publish


def nine_digits(score: Column) -> Column:
    """A score (a normal number) as text of at most nine significant digits: fixed from 1e-4 up to 1e9, with an exponent of two digits or more beyond; trailing zeros go."""
    text = F.format_string("%.8e", score.cast("double"))
    minus, digits = F.regexp_extract(text, "^(-?)", 1), F.regexp_replace(F.regexp_extract(text, r"([0-9.]+)e", 1), r"\.", "")
    power = F.regexp_extract(text, r"e([+-][0-9]+)$", 1).cast("int")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    large = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(9)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    far = F.concat(bare(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 8))), F.lit("e"), F.regexp_extract(text, r"e([+-][0-9]+)$", 1))
    number = F.when(power.between(0, 8), bare(large)).when(power.between(-4, -1), bare(small)).otherwise(far)
    return F.when(F.isnan(score.cast("double")) | (F.abs(score.cast("double")) == float("inf")), F.lower(score.cast("string"))).otherwise(F.concat(minus, number))


def write_run(run: DataFrame, path: str, tag: str) -> None:
    """`query Q0 item rank score tag` lines of (query_id, item_id, rank, score), in order of query and rank, in as many files as there are partitions."""
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("item_id").cast("string"), F.col("rank").cast("string"), nine_digits(F.col("score")), F.lit(tag))
    publish(run.sparkSession, path, run.repartitionByRange("query_id").sortWithinPartitions("query_id", "rank").select(line).write.text)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, item_id, rank, score, tag); raises unless the second field is Q0 and a query's ranks are 1 to n."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("query_id"), p[1].alias("q0"), p[2].alias("item_id"), p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("tag"))
    expected = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    ok = (F.col("q0") == "Q0") & (F.col("rank") == F.col("expected"))
    checked = F.when(ok, F.col("rank")).otherwise(F.raise_error(F.lit("not a run: literal or ranks")).cast("int"))
    return rows.withColumn("expected", expected).select("query_id", "item_id", checked.alias("rank"), "score", "tag")


def write_qrels(qrels: DataFrame, path: str) -> None:
    """`query 0 item grade` lines."""
    publish(qrels.sparkSession, path, qrels.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), F.col("item_id").cast("string"), F.col("grade").cast("string"))).write.text)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, item_id, grade); of repeated judgments the last line of the last file counts. A line of other than four fields raises."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("query_id"), p[2].alias("item_id"), F.when(F.size(p) == 4, p[3]).otherwise(F.raise_error(F.lit("not a judgment: fields"))).cast("int").alias("grade"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("place"))
    return rows.groupBy("query_id", "item_id").agg(F.max_by("grade", "place").alias("grade"))


def write_beir(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, path: str) -> None:
    """corpus (_id, title, text) and queries (_id, text) as JSON lines, qrels as tab-separated values with a header."""
    judged = qrels.select(F.col("query_id").alias("query-id"), F.col("item_id").alias("corpus-id"), F.col("grade").alias("score"))

    def write(at: str) -> None:
        corpus.select("_id", "title", "text").write.json(f"{at}/corpus")
        queries.select("_id", "text").write.json(f"{at}/queries")
        judged.write.option("sep", "\t").option("header", True).csv(f"{at}/qrels")

    publish(corpus.sparkSession, path, write)


def read_beir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus, queries with a judgment, qrels. check_beir() compares them with what was written."""
    corpus = spark.read.schema("_id string, title string, text string").option("mode", "FAILFAST").json(f"{path}/corpus")
    qrels = spark.read.schema("`query-id` string, `corpus-id` string, score int").option("sep", "\t").option("header", True).csv(f"{path}/qrels").toDF("query_id", "item_id", "grade")
    queries = spark.read.schema("_id string, text string").option("mode", "FAILFAST").json(f"{path}/queries")
    return corpus, queries.join(qrels.select(F.col("query_id").alias("_id")).distinct(), "_id", "left_semi"), qrels


def check_beir(spark: SparkSession, path: str, corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> None:
    """Raise unless the files below `path` have exactly these ids: corpus (_id), judged queries (_id), qrels (query_id, item_id, grade)."""
    back, asked, judged = read_beir(spark, path)
    wanted = queries.join(qrels.select(F.col("query_id").cast("string").alias("_id")).distinct(), "_id", "left_semi")
    as_text = lambda q: q.select(F.col("query_id").cast("string"), F.col("item_id").cast("string"), F.col("grade").cast("int"))
    for name, a, b in (("corpus", back.select("_id"), corpus.select("_id")), ("queries", asked.select("_id"), wanted.select("_id")), ("qrels", as_text(judged), as_text(qrels))):
        if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
            raise ValueError(f"{name} differ from what was read back")


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as canonical JSON."""
    return rows.select(canonical_json(**{c: F.col(c) for c in rows.columns}).alias("value"))


def write_json_lines(rows: DataFrame, path: str, sort_key: str) -> None:
    """Canonical JSON lines in order of `sort_key` as text, then of the line, in one or more files in that order."""
    lines = rows.select(F.col(sort_key).cast("string").alias("k"), canonical_json(**{c: F.col(c) for c in rows.columns}).alias("value"))
    publish(rows.sparkSession, path, lines.repartitionByRange("k").sortWithinPartitions("k", "value").select("value").write.text)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of non-blank JSON lines; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
