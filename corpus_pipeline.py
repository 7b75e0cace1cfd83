"""A training corpus from documents: toxicity, line dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, lines, mixing, shingles, toxicity
from evidentia.llm._common import durable, release, table
from evidentia.llm.queries import tokenizer_path

#: Columns that pass from stage to stage.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labels outside the held-out fold, does not reject."""
    return toxicity.judge(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(COLUMNS)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sources share; a document stays even if nothing of it is left."""
    return _documents(lines.drop_boilerplate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 or more of their five-word shingles: the one with the smallest id.

    Candidates come from balls around SimHash fingerprints, and from bands for the pairs that a ball does not reach;
    links are verified by exact similarity. Texts are told apart by their own hashes, so several texts of one id stay as long
    as they differ, and a row without an id stays if no row with one is like it.
    """
    return shingles.one_of_each(docs).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, none to twice: sampled documents go, epochs repeat."""
    return mixing.repeat(docs).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("line_dedup", boilerplate_lines), ("simhash_near_dedup", near_duplicates), ("mixing", mixed), ("bpe", tokens)]

#: The learned model, the fingerprints and the tokenizer are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage no longer needs is deleted.

    Null texts count as empty, and leave as one empty document at most after near-dedup; null ids and sources stay null.
    Rows of one id are rows of their own where their texts differ. Repeated rows are one after near-dedup. Columns other than
    COLUMNS go. An empty table gives an empty result; without labels no document is toxic.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return rows
        docs = durable(rows)
        release(rows)
    return docs
