"""The training-data operators' queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import alignment, bpe, divergence, lines, mixing, mpegts, ngrams, quality, secrets, simhash, suffixes, toxicity, urls
from evidentia.llm._common import table


def tokenizer_path() -> str:
    """The public tokenizer file of the BPE query and stage."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op4(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op5(table(spark, sf_dir, "pages"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op6(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op7(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.op9(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.op11(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op12(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.op13(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline().run(spark, sf_dir)


def _pipeline():
    """corpus_pipeline, from the folder beside this package wherever the process was started."""
    try:
        import corpus_pipeline
    except ModuleNotFoundError as e:
        if e.name != "corpus_pipeline":
            raise
        path = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
        spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
        corpus_pipeline = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(corpus_pipeline)
    return corpus_pipeline


QUERIES = [op1_quality_rules, op2_bpe, op3_mix_sources, op4_secret_scan, op5_url_filter, op6_suffix_array_dedup, op7_line_dedup, op8_toxicity, op9_media_columns, op10_simhash, op11_ngram_join, op12_source_divergence, op13_token_alignment, pipeline]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return {"op3_mix_sources": mixing.mix_sql(), "op5_url_filter": urls.sql(), "op6_suffix_array_dedup": suffixes.sql(), "op7_line_dedup": lines.sql(), "op11_ngram_join": ngrams.sql(), "op12_source_divergence": divergence.sql()}
