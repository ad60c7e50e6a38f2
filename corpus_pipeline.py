"""From raw documents to token files, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read back as the next stage's ``docs``, so a stage starts
from files whatever executors were lost. All but the last return the columns of
``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.llm import (decontaminate, filtering, language_id, ngram_join, source_mix,
                          token_output)
from gridload.llm.common import importable, intermediates, read, written
from gridload.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a model learnt from the labelled
    rows, rejected texts (and those without a letter) go."""
    importable(spark)
    model = language_id.learn(docs, F.col("lang").isNotNull())
    told = language_id.predict(docs, model, prefix="_told_")
    return told.where("not _told_rejected").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by id) of each group linked by five-word shingles
    at a similarity of 0.8 or more."""
    importable(spark)
    groups = ngram_join.join(docs, k=5, num=80, den=100)
    return filtering.only_first(docs, groups)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    importable(spark)
    keyed = docs.select(F.struct("doc_id", ngram_join.text_key(F.col("text"))).alias("doc_id"),
                        "text")
    with intermediates(spark):
        found = decontaminate.decontaminate(keyed, read(spark, sf_dir, "benchmark"))
        leaks = written(found.where(F.size("matches") > 0).select("doc_id.*").distinct(), "leaks",
                        keep=True)
    return filtering.without(docs, leaks)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    importable(spark)
    with intermediates(spark):
        mixed = written(source_mix.mix(docs), "mix", keep=True)
    return source_mix.repeated(docs, mixed)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files under the shared folder, and what was read back from them."""
    importable(spark)
    path = scratch_path(spark, "token-files")
    token_output.write_tokens(docs, path)
    return token_output.read_tokens(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("source_mix", mix_sources),
    ("token_output", write_token_files),
]

# Trained models, seeded draws and a tokenizer are beyond SQL; tests hold the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
