"""The registered queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (decontaminate, exact_dedup, kn_lm, language_id, license_scan, ngram_join,
               prefix_trie, quality_rank, repair, secret_scan, source_mix, token_output, warc)
from .common import id_remainder, intermediates, read, written


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents"))


def op3_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = quality_rank.learn(docs, labels.where(~held_out))
    return quality_rank.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= quality_rank.CUT).cast("int").alias("predicted"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), k=4, num=85, den=100).select(
        "doc_id", "n_shingles", "component_id")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_output.write_tokens(read(spark, sf_dir, "documents"), path)
    return token_output.read_tokens(spark, path)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 7) == 2
    model = kn_lm.train(docs.where(~held_out).select("text"))
    return kn_lm.score(docs, model).withColumn("held_out", held_out)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    return language_id.identify(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"),
        slop=decontaminate.NEAR))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    with intermediates(spark):
        return written(repair.digest(turns, *repair.repair(repair.damaged(turns))),
                       "conversations-repaired", keep=True)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.digest(written(warc.read_archives(spark, path).drop("payload"), "warc-records"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with intermediates(spark):
        turns = prefix_trie.turns(read(spark, sf_dir, "conversations"))
        return written(prefix_trie.trie(*prefix_trie.spliced(*turns)), "trie", keep=True)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mix": op2_source_mix,
    "op3_quality_rank": op3_quality_rank,
    "op4_secret_scan": op4_secret_scan,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_output": op6_token_output,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}
