"""Dropping rows of a table by decisions about (doc_id, text).

Decisions carry the id and ``text_key`` (a hash of the text), so rows that
repeat an id with another text are told apart. Only the dropped rows are
joined: broadcast up to ``BROADCAST_ROWS`` (16 bytes each), by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ngram_join import text_key

BROADCAST_ROWS = 1_000_000


def _bounded(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole row as one column, so no name of its own can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"))


def _same(rows: DataFrame, drop: DataFrame):
    return (rows["_key"] == drop["text_key"]) & rows["_id"].eqNullSafe(drop["doc_id"])


def without(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_key) is in ``drop``."""
    rows, drop = _packed(docs, id_col, text_col), _bounded(drop)
    return rows.join(drop, _same(rows, drop), "left_anti").select("_doc.*")


def only_first(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` with the rows that ``decided`` (doc_id, text_key, first) calls
    first. Of repeated rows with the same id and text, where one is first, the
    smallest whole row stays."""
    told = decided.groupBy("doc_id", "text_key").agg(
        F.max("first").alias("_any"), F.min("first").alias("_all"))
    mixed = told.where("_any and not _all").select("doc_id", "text_key")
    gone = told.where("not _all").select("doc_id", "text_key")
    kept = without(docs, gone, id_col, text_col)
    rows, mixed = _packed(docs, id_col, text_col), _bounded(mixed)
    turn = Window.partitionBy("_id", "_key").orderBy(F.to_json("_doc"))
    one = (rows.join(mixed, _same(rows, mixed), "left_semi")
           .withColumn("_turn", F.row_number().over(turn)).where("_turn = 1")
           .select("_doc.*"))
    return kept.unionByName(one)
