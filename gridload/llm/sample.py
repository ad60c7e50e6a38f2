"""A bounded, seeded sample of labelled rows for the classifiers to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SALTS = 16
MAX_ROWS = 48_000  # over all labels


def row_key(id_col: str, text_col: str, seed: int) -> Column:
    """A row's key: rows of one id and one text are one, others are not."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))


def sample_ids(rows: DataFrame, id_col: str, label_col: str, per_label: int, seed: int,
               max_rows: int = MAX_ROWS, labels: int | None = None) -> DataFrame:
    """``(_id, _label)``: about ``per_label`` distinct ids (or row keys) of each
    label, fewer if all labels together had more than ``max_rows``, at most a
    quarter more. Repeated ids of a label count once, so they take no one's
    place. A label's ids are dealt to ``SALTS`` parts by their hashes and each
    part gives its lowest, so a frequent label is no single task's. Only ids and
    labels cross a shuffle. Null labels are left out; more labels than
    ``max_rows`` are an error. ``labels``: their number, if it is known."""
    rated = rows.where(F.col(label_col).isNotNull())
    if labels is None:
        labels = rated.select(label_col).distinct().count()
    if labels > max_rows:
        raise ValueError(f"{labels} labels, a sample holds {max_rows} rows")
    per_label = min(per_label, max_rows // max(1, labels))
    order = Window.partitionBy("_label", "_salt").orderBy("_order", "_id")
    each = -(-per_label * 5 // (4 * SALTS))
    return (rated.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).distinct()
            .withColumn("_order", F.xxhash64("_id", F.lit(seed)))
            .withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(SALTS)))
            .withColumn("_n", F.row_number().over(order))
            .where(F.col("_n") <= each).select("_id", "_label"))


def with_texts(rows: DataFrame, ids: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``(_id, _label, _text)``, one row for each sampled row key; ``ids`` is
    bounded by the sample's parameters, so it may be broadcast. Copies of a row
    are put together where they are read."""
    texts = rows.select(F.col(key_col).alias("_key"), F.col(text_col).alias("_text"))
    return (texts.join(F.broadcast(ids), texts["_key"] == ids["_id"])
            .groupBy("_id", "_label").agg(F.first("_text").alias("_text")))
