"""Mixing sources to target weights by capped water-filling.

Sources share all words by weight; none may take more than ``MAX_EPOCHS``
times its own words. Sources above that are clamped, and what they leave is
shared among the others by weight, again and again until none is above. Each
round is one aggregate over the table of sources (one row a source); only its
two sums reach the driver.

A source that takes 2.3 times its words has every document twice, and a seeded
part of its documents once more. That part is the beginning of the source in
the order of a seeded hash, up to the document whose middle is past the wanted
words. What that document leaves or has too much (at most half of it) is
mended the same way, three times, with documents no larger than the rest.
Documents are always taken whole.

The beginnings are found without gathering a source: each source is cut into
hash ranges of about ``RANGE_ROWS`` rows; sums of ranges give every range its
start, and running sums are taken within a range only. The hash is of id and
text, so rows of one id lie in many ranges; rows of equal hash, id and size are
the same to the mix, whichever comes first, so reruns agree.

Edge cases: null and empty texts have size 0 and are taken 0 times their size
(their repetitions follow the same order); the null source is a source, last
in order; repeated rows count as documents of their own; an empty table gives
an empty mix; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import WORD, written

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
RANGE_ROWS = 2_000
SEED = 11
MENDS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(sources: DataFrame, order: list[Column]) -> DataFrame:
    """``sources`` with ``_at``, the 0-based place in a total order: sorted by
    range, numbered within each partition, moved by the partitions before."""
    part = (sources.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_part", F.spark_partition_id()))
    part = written(part.withColumn("_row", F.monotonically_increasing_id()), "mix-order")
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_row0"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_row0",
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (part.join(starts, "_part")
            .withColumn("_at", F.col("_row") - F.col("_row0") + F.col("_before"))
            .drop("_part", "_row", "_row0", "_before"))


def water_fill(sources: DataFrame, total: int, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (with ``_weight``, ``source_size``) and their ``target``.

    The clamped sources only grow, and every round clamps one at least, so the
    loop ends; the number of rounds is the number of distinct levels at which
    sources clamp, a few in practice."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped_before = None, -1
    while True:
        clamped = F.lit(False) if level is None else F.col("_weight") * F.lit(level) > cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("source_size"))), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~clamped, F.col("_weight"))), F.lit(0)).alias("weights"),
            F.count(F.when(clamped, 1)).alias("n")).collect()[0]
        if row["weights"] == 0 or row["n"] == clamped_before:
            break
        clamped_before = row["n"]
        level = float((total - row["fixed"] * max_epochs) / row["weights"])
    share = F.lit(0.0) if level is None else F.col("_weight") * F.lit(level)
    return sources.withColumn("target", F.least(cap, share).cast("double"))


def _by_source(table: DataFrame, small: bool) -> DataFrame:
    """A table of one row a source, to be joined by source: broadcast if the
    table of sources was measured to be small, so no source's rows meet in one
    task; else left to a merge join, whose skew adaptive execution splits."""
    return F.broadcast(table) if small else table


def _prefix(rows: DataFrame, want: str, small: bool) -> DataFrame:
    """``rows`` (``_key``, ``_hash``, ``size``, ``_pick`` candidates, ``want``)
    with ``_in``: among the candidates of a source, in hash order, those whose
    middle is within ``want`` words of the beginning. Ranges are cut on the
    hash, by the number of candidates."""
    candidates = rows.where("_pick")
    parts = candidates.groupBy("_key").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(RANGE_ROWS)).cast("bigint").alias("_parts"))
    # the hash as 0..1 decides the range; equal hashes share one
    unit = (F.shiftrightunsigned("_hash", 11).cast("double") / F.lit(float(1 << 53)))
    ranged = (candidates.join(_by_source(parts, small), "_key")
              .withColumn("_range", F.floor(unit * F.col("_parts")).cast("bigint")))
    sums = ranged.groupBy("_key", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sums.select("_key", "_range",
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = (Window.partitionBy("_key", "_range").orderBy(F.shiftrightunsigned("_hash", 11),
                                                           "_hash", "_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (ranged.join(starts, ["_key", "_range"])
              .withColumn("_end", F.col("_start") + F.sum("size").over(within)))
    return placed.withColumn("_in", F.col("_end") - F.col("size") / 2 <= F.col(want))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, repetitions, taken.

    ``weights`` go to the sources by code point, repeating, null last."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
        F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"),
                 F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("_key"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("_hash"),
        word_count(F.col(text_col)).alias("size"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    sums = rows.groupBy("_key").agg(F.sum("size").alias("source_size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).collect()[0]["n"]
    # a total order of the keys; UTF-8 bytes sort like code points
    at = numbered(sums, [F.col("_key").asc()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("_at") % len(weights) + 1).cast("int"))
    sources = written(at.select("_key", "source_size", weight.cast("bigint").alias("_weight")),
                      "mix-sources")
    targets = written(water_fill(sources, total, max_epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0,
                   F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    wanted = (targets.withColumn("_whole", whole.cast("bigint"))
              .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))
    side, small = bounded_broadcast(
        wanted.select("_key", "source_size", "target", "_whole", "_rest"))
    every = rows.join(side, "_key")

    chosen = _prefix(every.withColumn("_pick", F.col("_rest") > 0), "_rest", small).where("_in")
    extra = written(chosen.select("_row", "_key", "_hash", "_id", "size"), "mix-extra")
    for _ in range(MENDS):
        extra = _mended(every, extra, wanted, small)
    picked = extra.select("_row", F.lit(1).cast("bigint").alias("_more"))
    out = every.join(picked, "_row", "left")
    times = F.col("_whole") + F.coalesce("_more", F.lit(0))
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "size",
                      "source_size", "target", times.alias("repetitions"),
                      (times * F.col("size")).alias("taken"))


def _mended(every: DataFrame, extra: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """Brings each source's extra words nearer to its rest: where words lack,
    documents not chosen yet and no larger than the lack are added; where there
    are too many, chosen ones no larger than the surplus go."""
    got = extra.groupBy("_key").agg(F.sum("size").alias("_got"))
    lack = (wanted.where("_rest > 0").join(got, "_key", "left")
            .select("_key", (F.col("_rest") - F.coalesce("_got", F.lit(0))).alias("_lack")))
    # A document of size 0 changes no sum and stays as it is.
    small = (every.select("_row", "_key", "_hash", "_id", "size").where("size > 0")
             .join(_by_source(lack, small), "_key").where(F.col("size") <= F.abs("_lack")))
    has = small.join(extra.select("_row", F.lit(True).alias("_has")), "_row", "left")
    able = has.withColumn("_pick", F.coalesce("_has", F.lit(False)) == (F.col("_lack") < 0))
    able = able.withColumn("_want", F.abs("_lack"))
    turn = written(_prefix(able, "_want", small).where("_in")
                   .select("_row", "_key", "_hash", "_id", "size"), "mix-turn")
    stay = extra.join(turn.select("_row"), "_row", "left_anti")
    come = turn.join(extra.select("_row"), "_row", "left_anti")
    return written(stay.unionByName(come), "mix-extra")


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id",
             source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Rows with the same
    id and source take turns in the repetitions of that id."""
    plan = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(
        F.sum("repetitions").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    cols = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in cols]).alias("_doc"),
                         docs[id_col].alias("_i"), docs[source_col].alias("_s"))
    # both sides grow with the input: a sort-merge join at every size
    same = packed.hint("merge").join(plan, F.col("_i").eqNullSafe(F.col("_id"))
                       & F.col("_s").eqNullSafe(F.col("_source")))
    # ids are as good as unique: the turn of a row matters only where they repeat
    once = same.where("_rows = 1").select("_doc", "_times")
    turn = Window.partitionBy("_i", "_s").orderBy(F.xxhash64("_doc"))
    many = (same.where("_rows > 1").withColumn("_turn", F.row_number().over(turn))
            .select("_doc", (F.floor(F.col("_times") / F.col("_rows"))
                             + (F.col("_turn") <= F.col("_times") % F.col("_rows"))
                             .cast("bigint")).alias("_times")))
    times = once.unionByName(many).where("_times > 0")
    return (times.select("_doc", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times"))
                         .alias("_copy")).select("_doc.*"))
