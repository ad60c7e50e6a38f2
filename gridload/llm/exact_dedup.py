"""Exact deduplication with static binary-fuse filters over immutable snapshots.

Texts are equal when they agree after each run of blanks is one space. Rows
arrive in batches. A batch is taken in like this:

1. its rows are digested (SHA-256 of the normalised text) and its own equal
   digests are grouped (map-side, so a third of all rows with one text is one
   row a task);
2. the distinct digests are screened by the binary-fuse filter of every
   snapshot before it. A filter never misses a member, so negatives are new;
3. positives join the snapshot's exact buckets on the whole digest;
4. the new digests become the next snapshot: immutable Parquet in buckets by
   digest prefix, with one filter for each bucket.

Byte checks: rows that share a digest are compared to the row that stays, in
parts of about ``PART_ROWS`` rows, each with a copy of that row, so one text's
copies are many tasks; rows whose bytes differ (a digest collision) are grouped
by the text itself.

The filter of a bucket is a static function over its keys (8-bit fingerprints,
three slots from a window of consecutive segments, 1.13 to 1.3 bytes a key).
Bucket sizes follow the number of digests, which are hashes: no bucket is hot.

Edge cases: null counts as empty text; the smallest doc_id of equal texts
stays (null ids last); repeated rows are copies like any other; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import written
from .words import mix

BATCHES = 3
BUCKET_KEYS = 200_000
DIGEST_BYTES = 32
BROADCAST_KEYS = 500_000  # of 32 bytes
PART_ROWS = 1_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


# --- the filter -----------------------------------------------------------

def _slots(keys: np.ndarray, seed: int, segment: int, segments: int):
    """Three slots of each key, in three consecutive segments, and its 8-bit
    fingerprint."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        g = mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A))
    begin = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    mask = segment - 1
    slots = np.stack([(begin + j) * segment
                      + ((g >> np.uint64(20 * j)) & np.uint64(mask)).astype(np.int64)
                      for j in range(3)])
    return slots, (h & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> dict:
    """A filter of distinct uint64 ``keys``: seed, segment length, number of
    first segments, fingerprints."""
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25), 2, 18))
    load = max(1.13, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 10)))
    segments = max(1, int(np.ceil(n * load / segment)) - 2)
    for seed in range(1, 200):
        size = (segments + 2) * segment
        slots, print_ = _slots(keys, seed, segment, segments)
        order = _peel(slots, size)
        if order is not None:
            return {"seed": seed, "segment": segment, "segments": segments,
                    "prints": _assign(slots, print_, order, size).tobytes()}
        if seed % 10 == 0:
            segments += max(1, segments // 10)
    raise RuntimeError("no seed lets the filter be built")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their free slots): in each, all slots that one key is
    left in. None if a core remains."""
    n = slots.shape[1]
    degree = np.bincount(slots.ravel(), minlength=size)
    owner = np.zeros(size, np.int64)  # xor of the keys left in a slot
    for j in range(3):
        np.bitwise_xor.at(owner, slots[j], np.arange(n))
    rounds, left = [], n
    free = np.flatnonzero(degree == 1)
    while len(free):
        key, where = np.unique(owner[free], return_index=True)
        rounds.append((key, free[where]))
        left -= len(key)
        touched = slots[:, key].ravel()
        np.subtract.at(degree, touched, 1)
        np.bitwise_xor.at(owner, touched, np.tile(key, 3))
        touched = np.unique(touched)
        free = touched[degree[touched] == 1]
    return rounds if left == 0 else None


def _assign(slots: np.ndarray, prints: np.ndarray, rounds: list, size: int) -> np.ndarray:
    table = np.zeros(size, np.uint8)
    for key, free in reversed(rounds):
        s = slots[:, key]
        table[free] = 0
        table[free] = prints[key] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
    return table


def probe(filter_: dict, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be a member (never False for a member)."""
    table = np.frombuffer(filter_["prints"], np.uint8)
    s, print_ = _slots(keys, int(filter_["seed"]), int(filter_["segment"]),
                       int(filter_["segments"]))
    return (table[s[0]] ^ table[s[1]] ^ table[s[2]]) == print_


# --- snapshots ------------------------------------------------------------

FIRST = ("keep_null", "keep_id", "keep_row", "n")


def _with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """With the digest's first 60 bits and its bucket."""
    key = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("bigint")
    return (df.withColumn("_k", F.coalesce(key, F.lit(0)))
            .withColumn("bucket", (F.col("_k") % buckets).cast("int")))


def _grouped(rows: DataFrame) -> DataFrame:
    """Distinct digests with their first row (smallest id, null last) and the
    number of rows: algebraic, so a hot digest is one row a task."""
    first = F.min(F.struct("keep_null", "keep_id", "keep_row"))
    return (rows.groupBy("digest").agg(first.alias("_first"), F.sum("n").alias("n"))
            .select("digest", "_first.*", "n"))


def build_snapshot(spark: SparkSession, groups: DataFrame, buckets: int) -> dict:
    """An immutable snapshot of distinct digests: its exact buckets and one
    filter for each bucket, both as files."""
    path = scratch_path(spark, "dedup-snapshot")
    _with_bucket(groups, buckets).repartition("bucket").write.parquet(f"{path}/exact")
    exact = spark.read.parquet(f"{path}/exact")

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        f = build_filter(rows.column("_k").to_numpy().astype(np.uint64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()),
                         "seed": pa.array([f["seed"]], pa.int32()),
                         "segment": pa.array([f["segment"]], pa.int32()),
                         "segments": pa.array([f["segments"]], pa.int32()),
                         "prints": pa.array([f["prints"]], pa.binary())})

    (exact.select("bucket", "_k").groupBy("bucket")
     .applyInArrow(build, "bucket int, seed int, segment int, segments int, prints binary")
     .write.parquet(f"{path}/filter"))
    return {"exact": exact, "filter": spark.read.parquet(f"{path}/filter"), "buckets": buckets}


def screen(incoming: DataFrame, snapshot: dict) -> DataFrame:
    """``incoming`` (distinct digests) with ``maybe``: what the snapshot's
    filter says. Bucket by bucket: a task holds one filter of bounded size."""
    rows = _with_bucket(incoming, snapshot["buckets"])
    names = incoming.columns

    def ask(keys: pa.Table, filters: pa.Table) -> pa.Table:
        maybe = (probe(filters.to_pylist()[0], keys.column("_k").to_numpy().astype(np.uint64))
                 if len(filters) else np.zeros(len(keys), bool))
        return keys.select(names).append_column("maybe", pa.array(maybe))

    return (rows.groupBy("bucket").cogroup(snapshot["filter"].groupBy("bucket"))
            .applyInArrow(ask, incoming.schema.add("maybe", "boolean")))


def take_in(batch: DataFrame, snapshots: list[dict], buckets: int):
    """Screens a batch's rows against all snapshots. Returns the digests that
    were known (or None) and the snapshot of the new ones."""
    rest, known = written(_grouped(batch), "dedup-batch"), None
    for snapshot in snapshots:
        screened = written(screen(rest, snapshot), "dedup-screened")
        maybe = screened.where("maybe").drop("maybe")
        exact = snapshot["exact"].select("digest")
        hit = maybe.join(exact, "digest", "left_semi")
        known = hit if known is None else known.unionByName(hit)
        rest = screened.where("not maybe").drop("maybe").unionByName(
            maybe.join(exact, "digest", "left_anti"))
    return known, build_snapshot(batch.sparkSession, rest, buckets)


def dedup(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id",
          text_col: str = "text", digest_bytes: int = DIGEST_BYTES,
          bucket_keys: int = BUCKET_KEYS,
          broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    The rows are taken in as ``batches`` batches (by hashed id), each against
    the snapshots of those before. ``digest_bytes`` may shorten the digest that
    groups rows (to try collisions); results stay exact by the byte check."""
    text = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(batches)).alias("batch"))
    rows = rows.select(
        "doc_id", "text_sha256", "batch",
        F.unhex(F.substring("text_sha256", 1, 2 * digest_bytes)).alias("digest"),
        F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "dedup-rows")
    marked = rows.select("digest", F.col("doc_id").isNull().alias("keep_null"),
                         F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"),
                         F.lit(1).cast("bigint").alias("n"), "batch")
    buckets = max(1, -(-rows.count() // bucket_keys))
    snapshots, parts = [], []
    for b in range(batches):
        known, snapshot = take_in(marked.where(F.col("batch") == b).drop("batch"), snapshots,
                                  buckets)
        snapshots.append(snapshot)
        parts += [p.select("digest", *FIRST) for p in (known, snapshot["exact"]) if p is not None]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    groups = written(_grouped(every), "dedup-groups")

    # One digest may hold many rows: a sort-merge join, whose skewed keys
    # adaptive execution splits.
    placed = rows.hint("merge").join(groups, "digest")
    several = groups.where("n > 1")
    collided = written(_collisions(docs, several, id_col, text_col, digest_bytes,
                                   broadcast_keys), "dedup-collisions")
    fixed = _by_text(collided)
    plain = (placed.join(fixed.select("digest").distinct(), "digest", "left_anti")
             .select("doc_id", "keep_id", F.col("n").alias("group_size"),
                     (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"))
    return plain.unionByName(fixed.drop("digest"))


def _texts(docs: DataFrame, several: DataFrame, id_col: str, text_col: str, digest_bytes: int,
           broadcast_keys: int) -> DataFrame:
    """(digest, doc_id, text) of the rows whose digest occurs twice or more, and
    the parts of that digest and the row's part. Up to ``broadcast_keys`` wanted digests are broadcast; more are joined by a
    shuffle."""
    text = normalised(F.col(text_col))
    hexed = F.substring(F.sha2(text.cast("binary"), 256), 1, 2 * digest_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), F.unhex(hexed).alias("digest"))
    wanted = several.select("digest", (F.floor(F.col("n") / PART_ROWS) + 1).alias("parts"))
    if several.count() <= broadcast_keys:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "digest").withColumn(
        "part", F.pmod(F.monotonically_increasing_id(), F.col("parts")))


def _collisions(docs, several, id_col, text_col, digest_bytes, broadcast_keys) -> DataFrame:
    """The byte check: every row of a group against the text of the row that
    stays. Returns (digest, doc_id, text) of all rows of digests that hold
    different texts; normally none."""
    texts = written(_texts(docs, several, id_col, text_col, digest_bytes, broadcast_keys),
                    "dedup-texts")
    keeper = several.select(F.col("digest").alias("_d"), "keep_id")
    # dealt by digest and id first, so the rows of one digest do not meet here
    stays = (texts.join(keeper, (F.col("digest") == F.col("_d"))
                        & F.col("doc_id").eqNullSafe(F.col("keep_id")))
             .groupBy("digest", "parts").agg(F.min("_t").alias("_kept_text"))
             .select("digest", "_kept_text",
                     F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
                     .alias("part")))
    differ = (texts.hint("merge").join(stays, ["digest", "part"]).where("_t != _kept_text")
              .select("digest").distinct())
    return texts.join(differ, "digest", "left_semi").select("digest", "doc_id", "_t")


def _by_text(collided: DataFrame) -> DataFrame:
    """Groups by the text itself, for rows of collided digests."""
    rows = collided.withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "dedup-by-text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"),
                           F.col("row").alias("c")))
    groups = (rows.groupBy(F.col("digest").alias("_d"), F.col("_t").alias("_text"))
              .agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size")))
    return (rows.join(groups, (F.col("digest") == F.col("_d")) & (F.col("_t") == F.col("_text")))
            .select("digest", "doc_id", F.col("_first.b").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("_first.c")).alias("kept"),
                    F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256")))
