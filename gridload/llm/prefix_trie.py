"""The trie of conversation prefixes, as a minimal-perfect-hash node table.

Every conversation is a path of turns (role, text) from the root; equal
prefixes are one node. For each node: its smallest member, its parent's, its
members, children and leaves, and the words saved when a prefix shared by
several conversations is stored once. The steps:

1. turns get their place in the conversation by one sort over all rows
   (:mod:`.ordering`), and paths are put together from them;
2. prefix digests: a turn's SHA-256, taken with its depth, is four 32-bit
   numbers; the sums of these up to a depth, hashed to 128 bits, are the
   prefix's key, and without the last turn its parent's. Sums can be cut
   anywhere: a long path is summed in blocks of ``BLOCK`` turns, the blocks'
   own sums carry over;
3. nodes: the distinct keys, counted with partial counts before the shuffle.
   All rows of a key must agree in parent key, turn and depth, or it raises: by
   induction equal keys are equal prefixes;
4. a node's weight is the number of turns of its members from it on, which is
   at least the size of its subtree. Nodes over a bound are heavy, with all
   their ancestors; what hangs below them are subtrees of bounded size, dealt
   to shards by the key of their top;
5. a shard gives its nodes slots by a minimal perfect hash, verified by the
   stored keys, scatters their counts into flat arrays by slot, looks up the
   slot of each node's parent and adds up through it, deepest first;
6. the heavy nodes take the sums of the tops below them and are added up the
   same way, in bands of depth of at most about ``SHARD_NODES`` nodes (one band,
   unless paths are very long).

Rows: null roles and texts are empty, null turns come first, rows of equal turn
are in the order of the SHA-256 of role and text. A null conv_id is a
conversation; it is no smallest member beside another and not listed in
``ends_sha256``. Other columns are ignored. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import WORD, written
from .ordering import batched, numbered, places

BLOCK = 4096
SHARD_NODES = 1 << 19
LEAST_BOUND = 256
IDS = 20_000  # ids of one piece of a node's list
KEY = ["k1", "k2"]


# ---- slots -----------------------------------------------------------------

def _spread(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
    h = k1.view(np.uint64) ^ np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + k2.view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class Slots:
    """A minimal perfect hash of distinct 128-bit keys: on each level the keys
    that are alone in their cell are placed, in the order of the cells; the rest
    go to the next. ``of`` verifies a slot by the key stored there."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.levels, left, start = [], np.arange(len(k1)), 0
        slot = np.full(len(k1), -1, np.int64)
        while len(left):
            if len(self.levels) == 100:
                raise ValueError("keys repeat")
            size = max(2, len(left) * 3 // 2)
            cell = _spread(k1[left], k2[left], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.where(alone, start + np.cumsum(alone) - 1, -1)
            self.levels.append(rank)
            slot[left] = rank[cell]
            start += int(alone.sum())
            left = left[~alone[cell]]
        self.slot = slot
        self.k1, self.k2 = np.empty_like(k1), np.empty_like(k2)
        self.k1[slot], self.k2[slot] = k1, k2

    def of(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 of keys that are not there."""
        out, left = np.full(len(k1), -1, np.int64), np.arange(len(k1))
        for level, rank in enumerate(self.levels):
            found = rank[_spread(k1[left], k2[left], level, len(rank))]
            out[left] = found
            left = left[found < 0]
        known = out >= 0
        known[known] = (self.k1[out[known]] == k1[known]) & (self.k2[out[known]] == k2[known])
        return np.where(known, out, -1)


def accumulate(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves, saved words of nodes and the row of each one's parent
    (-1: elsewhere), in the order given. ``t`` has keys, parents' keys, depth,
    n_convs, words and what is known from below: children, leaves, saved."""
    slots = Slots(t["k1"], t["k2"])
    slot, n = slots.slot, len(t["k1"])
    parent = np.empty(n, np.int64)
    parent[slot] = slots.of(t["p1"], t["p2"])
    depth, children, leaves, saved, row = (np.empty(n, np.int64) for _ in range(5))
    for array, name in ((depth, "depth"), (children, "children"), (leaves, "leaves"),
                        (saved, "saved")):
        array[slot] = t[name]
    row[slot] = np.arange(n)
    own = np.empty(n, np.int64)
    own[slot] = (t["n_convs"] - 1) * t["words"]
    saved += own
    inside = parent >= 0
    np.add.at(children, parent[inside], 1)
    leaves[children == 0] = 1
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []:
        level = level[inside[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    of = parent[slot]
    return {"children": children[slot], "leaves": leaves[slot], "saved": saved[slot],
            "parent": np.where(of >= 0, row[of], -1)}


# ---- paths -----------------------------------------------------------------

def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``: the turns as digest and number of words, with their
    place ``pos``; the conversations with their ``len``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("same"))
    rows, groups = numbered(rows, "conv_id", ["turn", "same"], "trie-turns")
    placed = places(rows, groups, "conv_id", "trie-parts")
    return (written(placed.select("conv_id", "pos", "words", "same"), "trie-places"),
            groups.select("conv_id", "len"))


def spliced(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's paths: of conversation c the first h turns of c - c % 20,
    then its own after its first h (h: crc32 of c modulo 4). ``(paths, ends)``:
    conv_id, depth, words, same; conv_id and depth of the path's end."""
    base = (F.col("conv_id") - F.col("conv_id") % 20).alias("base")
    h = F.when(F.col("conv_id") % 20 != 0, F.crc32(
        F.col("conv_id").cast("string").cast("binary")) % 4)
    convs = groups.select("conv_id", "len", base, F.coalesce(h, F.lit(0)).alias("h"))
    other = groups.select(F.col("conv_id").alias("_base"), F.col("len").alias("_len"))
    convs = written(convs.join(other, F.col("base") == F.col("_base"), "left").select(
        "conv_id", "base", "h", "len",
        F.least("h", F.coalesce("_len", F.lit(0))).alias("taken")), "trie-convs")
    side = convs.select(F.col("conv_id").alias("_conv"), "h", "taken")
    own = rows.join(side, F.col("conv_id").eqNullSafe(F.col("_conv"))).where(
        F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "words", "same")
    heads = rows.where((F.col("pos") <= 3) & (F.col("conv_id") % 20 == 0)).withColumnRenamed(
        "conv_id", "_base")
    taken = convs.where("taken > 0").join(heads, (F.col("base") == F.col("_base"))
                                          & (F.col("pos") <= F.col("taken"))).select(
        "conv_id", F.col("pos").alias("depth"), "words", "same")
    return own.unionByName(taken), convs.select(
        "conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("len") - F.col("h")))
        .cast("bigint").alias("end"))


def _keys(depth: Column, sums: list[Column], names: list[str]) -> list[Column]:
    return [F.xxhash64(F.lit(k), depth, *sums).alias(name) for k, name in enumerate(names, 1)]


def prefixes(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for every conversation and depth, the root's too: its key and its
    parent's, the turn (t1, t2, words), conv_id, depth and end."""
    side = ends.withColumnRenamed("conv_id", "_conv")
    rows = paths.join(side, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    here = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("same")), 256)
    lanes = [F.conv(F.substring(here, at, 8), 16, 10).cast("bigint").alias(f"e{k}")
             for k, at in enumerate((1, 9, 17, 25))]
    rows = rows.select("conv_id", "depth", "end", "words", "same", *lanes,
                       F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, 0)
    blocks = rows.where(F.col("end") > BLOCK).groupBy("conv_id", "block").agg(
        *[F.sum(f"e{k}").alias(f"b{k}") for k in range(4)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = blocks.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
                          *[F.sum(f"b{k}").over(before).alias(f"c{k}") for k in range(4)])
    rows = rows.withColumns({f"s{k}": F.sum(f"e{k}").over(w) for k in range(4)}).join(
        carry, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")),
        "left")
    sums = [F.col(f"s{k}") + F.coalesce(f"c{k}", F.lit(0)) for k in range(4)]
    less = [s - F.col(f"e{k}") for k, s in enumerate(sums)]
    rows = rows.select("conv_id", "depth", "end", "words", *_keys(F.col("depth"), sums, KEY),
                       *_keys(F.col("depth") - 1, less, ["p1", "p2"]),
                       *_keys(F.lit(0), [F.col("same")], ["t1", "t2"]))
    none = F.lit(0).cast("bigint")
    roots = ends.select("conv_id", none.alias("depth"), "end", none.alias("words"),
                        *_keys(none, [none] * 4, KEY),
                        *[none.alias(c) for c in ("p1", "p2", "t1", "t2")])
    return written(rows.unionByName(roots), "trie-prefixes")


# ---- nodes -----------------------------------------------------------------

def distinct_nodes(rows: DataFrame) -> DataFrame:
    fixed = ["p1", "p2", "t1", "t2", "depth", "words"]
    agree = F.lit(True)
    for c in fixed:
        agree = agree & (F.col(f"{c}_a") == F.col(f"{c}_z"))
    found = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("end") - F.col("depth") + 1).alias("weight"),
        *[F.min(c).alias(f"{c}_a") for c in fixed], *[F.max(c).alias(f"{c}_z") for c in fixed])
    depth = F.when(agree, F.col("depth_a")).otherwise(
        F.raise_error(F.lit("two prefixes have one key")).cast("bigint"))
    return written(found.select(*KEY, "conv_id", "n_convs", "weight", depth.alias("depth"),
                                *[F.col(f"{c}_a").alias(c) for c in ("p1", "p2", "words")]),
                   "trie-nodes")


SUMS = "children bigint, leaves bigint, saved bigint"


def _summed(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """The nodes of each partition added up; ``keep`` are columns passed on,
    ``up`` is the parent's conv_id where the partition has it (else null)."""
    need = [*KEY, "p1", "p2", "depth", "n_convs", "words", "children", "leaves", "saved"]
    schema = ", ".join(f"{c} bigint" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        got = accumulate({c: table[c].to_numpy() for c in need})
        inside = got["parent"] >= 0
        up = table["conv_id"].take(pa.array(np.where(inside, got["parent"], 0)))
        up = pa.compute.if_else(pa.array(inside), up, pa.scalar(None, pa.int64()))
        out = table.select(keep)
        for name in ("children", "leaves", "saved"):
            out = out.append_column(name, pa.array(got[name]))
        out = out.append_column("inside", pa.array(inside)).append_column("up", up)
        yield from out.to_batches(max_chunksize=20_000)

    return nodes.select(*dict.fromkeys([*need, *keep])).mapInArrow(
        run, f"{schema}, {SUMS}, inside boolean, up bigint")


def node_table(rows: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens of every node."""
    spark = rows.sparkSession
    nodes = distinct_nodes(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = nodes.count()
    bound = min(shard_nodes, max(LEAST_BOUND, count // (4 * parts)))
    shards = max(parts, -(-2 * count // shard_nodes))

    is_heavy = (F.col("weight") > bound) | (F.col("depth") == 0)
    heavy = nodes.where(is_heavy)
    over = heavy.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                        F.col("conv_id").alias("parent_conv_id"))
    heavy = written(heavy.join(over, ["p1", "p2"], "left"), "trie-heavy")

    # the deepest heavy node of each path, and the top of what hangs there
    known, small = bounded_broadcast(heavy.select(
        *KEY, F.col("depth").alias("h_depth"), F.col("conv_id").alias("h_conv")))
    hit = rows.select("conv_id", *KEY).join(known if small else known.hint("merge"), KEY)
    deepest = hit.groupBy("conv_id").agg(F.max(F.struct("h_depth", *KEY, "h_conv")).alias("h"))
    deepest = deepest.select(F.col("conv_id").alias("_conv"), "h.h_depth", "h.h_conv",
                             F.col("h.k1").alias("h1"), F.col("h.k2").alias("h2"))
    tops = rows.select("conv_id", "depth", F.col("k1").alias("top1"),
                       F.col("k2").alias("top2")).join(
        deepest, F.col("conv_id").eqNullSafe(F.col("_conv"))
        & (F.col("depth") == F.col("h_depth") + 1)).select("_conv", "top1", "top2", "h1", "h2",
                                                           "h_conv")
    zero = {c: F.lit(0).cast("bigint") for c in ("children", "leaves", "saved")}
    light = nodes.where(~is_heavy).join(
        tops, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumns(zero)
    keep = [*KEY, "conv_id", "depth", "n_convs"]
    low = written(_summed(light.repartition(shards, "top1", "top2"),
                          [*keep, "top1", "top2", "h1", "h2", "h_conv"]), "trie-light")
    is_top = (F.col("k1") == F.col("top1")) & (F.col("k2") == F.col("top2"))
    held = F.when(F.col("inside") == is_top, F.raise_error(F.lit("a node without its parent"))
                  .cast("bigint")).when(is_top, F.col("h_conv")).otherwise(F.col("up"))
    done = [low.select(*keep, held.alias("parent_conv_id"), "children", "leaves", "saved")]
    below = [low.where(is_top).groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"))]

    for first, last in _bands(heavy, shard_nodes):
        added = below[0]
        for more in below[1:]:
            added = added.unionByName(more)
        added = added.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(
            *[F.sum(c).alias(c) for c in zero])
        band = heavy.where(F.col("depth").between(first, last)).join(added, KEY, "left").withColumns(
            {c: F.coalesce(c, F.lit(0)) for c in zero})
        got = written(_summed(band.coalesce(1), [*keep, "p1", "p2", "parent_conv_id"]),
                      "trie-band")
        done.append(got.select(*keep, "parent_conv_id", *zero))
        below.append(got.where(~F.col("inside")).groupBy(
            F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
            F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnsRenamed({"children": "n_children", "leaves": "n_leaves",
                                   "saved": "saved_tokens"})


def _bands(heavy: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of depth, deepest first, of about ``most`` heavy nodes at most."""
    deepest = heavy.agg(F.max("depth")).collect()[0][0]
    if deepest is None:
        return []
    width = deepest // 10_000 + 1
    sizes = heavy.groupBy(F.expr(f"depth div {width}").alias("b")).count().collect()
    bands, held = [], 0
    for b, n in sorted(((r["b"], r["count"]) for r in sizes), reverse=True):
        first, last = b * width, (b + 1) * width - 1
        if bands and held + n <= most:
            bands[-1], held = (first, bands[-1][1]), held + n
        else:
            bands.append((first, last))
            held = n
    return bands


def ends_digest(rows: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes where paths end: SHA-256 of their conv_ids,
    ascending. Lists are written as text in pieces, wherever they lie in the
    sorted rows; one stream of pieces ends in each digest."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ended = rows.where((F.col("depth") == F.col("end")) & F.col("conv_id").isNotNull()).select(
        *KEY, "conv_id").repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(
        *KEY, "conv_id")
    big = pa.int64()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            key, ids = None, []
            for batch in batches:
                for k1, k2, c in zip(*(x.to_pylist() for x in batch.columns)):
                    if ids and ((k1, k2) != key or len(ids) == IDS):
                        yield *key, ids[0], ",".join(map(str, ids))
                        ids = []
                    key = (k1, k2)
                    ids.append(c)
            if ids:
                yield *key, ids[0], ",".join(map(str, ids))
        return batched(out(), [*KEY, "first", "ids"], [big, big, big, pa.string()], 500)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            key, sha = None, None
            for batch in batches:
                for k1, k2, text in zip(*(x.to_pylist() for x in batch.columns)):
                    if (k1, k2) == key:
                        sha.update(b",")
                    else:
                        if sha:
                            yield *key, sha.hexdigest()
                        key, sha = (k1, k2), hashlib.sha256()
                    sha.update(text.encode())
            if sha:
                yield *key, sha.hexdigest()
        return batched(out(), [*KEY, "ends_sha256"], [big, big, pa.string()])

    text = ended.mapInArrow(pieces, "k1 bigint, k2 bigint, first bigint, ids string")
    return text.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(
        *KEY, "ids").mapInArrow(hashed, "k1 bigint, k2 bigint, ends_sha256 string")


def trie(paths: DataFrame, ends: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, depth, words, same) that end
    as ``ends`` (conv_id, end) says."""
    rows = prefixes(paths, ends)
    nodes = node_table(rows, shard_nodes)
    return nodes.join(ends_digest(rows), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
        .alias("ends_sha256"))
