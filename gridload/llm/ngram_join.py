"""Similarity join of word shingles (Jaccard) with a token-group matrix.

Exact: no link between different texts is lost. Sizes below are for sets of
``n`` shingles and a similarity of ``num / den``.

1. *Order.* All shingles are counted into ``CELLS`` cells of their hashes; the
   order of a set is by the magnitude of the cell's count, then by hash. Rare
   shingles come first, so passages that many documents share come last.
2. *Sets.* Equal sets are one class. Two similar sets share one of their first
   ``n - ceil(n * num / den) + 1`` shingles (prefix), and their first common
   one leaves enough shingles behind it on both sides for the overlap needed.
3. *Groups.* In the list of a prefix shingle the set that has it earliest
   leads; the others are compared to the leader. Sets linked that way are one
   group: the partition into groups of similar documents.
4. *Token-group matrix.* For each shingle and group: the sizes of the group's
   sets that have it, and how much at most is left behind it. A set of another
   group is held against that row: if no set of the group can reach the overlap
   needed, the group stays closed. Only qualifying groups are opened, and their
   sets with that shingle compared. Sets of one group are not compared again,
   as they are in one component already.
   Lists of two sets hold no other pair than the leader's and are left out.
5. *Comparing.* Parity sketches of two bits a shingle or more bound the
   difference of two sets from below; what they cannot rule out is compared
   shingle by shingle.

Lists of very frequent shingles are salted by their magnitude, and the leaders
of the parts led by one of them, so no list is one task's. Groups as large as
the corpus cost a comparison to a leader a set, not all pairs.

Edge cases: null and blank texts have an empty set and no link; fewer words
than a shingle are one shingle; repeated rows and equal texts are one class;
null ids never name a component unless all its ids are null; empty tables give
no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import intermediates, slices, utf8, written
from .graph import components
from .words import mix, shingles, words

CELL_BITS = 22
CELLS = 1 << CELL_BITS
PARTS = 64  # of the table of cells
SKETCH_BITS = (512, 1 << 17)  # least and most bits of a sketch
SALT_FROM = 13  # magnitudes (powers of two) above this are salted
BROADCAST_IDS = 1_000_000


def overlap_needed(na, nb, num: int, den: int):
    """Least number of common shingles of two sets that link."""
    return -(-num * (na + nb) // (num + den))


def _sets(batch: pa.RecordBatch, column: int, k: int):
    data, offsets = utf8(batch.column(column))
    for a, b in slices(offsets):
        _, value, first = words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        yield a, b, shingles(value, first, k)


def magnitudes(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """The order's table: for each cell the bit length of its count. ``CELLS``
    bytes, whatever the data."""
    shift = np.uint64(64 - CELL_BITS)
    part = CELLS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, sets in _sets(batch, 0, k):
                cells = np.concatenate([np.zeros(0, np.uint64), *sets]) >> shift
                if len(cells) > CELLS // 8:
                    total += np.bincount(cells.astype(np.int64), minlength=CELLS)
                else:
                    np.add.at(total, cells.astype(np.int64), 1)
        pieces = [zlib.compress(total[p * part:(p + 1) * part].astype("<u4").tobytes(), 1)
                  for p in range(PARTS)]
        yield pa.record_batch([pa.array(range(PARTS), pa.int32()),
                               pa.array(pieces, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(part, np.int64), None
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = p
                total += np.frombuffer(zlib.decompress(raw), "<u4")
        if number is not None:
            bits = np.frexp(total.astype(np.float64))[1].astype(np.uint8)
            yield pa.record_batch([pa.array([number], pa.int32()),
                                   pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())],
                                  ["part", "counts"])

    kind = "part int, counts binary"
    rows = (docs.select(text_col).mapInArrow(count, kind)
            .repartitionById(PARTS, F.col("part")).mapInArrow(add, kind).collect())
    table = np.zeros(CELLS, np.uint8)
    for r in rows:
        table[r["part"] * part:(r["part"] + 1) * part] = np.frombuffer(
            zlib.decompress(r["counts"]), np.uint8)
    return table


def parity_sketch(values: np.ndarray) -> bytes:
    """One bit for each cell that an odd number of the set's hashes fall in, in
    twice as many cells as the set is large, or more (a power of two within
    ``SKETCH_BITS``)."""
    least, most = SKETCH_BITS
    bits = min(max(least, 1 << (2 * len(values) - 1).bit_length()), most)
    cell = (mix(values) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=bits) & 1).tobytes()


def sketch_difference(x: bytes, y: bytes) -> int:
    """At most the size of the sets' symmetric difference. The longer sketch is
    folded: the parities of cells that fall together add up."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def signatures(docs: DataFrame, table: np.ndarray, k: int, num: int, den: int,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_key, row, n, digest of the set (null if empty),
    sketch, prefix (hashes in order) and the prefix's magnitudes; written."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    shift = np.uint64(64 - CELL_BITS)
    names = ["n", "digest", "sketch", "prefix", "levels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for a, b, sets in _sets(batch, 2, k):
                out = []
                for s in sets:
                    n = len(s)
                    if not n:
                        out.append((0, None, None, None, None))
                        continue
                    own = level[(s >> shift).astype(np.int64)]
                    order = np.argsort(own, kind="stable")[:n - -(-num * n // den) + 1]
                    out.append((n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                                parity_sketch(s), s[order].tobytes(), own[order].tobytes()))
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array([o[0] for o in out], pa.int64()),
                     *(pa.array([o[j] for o in out], pa.binary()) for j in range(1, 5))],
                    ["doc_id", "text_key", *names])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)), F.col(text_col))
    out = rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, n bigint, digest binary, "
                          "sketch binary, prefix binary, levels binary")
    return written(out.withColumn("row", F.monotonically_increasing_id()), "shingle-signatures")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")


def _classes(sigs: DataFrame) -> DataFrame:
    """(digest, cid, first_row, doc_id): one row for each distinct set; kept
    for the block around the running one. ``cid``
    numbers it; ``first_row`` is the row with the smallest id, null last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"),
                           F.col("row").alias("r")))
    groups = sigs.where("n > 0").groupBy("digest").agg(first.alias("_f"))
    return written(groups.select("digest", F.monotonically_increasing_id().alias("cid"),
                                 F.col("_f.r").alias("first_row"),
                                 F.col("_f.d").alias("doc_id")), "shingle-classes", keep=True)


def _firsts(sigs: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """These columns of the first row of each class, with its cid, digest and
    doc_id. Both sides grow with the input: a sort-merge join at every size."""
    return (sigs.select("row", *columns).hint("merge")
            .join(classes, F.col("row") == F.col("first_row")).drop("row", "first_row"))


ENTRY = "token bigint, salt int, cid bigint, n int, pos int, level int"


def _entries(reps: DataFrame) -> DataFrame:
    """One row for each prefix shingle of each class, salted if frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            tokens, _ = utf8(batch.column(2))
            level, at = utf8(batch.column(3))
            size = np.diff(at)
            owner = np.repeat(np.arange(len(cid)), size)
            salts = np.int64(1) << np.clip(level.astype(np.int64) - SALT_FROM, 0, 20)
            own = (mix(cid.astype(np.uint64)) & np.uint64(0xFFFFF)).astype(np.int64)[owner]
            yield pa.record_batch(
                [pa.array(tokens.view("<i8")), pa.array((own % salts).astype(np.int32)),
                 pa.array(cid[owner]), pa.array(n[owner].astype(np.int32)),
                 pa.array((np.arange(len(owner)) - np.repeat(at[:-1], size)).astype(np.int32)),
                 pa.array(level.astype(np.int32))],
                ["token", "salt", "cid", "n", "pos", "level"])

    return reps.select("cid", "n", "prefix", "levels").mapInArrow(run, ENTRY)


LED = ("token bigint, cid bigint, n int, pos int, leader bigint, leader_n int, leader_pos int, "
       "third boolean")


def _led(entries: DataFrame, salted: bool) -> DataFrame:
    """Lists with two sets or more, each row with its list's leader and whether
    it is the third of its list or later. Rows come sorted, so a list streams
    through its task and only its leader is kept. With ``salted``, also the
    only rows of salted lists (all of which count as third)."""
    keys = ["token", "salt"] if salted else ["token"]
    ranked = entries.repartition(*keys).sortWithinPartitions(*keys, "pos", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the running list's leader: token, salt, cid, n, pos, level, told, rows
        for batch in batches:
            if not batch.num_rows:
                continue
            token, salt, cid, n, pos, level = (batch.column(i).to_numpy() for i in range(6))
            same = np.zeros(len(token), bool)
            same[1:] = token[1:] == token[:-1]
            if salted:
                same[1:] &= salt[1:] == salt[:-1]
            rows = []
            if last is not None:
                same[0] = token[0] == last[0] and (not salted or salt[0] == last[1])
            first = np.maximum.accumulate(np.where(same, -1, np.arange(len(token))))
            carried = first < 0
            alone = np.concatenate([~same[1:], [False]]) & ~same if len(token) else same
            show = ~alone
            if salted:
                show |= level > SALT_FROM
            if not same[-1]:
                show[-1] = salted and level[-1] > SALT_FROM
            if last is not None and same[0] and not last[6]:
                rows.append([np.array([x]) for x in (*(last[j] for j in (0, 2, 3, 4, 2, 3, 4)),
                                                     False)])
            at = np.flatnonzero(show)
            lead = np.maximum(first[at], 0)
            own = [np.where(carried[at], last[j] if last is not None else 0, c[lead])
                   for j, c in ((2, cid), (3, n), (4, pos))]
            nth = np.arange(len(token)) + np.where(carried, last[7] if last is not None else 0,
                                                   -first)
            third = (nth >= 2) | (salted & (level > SALT_FROM))
            rows.append([token[at], cid[at], n[at], pos[at], *own, third[at]])
            if first[-1] < 0:
                last = (*last[:6], True, last[7] + len(token))
            else:
                k = int(first[-1])
                last = (token[k], salt[k], cid[k], n[k], pos[k], level[k], bool(show[k]),
                        len(token) - k)
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32, bool)
            yield pa.record_batch(
                [pa.array(np.concatenate([r[j] for r in rows]).astype(kind))
                 for j, kind in enumerate(kinds)],
                ["token", "cid", "n", "pos", "leader", "leader_n", "leader_pos", "third"])

    return ranked.mapInArrow(run, LED)


def _can_link(na, pa_, nb, pb, num: int, den: int) -> Column:
    """Whether two sets may link whose first common shingle stands at these
    places of these sizes."""
    need = F.ceil((F.lit(num) * (na + nb)).cast("bigint") / F.lit(num + den))
    return ((F.lit(den) * F.least(na, nb) >= F.lit(num) * F.greatest(na, nb))
            & (F.least(na - pa_, nb - pb) >= need))


def _pairs(rows: DataFrame) -> DataFrame:
    return (rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .where("a != b").distinct())


def _named(pairs: DataFrame) -> DataFrame:
    """The classes that stand in these pairs."""
    return pairs.select(F.col("a").alias("cid")).unionByName(
        pairs.select(F.col("b").alias("cid"))).distinct()


def _only(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is one of ``ids`` (a written table of one
    column). Up to ``BROADCAST_IDS`` ids are broadcast; more are joined by a
    shuffle."""
    few = ids.count() <= BROADCAST_IDS
    ids = ids.toDF("_wanted")
    return rows.join(F.broadcast(ids) if few else ids,
                     F.col(column).eqNullSafe(F.col("_wanted")), "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int,
              id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes that link. Only sketches and sets of classes
    with a pair are moved."""
    named = written(_named(pairs), "classes-paired")
    reps = _only(reps, named, "cid")
    side = {s: reps.select(F.col("cid").alias(s), F.col("n").alias(f"n{s}"),
                           F.col("sketch").alias(f"s{s}")) for s in "ab"}
    sketched = pairs.join(side["a"], "a").join(side["b"], "b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            differ = np.array([sketch_difference(x.as_buffer(), y.as_buffer())
                               for x, y in zip(batch.column(4), batch.column(5))])
            ok = differ <= na + nb - 2 * overlap_needed(na, nb, num, den)
            yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    maybe = written(sketched.select("a", "b", "na", "nb", "sa", "sb")
                    .mapInArrow(bound, "a bigint, b bigint"), "pairs-possible")
    wanted = written(_named(maybe).join(reps.select("cid", "digest", "doc_id"), "cid"),
                     "sets-wanted")
    sets = _fetch(docs, wanted, k, id_col, text_col)
    left = maybe.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                ok[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(
                pa.array(ok))

    return written(both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint"),
                   "links")


def _fetch(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, set) of the wanted classes, made again from their documents."""
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    rows = _only(rows, wanted.select("doc_id").distinct(), "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in _sets(batch, 0, k):
                raw = [s.tobytes() for s in sets if len(s)]
                yield pa.record_batch(
                    [pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw],
                              pa.binary()), pa.array(raw, pa.binary())], ["digest", "set"])

    made = rows.select("text").mapInArrow(run, "digest binary, set binary")
    # an id may stand for several texts: the digest says which is meant, and as
    # it names the class, one shuffle serves the join and the repeated rows
    found = made.join(wanted.select("digest", "cid"), "digest")
    return written(found.dropDuplicates(["digest"]).select("cid", "set"), "sets")


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_key, row, n_shingles, component (a number, null
    for empty sets), component_id (its smallest doc_id), first (whether the row
    is the component's first, by id, then row)."""
    spark = docs.sparkSession
    with intermediates(spark):
        with intermediates(spark):  # the prefixes go once the lists are written
            sigs = signatures(docs, magnitudes(docs, k, text_col), k, num, den, id_col, text_col)
            classes = _classes(sigs)
            rows = written(sigs.select("doc_id", "text_key", "row", "n", "digest"),
                           "shingle-rows", keep=True)
            reps = written(_firsts(sigs, classes, "n", "sketch"), "shingle-reps", keep=True)
            led = _led(_entries(_firsts(sigs, classes, "n", "prefix", "levels")), True)
            live = written(led, "prefix-lists", keep=True)
        # the parts of salted lists: their leaders are led by one of them
        heads = (live.where("cid = leader and third")
                 .select("token", F.lit(0).alias("salt"), "cid", "n", "pos", F.lit(0).alias("level")))
        stars = live.unionByName(_led(heads, False)).where("cid != leader")
        near = stars.where(_can_link(F.col("n"), F.col("pos"), F.col("leader_n"),
                                     F.col("leader_pos"), num, den))
        tried = written(_pairs(near.select(F.col("cid").alias("x"), F.col("leader").alias("y"))),
                        "pairs-leaders")
        links = _verified(tried, docs, reps, k, num, den, id_col, text_col)
        opened = _opened(live, components(links), num, den)
        more = written(_pairs(opened).join(tried, ["a", "b"], "left_anti"), "pairs-opened")
        links = links.unionByName(_verified(more, docs, reps, k, num, den, id_col, text_col))
        return written(_labelled(rows, classes, components(links)), "similar", keep=True)


def _opened(live: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """The token-group matrix at work: pairs (x, y) of sets of different groups
    to compare, from the groups that qualify."""
    sizes = groups.groupBy(F.col("c").alias("g")).agg(F.count(F.lit(1)).alias("members"))
    longer = live.where("third").select("token").distinct()
    named = (live.select("token", "cid", "n", "pos").join(longer, "token", "left_semi")
             .join(groups, live["cid"] == groups["v"], "left")
             .withColumn("g", F.coalesce("c", "cid")).drop("v", "c")
             .join(sizes, "g", "left").withColumn("members", F.coalesce("members", F.lit(1))))
    named = written(named, "lists-grouped")
    matrix = named.groupBy("token", "g", "members").agg(
        F.min("n").alias("low"), F.max("n").alias("high"),
        F.max(F.col("n") - F.col("pos")).alias("reach"))
    several = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("_g")).where("_g > 1")
    matrix = written(matrix.join(several.select("token"), "token", "left_semi"),
                     "token-group-matrix")
    q, m = named.alias("q"), matrix.alias("m")
    n = F.col("q.n")
    least = F.greatest(F.col("m.low").cast("bigint"), F.ceil(F.lit(num) * n / F.lit(den)))
    most = F.least(F.col("m.high").cast("bigint"), F.floor(F.lit(den) * n / F.lit(num)))
    need = F.ceil(F.lit(num) * (n + least) / F.lit(num + den))
    # the set of the smaller group asks, so a large group asks nothing of small ones
    asks = (F.struct("q.members", "q.g") < F.struct("m.members", "m.g"))
    qualified = q.join(m, F.col("q.token") == F.col("m.token")).where(
        asks & (least <= most)
        & (F.least(n - F.col("q.pos"), F.col("m.reach")) >= need))
    asked = qualified.select(F.col("q.token").alias("token"), F.col("m.g").alias("g"),
                             F.col("q.cid").alias("x"), n.alias("xn"),
                             F.col("q.pos").alias("xp"))
    there = named.select("token", "g", F.col("cid").alias("y"), F.col("n").alias("yn"),
                         F.col("pos").alias("yp"))
    return (asked.join(there, ["token", "g"])
            .where(_can_link(F.col("xn"), F.col("xp"), F.col("yn"), F.col("yp"), num, den)))


def _labelled(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    named = (classes.join(labels, classes["cid"] == labels["v"], "left")
             .select("digest", "doc_id", "first_row", F.coalesce("c", "cid").alias("component")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"),
                           F.col("first_row").alias("r")))
    heads = named.groupBy("component").agg(first.alias("_f"))
    of = written(named.select("digest", "component").join(heads, "component")
                 .select(F.col("digest").alias("_digest"), "component",
                         F.col("_f.d").alias("_id"), F.col("_f.r").alias("_row")),
                 "shingle-components")
    # many rows may have one digest: a sort-merge join, split where it is skewed
    linked = rows.where("n > 0").hint("merge").join(of, F.col("digest") == F.col("_digest"))
    empty = rows.where("n = 0").select(
        "doc_id", "text_key", "row", F.col("n").alias("n_shingles"),
        F.lit(None).cast("bigint").alias("component"), F.col("doc_id").alias("component_id"),
        F.lit(True).alias("first"))
    return linked.select(
        "doc_id", "text_key", "row", F.col("n").alias("n_shingles"), "component",
        F.col("_id").alias("component_id"), (F.col("row") == F.col("_row")).alias("first")
    ).unionByName(empty)
