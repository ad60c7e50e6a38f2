"""Conversation structure repair by a run-length dynamic program.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: an
optional system turn, then user and assistant in turn. Each row has at most one
fault, the first that holds of: blank (no letter but blanks), duplicate (role
and text seen before in the conversation), truncated (its last character that
is no blank is not one of ``.!?``). Edits: Keep (0), Rerole to user or assistant
(3), Delete (4; required for blank and duplicate rows), Insert an empty user or
assistant turn anywhere (3); a truncated row that is not deleted adds 3. The
cheapest edits are taken; of equally cheap ones those whose initials (D, I, K,
R) come first in ASCII.

The program has four states (start, after s, after u, after a). A row is one of
nine symbols (role s, u, a or other, truncated or not; or must go), a symbol a
4 x 4 min-plus matrix of the cheapest way over such a row, inserts before it
included. Equal neighbours are a run; a run is crossed by the cached binary
powers of its matrix. Going back over the runs gives the cost of the rest at
each run's end; going forward, the choices of each run are unrolled.

Conversations are numbered by one sort over all rows and cut into chunks of
``CHUNK`` rows. Of one that has several, a chunk's matrix is the product of its
runs; a pass back over the chunk matrices gives the cost after each chunk, a
pass forward the state before it. So no task holds more rows than a chunk, and
a conversation of a third of all rows is many chunks. Only the digest of a whole
conversation, one SHA-256 over its texts, is one stream through one task.

Rows: a null role or text is one space (so a null text is blank). Null turns
come first; rows of equal turn are in the order of the SHA-256 of role and text.
A null conv_id is a conversation of its own. Gaps beyond a long are the largest
long. Roles other than s, u, a must be
reroled or deleted. Other columns are ignored; an empty table gives an empty
result; very long texts pass row by row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from decimal import Decimal
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .ordering import batched, groups_of, numbered, places, sorted_by

CHUNK = 4096
INF = 1 << 60
# Costs, and the blanks of [^\x20\x09-\x0D].
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
STATES = range(4)
START, AFTER_S, AFTER_U, AFTER_A = STATES
ROLES = "sua"  # class 3: any other
MUST_GO = 8
_TURN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # state after a rerole or an insert
_KEEP = ({START: AFTER_S}, {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
         {AFTER_U: AFTER_A}, {})
ROLE_INTO = {AFTER_S: None, AFTER_U: "user", AFTER_A: "assistant"}


def _times(a, b):
    return tuple(tuple(min(min(a[s][k] + b[k][t] for k in STATES), INF) for t in STATES)
                 for s in STATES)


def _apply(a, v):
    return tuple(min(min(a[s][t] + v[t] for t in STATES), INF) for s in STATES)


IDENTITY = tuple(tuple(0 if s == t else INF for t in STATES) for s in STATES)


def _inserts():
    one = [[0 if s == t else INF for t in STATES] for s in STATES]
    for s in STATES:
        one[s][_TURN[s]] = min(one[s][_TURN[s]], INSERT)
    return functools.reduce(_times, [tuple(map(tuple, one))] * 3)


_CLOSURE = _inserts()
END = _apply(_CLOSURE, (0, INF, INF, 0))


@functools.cache
def step(symbol: int):
    """The matrix of one row, inserts before it included."""
    m = [[INF] * 4 for _ in STATES]
    for s in STATES:
        m[s][s] = DELETE
        if symbol != MUST_GO:
            role, extra = symbol // 2, TRUNCATED * (symbol % 2)
            m[s][_TURN[s]] = min(m[s][_TURN[s]], REROLE + extra)
            if s in _KEEP[role]:
                t = _KEEP[role][s]
                m[s][t] = min(m[s][t], extra)
    return _times(_CLOSURE, tuple(map(tuple, m)))


@functools.cache
def power(symbol: int, k: int):
    """The matrix of 2 ** k equal rows."""
    return step(symbol) if k == 0 else _times(power(symbol, k - 1), power(symbol, k - 1))


def runs_of(symbols: list[int]) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def cross(run: tuple[int, int], after):
    """The costs before a run, of those after it."""
    symbol, n = run
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = _apply(power(symbol, k), after)
    return after


def matrix(symbols: list[int]):
    out = IDENTITY
    for symbol, n in runs_of(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _times(out, power(symbol, k))
    return out


def unroll(symbols: list[int], state: int, after, last: bool):
    """The edits of the rows: lists of (row, letter, state after it) from
    ``state``, where ``after`` is the cost of what follows the rows; ``last``:
    nothing does. Returns the edits and the state they end in."""
    runs = runs_of(symbols)
    ends = [after]
    for run in reversed(runs):
        ends.append(cross(run, ends[-1]))
    ends.reverse()
    edits, row = [], 0
    for nth, (symbol, n) in enumerate(runs):
        costs = [ends[nth + 1]]
        one = step(symbol)
        for _ in range(n):
            costs.append(_apply(one, costs[-1]))
        role, extra = symbol // 2, TRUNCATED * (symbol % 2)
        for left in range(n, 0, -1):
            here, rest = costs[left], costs[left - 1]
            while True:
                best, turn = here[state], _TURN[state]
                if DELETE + rest[state] == best:
                    edits.append((row, "D", state))
                elif INSERT + here[turn] == best:
                    state = turn
                    edits.append((row, "I", state))
                    continue
                elif symbol != MUST_GO and state in _KEEP[role] and \
                        extra + rest[_KEEP[role][state]] == best:
                    state = _KEEP[role][state]
                    edits.append((row, "K", state))
                else:
                    state = turn
                    edits.append((row, "R", state))
                break
            row += 1
    while last and END[state]:
        state = _TURN[state]
        edits.append((row, "I", state))
    return edits, state


def faults(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The rows with ``initial``, ``fault`` ('blank', 'duplicate', 'truncated' or
    null), ``symbol``, and ``pos``, ``len``, ``chunk`` in their conversation;
    without the text, which stays in the second frame, both by ``at``."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv_id"), "turn", role.alias("role"),
                        text.alias("text")).select(
        "*", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"),
                            256)).alias("same"))
    rows, groups = numbered(rows, "conv_id", ["turn", "same"], "turns")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    light = rows.select("conv_id", "turn", "at", "same", F.left("role", F.lit(1)).alias("initial"),
                        (trimmed == "").alias("blank"),
                        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    placed = places(light, groups, "conv_id", "turn-parts")
    again = light.groupBy("conv_id", "same").agg(F.min("at").alias("seen_at"),
                                                 F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "seen_at")
    placed = placed.join(again, F.col("conv_id").eqNullSafe(F.col("_conv"))
                         & (F.col("same") == F.col("_same")), "left")
    fault = (F.when(F.col("blank"), "blank")
             .when(F.col("at") > F.col("seen_at"), "duplicate").when(F.col("cut"), "truncated"))
    kind = F.coalesce(*[F.when(F.col("initial") == c, k) for k, c in enumerate(ROLES)], F.lit(3))
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO)
              .when(F.col("fault") == "truncated", kind * 2 + 1).otherwise(kind * 2))
    marked = placed.select("conv_id", "turn", "at", "initial", fault.alias("fault"), "pos",
                           "len", F.expr(f"(pos - 1) div {CHUNK}").alias("chunk")).withColumn(
        "symbol", symbol.cast("int"))
    return written(marked, "turn-faults"), rows.select("at", "role", "text")


def _bounds(marked: DataFrame) -> DataFrame:
    """For the chunks of conversations that have several: the state before and
    the costs after each."""
    long = marked.where(F.col("len") > CHUNK).select(
        "conv_id", "chunk", "pos", "symbol")
    keys = [pa.int64(), pa.int64()]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((*key, [x for line in matrix(symbols) for x in line])
                        for key, (_, symbols) in groups_of(batches, 2)),
                       ["conv_id", "chunk", "m"], [*keys, pa.list_(pa.int64())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conv, after = object(), END
            for batch in batches:
                for c, chunk, m in zip(*(x.to_pylist() for x in batch.columns)):
                    after = END if c != conv else after
                    conv = c
                    yield c, chunk, list(after)
                    after = _apply([m[k:k + 4] for k in (0, 4, 8, 12)], after)
        return batched(rows(), ["conv_id", "chunk", "after"], [*keys, pa.list_(pa.int64())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((*key, [unroll(symbols, s, tuple(after[0]), False)[1] for s in STATES])
                        for key, (_, symbols, after) in groups_of(batches, 2)),
                       ["conv_id", "chunk", "ends"], [*keys, pa.list_(pa.int64())])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conv, state = object(), START
            for batch in batches:
                for c, chunk, end in zip(*(x.to_pylist() for x in batch.columns)):
                    state = START if c != conv else state
                    conv = c
                    yield c, chunk, state
                    state = end[state]
        return batched(rows(), ["conv_id", "chunk", "before"], [*keys, pa.int64()])

    whole = "conv_id bigint, chunk bigint, "
    m = sorted_by(long, ["conv_id", "chunk"], ["pos"]).mapInArrow(
        matrices, whole + "m array<bigint>")
    after = written(m.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"))
                    .mapInArrow(back, whole + "after array<bigint>"), "chunk-costs")
    ended = sorted_by(_with(long, after), ["conv_id", "chunk"], ["pos"]).select(
        "conv_id", "chunk", "pos", "symbol", "after").mapInArrow(ends, whole + "ends array<bigint>")
    before = sorted_by(ended, ["conv_id"], ["chunk"]).mapInArrow(forward, whole + "before bigint")
    return written(_with(after, before), "chunk-states")


def _with(rows: DataFrame, chunks: DataFrame, how: str = "inner") -> DataFrame:
    side = chunks.withColumnsRenamed({"conv_id": "_conv", "chunk": "_chunk"})
    return rows.join(side, F.col("conv_id").eqNullSafe(F.col("_conv"))
                     & (F.col("chunk") == F.col("_chunk")), how).drop("_conv", "_chunk")


def plan(marked: DataFrame) -> DataFrame:
    """The edits: conv_id, pos and nth (place; inserts stand before the row of
    their pos), ``at`` (the row, of an insert null), edit, new_role (of an edit
    that sets one), cost."""
    columns = ["conv_id", "chunk", "pos", "len", "at", "symbol", "before", "after"]
    rows = sorted_by(_with(marked, _bounds(marked), "left"), ["conv_id", "chunk"], ["pos"])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for key, (pos, size, at, symbols, before, after) in groups_of(batches, 2):
                last = pos[-1] == size[0]
                known = before[0] is not None
                done, _ = unroll(symbols, before[0] if known else START,
                                 tuple(after[0]) if known else END, last)
                nth = 0
                for row, edit, state in done:
                    if edit == "I":
                        yield (key[0], pos[0] + row, nth, None, edit, ROLE_INTO[state], INSERT)
                        nth += 1
                        continue
                    cut = symbols[row] != MUST_GO and symbols[row] % 2
                    yield (key[0], pos[row], nth, at[row], edit,
                           ROLE_INTO[state] if edit == "R" else None,
                           DELETE if edit == "D" else REROLE * (edit == "R") + TRUNCATED * cut)
                    nth = 0
        big = pa.int64()
        return batched(out(), ["conv_id", "pos", "nth", "at", "edit", "new_role", "cost"],
                       [big, big, big, big, pa.string(), pa.string(), big])

    return rows.select(*columns).mapInArrow(
        edits, "conv_id bigint, pos bigint, nth bigint, at bigint, edit string, "
               "new_role string, cost bigint")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(marked, repaired)``: the rows with their faults, and all edits in
    order (conv_id, pos, nth) with role and text of what stays: those of a
    deleted row are null."""
    marked, texts = faults(turns)
    todo = plan(marked)
    joined = todo.join(texts.withColumnRenamed("at", "_at"), F.col("at") == F.col("_at"), "left")
    stays = F.col("edit") != "D"
    return marked, joined.select(
        "conv_id", "pos", "nth", "edit", "cost",
        F.when(stays, F.coalesce("new_role", "role")).alias("role"),
        F.when(stays, F.coalesce("text", F.lit(""))).alias("text"))


def illegal_pairs(marked: DataFrame) -> DataFrame:
    """conv_id, illegal: neighbours whose initials are not su, ua or au. A chunk
    also sees the first row of the next one."""
    twice = F.when((F.col("pos") > 1) & ((F.col("pos") - 1) % CHUNK == 0),
                   F.array(F.col("chunk") - 1, F.col("chunk"))).otherwise(F.array("chunk"))
    rows = marked.select("conv_id", "pos", "initial", F.explode(twice).alias("chunk"))
    w = Window.partitionBy("conv_id", "chunk").orderBy("pos")
    pair = F.concat(F.lag("initial").over(w), "initial")
    return rows.select("conv_id", (~pair.isin("su", "ua", "au")).alias("bad")).groupBy(
        "conv_id").agg(F.count(F.when(F.col("bad"), 1)).alias("illegal"))


def audits(repaired: DataFrame) -> DataFrame:
    """conv_id, cost, audit, repaired_sha256 of each conversation with rows: its
    rows stream by in order, only the edits' letters are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conv, cost, letters, sha, first = object(), 0, [], None, True
            for batch in batches:
                for c, edit, price, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                    if sha is None or c != conv:
                        if sha is not None:
                            yield conv, cost, "".join(letters), sha.hexdigest()
                        conv, cost, letters, sha, first = c, 0, [], hashlib.sha256(), True
                    cost += price
                    letters.append(edit)
                    if edit != "D":
                        if not first:
                            sha.update(b"\n")
                        first = False
                        sha.update(f"{role}:{text}".encode())
            if sha is not None:
                yield conv, cost, "".join(letters), sha.hexdigest()
        return batched(rows(), ["conv_id", "cost", "audit", "repaired_sha256"],
                       [pa.int64(), pa.int64(), pa.string(), pa.string()], 1000)

    return sorted_by(repaired, ["conv_id"], ["pos", "nth"]).select(
        "conv_id", "edit", "cost", "role", "text").mapInArrow(
        run, "conv_id bigint, cost bigint, audit string, repaired_sha256 string")


def digest(ids: DataFrame, marked: DataFrame, repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``ids``, also those without rows."""
    span = (F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1
            - F.countDistinct("turn"))
    most = F.lit(Decimal(2**63 - 1))
    counts = marked.groupBy("conv_id").agg(
        F.coalesce(F.when(span > most, most).otherwise(span).cast("bigint"), F.lit(0)).alias(
            "gaps"),
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f)
          for f in ("blank", "duplicate", "truncated")])
    out = ids.select("conv_id").distinct()
    for part in (counts, illegal_pairs(marked), audits(repaired)):
        side = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
                      .alias("repaired_sha256"))


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the contract's damage, by crc32 of ``conv_id:turn`` modulo
    20: 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it,
    4 makes it the user's. Nulls are one space."""
    rows = conversations.select(
        "conv_id", "turn", _key("role").alias("role"), _key("text").alias("text"),
        (F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn")).cast("binary")) % 20)
        .alias("m"))
    rows = rows.where("m <> 0").withColumn(
        "copy", F.explode(F.when(F.col("m") == 3, F.array(F.lit(1), F.lit(2)))
                          .otherwise(F.array(F.lit(1)))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("m") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("m") == 1, "").when(
            F.col("m") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"))
