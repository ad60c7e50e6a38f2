"""Conversation repair: the program against exhaustive search, whole results
against plain Python and SQL, conversations of many chunks."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from conftest import SF_ORACLE
from oracle_compare import compare

from gridload.llm import repair as R
from gridload.llm.oracle import ORACLE_SQL
from gridload.llm.queries import QUERIES

GOOD = re.compile(r"(s?(ua)+)?")
LONG = "word " * 100_000 + "end."


def search(rows):
    """(cost, audit, repaired) by best-first search over (cost, audit): rows are
    (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, "\n".join(out)
        state = (i, "" if not roles else roles[-1], roles == "s")
        if state in done:
            continue
        done.add(state)

        def push(more, letter, at, role, text):
            new = roles + (role[:1] if role is not None else "")
            if role is None or any(GOOD.fullmatch(new + t) for t in ("", "a", "ua")):
                heapq.heappush(heap, (cost + more, audit + letter, at, new,
                                      out if role is None else (*out, f"{role}:{text}")))

        for role in ("user", "assistant"):
            push(3, "I", i, role, "")
        if i < len(rows):
            role, text, fault = rows[i]
            push(4, "D", i + 1, None, "")
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1]:
                    push(extra, "K", i + 1, role, text)
                for new in ("user", "assistant"):
                    push(3 + extra, "R", i + 1, new, text)


def expected(turns):
    """The contract's row for each conversation of (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(key.encode()) % 20
        if m == 0:
            continue
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        rows += [(turn, "user" if m == 4 else role, text)] * (1 + (m == 3))
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(
            f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen else
                     "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        turn = {r[0] for r in rows} - {None}
        count = {f: sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        cost, audit, text = search(marked)
        gaps = min(max(turn) - min(turn) + 1 - len(turn), 2**63 - 1) if turn else 0
        out.append((conv, gaps, count["blank"],
                    count["duplicate"], count["truncated"],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


TURNS = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"),
    (2, None, "system", "Be kind."), (2, 0, "user", "A?"), (2, 0, "user", "B?"),
    (2, 5, "tool", "out."), (2, 7, "assistant", "cut"), (2, 9, None, None),
    (3, None, None, None), (4, 1, "", "no role."), (4, 2, "User", "capital."),
    (None, 0, "user", "nobody."), (None, None, "assistant", "still."), (None, 3, "user", "x"),
    (5, 0, "assistant", LONG), (5, 1, "assistant", LONG), (5, 1, "assistant", LONG),
    (6, 2, "user", " \t\r\n\x0b\x0c"), (6, 3, "user", " "), (6, 4, "assistant", "end. "),
    (7, -3, "system", "a."), (7, -2, "system", "b."), (7, 4, "system", "c."),
    (8, 1, "usher", "role that only begins alike."), (8, 2, "a", "short."), (8, 2, "a", "short."),
    (9, -(2**63), "user", "far."), (9, 2**63 - 1, "assistant", "apart."),
    (10, 1, "assistant", ".\x01\n?"), (10, 2, "ü", "ünï."), (10, 2, "user", "漢字!"),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "k", 1, "x") for r in rows],
        "conv_id bigint, turn bigint, role string, text string, pos string, at int, same string")


def random_turns(seed, conversations=40, longest=9):
    rnd = random.Random(seed)
    return [(c, rnd.choice([None, *range(longest)]) if rnd.random() < 0.2 else k,
             rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None]),
             rnd.choice(["One.", "Two!", "three", "", None, "Four?", f"n{k}."]))
            for c in range(conversations) for k in range(rnd.randrange(longest))]


def result(spark, rows):
    turns = frame(spark, rows)
    got = R.digest(turns, *R.repair(R.damaged(turns)))
    return sorted(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("seed", range(6))
def test_unroll_is_the_cheapest_and_least(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        symbols = [rnd.randrange(9) for _ in range(rnd.randrange(9))]
        names = ["system", "user", "assistant", "tool"]
        rows = [(names[s // 2], "t", "truncated" if s % 2 else "") if s < 8 else
                ("user", "t", "blank") for s in symbols]
        cost, audit, text = search(rows)
        edits, _ = R.unroll(symbols, R.START, R.END, True)
        assert "".join(e[1] for e in edits) == audit
        out = R.matrix(symbols)
        assert min(out[R.START][t] + R.END[t] for t in R.STATES) == cost


def test_chunks_compose():
    rnd = random.Random(4)
    symbols = [s for _ in range(30) for s in [rnd.randrange(9)] * rnd.randrange(1, 40)]
    whole, _ = R.unroll(symbols, R.START, R.END, True)
    for size in (1, 7, 64):
        parts = [symbols[k:k + size] for k in range(0, len(symbols), size)]
        after = [R.END]
        for p in reversed(parts):
            after.append(R._apply(R.matrix(p), after[-1]))
        after = after[-2::-1]
        state, letters = R.START, ""
        for k, p in enumerate(parts):
            edits, state = R.unroll(p, state, after[k], k == len(parts) - 1)
            letters += "".join(e[1] for e in edits)
        assert letters == "".join(e[1] for e in whole)


@pytest.mark.parametrize("rows", [TURNS, random_turns(1), random_turns(2)])
def test_matches_brute_force(spark, rows):
    assert result(spark, rows) == expected(rows)


def test_long_conversations_are_chunks(spark, monkeypatch, small_batches):
    monkeypatch.setattr(R, "CHUNK", 3)
    rows = random_turns(3, 30, 40) + [(77, k, "user" if k % 3 else "assistant", f"t{k}.")
                                      for k in range(300)] + [(None, k, "user", "same.")
                                                              for k in range(50)]
    assert result(spark, rows) == expected(rows)


@pytest.mark.parametrize("rows,want", [
    # insert + keep + delete = 7; reroled first it would be 3 + 4 + 3
    ([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "")],
     [("I", "user", ""), ("K", "assistant", "Hi."), ("D", None, None)]),
    # rerole + truncated + delete = 10; inserted first it would be 3 + 4 + 4
    ([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "cut"), (1, 2, "assistant", "")],
     [("R", "user", "Hi."), ("K", "assistant", "cut"), ("D", None, None)])])
def test_repaired_rows(spark, rows, want):
    _, repaired = R.repair(frame(spark, rows))
    got = [(r.edit, r.role, r.text) for r in repaired.orderBy("pos", "nth").collect()]
    assert got == want


def test_empty_table(spark):
    assert result(spark, []) == []


def test_rows_all_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert result(spark, [(5, turn, "user", "x.")]) == [
        repr((5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))]


def test_matches_sql_on_the_given_tables(spark):
    name = "op11_conversation_repair"
    r = compare(spark, QUERIES[name], ORACLE_SQL[name], SF_ORACLE)
    assert r["columns_match"] and r["exact_match"] and r["spark_rows"] > 0, r
