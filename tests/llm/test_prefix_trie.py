"""The prefix trie: slots, sums, whole results against plain Python and SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF_ORACLE
from oracle_compare import compare

from gridload.llm import prefix_trie as P
from gridload.llm.oracle import ORACLE_SQL
from gridload.llm.queries import QUERIES

LONG = "word " * 100_000


def rebuilt(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        own[conv].append((turn, role or "", text or ""))
    for rows in own.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(
            f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    own = {c: [r[1:] for r in rows] for c, rows in own.items()}
    out = {}
    for c, rows in own.items():
        base = None if c is None else c - int(np.fmod(c, 20))
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        out[c] = rows if base in (c, None) else own.get(base, [])[:h] + rows[h:]
    return out


def expected(turns):
    members, children = defaultdict(list), defaultdict(set)
    paths = rebuilt(turns)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                children[tuple(path[:d - 1])].add(tuple(path[:d]))

    def least(node):
        return min((c for c in members[node] if c is not None), default=None)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if c is not None and len(paths[c]) == len(node))
        out.append((least(node), len(node), least(node[:-1]) if node else None, len(convs),
                    len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(repr, out))


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, 2, "x") for r in rows],
        "conv_id bigint, turn bigint, role string, text string, depth int, k1 int, same string")


def result(spark, rows, **kw):
    got = P.trie(*P.spliced(*P.turns(frame(spark, rows))), **kw)
    return sorted(repr(tuple(r)) for r in got.collect())


TURNS = [
    (0, 0, "user", "a b c"), (0, 1, "assistant", "d e"), (0, 2, "user", "f"),
    (1, 0, "user", "x"), (1, 1, "user", "y"), (2, 0, "user", "one"), (3, 0, "user", "one"),
    (4, None, None, None), (4, 0, "user", ""), (5, 0, "user", "a b c"), (5, 0, "user", "a b c"),
    (21, 0, "user", "no base"), (22, 0, "user", "no base"), (25, 0, None, "t"),
    (-3, 0, "user", "minus"), (-20, 0, "user", "base of minus"), (None, 0, "user", "a b c"),
    (None, 1, "assistant", "d e"), (40, 0, "u", "ser x"), (60, 0, "us", "er x"), (80, 0, "user", LONG),
    (100, 0, "user", LONG), (2**62 - 2**62 % 20, 0, "user", "a b c"), (-2**63, 3, "ü", "漢 字"),
]


def random_turns(seed, convs=90, longest=7, texts=3):
    rnd = random.Random(seed)
    return [(c, k if rnd.random() > 0.1 else None, rnd.choice(["user", "assistant"]),
             rnd.choice(["a b", "c", "", None, "d e f"][:texts]))
            for c in range(-convs // 3, convs) for k in range(rnd.randrange(longest))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 50_000])
def test_slots_are_minimal_and_verified(n):
    rng = np.random.default_rng(n)
    k1, k2 = (rng.integers(-2**63, 2**63 - 1, n) for _ in range(2))
    k1[: n // 2] = 7  # half of them differ in one part only
    slots = P.Slots(k1, k2)
    assert sorted(slots.slot.tolist()) == list(range(n))
    assert (slots.of(k1, k2) == slots.slot).all()
    assert (slots.of(k1, k2 ^ 1) == -1).all()


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError, match="repeat"):
        P.Slots(np.array([1, 1]), np.array([2, 2]))


@pytest.mark.parametrize("rows", [TURNS, random_turns(1), random_turns(2, 60, 12, 2)])
def test_matches_brute_force(spark, rows):
    assert result(spark, rows) == expected(rows)


def test_bounds_change_nothing(spark, monkeypatch, small_batches):
    """Small shards, several bands of heavy nodes, paths of many blocks, pieces
    of few ids."""
    monkeypatch.setattr(P, "BLOCK", 3)
    monkeypatch.setattr(P, "IDS", 4)
    monkeypatch.setattr(P, "LEAST_BOUND", 2)
    rows = random_turns(3, 60, 6, 2) + [(500, k, "user", f"t{k % 5}") for k in range(120)] + [
        (501 + j, 0, "user", "the same") for j in range(60)]
    assert result(spark, rows, shard_nodes=10) == expected(rows)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(P, "bounded_broadcast", lambda df: (df, False))
    assert result(spark, TURNS) == expected(TURNS)


def test_a_collision_is_noticed(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1, 2, 5, 6, 0, 0, 7, 7), (2, 1, 1, 2, 5, 6, 0, 0, 8, 8)],
        "conv_id bigint, depth bigint, end bigint, words bigint, k1 bigint, k2 bigint, p1 bigint, "
        "p2 bigint, t1 bigint, t2 bigint")
    with pytest.raises(Exception, match="one key"):
        P.distinct_nodes(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_matches_sql_on_the_given_tables(spark):
    r = compare(spark, QUERIES["op13_prefix_trie"], ORACLE_SQL["op13_prefix_trie"], SF_ORACLE)
    assert r["columns_match"] and r["exact_match"] and r["spark_rows"] > 0, r
