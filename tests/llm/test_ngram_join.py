"""The similarity join against all pairs in plain Python."""

import random
from itertools import combinations

import numpy as np
import pytest
from conftest import SF_SMALL
from fixtures_llm import docs_frame, read_docs, words

from gridload.llm import ngram_join as J
from gridload.llm.graph import components
from gridload.llm.queries import QUERIES


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, num, den):
    """(doc_id, n_shingles, component_id) of each row, by comparing all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)

    def name(i):
        known = [x for x in ids[find(i)] if x is not None]
        return min(known) if known else None

    return [(rows[i][0], len(sets[i]), name(i)) for i in range(len(rows))], len(ids)


def held_to_brute(got, rows, k, num, den):
    want, groups = brute(rows, k, num, den)
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == \
        sorted(map(repr, want))
    assert sum(r.first for r in got) == groups


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    """Families of near copies around the threshold, one of them large, exact
    copies, and a passage that unlike texts share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = family(rng, [f"a{i}" for i in range(60)], 60, 4)
    for f in range(8):
        texts += family(rng, [f"b{f}.{i}" for i in range(rng.randint(3, 80))], 6, 5)
    texts += [" ".join([f"u{j}.{i}" for i in range(40)] + passage) for j in range(40)]
    texts += [" ".join(passage)] * 3 + ["one two three"] * 4 + ["one two", "one", "", None, " \t"]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,k,num,den,salt", [(1, 4, 85, 100, 13), (2, 5, 80, 100, 13),
                                                 (3, 3, 60, 100, 1), (4, 1, 50, 100, 2)])
def test_no_link_is_lost(spark, small_batches, monkeypatch, seed, k, num, den, salt):
    """Also with lists salted from the second set on, over many small batches."""
    monkeypatch.setattr(J, "SALT_FROM", salt)
    rows = corpus(seed)
    df = docs_frame(spark, [(*r, "en", "a") for r in rows]).repartition(4)
    held_to_brute(J.join(df, k, num, den).collect(), rows, k, num, den)


def test_ids_to_fetch_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    rows = corpus(5)
    df = docs_frame(spark, [(*r, "en", "a") for r in rows])
    held_to_brute(J.join(df).collect(), rows, 4, 85, 100)


def test_query_on_given_and_odd_tables(spark, edge_dir):
    for sf in (SF_SMALL, edge_dir):
        rows = [(d["doc_id"], d["text"]) for d in read_docs(sf)]
        want, _ = brute(rows, 4, 85, 100)
        got = QUERIES["op5_ngram_jaccard"](spark, sf).collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_empty(spark, empty_dir):
    assert QUERIES["op5_ngram_jaccard"](spark, empty_dir).collect() == []


def test_parity_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 10, 300, 4000):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2],
                                      rng.integers(0, 1 << 62, n // 2, dtype=np.uint64)]))
        for x, y in ((a, b), (a, a[::3]), (a, np.concatenate([a, b + np.uint64(1 << 62)]))):
            differ = J.sketch_difference(J.parity_sketch(x), J.parity_sketch(y))
            assert differ <= len(np.setxor1d(x, y))
        assert J.sketch_difference(J.parity_sketch(a), J.parity_sketch(a)) == 0


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 180)]
    links = spark.createDataFrame(chain + star + [(7, 7), (300, 299)], "a bigint, b bigint")
    got = {r.v: r.c for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 180)},
                   299: 299, 300: 299}


def test_matches_sql_on_the_given_tables(spark):
    from conftest import SF_ORACLE
    from oracle_compare import compare

    from gridload.llm.oracle import ORACLE_SQL

    r = compare(spark, QUERIES["op5_ngram_jaccard"], ORACLE_SQL["op5_ngram_jaccard"], SF_ORACLE)
    assert r["columns_match"] and r["exact_match"], r
