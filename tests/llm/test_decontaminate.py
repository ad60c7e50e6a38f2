"""Phrase and proximity matches against a scan of every window."""

import hashlib

import pytest
from conftest import SF_SMALL
from fixtures_llm import ALNUM, ITEM, docs_frame, read_docs, words

from gridload.llm import decontaminate as D
from gridload.llm.queries import QUERIES


def brute(docs, items, window=10):
    windows = {}
    for item_id, text in items:
        w = words(text, ALNUM)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).add(
                "" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text, ALNUM), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                names = windows.get(tuple(w[k:k + size]))
                if names:
                    hit.update(range(k, k + size))
                    found |= names
        out.append((doc_id, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def places_near(text, window, start, slop):
    """Whether the window's words have places of their own, each at most
    ``slop`` behind its place from ``start``."""
    taken = -1
    used = {}
    for k, word in enumerate(window):
        at = [p for p in range(max(0, start + k), min(len(text), start + k + slop + 1))
              if text[p] == word and p > used.get(word, taken)]
        if not at:
            return False
        used[word] = at[0]
    return True


def near_items(docs, items, window=10, slop=D.NEAR):
    """(doc_id, number of items with a proximity match)."""
    out = []
    for doc_id, text in docs:
        w, found = words(text, ALNUM), set()
        for item_id, item in items:
            t = words(item, ALNUM)
            spans = [t[k:k + window] for k in range(max(1, len(t) - window + 1))] if t else []
            if any(set(x) <= set(w) and any(places_near(w, x, b, slop)
                                            for b in range(-slop, len(w)))
                   for x in spans):
                found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(found)))
    return sorted(map(repr, out))


def test_near_items_of_the_query(spark, edge_dir):
    for sf in (SF_SMALL, edge_dir):
        docs = [(d["doc_id"], d["text"]) for d in read_docs(sf)]
        got = QUERIES["op10_decontaminate"](spark, sf).select("doc_id", "n_near", "n_items").collect()
        assert sorted(repr((r.doc_id, r.n_near)) for r in got) == near_items(docs, read_items(sf))
        assert all(r.n_near >= r.n_items for r in got)


def test_near_items_with_words_between_repeated_and_swapped(spark):
    w = ITEM.split()[:10]
    docs = [(1, " ".join([*w[:5], "x", *w[5:]])), (2, " ".join([*w[:3], "x", "y", "z", *w[3:]])),
            (3, " ".join([w[1], w[0], *w[2:]])), (4, "a a b"), (5, "a b"), (6, "a x y a b")]
    items = [(1, " ".join(w)), (2, "a a b"), (2, "a a b")]
    found = D.digest(D.decontaminate(docs_frame(spark, [(*d, "en", "a") for d in docs]),
                                     spark.createDataFrame(items, "item_id int, text string"),
                                     slop=D.NEAR))
    got = {r.doc_id: (r.n_items, r.n_near) for r in found.collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (0, 1), 4: (1, 1), 5: (0, 0), 6: (0, 1)}
    assert sorted(repr((k, n)) for k, (_, n) in got.items()) == near_items(docs, items)


def digests(df):
    return sorted(repr(tuple(r)) for r in df.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def read_items(sf):
    import pyarrow.parquet as pq

    return [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]


def test_query_on_given_and_odd_tables(spark, edge_dir, small_batches):
    for sf in (SF_SMALL, edge_dir):
        docs = [(d["doc_id"], d["text"]) for d in read_docs(sf)]
        want = brute(docs, read_items(sf))
        assert digests(QUERIES["op10_decontaminate"](spark, sf)) == want
        assert any("True" in w for w in want)


def test_a_benchmark_in_several_blocks_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    docs = [(k, f"x{k} " + ITEM * (k % 3) + f" a{k} b{k} one two") for k in range(30)]
    items = [(1, ITEM), (2, "one two"), (3, ITEM[4:]), (3, "one two"), (9, "not there at all")]
    found = D.decontaminate(docs_frame(spark, [(*d, "en", "a") for d in docs]),
                            spark.createDataFrame(items, "item_id int, text string"),
                            query_words=5)
    assert digests(D.digest(found)) == brute(docs, items)


def test_matches_name_their_words_and_do_not_cross_texts(spark):
    w = ITEM.split()
    docs = [(1, " ".join(["a", "b", *w[2:14], "c"])), (2, " ".join(w[:5])), (3, " ".join(w[5:12]))]
    items = spark.createDataFrame([(7, ITEM)], "item_id int, text string")
    got = {r.doc_id: r for r in D.decontaminate(
        docs_frame(spark, [(*d, "en", "a") for d in docs]), items).collect()}
    assert [tuple(m) for m in got[1].matches] == [("7", 2, 14, 0)]
    assert got[2].matches == [] and got[3].matches == []


@pytest.mark.parametrize("slop,kinds", [(0, {1: 0}), (1, {1: 0, 2: 1}), (4, {1: 0, 2: 1, 3: 4})])
def test_proximity(spark, slop, kinds):
    docs = [(1, "x alpha beta gamma y"), (2, "x alpha beta z gamma y"),
            (3, "alpha z z beta z z gamma"), (4, "alpha beta")]
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id int, text string")
    found = D.decontaminate(docs_frame(spark, [(*d, "en", "a") for d in docs]), items, slop=slop)
    assert {r.doc_id: min(m.slack for m in r.matches)
            for r in found.collect() if r.matches} == kinds


def test_empty(spark, empty_dir, edge_dir):
    assert QUERIES["op10_decontaminate"](spark, empty_dir).collect() == []
    none = spark.createDataFrame([], "item_id int, text string")
    found = D.decontaminate(spark.read.parquet(f"{edge_dir}/documents.parquet"), none)
    assert all(r.matches == [] for r in found.collect())


def test_matches_sql_on_the_given_tables(spark):
    from conftest import SF_ORACLE
    from oracle_compare import compare

    from gridload.llm.oracle import ORACLE_SQL

    r = compare(spark, QUERIES["op10_decontaminate"], ORACLE_SQL["op10_decontaminate"], SF_ORACLE)
    assert r["columns_match"] and r["exact_match"], r


def block_of(texts):
    import numpy as np

    value = np.array([ord(c) for t in texts for c in t], np.uint64)
    first = np.cumsum([0] + [len(t) for t in texts])
    order = np.argsort(value, kind="stable")
    terms, begin = np.unique(value[order], return_index=True)
    return D.Block(first.astype("<i8").tobytes(), terms.astype("<u8").tobytes(),
                   np.append(begin, len(value)).astype("<u4").tobytes(),
                   order.astype("<u4").tobytes())


def near(texts, window, slop):
    """The least slack of each text."""
    import numpy as np

    block, out = block_of(texts), {}
    at, size = block.lookup(np.array([ord(c) for c in window], np.uint64))
    if size.min() > 0:
        for text, start, end, slack in zip(*(x.tolist() for x in block.find(at, size, slop))):
            assert block.first[text] <= start < end <= block.first[text + 1]
            out[text] = min(slack, out.get(text, slack))
    return out


def near_brute(texts, window, slop):
    from itertools import permutations

    out = {}
    for n, text in enumerate(texts):
        for places in permutations(range(len(text)), len(window)):
            if all(text[p] == c for p, c in zip(places, window)):
                off = [p - k for k, p in enumerate(places)]
                if max(off) - min(off) <= slop:
                    out[n] = min(out.get(n, slop), max(off) - min(off))
    return out


def test_proximity_beyond_the_nearest_posting():
    assert near(["1Rxxx12"], "R12", 3) == {0: 3}
    assert near(["ab", "xbca"], "abc", 2) == near_brute(["ab", "xbca"], "abc", 2)
    assert near(["a"], "aa", 1) == {} and near(["axa"], "aa", 1) == {0: 1}


def test_proximity_against_all_places():
    import random

    rng = random.Random(4)
    for _ in range(400):
        texts = ["".join(rng.choices("abcx", k=rng.randint(0, 7))) for _ in range(3)]
        window = "".join(rng.choices("abc", k=rng.randint(1, 4)))
        slop = rng.randint(0, 4)
        assert near(texts, window, slop) == near_brute(texts, window, slop), (texts, window, slop)
