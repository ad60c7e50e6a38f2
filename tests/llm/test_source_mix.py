"""Targets against plain water-filling; what the mix takes against the targets."""

from collections import Counter, defaultdict

import pytest
from conftest import SF_ORACLE
from fixtures_llm import docs_frame, read_docs, words

from gridload.llm import source_mix as M
from gridload.llm.queries import QUERIES


def targets(sizes):
    """By the rule: sources by code point, null last, weigh 5, 2, 1 ..."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        w = sum(weight[s] for s in rest)
        if not w:
            return fixed
        level = (total - sum(fixed.values())) / w
        above = [s for s in rest if weight[s] * level > 3 * sizes[s]]
        if not above:
            return {**fixed, **{s: weight[s] * level for s in rest}}
        fixed.update({s: 3.0 * sizes[s] for s in above})


def held_to_rules(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(words(text))
    want = targets(sizes)
    assert sorted(repr((r.doc_id, r.size)) for r in rows) == sorted(
        repr((d, len(words(t)))) for d, t, _ in docs)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.repetitions <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    return {s: (taken[s], want[s], largest[s]) for s in sizes}


def test_query_on_the_given_tables(spark):
    docs = [(d["doc_id"], d["text"], d["source"]) for d in read_docs(SF_ORACLE)]
    rows = QUERIES["op2_source_mix"](spark, SF_ORACLE).collect()
    for taken, target, _ in held_to_rules(rows, docs).values():
        assert taken == pytest.approx(target, rel=0.02)
    again = QUERIES["op2_source_mix"](spark, SF_ORACLE).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(spark, edge_dir):
    docs = [(d["doc_id"], d["text"], d["source"]) for d in read_docs(edge_dir)]
    rows = QUERIES["op2_source_mix"](spark, edge_dir).collect()
    for taken, target, largest in held_to_rules(rows, docs).values():
        assert abs(taken - target) <= largest


def test_clamped_sources_and_a_hot_one(spark, monkeypatch):
    """Tiny sources clamp one after the other; the hot source has a third of
    all rows and is cut into many ranges."""
    monkeypatch.setattr(M, "RANGE_ROWS", 7)
    docs = [(k, "w " * (1 + k % 9), "hot" if k % 3 == 0 else f"s{k % 5}") for k in range(600)]
    docs += [(1000, "a b c", "A"), (1001, "a", "B"), (1002, "a b", "Ä"), (1003, "one", None)]
    df = docs_frame(spark, [(i, t, "en", s) for i, t, s in docs]).repartition(6)
    rows = M.mix(df).collect()
    found = held_to_rules(rows, docs)
    assert found["A"][1] == 9.0 and found["A"][0] == 9  # clamped at three epochs
    for source, (taken, target, largest) in found.items():
        assert abs(taken - target) <= (3 if len(source or "") > 1 else largest)


def test_repeated_takes_whole_rows(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    mixed = M.mix(docs)
    out = M.repeated(docs, mixed)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id, r.source] += r.repetitions
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def test_empty(spark, empty_dir):
    assert QUERIES["op2_source_mix"](spark, empty_dir).collect() == []


def test_reruns_agree_when_ids_repeat(spark):
    """One id on most rows, sizes apart: the same rows in other orders and
    partitionings give the same mix."""
    rows = [(7 if k % 6 else k, " ".join(["w"] * (k % 37)), "ab"[k % 7 == 0]) for k in range(350)]
    rows += [(7, "same text here", "a")] * 40
    schema = "doc_id bigint, text string, source string"
    seen = []
    for parts, order in ((1, rows), (9, rows[::-1]), (4, sorted(rows, key=repr))):
        got = M.mix(spark.createDataFrame(order, schema).repartition(parts)).collect()
        seen.append(sorted((r.doc_id, r.source, r.size, r.repetitions, r.taken, r.target)
                           for r in got))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)
    taken = {s: sum(r[4] for r in seen[0] if r[1] == s) for s in "ab"}
    target = {s: next(r[5] for r in seen[0] if r[1] == s) for s in "ab"}
    assert all(abs(taken[s] - target[s]) <= 40 for s in "ab")


def test_shuffled_sources_give_the_same(spark, monkeypatch):
    rows = [(k, " ".join(["w"] * (k % 11)), "abc"[k % 3]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one = sorted(map(repr, M.mix(docs).collect()))
    monkeypatch.setattr(M, "bounded_broadcast", lambda df: (df, False))
    assert sorted(map(repr, M.mix(docs).collect())) == one
