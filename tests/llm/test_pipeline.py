"""The pipeline's stages: order, columns, decisions, and odd rows."""

from collections import Counter

import corpus_pipeline as P
from conftest import SF_SMALL
from fixtures_llm import ALNUM, CLASHES, docs_frame, read_docs, words

from gridload.llm import filtering
from gridload.llm.common import written
from gridload.llm.queries import QUERIES
from llm.test_ngram_join import brute as near_copies
from llm.test_token_output import held_to_brute


def test_stages_and_registration(spark):
    import __spark_entry__ as E

    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_jaccard", "decontaminate",
                                        "source_mix", "token_output"]
    assert P.ORACLE_SQL is None and E.queries()["pipeline"] is P.run
    assert set(QUERIES) <= set(E.queries())
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def stage(spark, name, docs, sf_dir):
    return written(dict(P.STAGES)[name](spark, docs, sf_dir), f"test-{name}")


def windows(items, size=10):
    out = set()
    for text in items:
        w = words(text, ALNUM)
        out |= {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1)) if w}
    return out


def leaks(text, found):
    w = words(text, ALNUM)
    return any(tuple(w[k:k + n]) in found for n in {len(x) for x in found}
               for k in range(len(w) - n + 1))


def run_and_hold(spark, sf_dir, docs, items):
    """Every stage on its own input, against brute force."""
    told = stage(spark, "language_id", docs, sf_dir)
    assert told.columns == docs.columns
    all_rows = Counter(map(tuple, docs.collect()))
    kept = Counter(map(tuple, told.collect()))
    assert kept <= all_rows
    assert not [r for r in kept if not any(c.isalpha() for c in (r[1] or ""))]
    if sf_dir == SF_SMALL:  # enough to learn from: clean documents stay
        assert not [r for r in all_rows - kept if any(c.isalpha() for c in (r[1] or ""))]

    first = stage(spark, "ngram_jaccard", told, sf_dir)
    rows = [(r.doc_id, r.text) for r in told.collect()]
    _, groups = near_copies(rows, 5, 80, 100)
    assert first.columns == docs.columns and first.count() == groups
    assert Counter(map(tuple, first.collect())) <= kept
    _, apart = near_copies([(r.doc_id, r.text) for r in first.collect()], 5, 80, 100)
    assert apart == groups  # no two of them link

    clean = stage(spark, "decontaminate", first, sf_dir)
    found = windows(items)
    want = Counter(tuple(r) for r in first.collect() if not leaks(r.text, found))
    assert clean.columns == docs.columns and Counter(map(tuple, clean.collect())) == want

    mixed = stage(spark, "source_mix", clean, sf_dir)
    assert mixed.columns == docs.columns
    times = Counter(map(tuple, mixed.collect()))
    assert set(times) <= set(want) and all(times[r] <= 3 * want[r] for r in times)
    n = sum(len(words(r.text)) for r in clean.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - n) <= 0.1 * n + 50

    tokens = stage(spark, "token_output", mixed, sf_dir).collect()
    held_to_brute(tokens, [(r.doc_id, r.text) for r in mixed.collect()])


def test_every_stage_on_given_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    run_and_hold(spark, SF_SMALL, docs, items)


def test_every_stage_on_odd_rows(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{edge_dir}/benchmark.parquet").collect()]
    run_and_hold(spark, edge_dir, docs, items)


def test_run_is_the_stages_one_after_the_other(spark):
    got = P.run(spark, SF_SMALL).collect()
    assert sorted(got[0].asDict()) == ["doc_id", "ids_crc32", "n_tokens", "start"]
    known = {d["doc_id"] for d in read_docs(SF_SMALL)}
    assert {r.doc_id for r in got} <= known and max(Counter(r.doc_id for r in got).values()) <= 3
    assert sorted(map(tuple, P.run(spark, SF_SMALL).collect())) == sorted(map(tuple, got))


def test_empty(spark, empty_dir):
    assert P.run(spark, empty_dir).collect() == []


def test_filters_tell_texts_of_one_id_apart(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (3, None), (3, None)]
    docs = docs_frame(spark, [(*r, "en", "s") for r in rows])
    key = filtering.text_key(docs["text"])
    drop = docs.where("text = 'b' or text = 'd'").select("doc_id", key)
    left = filtering.without(docs, drop)
    assert left.columns == docs.columns and set(CLASHES) <= set(left.columns)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        [(1, "a"), (2, "c"), (3, None), (3, None)], key=repr)
    decided = docs.select("doc_id", key).selectExpr(
        "doc_id", "text_key", "row_number() over (partition by doc_id, text_key order by 1) = 1 "
        "AS first")
    first = filtering.only_first(docs, decided)
    assert sorted(((r.doc_id, r.text) for r in first.collect()), key=repr) == sorted(
        [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], key=repr)


def test_a_lost_bound_gives_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before = stage(spark, "ngram_jaccard", docs, SF_SMALL)
    monkeypatch.setattr(filtering, "BROADCAST_ROWS", 0)
    after = stage(spark, "ngram_jaccard", docs, SF_SMALL)
    assert sorted(before.collect()) == sorted(after.collect())
