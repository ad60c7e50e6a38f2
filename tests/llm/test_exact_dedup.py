"""Filters, digest collisions, and whole results against grouping by text."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF_ORACLE
from fixtures_llm import DOCS, docs_frame
from oracle_compare import compare

from gridload.llm import exact_dedup as D
from gridload.llm.oracle import ORACLE_SQL
from gridload.llm.queries import QUERIES


def normalised(text):
    return re.sub("[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normalised(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[normalised(text)]
        known = [i for i in ids if i is not None]
        out.append((doc_id, min(known) if known else None, len(ids),
                    hashlib.sha256(normalised(text).encode()).hexdigest()))
    return sorted(map(repr, out)), len(groups)


def held_to_brute(got, rows):
    want, n_groups = brute(rows)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n_groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_has_every_member_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
    made = D.build_filter(np.concatenate([keys, keys]))
    assert D.probe(made, keys).all()
    others = rng.integers(1 << 60, 1 << 61, 20_000, dtype=np.uint64)
    assert D.probe(made, others).mean() < 0.02
    if n > 1000:
        assert len(made["prints"]) < 1.3 * n


def test_matches_sql_on_the_given_tables(spark):
    r = compare(spark, QUERIES["op9_exact_dedup"], ORACLE_SQL["op9_exact_dedup"], SF_ORACLE)
    assert r["columns_match"] and r["exact_match"], r


@pytest.mark.parametrize("digest_bytes,broadcast", [(32, 500_000), (1, 500_000), (1, 0), (0, 0)])
def test_odd_rows_and_colliding_digests(spark, digest_bytes, broadcast):
    """With a digest of one byte (or none) different texts collide: the byte
    check must tell them apart."""
    rows = [r[:2] for r in DOCS] + [(100 + k, f"text {k % 40}") for k in range(300)]
    df = docs_frame(spark, [(*r, "en", "a") for r in rows]).repartition(3)
    held_to_brute(D.dedup(df, digest_bytes=digest_bytes, broadcast_keys=broadcast,
                          bucket_keys=50).collect(), rows)


def test_a_hot_digest_in_many_parts(spark, monkeypatch):
    """The copies of one text, and colliding texts, over parts of a few rows."""
    monkeypatch.setattr(D, "PART_ROWS", 7)
    rows = [(k % 150 if k % 5 else None, "hot" if k % 3 else f"text {k % 9}") for k in range(400)]
    df = docs_frame(spark, [(*r, "en", "a") for r in rows]).repartition(5)
    for digest_bytes in (32, 0):
        held_to_brute(D.dedup(df, digest_bytes=digest_bytes).collect(), rows)


@pytest.mark.parametrize("batches", [1, 5])
def test_number_of_batches_does_not_matter(spark, batches):
    rows = [(k, f"same {k % 7}" if k % 3 else "hot") for k in range(120)]
    df = docs_frame(spark, [(*r, "en", "a") for r in rows])
    held_to_brute(D.dedup(df, batches=batches).collect(), rows)


def test_empty(spark, empty_dir):
    assert QUERIES["op9_exact_dedup"](spark, empty_dir).collect() == []
