"""Word hashes and shingles against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import ALNUM, LONG, WORD, thue_morse
from fixtures_llm import words as plain
from hypothesis import given, settings
from hypothesis import strategies as st

from gridload.llm import words as W
from gridload.llm.common import slices, utf8

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ0é漢 \t\n\x00.", max_size=40)),
                 min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS, piece=st.sampled_from([5, 17, 1 << 20]))
def test_words_are_the_patterns_words(texts, piece):
    data, offsets = utf8(pa.array(texts, pa.string()))
    before, W.PIECE = W.PIECE, piece
    try:
        for separator, pattern in ((W.BLANKS, WORD), (W.NO_ALNUM, ALNUM)):
            _, value, first = W.words(data, offsets, separator)
            want = [plain(t, pattern) for t in texts]
            assert np.diff(first).tolist() == [len(w) for w in want]
            seen = {}
            for w, h in zip([w for ws in want for w in ws], value.tolist()):
                assert seen.setdefault(w, h) == h
            assert len(set(seen.values())) == len(seen)
    finally:
        W.PIECE = before


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingles_are_distinct_windows(k):
    texts = ["a b c d e f", "a b", "", None, "a a a a a a a", LONG]
    data, offsets = utf8(pa.array(texts, pa.string()))
    _, value, first = W.words(data, offsets)
    sets = W.shingles(value, first, k)
    for text, got in zip(texts, sets):
        w = plain(text)
        want = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()


def test_slices_cover_all_rows_once():
    offsets = np.array([0, 5, 5, 30, 31, 31, 90, 90])
    for limit in (1, 10, 31, 1000):
        parts = list(slices(offsets, limit))
        assert [r for a, b in parts for r in range(a, b)] == list(range(7))


def test_utf8_of_sliced_and_chunked_columns():
    whole = pa.chunked_array([pa.array(["a", None]), pa.array(["bc", "d"])])
    for column in (whole, pa.array(["zz", "a", None, "bc", "d"]).slice(1),
                   pa.array(["a", None, "bc", "d"], pa.large_string())):
        data, offsets = utf8(column)
        assert bytes(data) == b"abcd" and offsets.tolist() == [0, 1, 1, 3, 4]
    assert utf8(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("letters", [64, 256, 1024, 4096])
def test_no_pattern_of_letters_collides(letters):
    data, offsets = utf8(pa.array([*thue_morse(letters), *thue_morse(letters, "xy")]))
    assert len(set(W.words(data, offsets)[1].tolist())) == 4


def test_words_of_zero_bytes_differ_by_length():
    texts = ["\x00" * n for n in range(1, 40)] + ["a" + "\x00" * n for n in range(40)]
    texts += ["x" * n for n in range(1, 600)]
    data, offsets = utf8(pa.array(texts))
    assert len(set(W.words(data, offsets)[1].tolist())) == len(texts)


def test_adversarial_words_are_told_apart(spark):
    """Documents of one word each that a polynomial hash takes for equal: no
    link, no benchmark hit, and unknown to a model of the other."""
    from gridload.llm import decontaminate, kn_lm, ngram_join

    one, two = thue_morse(1024)
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        got = ngram_join.join(docs, k=k, num=num, den=den).collect()
        assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2}
    items = spark.createDataFrame([(1, one)], "item_id bigint, text string")
    hit = decontaminate.digest(decontaminate.decontaminate(docs, items)).collect()
    assert {r.doc_id: r.n_hit for r in hit} == {1: 1, 2: 0}
    model = kn_lm.train(docs.where("doc_id = 1").select("text"))
    known = kn_lm.score(docs, model).collect()
    assert {r.doc_id: r.n_known for r in known} == {1: 2, 2: 1}


def test_a_worker_keeps_one_operators_memory():
    from gridload.llm import common

    cleared = []
    common.keep("a", lambda: cleared.append("a"))
    common.release_others("a")
    assert cleared == []
    common.keep("b", lambda: cleared.append("b"))
    common.release_others("b")
    common.release_others("b")
    assert cleared == ["a"]
    common.release_others("c")
    assert cleared == ["a", "b"]
