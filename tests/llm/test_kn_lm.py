"""The Kneser-Ney model against the textbook formulas in plain Python."""

import math
from collections import Counter, defaultdict

import pytest
from conftest import SF_SMALL
from fixtures_llm import read_docs, remainder, words

from gridload.llm import kn_lm as K
from gridload.llm.queries import QUERIES


class Plain:
    def __init__(self, texts):
        self.c, self.big, self.n_texts = Counter(), Counter(), len(texts)
        for t in texts:
            s = [*words(t), None]
            self.c.update(s)
            self.big.update(zip(["<s>", *s[:-1]], s))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.follows = Counter(w for _, w in self.big)
        self.classes = defaultdict(lambda: [0, 0, 0])
        for (u, _), k in self.big.items():
            self.classes[u][min(k, 3) - 1] += 1
        of, low = Counter(self.big.values()), Counter(self.follows.values())
        self.d = K.estimate_discounts([of[k] for k in (1, 2, 3, 4)])
        self.dl = K.estimate_discounts([low[k] for k in (1, 2, 3, 4)])
        rest = [low[1], low[2], sum(n for k, n in low.items() if k > 2)]
        self.rest = sum(a * b for a, b in zip(self.dl, rest)) / max(1, len(self.big))

    @staticmethod
    def less(k, d):
        return max(k - (0, *d)[min(k, 3)], 0)

    def p(self, u, w):
        low = 1 / (self.v + 1)
        if self.big:
            low = self.less(self.follows[w], self.dl) / len(self.big) + self.rest * low
        total = self.n_texts if u == "<s>" else self.c[u]
        if not total:
            return low
        back = sum(a * b for a, b in zip(self.d, self.classes[u])) / total
        return self.less(self.big[u, w], self.d) / total + back * low

    def score(self, text):
        s = [*words(text), None]
        own = sum(math.log10(self.p(u, w)) for u, w in zip(["<s>", *s[:-1]], s))
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in s)
        return len(s), sum(self.c[w] > 0 for w in s), base, own


def test_query_on_given_and_odd_tables(spark, edge_dir, small_batches):
    for sf in (SF_SMALL, edge_dir):
        docs = read_docs(sf)
        plain = Plain([d["text"] for d in docs if remainder(d["doc_id"], 7) != 2])
        want = sorted((repr(d["doc_id"]), remainder(d["doc_id"], 7) == 2, *plain.score(d["text"]))
                      for d in docs)
        rows = QUERIES["op7_kneser_ney"](spark, sf).collect()
        got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score)
                     for r in rows)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert [x for g in got for x in g[4:]] == pytest.approx(
            [x for w in want for x in w[4:]], rel=1e-9)
        assert {r.train_tokens for r in rows} == {plain.n}


def test_probabilities_of_all_words_sum_to_one(spark):
    texts = ["a b a c", "a b", "b a d e a b", "c c c", "", "a b a b"]
    model = K.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = Plain(texts)
    for u in ("a", "b", "c", "<s>"):
        seen = sum(plain.p(u, w) for w in plain.c)
        assert seen + plain.p(u, "never seen") == pytest.approx(1.0)
    assert model.tokens == plain.n and model.types == plain.v and model.bigrams == len(plain.big)


def test_a_hot_context_is_dealt_over_shards_with_the_same_result(spark):
    """One word is a third of all tokens, and its followers are all different."""
    texts = [" ".join(f"hot w{k}{j} x" for j in range(40)) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    model = K.train(df.select("text"))
    assert len(model.dealt) >= 1
    plain = Plain(texts)
    for r in K.score(df, model).collect():
        assert r.score == pytest.approx(plain.score(texts[r.doc_id])[3], rel=1e-9)


def test_no_training_text(spark):
    model = K.train(spark.createDataFrame([], "text string"))
    rows = K.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string"),
                   model).collect()
    assert [(r.n_tokens, r.n_known, r.score, r.base_score) for r in rows] == [
        (3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


def test_empty(spark, empty_dir):
    assert QUERIES["op7_kneser_ney"](spark, empty_dir).collect() == []


def test_folder_must_be_mounted():
    assert K.mounted("file:///a/b") == "/a/b" and K.mounted("/a") == "/a"
    with pytest.raises(ValueError):
        K.mounted("hdfs://host/a")


def test_held_out_text_is_better_than_unigrams(spark):
    rows = QUERIES["op7_kneser_ney"](spark, SF_SMALL).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
