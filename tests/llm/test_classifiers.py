"""Language identification and quality ranking: held-out accuracy, odd rows."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF_ORACLE
from fixtures_llm import DOCS, read_docs, remainder

from gridload.llm import language_id as L
from gridload.llm import quality_rank as Q
from gridload.llm import sample
from gridload.llm.queries import QUERIES


def test_languages_of_held_out_documents(spark):
    lang = {d["doc_id"]: d["lang"] for d in read_docs(SF_ORACLE)}
    rows = QUERIES["op8_language_id"](spark, SF_ORACLE).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.lang_pred in set(lang.values()) for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.01
    again = QUERIES["op8_language_id"](spark, SF_ORACLE).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_undetermined_texts(spark, edge_dir):
    rows = QUERIES["op8_language_id"](spark, edge_dir).collect()
    assert len(rows) == len(DOCS)
    by = {r.doc_id: r for r in rows}
    for doc_id in (4, 5, 6, 7):  # null, empty, blank, digits
        assert (by[doc_id].lang_pred, by[doc_id].score, by[doc_id].rejected) == ("und", 0.0, True)
    for doc_id in (1, 8, 11, 12, -5):
        assert by[doc_id].lang_pred in ("en", "de", "fr")


def test_letters_of_any_script():
    from gridload.llm.common import utf8
    import pyarrow as pa

    texts = ["é", "漢", "12", "", None, "–…", "x", "٣"]
    assert L.has_letter(*utf8(pa.array(texts))).tolist() == [True, True, False, False, False,
                                                              False, True, False]


def test_no_label_at_all(spark, edge_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    assert {r.lang_pred for r in L.identify(docs, F.lit(False)).collect()} == {"und"}
    one = L.identify(docs, F.col("lang") == "en").collect()
    assert {r.lang_pred for r in one} == {"en", "und"}


def test_predictions_replace_columns_of_their_names(spark, edge_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = L.predict(docs, L.learn(docs, F.lit(True)))
    assert sorted(out.columns) == sorted(docs.columns)
    assert out.schema["score"].dataType.simpleString() == "double"


def test_sample_is_bounded_per_label(spark):
    rows = spark.range(20_000).selectExpr("id", "IF(id % 10 = 0, 'b', 'a') AS lab")
    got = sample.sample_ids(rows, "id", "lab", 200, 1).groupBy("_label").count().collect()
    assert {r["_label"] for r in got} == {"a", "b"} and all(200 <= r["count"] <= 260 for r in got)


def test_quality_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in
              pq.read_table(f"{SF_ORACLE}/labels.parquet").to_pylist()}
    rows = QUERIES["op3_quality_rank"](spark, SF_ORACLE).collect()
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = np.array([r.score for r in held if labels[r.doc_id] == 1])
    bad = np.array([r.score for r in held if labels[r.doc_id] == 0])
    assert (good[:, None] > bad).mean() > 0.98
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    again = QUERIES["op3_quality_rank"](spark, SF_ORACLE).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_quality_of_odd_rows_and_without_labels(spark, edge_dir, empty_dir):
    rows = QUERIES["op3_quality_rank"](spark, edge_dir).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    none = Q.learn(docs, spark.read.parquet(f"{empty_dir}/labels.parquet"))
    assert none is None and {r.score for r in Q.score(docs, none).collect()} == {0.5}


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(Q.FEATURES)))
    value = x @ np.r_[2.0, -1.0, np.zeros(len(Q.FEATURES) - 2)]
    y = (value > 0.5).astype(int)
    model = Q.train(x, y, ((y == 0).sum(), (y == 1).sum()))
    assert np.corrcoef(model.rank(x), value)[0, 1] > 0.95
    # the threshold is the quantile of label 0's share
    assert np.mean(model.score(x) >= Q.CUT) == pytest.approx(y.mean(), abs=0.02)


def test_keep_above_quantile(spark):
    scored = spark.range(1000).selectExpr("id", "id / 1000.0D AS score")
    kept = Q.keep_above_quantile(scored, 0.75).agg({"id": "min", "*": "count"}).collect()[0]
    assert abs(kept["count(1)"] - 250) <= 2


def test_empty(spark, empty_dir):
    assert QUERIES["op8_language_id"](spark, empty_dir).collect() == []
    assert QUERIES["op3_quality_rank"](spark, empty_dir).collect() == []


def hot_rows(n=3000):
    """A third of the rows are copies of one row, a third has its id and texts
    of their own."""
    words = {"a": "the rain falls on old roofs", "b": "der regen fällt auf alte dächer"}
    out = []
    for k in range(n):
        lab = "ab"[k % 2]
        own = f"{words[lab]} x{k}"
        out.append((0, words["a"], "a") if k % 3 == 0 else (0, own, lab) if k % 3 == 1
                   else (k, own, lab))
    return out


def test_repeated_ids_take_no_places_and_stay_bounded(spark):
    docs = spark.createDataFrame(hot_rows(), "doc_id int, text string, lang string")
    rows = docs.select(sample.row_key("doc_id", "text", 1).alias("_row"), "lang", "text")
    ids = sample.sample_ids(rows, "_row", "lang", 160, 1)
    texts = sample.with_texts(rows, ids, "_row", "text").collect()
    by = {lab: [r["_text"] for r in texts if r["_label"] == lab] for lab in "ab"}
    assert all(150 <= len(t) <= 208 and len(set(t)) == len(t) for t in by.values())
    by_id = sample.sample_ids(docs, "doc_id", "lang", 160, 1).collect()
    assert len(by_id) == len(set(by_id)) > 300


def test_sample_is_bounded_over_labels(spark):
    rows = spark.range(20_000).selectExpr("id", "id % 50 AS lab")
    got = sample.sample_ids(rows, "id", "lab", 200, 1, max_rows=800).groupBy("_label").count()
    assert got.count() == 50 and all(r["count"] <= 32 for r in got.collect())
    with pytest.raises(ValueError):
        sample.sample_ids(rows, "id", "lab", 200, 1, max_rows=49)


def test_classifiers_learn_from_a_table_with_a_hot_id(spark, monkeypatch):
    docs = spark.createDataFrame(hot_rows(), "doc_id int, text string, lang string")
    seen = {}
    monkeypatch.setattr(L, "train", lambda d, labels, seed: seen.update(n=len(labels)))
    L.learn(docs, docs["lang"].isNotNull(), per_language=160)
    assert 300 <= seen["n"] <= 416
    labels = docs.selectExpr("doc_id", "IF(lang = 'a', 1, 0) AS quality")
    monkeypatch.setattr(Q, "train", lambda x, y, totals, seed: seen.update(q=len(y)))
    Q.learn(docs, labels, per_label=160)
    assert 300 <= seen["q"] <= 416


def test_threshold_covers_all_labelled_rows(spark):
    """Far more rows than the fit sees, of every length, empty ones among them."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(1500):
        good = k % 3 == 0
        text = " ".join(rng.choice(["clear", "words", "follow", "here"] if good else
                                   ["!!", "BUY", "|x|", "now"], int(rng.integers(3, 40))))
        rows.append((k, None if k % 50 == 1 else "" if k % 50 == 2 else text))
        labels.append((k, int(good)))
    rows += [(5000 + k, "clear words follow here " * 5000) for k in range(3)]
    labels += [(5000 + k, 1) for k in range(3)] + labels[:100] + [(9999, 0)] * 500
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    given = spark.createDataFrame(labels, "doc_id int, quality int")
    model = Q.learn(docs, given, per_label=64)
    ranks = {r.doc_id: r["rank"] for r in Q.score(docs, model).collect()}
    label = dict(labels)
    s, n0 = np.sort([ranks[k] for k in ranks]), sum(label[k] == 0 for k in ranks)
    assert model.threshold == pytest.approx((s[n0 - 1] + s[n0]) / 2)


def test_labels_of_empty_texts_are_learnt(spark):
    texts = ["", None] * 30 + [f"some words of text {k}" for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    labels = docs.selectExpr("doc_id", "IF(length(text) > 0, 1, 0) AS quality")
    model = Q.learn(docs, labels)
    assert model.weights[Q.FEATURES.index("is_empty")] < 0
    rows = Q.score(docs, model).collect()
    assert all((r.score >= Q.CUT) == (r.doc_id >= 60) for r in rows)
