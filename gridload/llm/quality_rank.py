"""Quality scores by Bradley-Terry ranking of documents.

A pair of a label-1 and a label-0 text of a bounded, seeded sample says "the
first is better"; ``PAIRS`` pairs are drawn with replacement. The model is ``P(a over b) = sigmoid(w . (f(a) - f(b)))``
on standardised text features, fitted by logistic loss on feature differences
(Newton steps). ``w . f(text)`` then ranks all texts. The threshold is the
quantile of the ranks of all labelled training rows that leaves the share of
label 0 below it (by Spark's quantile sketch, exact up to some 10,000 rows and
off by at most that part of the rows beyond); ``score`` is the sigmoid of the
distance to the threshold, shifted so that the threshold is ``CUT``.

A labelled row is a document with a label of its id; a label given twice to an
id counts once, an id with both labels gives a row of each.

Features come from the whole text only: shares of byte classes, word lengths,
repetition of words and length. Edge cases: null and empty texts have the
features of an empty text; without rows of both labels every score is 0.5;
repeated rows and ties get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import intermediates, slices, utf8, written
from .sample import row_key, sample_ids, with_texts
from .words import words

CUT = 0.7
PER_LABEL = 4000
ACCURACY = 10_000
PAIRS = 100_000

_CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "comma", "shout", "bar",
            "symbol", "bracket", "other", "control", "wide")
_CLASS = np.full(256, _CLASSES.index("other"), np.int64)
_CLASS[97:123] = _CLASSES.index("lower")
_CLASS[65:91] = _CLASSES.index("upper")
_CLASS[48:58] = _CLASSES.index("digit")
_CLASS[:32] = _CLASS[127] = _CLASSES.index("control")
_CLASS[[32, 9]] = _CLASSES.index("blank")
_CLASS[[10, 13]] = _CLASSES.index("line")
_CLASS[128:] = _CLASSES.index("wide")
for _chars, _name in ((".", "stop"), (",;:", "comma"), ("!?", "shout"), ("|", "bar"),
                      ("#$%&*@^~+=_\\/", "symbol"), ("()[]{}<>\"'`", "bracket")):
    _CLASS[[ord(c) for c in _chars]] = _CLASSES.index(_name)

FEATURES = (*(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_length",
            "short_words", "long_words", "very_long_words", "distinct_words",
            "repeated_next_word", "upper_starts", "bar_starts", "symbol_ends",
            "top_word_share", "is_empty")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(FEATURES)))
    row = np.repeat(np.arange(n), size)
    kinds = len(_CLASSES)
    kind = _CLASS[data]
    share = np.bincount(row * kinds + kind, minlength=n * kinds).reshape(n, kinds)
    out[:, :kinds] = share / np.maximum(size, 1)[:, None]
    start, value, first = words(data, offsets)
    count = np.diff(first)
    end = np.empty_like(start)
    if len(start):
        blank = np.flatnonzero((kind == _CLASSES.index("blank")) | (kind == _CLASSES.index("line"))
                               | (data == 11) | (data == 12))
        text_end = np.repeat(offsets[1:], count)
        after = np.searchsorted(blank, start)
        end = np.minimum(np.append(blank, len(data))[after], text_end)
    length = end - start
    of = np.repeat(np.arange(n), count)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, x, n) / np.maximum(count, 1)

    same = np.zeros(len(start))
    same[1:] = (value[1:] == value[:-1]) & (of[1:] == of[:-1])
    distinct, top = np.zeros(n), np.zeros(n)
    for k in np.flatnonzero(count):
        _, c = np.unique(value[first[k]:first[k + 1]], return_counts=True)
        distinct[k], top[k] = len(c) / count[k] ** 0.9, c.max() / count[k]
    last = kind[np.maximum(end - 1, 0)] if len(start) else np.zeros(0, np.int64)
    begin = kind[start] if len(start) else np.zeros(0, np.int64)
    out[:, kinds:] = np.stack([
        np.log1p(size), np.log1p(count), np.minimum(mean(length), 60), mean(length <= 2),
        mean(length > 12), mean(length > 30), distinct, mean(same),
        mean(begin == _CLASSES.index("upper")), mean(begin == _CLASSES.index("bar")),
        mean((last == _CLASSES.index("symbol")) | (last == _CLASSES.index("shout"))), top,
        (size == 0).astype(float)], axis=1)
    return out


@dataclass
class RankModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.rank(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def threshold_at(scores: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The middle of the gap at the weighted ``share`` quantile of the scores."""
    order = np.argsort(scores, kind="stable")
    s, w = scores[order], np.cumsum(weight[order]) / weight.sum()
    k = int(np.clip(np.searchsorted(w, share, side="left") + 1, 1, len(s) - 1))
    return float((s[k - 1] + s[k]) / 2)


def train(x: np.ndarray, y: np.ndarray, totals: tuple[int, int], seed: int = 7,
          pairs: int = PAIRS, ridge: float = 1e-3) -> RankModel | None:
    """Bradley-Terry weights of feature differences; ``totals``: all rows of
    label 0 and 1. None if a label has no row."""
    if not (y == 0).any() or not (y == 1).any():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = (rng.choice(np.flatnonzero(y == k), pairs) for k in (1, 0))
    diff, w = z[better] - z[worse], np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance that the pair is misranked
        grad = -(diff * p[:, None]).mean(0) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    model = RankModel(mean, scale, w, 0.0)
    counts = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = (np.array(totals) / counts)[y]
    model.threshold = threshold_at(model.rank(x), weight, totals[0] / sum(totals))
    return model


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        found = [features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                 for a, b in slices(offsets)]
        rows = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
        yield pa.record_batch([batch.column(0), batch.column(1),
                               pa.array(list(rows), pa.list_(pa.float64()))],
                              ["_id", "_label", "f"])


def threshold_over(docs: DataFrame, rated: DataFrame, model: RankModel, id_col: str,
                   text_col: str) -> float:
    """The middle of the gap at the quantile of label 0's share, over the ranks
    of all ``docs`` with a label in ``rated`` (_doc, _label)."""
    ranks = score(docs, model, id_col, text_col).select(F.col("doc_id").alias("_doc"), "rank")
    with intermediates(docs.sparkSession):  # ids and ranks only cross the shuffle
        rows = written(ranks.join(rated, "_doc").select("rank", "_label"), "label-ranks")
        low, total = rows.agg(F.count_if(F.col("_label") == 0), F.count("*")).first()
        at = [(low - 0.5) / total, min(1.0, (low + 0.5) / total)]
        return sum(rows.agg(F.percentile_approx("rank", at, ACCURACY)).first()[0]) / 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_label: int = PER_LABEL,
          seed: int = 7) -> RankModel | None:
    """A model from the 0/1 ``labels`` (already restricted to training rows).
    ``per_label`` bounds the sample that reaches the driver."""
    rated = (labels.where(F.col(label_col).isin(0, 1))
             .select(F.col(id_col).alias("_doc"), F.col(label_col).cast("int").alias("_label"))
             .distinct())
    used = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"),
                       row_key(id_col, text_col, seed).alias("_row"))
    labelled = used.select("_doc", "_row").distinct().join(rated, "_doc")
    ids = sample_ids(labelled, "_row", "_label", per_label, seed, labels=2)
    rows = (with_texts(used, ids, "_row", "_text")
            .mapInArrow(_described, "_id bigint, _label int, f array<double>").collect())
    rows.sort(key=lambda r: (r["_label"], r["_id"], r["f"]))
    if not rows:
        return None
    y = np.array([r["_label"] for r in rows])
    model = train(np.array([r["f"] for r in rows]), y, ((y == 0).sum(), (y == 1).sum()), seed)
    if model is not None:
        model.threshold = threshold_over(docs, rated, model, id_col, text_col)
    return model


def score(docs: DataFrame, model: RankModel | None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row: doc_id, rank (unbounded) and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rank, value = [np.zeros(0)], [np.zeros(0)]
            for a, b in slices(offsets):
                if m is None:
                    rank.append(np.zeros(b - a))
                    value.append(np.full(b - a, 0.5))
                    continue
                x = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                rank.append(m.rank(x))
                value.append(m.score(x))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(rank)),
                                   pa.array(np.concatenate(value))],
                                  ["doc_id", "rank", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, rank double, score double")


def keep_above_quantile(scored: DataFrame, quantile: float, column: str = "score") -> DataFrame:
    """Rows whose score is at least the given quantile of all scores (an
    approximate quantile with relative error 0.001, computed on executors)."""
    cut = scored.agg(F.percentile_approx(column, quantile, 1000).alias("_cut"))
    return (scored.join(F.broadcast(cut), scored[column] >= cut["_cut"]).drop("_cut"))
