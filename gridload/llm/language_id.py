"""Language identification with averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords (byte n-grams of its
lower-cased letter runs, borders included, hashed to ``BUCKETS`` rows); a
linear softmax over that average gives the language. Embeddings and softmax
are trained together by stochastic gradient descent in numpy on the driver,
on a bounded sample (``PER_LANGUAGE`` texts of each language, each of at most
``MAX_CHARS`` characters; equal texts of one id are one). Because averaging and the softmax's product are
both linear, a worker needs only ``embeddings @ weights``: one row of
``languages`` numbers a subword, a table of fixed size that is broadcast.

Rejection is calibrated on a part of the sample that SGD does not see: a
temperature is fitted to it, and a text is rejected when its calibrated
probability is under the value that ``KEEP`` of the rightly named texts reach,
though never when its language is more likely than not (``EVEN``).

Edge cases: a null text or one without a letter is ``und``, score 0 and
rejected; without a learnable row every text is; repeated rows and ties in the
sample's order change nothing; the other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_others, slices, utf8
from .sample import row_key, sample_ids, with_texts

BITS = 16
BUCKETS = 1 << BITS
SIZES = (2, 3, 4)
DIMENSION = 16
PER_LANGUAGE = 600
MAX_CHARS = 10_000
KEEP = 0.999
EVEN = 0.5
UNDETERMINED = "und"

# Letters of lower-cased ASCII and all bytes of multi-byte characters; every
# other byte is a border (0).
_LETTER = np.zeros(256, np.uint32)
_LETTER[65:91] = _LETTER[97:123] = np.arange(1, 27)
_LETTER[128:] = np.arange(27, 155)
_PRIMES = (2654435761, 2246822519, 3266489917, 668265263)


def _buckets(code: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the subword that starts at each byte; 0 where it would
    begin and go on with borders."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(len(code), np.int64)
    h = np.full(n, size, np.uint32)
    for j in range(size):
        h = (h ^ code[j:j + n]) * np.uint32(_PRIMES[j])
        h ^= h >> np.uint32(15)
    out = np.zeros(len(code), np.int64)
    out[:n] = (h >> np.uint32(32 - BITS)).astype(np.int64)
    out[:n][(code[:n] == 0) & (code[1:n + 1] == 0)] = 0
    return out


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes with one border before each text and after the last, and
    the place of each text's border."""
    lengths = np.diff(offsets)
    at = offsets[:-1] + np.arange(len(lengths))
    code = np.zeros(len(data) + len(lengths) + 1, np.uint32)
    inside = np.ones(len(code), bool)
    inside[at] = inside[-1] = False
    code[inside] = _LETTER[data]
    return code, at


def subword_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    raw = np.frombuffer(text.encode(), np.uint8)
    code, _ = _codes(raw, np.array([0, len(raw)]))
    found = np.concatenate([_buckets(code, s) for s in SIZES])
    bucket, count = np.unique(found[found > 0], return_counts=True)
    return bucket.astype(np.uint16), np.minimum(count, 0xFFFF).astype(np.uint16)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    code = _LETTER[data]
    plain = np.concatenate([[0], np.cumsum((code > 0) & (code < 27))])
    wide = np.concatenate([[0], np.cumsum(code >= 27)])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for k in np.flatnonzero(~out & (wide[offsets[1:]] > wide[offsets[:-1]])):
        out[k] = any(c.isalpha() for c in bytes(data[offsets[k]:offsets[k + 1]]).decode())
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages, already divided by the temperature
    bias: np.ndarray
    reject_below: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        code, at = _codes(data, offsets)
        total = np.zeros((len(at), len(self.languages)))
        seen = np.zeros(len(at))
        for size in SIZES:
            bucket = _buckets(code, size)
            total += np.add.reduceat(self.table[bucket], at, axis=0, dtype=np.float64)
            seen += np.add.reduceat((bucket > 0).astype(np.int64), at)
        logits = total / np.maximum(seen, 1)[:, None] + self.bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _means(emb: np.ndarray, docs: list, picked: np.ndarray) -> tuple[np.ndarray, ...]:
    bucket = np.concatenate([docs[k][0] for k in picked])
    count = np.concatenate([docs[k][1] for k in picked]).astype(np.float64)
    size = np.array([len(docs[k][0]) for k in picked])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    row = np.repeat(np.arange(len(picked)), size)
    share = count / np.add.reduceat(count, start)[row]
    return np.add.reduceat(emb[bucket] * share[:, None], start, axis=0), bucket, row, share


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7,
          epochs: int = 5, batch: int = 32, rate: float = 0.4,
          least_steps: int = 300) -> LanguageModel:
    """SGD over the sample, ``epochs`` times or, for a small one, as often as
    ``least_steps`` batches take; one text in five is kept for calibration."""
    keep = [k for k, d in enumerate(docs) if len(d[0])]
    docs, labels = [docs[k] for k in keep], [labels[k] for k in keep]
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], dtype=np.int64)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    weights = rng.normal(0, 0.1, (DIMENSION, max(1, len(languages))))
    bias = np.zeros(max(1, len(languages)))
    order = rng.permutation(len(docs))
    held, fit = order[::5] if len(order) >= 20 else order, order[np.arange(len(order)) % 5 > 0]
    if len(order) < 20:
        fit = order
    epochs = max(epochs, -(-least_steps * batch // max(1, len(fit))) if len(fit) else 0)
    epochs = min(epochs, least_steps)
    for epoch in range(epochs if len(languages) > 1 else 0):
        lr = rate * (1 - epoch / epochs)
        for a in range(0, len(fit), batch):
            picked = fit[a:a + batch] if a else rng.permutation(fit)[:batch]
            mean, bucket, row, share = _means(emb, docs, picked)
            grad = _softmax(mean @ weights + bias)
            grad[np.arange(len(picked)), y[picked]] -= 1
            back = (grad @ weights.T)[row] * share[:, None]
            weights -= lr / len(picked) * 10 * (mean.T @ grad)
            bias -= lr / len(picked) * grad.sum(0)
            used, inverse = np.unique(bucket, return_inverse=True)
            for d in range(DIMENSION):
                emb[used, d] -= lr * 10 * np.bincount(inverse, back[:, d], len(used))
    table, temperature, reject = emb @ weights, 1.0, 0.0
    if len(held) and len(languages) > 1:
        means = [_means(emb, docs, held[a:a + batch])[0] for a in range(0, len(held), batch)]
        logits = np.concatenate(means) @ weights + bias
        grid = np.geomspace(0.05, 5, 60)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
                for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / temperature)
        right = p.max(1)[p.argmax(1) == y[held]]
        reject = float(min(EVEN, np.quantile(right, 1 - KEEP))) if len(right) else 0.0
    table[0] = 0
    return LanguageModel(languages, (table / temperature).astype(np.float32),
                         bias / temperature, reject)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [subword_counts(t.as_py()) for t in batch.column(2)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1),
             pa.array([b.tobytes() for b, _ in found], pa.binary()),
             pa.array([c.tobytes() for _, c in found], pa.binary())],
            ["_id", "_label", "bucket", "count"])


def learn(docs: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", per_language: int = PER_LANGUAGE,
          max_chars: int = MAX_CHARS, seed: int = 7) -> LanguageModel:
    """A model from ``text`` and non-null ``lang`` of the rows that the
    condition ``train_rows`` selects."""
    used = (docs.where(train_rows).where(F.length(text_col).between(1, max_chars))
            .select(row_key(id_col, text_col, seed).alias("_row"),
                    F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")))
    ids = sample_ids(used, "_row", "_lang", per_language, seed)
    rows = with_texts(used, ids, "_row", "_text").mapInArrow(
        _counted, "_id bigint, _label string, bucket binary, count binary").collect()
    rows.sort(key=lambda r: (r["_label"], r["_id"], r["bucket"], r["count"]))
    return train([(np.frombuffer(r["bucket"], np.uint16), np.frombuffer(r["count"], np.uint16))
                  for r in rows], [r["_label"] for r in rows], seed)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text",
            prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (names after
    ``prefix``), which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")]
    kept = [c for c in docs.columns if c not in names]
    text_at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others("language_id")
        m = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            lang, score, reject = [], [], []
            for a, b in slices(offsets):
                part, offs = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                known = has_letter(part, offs) & bool(m.languages)
                p = (m.probabilities(part, offs) if m.languages
                     else np.zeros((b - a, 1)))
                best, top = p.argmax(1), p.max(1)
                lang += [m.languages[i] if k else UNDETERMINED for i, k in zip(best, known)]
                score.append(np.where(known, top, 0.0))
                reject.append(~known | (top < m.reject_below))
            yield pa.record_batch(
                [*batch.columns, pa.array(lang, pa.string()),
                 pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64()),
                 pa.array(np.concatenate(reject) if reject else np.zeros(0, bool), pa.bool_())],
                [*kept, *names])

    schema = docs.select(*kept).schema
    for name, kind in zip(names, ("string", "double", "boolean")):
        schema = schema.add(name, kind)
    return docs.select(*kept).mapInArrow(run, schema)


def identify(docs: DataFrame, train_rows, id_col: str = "doc_id") -> DataFrame:
    """Learn, then predict every row: doc_id, lang_pred, score, rejected."""
    model = learn(docs, train_rows, id_col)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col("text").alias("text"))
    return predict(named, model).drop("text")
