"""Bigram language model with interpolated modified Kneser-Ney smoothing.

Counted in Spark, stored as sorted hash arrays in the shared folder, mapped
into memory by the workers that score.

1. *Vocabulary.* Tasks count the 64-bit hashes of their words; the counts go to
   shards by the hash's first bits. A shard is one file of sorted hashes and
   counts; a word's id is its place in the whole order.
2. *Bigrams.* Tasks count (context id, word id) and send them, sorted and
   packed, to shards by the context. A context that holds more than a small
   share of all tokens is dealt by the word as well, so no shard is hot. A shard
   is one file: sorted bigram keys, counts, and for each context how many of
   its words follow it once, twice and more often. For dealt contexts these
   numbers are summed on the driver (at most ``4 * shards`` contexts).
3. *Continuations.* Each bigram shard sends how many of its contexts each word
   follows; their sums are files in the order of word ids.
4. *Scoring.* Every text is looked up in the mapped files and its log10
   probability summed. No shuffle.

Counts grow with the corpus and are complete: nothing is cut, capped or
sampled. Higher orders would work alike but store as many rows again each.

The files are read by path, so the shared folder must be mounted on all
machines. A task writes its file under a temporary name and moves it, so a
repeated task does no harm.

Edge cases: a null or empty text is one end; a word unseen in training gets the
uniform share; without a training text every probability is 1; repeated rows
count and are scored as often as they stand; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import slices, utf8, written
from .words import mix, words

END = np.uint64(0xE0D0000000000001)  # the hash of the end token
UNKNOWN = 0xFFFFFFFF
SHARD_CHARS = 8_000_000
LEAST_SHARDS = 64
CHUNK_KEYS = 4_000_000
MAPPED = 4096  # files that a worker keeps mapped


def mounted(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model's folder must be mounted on all machines, not {path}")
    return url.path


# --- files of arrays --------------------------------------------------------

def save_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, their types and lengths in front."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        head = np.array([x for a in arrays for x in (a.dtype.itemsize, len(a))], "<i8")
        f.write(np.array([len(arrays)], "<i8").tobytes() + head.tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    os.replace(temporary, path)


def map_arrays(path: str) -> list[np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[:8].view("<i8")[0])
    head, at, out = raw[8:8 + 16 * n].view("<i8"), 8 + 16 * n, []
    for item, length in head.reshape(n, 2).tolist():
        out.append(raw[at:at + item * length].view(f"<u{item}"))
        at += item * length + (-item * length) % 8
    return out


_MAPPED: dict[str, list[np.ndarray]] = {}


def _shard(folder: str, kind: str, shard: int) -> list[np.ndarray]:
    key = f"{folder}/{kind}-{shard}"
    found = _MAPPED.pop(key, None) or map_arrays(f"{key}.bin")
    _MAPPED[key] = found
    if len(_MAPPED) > MAPPED:  # the one not used for longest
        _MAPPED.pop(next(iter(_MAPPED)))
    return found


def pack(sorted_values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(sorted_values, prepend=sorted_values.dtype.type(0)).tobytes(), 1)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), dtype), dtype=dtype)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several arrays and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first], (np.add.reduceat(count, first) if len(first) else count[:0])


# --- the model --------------------------------------------------------------

@dataclass
class Model:
    """What a worker needs besides the files; all of bounded size."""

    folder: str
    shards: int
    bases: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first id a shard
    tokens: int = 0
    texts: int = 0
    dealt: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # hot contexts
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_classes: tuple[int, int, int] = (0, 0, 0)
    bigrams: int = 0

    @property
    def types(self) -> int:
        return int(self.bases[-1])

    @property
    def start(self) -> int:
        return self.types  # the id of the context before the first word

    def shard_of_hash(self, value: np.ndarray) -> np.ndarray:
        return (value >> np.uint64(64 - self.shards.bit_length() + 1)).astype(np.int64)

    def shard_of_bigram(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        hot = np.isin(context, np.fromiter(self.dealt, np.int64, len(self.dealt)))
        key = context.astype(np.uint64)
        key[hot] |= (word[hot].astype(np.uint64) + np.uint64(1)) << np.uint64(32)
        return (mix(key) % np.uint64(self.shards)).astype(np.int64)

    def look_up(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts of word hashes (UNKNOWN and 0)."""
        distinct, back = np.unique(value, return_inverse=True)
        ids, counts = np.full(len(distinct), UNKNOWN, np.int64), np.zeros(len(distinct), np.int64)
        shard = self.shard_of_hash(distinct)
        edges = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.unique(shard):
            known, count = _shard(self.folder, "words", int(s))
            a, b = edges[s], edges[s + 1]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, distinct[a:b]), len(known) - 1)
            same = known[at] == distinct[a:b]
            ids[a:b][same] = at[same] + self.bases[s]
            counts[a:b][same] = count[at[same]]
        return ids[back], counts[back]

    def continuations(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.bases, ids, side="right") - 1
        for s in np.unique(shard[ids != UNKNOWN]):
            mine = (shard == s) & (ids != UNKNOWN)
            out[mine] = _shard(self.folder, "follows", int(s))[0][ids[mine] - self.bases[s]]
        return out

    def bigram_counts(self, context: np.ndarray, word: np.ndarray):
        """Per bigram: its count, and its context's followers seen once, twice
        and more often."""
        n = len(context)
        count, classes = np.zeros(n, np.int64), np.zeros((3, n), np.int64)
        order = np.argsort(shard := self.shard_of_bigram(context, word), kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        key = (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
        for s in np.flatnonzero(np.diff(edges)):
            at = order[edges[s]:edges[s + 1]]
            keys, counts, contexts, *parts = _shard(self.folder, "bigrams", int(s))
            if len(keys):
                k = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
                same = keys[k] == key[at]
                count[at[same]] = counts[k[same]]
            if len(contexts):
                k = np.minimum(np.searchsorted(contexts, context[at]), len(contexts) - 1)
                same = contexts[k] == context[at]
                for part, values in zip(classes, parts):
                    part[at[same]] = values[k[same]]
        for hot, values in self.dealt.items():
            classes[:, context == hot] = np.array(values)[:, None]
        return count, classes

    def low(self, ids: np.ndarray) -> np.ndarray:
        """The lower order: continuation counts, then uniform."""
        uniform = 1 / (self.types + 1)
        if not self.bigrams:
            return np.full(len(ids), uniform)
        follows = self.continuations(ids)
        rest = sum(d * n for d, n in zip(self.low_discounts, self.low_classes)) / self.bigrams
        return _discounted(follows, self.low_discounts) / self.bigrams + rest * uniform

    def log10(self, context: np.ndarray, context_count: np.ndarray, word: np.ndarray):
        """log10 probability of each word after its context."""
        low = self.low(word)
        if not self.bigrams:
            return np.log10(low)
        key = (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        count, classes = (x[..., back] for x in self.bigram_counts(context[first], word[first]))
        total = np.maximum(context_count, 1)
        rest = sum(d * n for d, n in zip(self.discounts, classes)) / total
        high = _discounted(count, self.discounts) / total
        return np.log10(np.where(context_count > 0, high + rest * low, low))


def _discounted(count: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *discounts])[np.minimum(count, 3)], 0.0)


def estimate_discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts from how many counts are 1, 2, 3 and 4 (Chen and Goodman)."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = []
    for k in range(3):
        d = k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else y * (k + 1)
        out.append(float(min(max(d, 0.1 * (k + 1)), 0.95 * (k + 1))))
    return tuple(out)


def _sequences(batch: pa.RecordBatch, column: int):
    """(rows from, to, hashes with ends, index after each text's end)."""
    data, offsets = utf8(batch.column(column))
    for a, b in slices(offsets):
        _, value, first = words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        out = np.full(len(value) + b - a, END, np.uint64)
        ends = first[1:] + np.arange(1, b - a + 1)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = value
        yield a, b, out, ends


def _contexts(ids: np.ndarray, counts: np.ndarray, ends: np.ndarray, start: int, texts: int):
    """The context of each token and how often it occurs in training."""
    before, of = np.empty_like(ids), np.empty_like(counts)
    before[1:], of[1:] = ids[:-1], counts[:-1]
    first = np.concatenate([[0], ends[:-1]])
    before[first], of[first] = start, texts
    return before, of


def _by_shard(shard: np.ndarray, key: np.ndarray, count: np.ndarray):
    """(shard, keys, counts) in the order of shards, then keys."""
    order = np.lexsort((key, shard))
    shard, key, count = shard[order], key[order], count[order]
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
    for a, b in zip(edges, [*edges[1:], len(shard)]):
        yield int(shard[a]), key[a:b], count[a:b]


def _packed(parts) -> pa.RecordBatch:
    rows = [(s, pack(k), zlib.compress(c.astype("<u4").tobytes(), 1)) for s, k, c in parts]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()),
                            pa.array([r[1] for r in rows], pa.binary()),
                            pa.array([r[2] for r in rows], pa.binary())],
                           ["shard", "keys", "counts"])


def _unpacked(batches: Iterator[pa.RecordBatch]):
    """(shard, keys, counts) of a task's rows, or None without any."""
    shard, keys, counts = None, [], []
    for batch in batches:
        for s, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            shard = s
            keys.append(unpack(k, "<u8"))
            counts.append(np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64))
            if sum(map(len, keys)) > 2 * CHUNK_KEYS and len(keys) > 8:
                key, count = summed(keys, counts)
                keys, counts = [key], [count]
    return None if shard is None else (shard, *summed(keys, counts))


PACKED = "shard int, keys binary, counts binary"


def _count_words(texts: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for _, _, value, _ in _sequences(batch, 0):
                key, count = np.unique(value, return_counts=True)
                keys.append(key)
                counts.append(count)
                if sum(map(len, keys)) > CHUNK_KEYS:
                    key, count = summed(keys, counts)
                    keys, counts = [key], [count]
                    if len(key) > CHUNK_KEYS:
                        yield _packed(_by_shard(model.shard_of_hash(key), key, count))
                        keys, counts = [], []
        if keys:
            key, count = summed(keys, counts)
            yield _packed(_by_shard(model.shard_of_hash(key), key, count))

    return texts.mapInArrow(run, PACKED)


def _store_words(packed: DataFrame, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _unpacked(batches)
        if found is None:
            return
        shard, key, count = found
        save_arrays(f"{model.folder}/words-{shard}.bin", [key, count.astype("<u8")])
        end = np.searchsorted(key, END)
        texts = int(count[end]) if end < len(key) and key[end] == END else 0
        yield pa.record_batch(
            [pa.array([shard], pa.int32()), pa.array([len(key)], pa.int64()),
             pa.array([int(count.sum())], pa.int64()), pa.array([texts], pa.int64())],
            ["shard", "types", "tokens", "texts"])

    return packed.repartitionById(model.shards, F.col("shard")).mapInArrow(
        run, "shard int, types bigint, tokens bigint, texts bigint")


def _words_over(shards: DataFrame, model: Model, limit: float) -> DataFrame:
    """Ids of the words that occur more than ``limit`` times (fewer than
    ``tokens / limit``), from the stored shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                _, count = _shard(model.folder, "words", shard)
                yield pa.record_batch([pa.array(np.flatnonzero(count > limit)
                                                + model.bases[shard])], ["id"])

    return shards.mapInArrow(run, "id bigint")


def _count_bigrams(texts: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def flush():
            key, count = summed(keys, counts)
            context, word = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
            shard = model.shard_of_bigram(context.astype(np.int64), word.astype(np.int64))
            keys.clear()
            counts.clear()
            return _packed(_by_shard(shard, key, count))

        for batch in batches:
            for _, _, value, ends in _sequences(batch, 0):
                ids, known = model.look_up(value)
                before, _ = _contexts(ids, known, ends, model.start, model.texts)
                key, count = np.unique((before.astype(np.uint64) << np.uint64(32))
                                       | ids.astype(np.uint64), return_counts=True)
                keys.append(key)
                counts.append(count)
                if sum(map(len, keys)) > CHUNK_KEYS:
                    yield flush()
        if keys:
            yield flush()

    return texts.mapInArrow(run, PACKED)


def _store_bigrams(packed: DataFrame, model: Model) -> DataFrame:
    """Writes the shards; returns packed continuation counts by shard of the
    words, and one row (shard -1) a task with counts of counts and the parts of
    dealt contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _unpacked(batches)
        if found is None:
            return
        shard, key, count = found
        context = (key >> np.uint64(32)).astype(np.int64)
        word = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        classes = [np.add.reduceat((np.minimum(count, 3) == k).astype(np.int64), first)
                   for k in (1, 2, 3)]
        small = "<u2" if int(count.max()) < 1 << 16 else "<u8"
        save_arrays(f"{model.folder}/bigrams-{shard}.bin",
                    [key, count.astype(small), context[first].astype("<u4"),
                     *(c.astype("<u4") for c in classes)])
        owners = context[first]
        hot = np.flatnonzero(np.isin(owners, np.fromiter(model.dealt, np.int64,
                                                         len(model.dealt))))
        of_counts = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        report = np.array([len(key), *of_counts] + [
            x for h in hot for x in (owners[h], *(c[h] for c in classes))], "<i8")
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([report.tobytes()]),
                               pa.array([b""], pa.binary())], ["shard", "keys", "counts"])
        ids, follows = np.unique(word, return_counts=True)
        owner = np.searchsorted(model.bases, ids, side="right") - 1
        yield _packed(_by_shard(owner, ids.astype(np.uint64), follows))

    return packed.repartitionById(model.shards, F.col("shard")).mapInArrow(run, PACKED)


def _store_follows(packed: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _unpacked(batches)
        if found is None:
            return
        shard, ids, follows = found
        size = int(model.bases[shard + 1] - model.bases[shard])
        dense = np.zeros(size, "<u4")
        dense[ids.astype(np.int64) - model.bases[shard]] = follows
        save_arrays(f"{model.folder}/follows-{shard}.bin", [dense])
        yield pa.record_batch(
            [pa.array([int((dense == k).sum())], pa.int64()) for k in (1, 2, 3, 4)]
            + [pa.array([int((dense > 2).sum())], pa.int64())], ["n1", "n2", "n3", "n4", "n3more"])

    return packed.repartitionById(model.shards, F.col("shard")).mapInArrow(
        run, "n1 bigint, n2 bigint, n3 bigint, n4 bigint, n3more bigint")


def train(texts: DataFrame, folder: str | None = None) -> Model:
    """A model of the one text column of ``texts``, its files in ``folder``
    (a new one in the shared folder by default)."""
    folder = mounted(folder or scratch_path(texts.sparkSession, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    chars = texts.agg(F.coalesce(F.sum(F.length(texts.columns[0])), F.lit(0)).alias("n"))
    shards = max(LEAST_SHARDS, 1 << (chars.collect()[0]["n"] // SHARD_CHARS).bit_length())
    model = Model(folder, shards)
    rows = _store_words(_count_words(texts, model), model).collect()
    for s in set(range(shards)) - {r["shard"] for r in rows}:
        save_arrays(f"{folder}/words-{s}.bin", [np.zeros(0, "<u8")] * 2)
    sizes = np.zeros(shards, np.int64)
    for r in rows:
        sizes[r["shard"]] = r["types"]
    model.bases = np.concatenate([[0], np.cumsum(sizes)])
    model.tokens, model.texts = sum(r["tokens"] for r in rows), sum(r["texts"] for r in rows)
    if not model.tokens:
        return model
    if model.types >= UNKNOWN - 1:
        raise ValueError("more word types than a 32-bit id can number")
    limit = model.tokens / (4 * shards)
    hot = [r["id"] for r in _words_over(texts.sparkSession.range(shards), model, limit).collect()]
    hot += [model.start] if model.texts > limit else []
    model.dealt = {h: (0, 0, 0) for h in hot}

    follows = written(_store_bigrams(_count_bigrams(texts, model), model), "kneser-ney-follows")
    of_counts, dealt = np.zeros(5, np.int64), {h: np.zeros(3, np.int64) for h in hot}
    for r in follows.where("shard = -1").collect():
        report = np.frombuffer(bytes(r["keys"]), "<i8")
        of_counts += report[:5]
        for h, *parts in report[5:].reshape(-1, 4).tolist():
            dealt[h] += parts
    for s in range(shards):
        if not os.path.exists(f"{folder}/bigrams-{s}.bin"):
            save_arrays(f"{folder}/bigrams-{s}.bin", [np.zeros(0, f"<u{b}") for b in (8, 2, 4, 4, 4, 4)])
    model.dealt = {h: tuple(v.tolist()) for h, v in dealt.items()}
    model.bigrams = int(of_counts[0])
    model.discounts = estimate_discounts(of_counts[1:].tolist())
    low = np.zeros(5, np.int64)
    for r in _store_follows(follows.where("shard >= 0"), model).collect():
        low += np.array([r[k] for k in ("n1", "n2", "n3", "n4", "n3more")])
    model.low_discounts = estimate_discounts(low[:4].tolist())
    model.low_classes = (int(low[0]), int(low[1]), int(low[4]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams), score and perplexity of the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, value, ends in _sequences(batch, 1):
                ids, counts = m.look_up(value)
                before, of = _contexts(ids, counts, ends, m.start, m.texts)
                text = np.repeat(np.arange(b - a), np.diff(ends, prepend=0))

                def total(x: np.ndarray) -> np.ndarray:
                    return np.bincount(text, x, b - a)

                n = np.diff(ends, prepend=0)
                base = total(np.log10((counts + 1) / (m.tokens + m.types + 1)))
                own = total(m.log10(before, of, ids))
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(n),
                     pa.array(total(counts > 0).astype(np.int64)),
                     pa.array(np.full(b - a, m.tokens)), pa.array(base), pa.array(own),
                     pa.array(10 ** np.minimum(-own / n, 300))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                     "perplexity"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double, perplexity double")
