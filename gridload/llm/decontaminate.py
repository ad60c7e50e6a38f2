"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of all training tokens: one row for each
block of documents (about ``BLOCK_BYTES`` of text) with the block's sorted
distinct terms (64-bit hashes) and, for each term, the rising positions at
which it stands. The blocks are shards by document: a query needs no shuffle,
and a lost shard is read again from the written table.

``search`` takes windows of benchmark words. Within a shard a window whose
terms are not all there is out at once; for the others the postings of the
rarest term, moved back by its offset, are the candidate starts, and the lists
of the next rarest terms, moved likewise, are intersected with them. With
``slop`` up to that many words may stand between the terms (proximity): for each
posting of the rarest term, all postings of the others in the same text within
``slop`` of their places are tried, each used for one word of the window only.
A match's ``slack`` is the least spread of the terms about their places (in
order, the number of words between), 0 for an exact phrase.

The benchmark's windows are broadcast in blocks of at most ``QUERY_WORDS``
words (8 bytes each); a larger benchmark is searched block after block.

Edge cases: a null or empty text has no words and no match; an item without
words has no window, an item with fewer words than a window is one window;
equal windows of several items match for each; an item repeated with equal
words is one; repeated documents are documents of their own; empty tables give no match; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8, written
from .words import NO_ALNUM, words

WINDOW = 10
BLOCK_BYTES = 8 << 20
QUERY_WORDS = 200_000
NEAR = 2  # words that may stand between those of a proximity match

MATCHES = "array<struct<item_id:string,start:bigint,end:bigint,slack:int>>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, written: a row a block. ``block`` numbers it,
    ``ids`` are its texts' ids, ``first`` holds each text's first word position
    (and the number of words), ``begins`` where each term's positions begin in
    ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, BLOCK_BYTES):
                _, value, first = words(data[offsets[a]:offsets[b]],
                                        offsets[a:b + 1] - offsets[a], NO_ALNUM)
                order = np.argsort(value, kind="stable")
                ranked = value[order]
                begin = np.flatnonzero(np.concatenate(
                    [np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]]))
                begins = np.append(begin, len(ranked))
                ids = batch.column(0).slice(a, b - a)
                yield pa.record_batch(
                    [pa.array([block], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids),
                     *(pa.array([x.tobytes()], pa.binary()) for x in (
                         first.astype("<i8"), ranked[begin].astype("<u8"),
                         begins.astype("<u4"), order.astype("<u4")))],
                    ["block", "ids", "first", "terms", "begins", "places"])
                block += 1 << 24

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return written(docs.select(id_col, text_col).mapInArrow(
        run, f"block bigint, ids array<{kind}>, first binary, terms binary, begins binary, "
        "places binary"), "postings")


class Block:
    """One shard of the index, in memory."""

    def __init__(self, first: bytes, terms: bytes, begins: bytes, places: bytes):
        self.first = np.frombuffer(first, "<i8")
        self.terms = np.frombuffer(terms, "<u8")
        self.begins = np.frombuffer(begins, "<u4").astype(np.int64)
        self.places = np.frombuffer(places, "<u4")

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each term and the length of its list (0: not there)."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        size = np.where(self.terms[at] == terms, self.begins[at + 1] - self.begins[at], 0)
        return at, size

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.begins[term]:self.begins[term + 1]].astype(np.int64)

    def find(self, at: np.ndarray, size: np.ndarray, slop: int):
        """(start, end, slack) of the matches of one window, given its terms'
        indexes and list lengths."""
        if slop:
            return self.near(at, size, slop)
        order = np.argsort(size, kind="stable")
        start = self.postings(at[order[0]]) - order[0]
        start = start[start >= 0]
        for k in order[1:]:
            if not len(start):
                break
            there = self.postings(at[k])
            want = start + k
            start = start[there[np.minimum(np.searchsorted(there, want), len(there) - 1)] == want]
        # all within one text
        end = start + len(at)
        text = np.searchsorted(self.first, start, side="right")
        ok = text == np.searchsorted(self.first, end - 1, side="right")
        return text[ok] - 1, start[ok], end[ok], np.zeros(int(ok.sum()), np.int64)

    def near(self, at: np.ndarray, size: np.ndarray, slop: int):
        """As ``find``, for each posting of the rarest term the match about it
        of the least slack. All terms lie within ``slack`` of a common start, so
        each start and slack is tried; a term takes its first free posting
        there, which leaves the most to its later repetitions."""
        order = np.argsort(size, kind="stable")
        rarest = int(order[0])
        anchor = self.postings(at[rarest])
        text = np.searchsorted(self.first, anchor, side="right") - 1
        begin, least, most = anchor - rarest, self.first[text], self.first[text + 1] - 1
        lists = {}
        for k in order.tolist():
            if not len(begin):
                return (np.zeros(0, np.int64),) * 4
            t = int(at[k])
            if t not in lists:
                lists[t] = self.postings(t)
            lo = np.searchsorted(lists[t], np.maximum(begin + k - slop, least))
            hi = np.searchsorted(lists[t], np.minimum(begin + k + slop, most), side="right")
            ok = hi > lo
            text, begin, least, most = text[ok], begin[ok], least[ok], most[ok]
        out = []
        for slack in range(slop + 1):
            for shift in range(-slack, 1):
                if not len(begin):
                    break
                ok, used = np.ones(len(begin), bool), {}
                low, high = most, least
                for k, t in enumerate(at.tolist()):
                    want = np.maximum(begin + shift + k, least)
                    if t in used:
                        want = np.maximum(want, used[t] + 1)
                    i = np.searchsorted(lists[t], want)
                    used[t] = there = lists[t][np.minimum(i, len(lists[t]) - 1)]
                    ok &= (i < len(lists[t])) & (
                        there <= np.minimum(begin + shift + k + slack, most))
                    low, high = np.minimum(low, there), np.maximum(high, there)
                out.append((text[ok], low[ok], high[ok] + 1, np.full(int(ok.sum()), slack)))
                text, begin, least, most = text[~ok], begin[~ok], least[~ok], most[~ok]
        if not out:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*out))


def windows_of(value: np.ndarray, size: int) -> np.ndarray:
    if not len(value):
        return np.zeros((0, size), np.uint64)
    if len(value) <= size:
        return value[None, :]
    return np.lib.stride_tricks.sliding_window_view(value, size)


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words): the word hashes of each item row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            _, value, first = words(data, offsets, NO_ALNUM)
            yield pa.record_batch(
                [batch.column(0), pa.array([value[a:b].tobytes() for a, b in
                                            zip(first[:-1], first[1:])], pa.binary())],
                ["item_id", "words"])

    return (items.select(F.col(id_col).cast("string").alias("item_id"), text_col)
            .mapInArrow(run, "item_id string, words binary"))


def _joined(found: dict, names: list) -> list[dict]:
    """Matches of one text, those of an item that touch joined."""
    out = []
    for (item, slack), spans in sorted(found.items()):
        last = None
        for start, end in sorted(spans):
            if last is not None and start <= last["end"]:
                last["end"] = max(last["end"], end)
            else:
                last = {"item_id": names[item], "start": start, "end": end, "slack": slack}
                out.append(last)
    return out


def _queries(items: list[tuple[str | None, bytes]], window: int):
    """(item numbers, windows) for each length of window."""
    by_size: dict[int, list] = defaultdict(list)
    for item, (_, raw) in enumerate(items):
        found = windows_of(np.frombuffer(raw, np.uint64), window)
        if len(found):
            by_size[found.shape[1]].append((np.full(len(found), item), found))
    return [(np.concatenate([i for i, _ in part]), np.concatenate([w for _, w in part]))
            for part in by_size.values()]


def search(index: DataFrame, items: list[tuple[str | None, bytes]], window: int = WINDOW,
           slop: int = 0) -> DataFrame:
    """Per text of the index: row, doc_id, n_words and its matches, each with
    the item's id and the words from start to end (exclusive) that it covers."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in shared.value]
        queries = _queries(shared.value, window)
        match = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()),
                                    ("end", pa.int64()), ("slack", pa.int32())]))
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(1).slice(k, 1).flatten()
                block = Block(*(batch.column(c)[k].as_py() for c in range(2, 6)))
                found = defaultdict(lambda: defaultdict(list))
                for item, terms in queries:
                    at, size = block.lookup(terms)
                    for w in np.flatnonzero(size.min(axis=1) > 0):
                        for text, start, end, slack in zip(
                                *(x.tolist() for x in block.find(at[w], size[w], slop))):
                            base = int(block.first[text])
                            found[text][int(item[w]), slack].append((start - base, end - base))
                rows = np.arange(len(ids)) + batch.column(0)[k].as_py()
                yield pa.record_batch(
                    [pa.array(rows), ids, pa.array(np.diff(block.first)),
                     pa.array([_joined(found[t], names) if t in found else []
                               for t in range(len(ids))], match)],
                    ["row", "doc_id", "n_words", "matches"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(
        run, f"row bigint, doc_id {kind}, n_words bigint, matches {MATCHES}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  query_words: int = QUERY_WORDS) -> DataFrame:
    """Per row of ``docs``: row (a number of its own), doc_id, n_words and
    ``matches``: (item_id, start, end, slack)."""
    index = build_index(docs, id_col, text_col)
    items = written(item_words(benchmark, item_col, "text").distinct(), "benchmark-words")
    size = items.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("b")).collect()[0]["b"]
    parts, out = max(1, -(-size // (8 * query_words))), None
    for part in range(parts):
        block = items.where(F.pmod(F.xxhash64("words", "item_id"), F.lit(parts)) == part)
        found = search(index, [(r["item_id"], bytes(r["words"])) for r in block.collect()],
                       window, slop)
        out = found if out is None else out.unionByName(found)
    if parts > 1:
        out = out.groupBy("row", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("matches")).alias("matches"))
    return out


def covered(matches: Column) -> Column:
    """Number of words that lie in any of the matches."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"))))
    start = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, m):
        return F.struct(F.greatest(acc["to"], m["end"]).alias("to"),
                        (acc["n"] + F.greatest(F.lit(0).cast("bigint"),
                                               m["end"] - F.greatest(acc["to"], m["start"])))
                        .alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def digest(found: DataFrame) -> DataFrame:
    """Words hit by exact phrases, the items they come from, and ``n_near``: the
    items with any match, exact or within the slop that was searched."""
    def items(matches: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(
            matches, lambda m: F.coalesce(m["item_id"], F.lit("")))))

    exact = F.filter("matches", lambda m: m["slack"] == 0)
    return (found.select("doc_id", "n_words", covered(exact).alias("n_hit"),
                         items(exact).alias("_items"), items(F.col("matches")).alias("_near"))
            .select("doc_id", "n_words", "n_hit", F.size("_items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("_items", ",").cast("binary"), 256)
                    .alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
                    F.size("_near").cast("bigint").alias("n_near")))
