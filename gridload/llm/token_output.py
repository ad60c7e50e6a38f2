"""Token ids as Huffman-coded binary files.

1. Every text is encoded once and its ids are staged in the shared folder.
2. The occurrences of each id are summed over the staged ids (a row for each id
   and task; at most the vocabulary reaches the driver) and the codes made from
   these global counts.
3. The staged texts are dealt by ranges of (doc_id, hash of the ids, row), so an
   id that many rows share is many ranges. A task codes its range in that order
   and begins a new file when one would hold more than ``2 * FILE_IDS`` ids; it
   writes under temporary names and moves (a repeated task writes the same
   files). There are at most ``RANGES`` ranges; beyond, each has more files.
4. Spark reads the files back; blocks of ``BLOCK`` ids decode independently
   from their bit offsets.

Texts are cut at single blanks and line ends between other
characters, where the byte-level pre-tokenizer always begins a new piece; a
piece is encoded once and remembered, up to ``REMEMBER`` pieces of a kind in a
worker: when half as many are new, the older half goes, but for what was used
since. What was forgotten is encoded again.
Texts with other blanks are cut by a stricter rule.

A file is a row of segments: counts (``HEADER``), doc ids, null flags, numbers
of ids, bit offset of each block, coded bytes. ``codes.bin`` holds symbols and
code lengths.

Edge cases: null and empty texts hold the end id only; null ids come first;
rows with the same id are ordered by a hash of their ids, equal ones as they
were staged; a text of more than ``2 * FILE_IDS`` ids is a file; an empty table gives no
file and no row; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import intermediates, keep, release_others, slices, utf8, written
from .huffman import Codebook

END_ID = 2
BLOCK = 1024
FILE_IDS = 4_000_000
RANGES = 50_000
SEGMENT_BYTES = 4 << 20
REMEMBER = 600_000
FILES_A_RANGE = 10**9  # above the number of files that a range can have
HEADER = "<6sQQQ"
MAGIC = b"TIDS1\n"

_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces:
    """Remembered pieces of one kind and their ids, in one growing array."""

    def __init__(self, dtype: np.dtype):
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype)
        self.ends = np.zeros(1 << 14, np.int64)

    def __len__(self) -> int:
        return len(self.at)

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = len(self.at), int(self.ends[len(self.at) - 1]) if self.at else 0
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.ends) < n + len(pieces):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used:used + len(ids)] = ids
        self.ends[n:n + len(pieces)] = used + np.cumsum(sizes)
        self.at.update(zip(pieces, range(n, n + len(pieces))))

    def places(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; -1 of those that are not known."""
        return np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces with these numbers, and how many each has."""
        start = np.where(at > 0, self.ends[at - 1], 0)
        return _ranges(self.ids, start, sizes := self.ends[at] - start), sizes


def _ranges(store: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The elements of ``store`` in ranges, one range after the other."""
    ends = np.cumsum(size)
    take = np.arange(int(ends[-1]) if len(ends) else 0)
    take += np.repeat(start - (ends - size), size)
    return store[take]


class Encoder:
    """Ids of many texts at once, piece by remembered piece.

    New pieces are encoded many in one text, parted by the blank they begin
    with or by line ends; the parts are told by the tokens that begin with the
    blank, or are the line end. Where their number does not fit, each piece is
    encoded by itself."""

    JOINED = 2000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.begins = np.zeros(size, bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.begins[k] = token.startswith("\u0120")  # the byte-level blank
        self.line = self._ids("\n")[-1:].astype(np.int64)
        self.kinds = {k: (Pieces(self.dtype), Pieces(self.dtype))
                      for k in ("spaced", "bare", "whole")}  # lately used, older

    def _ids(self, text: str) -> np.ndarray:
        # the same ids as of encode, without the offsets nobody needs here
        coded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(coded[0].ids, self.dtype)

    def _learn(self, kind: str, new: list[str]) -> None:
        known = self.kinds[kind][0]
        for a in range(0, len(new), self.JOINED):
            part, sizes = new[a:a + self.JOINED], None
            if kind == "spaced":
                ids = self._ids(" " + " ".join(part))
                first = np.flatnonzero(self.begins[ids])
                if len(first) == len(part) and first[0] == 0:
                    sizes = np.diff(first, append=len(ids))
            elif kind == "bare":
                ids = self._ids("\n".join(part))
                cut = np.flatnonzero(ids == self.line[0])
                if len(cut) == len(part) - 1:
                    sizes = np.diff(cut, prepend=-1, append=len(ids)) - 1
                    ids = np.delete(ids, cut)
            if sizes is None:
                lead = " " if kind == "spaced" else ""
                each = [self._ids(lead + p) for p in part]
                ids, sizes = np.concatenate(each), np.array([len(e) for e in each])
            known.add(part, ids, sizes)

    def look_up(self, kind: str, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known, older = self.kinds[kind]
        if len(known) and len(known) + len(pieces) > REMEMBER // 2:
            known, older = self.kinds[kind] = Pieces(self.dtype), known
        at, before = known.places(pieces), len(known)
        absent = np.flatnonzero(at < 0)
        names = [pieces[k] for k in absent.tolist()]  # each is there once
        place = older.places(names)
        again, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        known.add([names[k] for k in again.tolist()], *older.take(place[again]))
        self._learn(kind, [names[k] for k in new.tolist()])
        at[absent[np.concatenate([again, new])]] = before + np.arange(len(absent))
        return known.take(at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and where each text's begin (one more than texts)."""
        texts = texts.fill_null("")
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        flat, number = cut.flatten(), pc.list_value_length(cut).to_numpy()
        coded = flat.dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        text = np.repeat(np.arange(len(texts)), number)
        first = np.zeros(len(code) + 1, bool)
        first[np.cumsum(number) - number] = True
        first, last = first[:-1], np.concatenate([first[1:-1], [True]])[:len(code)]
        # a word may stand alone unless it is empty or has a blank at its ends
        line = pc.equal(words, "\n").to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.equal(words, ""), pc.not_equal(pc.utf8_trim_whitespace(words), words))
        odd = odd.to_numpy(zero_copy_only=False) & ~line
        is_line = line[code]
        bare = first | is_line
        bare[1:] |= is_line[:-1]
        strict = np.zeros(len(texts), bool)
        strict[text[odd[code] | (is_line & (first | last))]] = True
        use = ~strict[text]
        units: list[tuple[np.ndarray, np.ndarray]] = []
        place = np.zeros((2, len(words)), np.int64)
        n = 0
        for j, kind in enumerate(("spaced", "bare")):
            mine = np.zeros(len(words), bool)
            mine[code[use & (bare if j else ~bare)]] = True
            if j and (at := np.flatnonzero(mine & line)).size:  # the line end itself
                mine[at] = False
                units.append(self.look_up("whole", ["\n"]))
                place[j, at], n = n, n + 1
            at = np.flatnonzero(mine)
            units.append(self.look_up(kind, words.take(pa.array(at)).to_pylist()))
            place[j, at] = n + np.arange(len(at))
            n += len(at)
        row, unit = [text[use]], [place[bare[use].astype(np.int64), code[use]]]
        extra: dict[str, int] = {}
        for k in np.flatnonzero(strict):
            whole = texts[int(k)].as_py()
            ends = [m.start() for m in _SAFE_BLANK.finditer(whole)]
            own = [whole[a:b] for a, b in zip([0, *ends], [*ends, len(whole)]) if b > a]
            unit.append(np.array([extra.setdefault(p, n + len(extra)) for p in own], np.int64))
            row.append(np.full(len(own), k))
        if extra:
            units.append(self.look_up("whole", list(extra)))
        row_all, unit_all = np.concatenate(row), np.concatenate(unit)
        if strict.any():
            order = np.argsort(row_all, kind="stable")
            row_all, unit_all = row_all[order], unit_all[order]
        size = np.concatenate([s for _, s in units])
        store = np.concatenate([i for i, _ in units])
        length = size[unit_all]
        ids = _ranges(store, (np.cumsum(size) - size)[unit_all], length)
        tokens = np.bincount(row_all, length, len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(tokens)])


def encoder(path: str) -> Encoder:
    keep("token_output", _ENCODERS.clear)
    release_others("token_output")
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _with_end(ids: np.ndarray, starts: np.ndarray, end_id: int):
    """The same with ``end_id`` behind every text."""
    n = len(starts) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    inside = np.ones(len(out), bool)
    moved = starts + np.arange(n + 1)
    inside[moved[1:] - 1] = False
    out[inside] = ids
    return out, moved


def _encoded(batch: pa.RecordBatch, column: int, tokenizer: str, end_id: int,
             limit: int = 8 << 20):
    """(rows from, to, ids, starts) of a batch, some bytes at a time."""
    texts = batch.column(column)
    sizes = pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(texts):
        before = ends[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield a, b, *_with_end(*encoder(tokenizer).encode(texts.slice(a, b - a)), end_id)
        a = b


def stage_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, tie, row, ids): the ids of each text, the end included;
    written. ``tie`` and ``row`` order the rows of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, starts in _encoded(batch, 1, tokenizer, end_id):
                raw = ids.astype(np.uint16 if wide <= 1 << 16 else np.uint32).tobytes()
                at = (starts * (2 if wide <= 1 << 16 else 4)).tolist()
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(starts)),
                     pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary())],
                    ["doc_id", "n", "ids"])

    wide = id_space(tokenizer, end_id)
    return written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col)
                   .mapInArrow(run, "doc_id bigint, n bigint, ids binary")
                   .select("doc_id", "n", F.xxhash64("ids").alias("tie"),
                           F.monotonically_increasing_id().alias("row"), "ids"), "token-ids")


def id_space(tokenizer: str, end_id: int) -> int:
    """One more than the largest id."""
    return max(len(encoder(tokenizer).begins), end_id + 1)


def _staged_ids(column: pa.Array, wide: int) -> np.ndarray:
    return utf8(column)[0].view(np.uint16 if wide <= 1 << 16 else np.uint32)


def count_ids(staged: DataFrame, wide: int) -> DataFrame:
    """(id, n): occurrences over all staged texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide, np.int64)
        for batch in batches:
            total += np.bincount(_staged_ids(batch.column(0), wide), minlength=wide)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])

    return (staged.select("ids").mapInArrow(run, "id bigint, n bigint")
            .groupBy("id").agg(F.sum("n").alias("n")))


class TokenFile:
    """A token file while it is written, under a temporary name."""

    def __init__(self, fs: pafs.FileSystem, root: str, name: str):
        self.fs, self.path = fs, f"{root}/{name}"
        self.temporary = f"{root}/_{name}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.temporary)
        self.parts: list[tuple] = []
        self.size = self.texts = self.tokens = 0

    def add(self, key: pa.Array, number: np.ndarray, coded: tuple) -> None:
        data, byte, bits, blocks = coded
        self.parts.append((number, np.diff(byte), bits, blocks, key, data))
        self.size += len(data)
        self.texts, self.tokens = self.texts + len(number), self.tokens + int(number.sum())
        if self.size >= SEGMENT_BYTES:
            self.flush()

    def flush(self) -> None:
        """Writes a segment."""
        if not self.parts:
            return
        *numbers, keys, data = zip(*self.parts)
        number, length, bits, blocks = map(np.concatenate, numbers)
        key = pa.concat_arrays(keys)
        at = bits.astype("<u8") + np.repeat(8 * (np.cumsum(length) - length), blocks).astype("<u8")
        self.out.write(struct.pack(HEADER, MAGIC, len(number), len(at), self.size))
        self.out.write(key.fill_null(0).to_numpy().astype("<i8").tobytes())
        self.out.write(key.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
        self.out.write(number.astype("<i8").tobytes() + at.tobytes())
        for part in data:
            self.out.write(part)
        self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> dict:
    """Writes ``docs`` under ``path`` (any file system pyarrow knows and all
    executors reach); returns the number of texts, ids and files."""
    with intermediates(docs.sparkSession):
        return _write(docs, path, tokenizer, id_col, text_col, end_id)


def _write(docs: DataFrame, path: str, tokenizer: str | None, id_col: str, text_col: str,
           end_id: int) -> dict:
    tokenizer = tokenizer or default_tokenizer()
    wide = id_space(tokenizer, end_id)
    staged = stage_ids(docs, tokenizer, id_col, text_col, end_id)
    counts = sorted(count_ids(staged, wide).collect())
    symbols = np.array([r["id"] for r in counts], np.uint32)
    book = Codebook.of_counts(symbols, np.array([r["n"] for r in counts], np.int64))
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/codes.bin") as f:
        f.write(struct.pack("<Q", len(symbols)) + book.symbols.astype("<u4").tobytes()
                + book.lengths.tobytes())
    shared = docs.sparkSession.sparkContext.broadcast(book)
    file_ids = FILE_IDS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others("token_output")
        fs, root = pafs.FileSystem.from_uri(path)
        done, file = [], None
        for batch in batches:
            number = batch.column(1).to_numpy()
            sizes = np.concatenate([[0], np.cumsum(number)])
            for a, b in slices(sizes, min(file_ids, 1 << 21)):
                if file and file.tokens + sizes[b] - sizes[a] > 2 * file_ids:
                    file.close()
                    file = None
                if file is None:
                    file = TokenFile(fs, root, f"part-{TaskContext.get().partitionId():07d}"
                                               f"-{len(done):05d}.bin")
                    done.append(file)
                file.add(batch.column(0).slice(a, b - a), number[a:b], shared.value.encode(
                    _staged_ids(batch.column(2).slice(a, b - a), wide), sizes[a:b + 1] - sizes[a],
                    BLOCK))
        if file:
            file.close()
        yield pa.record_batch([pa.array([sum(f.texts for f in done)], pa.int64()),
                               pa.array([sum(f.tokens for f in done)], pa.int64()),
                               pa.array([len(done)], pa.int64())], ["texts", "tokens", "files"])

    order = ("doc_id", "tie", "row")
    total = staged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    row = (staged.repartitionByRange(min(RANGES, max(1, -(-total // file_ids))), *order)
           .sortWithinPartitions(*order).select("doc_id", "n", "ids")
           .mapInArrow(write, "texts bigint, tokens bigint, files bigint")
           .agg(*(F.sum(c).alias(c) for c in ("texts", "tokens", "files"))).collect()[0])
    return {k: row[k] or 0 for k in ("texts", "tokens", "files")}


def read_codes(spark: SparkSession, path: str) -> Codebook:
    raw = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "codes.bin").load(path)
                .select("content").collect()[0]["content"])
    n = struct.unpack_from("<Q", raw)[0]
    return Codebook(np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, np.uint8, n, 8 + 4 * n))


def segments(content: bytes, book: Codebook):
    """(doc ids, null flags, ids of all texts, starts) of each segment."""
    at = 0
    while at < len(content):
        magic, n, blocks, size = struct.unpack_from(HEADER, content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += struct.calcsize(HEADER)
        key = np.frombuffer(content, "<i8", n, at)
        null = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)
        number = np.frombuffer(content, "<i8", n, at + 9 * n)
        bits = np.frombuffer(content, "<u8", blocks, at + 17 * n)
        at += 17 * n + 8 * blocks
        per = -(-number // BLOCK)
        nth = np.arange(blocks) - np.repeat(np.cumsum(per) - per, per)
        sizes = np.minimum(BLOCK, np.repeat(number, per) - nth * BLOCK)
        ids = book.decode(content[at:at + size], bits, sizes)
        at += size
        yield key, null, ids, np.concatenate([[0], np.cumsum(number)])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per text, read back: doc_id, start (ids of all texts before it), n_tokens,
    ids_crc32 and, if wanted, ``ids`` (little-endian uint32)."""
    book = spark.sparkContext.broadcast(read_codes(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns)):
                base = 0
                for key, null, ids, starts in segments(content, book.value):
                    raw = ids.astype("<u4").tobytes()
                    own = [raw[4 * a:4 * b] for a, b in zip(starts[:-1], starts[1:])]
                    columns = [pa.array(np.full(len(key), file)), pa.array(key, mask=null),
                               pa.array(starts[:-1] + base), pa.array(np.diff(starts)),
                               pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    names = ["file", "doc_id", "at", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array(own, pa.binary())], [*names, "ids"]
                    base += int(starts[-1])
                    yield pa.record_batch(columns, names)

    def number(k: int) -> Column:
        return F.regexp_extract("path", r"part-(\d+)-(\d+)\.bin$", k).cast("bigint")

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bin").load(path)
             .select((number(1) * FILES_A_RANGE + number(2)).alias("file"), "content"))
    rows = files.mapInArrow(run, "file bigint, doc_id bigint, at bigint, n_tokens bigint, "
                            "ids_crc32 bigint" + ", ids binary" * with_ids)

    # one row a file: its number of ids, from the headers' numbers alone
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(
                [_ids_in(c.as_py()) for c in batch.column(1)], pa.int64())], ["file", "n"])

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.mapInArrow(total, "file bigint, n bigint").select(
        F.col("file").alias("_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    out = rows.join(starts, F.col("file") == F.col("_file"))
    return out.select("doc_id", (F.col("at") + F.col("_base")).alias("start"), "n_tokens",
                      "ids_crc32", *(["ids"] if with_ids else []))


def _ids_in(content: bytes) -> int:
    at, total = 0, 0
    while at < len(content):
        _, n, blocks, size = struct.unpack_from(HEADER, content, at)
        total += int(np.frombuffer(content, "<i8", n, at + struct.calcsize(HEADER) + 9 * n).sum())
        at += struct.calcsize(HEADER) + 17 * n + 8 * blocks + size
    return total
