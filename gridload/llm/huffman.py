"""Canonical length-limited Huffman codes over token ids, in numpy.

Lengths come from package-merge (optimal under ``LIMIT``); codes are canonical,
so a table of symbols and lengths is all a reader needs. Encoding packs whole
arrays at once; decoding looks ``LIMIT`` bits up in a table, for many blocks in
lockstep (each block is independent and begins at a known bit).
"""

from __future__ import annotations

import numpy as np

LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with positive
    ``counts`` (in order of count)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < n)
        merged = merged[at]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        m = int(is_leaf[:take].sum())
        lengths[:m] += 1
        take = 2 * (take - m)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


class Codebook:
    """Codes of ``symbols`` (uint32) with the given ``lengths``."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols = symbols[order].astype(np.uint32)
        self.lengths = lengths[order].astype(np.uint8)
        self.limit = int(self.lengths.max(initial=1))
        # canonical: each code is the one before, plus one, moved to its length
        wide = self.lengths.astype(np.uint64)
        steps = np.uint64(1) << (np.uint64(self.limit) - wide)
        first = np.concatenate([np.zeros(1, np.uint64), np.cumsum(steps)[:-1].astype(np.uint64)])
        self.codes = (first[:len(wide)] >> (np.uint64(self.limit) - wide)).astype(np.uint64)
        size = int(self.symbols.max(initial=0)) + 1
        self._code = np.zeros(size, np.uint64)
        self._code[self.symbols] = self.codes
        self._length = np.zeros(size, np.uint8)
        self._length[self.symbols] = self.lengths
        self._table = np.repeat(np.arange(len(wide), dtype=np.uint32), steps.astype(np.int64))
        self._table = np.pad(self._table, (0, (1 << self.limit) - len(self._table)))

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> Codebook:
        return cls(symbols, code_lengths(counts))

    def encode(self, ids: np.ndarray, starts: np.ndarray, block: int):
        """Bits of many texts: text k is ``ids[starts[k]:starts[k + 1]]``. Each
        begins at a byte. Returns the bytes, each text's byte range, and the bit
        (in its text) of each of its blocks with the number of blocks a text."""
        length = self._length[ids].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(length)])
        bits = total[starts[1:]] - total[starts[:-1]]
        byte = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
        text = np.repeat(np.arange(len(bits)), np.diff(starts))
        at = total[:-1] - total[starts[:-1]][text] + byte[:-1][text] * 8
        blocks = -(-np.diff(starts) // block)
        of = np.repeat(np.arange(len(bits)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = starts[:-1][of] + nth * block
        return (_pack(self._code[ids], length, at, int(byte[-1])), byte,
                total[first] - total[starts[:-1]][of], blocks)

    def decode(self, data: bytes, bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of blocks of ``sizes`` ids that begin at ``bits``, in order."""
        out_start = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(int(out_start[-1]), np.uint32)
        raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
        window = ((raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16))
                  | (raw[2:-1] << np.uint32(8)) | raw[3:])
        # longest blocks first, so the lanes still at work are a prefix
        order = np.argsort(-sizes, kind="stable")
        pos, size, at = bits[order].astype(np.int64), sizes[order], out_start[:-1][order]
        down = np.uint32(32 - self.limit)
        step, lanes = 0, len(order)
        while lanes:
            lanes = int(np.searchsorted(-size, -step, side="left"))
            p = pos[:lanes]
            index = self._table[(window[p >> 3] << (p & 7).astype(np.uint32)) >> down]
            out[at[:lanes] + step] = self.symbols[index]
            pos[:lanes] = p + self.lengths[index]
            step += 1
        return out


def _pack(code: np.ndarray, length: np.ndarray, at: np.ndarray, size: int) -> bytes:
    """Codes written at bit positions ``at`` (rising, not overlapping)."""
    if not len(code):
        return b""
    words = np.zeros(size // 8 + 2, np.uint64)
    word, off = at >> 6, (at & 63).astype(np.uint64)
    wide = length.astype(np.uint64)
    high = (code << (np.uint64(64) - wide)) >> off
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero((at & 63) + length > 64)
    words[word[over] + 1] |= code[over] << (np.uint64(128) - off[over] - wide[over])
    return words.astype(">u8").tobytes()[:size]
