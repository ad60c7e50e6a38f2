"""Words of many texts at once, as 64-bit hashes, in numpy.

A word is a run of bytes that are no separators; A-Z are lower-cased. Its hash
starts from its length and takes in eight bytes at a time, each time through a
mixing step that is one-to-one; words over ``LONG`` bytes go to XXH3. It is no
sum or polynomial, so no pattern of letters makes two words collide whatever
the constants. Two different words still have one hash by a chance of 2 ** -64.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import release_others

PIECE = 1 << 20
LONG = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Separators of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NO_ALNUM = np.zeros(256, bool)
NO_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_SEED = 0x9E3779B97F4A7C15
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


def _hashes(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``start`` with ``size`` bytes in ``low``."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) * np.uint64(_SEED | 1) + np.uint64(_SEED >> 7))
    left = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        if len(left) == 0:
            break
        rest = size[left] - at
        h[left] = mix(h[left] ^ (lanes[start[left] + at] & _MASKS[np.minimum(rest, 8)]))
        left = left[rest > 8]
    for k in np.flatnonzero(size > LONG).tolist():
        word = low[start[k]:start[k] + size[k]].tobytes()
        h[k] = xxhash.xxh3_64_intdigest(word, _SEED)
    return h


def _pieces(data: np.ndarray, separator: np.ndarray, offsets: np.ndarray):
    """Byte ranges of about PIECE that no word crosses: they end after a
    separator or at the end of a text."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + PIECE, n)
        if b < n:
            row = int(offsets[np.searchsorted(offsets, b, side="right") - 1])
            cut = 0
            if row <= a:
                seps = np.flatnonzero(separator[data[a:b]])
                cut = a + int(seps[-1]) + 1 if len(seps) else 0
            b = row if row > a else cut
            while b == 0:
                end = int(offsets[np.searchsorted(offsets, a, side="right")])
                seps = np.flatnonzero(separator[data[a:end]])
                b = a + int(seps[0]) + 1 if len(seps) else end
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = BLANKS):
    """``(starts, hashes, first)``: byte position and hash of every word, in
    order, and for each text the index of its first word (and the total)."""
    release_others("words")
    starts, hashes = [], []
    begins = np.unique(offsets[:-1])
    for a, b in _pieces(data, separator[LOWER], offsets):
        piece = data[a:b]
        word = ~separator[LOWER][piece]
        fresh = word.copy()
        fresh[1:] &= ~word[:-1]
        lo, hi = np.searchsorted(begins, (a, b))
        at = begins[lo:hi] - a
        fresh[at] = word[at]
        s = np.flatnonzero(fresh)
        if len(s) == 0:
            continue
        last = word.copy()
        last[:-1] &= ~word[1:] | fresh[1:]
        starts.append(s + a)
        hashes.append(_hashes(LOWER[piece], s, np.flatnonzero(last) + 1 - s))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return start, value, np.searchsorted(start, offsets)


def shingles(value: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text, its sorted distinct ``k``-word shingles as hashes; a text
    of fewer words has one, of all its words; a text without words none."""
    n = len(value)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15 | 1) + value[j:n - k + 1 + j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in value[a:b]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + x
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
