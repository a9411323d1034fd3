"""Words of many texts at once, as hashes, straight from the bytes of an Arrow column.

All work is on whole arrays: a batch of texts is one run of UTF-8 bytes, a word's hash is a polynomial in a fixed odd
number modulo 2^64 over its bytes, and sums over words come from one reduceat. Nothing is made per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that end a word: for exact word rules white space alone, for word lists all ASCII but letters and digits.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    up = np.ones(1, dtype=U)
    down = np.ones(1, dtype=U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, PIECE)
            inverse = pow(BASE, -1, 1 << 64)
            cls.up, cls.down = np.full(n, BASE, dtype=U), np.full(n, inverse, dtype=U)
            cls.up[0] = cls.down[0] = 1
            np.cumprod(cls.up, out=cls.up)
            np.cumprod(cls.down, out=cls.down)
        return cls.up[:n], cls.down[:n]


def _segment(b: np.ndarray, breaks: np.ndarray, starts_doc: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(start, hashes) of the words in a run of bytes. starts_doc: positions where a text begins."""
    word = ~breaks[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[starts_doc] = word[starts_doc]
    starts = np.flatnonzero(first)
    out = np.empty((len(starts), 1 + len(prefixes)), dtype=U)
    if not len(starts):
        return starts, out
    up, down = _Powers.to(len(b))
    value = (b.astype(U) + U(1)) * word
    value *= up[: len(b)]
    out[:, 0] = np.add.reduceat(value, starts) * down[starts]
    if prefixes:
        length = np.add.reduceat(word, starts, dtype=np.int64)
        sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(value, dtype=U)))
        for i, k in enumerate(prefixes):
            out[:, 1 + i] = (sums[starts + np.minimum(length, k)] - sums[starts]) * down[starts]
    return starts, mix64(out)


def words(texts: pa.Array, breaks: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z in lower case, of all texts in order; and how many each text has. A null text has none.

    With `prefixes`, a word has a row: its hash, and those of its first so many bytes.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty((0, 1 + len(prefixes)) if prefixes else 0, dtype=U), np.zeros(len(texts), dtype=np.int64)
    data = LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
    starts, hashes, at = [], [], 0
    while at < len(data):  # segments keep the memory of very long texts bounded; a segment ends between two words
        end = min(at + 4 * PIECE, len(data))
        while end < len(data):
            cut = np.flatnonzero(breaks[data[max(at, end - PIECE) : end]])
            if len(cut):
                end = max(at, end - PIECE) + int(cut[-1]) + 1
                break
            end = min(end + PIECE, len(data))
        mine = begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at
        s, h = _segment(data[at:end], breaks, mine, prefixes)
        starts.append(s + at)
        hashes.append(h)
        at = end
    found = np.concatenate(hashes)
    return found if prefixes else found[:, 0], np.diff(np.searchsorted(np.concatenate(starts), offsets))


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer text is a range of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
        yield at, end
        at = end


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text. With fewer words, all words are one shingle; without words there are none."""
    n = len(hashes)
    every = np.empty(0, dtype=U)
    if n >= width:
        every = np.zeros(n - width + 1, dtype=U)
        for j in range(width):
            every = (every + hashes[j : n - width + 1 + j]) * U(BASE)
        every = mix64(every)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(every[at : at + c - width + 1]))
        elif c:
            h = np.array([c], dtype=U)
            for i in range(at, at + c):
                h = (h ^ hashes[i : i + 1]) * U(BASE)
            out.append(mix64(h + U(1)))
        else:
            out.append(np.empty(0, dtype=U))
        at += c
    return out
