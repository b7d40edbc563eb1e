"""Words, word hashes and rolling window hashes of many texts at once, on Arrow buffers.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``.  A word's hash sums one random number for
each (place, byte) pair and is then mixed, all modulo 2**64.  Windows get a Rabin-Karp hash over word hashes
from prefix sums, so the cost does not depend on the window's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
PLACES = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20_240_501))
_BYTE_CODES = _RANDOM.integers(1, 2**63, size=PLACES * 256, dtype=np.int64).astype(U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on every other."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """``buffer`` holds all texts; word i is ``buffer[starts[i]:ends[i]]``; text d has words ``first[d]:first[d + 1]``."""
    buffer: np.ndarray
    text_offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word; the words must be in the order of their places."""
        if not len(self.starts):
            return np.zeros(0, dtype=U)
        lengths = self.ends - self.starts
        place = np.arange(int(lengths.sum()), dtype=np.int64)
        heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place -= np.repeat(heads, lengths)
        inside = _inside(self.starts, self.ends, len(self.buffer))
        codes = _BYTE_CODES[(place & (PLACES - 1)) * 256 + self.buffer[inside]]
        if len(place) and lengths.max() > PLACES:
            far = place >= PLACES
            codes[far] = mix(codes[far] + (place[far] // PLACES).astype(U) * BASE)
        return mix(np.add.reduceat(codes, heads) + lengths.astype(U))


def _inside(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    step = np.zeros(size + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offset of each text in them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        return whole[:0], np.zeros(1, dtype=np.int64)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, between: np.ndarray = _SPACE) -> Words:
    """Words are runs of bytes that ``between`` does not mark (white space by default)."""
    buffer, offsets = text_buffer(texts)
    return marked_words(buffer, offsets, ~between[buffer])


def marked_words(buffer: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Words:
    """Words are runs of bytes that ``word`` marks."""
    size = len(buffer)
    cut = np.zeros(size + 1, dtype=bool)   # a text begins or ends here
    cut[offsets] = True
    before = np.zeros(size, dtype=bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.zeros(size, dtype=bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return Words(buffer, offsets, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of ``length`` words that lies in one text.

    Returns the hashes, in order, and the word each window starts at.
    """
    counts = np.diff(first)
    each = np.maximum(counts - length + 1, 0)
    total = int(each.sum())
    if not total:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    at = np.arange(total, dtype=np.int64) + np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(each)[:-1])), each)
    n = len(hashes)
    down = np.full(n, INVERSE, dtype=U)
    down[0] = U(1)
    np.multiply.accumulate(down, out=down)
    prefix = np.zeros(n + 1, dtype=U)
    np.cumsum(hashes * down, out=prefix[1:])
    up = np.full(n, BASE, dtype=U)
    up[0] = U(1)
    np.multiply.accumulate(up, out=up)
    return mix((prefix[at + length] - prefix[at]) * up[at]), at


def shingles(words: Words, length: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words, and where each text's begin.

    A text of one to ``length - 1`` words has a single shingle, all of it; a text without words has none.
    """
    hashes = words.hashes()
    counts = words.counts
    rolled, _ = windows(hashes, words.first, length)
    each = np.maximum(counts - length + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < length))
    if not len(short):
        return rolled, np.concatenate(([0], np.cumsum(each)))
    each[short] = 1
    offsets = np.concatenate(([0], np.cumsum(each)))
    out = np.empty(int(offsets[-1]), dtype=U)
    is_short = np.zeros(len(out), dtype=bool)
    is_short[offsets[short]] = True
    out[~is_short] = rolled
    for text in short.tolist():
        value = np.array([counts[text]], dtype=U)
        for at in range(words.first[text], words.first[text + 1]):
            value = mix(value * BASE + hashes[at:at + 1])
        out[offsets[text]] = value[0]
    return out, offsets
