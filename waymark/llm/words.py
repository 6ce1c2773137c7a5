"""Words, shingles and prefixes of whole Arrow batches of notes, as NumPy arrays.

A word is a maximal run of ASCII letters and digits or of bytes beyond ASCII in the lower-cased note; everything else separates words. Text is
read in pieces that end between words, so the arrays for one piece stay small however long a note is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 17
SLICE_BYTES = 4 << 20

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[0x80:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each slice holds about ``limit`` bytes of its text column, or one longer note."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            done = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts (one more entry than rows); null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return raw_bytes(pc.utf8_lower(texts.cast(pa.large_string())))


class Words:
    """The words of several notes: ``hash`` per word, its byte range in ``buf``, and ``first[i] : first[i + 1]`` for the words of note i."""

    def __init__(self, texts: pa.Array):
        self.buf, self.off = lowered(texts)
        buf, off = self.buf, self.off
        n = len(buf)
        inside = _WORD[buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        row = off[:-1][(off[:-1] < n)]
        begins[row] = inside[row]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = off[1:][off[1:] > 0] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(self.start):
            at = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, at + PIECE_BYTES, side="right")))
            b = self.buf[at : self.end[hi - 1]].astype(np.uint64)
            s, e = self.start[lo:hi] - at, self.end[lo:hi] - at
            power, inverse = _powers(len(b))
            b += np.uint64(1)
            b *= power[: len(b)]
            np.cumsum(b, out=b)
            total = b[e - 1]
            total[1:] -= b[s[1:] - 1]
            if s[0]:
                total[0] -= b[s[0] - 1]
            out[lo:hi] = mix(total * inverse[s])
            lo = hi
        return out

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def prefixes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length k up to ``longest``: k, a hash of the first k bytes of every word, and which words have more than k bytes."""
        h = np.full(len(self.start), 0x51ED27, np.uint64)
        size = self.end - self.start
        padded = np.concatenate([self.buf, np.zeros(longest + 1, np.uint8)])
        for k in range(longest):
            h = h * np.uint64(0x100000001B3) + padded[self.start + k] + np.uint64(1)
            yield k + 1, h, size > k + 1

    def suffix(self, length: int) -> np.ndarray:
        """A hash of the last ``length`` bytes of every word (bytes before the word count as zero)."""
        h = np.full(len(self.start), 0xA3B195, np.uint64)
        for k in range(1, length + 1):
            at = self.end - k
            b = np.where(at >= self.start, self.buf[np.maximum(at, 0)] if len(self.buf) else 0, 0).astype(np.uint64)
            h = h * np.uint64(0x100000001B3) + b + np.uint64(1)
        return h

    def char_offsets(self) -> np.ndarray:
        """Code points of the whole buffer before each byte; lower-casing keeps their number."""
        return np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])


_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _TABLES.get("power")
    if have is None or len(have) < n:
        size = max(n, (1 << 20) + 4096)
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        q = np.full(size, pow(int(_BASE), -1, 1 << 64), np.uint64)
        q[0] = 1
        _TABLES["power"], _TABLES["inverse"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _TABLES["power"], _TABLES["inverse"]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, in order, and where each note's runs start. A note of fewer than ``k`` words, but at least one, is
    one run."""
    h, first = words.hash, words.first
    n = words.count
    out_n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(out_n)])
    if not len(h):
        return np.zeros(0, np.uint64), starts
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    row = words.row_of_word()
    left = first[row + 1] - np.arange(len(h))
    for j in range(k):
        w = padded[j : j + len(h)]
        total = total * np.uint64(0xD6E8FEB86659FD93) + (np.where(left > j, w, 0) if (n < k).any() else w)
    place = np.arange(len(h)) - first[row]
    keep = place < out_n[row]
    return mix(total[keep]), starts


def distinct_per_row(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and their new starts."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[new], r[new]
    return v, np.searchsorted(r, np.arange(len(starts)))
