"""Hashed word features computed over whole Arrow buffers, without a Python loop over words.

A batch of texts is one byte array. A table maps bytes to "separator or not", words are the runs
between separators, and a word's hash is a polynomial over its bytes, summed per word by
``reduceat``. Everything is a handful of numpy passes, so the cost follows the bytes of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 21

_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches the high bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def byte_table(separators) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(separators)] = True
    return out


#: The white space that separates words, and all ASCII that is neither letter nor digit.
WHITE = byte_table([9, 10, 11, 12, 13, 32])
NOT_WORD = byte_table([b for b in range(128) if not chr(b).isalnum()])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of consecutive texts of about SLICE_BYTES.

    Null texts are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of one slice: byte ranges, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data = data
        inside = ~separators[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edge] = inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        self.starts = np.flatnonzero(begins)
        self.lengths = np.flatnonzero(ends) + 1 - self.starts
        self.inside = inside
        self.first = np.searchsorted(self.starts, offsets)  # one more entry than texts
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, A-Z as a-z."""
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        place = np.arange(len(self.data), dtype=np.int64)
        begin = np.zeros(len(self.data), dtype=np.int64)
        begin[self.starts] = self.starts
        np.maximum.accumulate(begin, out=begin)
        values = (_LOWER[self.data].astype(np.uint64) + np.uint64(1)) * _POWERS[(place - begin) & 4095]
        values[~self.inside] = 0
        return mix(np.add.reduceat(values, self.starts))

    def classes(self) -> np.ndarray:
        """The set of kinds of characters of each word as bits, with its first and last kind."""
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        bits = _KIND[self.data]
        bits[~self.inside] = 0
        found = np.bitwise_or.reduceat(bits, self.starts)
        first, last = self.data[self.starts], self.data[self.starts + self.lengths - 1]
        return mix(found * np.uint64(3) + mix(_KIND[first]) + (mix(_KIND[last] + np.uint64(7)) << np.uint64(1)))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of each word of at least ``size`` bytes, hash of its first ``size`` bytes)."""
        which = np.flatnonzero(self.lengths >= size)
        out = np.full(len(which), size, dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(257) + _LOWER[self.data[self.starts[which] + k]].astype(np.uint64)
        return which, mix(out)

    def is_first(self) -> np.ndarray:
        out = np.zeros(len(self), dtype=bool)
        out[self.first[:-1][self.counts > 0]] = True
        return out


def _kinds() -> np.ndarray:
    """A bit for each kind of byte: lower, upper, digit, not ASCII, and each other character."""
    out, other = np.zeros(256, dtype=np.uint64), 4
    for b in range(256):
        c = chr(b)
        if b >= 128:
            bit = 3
        elif c.islower():
            bit = 0
        elif c.isupper():
            bit = 1
        elif c.isdigit():
            bit = 2
        else:
            bit = 4 + other % 60
            other += 1
        out[b] = np.uint64(1) << np.uint64(bit)
    return out


_KIND = _kinds()


def bucket(hashes: np.ndarray, bits: int, salt: int) -> np.ndarray:
    """Hashes to feature numbers of ``bits`` bits; ``salt`` keeps kinds of features apart."""
    return (mix(hashes + np.uint64(salt * 0x1000193)) >> np.uint64(64 - bits)).astype(np.int64)
