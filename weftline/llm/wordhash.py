"""Word hashes of Arrow string columns in numpy, for operators on word sequences.

Words are maximal runs of bytes other than \\x20 and \\x09-\\x0D; such bytes never occur inside a
multi-byte UTF-8 character, so bytes serve as well as code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_FACTOR = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(int(_FACTOR), -1, 2**64))
#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 3 << 20
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Finder:
    """Places of values among sorted, different hashes, signed or not: a table by their first bits says where to begin, so that a search takes a step or two."""

    def __init__(self, keys: np.ndarray):
        bits = min(max(len(keys).bit_length() + 1, 4), 24)
        self.keys, self._shift = keys, keys.dtype.type(64 - bits)
        self._low = -(1 << bits - 1) if keys.dtype.kind == "i" else 0
        sizes = np.bincount(self._buckets(keys), minlength=1 << bits)
        self._starts = (np.cumsum(sizes) - sizes).astype(np.int32 if len(keys) < 2**31 else np.int64)

    def _buckets(self, values: np.ndarray) -> np.ndarray:
        return (values >> self._shift).astype(np.int64) - self._low

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, which values are there); the place of a value that is not there means nothing."""
        if not len(self.keys):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        last = len(self.keys) - 1
        at = np.minimum(self._starts[self._buckets(values)], last)
        there = self.keys[at]
        hit, late = there == values, np.flatnonzero(there < values)
        while late.size:
            late = late[at[late] < last]
            at[late] += 1
            there, wanted = self.keys[at[late]], values[late]
            hit[late] = there == wanted
            late = late[there < wanted]
        return at, hit


@dataclass
class Words:
    """The words of a run of texts: hashes, byte spans in `data`, and each text's first word (one more at the end)."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def last_of_text(self) -> np.ndarray:
        """For each word, the number of the word that follows its text's last one."""
        return np.repeat(self.first[1:], self.counts())


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by first word; whoever asks drops those that cross texts."""
    if len(hashes) < k:
        return np.zeros(0, _U)
    acc = hashes[: len(hashes) - k + 1].copy()
    for j in range(1, k):
        acc *= _FACTOR
        acc += hashes[j : len(hashes) - k + 1 + j]
    return mix(acc + _U(k * int(_ODD) % 2**64))


class SpanHashes:
    """Hashes of word spans of any length, from one running sum."""

    def __init__(self, hashes: np.ndarray):
        powers = np.full(len(hashes) + 1, _FACTOR, _U)
        powers[0] = 1
        inverse = np.full(len(hashes) + 1, _INVERSE, _U)
        inverse[0] = 1
        powers, self._inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
        self._sums = np.concatenate([np.zeros(1, _U), np.add.accumulate(hashes * powers[: len(hashes)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        spans = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(spans + (end - start).astype(_U) * _ODD)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)), offsets


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about `limit` bytes."""
    _, offsets = _buffers(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, len(texts))
        low = high


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """All words of the texts. With `lower`, A-Z count as a-z."""
    body, offsets = _buffers(texts)
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    data = np.zeros(size + 8, np.uint8)
    data[:size] = _LOWER[body[base : base + size]] if lower else body[base : base + size]
    offsets = offsets - base
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = ~_SPACE[data[:size]]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    begins[cuts] = inside[cuts + 1]
    stops[cuts - 1] = inside[cuts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    lengths = ends - starts
    chunks = np.ndarray((size + 1,), "<u8", data.tobytes(), strides=(1,)) if size else np.zeros(1, "<u8")
    rest = np.minimum(lengths, 8)
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U)
    hashes = mix((chunks[starts] & masks[rest]) + lengths.astype(_U) * _ODD)
    more = np.flatnonzero(lengths > 8)
    at = 8
    while more.size:
        left = lengths[more] - at
        long = more[left > _LONG_WORD] if at == 8 else more[:0]
        for w in long:
            hashes[w] = int.from_bytes(blake2b(data[starts[w] : ends[w]].tobytes(), digest_size=8).digest(), "little")
        if long.size:
            more = more[left <= _LONG_WORD]
            left = lengths[more] - at
        value = chunks[starts[more] + at] & masks[np.minimum(left, 8)]
        hashes[more] = mix(hashes[more] * _FACTOR + value)
        at += 8
        more = more[left > 8]
    return Words(data, hashes, starts, ends, np.searchsorted(starts, offsets))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, which at its end returns what it has freed to the system: a worker that idles after a task keeps little of it."""

    def mapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return mapped
