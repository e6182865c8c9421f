"""Words and their hashes for whole Arrow batches, with numpy on the raw UTF-8 bytes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, that is ``[^\\x20\\x09-\\x0D]+``.
All hashes depend on the bytes alone, so they are equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TERM_SEPARATORS = np.ones(256, bool)
TERM_SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, CHUNK_BYTES)
        tables = []
        for step in (base, pow(base, -1, 2**64)):
            table = np.full(size, step, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        known = _POWERS[base] = (tables[0], tables[1])
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A hash of values[start:end] for each pair, from one running sum."""
    power, inverse = _powers(_BASES[which], len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def spaces(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each byte, to be hashed by ranges."""
    return _BYTE[data]


@dataclass
class Words:
    """Words of consecutive documents; ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def grams(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows and whether each lies within one document."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n)
        document = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return range_hashes(self.hashes, at, at + k, which), document[:n] == document[k - 1 :]

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _pieces(data: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``CHUNK_BYTES`` that cut no word; a longer word stays whole."""
    begin = 0
    while begin < len(data):
        end = begin + CHUNK_BYTES
        while end < len(data):
            found = np.flatnonzero(separators[data[end : end + 65536]])
            if len(found):
                end += int(found[0])
                break
            end += 65536
        end = min(end, len(data))
        yield begin, end
        begin = end


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _SPACE) -> Words:
    """Words of documents data[offsets[d]:offsets[d + 1]]; a long text is worked off in pieces."""
    if lower:
        data = _LOWER[data]
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin, end in _pieces(data, separators):
        part = data[begin:end]
        solid = ~separators[part]
        edge = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end)] - begin
        opens = np.append(True, ~solid[:-1])
        opens[edge] = True
        closes = np.append(~solid[1:], True)
        closes[edge[edge > 0] - 1] = True
        first, last = np.flatnonzero(solid & opens), np.flatnonzero(solid & closes) + 1
        starts.append(first + begin)
        ends.append(last + begin)
        hashes.append(range_hashes(_BYTE[part], first, last, 0))
    at = np.concatenate(starts)
    return Words(data, at, np.concatenate(ends), np.searchsorted(at, offsets), np.concatenate(hashes))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes (one row at least) with their bytes and offsets; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over values[i:i + width], for every full window."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
