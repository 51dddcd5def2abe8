"""Words and their 64-bit hashes, found in the UTF-8 bytes of many texts at once.

Everything works on the buffers of an Arrow string column, without a Python object per text or word. Memory is
bounded by PIECE bytes of text at a time (plus one word, should a single word be longer than that), times a constant;
the arrays returned have an entry per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_RADIX_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_class(word_byte) -> np.ndarray:
    """A table over the 256 bytes: is it part of a word?"""
    return np.array([bool(word_byte(b)) for b in range(256)])


#: `[^\x20\x09-\x0D]+`
BLANK_SEPARATED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z have been lower-cased
ALPHANUMERIC = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
#: byte -> byte with A-Z lower-cased
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_VALUES = _BYTE_VALUES[LOWER]

_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, PIECE + 4096)
        base = np.full(size, _RADIX)
        base[0] = 1
        _powers = np.cumprod(base, dtype=np.uint64)
        base = np.full(size, _RADIX_INVERSE)
        base[0] = 1
        _inverse_powers = np.cumprod(base, dtype=np.uint64)
    return _powers, _inverse_powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n, (_, offsets, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with at most limit bytes, or one longer text."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _cuts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes that end at a text's end or at a byte outside words."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + PIECE
        while hi < n:
            at = int(np.searchsorted(offsets, hi, "right")) - 1
            if offsets[at] > lo:
                hi = int(offsets[at])
                break
            gaps = np.flatnonzero(~table[data[max(lo + 1, hi - 4096) : hi]])
            if len(gaps):
                hi = max(lo + 1, hi - 4096) + int(gaps[-1])
                break
            hi += 4096
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): a word's hash (A-Z lower-cased) and its bytes; text i has words first[i] : first[i + 1]."""
    hashes, starts, ends = [], [], []
    for lo, hi in _cuts(data, offsets, table):
        part = data[lo:hi]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = table[part]
        edge = np.zeros(len(part) + 1, bool)
        a, b = np.searchsorted(offsets, [lo, hi])
        edge[offsets[a:b] - lo] = True
        begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        edge[-1] = True
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        power, inverse = _powers_to(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * power[: len(part)], out=total[1:])
        hashes.append((total[end] - total[begin]) * inverse[begin])
        starts.append(begin + lo)
        ends.append(end + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return mix(np.concatenate(hashes)), start, np.concatenate(ends), np.searchsorted(start, offsets)


def hash_word(word: str | bytes, table: np.ndarray = BLANK_SEPARATED) -> int:
    """The hash that words() gives a word."""
    data = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(words(data, np.array([0, len(data)]), table)[0][0])


_SHIFTS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on that has as many after it, without regard to the texts' ends."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i : i + len(out)] * _SHIFTS[i]
    return mix(out + np.uint64(n))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted set of its n-word shingles; the whole sequence if it has fewer, but some, words."""
    every = runs(hashes, n)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= n:
            s = np.sort(every[lo : hi - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif hi > lo:
            out.append(runs(hashes[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
