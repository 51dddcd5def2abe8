"""Periodic runs of words: every maximal repetition of a document, by its Lyndon roots, without a suffix array.

A run with period q is a longest stretch in which words q apart are equal, of at least two periods. Scanned from right to left, a
stack holds, for each position, the beginning of the next smaller suffix: what lies between is the longest Lyndon word there.
Under one of two orders (words by their number, and the reverse) the root of every run is such a word. So both orders are
scanned, and a candidate (i, j) with the same first word, root i..j, is extended: to the right by the longest common
extension of i and j, which the comparison has found already, to the left by that of the reversed text.

Longest common extensions (LCE) are looked for word by word first, then by binary search over a rolling hash of word numbers, and
verified directly on the words themselves: hash equality can only be too long, so the first differing word in what
it gives is the exact answer. Extensions are kept by distance, so that each stretch is verified once for a distance. Results do not
depend on the hash. Time is O(n log n) for n words, memory O(n) for one document at a time; documents don't meet, so there is
no shuffle, and a lost executor's documents are scanned anew.

Cases: a null or empty text has no words, no runs, and an empty collapsed text. Words are byte strings `[^\\x20\\x09-\\x0D]+` and
compared as they are. Repeated rows are scanned each. Other columns are kept as they are, whatever their names; those named as
the added ones give way to them. An empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, per_batch, small_batches

MIN_LENGTH = 6
MIN_PERIODS = 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: words compared one by one before the hash is asked
NEAR = 8
_RADIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Extensions:
    """LCE of pairs of positions in a list of word numbers."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.array = np.array(ids, np.int32)
        self.known: dict[int, tuple[int, int]] = {}  # distance -> (position, its LCE), of the leftmost position so far
        self.hashes: list[int] | None = None

    def _hash(self) -> None:
        """hashes[k]: of the first k words; powers[k]: the radix to the k."""
        spread = (self.array.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        spread ^= spread >> np.uint64(29)
        powers = np.full(self.n + 1, _RADIX, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(spread * powers[:-1], out=total[1:])
        self.hashes, self.powers = total.tolist(), powers.tolist()

    def _equal(self, i: int, j: int, m: int) -> bool:
        """Do m words from i and from j on hash alike? (i <= j)"""
        h = self.hashes
        return ((h[i + m] - h[i]) * self.powers[j - i] - h[j + m] + h[j]) & _MASK == 0

    def _verified(self, i: int, j: int, m: int) -> int:
        """How many of m words from i and j on are equal, up to the first that isn't."""
        done, step = 0, 64
        while done < m:
            end = min(m, done + step)
            differ = self.array[i + done : i + end] != self.array[j + done : j + end]
            if differ.any():
                return done + int(differ.argmax())
            done, step = end, step * 4
        return m

    def right(self, i: int, j: int) -> int:
        """The number of equal words from i and from j on, i < j. Positions of one distance are best asked from right to left."""
        ids, most = self.ids, self.n - j
        near = min(NEAR, most)
        for m in range(near):
            if ids[i + m] != ids[j + m]:
                return m
        if near == most:
            return most
        at, length = self.known.get(j - i, (self.n, 0))
        gap = at - i
        if gap < 0:
            gap = most  # asked before, further left: not of use here
        if gap <= NEAR:
            found = gap + length
        else:
            if self.hashes is None:
                self._hash()
            low, high = near, min(most, gap)
            if not self._equal(i, j, high):
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if self._equal(i, j, middle) else (low, middle)
                high = low
            found = near + self._verified(i + near, j + near, high - near)
            if found == gap < most:
                found += length
        if i < at:
            self.known[j - i] = (i, found)
        return found

    def left(self, i: int, j: int) -> int:
        """The number of equal words before i and before j, i < j."""
        near = min(NEAR, i)
        for m in range(near):
            if self.ids[i - 1 - m] != self.ids[j - 1 - m]:
                return m
        if near == i:
            return i
        if self.hashes is None:
            self._hash()
        low, high = near, i
        if not self._equal(i - high, j - high, high):
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if self._equal(i - middle, j - middle, middle) else (low, middle)
            high = low
        done, step = near, 64
        while done < high:
            end = min(high, done + step)
            differ = self.array[i - end : i - done] != self.array[j - end : j - done]
            if differ.any():
                return done + int(differ[::-1].argmax())
            done, step = end, step * 4
        return high


def runs(ids: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least min_length words and min_periods (2 or more) periods, by start and period."""
    if min_periods < 2:
        raise ValueError("a run has at least two periods")
    n = len(ids)
    if n < max(min_length, min_periods):
        return []
    extensions, found = Extensions(ids), set()
    extend = extensions.right
    for order in (ids, [-x for x in ids]):
        extensions.known.clear()
        stack: list[int] = []
        begun: dict[int, int] = {}  # period -> start of the run found last, the leftmost
        for i in range(n - 1, -1, -1):
            word = order[i]
            while stack:
                j = stack[-1]
                other = order[j]
                if other < word:
                    break
                if other == word:
                    same = extend(i, j)
                    end = j + same
                    if end == n or order[end] < order[i + same]:
                        # j begins the next smaller suffix: order[i:j] is the longest Lyndon word at i
                        period = j - i
                        if same > (min_periods - 2) * period and begun.get(period, n) > i:
                            start = i - extensions.left(i, j)
                            begun[period] = start
                            if end - start >= max(min_length, min_periods * period):
                                found.add((start, end - start, period))
                        break
                stack.pop()
            stack.append(i)
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """[start, end) of the words that some run has after its first period, merged, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s + p, s + length) for s, length, p in found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scanned(text: bytes, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> tuple[list[tuple[int, int, int]], bytes]:
    """(runs, the words that stay joined by one space) of a text."""
    words = WORD.findall(text)
    numbers: dict[bytes, int] = {}
    found = runs([numbers.setdefault(w, len(numbers)) for w in words], min_length, min_periods)
    for start, end in reversed(dropped(found)):
        del words[start:end]
    return found, b" ".join(words)


def detected(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """docs with runs (an array of start, length, period, counted in words, by start and period) and collapsed (its text without repetitions)."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    # by position, so that names don't matter to the Arrow schema
    narrow = docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(kept)), F.coalesce(column(text), F.lit("")).cast("binary").alias("t"))
    run = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("runs", T.ArrayType(run, False), False), T.StructField("collapsed", T.BinaryType(), False)])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def scan(batch: pa.RecordBatch):
        found, texts = [], []
        for t in batch.column(len(kept)):
            r, collapsed = scanned(t.as_buffer().to_pybytes(), min_length, min_periods)
            found.append([dict(zip(("start", "length", "period"), x)) for x in r])
            texts.append(collapsed)
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, kind), pa.array(texts, pa.binary())], names=schema.names)

    out = narrow.mapInArrow(per_batch(scan), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "runs", F.col("collapsed").cast("string").alias("collapsed"))
