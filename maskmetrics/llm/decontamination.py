"""Benchmark decontamination with a generalised suffix automaton.

The test items, as sequences of normalised words, are built into one automaton over all of them. A document's words are
streamed through it; after each word the automaton's state and matching length say what the longest run of words ending
there is that some item holds. A length of `window` or more is an occurrence of a window; items shorter than a window
are windows as a whole, found along the suffix links.

Scale: one scan of the documents, no shuffle. What is shipped to the executors is the automaton. The benchmark is read in
parts of at most `max_item_words` words, each with an automaton of its own and at most twice as many states, so no
broadcast grows with the benchmark; where there are several, the documents are scanned once for each part, what is found is
written before the next automaton is built, and the parts' findings are united by row. Words and neighbouring pairs that no item holds lead from any state back to the root within two steps: a vectorised
look at the pairs' hashes finds them, so that Python walks the automaton only where two words of some item meet.

Cases: a null text has no words. An item that is null or has no words gives no window. Items with equal words are all
named. A null item_id hits but isn't named. Repeated document rows are each judged. Column names besides the ones read are
kept as they are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import words as W
from .common import column, materialised, small_batches, unused, with_arrays

WINDOW = 10
MAX_ITEM_WORDS = 400_000


@dataclass
class Automaton:
    """A generalised suffix automaton over the words of items. ids: word hash -> symbol."""

    window: int
    ids: dict[int, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: state of a window's words -> items that hold it
    items: dict[int, set] = field(default_factory=dict)
    #: state of a whole short item -> {number of words: items}
    short: dict[int, dict[int, set]] = field(default_factory=dict)
    nearest_short: list[int] = field(default_factory=list)
    shortest: int = 1 << 30

    def _extend(self, last: int, symbol: int) -> int:
        step, link, length = self.step, self.link, self.length

        def split(parent: int, child: int) -> int:
            copy = len(step)
            step.append(dict(step[child]))
            link.append(link[child])
            length.append(length[parent] + 1)
            link[child] = copy
            while parent >= 0 and step[parent].get(symbol) == child:
                step[parent][symbol] = copy
                parent = link[parent]
            return copy

        known = step[last].get(symbol)
        if known is not None:
            return known if length[known] == length[last] + 1 else split(last, known)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            child = step[at][symbol]
            link[new] = child if length[child] == length[at] + 1 else split(at, child)
        return new

    def add(self, hashes: list[int]) -> None:
        last = 0
        for h in hashes:
            last = self._extend(last, self.ids.setdefault(h, len(self.ids)))
        if hashes:
            self.shortest = min(self.shortest, len(hashes), self.window)

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def name(self, item, hashes: list[int]) -> None:
        """After all items were added: says which states stand for this one's windows."""
        state = 0
        for n, h in enumerate(hashes, 1):
            state = self.step[state][self.ids[h]]
            if n >= self.window:
                self.items.setdefault(self._window_state(state), set()).add(item)
        if 0 < len(hashes) < self.window:
            self.short.setdefault(state, {}).setdefault(len(hashes), set()).add(item)

    def finish(self, sequences: list[list[int]]) -> None:
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        self.nearest_short = [-1] * len(self.step)
        for s in order:
            self.nearest_short[s] = s if s in self.short else self.nearest_short[self.link[s]]
        pairs = [W.runs(np.array(x, np.uint64), 2) for x in sequences if len(x) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        single = {h for h in self.ids if self.shortest == 1 and any(1 in self.short.get(s, {}) for s in [self.step[0].get(self.ids[h])])}
        self.single = np.array(sorted(single), np.uint64)

    def walk(self, symbols: list[int]) -> tuple[list[tuple[int, int]], set]:
        """The occurrences (first word, end) in a run of words, and the items they belong to."""
        step, link, length = self.step, self.link, self.length
        found, items, state, matched = [], set(), 0, 0
        for at, c in enumerate(symbols, 1):
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            if c in step[state]:
                state = step[state][c]
                matched += 1
            if matched >= self.window:
                found.append((at - self.window, at))
                items |= self.items[self._window_state(state)]
            s = self.nearest_short[state]
            while s > 0:
                for n, names in self.short[s].items():
                    if n <= matched:
                        found.append((at - n, at))
                        items |= names
                s = self.nearest_short[link[s]] if link[s] > 0 else -1
        return found, items


def _bitmap(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 18, bool)
    out[(values & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    return out


def _among(values: np.ndarray, sorted_values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    out = bitmap[(values & np.uint64((1 << 18) - 1)).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(at):
        near = np.minimum(np.searchsorted(sorted_values, values[at]), len(sorted_values) - 1)
        out[at] = sorted_values[near] == values[at]
    return out


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Automaton | None:
    """The automaton of (item_id, text) rows; None if none of them has a word."""
    data, offsets = W.text_buffers(pa.array([t for _, t in items], pa.string()))
    hashes, _, _, first = W.words(data, offsets, W.ALPHANUMERIC)
    sequences = [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    if not any(sequences):
        return None
    out = Automaton(window)
    for x in sequences:
        out.add(x)
    for (item, _), x in zip(items, sequences):
        out.name(item, x)
    out.finish(sequences)
    return out


def scan(column: pa.Array, automaton: Automaton):
    """For each text: (number of words, hit spans [(first word, end word, first byte, end byte)], items)."""
    if automaton is None:
        for _, _, data, offsets in W.chunks(column):
            for n in np.diff(W.words(data, offsets, W.ALPHANUMERIC)[3]).tolist():
                yield n, [], set()
        return
    pair_bits, single_bits = _bitmap(automaton.pairs), _bitmap(automaton.single)
    for lo, hi, data, offsets in W.chunks(column):
        hashes, start, end, first = W.words(data, offsets, W.ALPHANUMERIC)
        n = len(hashes)
        joined = np.zeros(n + 1, bool)  # joined[i]: words i - 1 and i follow one another in some item
        if n > 1 and len(automaton.pairs):
            joined[1:n] = _among(W.runs(hashes, 2), automaton.pairs, pair_bits)
            joined[first] = False
        begins = np.flatnonzero(~joined[:-1] & joined[1:])
        ends = np.flatnonzero(joined[:-1] & ~joined[1:]) + 1
        wide = ends - begins >= max(2, automaton.shortest)
        segments = list(zip(begins[wide].tolist(), ends[wide].tolist()))
        if len(automaton.single):
            alone = np.flatnonzero(_among(hashes, automaton.single, single_bits) & ~joined[:-1] & ~joined[1:])
            segments = sorted(segments + [(i, i + 1) for i in alone.tolist()])
        hit = np.zeros(n + 1, np.int32)
        items: dict[int, set] = {}
        rows = np.searchsorted(first, [a for a, _ in segments], "right") - 1
        ids = automaton.ids
        for (a, b), row in zip(segments, rows.tolist()):
            found, names = automaton.walk([ids[h] for h in hashes[a:b].tolist()])
            for x, y in found:
                hit[a + x] += 1
                hit[a + y] -= 1
            if found:
                items.setdefault(row, set()).update(names)
        covered = np.cumsum(hit[:n]) > 0
        for row in range(hi - lo):
            a, b = int(first[row]), int(first[row + 1])
            if row not in items:
                yield b - a, [], set()
                continue
            flags = np.concatenate(([False], covered[a:b], [False]))
            s, e = np.flatnonzero(~flags[:-1] & flags[1:]), np.flatnonzero(flags[:-1] & ~flags[1:])
            base = int(offsets[row])
            yield b - a, [(x, y, int(start[a + x]) - base, int(end[a + y - 1]) - base) for x, y in zip(s.tolist(), e.tolist())], {str(x) for x in items[row] if x is not None}


def parts(benchmark: DataFrame, max_item_words: int = MAX_ITEM_WORDS, item_id: str = "item_id", text: str = "text"):
    """The benchmark's (item_id, text) rows in lists of at most max_item_words words (or one longer item)."""
    part, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), F.col(text)).orderBy(item_id).toLocalIterator():
        n = len(W.words(*W.text_buffers(pa.array([row[1]], pa.string())), W.ALPHANUMERIC)[0])
        if part and size + n > max_item_words:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += n
    if part:
        yield part


def united(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans in order, those that overlap made one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, x, y in sorted(spans):
        if out and a <= out[-1][1]:
            first, end, at, to = out[-1]
            out[-1] = (first, max(end, b), at, max(to, y))
        else:
            out.append((a, b, x, y))
    return out


_SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_SPAN_TYPE = StructType([StructField(f.name, LongType()) for f in _SPAN])
_FOUND_TYPE = StructType().add("n_words", LongType()).add("spans", ArrayType(_SPAN_TYPE)).add("items", ArrayType(StringType()))


def findings(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS, text: str = "text", found: str = "_found") -> DataFrame:
    """docs with a column `found`: n_words; spans of hit words, as words and as UTF-8 bytes of the text; the items that occur."""
    spark, out, held = docs.sparkSession, docs, None
    small_batches(spark)
    names = [c for c in docs.columns if c != found]

    def scanned(out: DataFrame, held, again: bool) -> DataFrame:
        def run(texts: pa.Array, *before: pa.Array) -> list[pa.Array]:
            before = before[0].to_pylist() if before else None
            rows = []
            for i, (n, spans, items) in enumerate(scan(texts, held.value)):
                if before:
                    spans = united(spans + [tuple(x.values()) for x in before[i]["spans"]])
                    items |= set(before[i]["items"])
                rows.append({"n_words": n, "spans": [dict(zip(("first_word", "end_word", "start", "end"), x)) for x in spans], "items": sorted(items)})
            return [pa.array(rows, _FOUND)]

        return with_arrays(out, names, [text, found] if again else [text], [StructField(found, _FOUND_TYPE)], run)

    for rows in parts(benchmark, max_item_words):
        automaton = build(rows, window)
        if automaton is None:
            continue
        again = held is not None
        if again:  # the pass with the automaton before ends here, so that one at a time is held
            out = materialised(out, "findings")
            held.destroy()
        held = spark.sparkContext.broadcast(automaton)
        del automaton, rows
        out = scanned(out, held, again)
    return out if held is not None else scanned(out, spark.sparkContext.broadcast(None), False)


def hit_words(found: str = "_found"):
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("bigint"), lambda n, x: n + x["end_word"] - x["first_word"])


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the item ids that occur, sorted and comma-joined), contaminated, spans."""
    narrow = docs.select(F.col(doc_id), F.col(text).alias("text"))
    return findings(narrow, benchmark, **options).select(
        doc_id,
        F.col("_found.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("_found.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "_found.items").cast("binary"), 256).alias("items_sha256"),
        (F.size("_found.spans") > 0).alias("contaminated"),
        F.col("_found.spans").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, text: str = "text", **options) -> DataFrame:
    """docs without the spans that items share with them, and without the documents of which that is more than max_coverage of the words.

    The columns are docs' own; where n_chars is among them, it is counted anew for the texts that were cut. A document
    without a hit is kept byte for byte.
    """
    name, cut_text = unused(docs, "_found", "_cut")
    found = findings(docs, benchmark, text=text, found=name, **options)
    kept = found.where(hit_words(name) <= F.lit(max_coverage) * F.greatest(F.col(f"{name}.n_words"), F.lit(1)))
    raw = F.col(text).cast("binary")
    # pieces between the spans; substring() of binary counts bytes, from 1
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.col(f"{name}.spans.end"))
    begins = F.concat(F.col(f"{name}.spans.start"), F.array(F.octet_length(text).cast("bigint")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda p: F.decode(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "UTF-8"))
    cut = F.when(F.size(f"{name}.spans") > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    # under a name of its own first: a later expression over `text` would else see the cut text
    kept = kept.withColumn(cut_text, cut)
    columns = {text: F.col(cut_text)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.size(f"{name}.spans") > 0, F.length(cut_text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select([columns.get(c, column(c)).alias(c) for c in docs.columns])
