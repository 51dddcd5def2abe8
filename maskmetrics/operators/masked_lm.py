"""Information of spans by a masked language model that the caller brings: how surprising a span's subwords are where they stand.

Spans of one round are masked together, in one copy of their context (the whole text, or a sentence); the copy is cut into
segments, and a segment without a masked subword is never run. A span's information is -ln of the smallest probability
among the subwords that it overlaps, 0 without any. Probabilities are worked out in logarithms, so no logit overflows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fused, in_slices

MAX_SEGMENT_LENGTH = 100
BATCH = 128


class MaskedModel(Protocol):
    """What a provider brings. logits: of the subwords at (rows, columns) alone, one line of the vocabulary each."""

    mask_id: int

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and the spans (n, 2) in the text, ascending; a subword that stands for no characters has an empty span."""

    def logits(self, ids: np.ndarray, attention: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray: ...


class Segment(NamedTuple):
    group: str
    number: int
    ids: np.ndarray
    attention: np.ndarray
    columns: np.ndarray  # of the masked subwords, one for each span that hits it
    true: np.ndarray
    spans: np.ndarray


@lru_cache(maxsize=1)
def _loaded(load: Callable[[], MaskedModel]) -> MaskedModel:
    return load()


def overlapping(offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, subword) of each overlap."""
    solid = np.flatnonzero(offsets[:, 1] > offsets[:, 0])
    first = np.searchsorted(offsets[solid, 1], starts, "right")
    last = np.searchsorted(offsets[solid, 0], ends, "left")
    n = np.where(ends > starts, np.maximum(last - first, 0), 0)
    span = np.repeat(np.arange(len(starts)), n)
    return span, solid[np.repeat(first, n) + np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)]


def segments(model: MaskedModel, text: str, spans: np.ndarray, groups: list[str] | pa.Array, contexts: np.ndarray, length: int) -> Iterator[Segment]:
    """The masked segments of a text. spans, contexts: (start, end) of each span and of what the model sees around it."""
    coded = groups if isinstance(groups, pa.DictionaryArray) else pa.array(groups, pa.string()).dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    alike = not len(contexts) or bool((contexts == contexts[0]).all())
    for (a, z), members in _contexts(contexts, alike):
        ids, offsets = model.encode(text[a:z])
        span, subword = overlapping(offsets, spans[members, 0] - a, spans[members, 1] - a)
        span = members[span]
        order = np.lexsort((subword, code[span]))
        span, subword = span[order], subword[order]
        # a segment is what a round masks in `length` subwords
        whole = code[span] * (len(ids) // length + 1) + subword // length
        begins = np.flatnonzero(np.diff(whole, prepend=-1))
        for x, y, group in zip(begins.tolist(), [*begins[1:].tolist(), len(subword)], code[span[begins]].tolist()):
            number = int(subword[x]) // length
            part = ids[number * length : (number + 1) * length].copy()
            attention = np.ones(len(part), np.int64)
            columns = subword[x:y] - number * length
            true = part[columns]
            part[columns], attention[columns] = model.mask_id, 0
            yield Segment(names[group], number, part, attention, columns, true, span[x:y])


def _contexts(contexts: np.ndarray, alike: bool) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Each different context and the places that have it."""
    if alike:
        if len(contexts):
            yield tuple(contexts[0].tolist()), np.arange(len(contexts))
        return
    each, which = np.unique(contexts, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    for context, members in zip(each.tolist(), np.split(order, np.cumsum(np.bincount(which.ravel()))[:-1])):
        yield tuple(context), members


def _run(model: MaskedModel, held: list[Segment], ic: np.ndarray) -> None:
    ids, attention = (np.zeros((len(held), max(len(s.ids) for s in held)), np.int64) for _ in range(2))
    for i, s in enumerate(held):
        ids[i, : len(s.ids)], attention[i, : len(s.ids)] = s.ids, s.attention
    rows, columns = np.repeat(np.arange(len(held)), [len(s.columns) for s in held]), np.concatenate([s.columns for s in held])
    logits = np.asarray(model.logits(ids, attention, rows, columns), np.float64)
    top = logits.max(1)
    surprise = top + np.log(np.exp(logits - top[:, None]).sum(1)) - logits[np.arange(len(rows)), np.concatenate([s.true for s in held])]
    np.maximum.at(ic, np.concatenate([s.spans for s in held]), surprise)


def surprises(model: MaskedModel, text: str, spans: np.ndarray, groups: list[str], contexts: np.ndarray, length: int = MAX_SEGMENT_LENGTH, batch: int = BATCH) -> np.ndarray:
    """The information of each span; at most `batch` segments are held at once."""
    ic, held = np.zeros(len(spans)), []
    for segment in segments(model, text, spans, groups, contexts, length):
        held.append(segment)
        if len(held) == batch:
            _run(model, held, ic)
            held = []
    if held:
        _run(model, held, ic)
    return ic


def _alternating(texts: pa.Array, terms: Callable[[pa.Array], pa.Array], alternation: int):
    """A text, its terms (array of start, end), their rounds and contexts, of each row."""
    found = terms(texts)
    names = pa.array([str(i) for i in range(alternation)])
    spans, cuts, lo = found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False), 0
    edges = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.flatten()[:2]], 1)
    for text, n in zip(texts.to_pylist(), cuts.tolist()):
        text = text or ""
        yield text, edges[lo : lo + n], pa.DictionaryArray.from_arrays(pa.array((np.arange(n) % alternation).astype(np.int32)), names), np.tile([[0, len(text)]], (n, 1))
        lo += n


_GIVEN = "array<struct<round: string, segment: int, ids: array<bigint>, attention: array<bigint>, n_masked: int>>"


def _given(rows: list[list[Segment]]) -> pa.Array:
    """Segments of each row, as _GIVEN has them."""
    every = [s for row in rows for s in row]
    ends = pa.array(np.cumsum([0, *(len(s.ids) for s in every)]).astype(np.int32))
    whole = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))
    n_masked = [len(s.ids) - int(s.attention.sum()) for s in every]
    columns = [pa.array([s.group for s in every], pa.string()), pa.array([s.number for s in every], pa.int32()), *(pa.ListArray.from_arrays(ends, whole([s[k] for s in every])) for k in (2, 3)), pa.array(n_masked, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.StructArray.from_arrays(columns, ["round", "segment", "ids", "attention", "n_masked"]))


def _each(texts: pa.Array, of: pa.Array):
    """A text, its spans, their rounds and contexts, of each row."""
    lengths = pc.fill_null(pc.list_value_length(of), 0).to_numpy(zero_copy_only=False)
    start, end, names, since, until = of.flatten().flatten()
    numbers = lambda x, empty: pc.fill_null(x, empty).to_numpy(zero_copy_only=False).astype(np.int64)
    spans, contexts, names, lo = np.stack([numbers(start, 0), numbers(end, 0)], 1), np.stack([numbers(since, -1), numbers(until, 0)], 1), names.to_pylist(), 0
    for text, n in zip(texts.to_pylist(), lengths.tolist()):
        text, own = text or "", slice(lo, lo + n)
        yield text, spans[own], names[own], np.where(contexts[own, :1] < 0, [[0, len(text)]], contexts[own])
        lo += n


@dataclass(frozen=True)
class MaskedLM:
    """A provider of information for terms. load: makes the model, once in each Python worker."""

    load: Callable[[], MaskedModel]
    max_segment_length: int = MAX_SEGMENT_LENGTH
    batch: int = BATCH

    def limited(self, max_segment_length: int) -> MaskedLM:
        if max_segment_length < 1:
            raise ValueError(f"a segment has one subword at least, not {max_segment_length}")
        return replace(self, max_segment_length=max_segment_length)

    def _by_document(self, documents: DataFrame, spans: DataFrame | Column, sentences: DataFrame | None) -> DataFrame:
        """(doc_id, text, rows, of): a document's text goes along once for all its spans, and isn't moved where they are a column of its row."""
        if isinstance(spans, Column):
            seen = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["round"].cast("string").alias("round"), F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to"))
            return documents.select("doc_id", "text", spans.alias("rows")).withColumn("of", F.transform("rows", seen))
        if sentences is not None:
            spans = spans.where("sent_id IS NOT NULL").join(sentences.select("doc_id", "sent_id", F.col("start").alias("from"), F.col("end").alias("to")), ["doc_id", "sent_id"])
        else:
            spans = spans.withColumn("from", F.lit(None).cast("int")).withColumn("to", F.lit(None).cast("int"))
        seen = F.struct("start", "end", F.col("round").cast("string").alias("round"), "from", "to").alias("of")
        listed = spans.select("doc_id", F.struct(F.struct(*spans.columns).alias("row"), seen).alias("s")).groupBy("doc_id").agg(F.collect_list("s").alias("s"))
        return listed.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "text", F.col("s.row").alias("rows"), F.col("s.of").alias("of"))

    def weigh(self, documents: DataFrame, spans: DataFrame | Column, sentences: DataFrame | None = None) -> DataFrame:
        """spans (doc_id, start, end, round and any others) with ic; as a column, an array of structs of all but doc_id. Given sentences, spans have a sent_id, and those without one are left out."""
        load, length, batch = self.load, self.max_segment_length, self.batch

        @F.arrow_udf("array<double>")
        def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = _loaded(load)
            for given in batches:
                for part in in_slices(*given):
                    yield pa.array([surprises(model, *row, length, batch) for row in _each(*part)], pa.list_(pa.float64()))

        each = self._by_document(documents, spans, sentences).select("doc_id", "rows", found("text", "of").alias("ic"))
        each = each.select("doc_id", F.explode(F.arrays_zip("rows", "ic")).alias("z"))
        if isinstance(spans, Column):
            return each.select("doc_id", "z.rows.*", "z.ic")
        return each.select(*(F.col(f"z.rows.{c}").alias(c) for c in spans.columns), F.col("z.ic").alias("ic"))

    def weigh_texts(self, documents: DataFrame, terms: Callable[[pa.Array], pa.Array], alternation: int) -> DataFrame:
        """(doc_id, term_ord, ic) of the terms that a function finds in texts (arrays of start, end), every `alternation`th masked at a time; terms don't leave the slice of texts that has them."""
        load, length, batch = self.load, self.max_segment_length, self.batch

        def of(texts: pa.Array, _: pa.Array) -> pa.Array:
            model = _loaded(load)
            found = [surprises(model, *row, length, batch) for row in _alternating(texts, terms, alternation)]
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *found])))

        return documents.select("doc_id", F.posexplode(fused("array<double>", of)("text", "doc_id")).alias("term_ord", "ic"))

    def segments_of_texts(self, documents: DataFrame, terms: Callable[[pa.Array], pa.Array], alternation: int) -> DataFrame:
        """As masked_segments, of the same terms."""
        load, length = self.load, self.max_segment_length

        def of(texts: pa.Array, _: pa.Array) -> pa.Array:
            return _given([[*segments(_loaded(load), *row, length)] for row in _alternating(texts, terms, alternation)])

        return documents.select("doc_id", F.inline(fused(_GIVEN, of)("text", "doc_id")))

    def masked_segments(self, documents: DataFrame, spans: DataFrame | Column, sentences: DataFrame | None = None) -> DataFrame:
        """(doc_id, round, segment, ids, attention, n_masked): what the model is given."""
        load, length = self.load, self.max_segment_length

        @F.arrow_udf(_GIVEN)
        def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = _loaded(load)
            for batch in batches:
                for part in in_slices(*batch):
                    yield _given([[*segments(model, *row, length)] for row in _each(*part)])

        return self._by_document(documents, spans, sentences).select("doc_id", F.explode(found("text", "of")).alias("s")).select("doc_id", "s.*")


def subwords_of(documents: DataFrame, spans: DataFrame | Column, load: Callable[[], MaskedModel]) -> DataFrame:
    """spans with `subwords`, the places of the subwords that each overlaps."""

    @F.arrow_udf("array<array<int>>")
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in in_slices(*batch):
                out = []
                for text, at, _, _ in _each(*part):
                    span, subword = overlapping(_loaded(load).encode(text)[1], at[:, 0], at[:, 1])
                    ends = np.searchsorted(span, np.arange(len(at) + 1))
                    out.append([subword[x:y].tolist() for x, y in zip(ends[:-1], ends[1:])])
                yield pa.array(out, pa.list_(pa.list_(pa.int32())))

    if isinstance(spans, Column):
        each = MaskedLM(load)._by_document(documents, F.transform(spans, lambda s: s.withField("round", F.lit(""))), None)
        each = each.select("doc_id", F.explode(F.arrays_zip("rows", found("text", "of").alias("subwords"))).alias("z"))
        return each.select("doc_id", "z.rows.*", "z.subwords").drop("round")
    each = MaskedLM(load)._by_document(documents, spans.withColumn("round", F.lit("")), None)
    each = each.select(F.explode(F.arrays_zip("rows", found("text", "of").alias("subwords"))).alias("z"))
    return each.select(*(F.col(f"z.rows.{c}").alias(c) for c in spans.columns), F.col("z.subwords").alias("subwords"))
