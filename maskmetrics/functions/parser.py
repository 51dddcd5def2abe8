"""Parsers: sentences of tokens with entities and word classes, and the noun chunks over these classes.

The parser of this module needs no model: tokens by pattern, entities by form, listed words and endings as classes, no lemmas but
lower case. A parser with learned taggers (operators.tagger) puts in another analysis and has all the rest from here. Frames of any
other one with the same columns can take its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from . import text as T

#: Closed classes of common words: adpositions, particles, coordinating conjunctions, determiners.
CLOSED_CLASSES = {
    "ADP": ["of", "in", "to", "for", "with", "on", "at", "by", "from", "into", "over", "under", "between", "through", "after", "before", "during", "against", "without", "within"],
    "PART": ["not", "n't", "'s"],
    "CCONJ": ["and", "or", "but", "nor", "yet"],
    "DET": ["the", "a", "an", "this", "that", "these", "those", "each", "every", "some", "any"],
}
STOP_WORDS = sorted({w for ws in CLOSED_CLASSES.values() for w in ws} | {"is", "are", "was", "were", "be", "been", "it", "its", "as", "he", "she", "they", "we", "you", "i", "his", "her", "their"})
_ENTITIES = re.compile(r"(?P<EMAIL>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<IP>\d{1,3}(?:\.\d{1,3}){3})|(?P<CARD>\d{13,19})|(?P<PERSON>[A-Z][a-z]+(?: [A-Z][a-z]+)+)|(?P<QUANTITY>\d+(?:[.,]\d+)*)")
_TOKENS = re.compile(r"(\w+|[^\w\s])")
_SENTENCES = re.compile(r"(?:[^.!?\n]|[.!?](?!\s|$))+[.!?]*")
#: Closed classes that measures don't ask for, and endings of open classes; what else is no number, mark or capitalised is a noun.
MORE_CLASSES = {
    "PRON": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "who"],
    "AUX": ["is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "have", "has", "had", "will", "would", "can", "could", "may", "might", "shall", "should", "must"],
}
OPEN_ENDINGS = {"NOUN": ["tion", "sion", "ment", "ness", "ity", "ism", "ance", "ence", "ship"], "ADV": ["ly"], "ADJ": ["able", "ible", "ous", "ful", "less", "ive", "ic", "al"], "VERB": ["ing", "ed", "ize", "ise", "ify"]}
#: The transducer of noun chunks reads a letter for each token's class (O: any other) and marks what matches, leftmost and longest.
LETTERS = {"DET": "D", "ADJ": "A", "NUM": "U", "NOUN": "N", "PROPN": "N", "PRON": "R"}
NOUN_CHUNK = "D?[AUN]*N|R"
_CHUNK = re.compile(NOUN_CHUNK)
_TOKEN = (
    StructType()
    .add("tok_ord", IntegerType()).add("start", IntegerType()).add("end", IntegerType()).add("text", StringType())
    .add("ent_id", IntegerType()).add("ent_label", StringType()).add("pos", StringType())
)
#: What analysing a text gives: its sentences' tokens, each with the entity that holds it (by its start) and its class.
ANALYSED = ArrayType(ArrayType(_TOKEN))
IGNORABLE_WORDS = sorted({*T.TOKENS_TO_IGNORE, *(w for c in T.POS_TO_IGNORE for w in CLOSED_CLASSES.get(c, []))})


#: The same without addresses, which have an @; what is left begins with a capital or a digit, and that is asked first.
_NO_ADDRESS = re.compile(r"(?=[A-Z\d])(?:" + _ENTITIES.pattern.split("|", 1)[1] + ")")


def entities_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, label) of the patterns' matches. None goes beyond a line, and addresses are looked for in lines with an @ only."""
    found, at = [], 0
    while (hit := text.find("@", at)) >= 0:
        begin, end = text.rfind("\n", at, hit) + 1 or at, text.find("\n", hit)
        end = len(text) if end < 0 else end
        found += [(*m.span(), m.lastgroup) for m in _NO_ADDRESS.finditer(text, at, begin)]
        found += [(*m.span(), m.lastgroup) for m in _ENTITIES.finditer(text, begin, end)]
        at = end
    return found + [(*m.span(), m.lastgroup) for m in _NO_ADDRESS.finditer(text, at)]


def sliced(kind: ArrayType) -> Callable:
    """A column function of what makes one array of another, slice by slice of the texts."""

    def wrapped(of: Callable[[pa.Array], pa.Array]):
        @F.arrow_udf(kind)
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                for (part,) in T.in_slices(texts):
                    yield of(part)

        found.of = of
        return found

    return wrapped


@sliced(ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("label", StringType())))
def entity_spans(texts: pa.Array) -> pa.Array:
    ends, rows = [0], []
    for text in texts.to_pylist():
        rows.extend(entities_of(text or ""))
        ends.append(len(rows))
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "end", "label"]))


def tokens_of(text: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(spans, words, first): the text's tokens and the places at which sentences begin among them."""
    start, end, words = T.cut(_TOKENS, text)
    spans = np.stack([start, end], 1).astype(np.int32)
    begins = np.asarray([m.start() for m in _SENTENCES.finditer(text)], np.int32)
    # what no sentence holds (marks that begin a text or a line) goes with the sentence before it
    of = np.searchsorted(begins, spans[:, 0], "right")
    return spans, words, np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)


_CLOSED = {w: name for name, members in reversed([*CLOSED_CLASSES.items(), *MORE_CLASSES.items()]) for w in members}
_ENDS = [(e, name) for name, members in OPEN_ENDINGS.items() for e in members]


@lru_cache(1 << 16)
def listed_class(word: str) -> str:
    """The class of a token by lists, form and endings."""
    low, c = word.lower(), word[0]
    if low in _CLOSED:
        return _CLOSED[low]
    if c in "0123456789":
        return "NUM"
    if not (c.isalnum() or c == "_"):
        return "PUNCT"
    if c.isupper():
        return "PROPN"
    return next((name for e, name in _ENDS if low.endswith(e) and len(low) > len(e) + 1), "NOUN")


@lru_cache(1 << 16)
def _letter(word: str) -> str:
    return LETTERS.get(listed_class(word), "O")


@sliced(ANALYSED)
def token_spans(texts: pa.Array) -> pa.Array:
    """A text's sentences of tokens, each with the entity that holds it and its class."""
    outer, inner, rows = [0], [0], []
    for text in texts.to_pylist():
        entities, at = entities_of(text or ""), 0
        spans, words, first = tokens_of(text or "")
        inner.extend((np.append(first[1:], len(words)) + len(rows)).tolist() if words else [])
        outer.append(len(inner) - 1)
        for i, ((start, end), word) in enumerate(zip(spans.tolist(), words)):
            while at < len(entities) and entities[at][1] <= start:
                at += 1
            own = entities[at] if at < len(entities) and entities[at][0] <= start and end <= entities[at][1] else (None, None, None)
            rows.append((i, start, end, word, own[0], own[2], listed_class(word)))
    columns = [pa.array([r[k] for r in rows], pa.string() if f.dataType == StringType() else pa.int32()) for k, f in enumerate(_TOKEN.fields)]
    struct = pa.StructArray.from_arrays(columns, _TOKEN.names)
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), struct))


def noun_chunks_of(words: list[str], first: np.ndarray) -> np.ndarray:
    """(begin, stop) of the noun chunks among a text's tokens, of whose sentences `first` has the beginnings."""
    letters = "".join(map(_letter, words))
    chunks = np.asarray([m.span() for m in _CHUNK.finditer("|".join([letters[a:z] for a, z in zip(first.tolist(), [*first[1:].tolist(), len(words)])]))], np.int64).reshape(-1, 2)
    return chunks - (np.searchsorted(first + np.arange(len(first)), chunks[:, :1], "right") - 1)  # the marks between sentences are no tokens


def terms_by(chunks_of: Callable[[list[str], np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function of a text's terms in their order, as measures.terms_of has them: entities, then chunks that share no token with one, then tokens.

    chunks_of: (begin, stop) of chunks, ascending and disjoint, among a text's words, of whose sentences the first ones are known.
    """

    @sliced(ArrayType(T.SPAN))
    def found(texts: pa.Array) -> pa.Array:
        ends, edges = [0], []
        for text in texts.to_pylist():
            spans, words, first = tokens_of(text or "")
            inner = np.zeros(len(words), bool)  # goes on with the term of the token before it
            own = np.zeros(len(words) + 1, np.int32)  # in an entity
            for start, end, _ in entities_of(text or ""):
                a, z = np.searchsorted(spans[:, 0], start), np.searchsorted(spans[:, 1], end, "right")
                inner[a + 1 : z], own[a + 1 : z + 1] = True, 1
            before = np.cumsum(own)  # tokens in entities before a token
            chunks = chunks_of(words, first)
            begin, stop = chunks[before[chunks[:, 1]] == before[chunks[:, 0]]].T
            steps = np.bincount(begin + 1, minlength=len(words) + 2) - np.bincount(stop, minlength=len(words) + 2)
            inner |= np.cumsum(steps)[: len(words)] > 0
            at = np.flatnonzero(~inner)
            edges.append(np.stack([spans[at, 0], spans[np.append(at[1:], len(words)) - 1, 1]], 1) if len(at) else spans)
            ends.append(ends[-1] + len(at))
        edges = np.concatenate(edges) if edges else np.zeros((0, 2), np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(edges[:, k].astype(np.int32)) for k in range(2)], ["start", "end"]))

    return found


#: Terms with the parser's own chunks.
chunked_terms = terms_by(noun_chunks_of)


def chunk_places(classes: Column, pattern: str = NOUN_CHUNK) -> Column:
    """For the classes (array of strings) of a sentence's tokens: an array with the place of the first token of each token's chunk, null outside.

    A finite-state transducer as a pattern over one letter a token: it puts marks around what it accepts, and the lengths
    between marks lead back to places.
    """
    letter = F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))
    letters = F.array_join(F.transform(classes, lambda c: F.coalesce(F.element_at(letter, F.coalesce(c, F.lit(""))), F.lit("O"))), "")
    parts = F.split(F.regexp_replace(letters, f"({pattern})", "<$1>"), "[<>]")  # outside, inside, outside, ..
    empty = F.array().cast("array<struct<at:int,n:int,inside:boolean>>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("walked"))

    def walk(s: Column, p: Column) -> Column:
        here = F.struct(s["at"].alias("at"), F.length(p).alias("n"), s["inside"].alias("inside"))
        return F.struct((s["at"] + F.length(p)).alias("at"), (~s["inside"]).alias("inside"), F.concat(s["walked"], F.array(here)).alias("walked"))

    walked = F.aggregate(parts, begin, walk, lambda s: s["walked"])
    return F.flatten(F.transform(walked, lambda w: F.array_repeat(F.when(w["inside"], w["at"]), w["n"])))


class Parser:
    """What measures want of a parser, from one analysis of a text; here by patterns and lists."""

    def analysed(self, text: Column) -> Column:
        """A text's sentences (array of arrays of tok_ord, start, end, text, ent_id, ent_label, pos)."""
        return token_spans(text)

    def tokens(self, documents: DataFrame) -> DataFrame:
        """(doc_id, tok_ord, start, end, text, lower, pos, lemma, is_stop, ent_id, ent_label, chunk_id): a noun chunk goes by its first token."""
        sentences = documents.select("doc_id", F.explode(self.analysed(F.col("text"))).alias("s"))
        places = sentences.select("doc_id", "s", chunk_places(F.col("s.pos")).alias("places"))
        each = places.select("doc_id", F.col("s")[0]["tok_ord"].alias("begin"), F.explode(F.arrays_zip("s", "places")).alias("z")).select("doc_id", "begin", "z.s.*", F.col("z.places").alias("place"))
        lower = F.lower("text")
        return each.select(
            "doc_id", "tok_ord", "start", "end", "text", lower.alias("lower"), "pos", lower.alias("lemma"), F.col("text").isin(STOP_WORDS).alias("is_stop"),
            "ent_id", "ent_label", (F.col("begin") + F.col("place")).alias("chunk_id"),
        )

    def ignorable(self, documents: DataFrame, words: DataFrame) -> DataFrame:
        """(doc_id, start, end) of words whose class or form may stay unmasked."""
        return ignorable_tokens(words)

    def with_entity_types(self, texts: DataFrame) -> DataFrame:
        """texts with every entity replaced by its type."""
        return with_entity_types(texts)

    def curate(self, texts: DataFrame) -> DataFrame:
        return curate(texts)


PATTERNS = Parser()


def tokens(documents: DataFrame) -> DataFrame:
    """The tokens of the parser that needs no model."""
    return PATTERNS.tokens(documents)


def ignorable_tokens(words: DataFrame) -> DataFrame:
    """(doc_id, start, end) of words whose class or form may stay unmasked."""
    return words.where(F.lower("word").isin(IGNORABLE_WORDS)).select("doc_id", "start", "end")


#: The same in a text, as an array.
ignorable_spans = T.spans(r"\w+", among=frozenset(IGNORABLE_WORDS))


def with_entity_types(texts: DataFrame) -> DataFrame:
    """texts with every entity replaced by its type."""
    ents = F.transform(entity_spans("text"), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("replacement")))
    return texts.withColumn("_ents", ents).withColumn("text", T.apply_masking(F.col("text"), F.col("_ents"))).drop("_ents")


def curate(texts: DataFrame) -> DataFrame:
    """texts rebuilt without stop words, in lower case, row by row."""
    found = F.regexp_extract_all(F.col("text"), F.lit(f"({T.WORD}+|[^\\p{{L}}\\p{{N}}_\\s])"), F.lit(1))
    parts = F.transform(found, lambda t: F.struct(t.alias("text"), F.lower(t).alias("lemma"), t.isin(STOP_WORDS).alias("is_stop")))
    return texts.withColumn("text", T.curated(parts))
