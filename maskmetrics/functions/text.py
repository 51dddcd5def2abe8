"""Column functions on texts: spans of tokens, masking, mask marks, curation, and vectors of words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

#: The fixed values of the measures: marks that anonymizers leave, in their order; what may stay unmasked.
MASK_MARKS = [
    "SENSITIVE", "PERSON", "DEM", "LOC", "ORG", "DATETIME", "QUANTITY", "MISC", "NORP", "FAC", "GPE", "PRODUCT", "EVENT",
    "WORK_OF_ART", "LAW", "LANGUAGE", "DATE", "TIME", "ORDINAL", "CARDINAL", "DATE_TIME", "DATETIME", "NRP", "LOCATION",
    "ORGANIZATION", r"\*\*\*",
]
POS_TO_IGNORE = ["ADP", "PART", "CCONJ", "DET"]
TOKENS_TO_IGNORE = ["mr", "mrs", "ms", "no", "nr", "about"]
CHARACTERS_TO_IGNORE = " ,.-;:/&()[]–'\"’“”"

WORD = r"[\p{L}\p{N}_]"
SPAN = StructType().add("start", IntegerType()).add("end", IntegerType())


TOKEN = StructType().add("start", IntegerType()).add("end", IntegerType()).add("text", StringType())
PIECE = StructType().add("i", IntegerType()).add("n", IntegerType()).add("start", IntegerType()).add("end", IntegerType()).add("text", StringType())


def rows_of(**fields: DataType) -> ArrayType:
    """The type of an array of structs."""
    return ArrayType(StructType([StructField(name, kind) for name, kind in fields.items()]))


#: Bytes of text whose matches a task's Python holds at a time; one text of more is held by itself.
SLICE = 1 << 20


def in_slices(texts: pa.Array, *others: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of arrays of one length, each of about SLICE bytes of text, or of one row: what is made of a batch goes out piece by piece."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE)) + 1).tolist(), len(texts)]
    for a, z in zip(cuts[:-1], cuts[1:]):
        if a < z:
            yield tuple(x.slice(a, z - a) for x in (texts, *others))


def fused(kind: str, of: Callable[..., pa.Array]) -> Callable:
    """A column function of texts and what stands beside them: `of` slices of them. What it makes on the way stays in Python and is of one slice only."""

    @F.arrow_udf(kind)
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in in_slices(*batch):
                yield of(*part)

    return found


def cut(pattern: re.Pattern, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(starts, ends, texts) of a pattern's matches, none of them empty. The pattern is one group, and has no other."""
    parts = pattern.split(text)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return ends[:-1:2], ends[1::2], parts[1::2]


def _numbers(values: list) -> pa.Array:
    return pa.array(np.asarray(values, np.int32))


def spans(pattern: str, with_text: bool = False, among: frozenset[str] | None = None) -> Callable[[Column], Column]:
    """The spans of a (Python) pattern's matches in a text, in code points, from one Arrow batch to another; nothing is shuffled. among: in lower case, those to keep."""
    compiled = re.compile(f"({pattern})")

    def matched(texts: pa.Array) -> pa.Array:
        found = [cut(compiled, text or "") for text in texts.to_pylist()]
        if among is not None:
            keep = [np.fromiter((w.lower() in among for w in words), bool, len(words)) for _, _, words in found]
            found = [(a[k], z[k], [w for w, x in zip(words, k.tolist()) if x] if with_text else k.nonzero()[0]) for (a, z, words), k in zip(found, keep)]
        sizes = np.cumsum([0, *(len(words) for _, _, words in found)])
        columns, names = [pa.array(np.concatenate([np.zeros(0, np.int32), *(f[k] for f in found)]).astype(np.int32)) for k in (0, 1)], ["start", "end"]
        if with_text:
            columns, names = [*columns, pa.array([w for _, _, words in found for w in words], pa.string())], [*names, "text"]
        return pa.ListArray.from_arrays(_numbers(sizes), pa.StructArray.from_arrays(columns, names))

    @F.arrow_udf(ArrayType(TOKEN if with_text else SPAN))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for (part,) in in_slices(texts):
                yield matched(part)

    found.of = matched
    return found


def spans_within(pattern: str) -> Callable[[Column, Column, Column], Column]:
    """What a pattern matches in slices of a text, given by arrays of starts and ends: the slice's place i, the match's place n in it, its span in the text and its text."""
    compiled = re.compile(pattern, re.DOTALL)

    def matched(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        sizes, rows, words = [0], [], []
        for text, a, z in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            for i, (x, y) in enumerate(zip(a or (), z or ())):
                for n, m in enumerate(compiled.finditer(text or "", max(x, 0), max(x, y, 0))):
                    rows.append((i, n, *m.span()))
                    words.append(m.group())
            sizes.append(len(rows))
        rows = np.asarray(rows, np.int32).reshape(-1, 4)
        return pa.ListArray.from_arrays(_numbers(sizes), pa.StructArray.from_arrays([*(pa.array(rows[:, k].copy()) for k in range(4)), pa.array(words, pa.string())], ["i", "n", "start", "end", "text"]))

    @F.arrow_udf(ArrayType(PIECE))
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in in_slices(*batch):
                yield matched(*part)

    return found


#: Words; words and other visible characters; runs of what may not be ignored; a slice as a whole.
word_spans = spans(r"\w+")
word_texts = spans(r"\w+", with_text=True)
term_spans = spans(r"\w+|[^\w\s]")
term_texts = spans(r"\w+|[^\w\s]", with_text=True)
words_within = spans_within(r"\w+")
solid_within = spans_within("[^" + re.escape(CHARACTERS_TO_IGNORE) + "]+")
wholes_within = spans_within(".+")


def matches_in(slices: DataFrame, documents: DataFrame, found: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """slices' columns (doc_id, start and end among them) as a struct `of`, and `p`, one match of `found` in the slice.

    A document's text goes along once for all its slices, and no copy of it for each.
    """
    by_document = slices.groupBy("doc_id").agg(F.collect_list(F.struct(*slices.columns)).alias("_of"))
    each = by_document.join(documents.select("doc_id", "text"), "doc_id").select("_of", F.explode(found(F.col("text"), F.col("_of.start"), F.col("_of.end"))).alias("p"))
    return each.select(F.get("_of", F.col("p.i")).alias("of"), "p")


def slice_of(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], clipped to the text."""
    return F.substr(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def masked(text: str, masks: list[tuple[int, int, str | None]]) -> str:
    """text with what is in the place of each mask (start, end, replacement), from the last listed to the first, nulls as nothing.

    Ascending lists, which may overlap, take one pass; others shift as the measures' definition has it.
    """
    at, after = len(text), []  # what is done is text[:at] and then `after`, last piece first
    for start, end, replacement in reversed(masks):
        if start > at or end < 0:
            text = text[:at] + "".join(reversed(after))
            # as substr has it, a place before the text counts from its end
            at, after, end = len(text), [], end if end >= -1 else max(len(text) + end + 1, 0)
        start, end = min(max(start, 0), at), max(end, 0)
        if end <= at:
            after.append(text[end:at])
        else:
            gone = end - at
            while gone and after:
                piece = after.pop()
                if len(piece) > gone:
                    after.append(piece[gone:])
                gone -= min(gone, len(piece))
        after.append(replacement or "")
        at = start
    return text[:at] + "".join(reversed(after))


@F.arrow_udf(StringType())
def apply_masking(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The masked texts, of texts and their maskings (array of start, end, replacement); null where either is."""
    for batch in batches:
        for texts, lists in in_slices(*batch):
            fields = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten()))
            columns = [fields[c].to_pylist() for c in ("start", "end", "replacement")]
            cuts = np.cumsum([0, *(n or 0 for n in pc.list_value_length(lists).to_pylist())]).tolist()
            known = lists.is_valid().to_pylist()
            yield pa.array([masked(t, [*zip(*(c[a:z] for c in columns))]) if t is not None and k else None for t, k, a, z in zip(texts.to_pylist(), known, cuts[:-1], cuts[1:])], pa.string())


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def marks_pattern(marks: list[str] = MASK_MARKS) -> str:
    """One alternation of the upper-cased marks; a mark that is no valid pattern stands for itself."""
    parts = []
    for mark in marks:
        try:
            re.compile(mark.upper())
            parts.append(mark.upper())
        except re.error:
            parts.append(re.escape(mark.upper()))
    return "|".join(parts)


def remove_mask_marks(text: Column, marks: list[str] = MASK_MARKS) -> Column:
    return stripped(F.regexp_replace(text, marks_pattern(marks), ""))


def blank_to_null(replacement: Column) -> Column:
    return F.when(replacement.rlike(r"(?U)^\s*$"), None).otherwise(replacement)


def curated(tokens: Column) -> Column:
    """A document rebuilt from its tokens (array of text, lemma, is_stop): stop words go, lemmas stand for words."""
    piece = lambda t: F.regexp_replace(F.when(F.coalesce(t["lemma"], F.lit("")) == "", t["text"]).otherwise(t["lemma"]), r"[^ \nA-Za-z0-9À-ÖØ-öø-ÿЀ-ӿ./]+", "")
    pieces = F.transform(F.filter(tokens, lambda t: ~t["is_stop"]), piece)
    return F.array_join(F.transform(pieces, lambda p: F.when(p == ".", p).otherwise(F.concat(F.lit(" "), p))), "")


def sentences(text: Column) -> Column:
    """Paragraphs, then sentences: after . ! or ? and white space. Tokens are joined by one blank; blank ones go."""
    lines = F.split(text, "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(stripped(s), r"\s+", " ")), lambda s: s != "")


def windows(tokens: Column, length: int, overlap: int) -> Column:
    """Slices of length - 2 tokens (two places are for marks), each beginning length - overlap - 2 after the one before."""
    content, step = length - 2, length - overlap - 2
    if step < 1:
        raise ValueError("windows must move on")
    n = F.size(tokens)
    number = F.when(n <= content, 1).otherwise(F.ceil((n - content) / F.lit(step)).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.slice(tokens, i * step + 1, content))


def window_setting(setting: str) -> tuple[int, int] | None:
    """(length, overlap) of "512-128"; None, which means sentences, for what can't be read so."""
    try:
        length, overlap = map(int, setting.split("-"))
    except (ValueError, AttributeError):
        return None
    return length, overlap


BAG = 16


def bag_of_words(text: Column, size: int = BAG) -> Column:
    """A vector that counts a text's words by a hash of first character and length: what stands in for a language model's."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD}+)"), F.lit(1))
    if not 1 <= size <= 128:
        raise ValueError("a bag has 1 to 128 cells")
    # a letter for each word's cell: a text is walked once, and its letters are counted by what is left without one
    cells = F.array_join(F.transform(found, lambda w: F.char((F.ascii(w) * 31 + F.length(w) * 7) % size + 48)), "")
    return F.transform(F.array(F.struct(cells.alias("c"))), lambda s: F.array(*((F.length(s["c"]) - F.length(F.translate(s["c"], chr(48 + i), ""))).cast("double") for i in range(size))))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is null or has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def metric_key(name: str) -> str:
    return name.split("_", 1)[0]
