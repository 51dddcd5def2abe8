"""Precision, recall, and preserved information and similarity, for all anonymizations at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import by_document as D
from . import entities as E
from . import intervals as I
from .masked_lm import MaskedLM


_WORD = re.compile(r"\w+")


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def words(documents: DataFrame) -> DataFrame:
    """(doc_id, w_ord, start, end, word): runs of letters, digits and _."""
    found = documents.select("doc_id", F.posexplode(T.word_texts("text")).alias("w_ord", "p"))
    return found.select("doc_id", "w_ord", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.text").alias("word"))


def words_in(spans: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """The words of each span's slice: (keys, s_ord, start, end, word). A word that the span cuts gives its inner part. doc_id is among the keys."""
    found = T.matches_in(spans.select(*keys, "start", "end"), documents, T.words_within)
    return found.select(*(F.col(f"of.{k}").alias(k) for k in keys), F.col("p.n").alias("s_ord"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.text").alias("word"))


def sliced(spans: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, slice) of each span that holds a character. doc_id is among the keys."""
    found = T.matches_in(spans.select(*keys, "start", "end"), documents, T.wholes_within)
    return found.select(*(F.col(f"of.{k}").alias(k) for k in [*keys, "start", "end"]), F.col("p.text").alias("slice"))


def token_information(tokens: DataFrame) -> DataFrame:
    """(word, ic) with -ln((c + 1) / (n + v)): what stands in for a masked language model's surprise."""
    return _information(tokens.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("c")))


def text_information(documents: DataFrame) -> DataFrame:
    """The same of the words of documents (text), which are counted where the texts are; the counts, a row for each word, are kept on disk."""
    counted = documents.select("text").mapInArrow(_counts, "word string, c bigint")
    return _information(counted.groupBy(F.lower("word").alias("word")).agg(F.sum("c").alias("c")).persist(StorageLevel.DISK_ONLY))


def _counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """(word, c) of words as they are written; about `most` different ones are held at a time."""
    out = lambda held: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
    held: Counter[str] = Counter()
    for b in batches:
        for (texts,) in T.in_slices(b.column(0)):
            for text in texts.to_pylist():
                held.update(_WORD.findall(text or ""))
            if len(held) > most:
                yield out(held)
                held.clear()
    if held:
        yield out(held)


def _information(counted: DataFrame) -> DataFrame:
    total = counted.agg(F.sum("c").alias("n"), F.count("*").alias("v"))  # one row
    return counted.join(F.broadcast(total), F.lit(True)).select("word", (-F.log((F.col("c") + 1.0) / (F.col("n") + F.col("v")))).alias("ic"))


def precision(maskings: DataFrame, anon_docs: DataFrame, mentions: DataFrame, documents: DataFrame, token_level: bool = True, weights: DataFrame | MaskedLM | None = None) -> DataFrame:
    """(anon_name, precision): covering annotators by annotators, summed over all masks or their words; weights: (word, ic), or a model.

    A masked language model weighs what one anonymization masks in a document all at once. At the level of mentions a mask
    counts if it lies inside one gold mention.
    """
    names = anon_docs.select("anon_name").distinct()
    if token_level and not isinstance(weights, MaskedLM) or weights is None:
        own = documents.select("doc_id", "text").join(D.listed(maskings, "masks", ["anon_name", "mask_ord", "start", "end"]), "doc_id")
        own = own.join(D.listed(mentions, "mentions", ["annotator", "identifier_type", "start", "end"]), "doc_id", "left")
        return precision_of(D.covering_sums(own, token_level, weights), names)
    keys = ["anon_name", "doc_id", "mask_ord"]
    spans = maskings.select(*keys, "start", "end")
    if token_level:
        spans, keys = words_in(spans, documents, keys), [*keys, "s_ord"]
    if isinstance(weights, MaskedLM):
        spans = weights.weigh(documents, spans.withColumn("round", F.col("anon_name"))).drop("word", "round").withColumnRenamed("ic", "weight")
    else:
        spans = sliced(spans, documents, keys).withColumn("word", F.lower("slice")).drop("slice").join(weights, "word", "left").withColumn("weight", F.coalesce("ic", F.lit(0.0))).drop("word", "ic")
    judged = E.covering_annotators(spans, mentions, keys).join(E.annotators(mentions), "doc_id", "left").fillna(0, ["n_annotators"])
    return precision_of(judged.groupBy("anon_name").agg(F.sum(F.col("n_covering") * F.col("weight")).alias("a"), F.sum(F.col("n_annotators") * F.col("weight")).alias("b")), names)


def precision_of(sums: DataFrame, names: DataFrame) -> DataFrame:
    """(anon_name, precision) of (anon_name, a, b), 0 for names without a sum."""
    return names.join(sums, "anon_name", "left").select("anon_name", F.coalesce(ratio(F.col("a"), F.col("b")), F.lit(0.0)).alias("precision"))


def mask_counts(mentions: DataFrame, maskings: DataFrame, anon_docs: DataFrame, documents: DataFrame, ignorable: DataFrame | None = None, **options) -> DataFrame:
    """(anon_name, type, n, n_masked) of the spans that recall asks for."""
    own = documents.select("doc_id", "text").join(D.listed(mentions, "mentions", ["annotator", "mention_ord", "entity_id", "entity_type", "identifier_type", "start", "end"]), "doc_id")
    if ignorable is None:
        own = own.withColumn("ignorable", F.array().cast("array<struct<start:int,end:int>>"))
    else:
        own = own.join(D.listed(ignorable, "ignorable", ["start", "end"]), "doc_id", "left")
    return D.mask_counts(D.with_masks(own, maskings, anon_docs), **options)


def recall(counts: DataFrame, anon_docs: DataFrame) -> DataFrame:
    summed = counts.groupBy("anon_name").agg(F.sum("n_masked").alias("a"), F.sum("n").alias("b"))
    names = anon_docs.select("anon_name").distinct()
    return names.join(summed, "anon_name", "left").select("anon_name", F.coalesce(ratio(F.col("a"), F.col("b")), F.lit(0.0)).alias("recall"))


def recall_by_type(counts: DataFrame) -> DataFrame:
    """Null for a type without a span."""
    return counts.select("anon_name", F.col("type").alias("entity_type"), ratio(F.col("n_masked"), F.col("n"), None).alias("recall"))


def terms(documents: DataFrame) -> DataFrame:
    """(doc_id, term_ord, start, end): words, and other visible characters by themselves."""
    found = documents.select("doc_id", F.posexplode(T.term_spans("text")).alias("term_ord", "p"))
    return found.select("doc_id", "term_ord", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


def terms_column(alternation: int | None = None) -> Column:
    """The same beside a document's text, in one array (term_ord, start, end, and round if asked for): for what needs no other row."""
    more = lambda i: () if alternation is None else (F.pmod(i, F.lit(alternation)).alias("round"),)
    return F.transform(T.term_spans("text"), lambda p, i: F.struct(i.alias("term_ord"), p["start"].alias("start"), p["end"].alias("end"), *more(i)))


def terms_of(tokens: DataFrame, use_chunking: bool = True) -> DataFrame:
    """Terms of parsed tokens (doc_id, tok_ord, start, end, text, ent_id, chunk_id): entities, then chunks that share no token with one, then tokens."""
    visible = tokens
    if use_chunking:
        by_chunk = Window.partitionBy("doc_id", "chunk_id")
        free = F.col("chunk_id").isNotNull() & ~F.max(F.col("ent_id").isNotNull()).over(by_chunk)
        group = F.when(F.col("ent_id").isNotNull(), F.concat(F.lit("e"), F.col("ent_id").cast("string"))).when(free, F.concat(F.lit("c"), F.col("chunk_id").cast("string")))
        visible = visible.withColumn("_group", group)
    else:
        visible = visible.withColumn("_group", F.lit(None).cast("string"))
    visible = visible.where(F.col("_group").isNotNull() | ~F.col("text").rlike(r"(?U)^\s*$"))
    visible = visible.withColumn("_group", F.coalesce("_group", F.concat(F.lit("t"), F.col("tok_ord").cast("string"))))
    merged = visible.groupBy("doc_id", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).alias("term_ord"), "start", "end")


def term_information(found: DataFrame, documents: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """terms with ic: 1 for all, or the largest ic of the words in the term, 0 without one."""
    if weights is None:
        return found.withColumn("ic", F.lit(1.0))
    inner = words_in(found, documents, ["doc_id", "term_ord"]).withColumn("word", F.lower("word")).join(weights, "word")
    best = inner.groupBy("doc_id", "term_ord").agg(F.max("ic").alias("ic"))
    return found.join(best, ["doc_id", "term_ord"], "left").fillna(0.0, ["ic"])


def rounds(found: DataFrame, alternation: int | str) -> DataFrame:
    """terms with `round`: those masked together while a language model weighs them. "sentence" masks one at a time."""
    if alternation == "sentence":
        return found.withColumn("round", F.col("term_ord"))
    if not isinstance(alternation, int) or alternation < 2:
        raise ValueError(f"term alternation must be an integer above 1 or 'sentence', not {alternation!r}")
    return found.withColumn("round", F.pmod("term_ord", F.lit(alternation)))


_sentences = T.spans(r"(?:[^.!?\n]|[.!?](?!\s|$))+[.!?]*")


def sentence_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_id, start, end): runs up to a line's end or to . ! ? and white space."""
    found = documents.select("doc_id", F.posexplode(_sentences("text")).alias("sent_id", "p"))
    return found.select("doc_id", "sent_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


def terms_in_sentences(found: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, term_ord, sent_id) of terms that lie in a sentence (doc_id, sent_id, start, end)."""
    return I.range_join(found.select("doc_id", "term_ord", "start", "end"), spans, ["doc_id"], I.inside).select("doc_id", "term_ord", "sent_id")


def masked_terms(found: DataFrame, maskings: DataFrame, documents: DataFrame, overlap_mode: str = "endpoint", flush_tail: bool = False) -> DataFrame:
    """(anon_name, doc_id, term_ord, ic) of the terms that an island of masks hits."""
    merged = I.islands(maskings.select("anon_name", "doc_id", "start", "end"), ["anon_name", "doc_id"])
    if not flush_tail:
        merged = I.within_text(merged, documents)
    return I.range_join(found, merged, ["doc_id"], I.HITS[overlap_mode]).select("anon_name", "doc_id", "term_ord", "ic").distinct()


def preserved_information(found: DataFrame, maskings: DataFrame, anon_docs: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """(anon_name, doc_id, n_terms, n_masked, total_ic, masked_ic, tpi, ic_multiplier) of each document; tpi is NaN without a term."""
    total = found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("ic").alias("total_ic"))
    lost = masked_terms(found, maskings, documents, **options).groupBy("anon_name", "doc_id").agg(F.count("*").alias("n_masked"), F.sum("ic").alias("masked_ic"))
    every = anon_docs.select("anon_name", "doc_id").join(total, "doc_id", "left").join(lost, ["anon_name", "doc_id"], "left").fillna(0).fillna(0.0)
    return with_preserved(every)


def with_preserved(every: DataFrame) -> DataFrame:
    """(n_terms, n_masked, total_ic, masked_ic and any others) with tpi and ic_multiplier."""
    kept_ic, kept = F.col("total_ic") - F.col("masked_ic"), F.col("n_terms") - F.col("n_masked")
    lost_mean, kept_mean = ratio(F.col("masked_ic"), F.col("n_masked")), ratio(kept_ic, kept)
    return every.withColumn("tpi", F.when(F.col("total_ic") != 0, kept_ic / F.col("total_ic")).otherwise(F.lit(float("nan")))).withColumn("ic_multiplier", ratio(lost_mean, kept_mean))


def mean_by_anonymization(by_document: DataFrame, value: str, skip_empty: bool = False) -> DataFrame:
    rows = by_document.where(~F.isnan(value)) if skip_empty else by_document
    return rows.groupBy("anon_name").agg(F.avg(value).alias(value))


def replacement_terms(found: DataFrame, maskings: DataFrame, overlap_mode: str = "endpoint") -> DataFrame:
    """(anon_name, doc_id, mask_ord, term_ord, ic, replacement, r_start, r_end): terms that a mask with a replacement hits."""
    replaced = maskings.where("replacement IS NOT NULL").select("anon_name", "doc_id", "mask_ord", "start", "end", "replacement")
    return I.range_join(found, replaced, ["doc_id"], I.HITS[overlap_mode])


def preserved_similarity(found: DataFrame, maskings: DataFrame, anon_docs: DataFrame, documents: DataFrame, embed=T.bag_of_words, overlap_mode: str = "endpoint", flush_tail: bool = False) -> DataFrame:
    """(anon_name, doc_id, tps): as tpi, but a term counts by the similarity of what the last mask on it puts in its place."""
    keys = ["anon_name", "doc_id", "mask_ord", "replacement"]
    replaced = sliced(maskings.where("replacement IS NOT NULL"), documents, keys).withColumn("_a", embed(F.col("slice"))).withColumn("_b", embed(F.col("replacement")))
    similar = replaced.select("anon_name", "doc_id", "mask_ord", T.clamped(T.cosine(F.col("_a"), F.col("_b"))).alias("similarity"))
    hit = replacement_terms(found, maskings, overlap_mode).join(similar, ["anon_name", "doc_id", "mask_ord"])
    last = hit.groupBy("anon_name", "doc_id", "term_ord", "ic").agg(F.max_by("similarity", "mask_ord").alias("similarity"))
    lost = masked_terms(found, maskings, documents, overlap_mode, flush_tail).withColumn("_masked", F.lit(True))
    changed = lost.join(last, ["anon_name", "doc_id", "term_ord", "ic"], "full_outer")
    loss = changed.groupBy("anon_name", "doc_id").agg(F.sum(F.col("ic") * (1 - F.coalesce("similarity", F.lit(0.0)))).alias("loss"))
    total = found.groupBy("doc_id").agg(F.sum("ic").alias("total_ic"))
    every = anon_docs.select("anon_name", "doc_id").join(total, "doc_id", "left").join(loss, ["anon_name", "doc_id"], "left").fillna(0.0)
    return every.select("anon_name", "doc_id", F.when(F.col("total_ic") != 0, (F.col("total_ic") - F.col("loss")) / F.col("total_ic")).otherwise(F.lit(float("nan"))).alias("tps"))


def masked_texts(documents: DataFrame, anon_docs: DataFrame, maskings: DataFrame) -> DataFrame:
    """(anon_name, doc_id, text): each document under each anonymization that has it."""
    return D.masked_texts(D.with_masks(documents.select("doc_id", "text"), maskings, anon_docs))


def missing_documents(documents: DataFrame, anon_docs: DataFrame) -> DataFrame:
    """(anon_name, doc_id) of the corpus that an anonymization lacks."""
    known = anon_docs.select("anon_name", "doc_id").join(documents.select("doc_id"), "doc_id", "left_semi")
    counted = anon_docs.select("anon_name").distinct().join(known.groupBy("anon_name").agg(F.countDistinct("doc_id").alias("_n")), "anon_name", "left")
    total = documents.agg(F.countDistinct("doc_id").alias("_all"))  # one row
    # only anonymizations that lack any meet the documents
    short = counted.join(F.broadcast(total), F.coalesce("_n", F.lit(0)) < F.col("_all")).select("anon_name").distinct()
    every = documents.select("doc_id", F.lit(1).alias("_one")).join(F.broadcast(short.groupBy(F.lit(1).alias("_one")).agg(F.collect_list("anon_name").alias("_names"))), "_one")
    return every.select(F.explode("_names").alias("anon_name"), "doc_id").join(anon_docs, ["anon_name", "doc_id"], "left_anti")


def extra_documents(documents: DataFrame, anon_docs: DataFrame) -> DataFrame:
    return anon_docs.select("anon_name", "doc_id").join(documents, "doc_id", "left_anti").select("anon_name", "doc_id")
