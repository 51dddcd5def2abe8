"""Toxicity by multiple-instance learning: sentences are the instances, a document is the bag.

A sentence's log-odds are the bias and its evidence, the weights of the words it holds. A document's probability is a
noisy-or, 1 - exp(-H): H is the bias's hazard once for the document, log(1 + e^b), and for each sentence whose evidence is at
least EVIDENCE what its own hazard exceeds that by. Sentences without evidence add nothing, so a text's length alone doesn't
raise its score. Only document labels are learned from; the gradient shares the blame among the sentences. The fitted
sentence scores then locate the offending sentences.

Scale: the classifier is fitted on at most `max_per_label` labelled rows of either label, chosen by a hash of the text,
whatever their length, and on at most `max_vocabulary` words of them. Their words are found and counted on the executors;
what reaches the driver are the vocabulary and the cells (sentence, word of the vocabulary) of these rows, never a text. What
is shipped back is a weight for each of these words. Scoring is one scan of all documents, whole texts, without a shuffle.
Labels are joined by key in a shuffle of their own, so a hot source changes nothing.

Cases: a null or empty text has no sentence and so the score 0. Rows without a label, or whose label is null, don't train.
With no labelled rows, or none of one label, the model knows no word and every score is its bias's. Repeated rows are each
scored; extra columns are kept, but those named as the added ones give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import words as W
from .common import drop_path, new_path, per_batch, small_batches, unused, with_arrays

MAX_PER_LABEL = 4000
MAX_VOCABULARY = 20_000
THRESHOLD = 0.7
EVIDENCE = 1.0
_END = W.byte_class(lambda b: b in b".!?\n")


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted word hashes, their weights, and the bias of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def sentence_words(column: pa.Array):
    """For each run of texts: (first row, end row, word hashes, sentence of each word, row of each sentence, bytes of each sentence).

    Sentences end at . ! ? or a line's end; those without a word don't count.
    """
    for lo, hi, data, offsets in W.chunks(column):
        hashes, start, end, first = W.words(data, offsets, W.ALPHANUMERIC)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        breaks = np.concatenate(([0], np.cumsum(_END[data])))[start]
        new = np.ones(len(hashes), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
        sentence = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        ends = np.concatenate((begins[1:], [len(hashes)])) - 1 if len(begins) else begins
        base = offsets[row[begins]] if len(begins) else begins
        spans = np.stack((start[begins] - base, end[ends] - base), 1) if len(begins) else np.zeros((0, 2), np.int64)
        yield lo, hi, hashes, sentence, row[begins], spans


def _hazards(evidence: np.ndarray, bias: float) -> np.ndarray:
    """What sentences of that evidence add to -log(1 - P)."""
    return np.where(evidence >= EVIDENCE, np.logaddexp(0, bias + evidence) - np.logaddexp(0, bias), 0.0)


def _near(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted vocabulary, whether it is that word) of each hash."""
    near = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return near, vocabulary[near] == hashes


def document_words(column: pa.Array):
    """(row, word hashes, the sentence of each) for each text that has a word; a word stands once in a sentence."""
    for lo, _, hashes, sentence, row, _ in sentence_words(column):
        order = np.lexsort((hashes, sentence))
        hashes, sentence = hashes[order], sentence[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (sentence[1:] != sentence[:-1])
        hashes, sentence = hashes[new], sentence[new]
        of = row[sentence]
        begins = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
        for a, z in zip(begins, [*begins[1:], len(of)]):
            yield lo + int(of[a]), hashes[a:z], sentence[a:z] - sentence[a]


def descended(vocabulary: np.ndarray, start: np.ndarray, y: np.ndarray, spoken: np.ndarray, doc: np.ndarray, cell_s: np.ndarray, cell_w: np.ndarray, steps: int = 300, l2: float = 1e-4) -> ToxicityModel:
    """Full-batch gradient descent with Adagrad steps on the noisy-or likelihood, both labels weighted alike.

    spoken: the documents with a sentence at all; doc: the document of each sentence that has a word of the vocabulary;
    cells: that sentence and the word.
    """
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, b = start.copy(), -6.0
    seen_w, seen_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(steps):
        evidence = np.bincount(cell_s, w[cell_w], len(doc))
        leak, p = 1 / (1 + np.exp(-b)), 1 / (1 + np.exp(-b - evidence))
        hazard = np.where(spoken, np.logaddexp(0, b), 0.0) + np.bincount(doc, _hazards(evidence, b), len(y))
        # d loss / d hazard: 1 for label 0; -(1 - P) / P for label 1
        gradient = weight * np.where(y == 1, -np.exp(-hazard) / np.maximum(-np.expm1(-hazard), 1e-9), 1.0)
        active = evidence >= EVIDENCE
        gw = np.bincount(cell_w, (gradient[doc] * p * active)[cell_s], len(w)) + l2 * w
        gb = (gradient * spoken).sum() * leak + (gradient[doc] * (p - leak) * active).sum()
        seen_w += gw * gw
        seen_b += gb * gb
        w -= 0.3 * gw / np.sqrt(seen_w)
        b -= 0.3 * gb / np.sqrt(seen_b)
    return ToxicityModel(vocabulary, w, float(b))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", max_per_label: int = MAX_PER_LABEL, max_vocabulary: int = MAX_VOCABULARY, prune: float = 3.0, **options) -> ToxicityModel:
    """A model from the labelled rows of docs: at most max_per_label of either label, those whose texts hash lowest.

    The vocabulary: words that stand in two documents at least and whose document frequencies under the two labels differ by
    `prune` standard errors, the most different first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -6.0)
    marked = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_order")).join(
        labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct(), "_key"
    )
    chosen = None
    for k in (0, 1):  # a top-k by order is merged from partial ones; only keys and hashes reach the driver
        part = marked.where(F.col("_label") == k).select("_key", "_order", "_label").distinct().orderBy("_order", "_key").limit(max_per_label)
        chosen = part if chosen is None else chosen.union(part)
    rows = (
        docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_order"), F.col(text).alias("_text"))
        .join(F.broadcast(chosen), ["_key", "_order"])  # at most 2 * max_per_label rows
        .dropDuplicates(["_key", "_order", "_label"])
        .select("_order", F.col("_key").cast("string").alias("_name"), "_label", "_text")
    )

    def words(batch: pa.RecordBatch):
        n, at = batch.num_rows, 0
        hashes, sentences = [b""] * n, [b""] * n
        for i, h, s in document_words(batch.column(3)):
            hashes[i], sentences[i] = h.tobytes(), s.astype(np.int64).tobytes()
        while at < n:  # rows of long texts apart
            z, size = at + 1, len(hashes[at])
            while z < n and size + len(hashes[z]) < 1 << 24:
                size += len(hashes[z])
                z += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, z - at) for i in range(3)), pa.array(hashes[at:z], pa.binary()), pa.array(sentences[at:z], pa.binary())], names=["_order", "_name", "_label", "words", "sentences"])
            at = z

    def counted(batch: pa.RecordBatch):
        for k in (0, 1):
            mine = [np.unique(np.frombuffer(x.as_buffer(), np.uint64)) for x, y in zip(batch.column(1), batch.column(0).to_pylist()) if y == k]
            if mine:
                word, times = np.unique(np.concatenate(mine), return_counts=True)
                zero = np.zeros(len(word), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(zero if k else times), pa.array(times if k else zero)], names=["word", "clean", "toxic"])

    path = new_path(spark, "labelled")
    rows.mapInArrow(per_batch(words), "_order bigint, _name string, _label int, words binary, sentences binary").write.parquet(path)
    try:
        kept = spark.read.parquet(path)
        total = dict(kept.groupBy("_label").count().collect())
        if len(total) < 2:
            return none
        # first pass: in how many documents of either label each word stands
        frequencies = kept.select("_label", "words").mapInArrow(per_batch(counted), "word bigint, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        share = [(F.col(c) + 0.5) / F.lit(float(total[k] + 1)) for k, c in enumerate(("clean", "toxic"))]
        error = F.sqrt(share[0] * (1 - share[0]) / F.lit(float(total[0])) + share[1] * (1 - share[1]) / F.lit(float(total[1])))
        z = F.abs(share[1] - share[0]) / error
        best = frequencies.where("clean + toxic >= 2").select("word", share[0].alias("s0"), share[1].alias("s1"), z.alias("z")).where(F.col("z") >= prune).orderBy(F.desc("z"), "word").limit(max_vocabulary).collect()
        if not best:
            return none
        vocabulary = np.array([r["word"] for r in best], np.int64).view(np.uint64)
        # start from the frequencies: words of label 1 alone carry it
        start = np.clip(np.log([r["s1"] / r["s0"] for r in best]), -2, 4)
        order = np.argsort(vocabulary)
        vocabulary, start = vocabulary[order], start[order]
        held = spark.sparkContext.broadcast(vocabulary)

        # second pass: which of them stand in which sentence
        def cells(batch: pa.RecordBatch):
            at, of = [], []
            for h, s in zip(batch.column(3), batch.column(4)):
                near, true = _near(held.value, np.frombuffer(h.as_buffer(), np.uint64))
                at.append(near[true].astype(np.int32).tobytes())
                of.append(np.frombuffer(s.as_buffer(), np.int64)[true].tobytes())
            spoken = [len(h.as_buffer()) > 0 for h in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(spoken), pa.array(at, pa.binary()), pa.array(of, pa.binary())], names=["_order", "_name", "_label", "spoken", "at", "of"])

        found = kept.select("_order", "_name", "_label", "words", "sentences").mapInArrow(per_batch(cells), "_order bigint, _name string, _label int, spoken boolean, at binary, of binary").toArrow()
    finally:
        drop_path(spark, path)
    names, orders, marks = (found[c].to_pylist() for c in ("_name", "_order", "_label"))
    in_order = sorted(range(len(names)), key=lambda i: (orders[i], names[i], marks[i]))
    doc, cell_s, cell_w, made = [], [], [], 0
    for d, i in enumerate(in_order):
        sentence, s = np.unique(np.frombuffer(found["of"][i].as_buffer(), np.int64), return_inverse=True)
        doc.append(np.full(len(sentence), d))
        cell_s.append(s + made)
        cell_w.append(np.frombuffer(found["at"][i].as_buffer(), np.int32))
        made += len(sentence)
    y = np.array([marks[i] for i in in_order], np.int64)
    spoken = found["spoken"].to_numpy()[in_order].astype(bool)
    return descended(vocabulary, start, y, spoken, *(np.concatenate(x).astype(np.int64) for x in (doc, cell_s, cell_w)), **options)


def score_batch(column: pa.Array, model: ToxicityModel):
    """For each run of texts: (first row, end row, score of each row, row of each sentence, its bytes, its log-odds)."""
    bits = np.zeros(1 << 18, bool)
    low = np.uint64((1 << 18) - 1)
    bits[(model.words & low).astype(np.int64)] = True
    for lo, hi, hashes, sentence, row, spans in sentence_words(column):
        evidence = np.zeros(len(row))
        at = np.flatnonzero(bits[(hashes & low).astype(np.int64)])
        if len(at):
            near, true = _near(model.words, hashes[at])
            # a word counts once in a sentence
            cells = np.unique(sentence[at[true]] * len(model.words) + near[true])
            np.add.at(evidence, cells // len(model.words), model.weights[cells % len(model.words)])
        hazard = np.bincount(row, _hazards(evidence, model.bias), hi - lo).astype(float)
        hazard[row[np.concatenate(([True], row[1:] != row[:-1]))] if len(row) else row] += np.logaddexp(0, model.bias)
        yield lo, hi, -np.expm1(-hazard), row, spans, model.bias + evidence


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", sentences_over: float | None = None, score: str = "score", located: str = "sentences") -> DataFrame:
    """docs with `score`, the probability of being toxic; with sentences_over also `located`: (start, end, p) of the sentences of at least that p, in bytes."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    added = [StructField(score, DoubleType())]
    if sentences_over is not None:
        place = StructType().add("start", LongType()).add("end", LongType()).add("p", DoubleType())
        added.append(StructField(located, ArrayType(place)))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(texts: pa.Array) -> list[pa.Array]:
        out, where = np.zeros(len(texts)), [[] for _ in range(len(texts))] if sentences_over is not None else None
        for lo, hi, p, row, spans, z in score_batch(texts, held.value):
            out[lo:hi] = p
            if where is not None:
                each = 1 / (1 + np.exp(-z))
                for i in np.flatnonzero(each >= sentences_over).tolist():
                    where[lo + int(row[i])].append({"start": int(spans[i, 0]), "end": int(spans[i, 1]), "p": float(each[i])})
        return [pa.array(out)] + ([pa.array(where, kind)] if where is not None else [])

    return with_arrays(docs, [c for c in docs.columns if c not in [f.name for f in added]], [text], added, run)


def clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs without those that score at least threshold."""
    (score,) = unused(docs, "_score")
    return scored(docs, model, text, score=score).where(F.col(score) < threshold).drop(score)
