"""Information by a masked model, against a plain reading of its definition, one subword after another."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmetrics.operators import masked_lm as L, measures as M
from maskmetrics.plans.evaluate import Evaluation
from maskmetrics.plans.fixtures import PieceModel

TEXTS = {"a": "Anna Lindqvist met Bob in Oslo. They talked for hours! Nobody knows why", "b": "word " * 300, "c": "", "d": None, "e": "é–ü 🙂 x"}


class Steep(PieceModel):
    """Logits too large for exp()."""

    def logits(self, ids, attention, rows, columns):
        return super().logits(ids, attention, rows, columns) * 4000


class WithoutPlaces(PieceModel):
    """Subwords that stand for no characters at the end too."""

    def encode(self, text):
        ids, spans = super().encode(text)
        return np.append(ids, 2), np.vstack([spans, [[0, 0]]])


def plain(model, text, spans, groups, contexts, length):
    out = []
    for (start, end), group, (a, z) in zip(spans, groups, contexts):
        ids, offsets = (x.tolist() for x in model.encode(text[a:z]))
        touches = lambda o, s: o[0] < o[1] and s[0] < s[1] and o[0] < s[1] - a and s[0] - a < o[1]
        together = [s for s, g, c in zip(spans, groups, contexts) if g == group and c == (a, z)]
        masked = [any(touches(o, s) for s in together) for o in offsets]
        worst = None
        for i, o in enumerate(offsets):
            if touches(o, (start, end)):
                lo = i // length * length
                part = range(lo, min(lo + length, len(ids)))
                seen = np.array([[model.mask_id if masked[j] else ids[j] for j in part]]), np.array([[0 if masked[j] else 1 for j in part]])
                line = [float(x) for x in model.logits(*seen, np.array([0]), np.array([i - lo]))[0]]
                p = 1 / sum(math.exp(min(x - line[ids[i]], 700)) for x in line)
                worst = p if worst is None else min(worst, p)
        out.append(0.0 if worst is None else -math.log(worst))
    return out


@pytest.mark.parametrize("model", [PieceModel(), WithoutPlaces()])
@pytest.mark.parametrize("length,batch", [(1, 1), (4, 3), (100, 128)])
def test_against_one_subword_at_a_time(model, length, batch):
    text = TEXTS["a"]
    spans = [(0, 14), (0, 4), (5, 5), (4, 5), (6, 9), (19, 22), (26, 30), (26, 31), (32, 36), (55, 200)]
    groups = [str(i % 3) for i in range(len(spans))]
    for contexts in ([(0, len(text))] * len(spans), [(0, 31) if s[1] <= 31 else (32, len(text)) for s in spans]):
        got = L.surprises(model, text, np.array(spans), groups, np.array(contexts), length, batch)
        assert np.allclose(got, plain(model, text, spans, groups, contexts, length), atol=1e-9)
        assert got[2] == got[3] == 0  # no character, and none but a blank


def test_large_logits_and_nothing_at_all():
    spans = np.array([(0, 4), (5, 14)])
    got = L.surprises(Steep(), TEXTS["a"], spans, ["0", "0"], np.array([(0, 70)] * 2))
    assert np.isfinite(got).all() and (got >= 0).all()
    assert L.surprises(PieceModel(), "", np.zeros((0, 2), np.int64), [], np.zeros((0, 2), np.int64)).tolist() == []
    assert L.surprises(PieceModel(), "", np.array([(0, 4)]), ["0"], np.array([(0, 0)])).tolist() == [0.0]
    assert len(list(L.segments(PieceModel(), TEXTS["b"], np.array([(0, 4)]), ["0"], np.array([(0, 1500)]), 100))) == 1  # of seven, the one with a mask


def test_frames(spark):
    documents = spark.createDataFrame([(k, t, len(t or "")) for k, t in TEXTS.items()], "doc_id string, text string, n_chars int")
    terms = M.terms(documents)
    for alternation in (2, 6, "sentence"):
        rounds = M.rounds(terms, alternation)
        sentences = M.sentence_spans(documents) if alternation == "sentence" else None
        if sentences is not None:
            rounds = rounds.join(M.terms_in_sentences(terms, sentences), ["doc_id", "term_ord"])
            within = {(r["doc_id"], r["sent_id"]): (r["start"], r["end"]) for r in sentences.collect()}
        rounds = rounds.withColumn("ids", F.lit("kept"))  # other columns stay
        found = L.MaskedLM(PieceModel, 7).weigh(documents, rounds, sentences).orderBy("doc_id", "term_ord").collect()
        assert len(found) == terms.count() and {r["ids"] for r in found} == {"kept"}
        for doc_id, text in TEXTS.items():
            rows = [r for r in found if r["doc_id"] == doc_id]
            contexts = [(0, len(text)) if sentences is None else within[doc_id, r["sent_id"]] for r in rows]
            want = plain(PieceModel(), text, [(r["start"], r["end"]) for r in rows], [r["round"] for r in rows], contexts, 7) if doc_id != "b" else None
            assert want is None or np.allclose([r["ic"] for r in rows], want, atol=1e-9)
    empty = documents.where("false")
    assert L.MaskedLM(PieceModel).weigh(empty, M.rounds(M.terms(empty), 2)).count() == 0
    with pytest.raises(ValueError):
        L.MaskedLM(PieceModel).limited(0)


def test_evaluation_takes_a_masked_model(spark):
    documents = spark.createDataFrame([("a", TEXTS["a"])], "doc_id string, text string")
    mentions = spark.createDataFrame([("a", "a1", 0, "e1", "PERSON", "DIRECT", 0, 14), ("a", "a1", 1, "e2", "LOC", "QUASI", 26, 30)], "doc_id string, annotator string, mention_ord int, entity_id string, entity_type string, identifier_type string, start int, end int")
    masks = spark.createDataFrame([("X", "a", 0, 0, 14, None), ("X", "a", 1, 37, 43, None)], "anon_name string, doc_id string, mask_ord int, start int, end int, replacement string")
    docs = spark.createDataFrame([("X", 0, "a")], "anon_name string, anon_ord int, doc_id string")
    e = Evaluation(documents, mentions, information={"pieces": L.MaskedLM(PieceModel)})
    value = lambda df: df.collect()[0][1]
    weights = plain(PieceModel(), TEXTS["a"], [(0, 4), (5, 14), (37, 43)], ["X"] * 3, [(0, len(TEXTS["a"]))] * 3, 100)
    assert value(e.weighted_precision(docs, masks, "pieces")) == pytest.approx(sum(weights[:2]) / sum(weights))
    tpi = {n: value(e.tpi(docs, masks, "pieces", n, 2, False)) for n in (3, 100)}
    assert tpi[3] != tpi[100] and all(0 < v < 1 for v in tpi.values())
    assert value(e.tpi(docs, masks, "pieces", 100, "sentence", False)) not in tpi.values()
    assert 0 < value(e.tps(docs, masks, "pieces", use_chunking=False)) < 1
