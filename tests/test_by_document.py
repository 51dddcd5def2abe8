"""Arrays of a document's row give what frames of rows give, and shuffle less."""

import pytest
from pyspark.sql import functions as F

from maskmetrics.operators import by_document as D, masked_lm as L, measures as M
from maskmetrics.plans.fixtures import PieceModel

TEXTS = ["Anna met Bob in Oslo.", "", None, "one two three four five six, seven. " * 9, "İzmir ist ein ΣΟΦΟΣ", "..."]


@pytest.fixture
def corpus(spark):
    rows = [(str(i), t, len(t or "")) for i, t in enumerate(TEXTS)]
    masks = [("X", "0", 0, 0, 4), ("X", "0", 1, 16, 21), ("X", "3", 0, 2, 9), ("X", "3", 1, 8, 15), ("X", "3", 2, 15, 18), ("Y", "3", 0, 0, 40), ("Y", "3", 1, 50, 50), ("Y", "3", 2, 60, 325), ("Y", "4", 0, 0, 7), ("Y", "5", 0, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_chars int")
    names = spark.createDataFrame([(n,) for n in "XYZ"], "anon_name string")
    return docs, spark.createDataFrame(masks, "anon_name string, doc_id string, mask_ord int, start int, end int"), names.crossJoin(docs.select("doc_id"))


def _seen(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("anon_name", "doc_id", "n_terms", "n_masked", "total_ic", "masked_ic").collect())


@pytest.mark.parametrize("mode", ["endpoint", "true"])
@pytest.mark.parametrize("tail", [False, True])
@pytest.mark.parametrize("frequent", [0, 3, 100])
def test_information(corpus, mode, tail, frequent):
    docs, masks, anon_docs = corpus
    weights = M.token_information(M.words(docs))
    rows = D.with_information(docs, weights, frequent)
    listed = masks.groupBy("doc_id").agg(F.collect_list(F.struct("anon_name", "start", "end")).alias("masks"))
    rows = rows.join(listed, "doc_id", "left").withColumn("anon_names", F.array(*map(F.lit, "XYZ")))
    by_rows = M.preserved_information(M.term_information(M.terms(docs), docs, weights), masks, anon_docs, docs, overlap_mode=mode, flush_tail=tail)
    assert _seen(D.information(rows, overlap_mode=mode, flush_tail=tail)) == _seen(by_rows)


def test_masked_model_of_a_column_moves_no_row(corpus):
    docs, _, _ = corpus
    model, spans = L.MaskedLM(PieceModel, 5, 2), M.rounds(M.terms(docs), 6)
    found = {"weigh": (model.weigh(docs, M.terms_column(6)), model.weigh(docs, spans)), "segments": (model.masked_segments(docs, M.terms_column(6)), model.masked_segments(docs, spans)), "subwords": (L.subwords_of(docs, M.terms_column(), PieceModel), L.subwords_of(docs, M.terms(docs), PieceModel))}
    for a, b in found.values():
        assert sorted(a.select(b.columns).collect()) == sorted(b.collect())
        assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()
