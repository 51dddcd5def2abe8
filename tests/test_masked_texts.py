"""Terms found in slices of texts are masked as those of arrays and rows are, and leave Python as numbers alone."""

from maskmetrics.functions import text as T
from maskmetrics.operators import masked_lm as L
from maskmetrics.operators import measures as M
from maskmetrics.plans.fixtures import PieceModel

TEXTS = ["Anna met Bob in Oslo.", "", None, "one two three four five six, seven. " * 40, "İzmir ist ein ΣΟΦΟΣ 𝔘x", "..."]


def test_terms_of_texts(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "doc_id string, text string")
    model, spans = L.MaskedLM(PieceModel, 5, 2), M.rounds(M.terms(docs), 4)
    pairs = [(model.weigh_texts(docs, T.term_spans.of, 4), model.weigh(docs, spans)), (model.segments_of_texts(docs, T.term_spans.of, 4), model.masked_segments(docs, spans))]
    for found, by_rows in pairs:
        assert sorted(found.collect()) == sorted(by_rows.select(found.columns).collect())
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "transform(" not in plan and "Join" not in plan


def test_segments_of_mixed_contexts():
    import numpy as np

    text = TEXTS[3]
    spans, contexts = np.array([(0, 3), (40, 47), (4, 7), (50, 60)]), np.array([(0, 36), (36, 72), (0, 36), (36, 72)])
    one = {(s.group, s.number, tuple(s.columns), tuple(s.true), tuple(s.spans)) for s in L.segments(PieceModel(), text, spans, ["b", "a", "a", "a"], contexts, 3)}
    apart = set()
    for i in range(0, 4):
        for other in L.segments(PieceModel(), text, spans[[i]], [["b", "a", "a", "a"][i]], contexts[[i]], 3):
            apart.add((other.group, tuple(other.true), i))
    assert {(g, t, i) for g, _, _, ts, ss in one for t, i in zip(ts, ss)} == {(g, t, i) for g, ts, i in apart for t in ts}
