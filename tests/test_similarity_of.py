"""Preserved similarity worked out within slices of texts equals that of joined rows, and joins nothing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskmetrics.functions import text as T
from maskmetrics.operators import by_document as D
from maskmetrics.operators import measures as M

TEXTS = ["Anna met Bob in Oslo.", "", None, "one two three four five six, seven. " * 9, "İzmir ist ΣΟΦΟΣ"]
MASKS = {
    "0": [("X", 0, 0, 4, "Anna B"), ("X", 1, 16, 21, "LOC"), ("Y", 0, 0, 8, "A"), ("Y", 1, 2, 7, "met"), ("Y", 2, 9, 9, "no")],
    "3": [("X", 0, 2, 9, "two"), ("X", 1, 8, 15, None), ("X", 2, 8, 13, "three"), ("Y", 0, 0, 40, "one"), ("Y", 1, 320, 400, "seven"), ("Y", 2, 60, 80, "")],
    "4": [("X", 0, 0, 5, "Izmir"), ("Y", 0, 10, 15, "ist")],
}
KIND = pa.list_(pa.struct([("anon_name", pa.string()), ("mask_ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))


@pytest.mark.parametrize("mode", ["endpoint", "true"])
@pytest.mark.parametrize("tail", [False, True])
def test_similarity(spark, mode, tail):
    listed, kind = MASKS, KIND  # tasks cannot import this module

    def masks(texts, ids):
        return pa.array([[dict(zip(("anon_name", "mask_ord", "start", "end", "replacement"), m)) for m in listed.get(i, [])] for i in ids.to_pylist()], kind)

    def bag(texts):
        out = np.zeros((len(texts), T.BAG))
        for i, text in enumerate(texts):
            for w in T.term_spans.of(pa.array([text])).to_pylist()[0]:
                word = text[w["start"] : w["end"]]
                if word[0].isalnum():
                    out[i, (ord(word[0]) * 31 + len(word) * 7) % T.BAG] += 1
        return out

    docs = spark.createDataFrame([(str(i), t, len(t or "")) for i, t in enumerate(TEXTS)], "doc_id string, text string, n_chars int")
    rows = spark.createDataFrame([(d, *m) for d, ms in MASKS.items() for m in ms], "doc_id string, anon_name string, mask_ord int, start int, end int, replacement string")
    anon_docs = spark.createDataFrame([(n,) for n in "XYZ"], "anon_name string").crossJoin(docs.select("doc_id"))
    by_rows = M.preserved_similarity(M.terms(docs).withColumn("ic", F.lit(1.0)), rows, anon_docs, docs, T.bag_of_words, mode, tail)
    found = D.similarity_of(docs, lambda texts: D.weighted(T.term_spans.of(texts)), masks, ["X", "Y", "Z"], bag, mode, tail)
    seen = lambda df: sorted((r["anon_name"], r["doc_id"], "nan" if r["tps"] != r["tps"] else round(r["tps"], 9)) for r in df.collect())
    assert seen(found) == seen(by_rows)
    assert not any(x in found._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Window"))
