"""Vectors of words for clusterings: their counts, and how often a plan works them out."""

import re

from pyspark.sql import functions as F

from maskmetrics.functions import text as T
from maskmetrics.operators import clustering as C

TEXTS = ["The cat, the dog: 12 of_them", "", None, "ünder Ärger žluť", "x " * 500, "?!"]


def plain(text, size=T.BAG):
    out = [0.0] * size
    for w in re.findall(r"\w+", text or ""):
        out[(ord(w[0]) * 31 + len(w) * 7) % size] += 1
    return out


def test_counts_of_words(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    for size in (16, 100):
        got = {r["i"]: r["v"] for r in docs.where("text IS NOT NULL").select("i", T.bag_of_words(F.col("text"), size).alias("v")).collect()}
        assert got == {i: plain(t, size) for i, t in enumerate(TEXTS) if t is not None}


def test_vectors_are_worked_out_once(spark):
    texts = spark.createDataFrame([("a", str(i), t) for i, t in enumerate(TEXTS)], "anon_name string, doc_id string, text string")
    found = C.embed(texts).select("anon_name", "doc_id", "v", "features")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert {r["doc_id"]: r["v"] for r in found.collect()} == {str(i): plain(t) for i, t in enumerate(TEXTS) if t and any(plain(t))}
