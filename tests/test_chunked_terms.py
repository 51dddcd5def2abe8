"""Terms with chunks, and what is kept of them, are worked out in the document's row and equal those of parsed tokens."""

import pytest
from pyspark.sql import functions as F

from maskmetrics.functions import parser
from maskmetrics.operators import measures as M
from maskmetrics.plans import fixtures, queries

TEXTS = ["The red Fox saw 3 old dogs at 10.20.30.40. They met Anna Smith, of Oslo\nand mail a@b.org now", "", None, "...", "İzmir ist ΣΟΦΟΣ 1234567890123 x9876543210123y", "one two three four five six, seven. " * 40]


@pytest.fixture
def corpus(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return fixtures.Fixture(spark, str(tmp_path))


def _rows(df):
    return sorted(tuple("nan" if v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def _exchanges(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_with_chunks(corpus):
    found = queries.terms_with_chunks(corpus)
    assert _rows(found) == _rows(M.terms_of(parser.tokens(corpus.documents)).select("doc_id", "term_ord", "start", "end"))
    assert not any(x in _exchanges(found) for x in ("Window", "Aggregate", "Join"))


def test_tpi_with_chunks(corpus):
    found = queries.tpi_with_chunks(corpus)
    by_rows = M.preserved_information(M.terms_of(parser.tokens(corpus.documents)).withColumn("ic", F.lit(1.0)), corpus.maskings, corpus.anon_docs, corpus.documents)
    assert _rows(found) == _rows(M.mean_by_anonymization(by_rows, "tpi"))
    with_value = M.mean_by_anonymization(by_rows.where("n_terms > 0"), "tpi")
    corpus.documents = corpus.documents.where("trim(text) <> ''")
    assert _rows(queries.tpi_with_chunks(corpus)) == _rows(with_value)
    assert not any(x in _exchanges(found) for x in ("Window", "Join"))


def test_terms_of(corpus):
    found = queries.terms_of(corpus)
    tokens = parser.tokens(corpus.documents).withColumn("chunk_id", F.when(F.col("tok_ord") % 10 < 2, F.floor(F.col("tok_ord") / 10).cast("int")))
    by_rows = M.terms_of(tokens).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))
    assert _rows(found) == _rows(by_rows)
    assert not any(x in _exchanges(found) for x in ("Window", "Aggregate", "Join"))
