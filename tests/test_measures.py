"""Hand-worked fixtures: values worked out from the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from maskmetrics.functions import parser
from maskmetrics.functions import text as T
from maskmetrics.operators import clustering, entities as E, intervals as I, measures as M, reidentification as R
from maskmetrics.plans.evaluate import Evaluation

TEXT = "Anna met Bob in Oslo."
MENTIONS = "doc_id string, annotator string, mention_ord int, entity_id string, entity_type string, identifier_type string, start int, end int"
MASKS = "anon_name string, doc_id string, mask_ord int, start int, end int, replacement string"


@pytest.fixture
def corpus(spark):
    documents = spark.createDataFrame([("d", TEXT, len(TEXT))], "doc_id string, text string, n_chars int")
    mentions = spark.createDataFrame(
        [("d", "a1", 0, "a1_e1", "PERSON", "DIRECT", 0, 4), ("d", "a1", 1, "a1_e2", "LOC", "QUASI", 16, 20), ("d", "a2", 0, "a2_e1", "PERSON", "DIRECT", 0, 4), ("d", "a2", 1, "a2_e2", "PERSON", "QUASI", 9, 12)],
        MENTIONS,
    )
    masks = spark.createDataFrame([("X", "d", 0, 0, 4, "PERSON"), ("X", "d", 1, 16, 21, None)], MASKS)
    docs = spark.createDataFrame([("X", 0, "d"), ("Clear", 1, "d")], "anon_name string, anon_ord int, doc_id string")
    return documents, mentions, masks, docs


def by_name(df):
    return {r[0]: r[1] for r in df.collect()}


def test_precision_and_recall(corpus):
    documents, mentions, masks, docs = corpus
    assert by_name(M.precision(masks, docs, mentions, documents)) == {"X": 0.75, "Clear": 0.0}
    assert by_name(M.precision(masks, docs, mentions, documents, token_level=False)) == {"X": 0.5, "Clear": 0.0}
    counts = M.mask_counts(mentions, masks, docs, documents, parser.ignorable_tokens(M.words(documents)))
    assert by_name(M.recall(counts, docs)) == {"X": 0.75, "Clear": 0.0}
    assert {(r[0], r[1]): r[2] for r in M.recall_by_type(counts).collect()}["X", "PERSON"] == pytest.approx(2 / 3)


def test_masked_text_islands_and_information(corpus):
    documents, mentions, masks, docs = corpus
    assert {r[0]: r[2] for r in M.masked_texts(documents, docs, masks).collect()} == {"X": "PERSON met Bob in ", "Clear": TEXT}
    merged = I.islands(masks, ["anon_name", "doc_id"])
    assert {tuple(r[2:]) for r in merged.collect()} == {(0, 4), (16, 21)}
    assert {(r["start"], r["end"]) for r in I.within_text(merged, documents).collect()} == {(0, 4)}
    terms = M.terms(documents).withColumn("ic", F.lit(1.0))
    value = lambda **o: by_name(M.mean_by_anonymization(M.preserved_information(terms, masks, docs, documents, **o), "tpi"))["X"]
    assert value() == pytest.approx(5 / 6) and value(flush_tail=True) == pytest.approx(3 / 6)
    cosine = documents.select(T.cosine(T.bag_of_words(F.lit("Anna")), T.bag_of_words(F.lit("PERSON")))).first()[0]
    assert by_name(M.mean_by_anonymization(M.preserved_similarity(terms, masks, docs, documents), "tps"))["X"] == pytest.approx((5 + cosine) / 6)


def test_interior_term_depends_on_the_mode(spark):
    text = "ab cd ef gh"
    documents = spark.createDataFrame([("d", text, 11)], "doc_id string, text string, n_chars int")
    masks = spark.createDataFrame([("X", "d", 0, 0, 8, None)], MASKS)
    docs = spark.createDataFrame([("X", 0, "d")], "anon_name string, anon_ord int, doc_id string")
    terms = M.terms(documents).withColumn("ic", F.lit(1.0))
    for mode, kept in (("endpoint", 0.5), ("true", 0.25)):
        assert M.preserved_information(terms, masks, docs, documents, overlap_mode=mode).first()["tpi"] == kept


def test_fold_order_slices_windows_and_marks(spark):
    one = spark.range(1)
    masked = lambda ms: one.select(T.apply_masking(F.lit("abcdefghij"), F.from_json(F.lit(ms), "array<struct<start:int,end:int,replacement:string>>"))).first()[0]
    assert masked('[{"start":6,"end":8,"replacement":"X"},{"start":1,"end":3}]') == "adefghX"
    assert masked('[{"start":1,"end":3},{"start":6,"end":8,"replacement":"X"}]') == "adefXij"
    documents = spark.createDataFrame([("d", "ab-cd")], "doc_id string, text string")
    spans = spark.createDataFrame([("d", 1, 4)], "doc_id string, start int, end int")
    assert [(r["start"], r["end"]) for r in M.words_in(spans, documents, ["doc_id"]).orderBy("start").collect()] == [(1, 2), (3, 4)]
    sizes = one.select(*(F.size(T.windows(F.sequence(F.lit(1), F.lit(n)), 8, 2)) for n in (6, 7, 10, 11, 14, 15))).first()
    assert tuple(sizes) == (1, 2, 2, 3, 3, 4)
    assert one.select(T.remove_mask_marks(F.lit("LOCATION ORGANIZATION DATE_TIME"))).first()[0] == "ATION ANIZATION _"
    assert T.marks_pattern(["***"]) == r"\*\*\*" and T.window_setting("No") is None and T.window_setting("512-128") == (512, 128)
    tokens = F.from_json(F.lit('[{"text":"The","lemma":"the","is_stop":true},{"text":"dogs","lemma":"","is_stop":false},{"text":"\'","lemma":"\'","is_stop":false},{"text":".","lemma":".","is_stop":false}]'), "array<struct<text:string,lemma:string,is_stop:boolean>>")
    assert one.select(T.curated(tokens)).first()[0] == " dogs ."
    assert one.select(T.blank_to_null(F.lit("  "))).first()[0] is None


def test_mixed_entity_and_ignorable_words(spark):
    mentions = spark.createDataFrame([("d", "a", 0, "e", "PERSON", "NO_MASK", 0, 8), ("d", "a", 1, "e", "ORG", "DIRECT", 9, 13)], MENTIONS)
    e = E.entities(mentions).first()
    assert e["need_masking"] and not e["is_direct"] and e["entity_type"] == "PERSON" and e["n_mentions"] == 2
    documents = spark.createDataFrame([("d", "Mr Smith left", 13)], "doc_id string, text string, n_chars int")
    masks = spark.createDataFrame([("X", "d", 0, 3, 8, None)], MASKS)
    docs = spark.createDataFrame([("X", 0, "d")], "anon_name string, anon_ord int, doc_id string")
    found = E.masked_spans(mentions.withColumn("span_id", F.col("mention_ord").cast("string")), masks, docs, documents, parser.ignorable_tokens(M.words(documents)))
    assert {r["span_id"]: r["is_masked"] for r in found.collect()} == {"0": True, "1": False}


def test_empty_anonymization_and_blank_document(spark):
    documents = spark.createDataFrame([("a", "one two", 7), ("b", "   ", 3)], "doc_id string, text string, n_chars int")
    docs = spark.createDataFrame([("Clear", 0, "a"), ("Clear", 0, "b")], "anon_name string, anon_ord int, doc_id string")
    masks = spark.createDataFrame([], MASKS)
    found = {r["doc_id"]: r["tpi"] for r in M.preserved_information(M.terms(documents).withColumn("ic", F.lit(1.0)), masks, docs, documents).collect()}
    assert found["a"] == 1 and math.isnan(found["b"])


@pytest.mark.parametrize("a,b,nmi", [((0, 0, 1, 1), (1, 1, 0, 0), 1), ((0, 0, 1, 1), (0, 1, 0, 1), 0), ((0, 0, 1, 1), (0, 0, 1, 2), 0.8), ((0, 0), (1, 1), 1)])
def test_mutual_information(spark, a, b, nmi):
    labels = spark.createDataFrame([*zip(a, b)], "a int, b int")
    assert clustering.normalised_mutual_information(labels).first()[0] == pytest.approx(nmi, abs=1e-12)


def test_summed_scores(spark):
    rows = [("s", "p0", 0, [1.0, 2.0]), ("s", "p0", 0, [3.0, 0.0]), ("s", "p1", 1, [1.0, 0.0]), ("s", "p1", 1, [0.0, 0.5])]
    found = R.summed_scores(spark.createDataFrame(rows, "source string, name string, label int, scores array<double>"))
    assert {r["name"]: r["predicted"] for r in found.collect()} == {"p0": 0, "p1": 0}
    assert R.accuracy(found).first()["accuracy"] == 0.5


def test_chunks_and_entities_make_terms(spark):
    rows = [("d", 0, 0, 3, "the", None, 1), ("d", 1, 4, 7, "old", None, 1), ("d", 2, 8, 12, "Oslo", 7, 2), ("d", 3, 13, 17, "city", None, 2), ("d", 4, 17, 18, " ", None, None)]
    tokens = spark.createDataFrame(rows, "doc_id string, tok_ord int, start int, end int, text string, ent_id int, chunk_id int")
    assert [(r["start"], r["end"]) for r in M.terms_of(tokens).orderBy("term_ord").collect()] == [(0, 7), (8, 12), (13, 17)]
    assert M.terms_of(tokens, use_chunking=False).count() == 4
    with pytest.raises(ValueError):
        M.rounds(tokens, 1)


def test_evaluate_and_files(spark, tmp_path, corpus):
    documents, mentions, masks, docs = corpus
    out = tmp_path / "results" / "r.csv"
    found = Evaluation(documents, mentions).evaluate(docs, masks, {"Precision": {}, "Recall_all": {}, "Nonsense": {}, "TPI": {"weighting_model_name": None, "use_chunking": False}, "TPS": {"wrong": 1}}, str(out))
    assert set(found) == {"Precision", "Recall_all", "TPI"} and found["Recall_all"]["X"] == 0.75 and found["TPI"]["Clear"] == 1
    assert len(out.read_text().splitlines()) == 4
    with pytest.raises(ValueError):
        more = documents.unionByName(documents.withColumn("doc_id", F.lit("other")))
        Evaluation(more, mentions).evaluate(docs, masks, {"Precision": {}})
    from maskmetrics.sources import json_files as J

    (tmp_path / "x.json").write_text('{"d": [[0, 4, " "], [16, 21, "Y"]], "e": []}')
    d, m = J.read_anonymizations(spark, {"X": str(tmp_path / "x.json")})
    assert d.count() == 2 and {(r["start"], r["end"], r["replacement"]) for r in m.collect()} == {(0, 4, None), (16, 21, "Y")}
    (tmp_path / "c.json").write_text('[{"doc_id": "d", "text": "Anna", "annotations": {"a": {"entity_mentions": [{"entity_id": "e", "identifier_type": "DIRECT", "entity_type": "P", "start_offset": 0, "end_offset": 4}]}}}]')
    assert J.gold_mentions(J.read_corpus(spark, str(tmp_path / "c.json"))).first()["end"] == 4


def test_attack_config():
    with pytest.raises(ValueError):
        R.AttackConfig.of({"nothing": 1})
    assert R.AttackConfig.of({"finetuning_epochs": 2}).finetuning_epochs == 2


def test_lloyd_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 4)) + 6 * i for i in range(3)])
    rows = [(n, i, [float(v) for v in r]) for n in ("original", "other") for i, r in enumerate(x)]
    points = spark.createDataFrame(rows, "anon_name string, doc_id int, v array<double>")
    found = clustering.trained(points, {"original": [3], "other": [2]}, 6)
    assert set(found) == {("original", 3), ("other", 2)}
    centres, cost = found["original", 3]
    for c, total in zip(centres, cost):
        away = ((x[:, None] - c[None]) ** 2).sum(2)
        assert total == pytest.approx(away.min(1).sum())
        for k in range(3):  # a centre is the mean of its points
            assert np.allclose(c[k], x[away.argmin(1) == k].mean(0), atol=1e-3)
    labels = clustering.labelled(points, {"original": centres[cost.argmin()][None], "other": centres[cost.argmin()][None]}).collect()
    assert len({(r["doc_id"] // 30, r["labels"][0]) for r in labels}) == 3
    cells = np.array([[2, 0, 0], [0, 1, 1], [0, 0, 0]])
    pairs = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "a int, b int")
    assert clustering.mutual_information(cells) == pytest.approx(clustering.normalised_mutual_information(pairs).first()[0])
    from pyspark.ml.functions import array_to_vector

    scores, k, silhouettes = clustering.agreement(points.withColumn("features", array_to_vector("v")), n_clusterings=2, n_tries=3, max_k=4)
    assert set(scores) == {"original", "other"} and k in (2, 4) and len(silhouettes) == 2 and all(0 <= v <= 1 for v in scores.values())


def test_unknown_models_are_refused(spark, corpus):
    documents, mentions, masks, docs = corpus
    e = Evaluation(documents, mentions, information={"ones": lambda d, terms: terms.select("doc_id", "term_ord", F.lit(1.0).alias("ic")), "rounds": lambda d, terms: terms.select("doc_id", "term_ord", (F.col("round") + 1.0).alias("ic"))})
    for call in (lambda: e.tpi(docs, masks, "bert"), lambda: e.precision(docs, masks, "ones"), lambda: e.tps(docs, masks, None, similarity_model_name="albert"), lambda: e.nmi(docs, masks, embedding_model_name="minilm")):
        with pytest.raises(ValueError):
            call()
    value = lambda *a, **k: {r[0]: r[1] for r in e.tpi(docs, masks, *a, use_chunking=False, **k).collect()}
    assert value("ones") == value(None)
    # a model that weighs by round sees how terms alternate
    assert len({tuple(sorted(value("rounds", term_alterning=n).items())) for n in (2, 3, "sentence")}) == 3


def test_attack_options(spark, tmp_path):
    people = [(f"p{i}", f"the {w} of {w} and {w}x with {w}y in town") for i, w in enumerate(["ship", "horse", "tree", "stone"])]
    background = spark.createDataFrame(people, "doc_id string, text string")
    anonymized = spark.createDataFrame([("X", i, t) for i, t in people] + [("Y", i, "nothing here") for i, _ in people], "source string, doc_id string, text string")
    folder = str(tmp_path / "out")
    options = {"output_folder_path": folder, "finetuning_sliding_window": "20-5", "base_model_name": "logistic-regression", "finetuning_epochs": 3, "pretraining_sliding_window": "20-5"}
    run = lambda texts=anonymized, b=background, **more: {r[0]: r[1] for r in R.risk(texts, b, R.AttackConfig.of({**options, **more})).collect()}
    first = run()
    assert first["X"] == 1.0 and first["Y"] <= 0.5
    lines = (tmp_path / "out" / "results.csv").read_text().splitlines()
    assert len(lines) == 2 + 3 and lines[1] == "Time,Epoch,X,Y,Average"  # an epoch each
    run(finetuning_epochs=1)
    assert len((tmp_path / "out" / "results.csv").read_text().splitlines()) == 6
    # the saved pretreatment is what is tried, not the texts given; a new source is added, or isn't
    changed = anonymized.withColumn("text", F.lit("changed"))
    assert run(changed, load_saved_pretreatment=True)["X"] == 1.0 and run(changed, save_pretreatment=False)["X"] < 1.0
    new = anonymized.withColumn("source", F.concat(F.lit("new"), "source"))
    assert set(run(new, load_saved_pretreatment=True, add_non_saved_anonymizations=False)) == set()
    assert run(new, load_saved_pretreatment=True)["newX"] == 1.0
    # a saved classifier keeps the labels that it learned, whatever background there is now
    more = background.union(spark.createDataFrame([("a0", "someone else altogether")], background.schema))
    assert run(b=more, load_saved_finetuning=True)["X"] == 1.0
    # the pretrained features are taken up again, and so are other windows
    assert run(load_saved_pretraining=True, save_finetuning=False)["X"] == 1.0
    with pytest.raises(ValueError):
        run(dev_set_column_name="Z")
    assert run(dev_set_column_name="Y")["Y"] <= 0.5
    with pytest.raises(ValueError):
        run(base_model_name="bert")
    report = {r["kind"]: r["n"] for r in R.individuals(more, anonymized).collect()}
    assert report == {"all": 5, "train": 5, "evaluation": 4, "train without evaluation": 1, "evaluation without train": 0}


def test_individual_labels(spark):
    names = [f"n{i * 7919 % 1000}é" for i in range(700)] + ["", None, "n1é"]
    found = R.individual_labels(spark.createDataFrame([(n,) for n in names], "doc_id string")).collect()
    want = [None, *sorted({n for n in names if n is not None})]
    assert {r["doc_id"]: r["label"] for r in found} == {n: i for i, n in enumerate(want)} and len(found) == len(want)
    assert R.individual_labels(spark.createDataFrame([], "doc_id string")).count() == 0


def test_silhouettes_equal_sparks_own(spark):
    import numpy as np
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 3 * np.eye(4)[i % 4]).tolist()) for i in range(200)]
    points = spark.createDataFrame(rows, "doc_id int, v array<double>").repartition(3)
    centres = {k: np.array([[rows[(7 * j + r) % 200][1] for j in range(k)] for r in range(3)]) for k in (2, 3, 9)}
    centres[3][1] = centres[3][1][:1]  # all in one cluster: no silhouette
    centres[2][0] = [[0, 0, 0, 0], [0, 0, 0, 99]]  # and one without points
    found = clustering.silhouettes(points, centres)
    for k, runs in centres.items():
        labels = clustering.labelled(points.selectExpr("'a' AS anon_name", "doc_id", "v"), {"a": runs}).join(points, "doc_id")
        for r, s in enumerate(found[k]):
            one = labels.select(array_to_vector("v").alias("features"), F.col("labels")[r].cast("double").alias("label"))
            if one.select("label").distinct().count() < 2:
                assert s is None
            else:
                assert abs(s - ClusteringEvaluator(distanceMeasure="cosine", featuresCol="features", predictionCol="label").evaluate(one)) < 1e-9
    assert found[3][1] is None and found[2][0] is None and None not in found[9]
