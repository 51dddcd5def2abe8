"""The pipeline's stages against brute force, and their edge cases: nulls, repeated rows, empty tables, clashing names."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from maskmetrics.llm import decontamination, language_id, language_model, mixing, ngram_join, pii, sharding, topk, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for what they add, and for columns of their own.
CLASHING = ["score", "label", "size", "slot", "shard", "law", "copy", "shuffle_key", "component_id", "n_shingles", "key", "kind", "count", "spans", "items", "held_out", "tokens", "a", "b", "n", "id", "_key", "_id", "_found", "_cut", "_score", "_source", "_times", "_label", "text_crc32", "rate", "bytes", "node", "wanted", "groups", "value", "sentences", "_values", "_new", "_text", "_n", "_refers_to", "_page", "_sha", "_copy", "_shuffle_key", "text_id", "component", "place"]
PASSAGE = " ".join(f"exam{i}" for i in range(14))


def body(i, n=40):
    return " ".join(f"w{(i * 7919 + j * j * 31 + j) % 9973}" for j in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, body(i) + "." + (" You filthy scum, awful idiot." if i % 4 == 0 else ""), "en", "web" if i % 3 else "books", 1) for i in range(80)]
    rows += [(100 + i, body(1), "en", "web", 1) for i in range(5)]  # copies
    rows += [(110, body(2) + " changed", None, None, None), (111, None, None, None, None), (112, "", "en", "web", 0), (None, "no id here at all", "en", "web", 1), (None, None, None, None, None)]
    rows += [(120, body(500) + " " + PASSAGE + " " + body(501), "en", "web", 1), (121, PASSAGE, "en", "web", 1), (3, body(3) + ".", "en", "web", 1), (122, body(600, 20_000), "en", "web", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("t", PASSAGE), ("none", None), (None, "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain(df):
    return sorted(map(repr, df.collect()))


def test_stages_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    every = {r["doc_id"] for r in docs.collect()}
    first = P.drop_toxic(spark, docs, tables)
    assert {r["doc_id"] for r in first.collect()} == every - {i for i in range(0, 80, 4)} and first.columns == docs.columns
    second = P.drop_near_duplicates(spark, first, tables)
    # one row an id, also of the repeated row 3; both rows without an id stay
    kept = every - {*range(0, 80, 4)} - {100, 101, 102, 103, 104, 110}
    assert sorted((r["doc_id"] for r in second.collect()), key=str) == sorted([*kept, None], key=str)
    third = P.remove_benchmark(spark, second, tables)
    cut = {r["doc_id"]: r["text"] for r in third.collect()}
    assert 121 not in cut and PASSAGE not in cut[120] and cut[120].startswith(body(500)) and cut[120].endswith(body(501))
    unchanged = {r["doc_id"]: r["text"] for r in second.collect() if r["doc_id"] not in (120, 121, None)}
    assert all(cut[i] == t for i, t in unchanged.items())
    fourth = P.mix_sources(spark, third, tables)
    want = {(r["source"]): r["rate"] for r in mixing.rates(third).collect()}
    assert set(want) == {"web", "books", None} and fourth.columns == docs.columns and {r["doc_id"] for r in fourth.collect()} <= {r["doc_id"] for r in third.collect()}
    fifth = P.shard(spark, fourth, tables)
    assert fifth.count() == fourth.count()
    for r in fifth.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect():
        assert r["n"] == r["d"] == r["m"] + 1
    found = P.run(spark, tables)
    assert plain(found.drop("slot")) == plain(fifth.drop("slot"))


def test_stages_keep_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    more = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    for name, stage in P.STAGES:
        want, got = stage(spark, docs, tables), stage(spark, more, tables)
        if name != "sharding":
            assert got.columns == more.columns, name
            for c in CLASHING:
                assert got.where((F.col(c) != F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))).count() == 0, (name, c)
        assert plain(got.select(want.columns if name != "sharding" else [*docs.columns, "size", "shard"])) == plain(want if name != "sharding" else want.select(*docs.columns, "size", "shard")), name


def test_stages_of_columns_with_odd_names(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    nested = F.struct(F.col("doc_id").alias("a b"), F.lit(1).alias("c`d.e"))
    odd = {"a `b.c d": F.concat(F.lit("x"), F.col("doc_id").cast("string")), "n.n": nested, "`": F.array(nested), " ": F.lit(None).cast("string")}
    more = docs.select("*", *(v.alias(k) for k, v in odd.items()))
    for name, stage in P.STAGES:
        want, got = stage(spark, docs, tables), stage(spark, more, tables)
        assert got.columns[: len(more.columns)] == more.columns or set(more.columns) <= set(got.columns), name
        plain_names = got.toDF(*(f"c{i}" for i in range(len(got.columns))))
        at = {c: f"c{i}" for i, c in enumerate(got.columns)}
        assert plain_names.where(F.col(at["a `b.c d"]) != F.concat(F.lit("x"), F.col(at["doc_id"]).cast("string"))).count() == 0, name
        assert plain_names.where(F.col(at["n.n"])["a b"] != F.col(at["doc_id"])).count() == 0, name
        assert plain(plain_names.select(*(F.col(at[c]).alias(c) for c in docs.columns))) == plain(want.select(*docs.columns)), name
    predicted = language_id.predicted(more, language_id.learn(docs))
    assert set(more.columns) <= set(predicted.columns) and predicted.count() == docs.count()


def test_sizes_of_settings():
    from maskmetrics.llm.common import bytes_of

    assert [bytes_of(x) for x in ("256m", "64MB", "1g", "100", "5 kb", "-1", "67108864b")] == [256 << 20, 64 << 20, 1 << 30, 100, 5 << 10, -1, 64 << 20]


def test_stages_of_empty_tables(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    # without labels and items nothing is rejected or cut
    assert P.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count() and plain(P.remove_benchmark(spark, docs, str(tmp_path))) == plain(docs)


def test_operators_take_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    more = docs.select("*", *(F.lit("x").alias(c) for c in CLASHING if c != "held_out"))
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    same = lambda f: plain(f(docs)) == plain(f(more))
    assert same(lambda d: language_model.scored(d, F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))).select("doc_id", "n_tokens", "n_known", "train_tokens"))
    assert same(lambda d: mixing.replicate(d).select("doc_id", "copy", "shuffle_key"))
    assert same(lambda d: language_id.predicted(d.select("doc_id", "text"), language_id.learn(d)).select("doc_id", "lang_pred", "score"))
    assert same(lambda d: sharding.assign(d).select("doc_id", "size", "shard", "grown_shard", "text_crc32"))
    assert same(lambda d: toxicity.scored(d.select("doc_id", "text"), toxicity.learn(d, labels)).select("doc_id", "score"))
    assert same(lambda d: pii.pseudonymise(d, "k").select("doc_id", "text"))
    named = ("_values", "_new", "_text", "_n", "score", "_key")
    for out in (pii.pseudonymise(more, "k"), toxicity.scored(more, toxicity.learn(docs, labels), score="p"), language_id.predicted(more, language_id.learn(docs), score="p")):
        assert {c for c in named if out.where(F.col(c) != "x").count()} == set()
    # the added columns take the place of those of their name
    assert plain(toxicity.scored(more, toxicity.learn(docs, labels)).select("doc_id", "score")) == plain(toxicity.scored(docs, toxicity.learn(docs, labels)).select("doc_id", "score"))
    assert same(lambda d: ngram_join.classes(d))
    assert same(lambda d: decontamination.report(d, bench.withColumn("spans", F.lit(1))))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    clash = lambda d: d.select("*", *(F.lit("x").alias(c) for c in ("digest", "payload_bytes", "payload_digest", "record_type", "refers_to", "size", "path", "id", "n", "top", "kind", "payload", "_digest", "archive", "bucket", "_refers_to", "_page", "_sha", "_key")))
    assert plain(warc.round_trip(pages)) == plain(warc.round_trip(clash(pages)))
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id bigint, embedding array<double>")
    wide = vectors.select("*", *(F.lit("x").alias(c) for c in ("id", "v", "block", "chunk", "score", "rank", "query_id")))
    assert plain(topk.search(vectors, vectors.where("vec_id % 50 = 0"))) == plain(topk.search(wide, wide.where("vec_id % 50 = 0")))


def test_long_text_has_no_limit(spark):
    text = body(1, 60_000)
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text + " end", "en", "s", 1)], DOCS)
    rows = {r["doc_id"]: r for r in ngram_join.classes(docs).collect()}
    words = re.findall(r"\S+", text)
    assert rows[1]["n_shingles"] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and rows[2]["component_id"] == 1


def test_the_driver_lets_go_of_each_stage(spark, monkeypatch):
    from maskmetrics.llm import common

    seen = []
    monkeypatch.setattr(common, "forget", lambda session, rounds=0: seen.append(session))
    assert common.materialised(spark.range(3), "three").count() == 3 and len(seen) == 1
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a bigint, b bigint")
    assert {tuple(r) for r in common.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert len(seen) > 2
