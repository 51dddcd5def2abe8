"""Taggers against brute force: best paths, learning from spans and from partial labels, and the parser built on them."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmetrics.functions import parser as P
from maskmetrics.operators import measures as M
from maskmetrics.operators import tagger as G
from maskmetrics.plans.evaluate import Evaluation


def test_best_paths_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        tags, sizes = int(rng.integers(1, 4)), rng.integers(1, 6, rng.integers(1, 6))
        first, n = np.concatenate(([0], np.cumsum(sizes)[:-1])), int(sizes.sum())
        scores, start, follow = rng.integers(-9, 9, (n, tags)), rng.integers(-9, 9, tags), rng.integers(-9, 9, (tags, tags))
        got = G.best_paths(scores.astype(float), first, start, follow, cells=int(rng.integers(1, 40)))
        for a, size in zip(first.tolist(), sizes.tolist()):
            value = lambda p: start[p[0]] + sum(scores[a + i, t] for i, t in enumerate(p)) + sum(follow[x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
            assert value(got[a : a + size]) == max(map(value, itertools.product(range(tags), repeat=size)))


def test_tokens_of():
    spans, words, first = P.tokens_of("A b! Mr. X\nnew 3.5 line... ok\n. x")
    assert words == ["A", "b", "!", "Mr", ".", "X", "new", "3", ".", "5", "line", ".", ".", ".", "ok", ".", "x"]
    assert first.tolist() == [0, 3, 5, 6, 14, 16] and spans[3].tolist() == [5, 7]
    for empty in ("", " \n"):
        assert [len(x) for x in P.tokens_of(empty)] == [0, 0, 0]


TITLES = ["Anna", "Bert", "Cleo", "Dora", "Emil", "Finn", "Gina", "Hugo"]
PLACES = ["Oslo", "Rome", "Bonn", "Lima", "Kyiv", "Bern"]


def corpus(spark, n=160):
    rng, docs, mentions = np.random.default_rng(3), [], []
    for i in range(n):
        text = ""
        for _ in range(3):
            for part, kind in (("yesterday ", None), (" ".join(rng.choice(TITLES, rng.integers(1, 4))), "PERSON"), (" went to ", None), (rng.choice(PLACES), "LOC"), (" on day ", None), (str(rng.integers(1, 31)), "DATETIME"), (". ", None)):
                if kind and rng.random() < 0.95:
                    mentions.append((str(i), "a1", len(mentions), f"{i}_{len(mentions)}", kind, "DIRECT", len(text), len(text) + len(part)))
                    text += part
                elif not kind:
                    text += part
        docs.append((str(i), text))
    schema = "doc_id string, annotator string, mention_ord int, entity_id string, entity_type string, identifier_type string, start int, end int"
    return spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(mentions, schema)


@pytest.fixture(scope="module")
def learned(spark):
    docs, mentions = corpus(spark)
    return docs, mentions, G.LearnedParser.of(docs.where("doc_id % 4 <> 0"), mentions.where("doc_id % 4 <> 0"), epochs=4)


def test_learned_entities(spark, learned):
    docs, mentions, parser = learned
    held = docs.where("doc_id % 4 = 0")
    found = parser.tokens(held).where("ent_id IS NOT NULL").groupBy("doc_id", "ent_id", "ent_label").agg(F.max("end").alias("end"))
    got = {tuple(r) for r in found.select("doc_id", "ent_id", "end", "ent_label").collect()}
    want = {tuple(r) for r in mentions.where("doc_id % 4 = 0").select("doc_id", "start", "end", "entity_type").collect()}
    assert 2 * len(got & want) / (len(got) + len(want)) > 0.98
    masked = {r["doc_id"]: r["text"] for r in parser.with_entity_types(held.withColumn("other", F.lit(1))).collect()}
    by_hand = {r["doc_id"]: r["text"] for r in held.collect()}
    for doc, start, end, label in sorted(got, key=lambda r: -r[1]):
        by_hand[doc] = by_hand[doc][:start] + label + by_hand[doc][end:]
    assert masked == by_hand


def test_weights_depend_on_shards_only_and_are_saved(spark, learned, tmp_path):
    docs, mentions, parser = learned
    tags = G.outside_tags(["DATETIME", "LOC", "PERSON"])
    sentences = G.labelled_sentences(docs, mentions, tags)
    one, other = (G.learn(s, tags, epochs=2, shards=3, bits=12) for s in (sentences, sentences.repartition(7)))
    assert np.abs(one.flat()).sum() > 0 and np.allclose(one.flat(), other.flat(), atol=1e-5)
    assert not np.array_equal(one.flat(), G.learn(sentences, tags, epochs=2, shards=2, bits=12).flat())
    one.save(spark, f"{tmp_path}/tagger")
    again = G.Tagger.load(spark, f"{tmp_path}/tagger")
    assert again.tags == tags and np.array_equal(again.flat(), one.flat())
    assert not G.learn(sentences.limit(0), tags).flat().any()


def test_one_shard_by_hand(spark):
    # one shard, one sentence a step: the perceptron worked out word by word, averaged over the second of two epochs
    tags = ["O", "B-X", "I-X"]
    rows = [("1", 0, ["a", "Bo", "Cy", "d"], [1, 2, 4, 1]), ("2", 0, ["e", "Bo"], [1, 2]), ("3", 0, ["a", "e"], [1, 1])]
    df = spark.createDataFrame(rows, "doc_id string, sent_id int, words array<string>, allowed array<long>")
    bits, model = 10, G.Tagger.empty(tags, 10)
    order = [rows[int(r[0]) - 1] for r in df.orderBy(F.xxhash64("doc_id", "sent_id")).collect()]
    order.sort(key=lambda r: len(r[2]))
    w, start, follow = np.zeros((1 << bits, 3)), np.zeros(3), np.zeros((3, 3))
    total, steps = np.zeros(w.size + 12), 0
    for epoch in range(2):
        taken = [order[i] for i in np.random.default_rng(0).permutation(np.arange(3))]
        for _, _, words, allowed in taken:
            ids = G.features(words, np.array([0]), bits)
            gold = [int(a).bit_length() - 1 for a in allowed]
            ok = lambda p: p[0] != 2 and all(y != 2 or x in (1, 2) for x, y in zip(p, p[1:]))
            value = lambda p: start[p[0]] + sum(w[ids[i], t].sum() for i, t in enumerate(p)) + sum(follow[x, y] for x, y in zip(p, p[1:]))
            said = max((p for p in itertools.product(range(3), repeat=len(words)) if ok(p)), key=lambda p: (value(p), [-t for t in reversed(p)]))
            for p, sign in ((gold, 1), (said, -1)) if list(said) != gold else ():
                start[p[0]] += sign
                for i, t in enumerate(p):
                    np.add.at(w, (ids[i], t), sign)
                    if i:
                        follow[p[i - 1], t] += sign
            if epoch == 1:
                total, steps = total + np.concatenate((w.ravel(), start, follow.ravel())), steps + 1
    got = G.learn(df, tags, epochs=2, shards=1, batch=1, bits=bits)
    assert model.flat().shape == got.flat().shape and np.allclose(got.flat(), total / steps, atol=1e-5)


def test_partial_labels(spark):
    # "q" is open; what surrounds it is as around sure nouns
    texts = [f"the {w}otion of a {v}oment is here. a q was {x}only over the {v}oness" for w, v, x in itertools.product("abcd", "efgh", "ij")]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    seeds = {w: a for r in G.class_seeds(docs).collect() for w, a in zip(r["words"], r["allowed"])}
    bit = {t: 1 << i for i, t in enumerate(G.CLASSES)}
    assert [seeds[w] for w in ("the", "over", ".", "aotion", "ionly")] == [bit[t] for t in ("DET", "ADP", "PUNCT", "NOUN", "ADV")]
    assert bin(seeds["q"]).count("1") == 4
    classes = G.learn(G.class_seeds(docs), G.CLASSES, epochs=4)
    tagged = {r["text"]: r["pos"] for r in G.LearnedParser(spark, None, classes).tokens(docs).collect()}
    assert [tagged[w] for w in ("q", "the", "over", "eoment", "jonly")] == ["NOUN", "DET", "ADP", "NOUN", "ADV"]
    chunk = G.LearnedParser(spark, None, classes).tokens(docs.limit(1)).where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.count("*").alias("n")).orderBy("chunk_id").collect()
    assert [tuple(r) for r in chunk][:1] == [(0, 2)]


def test_noun_chunks_by_pattern(spark):
    rng = np.random.default_rng(4)
    letter = {**P.LETTERS, "VERB": "O", "PUNCT": "O", None: "O"}
    rows = [(i, [list(letter)[k] for k in rng.integers(0, len(letter), rng.integers(0, 14))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, classes array<string>").select("i", P.chunk_places(F.col("classes")).alias("places"))
    for i, places in df.collect():
        want = [None] * len(rows[i][1])
        for m in re.finditer(P.NOUN_CHUNK, "".join(letter[c] for c in rows[i][1])):
            want[m.start() : m.end()] = [m.start()] * (m.end() - m.start())
        assert places == want


def test_spans_of_mentions(spark):
    docs = spark.createDataFrame([("1", "aa bb-cc dd"), ("2", ""), ("3", None), ("4", "x y")], "doc_id string, text string")
    mentions = spark.createDataFrame([("1", 1, 5, "X"), ("1", 3, 8, "Y"), ("1", 3, 11, "Z"), ("1", 6, 8, "Y"), ("1", 9, 11, "W"), ("2", 0, 0, "X"), ("9", 0, 1, "X")], "doc_id string, start int, end int, entity_type string")
    tags = G.outside_tags(["X", "Y", "Z"])
    got = {(r["doc_id"], r["sent_id"]): (r["words"], [tags[a.bit_length() - 1] for a in r["allowed"]]) for r in G.labelled_sentences(docs, mentions, tags).collect()}
    # the one that begins first takes its tokens, then the longest of the rest that is left of them; no tag, no span
    assert got == {("1", 0): (["aa", "bb", "-", "cc", "dd"], ["B-X", "I-X", "B-Z", "I-Z", "I-Z"]), ("4", 0): (["x", "y"], ["O", "O"])}


def test_evaluation_takes_a_parser(spark, learned):
    docs, mentions, parser = learned
    masks = mentions.select(F.lit("A").alias("anon_name"), "doc_id", F.col("mention_ord").alias("mask_ord"), "start", "end", F.lit(None).cast("string").alias("replacement"))
    anon = docs.select(F.lit("A").alias("anon_name"), F.lit(0).alias("anon_ord"), "doc_id")
    by = {name: Evaluation(docs, mentions, parser=p) for name, p in (("patterns", P.PATTERNS), ("learned", parser))}
    terms = {n: e.terms(None, 6, True).count() for n, e in by.items()}
    assert terms["learned"] != terms["patterns"] < M.terms(docs).count()
    tpi = {n: e.tpi(anon, masks, weighting_model_name=None).first()["tpi"] for n, e in by.items()}
    assert 0 < tpi["learned"] < 1 and 0 < tpi["patterns"] < 1 and tpi["learned"] != tpi["patterns"]
    assert by["learned"].recall(anon, masks).first()["recall"] == 1.0
