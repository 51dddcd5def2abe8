"""The training-data operators against brute force, exact round trips, and their edge cases."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskmetrics.llm import decontamination as D
from maskmetrics.llm import language_id as LI
from maskmetrics.llm import language_model as LM
from maskmetrics.llm import mixing, ngram_join as J, pii, sharding, topk, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", "   ", "one", "A b\tc d É", "long " * 30_000, "same words here again and again", "same words here again and again"]


def test_language_model(spark):
    texts = [*EDGES, *(f"the cat {w} sat on the mat {w}" for w in "abcdefghij")]
    docs = frame(spark, texts)
    rows = {r["doc_id"]: r for r in LM.scored(docs, F.col("doc_id") % 4 == 1).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + ["\n"] for i, t in enumerate(texts)}
    count = {}
    for i, ts in tokens.items():
        for t in ts if i % 4 != 1 else ():
            count[t] = count.get(t, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, ts in tokens.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ts), sum(t in count for t in ts), n, i % 4 == 1)
        assert r["base_score"] == pytest.approx(sum(np.log10((count.get(t, 0) + 1) / (n + v + 1)) for t in ts))
        assert r["score"] < 0 and np.isfinite(r["score"])
    assert rows[6]["score"] == rows[7]["score"]
    assert LM.scored(docs.limit(0), F.lit(False)).count() == 0


def seated_in_process(texts, asked, burn_in, samples):
    """(block, predictive probabilities) of one block with the pairs of texts, which train, and of asked, which don't."""
    chunk = LM.Chunk()
    for t, held in [*((t, False) for t in texts), *((t, True) for t in asked)]:
        raw = np.frombuffer(t.encode(), np.uint8)
        chunk.add([0], [held], *LM.tokens(raw, np.array([0, len(raw)])))
    hot = np.zeros(0, np.uint64)
    block = LM.Block([b for batch in chunk.dealt(1, 0, hot, False) for b in batch.column(2).to_pylist()])
    x, change = LM.Seating.of(block, hot)

    def root():
        alone = x.alone[0]
        return LM.Root(float(len(x.words) + alone), float(x.per_word(x.tables).sum() + alone), float(x.parent.sum() + alone), np.zeros(0), np.zeros(0))

    roots = []
    for i in range(burn_in + samples):
        x.told(change)
        change = x.sweep(root(), hot, i)
        if i >= burn_in:
            x.sampled()
            roots.append(root())
        x = LM.Seating.read(x.packed())
    per_context = lambda y: np.bincount(block.context, y, len(block.contexts))
    tables = LM.tables_of(block, x, samples)
    return block, LM.predictive(block, x, roots, hot, per_context(block.count), [per_context(t) for t in tables])


def hashed(word):
    return int(LM.END) if word == "\n" else LM.W.hash_word(word)


def test_predictive_probabilities_sum_to_one():
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat a dog", "the the the cat"] * 3
    known = sorted({w for t in texts for w in t.split()})
    asked = [f"{u} {w}" for u in [*known, "never"] for w in [*known, "other"]] + [*known, "never", ""]
    block, p = seated_in_process(texts, asked, 3, 4)
    for u in [*known, "never"]:
        of = {hashed(w) for w in [*known, "other", "\n"]}
        context = np.uint64(hashed(u)) >> LM.CONTEXT
        total, seen = 0.0, set()
        for word, c, value in zip(block.words[block.word], block.contexts[block.context], p):
            if c == context and int(word) in of:
                total, seen = total + value, seen | {int(word)}
        assert seen == of and total == pytest.approx(1.0)


def test_seating_by_brute_force():
    # customers seated one by one at tables, in the words' restaurants and their parent's, against the sweeps over dishes
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"], rng.integers(3, 9), p=[0.4, 0.3, 0.15, 0.1, 0.05])) for _ in range(30)]
    pairs = [(u, w) for t in texts for u, w in zip(["\n", *t.split()], [*t.split(), "\n"])]
    words = sorted({w for _, w in pairs})
    tables = {}  # (restaurant, dish) -> sizes of its tables; the parent's restaurant is None
    theta, d = {True: LM.ROOT_STRENGTH, False: LM.STRENGTH}, {True: LM.ROOT_DISCOUNT, False: LM.DISCOUNT}

    def probability(u, w):
        top = u is None
        own = [s for (r, _), s in tables.items() if r == u]
        n, t = sum(map(sum, own)), sum(map(len, own))
        mine = tables.get((u, w), [])
        base = 1 / (len(words) + 1) if top else probability(None, w)
        return (sum(mine) - d[top] * len(mine) + (theta[top] + d[top] * t) * base) / (theta[top] + n)

    def sit(u, w):
        top, mine = u is None, tables.setdefault((u, w), [])
        t = sum(len(s) for (r, _), s in tables.items() if r == u)
        base = 1 / (len(words) + 1) if top else probability(None, w)
        weights = [*(s - d[top] for s in mine), (theta[top] + d[top] * t) * base]
        at = int(rng.choice(len(weights), p=np.array(weights) / sum(weights)))
        if at < len(mine):
            mine[at] += 1
        else:
            mine.append(1)
            if not top:
                sit(None, w)

    def leave(u, w):
        mine = tables[u, w]
        at = int(rng.choice(len(mine), p=np.array(mine) / sum(mine)))
        mine[at] -= 1
        if not mine[at]:
            del mine[at]
            if u is not None:
                leave(None, w)

    for u, w in pairs:
        sit(u, w)
    asked = [(u, w) for u in words for w in words]
    mean = np.zeros(len(asked))
    for i in range(60):
        for u, w in pairs:
            leave(u, w)
            sit(u, w)
        if i >= 10:
            mean += [probability(u, w) for u, w in asked]
    mean /= 50
    block, p = seated_in_process(texts, [f"{u} {w}".replace("\n", " ") for u, w in asked], 10, 60)
    found = {(int(w), int(c)): x for w, c, x in zip(block.words[block.word], block.contexts[block.context], p)}
    ours = np.array([found[hashed(w), hashed(u) >> 16] for u, w in asked if (hashed(w), hashed(u) >> 16) in found])
    theirs = np.array([m for (u, w), m in zip(asked, mean) if (hashed(w), hashed(u) >> 16) in found])
    assert len(ours) > 30 and np.abs(np.log10(ours / theirs)).mean() < 0.02 and np.abs(np.log10(ours / theirs)).max() < 0.12


def test_hot_words_and_partitions_change_no_score(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], 30, p=np.arange(60, 0, -1) / 1830)) + " the end" * 5 for _ in range(120)]
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert len(LM.hot_words(frame(spark, texts), "text", int(n))) > 0
        found.append({r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in LM.scored(frame(spark, texts), F.col("doc_id") % 5 == 0).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, a in found[0].items():
        assert a == pytest.approx(found[1][i], rel=1e-9, abs=1e-9)


def test_seating_is_exact_for_small_and_large_dishes():
    for d, c in ((LM.DISCOUNT, 64), (LM.ROOT_DISCOUNT, 64)):
        t = np.arange(1, c)
        assert np.abs(LM.log_stirling(np.full(c - 1, float(c)), t.astype(float), d) - LM._stirling(d)[c, 1:c]).max() < 0.15
    # S(c, t) for 300 customers by its recurrence, and the mean number of tables that follows; the steps must reach it
    d, c, strength, p = 0.8, 300, 40.0, 0.3
    log = np.full(c + 2, -np.inf)
    log[0] = 0.0
    for n in range(c):
        t = np.arange(1, c + 2)
        log[1:], log[0] = np.logaddexp(log[:-1], log[1:] + np.log(np.maximum(n - d * t, 1e-300))), -np.inf
    t = np.arange(1, c + 1)
    weight = log[1 : c + 1] + np.cumsum(np.log((strength + d * (t - 1)) * p))
    weight = np.exp(weight - weight.max())
    want = (t * weight).sum() / weight.sum()
    n = 2000
    tables = np.ones(n, np.int64)
    for salt in range(30):
        tables = LM.seated(np.full(n, c), tables, np.full(n, strength), np.full(n, p), d, np.arange(n).astype(np.uint64), salt)
    assert abs(tables.mean() - want) < 0.02 * want
    # more customers than ever had a party of their own: tables go on growing
    more = LM.seated(np.full(n, 1_000_000), tables, np.full(n, 1e5), np.full(n, p), d, np.arange(n).astype(np.uint64), 1)
    assert more.min() > 300


def test_language_model_knows_every_context_and_any_partitioning(spark):
    # 70,000 contexts of one word each: none shares a restaurant, and the same scores for any number of blocks
    texts = [" ".join(f"c{i} f{i}" for i in range(a, a + 1000)) for a in range(0, 70_000, 1000)] * 3
    docs = frame(spark, texts + ["the cat the cat the dog"] * 200 + ["c5 f5", "c5 f6"])
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({r["doc_id"]: r["score"] for r in LM.scored(docs, F.col("doc_id") >= 410).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == pytest.approx(found[1]) and found[0][410] > found[0][411] + 2


def test_mixing(spark):
    docs = frame(spark, [f"text {i}" for i in range(400)]).withColumn("source", F.when(F.col("doc_id") % 4 == 0, "a").when(F.col("doc_id") % 4 == 1, None).otherwise("b"))
    out = mixing.replicate(docs, epochs=3.0).toPandas()
    assert 1000 < len(out) < 1400 and list(out.columns) == [*(c for c in docs.columns if c != "copy"), "copy", "shuffle_key"]
    again = mixing.replicate(docs.repartition(3), epochs=3.0).toPandas()
    assert sorted(zip(out["doc_id"], out["copy"], out["shuffle_key"])) == sorted(zip(again["doc_id"], again["copy"], again["shuffle_key"]))
    only = mixing.replicate(docs, weights={"a": 1.0}).toPandas()
    assert set(only.source) == {"a"} and 300 < len(only) < 500
    assert mixing.replicate(docs.limit(0)).count() == 0
    big = mixing.replicate(docs.limit(20), epochs=2000.0).count()
    assert abs(big - 40_000) < 20 * 45 * 5


def test_language_id(spark):
    texts = [f"the and of with there is this {i}" for i in range(30)] + [f"der die und nicht mit ist ein {i}" for i in range(30)]
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 30, "en").otherwise("de"))
    model = LI.learn(docs)
    asked = frame(spark, ["this is the one with the other", "das ist nicht mit der ein und die", *EDGES[:3], "123 !?", "ééé"])
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in LI.predicted(asked, model).collect()}
    assert out[0][0] == "en" and out[1][0] == "de" and all(out[i] == ("und", 0.0) for i in (2, 3, 4, 5)) and out[6][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in out.values())
    assert {r[0] for r in LI.predicted(asked, LI.learn(docs.where("false"))).select("lang_pred").collect()} == {"und"}
    # every language is learned however few rows there may be of each; too many are refused
    many = docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 20))
    assert len(LI.learn(many, max_rows=20).languages) == 20
    with pytest.raises(ValueError):
        LI.learn(many, max_rows=19)
    assert {r["doc_id"] for r in LI.predicted(frame(spark, ["x y " * 40_000]), model).collect()} == {0}


def test_features_do_not_depend_on_neighbours():
    texts = [b"caf\xc3\xa9 the", b"\xff\xfe bad \xe9", b"", b"gar\xc3\xa7on \xe2\x82\xac"]
    every = [LI.characters(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist() for t in texts]
    points, at = LI.characters(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [points[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == every and len(every[0]) == 8 and len(every[1]) == 8


def test_leader_by_brute_force():
    # the published per-coordinate updates, one number at a time
    rng = np.random.default_rng(5)
    leader = LI.FollowTheRegularisedLeader(6, 3, alpha=0.7, beta=1.0, l1=0.05, l2=0.1)
    z, n = [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]
    w = lambda i, k: 0.0 if abs(z[i][k]) <= 0.05 else -(z[i][k] - (0.05 if z[i][k] > 0 else -0.05)) / ((1.0 + n[i][k] ** 0.5) / 0.7 + 0.1)
    for _ in range(60):
        at = np.sort(rng.choice(6, 3, replace=False))
        x, label = rng.random(3), int(rng.integers(3))
        scores = [sum(v * w(i, k) for i, v in zip(at, x)) for k in range(3)]
        total = sum(np.exp(s) for s in scores)
        old = {(i, k): w(i, k) for i in at for k in range(3)}
        for i, v in zip(at, x):
            for k in range(3):
                g = v * (np.exp(scores[k]) / total - (k == label))
                sigma = ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / 0.7
                z[i][k] += g - sigma * old[i, k]
                n[i][k] += g * g
        leader.learn(at, x, label)
    assert np.allclose(leader.weights(), [[w(i, k) for k in range(3)] for i in range(6)])


def test_tf_idf_by_brute_force():
    texts = ["abba", "ab c", "zz"]
    found = np.concatenate([c for _, _, c, _ in LI.counts(pa.array(texts))])
    assert found.sum(1).tolist() == [3 * len(t) - 3 for t in texts]
    idf = np.log((1 + 3) / (1 + (found > 0).sum(0))) + 1
    x = LI.features(found, idf)
    want = np.log(1 + found) * idf
    assert np.allclose(x, want / np.sqrt((want**2).sum(1, keepdims=True)), rtol=1e-5)


def test_temperature():
    # labels drawn from the scores' own softmax at temperature 2.5
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(20_000, 3)) * 4
    p = np.exp(scores / 2.5)
    p /= p.sum(1, keepdims=True)
    labels = (p.cumsum(1) < rng.random((20_000, 1))).sum(1)
    assert LI.temperature_of(scores, labels) == pytest.approx(2.5, rel=0.08)


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    keys = spark.range(300).select(F.xxhash64("id").alias("k"))
    for r in keys.select("k", sharding.jump(F.col("k"), 1, 8, 9, 64).alias("j")).collect():
        assert [r["j"][f"n{n}"] for n in (1, 8, 9, 64)] == [jump(r["k"], n) for n in (1, 8, 9, 64)]
    out = sharding.assign(frame(spark, EDGES * 40, ids=[*range(300), *[None] * 20])).toPandas()
    assert ((out["shard"] == out["grown_shard"]) | (out["grown_shard"] == 8)).all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    for t, size, crc in zip(out["text"], out["size"], out["text_crc32"]):
        raw = (t or "").encode()
        assert (size, crc) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.assign(frame(spark, EDGES).limit(0)).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = lambda: " ".join(rng.choice([f"w{i}" for i in range(40)], 12)) + ". " + " ".join(rng.choice([f"w{i}" for i in range(40)], 9)) + "."
    texts = [plain() + (" You scum idiot." if i % 3 == 0 else "") for i in range(150)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(500, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    asked = frame(spark, ["w1 w2. What an idiot scum! w3 w4", "w1 w2 w3.", *EDGES])
    out = {r["doc_id"]: r for r in toxicity.scored(asked, model, sentences_over=0.5).collect()}
    assert out[0]["score"] > 0.7 > out[1]["score"] and out[2]["score"] == 0 == out[3]["score"]
    (s,) = out[0]["sentences"]
    assert "w1 w2. What an idiot scum! w3 w4"[s["start"] : s["end"]] == "What an idiot scum"
    assert {r["doc_id"] for r in toxicity.clean(asked, model).collect()} == set(out) - {0}
    assert len(toxicity.learn(docs, labels.where("toxic = 0")).words) == 0


def test_noisy_or_fit_by_brute_force():
    # steps of the written-out likelihood, with its gradient by differences
    doc, cell_s, cell_w = np.array([0, 0, 1, 2, 3]), np.array([0, 0, 1, 2, 3, 4]), np.array([0, 1, 2, 0, 1, 2])
    y, spoken, start = np.array([1, 0, 1, 0]), np.array([True, True, True, True]), np.array([2.0, 1.5, 1.2])
    weight = np.where(y == 1, 0.5 / 2, 0.5 / 2)

    def loss(v):
        w, b = v[:-1], v[-1]
        hazard = [np.log1p(np.exp(b))] * 4
        for s in range(5):
            evidence = sum(w[j] for i, j in zip(cell_s, cell_w) if i == s)
            if evidence >= toxicity.EVIDENCE:
                hazard[doc[s]] += np.log1p(np.exp(b + evidence)) - np.log1p(np.exp(b))
        each = [-np.log(-np.expm1(-h)) if label else h for h, label in zip(hazard, y)]
        return float(np.dot(weight, each)) + 0.5 * 1e-4 * float((w**2).sum())

    v, seen = np.array([*start, -6.0]), np.full(4, 1e-8)
    for _ in range(5):
        g = np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(4) * 1e-5])
        seen += g * g
        v = v - 0.3 * g / np.sqrt(seen)
    model = toxicity.descended(np.arange(3, dtype=np.uint64), start, y, spoken, doc, cell_s, cell_w, steps=5)
    assert np.allclose([*model.weights, model.bias], v, atol=1e-3)


def test_toxicity_does_not_grow_with_length(spark):
    rng = np.random.default_rng(3)
    plain = lambda n: " ".join(" ".join(rng.choice([f"w{i}" for i in range(40)], 9)) + "." for _ in range(n))
    # the sign of label 1 stands in long texts alone, which are learned from like others
    texts = [plain(2) + (" You scum idiot." if i % 3 == 0 else "") for i in range(90)] + [plain(7000) + " Vermin of vermin." * (i % 2) for i in range(24)]
    labels = spark.createDataFrame([(i, i % 2 if i >= 90 else int(i % 3 == 0)) for i in range(len(texts))], "doc_id bigint, toxic int")
    model = toxicity.learn(frame(spark, texts), labels)
    asked = [plain(20_000), plain(10_000) + " You scum idiot. " + plain(10_000), "w1 w2. Vermin of vermin!", "w1."]
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(frame(spark, asked), model).collect()}
    assert out[0] < 0.7 <= min(out[1], out[2]) and out[3] < 0.1


def test_pii(spark):
    text = "Born 1987-03-05, 05/03/1987 or 31.12.1999, ssn 123-45-6789, 666-45-6789, ip 10.0.0.1 300.1.1.1 card 4111 1111 1111 1111 4111111111111112 Anna.Bell_7@x.org +44 20 7946 0958 (555) 123-4567 2023-02-30"
    docs = frame(spark, [text, text + " again", *EDGES])
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    assert out[0]["text"] != pii.pseudonymise(docs, "another").where("doc_id = 0").first()["text"]
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")
    assert out[0]["n_values"] == 9 and out[1]["text"] == out[0]["text"] + " again"
    new = out[0]["text"]
    assert len(re.findall(r"\d{4}-\d{2}-\d{2}", new)) >= 2 and "666-45-6789" in new and "300.1.1.1" in new and "4111111111111112" in new and "2023-02-30" in new and "@x.org" in new
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    assert all(out[i + 2]["text"] == t for i, t in enumerate(EDGES))
    back = pii.pseudonymise(spark.createDataFrame([(0, new)], "doc_id int, text string"), "k", back=True).first()
    assert back["text"] == text
    days = spark.range(500).select(pii.feistel(F.col("id") % 25, F.floor(F.col("id") / 25), F.lit(25).cast("bigint"), F.lit(20).cast("bigint"), "t", "k").alias("f"))
    assert days.distinct().count() == 500


def components(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(sets))]


def test_ngram_join(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = list(EDGES)
    for _ in range(12):
        base = list(rng.choice(vocabulary, rng.integers(3, 150)))
        for _ in range(rng.integers(1, 7)):
            copy = [w if rng.random() > 0.03 else "x" for w in base]
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for block in (1024, 5, 2):
        out = {r["doc_id"]: r for r in J.classes(frame(spark, texts), block=block).collect()}
        assert [out[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
        assert [out[i]["component_id"] for i in range(len(texts))] == components(sets)
    # a doc_id repeated with another text: each text is judged by itself, and of wholly repeated rows one stays
    base = [" ".join(rng.choice(vocabulary, 60)) for _ in range(3)]
    again = frame(spark, [base[0], base[0], base[1], base[2], base[2].upper(), base[1] + " more"], ids=[1, 2, 2, 5, 5, 9]).union(frame(spark, [base[1]], ids=[2]))
    assert sorted((r["doc_id"], r["text"].lower()) for r in J.keep_one(again).collect()) == sorted([(1, base[0]), (2, base[1]), (5, base[2])])
    assert [r["component_id"] for r in J.classes(frame(spark, [base[0], base[0]], ids=[-3, 4])).collect()] == [-3, -3]
    kept = J.keep_one(frame(spark, texts))
    assert kept.count() == len(set(components(sets)) | {0, 1, 2}) and J.classes(frame(spark, texts).limit(0)).count() == 0


def test_prefix_tree_and_parities():
    rng = np.random.default_rng(9)
    for _ in range(20):
        bases = [np.unique(rng.integers(0, 500, rng.integers(1, 80))) for _ in range(3)]
        sets = {}
        for _ in range(25):
            b = bases[rng.integers(3)]
            s = np.unique(np.concatenate((b[rng.random(len(b)) > rng.choice([0, 0.05, 0.2])], rng.integers(0, 500, 2)))).astype(np.uint64)
            sets[tuple(s)] = s
        sets = list(sets.values())
        plain = [set(s.tolist()) for s in sets]
        true = components(plain)
        links = J.join_group(sets)
        label = list(range(len(sets)))
        for a, b in links:
            assert 100 * len(plain[a] & plain[b]) >= 75 * len(plain[a] | plain[b])
            label = [label[a] if x == label[b] else x for x in label]
        assert len(set(label)) == len(set(true))
        could = J.possible(np.array([len(s) for s in sets]), [J.parities(s) for s in sets], (75, 100))
        assert all(could[i] == could[t] for i, t in enumerate(true))


PAGES = "page_id bigint, url string, html string, extra int"


def test_warc(spark):
    rows = [(i, f"http://x/{i % 5}", h, 1) for i, h in enumerate(["<p>a</p>", None, "", "<p>a</p>", "é" * 50_000, "x\r\n\r\nContent-Length: 3\r\n\r\n", "<p>a</p>"])] + [(90, None, "line\nbreak", 1)]
    out = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES), archive_bytes=20_000).collect()}
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(i, top.get(h or "", i))
    for i, _, h, _ in rows:
        raw, r = (h or "").encode(), out[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top[h or ""] == i else ("revisit", top[h or ""]))
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)) * 0.2
    x[50:60] = x[49]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [None] * 16), (902, [float("nan")] * 16), (903, []), (None, [0.0] * 16), (3, [float(v) for v in x[3]])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = np.floor(x * 256).astype(int)
    for block, chunk in ((32_768, 4096), (40, 3)):
        out = topk.search(v, v.where("vec_id % 50 = 0"), block=block, chunk=chunk).toPandas()
        for i in range(0, 300, 50):
            s = q @ q[i]
            best = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
            g = out[out.query_id == i].sort_values("rank")
            assert g.vec_id.tolist() == best and g.score.tolist() == s[best].tolist()
        assert set(out.query_id) == set(range(0, 300, 50))
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("hub", [0, 250, 999])
def test_components_of_stars_chains_and_random_links(spark, hub):
    from maskmetrics.llm.common import components as linked

    rng = np.random.default_rng(hub)
    nodes = np.setdiff1d(np.arange(0, 1000), [hub])
    edges = [(hub, int(x)) for x in nodes[nodes < 500]] + [(i, i + 1) for i in range(600, 640)] + [tuple(map(int, x)) for x in rng.integers(700, 1000, (150, 2))] + [(3, 3), (hub, 5), (5, hub)]
    parent = list(range(1000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r["node"]: r["component"] for r in linked(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert linked(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_topk_keeps_ties_and_large_components():
    rng = np.random.default_rng(11)
    for trial in range(24):
        size, n, d = [0.02, 6, 110, 1e5, 1e9, 1e17][trial % 6], int(rng.integers(1, 500)), [1, 3, 64][trial % 3]
        x = np.floor(rng.normal(size=(n, d)) * size * 256)
        if n > 250:  # more equal best rows than are ever resolved early
            x[40:240] = x[np.argmax(x @ x[0])]
        ids = rng.permutation(3 * n)[:n].astype(np.int64)
        exact = np.array([[int(v) for v in row] for row in x], object)
        m = min(n, 12)
        at, found, score = topk.SortedLists(ids, x).top(ids[:m], x[:m], 5, 8)
        for i in range(m):
            s = exact @ exact[i]
            best = [j for j in sorted(range(n), key=lambda j: (-s[j], ids[j])) if j != i][:5]
            assert found[at == i].tolist() == [ids[j] for j in best]
            assert score[at == i].tolist() == [max(-(2**63), min(2**63 - 1, s[j])) for j in best]


BENCH = "item_id string, text string"


def test_decontamination(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [" ".join(rng.choice(vocabulary, n)) for n in (25, 12, 10, 4, 1, 30)] + ["", None]
    texts = [" ".join(rng.choice(vocabulary, 80)) for _ in range(10)] + [f"before {items[0].upper()}. after", items[3], f"x {items[1].replace(' ', ', ')} {items[5]}", "alone", *EDGES]
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)] + [("twice", items[0])], BENCH)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    for size in (400_000, 20):
        out = {r["doc_id"]: r for r in D.report(frame(spark, texts), bench, max_item_words=size).collect()}
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for item, text in [(f"i{k}", x) for k, x in enumerate(items)] + [("twice", items[0])]:
                v = words(text)
                m = min(10, len(v))
                for a in range(len(v) - m + 1) if v else ():
                    for b in range(len(w) - m + 1):
                        if w[b : b + m] == v[a : a + m]:
                            hit |= set(range(b, b + m))
                            found.add(item)
            r = out[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    long_only = bench.where("item_id IN ('i0', 'i1')")
    cleaned = {r["doc_id"]: r for r in D.clean(frame(spark, [f"é one two three four five {' '.join('abcdefghijklmnopqrstuvwxyz')} {items[1]} end", items[0], *EDGES]), long_only).collect()}
    assert cleaned[0]["text"].startswith("é one") and items[1] not in cleaned[0]["text"] and cleaned[0]["n_chars"] == len(cleaned[0]["text"]) and 1 not in cleaned
    assert all(cleaned[i + 2]["text"] == t for i, t in enumerate(EDGES))


def test_split_by_loses_no_row(spark):
    from maskmetrics.llm.common import split_by

    rows = spark.range(500).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("id"), F.lit("x").alias("_bucket"))
    wanted = spark.range(0, 500, 7).select(F.col("id").alias("k"))
    for buckets in (1 << 20, 16, 1):
        near, rest = split_by(rows, rows["id"], wanted, wanted["k"], buckets)
        assert near.columns == rows.columns and near.count() + rest.count() == 500
        assert {r["id"] for r in near.collect()} >= {i for i in range(0, 500, 7) if i % 50} and (buckets > 1 or rest.count() == 0)


def test_benchmark_parts_are_bounded_by_words(spark):
    # "a-b" is two words for the operator, and one between blanks
    bench = spark.createDataFrame([(f"i{k}", "a-b c-d") for k in range(6)], BENCH)
    assert [len(p) for p in D.parts(bench, 8)] == [2, 2, 2] and [len(p) for p in D.parts(bench, 3)] == [1] * 6
