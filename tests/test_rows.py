"""Mentions, masks and words as arrays of a document's row: results by brute force, and no row of theirs is shuffled."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskmetrics.functions import parser, text as T
from maskmetrics.operators import by_document as D, entities as E, measures as M
from maskmetrics.plans.fixtures import Fixture
from maskmetrics.plans import queries

DATA = "/root/testdata/sf0.001"


def _folded(text, masks):
    for start, end, replacement in reversed(masks):
        text = text[:start] + (replacement or "") + text[end:]
    return text


def test_masking_by_brute_force():
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(0, 30)))
        masks = [(a, a + draw.randrange(-2, 9) if a > 1 else a + 2, draw.choice([None, "", "X", "LOC"])) for a in (draw.randrange(0, 34) for _ in range(draw.randrange(0, 7)))]
        for given in (masks, sorted(masks, key=lambda m: m[0])):
            assert T.masked(text, given) == _folded(text, given)


def test_negative_ends_are_as_substr_has_them():
    assert [T.masked("abcd", [(1, end, "-")]) for end in (-1, -2, -3, -9)] == ["a-abcd", "a-bcd"[:2] + "d", "a-cd", "a-abcd"]


def test_entities_by_the_whole_pattern():
    draw = random.Random(9)
    pieces = ["a.b@c.de", "@", "x@y", "Anna Bo", "Bo ", "10.0.0.1", "4111111111111111", "3,5", "1.", "\n", " ", ". ", "ab-", "É", "@@", "r@s.t\n", "٣"]
    for _ in range(2000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(0, 14)))
        assert parser.entities_of(text) == [(*m.span(), m.lastgroup) for m in parser._ENTITIES.finditer(text)]


def test_overlapping_masks_take_one_pass():
    """Ten times the text and masks, about ten times the time, and not a hundred."""

    def taken(n):
        text, masks = "ab " * n, [(3 * i, 3 * i + 5, None) for i in range(n - 1)]
        begun = time.process_time()
        T.masked(text, masks)
        return time.process_time() - begun

    assert taken(400_000) < 40 * max(taken(40_000), 0.005)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_texts_do_not_go_to_their_labels(spark):
    plan = queries.QUERIES["attack_texts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftOuter")
    assert "md5(" in plan[join:] and "md5(" not in plan[:join]


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(5)
    pieces = ["Anna", "of", "Mr", " ", " ", ", ", "(x)", "the", "Ünal", "7", "_", "𝔸b", "-", "\n", "About"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(0, 40))) for _ in range(60)] + [None, "", "one " * 3000]
    span = lambda t: (lambda a: (a, a + draw.randrange(1, 9)))(draw.randrange(-1, len(t or "") + 2))
    docs = [(str(i), t, len(t or "")) for i, t in enumerate(texts)]
    mentions = [(d, a, k, f"{d}{a}{draw.randrange(3)}", draw.choice(["P", "L", None]), draw.choice(["DIRECT", "QUASI", "NO_MASK"]), *span(t)) for d, t, _ in docs for a in ("a", "b")[: draw.randrange(3)] for k in range(draw.randrange(6))]
    masks = [(n, d, k, *span(t), draw.choice([None, "R"])) for d, t, _ in docs for n in "XYZ" for k in range(draw.randrange(7))]
    anon_docs = [(n, d) for d, _, _ in docs for n in "XYZW" if draw.random() < 0.8]
    frame = spark.createDataFrame
    return (
        frame(docs, "doc_id string, text string, n_chars int"),
        frame(mentions, "doc_id string, annotator string, mention_ord int, entity_id string, entity_type string, identifier_type string, start int, end int"),
        frame(masks, "anon_name string, doc_id string, mask_ord int, start int, end int, replacement string"),
        frame(anon_docs, "anon_name string, doc_id string"),
    )


def _seen(frames):
    return [f.collect() for f in frames]


def _masked(text, start, end, masks):
    ignored = {i for m in re.finditer(r"\w+", text) if m.group().lower() in parser.IGNORABLE_WORDS for i in range(*m.span())}
    under = {i for a, z in masks for i in range(a, z)}
    return all(i in ignored or i in under or text[i] in T.CHARACTERS_TO_IGNORE for i in range(max(start, 0), min(end, len(text))))


def test_recall_and_entities_by_brute_force(corpus):
    docs, mentions, masks, anon_docs = corpus
    d, m, k, n = _seen(corpus)
    text = {r["doc_id"]: r["text"] or "" for r in d}
    of = lambda name, doc: [(r["start"], r["end"]) for r in k if (r["anon_name"], r["doc_id"]) == (name, doc)]
    ignorable = parser.ignorable_tokens(M.words(docs))
    want = {(a["anon_name"], r["annotator"], r["doc_id"], r["mention_ord"]): _masked(text[r["doc_id"]], r["start"], r["end"], of(*a)) for r in m for a in n if a["doc_id"] == r["doc_id"]}
    found = E.masked_spans(mentions, masks, anon_docs, docs, ignorable).collect()
    assert len(found) == len(want) and all(want[r["anon_name"], r["annotator"], r["doc_id"], r["mention_ord"]] == r["is_masked"] for r in found)
    rows = docs.select("doc_id", "text", parser.ignorable_spans("text").alias("ignorable")).join(D.listed(mentions, "mentions", mentions.columns[1:]), "doc_id")
    entities = {tuple(r) for r in D.masked_entities(D.with_masks(rows, masks, anon_docs)).collect()}
    assert entities == {tuple(r) for r in E.masked_entities(E.masked_spans(mentions, masks, anon_docs, docs, ignorable)).select("anon_name", "doc_id", "annotator", "entity_id", "is_masked").collect()}
    chosen = {(r["doc_id"], r["annotator"], r["entity_id"]): r["entity_type"] for r in E.to_mask(E.entities(mentions), include_direct=False).collect()}
    counts = {}
    for r in m:
        at = (r["doc_id"], r["annotator"], r["entity_id"])
        for w in re.compile(r"\w+").finditer(text[r["doc_id"]], max(r["start"], 0), max(r["end"], 0)) if at in chosen else ():
            for a in n:
                if a["doc_id"] == r["doc_id"]:
                    c = counts.setdefault((a["anon_name"], chosen[at]), [0, 0])
                    c[0] += 1
                    c[1] += _masked(text[r["doc_id"]], *w.span(), of(*a))
    assert {(r[0], r[1]): [r[2], r[3]] for r in M.mask_counts(mentions, masks, anon_docs, docs, ignorable, include_direct=False).collect()} == counts


def test_covering_by_brute_force(corpus):
    docs, mentions, masks, anon_docs = corpus
    d, m, k, n = _seen(corpus)
    want = {tuple(r)[:3]: len({x["annotator"] for x in m if x["doc_id"] == r["doc_id"] and x["identifier_type"] != "NO_MASK" and x["start"] <= r["start"] and r["end"] <= x["end"]}) for r in k}
    found = E.covering_annotators(masks, mentions, ["anon_name", "doc_id", "mask_ord"])
    assert found.columns == [*masks.columns, "n_covering"] and {tuple(r)[:3]: r["n_covering"] for r in found.collect()} == want
    all_of = {r["doc_id"]: set() for r in d}
    for x in m:
        all_of[x["doc_id"]].add(x["annotator"])
    for r in M.precision(masks, anon_docs, mentions, docs, token_level=False).collect():
        b = sum(len(all_of[x["doc_id"]]) for x in k if x["anon_name"] == r["anon_name"])
        assert r["precision"] == pytest.approx(sum(v for key, v in want.items() if key[0] == r["anon_name"]) / b if b else 0)


def test_masked_texts_by_brute_force(corpus):
    docs, _, masks, anon_docs = corpus
    d, _, k, n = _seen(corpus)
    text = {r["doc_id"]: r["text"] for r in d}
    for r in M.masked_texts(docs, anon_docs, masks.where("start >= 0")).collect():
        own = sorted(tuple(x)[2:] for x in k if (x["anon_name"], x["doc_id"]) == (r["anon_name"], r["doc_id"]) and x["start"] >= 0)
        assert r["text"] == (None if text[r["doc_id"]] is None else _folded(text[r["doc_id"]], [x[1:] for x in own]))
    assert M.masked_texts(docs, anon_docs, masks).count() == len(n)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["covering_annotators", "mention_masked", "entity_masked", "apply_masking", "recall_token", "recall_mention", "recall_direct_only", "recall_per_type", "precision_token", "results_long", "results_pivot"])
def test_no_span_is_joined(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    of_names = plan.count("Join LeftOuter, (anon_name")  # sums of one row a name
    assert plan.count("Join ") == of_names and "Window" not in plan and "collect_list" not in plan
    assert Fixture(spark, DATA).rows.columns[-4:] == ["masks", "mentions", "ignorable", "anon_names"]
