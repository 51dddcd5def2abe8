"""What a batch of texts gives goes out in pieces, whatever the batch holds."""

import pyarrow as pa
import pytest

from maskmetrics.functions import parser
from maskmetrics.functions import text as T


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(T, "SLICE", 1 << 16)


def _batches(n: int) -> pa.Array:
    return pa.array([None, "", "the red Fox saw 3 dogs. " * 200] * n)


@pytest.mark.parametrize("found", [T.word_spans, T.term_texts, parser.entity_spans, parser.token_spans], ids=["words", "terms", "entities", "tokens"])
def test_pieces_are_bounded_and_whole(found):
    texts = _batches(60)
    pieces = list(found.func(iter([texts])))
    assert len(pieces) > 1 and max(len(p) for p in pieces) <= 3 * (T.SLICE // 4800 + 2)
    one_by_one = [p.to_pylist()[0] for t in texts[:6] for p in found.func(iter([pa.array([t], pa.string())]))]
    assert sum((p.to_pylist() for p in pieces), [])[:6] == one_by_one and sum(map(len, pieces)) == len(texts)


def test_slices_within_texts():
    texts = _batches(60)
    starts, ends = (pa.array([[a]] * len(texts), pa.list_(pa.int32())) for a in (4, 11))
    pieces = list(T.words_within.func(iter([(texts, starts, ends)])))
    words = [[p["text"] for p in row] for piece in pieces for row in piece.to_pylist()]
    assert len(pieces) > 1 and words == [[], [], ["red", "Fox"]] * 60


def test_a_row_larger_than_a_slice_is_whole():
    assert [len(x) for (x,) in T.in_slices(pa.array(["a" * 3 * T.SLICE, "b", None]))] == [1, 2] and list(T.in_slices(pa.array([], pa.string()))) == []
