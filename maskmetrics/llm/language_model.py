"""A hierarchical Pitman-Yor language model: seatings by Gibbs, scores from averaged predictive probabilities.

A text is its words, A-Z lower-cased, and one end. A token's context is the word before it (the end, at a text's start).
Words are told apart by 64 bits of a hash, contexts by 48 of them: of a hundred million contexts about 18 pairs are one. Each context has a restaurant whose parent is one restaurant of all words; that one's parent is uniform over
the V known words and one unknown. With counts c, tables t and sums over words n, T:

    P(w | u) = (c_uw - d t_uw + (theta + d T_u) P(w)) / (theta + n_u)
    P(w)     = (c_w - d0 t_w + (theta0 + d0 T0) / (V + 1)) / (theta0 + C0),   c_w = sum over u of t_uw

Seating: all that the probabilities need of a dish is its number of tables t, whose distribution given the others is
S_d(c, t) (theta + d T')(theta + d (T' + 1)) ... (theta + d (T' + t - 1)) P(w)^t, T' being the restaurant's other tables and S
the generalised Stirling numbers. Dishes of up to EXACT customers draw from it; larger ones take STEPS Metropolis steps, with
S by a short series or its saddle point, so that any number of customers takes the memory of one number. A dish of one
customer always has one table. All start with one table; then come `burn_in` + `samples` sweeps over the contexts' dishes and
then the parent's. In a sweep the dishes of a restaurant move at once, given T_u, C0, T0 and P(w) as the sweep before left
them, exact over the whole corpus. Texts are scored with the mean over the sampled seatings of P(w | u).

Scale: pairs of word and context are dealt out to blocks, by the word's hash, so a word's parent numbers are at home. A hot
word, of more than a quarter of a block's mean share, is dealt out by its contexts instead; there are fewer than 4 * blocks
of them, and their parent numbers are added up and seated by the driver. Pairs are counted by chunk of documents before they
are dealt, so a text that a third of all documents repeats weighs little. Only dishes of two customers or more are carried
from sweep to sweep. After each, a block sends by how much the tables of their contexts have changed to slices of the
contexts, which send the sums back; neither counts nor contexts nor the vocabulary are ever collected or broadcast. At the
end all documents' pairs are dealt out once for the sums of their contexts, and once with the documents that hold them; sums
by document come back. Random
numbers are hashes of word, context and sweep, so seating and scores are the same for any number of blocks and partitions (but
for the last bits, as sums of doubles are taken in another order), and wherever a block is worked out again.

Cases: a null or blank text is one token, its end. Repeated rows are scored each, and count each. Without training rows all
words are unknown and P is 1. A null held_out trains. Extra columns are left alone. A doc_id is a bigint, or text that holds one.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import drop_path, forget, materialised, partitions, small_batches

EXACT = 64
STEPS = 12
NEAR, TERMS = 1.5, 40
CHUNK_TOKENS = 3 << 19
CHUNK_DOCS = 60_000
DISCOUNT, STRENGTH = 0.8, 2.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
END = np.uint64(0x5BD1E9955BD1E995)
#: A context is a word's hash without its last 16 bits.
CONTEXT = np.uint64(16)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, row) of each token of each text."""
    hashes, _, _, first = W.words(data, offsets, W.BLANK_SEPARATED)
    n = np.diff(first)
    out = np.full(len(hashes) + len(n), END, np.uint64)
    row = np.repeat(np.arange(len(n), dtype=np.uint32), n + 1)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(n + 1) - 1] = False
    out[inside] = hashes
    return out, row


def _packed(*arrays: np.ndarray) -> bytes:
    return struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sQ", x.dtype.str[1:].encode(), x.nbytes) for x in arrays) + b"".join(x.tobytes() for x in arrays)


def _unpacked(raw) -> list[np.ndarray]:
    view = memoryview(raw)
    (n,) = struct.unpack_from("<I", view, 0)
    heads = [struct.unpack_from("<2sQ", view, 4 + 10 * i) for i in range(n)]
    at, out = 4 + 10 * n, []
    for kind, size in heads:
        out.append(np.frombuffer(bytes(view[at : at + size]), np.dtype(kind.decode())))
        at += size
    return out


def _six(x: np.ndarray) -> np.ndarray:
    """Numbers of 48 bits as bytes, six each."""
    return x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def _eight(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.ravel().view("<u8")


def _narrow(x: np.ndarray) -> np.ndarray:
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kinds = (np.uint8, np.uint16, np.uint32, np.uint64) if low >= 0 else (np.int8, np.int16, np.int32, np.int64)
    return x.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def _lookup(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted known, whether it is that key) of each key."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return near, known[near] == keys


def block_of(words: np.ndarray, contexts: np.ndarray, hot: np.ndarray, blocks: int) -> np.ndarray:
    """A pair's block: by its word, but for hot words by its context."""
    key = np.where(_lookup(hot, words)[1], W.mix(contexts + END), words) if len(hot) else words
    return ((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


class Chunk:
    """Documents whose tokens go out together."""

    def __init__(self):
        self.parts, self.ids, self.held, self.n = [], [], [], 0

    def add(self, ids, held, words, rows) -> None:
        self.parts.append((words, rows + len(self.ids)))
        self.ids += ids
        self.held += held
        self.n += len(words)

    def dealt(self, blocks: int, name: int, hot: np.ndarray, counted: bool):
        """The (word, context) pairs by block: with how often they stand in documents that train, or with the documents that hold them."""
        words, rows = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        known, word = np.unique(words, return_inverse=True)
        word = word.astype(np.int32)
        # a token's context is the token before it; a text's first follows the end of the text before
        context = np.empty_like(word)
        context[0], context[1:] = np.searchsorted(known, END), word[:-1]
        block = block_of(words, known[context] >> CONTEXT, hot, blocks).astype(np.uint32)
        del words
        bits, n = max(1, len(known).bit_length()), len(word)
        if 2 * bits + blocks.bit_length() <= 64:
            key = block.astype(np.uint64) << np.uint64(2 * bits) | word.astype(np.uint64) << np.uint64(bits) | context.astype(np.uint64)
            order = np.argsort(key)
        else:
            order = np.lexsort((context, word, block))
        word, context, block = word[order], context[order], block[order]
        new_word = np.ones(n, bool)
        new_word[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        new_type = new_word.copy()
        new_type[1:] |= context[1:] != context[:-1]
        ends = np.searchsorted(block, np.arange(blocks + 1))
        rows, held = rows[order], np.array(self.held, bool)
        out = [], []
        for b in range(blocks):
            x, y = int(ends[b]), int(ends[b + 1])
            if x == y:
                continue
            t, w = np.flatnonzero(new_type[x:y]), np.flatnonzero(new_word[x:y])
            per_type = np.diff(t, append=y - x)
            types = np.diff(np.searchsorted(t, w), append=len(t))
            pairs = known[word[x:y][w]], _narrow(types), _six(known[context[x:y][t]] >> CONTEXT)
            if counted:
                trains = np.concatenate(([0], np.cumsum(~held[rows[x:y]])))
                pairs = *pairs, _narrow(trains[np.append(t[1:], y - x)] - trains[t])
            else:
                pairs = *pairs, _narrow(per_type)
                docs, local = np.unique(rows[x:y], return_inverse=True)
                pairs = *pairs, _narrow(local), docs.astype(np.uint16), np.packbits(held[docs])
            out[0].append(b)
            out[1].append(_packed(*pairs))
        meta = [None] * len(out[0])
        if not counted:
            n_tokens = np.bincount(rows, minlength=len(self.ids)).astype(np.int64)
            meta[0] = _packed(np.array([-1 if i is None else i for i in self.ids], np.int64), np.array([i is None for i in self.ids], np.uint8), held.astype(np.uint8), n_tokens)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([name] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary()), pa.array(meta, pa.binary())], names=["block", "chunk", "pairs", "meta"])


def _pair(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return W.mix(words + contexts * np.uint64(0x9E3779B97F4A7C15))


class Block:
    """All pairs of one block, in the order of their hashes: the training counts, and which chunk's documents ask for them."""

    def __init__(self, pairs: list):
        words, contexts, counts, self.asked = [], [], [], []
        at = 0
        for raw in pairs:
            w, per_word, u, per_type, *rest = _unpacked(raw)
            u = _eight(u)
            words.append(np.repeat(w, per_word))
            contexts.append(u)
            if rest:
                local, docs, held = rest
                flags = np.unpackbits(held, count=len(docs)).astype(bool)
                of_type = np.repeat(np.arange(len(u), dtype=np.int32), per_type)
                counts.append(np.bincount(of_type[~flags[local]], minlength=len(u)))
                self.asked.append((of_type + np.int32(at), local, docs))
            else:
                counts.append(per_type)
            at += len(u)
        words, contexts = np.concatenate(words), np.concatenate(contexts)
        self.pair, first, back = np.unique(_pair(words, contexts), return_index=True, return_inverse=True)
        back = back.astype(np.int32)
        self.count = np.bincount(back, np.concatenate(counts), len(first)).astype(np.int64)
        self.words, self.word = np.unique(words[first], return_inverse=True)
        self.contexts, self.context = np.unique(contexts[first], return_inverse=True)
        self.asked = [(back[t], local, docs) for t, local, docs in self.asked]
        self.word_count = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)


def _uniform(key: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys and salts alone."""
    for x in salts:
        key = W.mix(key + np.uint64((x + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((W.mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series above 8."""
    x = np.asarray(x, np.float64)
    low = np.maximum(0, np.ceil(8 - x))
    out = np.zeros_like(x)
    for i in range(8):
        out -= np.where(i < low, np.log(np.maximum(x + i, 1e-300)), 0)
    x = x + low
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


@lru_cache
def _stirling(discount: float) -> np.ndarray:
    """log S_d(c, t) for c and t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, 0 : c + 1], out[c, 1 : c + 2] + np.log(np.maximum(c - discount * t, 0)))
    return out


@lru_cache
def _saddle(discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By log(c / t - 1): log f(x) - (c / t) log x and the log curvature at the saddle, f(x) = (1 - (1 - x)^d) / d."""
    y = np.concatenate((-np.expm1(-np.geomspace(1e-7, 1, 4000)), np.exp(-np.linspace(1, 160, 12_000))[1:]))
    y = np.sort(1 - y[:4000]).tolist() + y[4000:].tolist()
    y = np.sort(np.unique(np.array(y)))[::-1]
    x, power = 1 - y, y**discount
    r = x * discount * power / y / (1 - power)
    curvature = r * (1 + (1 - discount) * x / y - r)  # x dr/dx
    good = (r > 1 + 1e-9) & (curvature > 0)
    x, power, r, curvature = x[good], power[good], r[good], curvature[good]
    at = np.log(r - 1)
    order = np.argsort(at)
    return at[order], (np.log((1 - power) / discount) - r * np.log(x))[order], np.log(curvature)[order]


@lru_cache
def _series(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """log of |1 / Gamma(-d j)| and its sign, for j from 1."""
    j = [discount * i for i in range(1, TERMS + 1)]
    pole = [abs(x - round(x)) < 1e-9 for x in j]
    return np.array([-np.inf if q else -math.lgamma(-x) for x, q in zip(j, pole)]), np.array([0.0 if q else 1.0 if math.floor(-x) % 2 == 0 else -1.0 for x, q in zip(j, pole)])


class LargeDishes:
    """log S_d(c, t) of dishes with many customers each, at one t for each, 1 <= t <= c.

    An alternating sum while t is below NEAR c^d; the saddle point of the generating function beyond. What depends on c alone
    is worked out once.
    """

    def __init__(self, c: np.ndarray, discount: float):
        self.c, self.d = np.asarray(c, np.float64), discount
        self.scale = self.c**discount
        log, sign = _series(discount)
        top = _log_gamma(self.c - discount)
        self.first = top + log[0]
        self.terms = [
            sign[j - 1] * (-1) ** j * np.exp(_log_gamma(np.maximum(self.c - discount * j, 1e-9)) - top + log[j - 1] - log[0] + discount * (j - 1) * np.log(self.c)) if sign[j - 1] else None
            for j in range(1, TERMS + 1)
        ]
        self.whole = _log_gamma(self.c + 1)

    def log(self, t: np.ndarray) -> np.ndarray:
        t = np.asarray(t, np.float64)
        near = t <= NEAR * self.scale
        total, falling = self.terms[0].copy(), np.ones(len(t))
        for j in range(2, TERMS + 1):
            falling = falling * (t - j + 1) / (j * self.scale)  # 0 from j = t + 1 on
            if self.terms[j - 1] is not None:
                total += falling * self.terms[j - 1]
        fewer = _log_gamma(t + 1)
        out = self.first + np.log(t) + np.log(np.maximum(total, 1e-300)) - t * np.log(self.d) - fewer
        far = np.flatnonzero(~near)
        if len(far):
            at, value, curvature = _saddle(self.d)
            c, t = self.c[far], t[far]
            place = np.log(np.maximum(c / t - 1, 1e-300))
            by_saddle = self.whole[far] - fewer[far] + t * np.interp(place, at, value) - 0.5 * (np.log(2 * np.pi * t) + np.interp(place, at, curvature))
            out[far] = np.where(t < c, by_saddle, 0.0)  # t = c: S is 1
        return out


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    return LargeDishes(c, discount).log(t)


def seated(count: np.ndarray, tables: np.ndarray, strength: np.ndarray, p: np.ndarray, discount: float, key: np.ndarray, salt: int) -> np.ndarray:
    """New numbers of tables of dishes with that many customers. strength: theta + d times the restaurant's other tables."""
    out = np.minimum(count, 1)
    order = np.argsort(count, kind="stable")
    sizes = np.searchsorted(count[order], np.arange(2, EXACT + 2))
    small = _stirling(discount)
    for c in range(2, EXACT + 1):
        rows = (1 << 18) // c
        for a in range(sizes[c - 2], sizes[c - 1], rows):
            at = order[a : min(a + rows, sizes[c - 1])]
            log = np.cumsum(np.log((strength[at, None] + discount * np.arange(c)) * p[at, None]), 1) + small[c, 1 : c + 1]
            total = np.cumsum(np.exp(log - log.max(1, keepdims=True)), 1)
            out[at] = 1 + (total < _uniform(key[at], salt)[:, None] * total[:, -1:]).sum(1)
    for a in range(sizes[-1], len(order), 1 << 15):
        at = order[a : a + (1 << 15)]
        dishes = LargeDishes(count[at], discount)
        c, t, s, lp, k = count[at].astype(float), tables[at].astype(float), strength[at] / discount, np.log(p[at] * discount), key[at]
        weight = lambda t: dishes.log(t) + _log_gamma(s + t) + t * lp  # noqa: E731, B023
        low, high = np.ones(len(at)), c.copy()
        while (high > low).any():  # the mode
            middle = np.floor((low + high) / 2)
            up = weight(np.minimum(middle + 1, c)) > weight(middle)
            low, high = np.where(up & (high > low), middle + 1, low), np.where(up, high, middle)
        step = np.maximum(np.minimum(np.floor(np.sqrt(low) / 2), np.minimum(low - 1, c - low)), 1)
        bend = 2 * weight(low) - weight(np.minimum(low + step, c)) - weight(np.maximum(low - step, 1))
        width = np.clip(step / np.sqrt(np.maximum(bend, 1e-9)), 1, c)
        # steps are proposed about the mode, by a rounded Cauchy distribution
        dense = lambda t: np.log(np.arctan2(1 / width, 1 + ((t - low) ** 2 - 0.25) / width**2))  # noqa: E731, B023
        now = weight(t) - dense(t)
        for i in range(STEPS):
            to = np.rint(low + width * np.tan(np.pi * (_uniform(k, salt, i, 0) - 0.5)))
            inside = (to >= 1) & (to <= c)
            to = np.where(inside, to, t)
            then = weight(to) - dense(to)
            take = inside & (np.log(_uniform(k, salt, i, 1)) < then - now)
            t, now = np.where(take, to, t), np.where(take, then, now)
        out[at] = t.astype(np.int64)
    return out


@dataclass
class Root:
    """What all blocks are told after a sweep: sums over the corpus, and the hot words' own numbers in the parent."""

    v: float
    c0: float
    t0: float
    customers: np.ndarray
    tables: np.ndarray

    def p_word(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - ROOT_DISCOUNT * tables + (ROOT_STRENGTH + ROOT_DISCOUNT * self.t0) / (self.v + 1)) / (ROOT_STRENGTH + self.c0)

    def seated(self, words: np.ndarray, customers: np.ndarray, tables: np.ndarray, salt: int) -> np.ndarray:
        """New numbers of tables in the parent for words with that many customers there."""
        start = np.minimum(np.maximum(tables, 1), np.maximum(customers, 1))
        return seated(customers, start, ROOT_STRENGTH + ROOT_DISCOUNT * (self.t0 - tables), np.full(len(words), 1 / (self.v + 1)), ROOT_DISCOUNT, words, salt)


class Seating:
    """What of a block can change: its dishes of two customers or more, and its words' numbers in the parent.

    A dish of one customer has one table for good; `singles` counts a word's. A word with one such dish and no other is only
    counted in `alone`: its numbers in the parent are 1 and 1. total: T_u of the dishes' contexts; until the first sweep `at`
    says which of the block's contexts those are.
    """

    fields = ("words", "singles", "parent", "contexts", "total", "at", "word", "context", "count", "tables", "alone")

    @classmethod
    def of(cls, block: Block, hot: np.ndarray) -> tuple[Seating, np.ndarray]:
        """The first seating, a table a dish; and for each context of the block how many dishes it has here."""
        out = cls()
        many, single = block.count > 1, block.count == 1
        singles = np.bincount(block.word[single], minlength=len(block.words)).astype(np.int64)
        dishes = np.bincount(block.word[many], minlength=len(block.words))
        kept = (singles > 1) | (dishes > 0) | ((singles > 0) & _lookup(hot, block.words)[1])
        out.alone = np.array([((singles == 1) & ~kept).sum()], np.int64)
        out.words, out.singles = block.words[kept], singles[kept]
        out.word = (np.cumsum(kept) - 1)[block.word[many]]
        used = np.zeros(len(block.contexts), bool)
        used[block.context[many]] = True
        out.contexts, out.at, out.context = block.contexts[used], np.flatnonzero(used), (np.cumsum(used) - 1)[block.context[many]]
        out.count = block.count[many]
        out.tables, out.parent = np.ones(len(out.count), np.int64), np.ones(len(out.words), np.int64)
        out.total, out.samples = np.zeros(0, np.int64), []
        return out, np.bincount(block.context[block.count > 0], minlength=len(block.contexts)).astype(np.int64)

    @classmethod
    def read(cls, raw) -> Seating:
        out, parts = cls(), [x if x.dtype.itemsize == 8 else x.astype(np.int64) for x in _unpacked(raw)]
        for name, x in zip(cls.fields, parts):
            setattr(out, name, x)
        rest = parts[len(cls.fields) :]
        out.samples = [tuple(rest[i : i + 3]) for i in range(0, len(rest), 3)]
        return out

    def packed(self) -> bytes:
        every = [getattr(self, f) for f in self.fields] + [x for sample in self.samples for x in sample]
        return _packed(*(x if x.dtype == np.uint64 else _narrow(x) for x in every))

    def per_word(self, of_dish: np.ndarray) -> np.ndarray:
        return self.singles + np.bincount(self.word, of_dish, len(self.words)).astype(np.int64)

    def told(self, change: np.ndarray | None) -> None:
        """What the contexts' tables have changed by in all blocks; the first time, their number for all contexts of this block."""
        if change is not None:
            self.total = self.total + change if not len(self.at) else change[self.at]
        self.at = self.at[:0]

    def sweep(self, root: Root, hot: np.ndarray, salt: int) -> np.ndarray:
        """New tables of all dishes, then of the words in the parent; by how much each context's tables have changed here."""
        at, is_hot = _lookup(hot, self.words)
        customers, parent = self.per_word(self.tables), self.parent
        if is_hot.any():
            customers, parent = np.where(is_hot, root.customers[at], customers), np.where(is_hot, root.tables[at], parent)
        p = root.p_word(customers, parent)[self.word]
        before = self.tables
        self.tables = seated(self.count, before, STRENGTH + DISCOUNT * (self.total[self.context] - before), p, DISCOUNT, _pair(self.words[self.word], self.contexts[self.context]), salt)
        cold = np.flatnonzero(~is_hot)
        self.parent = self.parent.copy()
        self.parent[cold] = root.seated(self.words[cold], self.per_word(self.tables)[cold], self.parent[cold], salt)
        return np.bincount(self.context, self.tables - before, len(self.contexts)).astype(np.int64)

    def sampled(self) -> None:
        self.samples.append((self.tables, self.per_word(self.tables), self.parent))


def tables_of(block: Block, x: Seating | None, samples: int) -> list[np.ndarray]:
    """The tables of the block's pairs in each sampled seating."""
    single = np.minimum(block.count, 1)
    if x is None:
        return [single] * samples
    pair = _pair(x.words[x.word], x.contexts[x.context])
    order = np.argsort(pair)
    near, found = _lookup(pair[order], block.pair)
    return [np.where(found, tables[order[near]] if len(pair) else 0, single) for tables, _, _ in x.samples]


def predictive(block: Block, x: Seating | None, roots: list[Root], hot: np.ndarray, n_u: np.ndarray, t_u: list[np.ndarray]) -> np.ndarray:
    """P(w | u) of the block's pairs, the mean over the sampled seatings; n_u and t_u: the customers and tables of its contexts."""
    at, is_hot = _lookup(hot, block.words)
    near, known = _lookup(x.words if x is not None else hot[:0], block.words)
    seen = np.minimum(block.word_count, 1)
    out = np.zeros(len(block.pair))
    for s, (root, tables) in enumerate(zip(roots, tables_of(block, x, len(roots)))):
        customers = parent = seen
        if x is not None and len(x.words):
            customers, parent = (np.where(known, y[near], seen) for y in x.samples[s][1:])
        if len(hot):
            customers, parent = np.where(is_hot, root.customers[at], customers), np.where(is_hot, root.tables[at], parent)
        p = root.p_word(customers, parent)[block.word]
        out += (np.maximum(block.count - DISCOUNT * tables, 0) + (STRENGTH + DISCOUNT * t_u[s][block.context]) * p) / (STRENGTH + n_u[block.context])
    return out / len(roots)


def hot_words(texts: DataFrame, text: str, blocks: int) -> np.ndarray:
    """Words that make more than a quarter of a block's mean share of the tokens, sorted: fewer than 4 * blocks."""

    def run(batches):
        n = 0
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column(0)):
                found = tokens(data, offsets)[0]
                n += len(found)
                w, c = np.unique(found, return_counts=True)
                words, at = np.unique(np.concatenate((words, w)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, c))).astype(np.int64)
                # a word that has been rare so far is left out: only where its pairs are dealt depends on this
                often = counts * 32 * blocks > n
                words, counts = words[often], counts[often]
        often = counts * 4 * blocks > n
        yield pa.RecordBatch.from_arrays([pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()), pa.array([n, *counts[often].tolist()], pa.int64())], names=["word", "n"])

    found = texts.select(text).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = materialised(found, "hot")
    total = found.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = found.where(F.col("word").isNotNull() & (F.col("n") * 4 * blocks > F.lit(total))).select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def scored(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", burn_in: int = 3, samples: int = 3, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row; rows not held out train."""
    spark = docs.sparkSession
    blocks = partitions(spark)
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    hot = hot_words(training, "text", blocks)

    # a task for each core or each eight blocks, so that a sweep doesn't write many small files
    few = max(spark.sparkContext.defaultParallelism, -(-blocks // 8))

    def dealt(df: DataFrame, counted: bool) -> DataFrame:
        """Chunks' pairs by block; counted: without the documents."""

        def run(batches):
            chunk, made, part = Chunk(), 0, TaskContext.get().partitionId()
            for batch in batches:
                ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                for lo, hi, data, offsets in W.chunks(batch.column(1)):
                    for a in range(lo, hi, CHUNK_DOCS):
                        z = min(hi, a + CHUNK_DOCS)
                        x = offsets[a - lo : z - lo + 1]
                        if len(chunk.ids) + z - a > CHUNK_DOCS:
                            yield from chunk.dealt(blocks, part << 32 | made, hot, counted)
                            chunk, made = Chunk(), made + 1
                        chunk.add(ids[a:z], held[a:z], *tokens(data[x[0] : x[-1]], x - x[0]))
                        if chunk.n >= CHUNK_TOKENS:
                            yield from chunk.dealt(blocks, part << 32 | made, hot, counted)
                            chunk, made = Chunk(), made + 1
                pa.default_memory_pool().release_unused()
            if chunk.ids:
                yield from chunk.dealt(blocks, part << 32 | made, hot, counted)

        return df.mapInArrow(run, "block int, chunk bigint, pairs binary, meta binary")

    # fewer than the blocks, which each have a message for each of them
    slices = min(blocks, math.ceil(4 * math.sqrt(blocks)))
    edges = np.array([(i << 48) // slices for i in range(1, slices)], np.uint64)
    scalars = ("n", "v", "c0", "t0")
    shape = "block int, slice int, state binary, contexts binary, sums binary, n bigint, v bigint, c0 bigint, t0 bigint, hot array<bigint>"

    def message(block: int, contexts: np.ndarray, sums: list[np.ndarray]) -> pa.Table:
        """A block's sums by context, for each slice of the contexts that it has any of."""
        cuts = [0, *np.searchsorted(contexts, edges).tolist(), len(contexts)]
        of = [(i, a, z) for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
        return pa.table({
            "block": pa.array([block] * len(of), pa.int32()), "slice": pa.array([i for i, _, _ in of], pa.int32()),
            "contexts": pa.array([_packed(_six(contexts[a:z])) for _, a, z in of], pa.binary()), "sums": pa.array([_packed(*(_narrow(y[a:z]) for y in sums)) for _, a, z in of], pa.binary()),
        })

    def told(block: int, x: Seating, contexts: np.ndarray, change: np.ndarray) -> pa.Table:
        """A block's seating and its totals, and its changes for the slices."""
        at, is_hot = _lookup(hot, x.words)
        customers, tokens = x.per_word(x.tables), x.per_word(x.count)
        of_hot = np.zeros(2 * len(hot), np.int64)
        of_hot[at[is_hot]], of_hot[len(hot) + at[is_hot]] = customers[is_hot], tokens[is_hot]
        alone = x.alone[0]
        own = tokens.sum() + alone, (~is_hot).sum() + alone, customers.sum() + alone, x.parent[~is_hot].sum() + alone
        first = {"block": pa.array([block], pa.int32()), "slice": pa.array([-1], pa.int32()), "state": pa.array([x.packed()], pa.binary()), **{c: pa.array([int(y)], pa.int64()) for c, y in zip(scalars, own)}, "hot": pa.array([of_hot.tolist()], pa.list_(pa.int64()))}
        names = [c.split(" ")[0] for c in shape.split(", ")]
        return pa.concat_tables([pa.table(first), message(block, contexts, [change])], promote_options="default").select(names)

    def added(table: pa.Table) -> pa.Table:
        """The sums over all blocks, for each block those of its contexts."""
        contexts = [_eight(_unpacked(x.as_buffer())[0]) for x in table["contexts"]]
        sums = [np.concatenate(x) for x in zip(*(_unpacked(x.as_buffer()) for x in table["sums"]))]
        known, at = np.unique(np.concatenate(contexts), return_inverse=True)
        ends = np.cumsum([len(x) for x in contexts])[:-1]
        sums = [np.bincount(at, x, len(known)).astype(np.int64) for x in sums]
        return pa.table({"block": table["block"], "slice": table["slice"], "sums": pa.array([_packed(*(_narrow(y[i]) for y in sums)) for i in np.split(at, ends)], pa.binary())})

    def everywhere(messages: DataFrame) -> DataFrame:
        return messages.select("block", "slice", "contexts", "sums").groupBy("slice").applyInArrow(added, "block int, slice int, sums binary")

    def summed(sums: pa.Table) -> list[np.ndarray] | None:
        parts = [_unpacked(x.as_buffer()) for i, x in sorted(zip(sums["slice"].to_pylist(), sums["sums"]), key=lambda x: x[0]) if i >= 0]
        return [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else None

    paths: list[str] = []

    def written(seatings: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame, dict, np.ndarray, np.ndarray]:
        """(seatings, sums for each block, totals, hot words' customers and tokens) after a sweep."""
        found = materialised(seatings().coalesce(few), "seating", paths)
        for old in paths[:-1]:
            drop_path(spark, old)
        del paths[:-1]
        forget(spark)
        own = found.where("slice < 0")
        totals = own.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in scalars)).first().asDict()
        of_hot = np.zeros(2 * len(hot), np.int64)
        for r in own.select(F.posexplode("hot")).groupBy("pos").agg(F.sum("col").alias("n")).collect() if len(hot) else ():
            of_hot[r["pos"]] = r["n"]
        return own.select("block", "state"), everywhere(found.where("slice >= 0")), totals, of_hot[: len(hot)], of_hot[len(hot) :]

    def first(table: pa.Table) -> pa.Table:
        block = Block([x.as_buffer() for x in table["pairs"]])
        x, dishes = Seating.of(block, hot)
        return told(table["block"][0].as_py(), x, block.contexts, dishes)

    def sweep(i: int, root: Root):
        def run(own: pa.Table, sums: pa.Table) -> pa.Table:
            x = Seating.read(own["state"][0].as_buffer())
            change = summed(sums)
            x.told(None if change is None else change[0])
            change = x.sweep(root, hot, seed * 1000 + i)
            if i >= burn_in:
                x.sampled()
            return told(own["block"][0].as_py(), x, x.contexts, change)

        return run

    state, sums, totals, hot_customers, hot_tokens = written(lambda: dealt(training, True).groupBy("block").applyInArrow(first, shape))
    n, v = totals["n"], float(totals["v"] + (hot_tokens > 0).sum())
    hot_tables = np.minimum(hot_customers, 1)
    root = Root(v, float(totals["c0"]), float(totals["t0"] + hot_tables.sum()), hot_customers, hot_tables)
    roots = []
    for i in range(burn_in + samples):
        if n:
            state, sums, totals, hot_customers, _ = written(lambda: state.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(sweep(i, root), shape))  # noqa: B023
            hot_tables = root.seated(hot, hot_customers, root.tables, seed * 1000 + i)
            root = Root(v, float(totals["c0"]), float(totals["t0"] + hot_tables.sum()), hot_customers, hot_tables)
        if i >= burn_in:
            roots.append(root)

    def own_seating(raw: list) -> Seating | None:
        return Seating.read(raw[0]) if raw else None

    def contexts_asked(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return message(0, np.zeros(0, np.uint64), [])
        block = Block([x.as_buffer() for x in asked["pairs"]])
        per_context = lambda y: np.bincount(block.context, y, len(block.contexts)).astype(np.int64)
        tables = tables_of(block, own_seating([x.as_buffer() for x in own["state"]]), samples)
        return message(asked["block"][0].as_py(), block.contexts, [per_context(block.count), *map(per_context, tables)])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            block = Block([x.as_buffer() for x in asked["pairs"]])
            x = own_seating([x.as_buffer() for i, x in zip(own["slice"].to_pylist(), own["sums"]) if i < 0])
            n_u, *t_u = summed(own)
            score = np.log10(predictive(block, x, roots, hot, n_u, t_u))
            at, is_hot = _lookup(hot, block.words)
            count = np.where(is_hot, hot_tokens[at], block.word_count) if len(hot) else block.word_count
            base, known = np.log10((count + 1.0) / (n + v + 1.0))[block.word], (count > 0)[block.word]
            for token_type, local, rows in block.asked:
                m = len(rows)
                out.append(_packed(rows, np.bincount(local, base[token_type], m), np.bincount(local, score[token_type], m), _narrow(np.bincount(local, known[token_type], m).astype(np.int64))))
        return pa.table({"chunk": asked["chunk"], "sums": pa.array(out, pa.binary()), "meta": asked["meta"]})

    # in two jobs, so that the shuffles of the one are gone when the other begins
    contexts = dealt(rows, True).groupBy("block").cogroup(state.groupBy("block")).applyInArrow(contexts_asked, "block int, slice int, contexts binary, sums binary")
    known = materialised(everywhere(contexts).coalesce(few), "contexts")
    del contexts
    forget(spark, 2)
    answers = dealt(rows, False).groupBy("block").cogroup(known.union(state.select("block", F.lit(-1), "state")).groupBy("block")).applyInArrow(answer, "chunk bigint, sums binary, meta binary")

    def documents(table: pa.Table) -> pa.Table:
        ids, null, held, n_tokens = next(_unpacked(x.as_buffer()) for x in table["meta"] if x.is_valid)
        base, score, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for x in sorted(table["sums"].to_pylist()):  # in one order, as sums of doubles depend on it
            of, b, s, k = _unpacked(x)
            base[of] += b
            score[of] += s
            known[of] += k
        return pa.table({
            "doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": n_tokens, "n_known": known,
            "train_tokens": np.full(len(ids), n, np.int64), "base_score": base, "score": score,
        })

    return answers.groupBy("chunk").applyInArrow(documents, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity by token of the held-out rows and of the others, under the model and under the base."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"), F.sum("n_tokens").alias("n_tokens"))
