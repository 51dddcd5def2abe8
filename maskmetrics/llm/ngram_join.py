"""Exact n-gram Jaccard join with prefix trees, and the classes that its links make.

A document's set is its distinct word n-grams, as 64-bit hashes, in one global order: n-grams that are frequent in some
part of the corpus last, the others by hash. Two sets of Jaccard similarity t or more share an n-gram among the first
n - ceil(t n) + 1 of either (prefix filter), so those alone are dealt out over the cluster:

1. a scan hashes each text's set: its size and a 128-bit key of the set. Equal sets are one node from here on. The scan
   also names the n-grams that stand in more than `frequent` of some chunk's documents; the MAX_LAST of them that are named
   for the most documents move to the order's end. Any order gives the same links, so that bound changes only the work.
2. prefixes go, packed by chunk, to the blocks of the hash space. Where an n-gram is shared, its sharers of like sizes, for
   whom it can be the first shared one, are put into the group of the smallest key among them (its pivot). Two sets that share a prefix n-gram meet in a group at least once.
   Groups are lists of members, never lists of pairs: rows grow with the members.
3. within a group, the parities of the n-grams' numbers by residue of their hashes (a bit for each n-gram, about) bound from
   below in how many n-grams two sets differ. Members that no other can be linked with leave; the rest falls into parts.
   A group of more than `block` members is split into blocks first, with the pivot in each. When the classes of these links
   are known, those of a large group that aren't of its most numerous class meet all its members, block by block: two of
   that class need no link any more. So a third of all documents as near copies of one text costs about its members.
   The sets of what is left are fetched (one text for each distinct set), and each part is joined in a prefix tree.
4. in the tree, a set walks down from the root, counting its overlap with a shared path once for all sets below. A subtree
   is left when the overlap so far plus what can remain, bounded by the remaining lengths, is too small for every size in
   it, or when all its sets are already in the walker's class. So a group of m near copies costs about m steps, not m^2,
   and gives m - 1 links. Links between different classes are never dropped.
5. components of the links, by rounds of stars. A node's name begins with the smallest doc_id of its set, so
   the least name that links reach says the component, and nothing is joined by component.

Nothing of this is collected but those MAX_LAST n-grams. Cases: a null or blank text has the empty set, no link, and itself
as component. A row without a doc_id takes no part and has no component. Repeated rows and equal texts are one node. Where a
doc_id repeats with different texts, each of its sets is a node. A doc_id is a bigint, or text that holds one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import components, drop_path, materialised, partitions, per_batch, small_batches, split_by

NGRAM = 5
SIMILARITY = (75, 100)
FREQUENT = 1 / 500
BLOCK = 1024
MAX_LAST = 1 << 18
_SIGN = -(1 << 63)
_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that stand for each set."""
    out = np.zeros(len(sets), _KEY)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        a = np.add.reduceat(W.mix(flat ^ np.uint64(0xD6E8FEB86659FD93)), at)
        b = np.add.reduceat(W.mix(flat * np.uint64(0xA0761D6478BD642F)), at)
        out["a"][full] = W.mix(a ^ sizes[full].astype(np.uint64))
        out["b"][full] = W.mix(b + sizes[full].astype(np.uint64))
    return out


def key_bytes(keys: np.ndarray) -> list[bytes]:
    raw = keys.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def needed(n: int, m: int, similarity: tuple[int, int]) -> int:
    """The smallest overlap with which sets of n and m reach the similarity."""
    p, q = similarity
    return -(-p * (n + m) // (p + q))


def ordered(s: np.ndarray, frequent: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: frequent (n-gram -> rank, as two arrays in one) last."""
    if not len(frequent):
        return s
    hit = bits[(s & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(hit)
    if not len(at):
        return s
    near = np.minimum(np.searchsorted(frequent, s[at]), len(frequent) - 1)
    hit[at] = frequent[near] == s[at]
    return np.concatenate((s[~hit], s[hit]))


def _bits(frequent: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[(frequent & np.uint64(0xFFFF)).astype(np.int64)] = True
    return out


def prefix(s: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    p, q = similarity
    return s[: len(s) - -(-p * len(s) // q) + 1] if len(s) else s


def n_parities(n: int) -> int:
    return 1 << min(16, max(6, int(n - 1).bit_length()))


def parities(s: np.ndarray) -> bytes:
    """For each residue of the n-grams' hashes the parity of their number.

    Two sets differ in at least as many n-grams as their parities differ; residues modulo half as many are sums of these.
    """
    b = n_parities(len(s))
    return np.packbits(np.bincount((W.mix(s) & np.uint64(b - 1)).astype(np.int64), minlength=b).astype(np.uint8) & 1, bitorder="little").tobytes()


def possible(sizes: np.ndarray, bits: list[bytes], similarity: tuple[int, int]) -> np.ndarray:
    """A label for each set: sets that could be linked, by their sizes and parities, share one. Exact: no link crosses labels."""
    p, q = similarity
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    label = np.arange(len(n))
    width = np.array([len(bits[i]) for i in order])
    # sets of one width are neighbours, as widths grow with sizes
    begins = {int(w): int(np.searchsorted(width, w)) for w in np.unique(width)}
    rows = {w: np.frombuffer(b"".join(bits[i] for i in order[a : int(np.searchsorted(width, w, "right"))]), np.uint64).reshape(-1, w // 8) for w, a in begins.items()}
    for x in range(1, len(n)):
        lo = int(np.searchsorted(n, -(-p * int(n[x]) // q)))
        if lo >= x or (label[lo:x] == label[x]).all():
            continue
        w = int(width[x])
        mine = rows[w][x - begins[w]]
        while True:
            a, b = max(lo, begins.get(w, x)), min(x, begins.get(w, x) + len(rows.get(w, ())))
            if a < b:
                apart = np.bitwise_count(rows[w][a - begins[w] : b - begins[w]] ^ mine).sum(1)
                least = -(-p * (n[a:b] + n[x]) // (p + q))
                for other in np.unique(label[a:b][apart <= n[a:b] + n[x] - 2 * least]):
                    if other != label[x]:
                        label[label == other] = label[x]
            if a == lo or w <= 8:
                break
            w //= 2
            mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
    out = np.empty(len(n), np.int64)
    out[order] = label
    return out


class PrefixTree:
    """Sets, in one order of their elements, as a tree with compressed paths: a node's path is a slice of its first set.

    elements are ranks 0.. of a common order, rarest first; sets are sorted tuples of them.
    """

    def __init__(self, sets: list[np.ndarray], universe: int):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.universe = universe
        shared = [0]
        for x, y in zip(self.sets, self.sets[1:]):
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            shared.append(int(differ[0]) if len(differ) else n)
        shared.append(0)
        # a node: (first set, end set, depth where its path begins, depth where it ends, children)
        self.lo, self.hi, self.top, self.bottom, self.children = [], [], [], [], []
        self.root = self._build(shared)
        self.smallest = np.array([self.sizes[a:b].min() for a, b in zip(self.lo, self.hi)])
        self.largest = np.array([self.sizes[a:b].max() for a, b in zip(self.lo, self.hi)])

    def _node(self, lo, hi, top, bottom, children) -> int:
        for store, x in zip((self.lo, self.hi, self.top, self.bottom, self.children), (lo, hi, top, bottom, children)):
            store.append(x)
        return len(self.lo) - 1

    def _build(self, shared: list[int]) -> int:
        """The tree of the sorted sets' common prefix lengths, with one pass and a stack, as for a suffix tree."""
        stack: list[list] = [[0, 0, []]]  # depth of a branching, its first set, its children (node ids yet without a top)
        for i in range(len(self.sets)):
            first, last = i, self._node(i, i + 1, 0, len(self.sets[i]), [])
            nxt = shared[i + 1]
            while stack[-1][0] > nxt:
                d, f, kids = stack.pop()
                kids.append(last)
                last = self._node(f, i + 1, 0, d, kids)
                first = f
            if stack[-1][0] < nxt:
                stack.append([nxt, first, [last]])
            else:
                stack[-1][2].append(last)
        root = self._node(0, len(self.sets), 0, 0, stack[0][2])
        for parent in range(len(self.lo)):
            for child in self.children[parent]:
                self.top[child] = self.bottom[parent]
        return root

    def links(self, similarity: tuple[int, int], joined: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links (positions in the given list) that make the classes of all links; joined: classes known beforehand."""
        p, q = similarity
        m = len(self.sets)
        label = np.arange(m) if joined is None else joined[self.order].copy()
        mark = np.zeros(self.universe + 1, bool)
        found: list[tuple[int, int]] = []
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        for x in np.argsort(-self.sizes, kind="stable").tolist():
            if change[-1] == 0:
                break
            mine, n = self.sets[x], len(self.sets[x])
            if not n:
                continue
            mark[mine] = True
            stack = [(self.root, 0)]
            while stack:
                node, overlap = stack.pop()
                lo, hi = self.lo[node], self.hi[node]
                if change[hi - 1] == change[lo] and label[lo] == label[x]:
                    continue
                small, large = int(self.smallest[node]), int(self.largest[node])
                if 100 * min(n, large) * q < 100 * p * max(n, small):
                    continue
                least = -(-p * (n + max(small, -(-p * n // q))) // (p + q))
                top, bottom = self.top[node], self.bottom[node]
                if bottom > top:
                    path = self.sets[lo]
                    # the path in two steps: what its first part leaves possible is looked at first
                    step = min(bottom, top + max(1, (large - least) + overlap + 1))
                    overlap += int(np.count_nonzero(mark[path[top:step]]))
                    if overlap + large - step < least:
                        continue
                    if step < bottom:
                        overlap += int(np.count_nonzero(mark[path[step:bottom]]))
                    left = n - int(np.searchsorted(mine, path[bottom - 1], "right"))
                    if overlap + min(left, large - bottom) < least:
                        continue
                if not self.children[node]:
                    # sets end here: lo : hi is one set
                    if lo != x and (p + q) * overlap >= p * (n + int(self.sizes[lo])) and label[lo] != label[x]:
                        found.append((self.order[x], self.order[lo]))
                        label[label == label[lo]] = label[x]
                        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
                else:
                    stack.extend((c, overlap) for c in self.children[node])
            mark[mine] = False
        return found


def join_group(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that make the classes of all pairs of sets (of hashes) with the similarity, beside the classes known; equal sets must not repeat."""
    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    known, rank, count = np.unique(flat, return_inverse=True, return_counts=True)
    by_frequency = np.empty(len(known), np.int32)
    by_frequency[np.argsort(count, kind="stable")] = np.arange(len(known), dtype=np.int32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    ranks = by_frequency[rank]
    return PrefixTree([np.sort(ranks[a:b]) for a, b in zip(at[:-1], at[1:])], len(known)).links(similarity, joined)


_NODE = np.dtype([("key", _KEY), ("n", "<u4")])


def _short(x: np.ndarray) -> bytes:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32).tobytes()


def _long(raw: pa.Scalar, n: int) -> np.ndarray:
    raw = raw.as_buffer()
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)


def pivots(grams: np.ndarray, owners: np.ndarray, places: np.ndarray, keys: np.ndarray, sizes: np.ndarray, similarity: tuple[int, int], near: int = 64) -> pa.Table:
    """(pivot, key) from prefix entries: an n-gram, its owner (an index in keys and sizes) and its place in the owner's order.

    Of an n-gram's owners, in the order of size, those stay who have a partner for whom it can be the first shared n-gram:
    of a size in reach, and with enough n-grams left in both. Among more than `near` owners, those without a partner among
    the `near` next stay too. Where sizes leave a gap out of reach, a new group begins.
    """
    p, q = similarity
    order = np.lexsort((owners, sizes[owners], grams))
    grams, owners, places = grams[order], owners[order], places[order]
    again = np.zeros(len(grams), bool)  # the same set out of another chunk
    again[1:] = (grams[1:] == grams[:-1]) & (owners[1:] == owners[:-1])
    grams, owners, places = grams[~again], owners[~again], places[~again]
    # only n-grams with several owners
    several = np.zeros(len(grams), bool)
    same = grams[1:] == grams[:-1]
    several[1:] |= same
    several[:-1] |= same
    grams, owners, places = grams[several], owners[several], places[several]
    n = sizes[owners]
    live = np.zeros(len(grams), bool)
    for o in range(1, near + 1):
        at = np.flatnonzero(grams[o:] == grams[:-o])
        if not len(at):
            break
        small, large = n[at], n[at + o]
        least = -(-p * (small + large) // (p + q))
        fits = (q * small >= p * large) & (np.minimum(small - places[at], large - places[at + o]) >= least)
        live[at[fits]] = True
        live[at[fits] + o] = True
    else:
        far = np.flatnonzero(grams[near + 1 :] == grams[: -near - 1])
        live[far] = True
        live[far + near + 1] = True
    grams, owners, n = grams[live], owners[live], n[live]
    if not len(grams):
        return pa.table({"pivot": pa.array([], pa.binary()), "key": pa.array([], pa.binary())})
    begins = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (q * n[:-1] < p * n[1:]))))
    least = np.minimum.reduceat(owners, begins)
    size = np.diff(np.concatenate((begins, [len(grams)])))
    shared = np.repeat(size > 1, size)
    pairs = np.unique(np.repeat(least, size)[shared] * len(keys) + owners[shared])
    return pa.table({"pivot": pa.array(key_bytes(keys[pairs // len(keys)]), pa.binary()), "key": pa.array(key_bytes(keys[pairs % len(keys)]), pa.binary())})


def _texts(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def document_sets(docs: DataFrame, ngram: int = NGRAM, frequent: float = FREQUENT) -> DataFrame:
    """(doc_id, text_id, n, key, bits) of each document, and rows (null, null, count, n-gram) of the n-grams frequent in a chunk of them.

    docs: doc_id, text, text_id.
    """

    def run(batch: pa.RecordBatch):
        ids, column, text_ids = (batch.column(i) for i in range(3))
        for lo, hi, data, offsets in W.chunks(column, 4 << 20):
            hashes, _, _, first = W.words(data, offsets, W.BLANK_SEPARATED)
            sets = W.shingles(hashes, first, ngram)
            keys = set_keys(sets)
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(["d"] * len(n)), ids.slice(lo, hi - lo), text_ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(key_bytes(keys), pa.binary()), pa.array([parities(x) for x in sets], pa.binary())], names=["kind", "doc_id", "text_id", "n", "key", "bits"])
            distinct = np.unique(keys, return_index=True)[1]
            flat = np.sort(np.concatenate([sets[i] for i in distinct]))
            if len(flat):
                begins = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
                count = np.diff(np.concatenate((begins, [len(flat)])))
                often = count > max(8, frequent * len(distinct))
                found = flat[begins[often]]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(["f"] * len(found)), *[pa.nulls(len(found), pa.int64())] * 2, pa.array(count[often], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.nulls(len(found), pa.binary())], names=["kind", "doc_id", "text_id", "n", "key", "bits"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(per_batch(run), "kind string, doc_id bigint, text_id bigint, n bigint, key binary, bits binary")


def _ranked(rows: DataFrame) -> np.ndarray:
    """The n-grams that go last, sorted: at most MAX_LAST."""
    found = rows.where("kind = 'f'").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(MAX_LAST).select("key").toPandas()["key"]
    return np.sort(np.frombuffer(b"".join(bytes(x) for x in found), np.uint64))


def groups(docs: DataFrame, frequent: np.ndarray, blocks: int, ngram: int = NGRAM, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(pivot, key): each set's key with the smallest key it shares a prefix n-gram with; pivots are members too."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(frequent)
    width = np.uint64(-(-(1 << 64) // blocks))

    def deal(batch: pa.RecordBatch):
        bits = _bits(held.value)
        for lo, hi, data, offsets in W.chunks(batch.column(0), 4 << 20):
            hashes, _, _, first = W.words(data, offsets, W.BLANK_SEPARATED)
            sets = W.shingles(hashes, first, ngram)
            keys = set_keys(sets)
            distinct = np.unique(keys, return_index=True)[1]
            distinct = [int(i) for i in distinct if len(sets[i])]
            if not distinct:
                continue
            parts = [prefix(ordered(sets[i], held.value, bits), similarity) for i in distinct]
            flat = np.concatenate(parts)
            sizes = [len(x) for x in parts]
            owner = np.repeat(np.arange(len(parts), dtype=np.uint32), sizes)
            place = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
            order = np.argsort(flat, kind="stable")
            flat, owner, place = flat[order], owner[order], place[order]
            table = np.zeros(len(distinct), _NODE)
            table["key"], table["n"] = keys[distinct], [len(sets[i]) for i in distinct]
            to = (flat // width).astype(np.int64)
            ends = np.searchsorted(to, np.arange(blocks + 1))
            out = [], [], [], [], []
            for b in range(blocks):
                x, y = int(ends[b]), int(ends[b + 1])
                if x < y:
                    used, local = np.unique(owner[x:y], return_inverse=True)
                    for store, value in zip(out, (b, flat[x:y].tobytes(), _short(local), _short(place[x:y]), table[used].tobytes())):
                        store.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["block", "grams", "owners", "places", "nodes"])

    def gather(table: pa.Table) -> pa.Table:
        grams, owners, places, nodes, base = [], [], [], [], 0
        for g, o, at, k in zip(*(table[c] for c in ("grams", "owners", "places", "nodes"))):
            grams.append(np.frombuffer(g.as_buffer(), np.uint64))
            owners.append(_long(o, len(grams[-1])) + base)
            places.append(_long(at, len(grams[-1])))
            nodes.append(np.frombuffer(k.as_buffer(), _NODE))
            base += len(nodes[-1])
        every = np.concatenate(nodes)
        known, first, back = np.unique(every["key"], return_index=True, return_inverse=True)
        return pivots(np.concatenate(grams), back[np.concatenate(owners)], np.concatenate(places), known, every["n"][first].astype(np.int64), similarity)

    dealt = docs.select("text").mapInArrow(per_batch(deal), "block int, grams binary, owners binary, places binary, nodes binary")
    return dealt.groupBy("block").applyInArrow(gather, "pivot binary, key binary").distinct()


def _joined(docs: DataFrame, dealt: DataFrame, ngram: int, similarity: tuple[int, int], paths: list[str]) -> DataFrame:
    """(a, b): links between the nodes in each (pivot, i, j) of dealt that are of different classes, enough to make all their classes.

    dealt: pivot, i, j, key, node, doc_id, n, bits, class (what is known of the member's class; its node, if nothing).
    """

    def could_link(table: pa.Table) -> pa.Table:
        keys, known = table["key"].to_pylist(), table["class"].to_pylist()
        label = possible(table["n"].to_numpy(), table["bits"].to_pylist(), similarity).tolist()
        least: dict[int, bytes] = {}
        several: dict[int, set] = {}
        for k, c, l in zip(keys, known, label):
            least[l] = min(k, least.get(l, k))
            several.setdefault(l, set()).add(c)
        at = [i for i, l in enumerate(label) if len(several[l]) > 1]
        return pa.table({"pivot": pa.array([least[label[i]] for i in at], pa.binary()), **{c: table[c].take(pa.array(at, pa.int64())) for c in ("i", "j", "key", "node", "doc_id", "class")}})

    # dealt by block, even where a join has dealt by pivot before: that would do for groupBy, with all blocks in one task
    left = dealt.repartition("pivot", "i", "j").groupBy("pivot", "i", "j").applyInArrow(could_link, "pivot binary, i int, j int, key binary, node string, doc_id bigint, class string").distinct()
    wanted = left.groupBy("doc_id", "key", "node", "class").agg(F.collect_list(F.struct("pivot", "i", "j")).alias("groups")).withColumnRenamed("key", "wanted")
    wanted = materialised(wanted, "wanted", paths)
    texts = docs.select("doc_id", "text")
    texts, _ = split_by(texts, texts["doc_id"], wanted, wanted["doc_id"])
    kinds = {"pivot": pa.binary(), "i": pa.int32(), "j": pa.int32(), "node": pa.string(), "class": pa.string(), "grams": pa.binary()}

    def members(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds.values())], names=[*kinds])

    def fetch(batch: pa.RecordBatch):
        want, node, known, where = (_texts(batch, name).to_pylist() for name in ("wanted", "node", "class", "groups"))
        for lo, hi, data, offsets in W.chunks(_texts(batch, "text"), 4 << 20):
            hashes, _, _, first = W.words(data, offsets, W.BLANK_SEPARATED)
            sets = W.shingles(hashes, first, ngram)
            out, size = [], 0
            for i, (s, key) in enumerate(zip(sets, key_bytes(set_keys(sets))), lo):
                if key != want[i]:
                    continue
                packed = s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()  # 48 bits of each: apart within any two sets
                for g in where[i]:
                    out.append((*g.values(), node[i], known[i], packed))
                    size += len(packed)
                    if size > 8 << 20:
                        yield members(out)
                        out, size = [], 0
            if out:
                yield members(out)

    def join(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_pylist()
        first = {k: i for i, k in reversed([*enumerate(nodes)])}  # repeated rows of a doc_id
        at = sorted(first.values())
        sets = []
        for i in at:
            packed = np.frombuffer(table["grams"][i].as_buffer(), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(packed), 8), np.uint8)
            wide[:, 2:] = packed
            sets.append(wide.reshape(-1).view(np.uint64))
        number: dict[bytes, int] = {}
        known = np.array([number.setdefault(table["class"][i].as_py(), len(number)) for i in at], np.int64)
        found = join_group(sets, similarity, known)
        return pa.table({"a": pa.array([nodes[at[x]] for x, _ in found], pa.string()), "b": pa.array([nodes[at[y]] for _, y in found], pa.string())})

    fetched = texts.join(wanted, "doc_id").select("text", "wanted", "node", "class", "groups").mapInArrow(per_batch(fetch), "pivot binary, i int, j int, node string, class string, grams binary")
    return fetched.groupBy("pivot", "i", "j").applyInArrow(join, "a string, b string")


def _every(column: str):
    return F.sequence(F.lit(0), F.col(column) - 1)


def _node(doc_id: str, key: str):
    """The name of a set with that doc_id: in the order of doc_ids, negative ones first."""
    return F.concat(F.lpad(F.hex(F.col(doc_id).bitwiseXOR(F.lit(_SIGN))), 16, "0"), F.hex(key))


def _doc_id(node: str):
    return F.conv(F.substring(node, 1, 16), 16, -10).cast("bigint").bitwiseXOR(F.lit(_SIGN))


def linked(docs: DataFrame, rows: DataFrame, ngram: int = NGRAM, similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(key, component): each set that isn't empty, with the least node that links reach, its own included. docs: doc_id, text."""
    spark = docs.sparkSession
    done: list[str] = []
    nodes = rows.where("kind = 'd' AND doc_id IS NOT NULL AND n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = materialised(nodes.withColumn("node", _node("doc_id", "key")), "nodes")
    members = materialised(groups(docs, _ranked(rows), 4 * partitions(spark), ngram, similarity), "members", done)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    dealt = lambda df: df.withColumn("to", F.explode("to")).select("pivot", "to.i", "to.j", "key", "node", "doc_id", "n", "bits", "class")
    # first, members meet in their own block, and the pivot in all blocks
    # (written, so that its size is known and Spark broadcasts it only below its threshold)
    sizes = materialised(members.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts")).where("parts > 1"), "sizes", done)
    own = lambda parts, name: F.pmod(F.xxhash64("key", F.lit(name)), F.col(parts)).cast("int")
    placed = members.join(nodes, "key").join(sizes, "pivot", "left").fillna(1, ["parts"]).withColumn("class", F.col("node"))
    alone = F.transform(F.when(F.col("key") == F.col("pivot"), _every("parts")).otherwise(F.array(own("parts", "member"))), lambda i: pair(i, i))
    first = materialised(_joined(docs, dealt(placed.withColumn("to", alone)), ngram, similarity, done), "links", done)
    found = materialised(components(first), "classes")
    if not sizes.isEmpty():
        # then those of a large group that aren't of its most numerous class meet all its members; two of that class need not meet
        large = members.join(sizes, "pivot").join(nodes, "key").join(found, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
        large = materialised(large, "large", done)
        counted = large.groupBy("pivot", "class").count()
        most = counted.groupBy("pivot").agg(F.max_by("class", F.struct("count", "class")).alias("most"), F.sum("count").alias("all"), F.max("count").alias("in_most"))
        most = materialised(most.where("all > in_most").select("pivot", "most", F.ceil((F.col("all") - F.col("in_most")) / F.lit(block)).cast("int").alias("rest")), "most", done)
        open_groups = large.join(most, "pivot")
        as_member = F.transform(_every("rest"), lambda i: pair(i, own("parts", "member")))
        as_other = F.transform(_every("parts"), lambda j: pair(own("rest", "other"), j))
        to = F.when(F.col("class") == F.col("most"), as_member).otherwise(F.array_distinct(F.concat(as_member, as_other)))
        second = materialised(_joined(docs, dealt(open_groups.withColumn("to", to)), ngram, similarity, done), "links", done)
        if not second.isEmpty():
            found = materialised(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)), "classes")
    for path in done:
        drop_path(spark, path)
    return nodes.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component"))


def _classed(docs: DataFrame, doc_id: str, text: str, ngram: int, similarity: tuple[int, int], frequent: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_id, n, key) of each row; (key, component) of each set that isn't empty and has a doc_id."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_id"))
    rows = materialised(document_sets(narrow, ngram, frequent), "sets")
    found = linked(narrow.select("doc_id", "text"), rows, ngram, similarity, block)
    return rows.where("kind = 'd'").drop("kind", "bits"), found


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, similarity: tuple[int, int] = SIMILARITY, frequent: float = FREQUENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the smallest doc_id that links of the similarity reach."""
    rows, found = _classed(docs, doc_id, text, ngram, similarity, frequent, block)
    found = rows.join(found, "key", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(_doc_id("component"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, similarity: tuple[int, int] = SIMILARITY, frequent: float = FREQUENT, block: int = BLOCK) -> DataFrame:
    """docs with one document of each class: that with the smallest doc_id, of several texts of that id and set the one that hashes lowest.

    Rows without a doc_id, and those with an empty set, stay; of rows repeated with their id and text, one stays.
    """
    rows, found = _classed(docs, doc_id, text, ngram, similarity, frequent, block)
    texts = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "text_id", "key", "n").count()
    found = materialised(texts.join(found, "key", "left"), "texts")
    stays = found.where((F.col("n") == 0) | (_node("doc_id", "key") == F.col("component")))
    first = stays.where("n > 0").groupBy("doc_id", "key").agg(F.min("text_id").alias("text_id"))
    kept = materialised(first.select("doc_id", "text_id").union(stays.where("n = 0").select("doc_id", "text_id")).distinct(), "kept")
    gone = materialised(found.select("doc_id", "text_id").distinct().join(kept, ["doc_id", "text_id"], "left_anti"), "gone")
    twice = materialised(found.where("count > 1").select("doc_id", "text_id").distinct().join(gone, ["doc_id", "text_id"], "left_anti"), "twice")
    name = lambda df, doc_id, text_id: F.struct(df[doc_id].cast("bigint"), text_id)

    def apart(df: DataFrame, other: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
        """(rows of df that are, or aren't, in other, of those that may be; the rest)"""
        near, rest = split_by(df, name(df, doc_id, F.xxhash64(df[text])), other, name(other, "doc_id", other["text_id"]))
        same = (near[doc_id].cast("bigint") == other["doc_id"]) & (F.xxhash64(near[text]) == other["text_id"])
        return near.join(other, same, kind), rest

    near, rest = apart(docs, gone, "left_anti")
    remaining = near.unionByName(rest)
    if twice.isEmpty():
        return remaining
    near, rest = apart(remaining, twice, "left_anti")
    return near.unionByName(rest).unionByName(apart(docs, twice, "left_semi")[0].dropDuplicates([doc_id, text]))
