"""The elements of a JSON list or mapping, of any size in one file, read in as many tasks as Spark splits its files into.

The scan is Spark's own reader of text, with a character that the format can't do without as the end of a line (rarer ones make
fewer rows): a split is then whole pieces between such characters, and never begins within an escape. Whether it begins in a string, and at which depth of brackets, follows from the splits before it.
So a first pass notes for each split what it does to either (as if it began outside a string, and inside one), one small row a
split; these are put together in order, on the driver; a second pass cuts at the commas of depth 1. What an element has in several splits,
two fragments a split at most, is brought together by a shuffle, for which the file is read once more; no other element is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are looked at together.
SLICE = 4 << 20

_QUOTE, _SLASH, _COMMA = b'"\\,'
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = _STEP != 0
_MARK[_COMMA] = True

#: (file, start) of a split: does it begin in a string, at which depth, and where does the element begin that it begins in
State = dict[tuple[str, int], tuple[int, int, int]]


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions of brackets and commas, quotes before each modulo 2, quotes in all modulo 2) of bytes that don't begin within an escape."""
    slashes = np.flatnonzero(data == _SLASH)
    quotes = np.flatnonzero(data == _QUOTE)
    if len(slashes) and len(quotes):
        last = np.append(np.diff(slashes) > 1, True)  # of a run of backslashes
        ends = np.flatnonzero(last)
        odd = np.diff(ends, prepend=-1) % 2 == 1
        quotes = quotes[~np.isin(quotes - 1, slashes[ends[odd]], assume_unique=True)]
    at = np.flatnonzero(_MARK[data])
    return at, np.searchsorted(quotes, at) & 1, len(quotes) & 1


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    lines = spark.read.text(path, lineSep=separator)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches, separator: str) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """((file, start), bytes) of the rows of one split that stand together, each with its separator, about SLICE bytes at most unless a row is longer."""
    for batch in batches:
        starts, ends = batch.column(2).to_numpy(), np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False))
        files = batch.column(1).dictionary_encode()
        number = files.indices.to_numpy()
        changed = np.flatnonzero((np.diff(starts) != 0) | (np.diff(number) != 0) | (np.diff(ends // SLICE) != 0)) + 1
        cuts = [0, *changed.tolist(), len(starts)]
        for a, z in zip(cuts, cuts[1:]):
            if a < z:
                yield (files[a].as_py(), int(starts[a])), np.frombuffer(separator.encode().join([*batch.column(0)[a:z].to_pylist(), b""]), np.uint8)


def _noted(batches, separator: str):
    """For each split: is its number of quotes odd, and for a begin outside and inside a string the change of depth and the depths with commas."""
    known: dict[tuple[str, int], list] = {}
    for key, data in _runs(batches, separator):
        mine = known.setdefault(key, [0, [0, 0], [set(), set()], None])
        at, odd, quotes = marks(data)
        steps = _STEP[data[at]]
        for inside in (0, 1):
            outside = odd == mine[0] ^ inside
            depth = mine[1][inside] + np.cumsum(steps[outside])
            mine[2][inside].update(np.unique(depth[steps[outside] == 0]).tolist())
            mine[1][inside] = int(depth[-1]) if len(depth) else mine[1][inside]
        mine[0] ^= quotes
        if mine[3] is None:
            mine[3] = data[:64].tobytes().removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
    rows = [(file, start, quotes, *changes, sorted(commas[0]), sorted(commas[1]), lead) for (file, start), (quotes, changes, commas, lead) in known.items()]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["file", "start", "quotes", "change0", "change1", "commas0", "commas1", "lead"])


def states(pieces: DataFrame, opening: str, separator: str) -> State:
    """How each split begins. A file that doesn't begin with the opening bracket, or doesn't end with all brackets and strings closed, is refused."""
    noted = pieces.mapInArrow(lambda batches: _noted(batches, separator), "file string, start bigint, quotes int, change0 bigint, change1 bigint, commas0 array<bigint>, commas1 array<bigint>, lead binary").collect()
    out: State = {}
    by_file: dict[str, list] = {}
    for r in noted:
        by_file.setdefault(r["file"], []).append(r)
    for file, splits in by_file.items():
        splits.sort(key=lambda r: r["start"])
        if bytes(splits[0]["lead"]) != opening.encode():
            raise ValueError(f"{file}: does not begin with {opening}")
        inside = depth = begun = 0
        for r in splits:
            out[file, r["start"]] = inside, depth, begun
            if 1 - depth in r[f"commas{inside}"]:
                begun = r["start"]
            depth, inside = depth + r[f"change{inside}"], inside ^ r["quotes"]
        # no whole file ends with its separator, so one stands behind the end of each
        if (inside, depth) != (separator == '"', _STEP[ord(separator)]):
            raise ValueError(f"{file}: ends within a string or a bracket")
    return out


def elements(spark: SparkSession, path: str, opening: str, separator: str = ",") -> DataFrame:
    """(element): the text of each element of the lists, or mappings, at path. opening: [ or {. separator: one of , " ] }, but not what closes the whole.

    separator only says where Spark may cut a file: between two of it should lie little text, but more than a few bytes.

    A mapping's element is a key and its value, with the colon. Blank elements, as of an empty list, are left out; an empty file has none. Elements are not
    checked further, and come in no order.
    """
    pieces = _pieces(spark, path, separator)
    held = spark.sparkContext.broadcast(states(pieces, opening, separator))

    def cut(whole: bool):
        """The elements that lie in one split each; or else the fragments of the others."""

        def run(batches):
            now: dict[tuple[str, int], list] = {}  # of each split of the task: in a string?, depth, has its element begun in it?, that element so far
            for key, data in _runs(batches, separator):
                inside, depth, own, so_far = now.pop(key, None) or [*held.value[key][:2], False, []]
                for other in [*now]:  # a split that came before, now at its end
                    yield from ended(other, now.pop(other))
                at, odd, quotes = marks(data)
                at = at[odd == inside]
                steps = _STEP[data[at]]
                depths = depth + np.cumsum(steps)
                cuts = np.flatnonzero(((steps == 0) & (depths == 1)) | ((steps == 1) & (depths == 1)) | ((steps == -1) & (depths == 0)))
                done, x = [], 0
                for i in cuts.tolist():
                    y = int(at[i])
                    so_far.append(data[x:y])
                    if steps[i] < 1:
                        if own and whole:
                            done.append(b"".join(map(bytes, so_far)))
                        elif not own and not whole:
                            yield from fragment(key, held.value[key][2], so_far)
                    own, so_far, x = True, [], y + 1
                so_far.append(data[x:])
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(done)), pa.nulls(len(done), pa.int64()), pa.nulls(len(done), pa.int64()), pa.array(done, pa.binary())], names=names)
                now[key] = [inside ^ quotes, int(depths[-1]) if len(depths) else depth, own, so_far]
            for key, state in now.items():
                yield from ended(key, state)

        def ended(key, state):
            _, depth, own, so_far = state
            if depth > 0 and not whole:
                yield from fragment(key, key[1] if own else held.value[key][2], so_far)

        def fragment(key, begun: int, so_far: list):
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([begun], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([b"".join(map(bytes, so_far))], pa.binary())], names=names)

        names = ["file", "begun", "part", "text"]
        found = pieces.mapInArrow(run, "file string, begun bigint, part bigint, text binary")
        return found.withColumn("text", F.col("text").cast("string"))

    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
    joined = cut(False).groupBy("file", "begun").agg(F.array_join(parts, "").alias("element"))
    return cut(True).select(F.col("text").alias("element")).unionByName(joined.select("element")).where(F.trim(F.regexp_replace("element", r"\s+", " ")) != "")
