"""What several operators share: tables in the shared folder, batch plumbing, connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of our own if all of Spark is this one process; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="maskmetrics-")
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(_remove, own)
    return found.rstrip("/")


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder not yet there. What drop_path() hasn't deleted when Python ends is deleted then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_rest, spark)
    _written.append(path)
    return path


def _drop_rest(spark: SparkSession) -> None:
    for path in list(_written):
        try:
            drop_path(spark, path)
        except Exception:  # Spark has gone: the folder's owner cleans it
            return


def materialised(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and a lost executor loses none of it.

    The folder's path is appended to paths, for a caller that can tell when nothing reads it any more.
    """
    path = new_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    forget(df.sparkSession)  # what the driver planned the stage with goes, and its heap shrinks, before the next one
    return df.sparkSession.read.schema(df.schema).parquet(path)


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def bytes_of(setting: str) -> int:
    """A size as Spark's settings have it, such as 64m; -1, no limit, stays."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(number) * _UNITS[unit]


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Has this session hand Python at most that many bytes in an Arrow batch, so that long texts don't come by the thousand."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bytes_of(spark.conf.get(name)) not in range(1, most + 1):
        spark.conf.set(name, str(most))


def forget(spark: SparkSession, rounds: int = 0) -> None:
    """Lets Spark delete the shuffles that nothing refers to any more.

    py4j passes on what Python has dropped within a second, and some of it goes at the second collection only: with 2 rounds
    all are gone, with none those of some time ago.
    """
    gc.collect()
    for _ in range(rounds):
        time.sleep(1.2)
        spark.sparkContext._jvm.System.gc()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_path gave, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def per_batch(function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: a function from one batch to some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
                pa.default_memory_pool().release_unused()

    return run


def with_arrays(docs: DataFrame, keep: list[str], read: list[str], added: list[StructField], function: Callable[..., list[pa.Array]]) -> DataFrame:
    """docs' columns `keep`, and those `added` that function makes of the columns `read`, from Arrow batch to Arrow batch.

    Columns go by position on the way, so names may have any characters, nested ones too.
    """
    names = [*keep, *(c for c in read if c not in keep)]
    own = docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(names)))
    kept = [f"c{i}" for i in range(len(keep))]
    schema = StructType([*own.schema.fields[: len(keep)], *(StructField(f"a{i}", f.dataType, f.nullable) for i, f in enumerate(added))])
    at = [names.index(c) for c in read]

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *function(*(batch.column(i) for i in at))], names=schema.names)

    out = own.mapInArrow(per_batch(run), schema)
    return out.select(*(F.col(c).alias(name) for c, name in zip(kept, keep)), *(F.col(f"a{i}").alias(f.name) for i, f in enumerate(added)))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has columns of (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def split_by(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, buckets: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be one of wanted's, rows whose key is none), without a shuffle of rows.

    What is broadcast is the hash buckets that wanted's keys fall into, at most `buckets` integers. A join with wanted then
    moves the first of the two only: wanted's rows and those that share a bucket with them by chance.
    """
    (name,) = unused(rows, "_bucket")
    bucket = lambda k: F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int")
    held = F.broadcast(wanted.select(bucket(wanted_key).alias(name)).distinct())
    own = rows.withColumn(name, bucket(key))
    names = [column(c) for c in rows.columns]
    return own.join(held, name, "left_semi").select(*names), own.join(held, name, "left_anti").select(*names)


def crc_remainder(column: str, modulus: int):
    """crc32 of a column as text, modulo; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


#: edges that components() contracts at a time
CONTRACTED = 1 << 17


def _contracted(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: edges (a, b), about `most` at a time, as stars: of each node that isn't the smallest one of its component among them, an edge to that."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (pa.concat_arrays([x.column(i) for x in held]) for i in range(2))
        coded = pa.concat_arrays([a, b]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ends = rank[coded.indices.to_numpy()].reshape(2, -1)
        label = np.arange(len(order))
        while True:
            x, y = label[ends]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (label[label] != label).any():
                label = label[label]
        other = np.flatnonzero(label != np.arange(len(label)))
        nodes = coded.dictionary.take(order)
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(other)), nodes.take(pa.array(label[other]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return run


def components(edges: DataFrame, rounds: int = 60, most: int = CONTRACTED) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node that links reach.

    Each round makes stars of the edges where they are, then deals them by their larger node: its smallest neighbour becomes its
    only one, and that of its other neighbours too; then what points to a node that points on goes on with it. It ends with the round in
    which neither happens. The edges are written to the shared folder after each round. A node with a great many links is no
    single task's list: as the larger one it has an edge at most of each `most` edges, as the smaller one it is met in a
    join, whose partitions Spark can split.
    """
    spark = edges.sparkSession
    name = edges.columns
    ends = [F.col(name[0]), F.col(name[1])]
    e = edges.where(ends[0] != ends[1]).select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b"))
    kind = e.schema["a"].dataType.simpleString()
    by = Window.partitionBy("a").orderBy("b")
    paths: list[str] = []
    for _ in range(rounds):
        near = e.mapInArrow(_contracted(most), f"a {kind}, b {kind}").select("a", "b", F.lag("b").over(by).alias("last"), F.min("b").over(by).alias("least"))
        linked = F.col("last").isNotNull()
        links = near.where(~linked | (F.col("last") != F.col("b"))).select(F.when(linked, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("least").alias("b"), linked.alias("linked"))
        on = links.where("NOT linked").select(F.col("a").alias("from"), F.col("b").alias("to"))
        e = links.join(on, F.col("b") == F.col("from"), "left").select("a", F.coalesce("to", "b").alias("b"), (F.col("linked") | F.col("to").isNotNull()).alias("open"))
        paths.append(new_path(spark, "edges"))
        e.write.parquet(paths[-1])
        e = spark.read.schema(e.schema).parquet(paths[-1])
        for old in paths[:-1]:
            drop_path(spark, old)
        del paths[:-1]
        forget(spark)
        if not e.agg(F.max("open")).first()[0]:
            break
        e = e.select("a", "b")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
