"""Agreement of the clusterings of original and anonymized texts."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Rounds in which candidates for starts are drawn, how many are expected in each (at least), and passes at most.
ROUNDS, OVERSAMPLING, ITERATIONS = 5, 256, 20


def contingency(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return labels.groupBy(a, b).agg(F.count("*").alias("n"))


def normalised_mutual_information(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """nmi, one row: mutual information by the mean of both entropies, natural logarithms; 1 if both have one cluster."""
    cells = contingency(labels, a, b)
    total = cells.agg(F.sum("n").cast("double").alias("t"))
    entropy = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).join(F.broadcast(total), F.lit(True)).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias(name))
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in (a, b))
    joined = cells.join(rows, a).join(columns, b).join(F.broadcast(total), F.lit(True))
    mutual = joined.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col(f"n_{a}") * F.col(f"n_{b}")))).alias("mi"))
    both = mutual.join(entropy(a, "ha"), F.lit(True)).join(entropy(b, "hb"), F.lit(True))  # one row each
    mean = (F.col("ha") + F.col("hb")) / 2
    return both.select(F.when(mean < 1e-12, F.lit(1.0)).otherwise(F.least(F.greatest(F.col("mi") / mean, F.lit(0.0)), F.lit(1.0))).alias("nmi"))


def nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, label) of the centre with the largest inner product, ties to the smaller label. centres: label, centre; a bounded few."""
    scored = vectors.join(F.broadcast(centres), F.lit(True)).withColumn("_s", T.dot(F.col("v"), F.col("centre")))
    return scored.groupBy("id").agg(F.min_by("label", F.struct(-F.col("_s"), F.col("label"))).alias("label"))


def embed(texts: DataFrame, vectoriser=T.bag_of_words, marks: list[str] | None = T.MASK_MARKS) -> DataFrame:
    """texts (.., text) with a vector of the text without its mask marks; texts without a word have no vector."""
    cleaned = T.remove_mask_marks(F.col("text"), marks) if marks else F.col("text")
    # exploded, a vector is worked out once: a filter on the expression itself would go below, and take it in again for each use
    each = texts.drop("v").select("*", F.explode(F.array(vectoriser(cleaned))).alias("v"))
    return each.where(T.dot(F.col("v"), F.col("v")) > 0).withColumn("features", array_to_vector("v"))


def _started(x: np.ndarray, weight: np.ndarray, k: int, runs: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres (runs, k, dimensions) of weighted points: each next one is drawn in proportion to weight times squared distance from those before."""
    n, square = len(x), (x * x).sum(1)
    away = lambda c: np.maximum(square - 2 * c @ x.T + (c * c).sum(1)[:, None], 0)
    out = np.empty((runs, k, x.shape[1]))
    out[:, 0] = x[rng.choice(n, runs, p=weight / weight.sum())]
    distance = away(out[:, 0])
    for j in range(1, k):
        reach = np.cumsum(distance * weight, 1)
        at = np.minimum((reach <= (rng.random(runs) * reach[:, -1])[:, None]).sum(1), n - 1)
        out[:, j] = x[at]
        distance = np.minimum(distance, away(out[:, j]))
    return out


def candidates(points: DataFrame, expected: dict[str, int], seed: int = 1, rounds: int = ROUNDS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{anon_name: (candidates, weights)} for starts, by k-means||, over all points (anon_name, doc_id, v).

    After a first candidate, that whose doc_id hashes lowest, each round draws points independently, with probability expected *
    squared distance from the candidates so far / its sum over the corpus: about `expected` a corpus and round, so rounds *
    expected + 1 in all, whatever the corpus' size. A candidate weighs as many points as it is the nearest one to. A round is
    two passes over the points; only drawn points and one sum a corpus and task leave it. What is drawn depends on doc_ids, not
    on how the points are partitioned (but for sums of doubles).
    """
    spark = points.sparkSession
    first = points.groupBy("anon_name").agg(F.min_by("v", F.struct(F.xxhash64("doc_id"), "doc_id", "v")).alias("v")).collect()
    chosen = {r["anon_name"]: np.asarray([r["v"]], np.float64) for r in first if r["anon_name"] in expected}

    def each(function, shape: str, *columns) -> list:
        """The rows of function(name, positions in the batch, label, squared distance, batch) over all points, by corpus."""
        held = spark.sparkContext.broadcast(chosen)

        def run(batches):
            for batch in batches:
                names, v = np.asarray(batch.column(0).to_pylist(), object), _rows(batch.column(1))
                for name, c in held.value.items():
                    at = np.flatnonzero(names == name)
                    step = max(1, (1 << 21) // len(c))
                    for i in range(0, len(at), step):
                        label, distance = (y[:, 0] for y in _assigned(v[at[i : i + step]], c[None]))
                        yield function(name, at[i : i + step], label, distance, batch)

        found = points.select("anon_name", "v", *columns).mapInArrow(run, shape)
        if "v array" not in shape:
            found = found.groupBy("anon_name", "label").agg(F.sum("x").alias("x"))
        rows = found.collect()
        held.destroy()
        return rows

    sums = "anon_name string, label int, x double"
    batch_of = lambda name, label, x: pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(label, pa.int32()), pa.array(x, pa.float64())], names=["anon_name", "label", "x"])
    cost_of = lambda name, at, label, distance, batch: batch_of(name, [0], [distance.sum()])

    def weight_of(name, at, label, distance, batch):
        used, n = np.unique(label, return_counts=True)
        return batch_of(name, used, n)

    for i in range(rounds):
        cost = {r["anon_name"]: r["x"] for r in each(cost_of, sums)}
        if not any(cost.values()):
            break

        def drawn(name, at, label, distance, batch, cost=cost):
            u = (batch.column(2).to_numpy()[at].view(np.uint64) >> np.uint64(11)) / float(1 << 53)
            taken = pa.array(at[u * cost[name] < expected[name] * distance])
            return pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken)], names=["anon_name", "v"])

        new: dict[str, list] = {}
        for r in each(drawn, "anon_name string, v array<double>", F.xxhash64("doc_id", F.lit(seed), F.lit(i)).alias("u")):
            new.setdefault(r["anon_name"], []).append(r["v"])
        chosen = {name: np.unique(np.concatenate([c, np.asarray(new[name], np.float64)]), axis=0) if name in new else c for name, c in chosen.items()}
    weights = {name: np.zeros(len(c)) for name, c in chosen.items()}
    for r in each(weight_of, sums):
        weights[r["anon_name"]][r["label"]] = r["x"]
    return {name: (c[weights[name] > 0], weights[name][weights[name] > 0]) for name, c in chosen.items()}


def _assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, squared distance) of each row in each run; ties to the smaller label."""
    runs, k, d = centres.shape
    flat = centres.reshape(-1, d)
    distance = ((flat * flat).sum(1) - 2 * x @ flat.T).reshape(len(x), runs, k)
    label = distance.argmin(2)
    return label, np.maximum(np.take_along_axis(distance, label[:, :, None], 2)[:, :, 0] + (x * x).sum(1)[:, None], 0)


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def trained(points: DataFrame, wanted: dict[str, list[int]], runs: int, seed: int = 1) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """{(anon_name, k): (centres, cost of each run)} of `runs` k-means runs for each of the numbers of clusters wanted.

    All runs of all corpora take their Lloyd iterations together, one pass over points (anon_name, doc_id, v) each, of which
    only sums by run and cluster come back. The starts are drawn by k-means++ from the candidates() of each corpus.
    """
    spark = points.sparkSession
    centres, cost = {}, {}
    drawn = candidates(points, {name: max(OVERSAMPLING, 2 * max(ks)) for name, ks in wanted.items()}, seed)
    for i, (name, ks) in enumerate(sorted(wanted.items())):
        for k in ks:
            centres[name, k] = _started(*drawn[name], k, runs, np.random.default_rng([seed, i, k]))
    for _ in range(ITERATIONS):
        held = spark.sparkContext.broadcast(centres)

        def summed(batches, held=held):
            sums: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                names = np.asarray(batch.column(0).to_pylist(), object)
                v = _rows(batch.column(1))
                for (name, k), c in held.value.items():
                    mine = v[names == name]
                    for a in range(0, len(mine), max(1, (1 << 21) // (runs * k))):
                        x = mine[a : a + max(1, (1 << 21) // (runs * k))]
                        label, distance = _assigned(x, c)
                        cell = (label + np.arange(runs) * k).ravel()
                        parts = [np.bincount(cell, minlength=runs * k), *(np.bincount(cell, np.repeat(x[:, j], runs), runs * k) for j in range(x.shape[1]))]
                        found = np.concatenate([*parts, distance.sum(0)])
                        sums[name, k] = sums[name, k] + found if (name, k) in sums else found
            rows = [(n, k, x.tobytes()) for (n, k), x in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["anon_name", "k", "sums"])

        def added(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x.as_buffer()) for x in table["sums"]], 0)
            return pa.table({"anon_name": table["anon_name"][:1], "k": table["k"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        kinds = "anon_name string, k int, sums binary"
        moved = 0.0
        for r in points.select("anon_name", "v").mapInArrow(summed, kinds).groupBy("anon_name", "k").applyInArrow(added, kinds).collect():
            old = centres[r["anon_name"], r["k"]]
            total = np.frombuffer(r["sums"])
            cells, cost[r["anon_name"], r["k"]] = total[:-runs].reshape(-1, runs, r["k"]), total[-runs:]
            new = np.where(cells[0][:, :, None] > 0, np.moveaxis(cells[1:], 0, 2) / np.maximum(cells[0], 1)[:, :, None], old)
            moved = max(moved, float(np.abs(new - old).max()))
            centres[r["anon_name"], r["k"]] = new
        held.destroy()
        if moved < 1e-4:
            break
    return {key: (centres[key], cost[key]) for key in centres if key in cost}


def labelled(points: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """(anon_name, doc_id, labels): each point's label in each run of its corpus' centres."""
    held = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), object)
            v, out = _rows(batch.column(2)), [None] * batch.num_rows
            for name, c in held.value.items():
                at = np.flatnonzero(names == name)
                if len(at):
                    for i, row in zip(at, _assigned(v[at], c)[0].tolist()):
                        out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["anon_name", "doc_id", "labels"])

    return points.select("anon_name", "doc_id", "v").mapInArrow(run, f"anon_name string, doc_id {points.schema['doc_id'].dataType.simpleString()}, labels array<int>")


def mutual_information(cells: np.ndarray) -> float:
    """normalised_mutual_information() of a table of counts."""
    p = cells / cells.sum()
    a, b = p.sum(1), p.sum(0)
    entropy = lambda x: float(-(x[x > 0] * np.log(x[x > 0])).sum())
    mean = (entropy(a) + entropy(b)) / 2
    both = float((p[p > 0] * np.log((p / np.outer(a, b).clip(1e-300))[p > 0])).sum())
    return 1.0 if mean < 1e-12 else min(max(both / mean, 0.0), 1.0)


def silhouette(vectors: DataFrame) -> float:
    """The mean silhouette of (features, label), by cosine distance."""
    return ClusteringEvaluator(distanceMeasure="cosine", featuresCol="features", predictionCol="label").evaluate(vectors)


def silhouettes(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, list[float | None]]:
    """{k: the mean silhouette by cosine distance of each run} of points (v), none of length 0; None where they have fewer than two clusters.

    centres: {k: (runs, k, dimensions)}. One pass sums up the points' directions by cluster, one the silhouettes that follow from
    these sums, for all runs of all k together.
    """
    spark = points.sparkSession

    def gathered(function) -> dict[int, np.ndarray]:
        """function(x, label) of slices of the points, summed up for each k."""

        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                v = _rows(batch.column(0))
                for k, c in held.value.items():
                    step = max(1, (1 << 21) // (c.shape[0] * k))
                    for a in range(0, len(v), step):
                        x = v[a : a + step]
                        found = function(x / np.sqrt((x * x).sum(1, keepdims=True)), _assigned(x, c)[0], k)
                        sums[k] = sums[k] + found if k in sums else found
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "sums"])

        def added(table: pa.Table) -> pa.Table:
            return pa.table({"k": table["k"][:1], "sums": pa.array([np.sum([np.frombuffer(x.as_buffer()) for x in table["sums"]], 0).tobytes()], pa.binary())})

        kinds = "k int, sums binary"
        found = points.select("v").mapInArrow(run, kinds).groupBy("k").applyInArrow(added, kinds).collect()
        return {r["k"]: np.frombuffer(bytes(r["sums"])) for r in found}

    def directions(u: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
        runs = label.shape[1]
        cell = (label + np.arange(runs) * k).ravel()
        return np.concatenate([np.bincount(cell, minlength=runs * k), *(np.bincount(cell, np.repeat(u[:, j], runs), runs * k) for j in range(u.shape[1]))])

    held = spark.sparkContext.broadcast(centres)
    sums = {k: x.reshape(-1, centres[k].shape[0], k) for k, x in gathered(directions).items()}  # counts, then a sum for each dimension

    def each(u: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
        n, total = sums[k][0], sums[k][1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            away = 1 - np.einsum("ij,jrk->irk", u, total) / n  # a cluster without points is infinitely far
        away = np.where(n > 0, away, np.inf)
        own = np.take_along_axis(away, label[:, :, None], 2)[:, :, 0]
        np.put_along_axis(away, label[:, :, None], np.inf, 2)
        other, size = away.min(2), np.take_along_axis(np.broadcast_to(n, (len(u), *n.shape)), label[:, :, None], 2)[:, :, 0]
        mine = own * size / np.maximum(size - 1, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(mine < other, 1 - mine / other, np.where(mine > other, other / mine - 1, 0.0))
        return np.where(size > 1, s, 0.0).sum(0)

    means = gathered(each)
    held.unpersist()
    return {k: [float(s / n.sum()) if (n > 0).sum() > 1 else None for s, n in zip(means[k], sums[k][0])] for k in means}


def agreement(embedded: DataFrame, original: str = "original", min_k: int = 2, max_k: int = 32, k_multiplier: float = 2, n_clusterings: int = 5, n_tries: int = 50, seed: int = 1) -> tuple[dict[str, float], int, list[float]]:
    """({anonymization: mean nmi}, k, silhouettes), at the k (growing geometrically) of the best mean silhouette of the original.

    embedded: anon_name, doc_id, v, features; the corpus itself under `original`. A clustering is the one of least cost of
    n_tries. The original is clustered once more, as if it were an anonymization, and that agreement stands under its own name.
    """
    if k_multiplier <= 1:
        raise ValueError("k must grow: k_multiplier is to be above 1")
    embedded = embedded.select("anon_name", "doc_id", "v", "features").cache()
    sizes = {r[0]: r[1] for r in embedded.groupBy("anon_name").count().collect()}
    ks, k = [], min_k
    while k <= max_k and k <= sizes.get(original, 0):
        ks.append(k)
        k = max(k + 1, int(k * k_multiplier))
    if not ks:
        raise ValueError("no number of clusters could be tried")
    of = {name: sorted({min(k, max(2, size)) for k in ks}) for name, size in sizes.items()}
    points = embedded.select("anon_name", "doc_id", "v")

    def clustered(wanted: dict[str, list[int]], seed: int) -> dict[tuple[str, int], np.ndarray]:
        best = {}
        for key, (centres, cost) in trained(points, wanted, n_clusterings * n_tries, seed).items():
            best[key] = centres[np.arange(n_clusterings) * n_tries + cost.reshape(n_clusterings, n_tries).argmin(1)]
        return best

    true = clustered({original: of[original]}, seed)
    own = embedded.where(F.col("anon_name") == original)
    best: tuple[float, int, list] | None = None
    for k, found in sorted(silhouettes(own, {k: true[original, k] for k in ks}).items()):
        valid = [s for s in found if s is not None]
        if len(valid) < len(found):
            logging.warning("k = %d: %d clusterings have fewer than two clusters", k, len(found) - len(valid))
        if valid and (best is None or sum(valid) / len(valid) > best[0]):
            best = sum(valid) / len(valid), k, valid
    if best is None:
        raise ValueError("no number of clusters could be tried")
    k = best[1]
    others = clustered({name: [min(k, max(2, size))] for name, size in sizes.items()}, seed + 17)
    theirs = labelled(points, {name: c for (name, _), c in others.items()}).withColumnRenamed("labels", "b")
    mine = labelled(own, {original: true[original, k]}).select("doc_id", F.col("labels").alias("a"))
    pairs = theirs.join(mine, "doc_id").select("anon_name", F.posexplode(F.arrays_zip("a", "b")).alias("c", "p"))
    cells: dict[str, np.ndarray] = {}
    for r in pairs.groupBy("anon_name", "c", "p.a", "p.b").count().collect():  # at most n_clusterings * k * k a corpus
        cells.setdefault(r["anon_name"], np.zeros((n_clusterings, k, k)))[r["c"], r["a"], r["b"]] = r["count"]
    embedded.unpersist()
    return {name: float(np.mean([mutual_information(x) for x in of])) for name, of in sorted(cells.items())}, k, best[2]
