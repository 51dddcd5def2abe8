"""Starts of k-means: candidates drawn over the whole corpus, weighed by the points that are nearest to them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmetrics.operators import clustering as C


def table(spark, by_name, partitions=3):
    rows = [(name, i, v.tolist()) for name, x in by_name.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "anon_name string, doc_id int, v array<double>").repartition(partitions)


def cost(x, c):
    return C._assigned(x, c)[1].sum(0)


def test_rare_points_are_found_and_starts_cost_no_more_than_a_samples(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(6000, 4)), rng.normal(size=(3, 4)) + 500, rng.normal(size=(3, 4)) - 500])
    points = table(spark, {"a": x})
    found, weight = C.candidates(points, {"a": 32})["a"]
    assert weight.sum() == len(x) and 32 < len(found) < 6 * 64
    assert (found > 400).all(1).any() and (found < -400).all(1).any()
    assert {tuple(v) for v in found} <= {tuple(v) for v in x}
    assert np.array_equal(weight, np.bincount(C._assigned(x, found[None])[0][:, 0], minlength=len(found)))
    mine = cost(x, C._started(found, weight, 3, 20, np.random.default_rng(1)))
    sample = x[rng.permutation(6000)[:2048]]  # without the rare ones, as most samples are
    assert mine.mean() < cost(x, C._started(sample, np.ones(2048), 3, 20, np.random.default_rng(1))).mean() / 10
    even = rng.normal(size=(5000, 4)) + 8 * np.eye(4)[rng.integers(4, size=5000)]
    found, weight = C.candidates(table(spark, {"a": even}), {"a": 256})["a"]
    best = lambda y, w: cost(even, C._started(y, w, 4, 50, np.random.default_rng(2))).min()
    assert best(found, weight) < 1.1 * best(even[:2048], np.ones(2048))


def test_candidates_depend_on_ids_and_not_on_partitions(spark):
    rng = np.random.default_rng(4)
    by_name = {"a": rng.normal(size=(400, 3)), "b": rng.normal(size=(90, 3)), "unwanted": rng.normal(size=(5, 3))}
    one, other = (C.candidates(table(spark, by_name, n), {"a": 16, "b": 16}) for n in (1, 7))
    assert set(one) == set(other) == {"a", "b"}
    for name in one:
        assert np.array_equal(one[name][0], other[name][0]) and np.array_equal(one[name][1], other[name][1])
        assert one[name][1].sum() == len(by_name[name])
    third = C.candidates(table(spark, by_name), {"a": 16, "b": 16}, seed=2)
    assert not np.array_equal(one["a"][0], third["a"][0])


@pytest.mark.parametrize("x", [np.ones((50, 2)), np.array([[1.0, 2.0]]), np.repeat([[0.0, 1.0], [1.0, 0.0]], 30, 0)])
def test_fewer_points_than_clusters(spark, x):
    points = table(spark, {"a": x})
    found, weight = C.candidates(points, {"a": 8})["a"]
    assert len(found) == len(np.unique(x, axis=0)) and weight.sum() == len(x)
    centres, total = C.trained(points, {"a": [2]}, 4)["a", 2]
    assert np.isfinite(centres).all() and total == pytest.approx(np.zeros(4), abs=1e-9)


def test_ids_of_any_kind_and_no_points(spark):
    rows = [("a", f"d{i}", [float(i % 7), 1.0]) for i in range(60)] + [("a", None, [3.0, 1.0])] * 2
    points = spark.createDataFrame(rows, "anon_name string, doc_id string, v array<double>")
    found, weight = C.candidates(points, {"a": 20})["a"]
    assert weight.sum() == 62 and len(found) <= 7
    assert C.candidates(points.where(F.lit(False)), {"a": 20}) == {}
