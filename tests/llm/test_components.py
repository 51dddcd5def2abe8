"""Connected components against a union of sets, and the work that their rounds make."""

import random

import pytest

from maskmetrics.llm.common import components

RANDOM = random.Random(3)


def united(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


ORDER = RANDOM.sample(range(900), 900)
CHAIN = [(f"n{ORDER[i]:05}", f"n{ORDER[i + 1]:05}") for i in range(899)]
STAR = [(f"z{i}", "m") for i in range(600)] + [(f"a{i % 5}", f"z{i * 7}") for i in range(80)]
SPARSE = [(f"r{RANDOM.randrange(600)}", f"r{RANDOM.randrange(600)}") for _ in range(350)]


@pytest.mark.parametrize("edges", [CHAIN + STAR + SPARSE, [], [("a", "a"), ("b", None)]])
def test_components_of_many_small_parts(spark, edges):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        df = spark.createDataFrame(RANDOM.sample(edges, len(edges)), "x string, y string").repartition(5)
        found = [tuple(r) for r in components(df, most=20).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(dict(found)) and dict(found) == united(edges)


def test_a_star_takes_few_tasks(spark):
    tracker, group = spark.sparkContext.statusTracker(), "star"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = dict(map(tuple, components(spark.createDataFrame(STAR, "x string, y string").repartition(5)).collect()))
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == united(STAR)
    assert sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s)) <= 50
