import random

import numpy as np
import pytest

from gleaner.llm.components import components, star
from gleaner.session import shared_dir


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted((x, find(x)) for x in root if find(x) != x)


def edges(kind):
    r = random.Random(kind)
    return {
        "chain": [(i, i + 1) for i in range(900)],
        "random": [(r.randrange(-600, 600), r.randrange(-600, 600)) for _ in range(700)] + [(None, 3), (4, None), (4, 4)],
        "hub": [(r.getrandbits(63) - (1 << 62), -5) for _ in range(500)],
        "none": [],
    }[kind]


@pytest.mark.parametrize("most", [1 << 18, 300, 40])
@pytest.mark.parametrize("kind", ["chain", "random", "hub", "none"])
def test_equals_union_find(spark, kind, most):
    """Also where a table is more than tasks join at once, and goes on over the cluster."""
    shared_dir(spark)
    got = components(spark.createDataFrame(edges(kind), "a long, b long"), most=most)
    assert sorted(map(tuple, got.collect())) == brute(edges(kind))


def test_a_table_of_one_task_takes_no_rounds(spark):
    """A round is several jobs and half a dozen shuffles, which all stay with the driver for a while."""
    shared_dir(spark)
    spark.sparkContext.setJobGroup("components-chain", "")
    try:
        got = components(spark.createDataFrame(edges("chain"), "a long, b long"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components-chain"))
    assert jobs <= 6 and got.count() == 900


def test_strings_go_on_over_the_cluster(spark):
    shared_dir(spark)
    got = components(spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "a string, b string"))
    assert sorted(map(tuple, got.collect())) == [("b", "a"), ("c", "a"), ("y", "x")]


def test_star_of_no_edges():
    a, b = star(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(a) == len(b) == 0
