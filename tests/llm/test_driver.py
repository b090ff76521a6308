"""What the driver keeps, and how many jobs it runs for components."""

import random

import pytest

from sieveline.llm import toxicity
from sieveline.llm.common import table
from sieveline.llm.components import components

SF = "/root/testdata/sf0.001"
DDL = "a binary, b binary"


def least_reachable(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {x: find(x) for x in top}


def node(i):
    return i.to_bytes(2, "big")


CASES = {
    "stars": [(10 * i, 10 * i + j) for i in range(40) for j in range(1, 6)],
    "chain": [(i, i + 1) for i in range(120)],
    "random": [(random.Random(i).randrange(600), random.Random(-i - 1).randrange(600)) for i in range(360)],
    "hub": [(999, i) for i in range(400)] + [(i, i + 1) for i in range(0, 400, 7)],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_components_are_the_least_reachable(spark, name):
    rows = [(node(a), node(b)) for a, b in CASES[name]]
    got = components(spark.createDataFrame(rows + rows[:3] + [(node(7), node(7))], DDL)).collect()
    want = least_reachable(rows)
    assert len(got) == len(want) and {bytes(r.node): bytes(r.label) for r in got} == want


def test_components_take_no_step_where_none_is_left(spark):
    edges = spark.createDataFrame([(node(a), node(b)) for a, b in CASES["stars"]], DDL)
    context = spark.sparkContext
    context.setJobGroup("settled-components", "")
    try:
        components(edges)
        jobs = context.statusTracker().getJobIdsForGroup("settled-components")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 8  # more with steps that change nothing


def test_driver_keeps_no_words_of_the_sample(spark):
    toxicity.buckets.cache_clear()
    told = toxicity.scores(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert toxicity.buckets.cache_info().currsize == 0
    assert any(r.score > 0 for r in told.collect())
