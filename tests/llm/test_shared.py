"""Connected components: both ways against a plain union."""

import random

import pytest

from tidewright.llm import shared


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(shared, "ONE_TASK_EDGES", one_task)
    rnd = random.Random(2)
    edges = [(rnd.randint(-60, 60), rnd.randint(-60, 60)) for _ in range(50)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (7, 8), (8, 7)]
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    out = shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == len(linked) and {r.node: r.component for r in out} == {x: label[x] for x in linked}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
