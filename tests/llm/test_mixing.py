"""Cube mixing: targets, balance, bounds, repeatability, edge rows."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tidewright.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, TAKEN string"


def test_targets():
    assert M.targets({}) == {}
    sizes = {"b": 100, "a": 10, None: 50, "c": 0}
    out = M.targets(sizes)
    assert out["a"] == 20 and out["c"] == 0 and all(out[s] <= 2 * n for s, n in sizes.items())
    assert sum(out.values()) == Fraction(3, 2) * 160
    assert M.targets({"x": 10, "y": 10}) == {"x": 20, "y": 10}


@pytest.mark.parametrize("land", [False, True])
def test_flight_keeps_totals(land):
    rnd = random.Random(1)
    size = [rnd.randint(0, 500) for _ in range(400)] + [7] * 50
    p = [rnd.choice([0.0, 0.25, 0.6, 1.0]) for _ in size]
    out = M.fly(p, size, random.Random(2), land)
    assert sum(0 < x < 1 for x in out) <= (0 if land else 2)
    slack = 2 if land else 1e-6
    assert abs(sum(out) - sum(p)) <= slack
    assert abs(sum(x * s for x, s in zip(out, size, strict=True)) - sum(x * s for x, s in zip(p, size, strict=True))) <= slack * 500


def test_flight_keeps_probabilities():
    size, p = [1, 5, 9, 14, 2], [0.3, 0.5, 0.2, 0.7, 0.4]
    runs = [M.fly(p, size, random.Random(i), True) for i in range(4000)]
    for k, x in enumerate(p):
        assert abs(sum(r[k] for r in runs) / len(runs) - x) < 0.04


@pytest.mark.parametrize("block", [20, 4000])
def test_sources(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rnd = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 60))), rnd.choice(["a", "a", "a", "b", "c", "d", None]), "") for i in range(900)]
    rows += [(5, None, "a", ""), (None, "x y", "b", ""), (6, "", "empty", "")] + [(7, "one two", "e", "")] * 300
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = M.mix_decisions(docs).collect()
    assert len(out) == len(rows)
    taken, want, size = defaultdict(int), {}, Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.repeats
        taken[r.source] += r.taken
        size[r.source] += r.size
        want[r.source] = r.target
    assert {s: float(t) for s, t in M.targets(dict(size)).items()} == want
    assert all(abs(taken[s] - want[s]) <= 2 * 60 for s in want)
    again = M.mix_decisions(docs.repartition(7)).collect()
    assert Counter(out) == Counter(again)
    mixed = Counter((r.doc_id, r.text, r.source) for r in M.mix(docs).collect())
    made, got = Counter(), Counter()
    for r in out:
        made[r.id, r.source] += r.repeats
    for (i, _, s), n in mixed.items():
        got[i, s] += n
    assert +made == got


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix_decisions(empty).count() == 0 and M.mix(empty).columns == empty.columns and M.mix(empty).count() == 0
