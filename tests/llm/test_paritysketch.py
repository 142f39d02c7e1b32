"""Parity-sketch join against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import paritysketch as P
from tidewright.llm import shared

SCHEMA = "doc_id long, text string, N string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (n, component), for unique ids; by union over all pairs that share a shingle."""
    sets, parent, inverted = {i: shingles(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}, defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for pair in {(a, b) for v in inverted.values() for a in v for b in v if a < b}:
        a, b = sets[pair[0]], sets[pair[1]]
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted(map(root, pair))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def planted(seed=3):
    """Families of edited copies, texts at the threshold, texts that share one passage, short and long ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    passage, out = [word() for _ in range(40)], []
    for base in range(12):
        text = [word() for _ in range(rnd.choice([3, 5, 6, 8, 12, 30, 120, 400]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            cut = rnd.randint(0, len(copy) // 4)
            out.append(copy[: len(copy) - cut] + ([word()] if rnd.random() < 0.3 else []))
    for _ in range(60):
        out.append([word() for _ in range(rnd.randint(5, 60))] + passage)
    out += [passage, passage[:20], ["One"], ["one"], [], [word() for _ in range(20_000)]]
    return [(i * 3 + 1, " ".join(w), None) for i, w in enumerate(out)]


@pytest.mark.parametrize("common_in", [2, 6, 10**9])
def test_brute_force(spark, monkeypatch, common_in):
    monkeypatch.setattr(P, "COMMON_IN", common_in)
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "PIECE", 20 if common_in == 2 else 4096)
    monkeypatch.setattr(P, "TILE", 7)
    monkeypatch.setattr(P, "COLUMNS", 50)
    rows = planted()
    out = P.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows) and len(out) == len(rows)
    assert len({c for _, c in brute(rows).values()}) < len(rows)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = P.jaccard_components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(docs.collect())


def test_edges(spark):
    rows = [(5, None, ""), (4, "", ""), (3, " \t", ""), (2, "A b", ""), (1, "a  B", ""), (None, "a b", ""), (7, "a b c d e f", ""),
            (7, "x y z u v", ""), (9, "x y z u v", ""), (9, "x y z u v", "")]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in P.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert out == sorted([(5, 0, 5), (4, 0, 4), (3, 0, 3), (2, 1, 1), (1, 1, 1), (None, 1, None), (7, 2, 7), (7, 1, 7), (9, 1, 7), (9, 1, 7)], key=str)
    assert P.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hamming_is_a_lower_bound():
    rnd = np.random.default_rng(1)
    texts = [" ".join(map(str, rnd.integers(0, 60, n))) for n in (9, 14, 15, 16, 40, 300, 900)]
    (_, sizes, sets), *_ = P.shingle_sets(pa.array(texts))
    far = P.hamming([np.frombuffer(s, np.uint8) for s in P.dense_sketches(sizes, sets)])
    parts = [set(s.tolist()) for s in np.split(sets, np.cumsum(sizes)[:-1])]
    assert all(far[i, j] <= len(a ^ b) for i, a in enumerate(parts) for j, b in enumerate(parts))
    assert (far == far.T).all() and (np.diag(far) == 0).all()


def test_near_misses_write_no_pairs(spark, monkeypatch):
    """A family of one body and own tails, all pairs at 0.74: none linked, and no row for any pair."""
    monkeypatch.setattr(P, "BLOCK", 64)
    body = [f"b{k}" for k in range(304)]
    rows = [(i, " ".join(body + [f"t{i}x{k}" for k in range(53)]), None) for i in range(600)]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.73 < len(a & b) / len(a | b) < 0.75
    made = {}
    for name in ("near_members", "spanning_links"):

        def counted(*args, f=getattr(P, name), name=name):
            made[name] = P.checkpoint(f(*args))
            return made[name]

        monkeypatch.setattr(P, name, counted)
    out = P.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert all(r.component_id == r.doc_id for r in out) and len(out) == 600
    assert made["near_members"].select("class").distinct().count() == 600
    assert made["near_members"].count() < 20 * 600 and made["spanning_links"].count() == 0


def test_intersections(monkeypatch):
    monkeypatch.setattr(P, "TILE", 3)
    monkeypatch.setattr(P, "COLUMNS", 4)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, n)).astype(np.uint64) for n in (1, 5, 9, 30, 1, 12, 60)]
    both = np.concatenate([x for _, x in P.intersections(sets)])
    assert (both + np.diag([10**6] * 7) >= 0).all()
    assert all(both[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


@pytest.mark.parametrize("hot", [0, 5, 10**9])
def test_attach(spark, monkeypatch, hot):
    """Rows of hot and of other keys get the facts of their key once."""
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(i, 0 if i < 50 else i % 7) for i in range(100)], "id long, key long")
    facts = rows.groupBy("key").count().withColumnRenamed("count", "copies").withColumn("what", F.col("key") * 10)
    out = shared.attach(rows, facts, "key", 100).collect()
    assert sorted((r.id, r.what) for r in out) == [(i, 0 if i < 50 else i % 7 * 10) for i in range(100)]
