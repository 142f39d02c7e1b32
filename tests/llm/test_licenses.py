"""License scan against a word-by-word brute force."""

import random
import re
import textwrap

import pytest

from tidewright.llm import licenses as L

SCHEMA = "doc_id long, text string, SCORE string"


def to_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = to_words(text)
    places = sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    own, labels, score = {x for _, x in places}, set(), 0.0
    lines = [to_words(line) for line in (text or "").split("\n")]
    for label, t in L.TEMPLATES:
        n, t = len(to_words(t)), set(to_words(t))
        for block in [*lines, *(w[i : i + n] for i in range(len(w)))]:
            share = len(t & set(block)) / len(t)
            if share >= L.THRESHOLD - 1e-12:
                labels.add(label)
                score = max(score, share)
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted(own)), ",".join(sorted(own | labels)), score)


def result(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


def test_brute_force(spark):
    rnd = random.Random(1)
    notices = [t for _, t in L.TEMPLATES]
    texts = [None, "", "\n\n", "CC BY", "cc\nby cc by", "mit license apache license", "MIT  LICENSE gnu general public license", "x" * 100_000]
    for _ in range(300):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            line = to_words(rnd.choice(notices))
            if rnd.random() < 0.6:
                line = [w for w in line if rnd.random() > 0.15]
            if rnd.random() < 0.5:
                rnd.shuffle(line)
            parts.append(" ".join(line + ["mit"] * rnd.randint(0, 2)))
        texts.append(rnd.choice(["\n", " "]).join(parts))
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(3, "CC BY", "")]
    out = L.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert result(r) == brute(r.text), r.text
    assert len({r.labels for r in out}) > 10


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = L.scan_licenses(docs).collect()
    assert all(result(r) == brute(r.text) for r in out) and any(r.n_base for r in out)


def test_empty(spark):
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("counts", [None, {"the": 9, "license": 5}])
def test_prefixes_hold_the_rarest(counts):
    s = L.Scanner(counts)
    for i, (_, ranks, need) in enumerate(s.templates):
        assert all(i in s.starters[r] for r in ranks[: len(ranks) - need + 1])


def test_wrapped_notices(spark):
    """Every notice is found whole, however it is wrapped; half a notice at the end of a text is not."""
    rows = []
    for i, (_, t) in enumerate(L.TEMPLATES):
        for width in (20, 40, 72):
            rows.append((i, "Some words\nbefore the\n" + "\n # ".join(textwrap.wrap(t, width)) + "\nand after.\n", ""))
    rows += [(100, " ".join(L.TEMPLATES[1][1].split()[:14]), ""), (101, None, "")]
    for r in L.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect():
        if r.doc_id < 100:
            assert L.TEMPLATES[r.doc_id][0] in r.labels.split(",") and r.score == 1.0
        else:
            assert (r.labels, r.score) == ("", 0.0)
