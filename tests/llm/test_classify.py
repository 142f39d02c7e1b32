"""Language profiles and subword quality: scores by hand, held-out accuracy, edge rows, determinism."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm.catalog import REGISTRY
from tidewright.llm.langid import Profiles, held_out, identify, learn_profiles, ngrams, ranking
from tidewright.llm.quality import learn_quality, score_quality
from tidewright.llm.text import mix, running_hash, span_hashes

DOCS = "doc_id long, text string, lang string, SCORE string"
ROWS = [
    (1, None, "en", "x"), (2, "", None, None), (3, "12 34 !!", "en", ""), (4, "the the house", "en", None),
    (5, "das haus das", "de", None), (5, "das haus das", "de", None), (None, "the house", "en", None),
    (6, "ñ" * 30_000, None, None),
]


def test_ngrams():
    def code(gram):
        return sum((1 if c == "_" else ord(c)) << 21 * i for i, c in enumerate(reversed(gram)))

    assert sorted(ngrams("Ab1c")) == sorted(map(code, "a b c _a ab b_ _c c_ _ab ab_ _c_".split()))
    assert list(ranking("aab", 2)) == [ord("a"), ord("b")]


def test_language_edges(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = identify(docs, learn_profiles(docs)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
        assert 0 <= r.score <= 1
    assert by[1] == by[2] == by[3] == [("und", 0.0)]
    assert by[4][0][0] == "en" and by[5][0] == by[5][1] and by[5][0][0] == "de" and by[None][0][0] == "en"
    assert len(by[6]) == 1 and identify(docs.limit(0), learn_profiles(docs.limit(0))).count() == 0
    assert Profiles([], ngrams(""), ngrams("").reshape(0, 0)).predict("abc") == ("und", 0.0)


@pytest.mark.parametrize("name", ["op2_language_profiles", "op7_subword_quality"])
def test_reruns_agree(spark, sf_dir, name):
    run = REGISTRY.queries[name]
    assert sorted(run(spark, sf_dir).collect()) == sorted(run(spark, sf_dir).collect())


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = REGISTRY.queries["op2_language_profiles"](spark, d)
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    right = out.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert out.count() == 1000 and right > 0.98
    assert out.where((F.crc32(F.col("doc_id").cast("string")) % 3 == 1) != F.col("held_out")).count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = REGISTRY.queries["op7_subword_quality"](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    right = out.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert out.count() == 1000 and right > 0.9
    assert out.where((F.col("score") >= 0.3).cast("int") != F.col("predicted")).count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (4, 1), (99, 1)], "doc_id long, quality int")
    out = score_quality(docs, learn_quality(docs, labels)).collect()
    assert len(out) == len(ROWS) and len({r.score for r in out if not r.text}) == 1
    by = {r.doc_id: r.score for r in out}
    assert by[5] < 0.3 < by[4]
    none = learn_quality(docs, labels.limit(0))
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), none).count() == 0


def rank_by_hand(text):
    """A text's most frequent letter 1- to 3-grams by a plain count."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    count = Counter()
    for w in letters.split():
        count.update(w)
        padded = f" {w} "
        count.update(padded[i : i + 2] for i in range(len(w) + 1))
        count.update(padded[i : i + 3] for i in range(len(w)))
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], key_of(x[0])))][:400]


def key_of(gram):
    return sum((1 if c == " " else ord(c)) << 21 * i for i, c in enumerate(reversed(gram)))


def test_language_table_by_hand(spark):
    """Every document's language and score from the learned profiles by out-of-place distances, without numpy."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    profiles = learn_profiles(docs.where(~held_out()))
    place = {x: {int(g): int(r) for g, r in zip(profiles.grams, ranks, strict=True) if r < 400} for x, ranks in zip(profiles.languages, profiles.ranks, strict=True)}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in REGISTRY.queries["op2_language_profiles"](spark, d).collect():
        own = [key_of(g) for g in rank_by_hand(texts[r.doc_id])]
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        away = {x: sum(min(400, abs(p[g] - i)) if g in p else 400 for i, g in enumerate(own)) for x, p in place.items()}
        best = min(away, key=lambda x: (away[x], x.encode()))
        assert r.lang_pred == best and abs(r.score - (1 - away[best] / (400 * len(own)))) < 1e-12


def test_language_ties():
    """Equally distant languages: the first by code point."""
    grams = np.array([ord("a"), ord("b"), np.iinfo(np.int64).max])
    ranks = np.array([[0, 1, 800], [0, 1, 800]])
    assert Profiles(["aa", "bb"], grams, ranks).predict("a")[0] == "aa"
    assert Profiles(["aa", "bb"], grams, ranks[:, [1, 0, 2]]).predict("zz")[0] == "aa"


def test_repeated_ids(spark):
    """Several texts of one id: reruns over other partitions learn the same."""
    rows = [(i % 40, f"word{i} " * (i % 7 + 1) + "the house", ["en", "de"][i % 2], "") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = (learn_quality(x, labels) for x in (docs, docs.repartition(7)))
    assert (a.margin == b.margin).all() and a.bias == b.bias
    a, b = (learn_profiles(x) for x in (docs, docs.repartition(7)))
    assert a.languages == b.languages and (a.grams == b.grams).all() and (a.ranks == b.ranks).all()


def test_quality_table_by_hand(spark):
    """Every document's score from the learned margins, feature by feature of plain Python words and n-grams."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = learn_quality(docs, spark.read.parquet(f"{d}/labels.parquet").where(~held_out(folds=5, fold=0)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    bucket = {}

    def features_by_hand(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
        for w in re.findall(rb"[^\x20\x09-\x0D]+", lowered):
            yield "w", w
            padded = b" " + w + b" "
            yield from (("g", padded[i : i + n]) for n in (3, 4) for i in range(len(padded) - n + 1))

    def bucket_of(kind, gram):
        if (kind, gram) not in bucket:
            data = np.frombuffer(gram, np.uint8)
            plain = span_hashes(running_hash(data), np.array([0]), np.array([len(data)]))
            with np.errstate(over="ignore"):
                salt = np.uint64(len(data)) * np.uint64(0xD6E8FEB86659FD93 if kind == "w" else 1)
                bucket[kind, gram] = int((mix(plain + salt) >> np.uint64(64 - 16))[0])
        return bucket[kind, gram]

    for r in REGISTRY.queries["op7_subword_quality"](spark, d).collect():
        margins = [model.margin[bucket_of(*f)] for f in features_by_hand(texts[r.doc_id])]
        margin = sum(margins) / max(1, len(margins)) + model.bias
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_fold(spark):
    rows = spark.range(3).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id")).select(held_out().alias("h")).collect()
    assert rows[0].h is True
