"""The corpus pipeline against a plain Python version of its decisions."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tokenizers

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidewright.llm import mixing  # noqa: E402


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_of_groups(docs):
    sets, inverted, root = {r.doc_id: shingles(r.text) for r in docs}, defaultdict(list), {r.doc_id: r.doc_id for r in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for a, b in {(a, b) for v in inverted.values() for a in v for b in v if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in root if find(i) == i}


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34", None, None, 5)], docs.schema)
    docs = docs.union(junk)
    seen = [docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    start, language, quality, single, mix, tokens = seen
    assert {r.doc_id for r in start} - {r.doc_id for r in language} == {10**6, 10**6 + 1}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {r.doc_id for r in language} - {r.doc_id for r in quality}
    judged = [labels[i] for i in gone if i in labels]
    assert gone and sum(judged) <= 0.15 * len(judged)
    assert {r.doc_id for r in single} == kept_of_groups(quality) and len(single) < len(quality)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in single:
        sizes[r.source] += len(words(r.text))
    for r in mix:
        taken[r.source] += len(words(r.text))
    for s, t in mixing.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 2 * max(len(words(r.text)) for r in single if r.source == s)
    known = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted((r.doc_id, hashlib.sha256(",".join(map(str, known.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()) for r in mix)
    assert sorted((r.doc_id, r.ids_sha256) for r in tokens) == expected


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, hash string, size string, extra string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of the table with nulls in any column, empty and long texts, repeated rows and ids, and more columns."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "a", None, "1", "x") for r in docs]
    base = max(docs, key=lambda r: len(r.text))
    near = base.text + " end"
    rows += [(None, base.text, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [(5000, "", "en", "s", 0, None, None, None, "x")] * 2 + [(5001, None, "en", None, None, None, None, None, "x")]
    rows += [(5002, near, "en", None, 1, None, None, None, e) for e in ("p", "q", "q", None)]
    rows += [(5003, near, "en", "s", 1, None, None, None, "x"), (5003, " ".join(reversed(near.split())), "en", "s", 1, None, None, None, "x")]
    rows += [(5004, " ".join([base.text[:20_000]] * 60), "en", "s", 1, None, None, None, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def expected_of_groups(rows):
    """Rows that stay by the rule of stage 3, as multisets of groups: (group of linked rows) -> one of least id."""
    live = [r for r in rows if r.doc_id is not None and shingles(r.text)]
    sets = [shingles(r.text) for r in live]
    root = list(range(len(live)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(live):
        groups[find(i)].append(r)
    return [r for r in rows if r.doc_id is None or not shingles(r.text)], list(groups.values())


def test_near_duplicates_by_row(spark, odd):
    out = Counter(corpus_pipeline.near_duplicates(spark, odd, "").collect())
    free, groups = expected_of_groups(odd.collect())
    assert not Counter(free) - out and sum(out.values()) == len(free) + len(groups)
    for g in groups:
        least = min(r.doc_id for r in g)
        assert sum(out[r] for r in {r for r in g if r.doc_id == least}) == 1
        assert not any(out[r] for r in g if r.doc_id > least)
    again = Counter(corpus_pipeline.near_duplicates(spark, odd.repartition(5), "").collect())
    assert again == out


def test_mix_keeps_every_column(spark, odd):
    out = Counter(corpus_pipeline.source_mix(spark, odd, "").collect())
    again = Counter(corpus_pipeline.source_mix(spark, odd.repartition(5), "").collect())
    assert out == again and set(out) <= set(odd.collect())
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in odd.collect():
        sizes[r.source] += len(words(r.text))
        most[r.source] = max(most[r.source], len(words(r.text)))
    for r, n in out.items():
        taken[r.source] += n * len(words(r.text))
    assert all(abs(taken[s] - t) <= 2 * most[s] for s, t in mixing.targets(dict(sizes)).items())


def test_every_stage_takes_odd_and_empty_tables(spark, odd, sf_dir, tmp_path):
    for start in (odd, odd.limit(0)):
        docs = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{start is odd}-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == odd.columns
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
        assert (docs.count() > 0) == (start is odd)
    assert corpus_pipeline.language(spark, odd, sf_dir).where("text IS NULL OR text = ''").count() == 0
