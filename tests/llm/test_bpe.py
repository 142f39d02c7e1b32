"""Byte-level BPE: exact agreement with the tokenizers library, and edge cases."""

import hashlib
import random

import public_tokenizers
import pytest
import tokenizers

from tidewright.llm.bpe import ByteBPE, bpe_digest, bpe_encode, merge_long

PATH = public_tokenizers.path("byte_bpe_50k.json")
KNOWN = tokenizers.Tokenizer.from_file(PATH)
OWN = ByteBPE(PATH)


def known(text):
    return KNOWN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["", " ", "  a", "a<|endoftext|> b  <|endoftext|>c", "don't  we'll\n\n x\t", "x" * 5000, "ab" * 3000, "zq" * 33,
     "😀é漢字" * 40, "　 \u0085x", "\x00\x1c\x1d"],
)
def test_agrees_on_edges(text):
    ids = OWN.encode(text)
    assert ids == known(text)
    assert OWN.decode(ids) == KNOWN.decode(ids, skip_special_tokens=False) == text


def test_agrees_on_random_texts():
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choice("abcdethin 'sé\n1. <|漢") for _ in range(rnd.randint(0, 300)))
        text = text.replace(" ", "") if rnd.random() < 0.3 else text
        assert OWN.encode(text) == known(text)


def test_both_trees_agree():
    rnd = random.Random(6)
    for n in (1, 2, 3, 31, 63):
        word = bytes(rnd.choice(b"ethinaos") for _ in range(n)).decode()
        assert merge_long(OWN.byte_id[list(word.encode())].tolist(), OWN.merges) == OWN.encode(word) == known(word)


def test_table(spark):
    """Every text of the table: the number and hash of the ids, and the hash of what the library decodes them to."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for r in bpe_digest(docs, PATH).collect():
        ids = known(r.text or "")
        decoded = KNOWN.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_decoded_hash_is_of_the_ids():
    """With a piece of the vocabulary changed, the hash follows the ids, not the text."""
    bpe = ByteBPE(PATH)
    (letter,) = known("a")
    bpe.piece_bytes = bpe.piece_bytes.copy()
    bpe.piece_bytes[bpe.piece_start[letter]] = ord("b")
    ((n, _, decoded),) = bpe.digests(["a"])
    assert n == 1 and decoded == hashlib.sha256(b"b").hexdigest()


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "a b", None), (2, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    out = [r.asDict() for r in bpe_digest(df, PATH).collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert [r["n_tokens"] for r in out] == [0, 0, 2, 2]
    assert {r["ids_sha256"] for r in out[:2]} == {r["decoded_sha256"] for r in out[:2]} == {empty}
    assert out[2]["ids_sha256"] == hashlib.sha256(",".join(map(str, known("a b"))).encode()).hexdigest()
    assert [r.token_ids for r in bpe_encode(df, PATH).collect()] == [[], [], known("a b"), known("a b")]
    assert bpe_digest(df.limit(0), PATH).count() == 0
