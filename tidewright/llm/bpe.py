"""Byte-level BPE by a segment tree over adjacent pair ranks (operator 9).

The leaves hold, for each pair of adjacent symbols, its merge rank and place; the root therefore names the
leftmost pair of the lowest rank. A merge changes three leaves, each repaired along one path to the root, until
the root holds no mergeable pair: O(n log n) for a pretoken of n bytes, however long. Short pretokens are merged
many at a time, their trees as rows of one array; each distinct pretoken of a batch is merged once and a bounded
cache keeps what recurs.

Null and empty texts give no tokens. Repeated rows give equal rows. Special tokens in a text become their ids, as
in the tokenizer file. Extra columns are kept; a column named like a result is replaced by the result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewright.llm.columns import with_arrow_columns

NO_PAIR = np.iinfo(np.int64).max
#: Bytes from which a pretoken gets a tree of its own.
LONG = 64
#: Pretokens of a cache generation, and bytes that they may have in all; the cache has two.
CACHE, CACHE_BYTES = 120_000, 16 << 20
#: Distinct pretokens merged at a time.
BLOCK = 16_384
#: The pretoken pattern of byte-level BPE (fixed value); white space by the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable character by which vocabulary files write each byte: itself, or the next free one from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge ranks by pair of ids: sorted keys for arrays, a dict for single pairs."""

    def __init__(self, ranked: list[tuple[int, int, int]]) -> None:
        keys = np.array([a << 32 | b for a, b, _ in ranked], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], NO_PAIR), np.append(order, 0)
        self.made = np.array([m for *_, m in ranked], np.int64)
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(ranked)}

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NO_PAIR where they do not merge or a side is missing (below 0)."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_PAIR)


def merge_long(ids: list[int], merges: Merges) -> list[int]:
    """Merge one pretoken by its own tree. Leaf i is the pair that starts at symbol i."""
    n = len(ids)
    width = 1 << max(0, (n - 2).bit_length()) if n > 1 else 1
    rank, made = merges.rank, merges.made
    ids, following, before = [*ids], [*range(1, n), -1], [*range(-1, n - 1)]
    none = 1 << 62
    tree = [none] * (2 * width)
    shift = max(1, n.bit_length())
    for i in range(n - 1):
        r = rank.get((ids[i], ids[i + 1]))
        if r is not None:
            tree[width + i] = r << shift | i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int) -> None:
        j = following[i]
        r = rank.get((ids[i], ids[j])) if j >= 0 and ids[i] >= 0 else None
        at = width + i
        tree[at] = none if r is None else r << shift | i
        at >>= 1
        while at:
            low = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == low:
                break
            tree[at] = low
            at >>= 1

    while tree[1] < none:
        i = tree[1] & ((1 << shift) - 1)
        j = following[i]
        ids[i] = int(made[tree[1] >> shift])
        ids[j] = -1
        following[i] = following[j]
        if following[j] >= 0:
            before[following[j]] = i
        if j < width:
            put(j)
        if i < width:
            put(i)
        if before[i] >= 0:
            put(before[i])
    return [x for x in ids if x >= 0]


def merge_many(ids: np.ndarray, merges: Merges) -> np.ndarray:
    """Merge rows of byte ids, padded by -1, together. Returns the rows with -1 where symbols went."""
    n, width = ids.shape
    place = np.arange(width)
    ids = ids.copy()
    following = np.where(place + 1 < width, place + 1, -1)[None].repeat(n, 0)
    following[:, :-1][ids[:, 1:] < 0] = -1
    before = np.broadcast_to(place - 1, (n, width)).copy()
    leaf = np.full((n, width), NO_PAIR, np.int64)
    rank = merges.of(ids[:, :-1], ids[:, 1:])
    leaf[:, :-1] = np.where(rank < NO_PAIR, rank * width + place[:-1], NO_PAIR)
    tree = np.full((n, 2 * width), NO_PAIR, np.int64)
    tree[:, width:] = leaf
    half = width
    while half > 1:
        level = tree[:, half : 2 * half]
        tree[:, half // 2 : half] = np.minimum(level[:, ::2], level[:, 1::2])
        half //= 2
    live = np.flatnonzero(tree[:, 1] < NO_PAIR)
    while len(live):
        root = tree[live, 1]
        i = root % width
        j = following[live, i]
        after = following[live, j]
        ids[live, i] = merges.made[root // width]
        ids[live, j] = -1
        following[live, i] = after
        some = after >= 0
        before[live[some], after[some]] = i[some]
        prior = before[live, i]
        right = merges.of(ids[live, i], np.where(some, ids[live, after], -1))
        left = merges.of(np.where(prior >= 0, ids[live, prior], -1), ids[live, i])
        rows = np.concatenate([live, live, live[prior >= 0]])
        at = np.concatenate([j, i, prior[prior >= 0]])
        new = np.concatenate([np.full(len(live), NO_PAIR), right, left[prior >= 0]])
        tree[rows, width + at] = np.where(new < NO_PAIR, new * width + at, NO_PAIR)
        node = (width + at) >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node >>= 1
        live = live[tree[live, 1] < NO_PAIR]
    return ids


class ByteBPE:
    """Encoder and decoder of a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab, character = whole["model"]["vocab"], byte_characters()
        byte_of = {c: b for b, c in enumerate(character)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.byte_id = np.array([vocab[c] for c in character], np.int64)
        self.special = {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        found = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.text_of = [str(i) for i in range(max(self.bytes_of) + 1)]
        pieces = [self.bytes_of.get(i, b"") for i in range(len(self.text_of))]
        self.piece_size = np.array([len(x) for x in pieces])
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.split_special = regex.compile(f"({found})") if found else None
        self.pretokens = regex.compile(PATTERN).findall
        #: Ids of known pretokens, joined by commas, and the bytes that these ids decode to.
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.held = 0

    def _keep(self, pretokens: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        """Cache the ids of pretokens, ``counts`` of ``flat`` each, and what they decode to."""
        names, size = list(map(self.text_of.__getitem__, flat.tolist())), self.piece_size[flat]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.piece_start[flat], size)
        decoded, ends = self.piece_bytes[place].tobytes(), np.concatenate([[0], np.cumsum(size)])
        self.held += len(decoded)
        last = np.cumsum(counts)
        at = zip((last - counts).tolist(), last.tolist(), ends[last - counts].tolist(), ends[last].tolist(), strict=True)
        for p, (i, j, start, end) in zip(pretokens, at, strict=True):
            self.cache[p] = ",".join(names[i:j]), decoded[start:end]

    def pretokenize(self, text: str) -> list[str]:
        """Pretokens in order; a special token stands whole."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pretokens(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.pretokens(part)
        return out

    def learn(self, pretokens: set[str]) -> None:
        """Merge those pretokens that the cache lacks.

        A full cache becomes the older one, from which pretokens that come up again are taken back.
        """
        if len(self.cache) > CACHE or self.held > CACHE_BYTES:
            self.older, self.cache, self.held = self.cache, {}, 0
        new = []
        for p in pretokens:
            if p not in self.cache:
                known = self.older.get(p)
                if known is None:
                    new.append(p)
                else:
                    self.cache[p] = known
                    self.held += len(known[1])
        raw = [p.encode() for p in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        for k in np.flatnonzero((size > LONG) | np.array([p in self.special for p in new], bool)).tolist():
            ids = [self.special[new[k]]] if new[k] in self.special else merge_long(self.byte_id[np.frombuffer(raw[k], np.uint8)].tolist(), self.merges)
            self._keep([new[k]], np.array(ids), np.array([len(ids)]))
            size[k] = 0
        width = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(size, 1))).astype(int))
        for w in np.unique(width[size > 0]).tolist():
            chosen = np.flatnonzero((width == w) & (size > 0))
            for part in np.split(chosen, range(BLOCK, len(chosen), BLOCK)):
                self._learn_short([new[k] for k in part.tolist()], [raw[k] for k in part.tolist()], size[part], w)

    def _learn_short(self, pretokens: list[str], raw: list[bytes], size: np.ndarray, width: int) -> None:
        ids = np.full((len(raw), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        merged = merge_many(ids, self.merges)
        held = merged >= 0
        self._keep(pretokens, merged[held], held.sum(1))

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Token count, hash of the ids and hash of the decoded text of each text.

        The decoded text is that of the ids: their bytes, read as UTF-8. The bytes of a pretoken's ids are put together
        once, when the ids are made.
        """
        for k in range(0, len(texts), 256):
            split = [self.pretokenize(t) if t else [] for t in texts[k : k + 256]]
            self.learn(set().union(*split))
            for s in split:
                made = list(map(self.cache.__getitem__, s))
                ids = ",".join([i for i, _ in made])
                decoded = b"".join([b for _, b in made]).decode("utf-8", "replace")
                yield (
                    ids.count(",") + 1 if s else 0,
                    hashlib.sha256(ids.encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                )

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text."""
        pretokens = self.pretokenize(text) if text else []
        self.learn(set(pretokens))
        return [int(i) for p in pretokens for i in self.cache[p][0].split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of token ids, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    """One tokenizer for each file and Python worker."""
    return ByteBPE(path)


def bpe_encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``token_ids`` (array<int>) to each row. ``path`` is read by every worker, as an installed package's file."""

    def encode(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = tokenizer(path)
        return {"token_ids": pa.array([bpe.encode(t) for t in batch[text].to_pylist()], pa.list_(pa.int32()))}

    return with_arrow_columns(docs, encode, "token_ids array<int>")


def bpe_digest(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` to each row, without keeping the ids."""

    def digest(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = list(tokenizer(path).digests(batch[text].to_pylist()))
        n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        return {
            "n_tokens": pa.array(n, pa.int64()),
            "ids_sha256": pa.array(ids, pa.string()),
            "decoded_sha256": pa.array(decoded, pa.string()),
        }

    return with_arrow_columns(docs, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
