"""Language identification by rank-order n-gram profiles (operator 2).

A language's profile is the ranking of its most frequent letter 1- to 3-grams, words being padded by a blank on
both sides. A document gets the language whose profile is at the least out-of-place distance from the document's
own ranking: the sum over its n-grams of how far the ranks lie apart, and the profile length for an n-gram that the
profile lacks. Ties go to the first language by code point.

Null texts and texts without a letter are ``und`` with score 0; so is all, where nothing could be learned. Repeated
rows give equal rows and are learned from once; different texts of one id are each learned from. Extra columns are kept; a column named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.columns import with_arrow_columns

UNKNOWN = "und"
#: N-grams of a profile and, at most, of a document's ranking.
PROFILE = 400
#: Texts, about, from which each language's profile is learned; all its texts, if it has fewer.
TRAIN_PER_LANGUAGE = 1500
_BITS = 21
_BLANK = 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """The letter 1- to 3-grams of a text, each as one integer of its code points, unsorted."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    x = np.concatenate([[0], np.where(_letters()[x], x, 0), [0]])
    keep = x != 0
    keep[1:] |= keep[:-1]
    keep[0] = True
    x = np.where(x[keep] != 0, x[keep], _BLANK)
    if len(x) < 2:
        return np.empty(0, np.int64)
    pairs = x[:-1] << _BITS | x[1:]
    triples = (pairs[:-1] << _BITS | x[2:])[x[1:-1] != _BLANK]
    return np.concatenate([x[x != _BLANK], pairs, triples])


def ranking(text: str | None, size: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first; equally frequent ones by code point."""
    grams = ngrams(text)
    if not len(grams):
        return grams
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff(first, append=len(grams))
    grams = grams[first]
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Languages, the n-grams of any profile in order, and each profile's rank of each of them."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int = PROFILE

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranking(text, self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        known = self.grams[at] == own
        ranks = np.where(known, self.ranks[:, at], 2 * self.size)
        away = np.minimum(np.abs(ranks - np.arange(len(own))), self.size).sum(1)
        best = int(away.argmin())
        return self.languages[best], 1.0 - float(away[best]) / (self.size * len(own))


def learn_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
    size: int = PROFILE, per_language: int = TRAIN_PER_LANGUAGE,
) -> Profiles:
    """Profiles of the languages of labelled texts; rows without text, label or id are not learned from.

    About ``per_language`` texts of each language are taken by a hash of their id. Only the profiles reach the
    driver: languages times ``size`` rows.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles([], np.array([np.iinfo(np.int64).max]), np.empty((0, 1), np.int64), size)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for language, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                texts.setdefault(language, []).append(ngrams(t))
            for language, grams in texts.items():
                gram, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    totals = (
        rows.where(part).distinct().mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("r", F.row_number().over(by_rank) - 1).where(F.col("r") < size).collect()
    languages = sorted({r["lang"] for r in top}, key=lambda x: x.encode())
    grams = np.array(sorted({r["gram"] for r in top}) + [np.iinfo(np.int64).max], np.int64)
    ranks = np.full((len(languages), len(grams)), 2 * size, np.int64)
    place = {x: i for i, x in enumerate(languages)}
    for r in top:
        ranks[place[r["lang"]], np.searchsorted(grams, r["gram"])] = r["r"]
    return Profiles(languages, grams, ranks, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (1 for an equal ranking, 0 for one that shares nothing) to each row."""

    def predict(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = [profiles.predict(t) for t in batch[text].to_pylist()]
        return {"lang_pred": pa.array([x for x, _ in out], pa.string()), "score": pa.array([s for _, s in out], pa.float64())}

    return with_arrow_columns(docs, predict, "lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a row's id falls in the held-out fold; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))
