"""Quality classification by supervised subword embeddings (operator 7).

Words and their byte 3- and 4-grams, the blanks around a word included, are hashed into buckets. Each bucket has a
learned vector; a document is the mean of its features' vectors, and a softmax layer over it gives the label. All is
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.

With the vectors fixed, the label margin of a document is the mean of one number for each feature, so scoring is a
table look-up at every byte. Null and empty texts have no feature and get the score of the bias alone. Repeated rows
give equal rows. Extra columns are kept; a column named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.columns import with_arrow_columns
from tidewright.llm.text import LOWER, SPACE, U64, Words, mix, row_chunks, running_hash, span_hashes, spans, utf8

BUCKET_BITS = 16
DIMENSIONS = 16
#: Labelled rows, at most, that are learned from.
TRAIN_ROWS = 1500
#: Steps of gradient descent, about: small samples are gone over more often.
STEPS = 25_000
RATE = 0.5
THRESHOLD = 0.3


def features(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, the buckets of their features, and the row (from 0) of each feature; whole texts are read."""
    data, offsets = utf8(column)
    shift = U64(64 - BUCKET_BITS)
    for rows in row_chunks(offsets):
        at = offsets[rows.start : rows.stop + 1]
        size = np.diff(at)
        row = np.repeat(np.arange(len(size)), size)
        padded = np.full(int(at[-1] - at[0]) + len(size) + 1, 0x20, np.uint8)
        padded[np.arange(len(row)) + row + 1] = LOWER[data[at[0] : at[-1]]]
        blank = SPACE[padded]
        padded[blank] = 0x20
        bounds = at - at[0] + np.arange(len(size) + 1)
        starts, ends = spans(~blank, bounds)
        words = Words(rows, padded, starts, ends, np.searchsorted(starts, bounds + 1))
        buckets, owners = [words.hashes() >> shift], [words.row_of_word()]
        owner = np.searchsorted(bounds, np.arange(len(padded)), "right") - 1
        sums, blanks = running_hash(padded), np.concatenate([[0], np.cumsum(blank)])
        with np.errstate(over="ignore"):
            for n in (3, 4):
                i = np.arange(max(0, len(padded) - n + 1))
                i = i[blanks[i + n - 1] == blanks[i + 1]]
                buckets.append(mix(span_hashes(sums, i, i + n) + U64(n)) >> shift)
                owners.append(owner[i])
        yield rows, np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass
class QualityModel:
    """What scoring needs: each bucket's share in the margin of label 1 over label 0, and the bias."""

    margin: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for rows, bucket, owner in features(column):
            n = rows.stop - rows.start
            total = np.bincount(owner, self.margin[bucket], n)
            out[rows] = total / np.maximum(np.bincount(owner, minlength=n), 1)
        return 1 / (1 + np.exp(-(out + self.bias)))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, rate: float = RATE, seed: int = 7) -> QualityModel:
    """Learn from (distinct buckets, their counts, label 0 or 1)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)) / DIMENSIONS
    weights, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    epochs, done = -(-steps // max(1, len(samples))), 0
    steps = epochs * len(samples)
    for _ in range(epochs if samples else 0):
        for k in rng.permutation(len(samples)):
            bucket, count, label = samples[k]
            step = rate * (1 - done / steps)
            share = count / max(1, count.sum())
            mean = share @ vectors[bucket]
            odds = np.exp((z := weights @ mean + bias) - z.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = error @ weights
            weights -= step * np.outer(error, mean)
            bias -= step * 0.1 * error
            vectors[bucket] -= step * np.outer(share, back)
            done += 1
    return QualityModel((vectors @ (weights[1] - weights[0])).astype(np.float64), float(bias[1] - bias[0]))


def learn_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", id_col: str = "doc_id",
    max_rows: int = TRAIN_ROWS,
) -> QualityModel:
    """Learn from at most ``max_rows`` labelled documents, the first by a hash of their id.

    Rows without an id or label are left out; a document with several labels has the largest, and any above 0
    counts as 1. Of several texts of one id the first by their hash is learned from. The sample's features come to the driver.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")

    def featurise(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bucket, count = [], []
        for rows, b, owner in features(batch["text"]):
            key, n = np.unique(owner << BUCKET_BITS | b, return_counts=True)
            cut = np.searchsorted(key >> BUCKET_BITS, np.arange(1, rows.stop - rows.start))
            bucket += np.split(key & ((1 << BUCKET_BITS) - 1), cut)
            count += np.split(n, cut)
        packed = [[x.astype(np.int32).tobytes() for x in column] for column in (bucket, count)]
        return {"bucket": pa.array(packed[0], pa.binary()), "n": pa.array(packed[1], pa.binary())}

    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    found = with_arrow_columns(rows, featurise, "bucket binary, n binary", ("text",))
    rows = sorted(found.collect(), key=lambda r: r["id"])
    return train([(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["n"], np.int32), r["label"]) for r in rows])


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from the threshold on) to each row."""

    def score(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        s = model.scores(batch[text])
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return with_arrow_columns(docs, score, "score double, predicted int")
