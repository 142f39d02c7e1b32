"""The corpus pipeline: language, quality, near duplicates, source mix, tokens.

Each stage takes the rows that its predecessor kept, whole texts of any length. All but the last return the columns of
``documents``, and any others that the table has.

1. Language: documents without a letter, null and empty ones among them, or unlike every learned language, go. A null
   ``lang`` or id is not learned from. Of languages equally near the first by code point counts.
2. Quality: documents that the classifier marks low go; rows without an id are judged, not learned from.
3. Near duplicates: one row of each group of linked documents stays: that of least id and, of several such, that of least
   mark over all columns. So of rows equal in all columns one stays, and rows of one id but of texts that do not link
   all stay. Rows without an id link with nothing and stay.
4. Mix: each source, null being one, is brought near its target; a row may stay out, stay or come twice.
5. Tokens: each row's token count and digests of its ids and decoded text; repeated rows give equal rows.

An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.bpe import bpe_digest
from tidewright.llm.catalog import ARROW_ROWS
from tidewright.llm.langid import UNKNOWN, held_out, identify, learn_profiles
from tidewright.llm.mixing import mix
from tidewright.llm.paritysketch import one_of_each
from tidewright.llm.quality import learn_quality, score_quality
from tidewright.llm.shared import ensure_checkpoint_dir, remove_folder

#: Least share of the ranking that a document and its language must have in common.
MIN_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language (operator 2)."""
    profiles = learn_profiles(docs.where(~held_out()))
    known = identify(docs, profiles).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return known.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (operator 7)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(folds=5, fold=0))
    scored = score_quality(docs, learn_quality(docs, labels))
    return scored.where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 6)."""
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken (operator 3)."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests (operator 9)."""
    return bpe_digest(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json")).drop("text")


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: The classifiers and the draw of the mix are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared checkpoint folder and read again.

    A stage's table is removed once the next one is written; the last stays, since the result reads it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{os.urandom(8).hex()}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            remove_folder(spark, last)
        last = path
    return docs
