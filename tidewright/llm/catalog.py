"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import dialogue, oracles
from tidewright.llm.bpe import bpe_digest
from tidewright.llm.chroma import align, fingerprint
from tidewright.llm.html import extract
from tidewright.llm.langid import held_out, identify, learn_profiles
from tidewright.llm.lattice import near_duplicates
from tidewright.llm.licenses import scan_licenses
from tidewright.llm.mixing import mix_decisions
from tidewright.llm.paritysketch import jaccard_components
from tidewright.llm.quality import learn_quality, score_quality
from tidewright.registry import Registry
from tidewright.session import table

REGISTRY = Registry()
#: Rows of an Arrow batch: texts can be long, so batches are kept small.
ARROW_ROWS = "250"


#: Bytes up to which a table is dealt over all cores before the work on it.
SMALL_TABLE = 20 << 20


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, read in small Arrow batches.

    A small table has fewer row groups than there are cores, so its rows are dealt out; larger ones are never moved.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    rows = table(spark, sf_dir, name)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_TABLE else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return source(spark, sf_dir, "documents")


@REGISTRY.query("op9_bpe_segment_tree")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@REGISTRY.query("op2_language_profiles")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn_profiles(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), profiles).drop("text")


@REGISTRY.query("op7_subword_quality")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    aside = held_out(folds=5, fold=0)
    model = learn_quality(docs, table(spark, sf_dir, "labels").where(~aside))
    return score_quality(docs.withColumn("held_out", aside), model).drop("text")


@REGISTRY.query("op6_parity_sketch_join", oracles.JACCARD)
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


@REGISTRY.query("op10_lattice_near_duplicates", oracles.COSINE)
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@REGISTRY.query("op3_cube_mixing")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_decisions(documents(spark, sf_dir))
    return out.select(out["id"].alias("doc_id"), "size", "source_size", "target", "taken", "source", "repeats")


@REGISTRY.query("op4_license_containment_join", oracles.LICENSES)
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "blocks")


@REGISTRY.query("op5_perspective_rotation", dialogue.ORACLE_SQL)
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.rotate(table(spark, sf_dir, "conversations"))


@REGISTRY.query("op8_crf_main_text")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(source(spark, sf_dir, "pages")).drop("html")


@REGISTRY.query("op1_chroma_alignment")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables hold no sound: a text's bytes are taken as a recording of unsigned 8-bit PCM.
    recordings = documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("pcm"))
    asked = F.col("doc_id") % 50 == 0
    return align(fingerprint(recordings, asked=asked).drop("pcm"), asked, "doc_id")
