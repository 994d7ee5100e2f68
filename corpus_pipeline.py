"""The corpus pipeline: documents are rid of toxic texts, near copies, repeated passages and benchmark texts, then encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of ``docs``.

Every stage takes null, empty and very long texts, null and repeated ids, empty tables and further columns. Texts without words are never toxic,
copies, repeats or contaminated, so they stay; rows without an id stay in the stages that compare documents. Of rows with one id and one set of
shingles one stays in near_copies; ids that stand for several texts keep one row for each text that isn't a near copy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest import ship
from palimpsest.llm import decontaminate, jaccard, passages, pieces, toxicity
from palimpsest.llm._shared import shared_dir


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go. The model is learnt from the labels of documents of the whole table."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.judged(docs, labels).where("predicted = 0").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of 5-word shingles with a similarity of 0.8 or more link."""
    ship(spark)
    return jaccard.one_of_each(docs, n=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage that near-repeats one of a smaller document is cut out."""
    ship(spark)
    return passages.without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    ship(spark)
    return pieces.digest(docs, pieces.default_path())


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("substring_dedup", repeats), ("decontamination", benchmark), ("sentencepiece", encoded)]

#: Toxicity learns a model and encoding follows a vocabulary: neither is SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are written to the shared folder and reread."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return docs
