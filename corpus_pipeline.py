"""A training corpus from raw documents: score, deduplicate, decontaminate, encode.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and returns a DataFrame,
which is written as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``docs``. Nulls, empty and very long texts, repeated rows and empty tables are handled as
the operators' own descriptions say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, exact_dedup, minhash, piece_lattice, quality
from feedloom.llm.common import fresh, staged

#: A document is rejected below this score.
QUALITY_LIMIT = 0.3
#: Words of a shingle that near duplicates are told by.
NEAR_WORDS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score reaches the limit; repeated rows and null ids are scored like others."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("score", docs.columns)
    return docs.withColumn(score, model.score_column(F.col("text"))).filter(F.col(score) >= QUALITY_LIMIT).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id."""
    return minhash.drop_near(docs, size=NEAR_WORDS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_pieces, piece_ids, lossless`` of every document."""
    coded = piece_lattice.encode_checked(docs.select("doc_id", "lang", "source", "text"), piece_lattice.Pieces.load())
    return coded.select("doc_id", "lang", "source", F.size("encoded.ids").cast("long").alias("n_pieces"),
                        F.col("encoded.ids").alias("piece_ids"), F.col("encoded.lossless").alias("lossless"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: The scores, signatures and draws have no SQL. Tests compare every stage, and the stages in a row, with
#: plain versions (tests/llm/test_pipeline_stages.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
