"""A training corpus from documents: quality, near duplicates, secrets, mixture, pieces; each stage reads what the one before it wrote.

All stages: texts of any length are read whole; an empty table gives an empty one; columns beside those that a stage speaks of pass through as
they are, whatever their names and types. What null and empty texts, null keys, ties and repeated rows come to is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillframe.llm.common import ship, stored
from rillframe.llm.mixing import take_mix
from rillframe.llm.ngram_join import keep_first
from rillframe.llm.pieces import encode_sampled
from rillframe.llm.quality import keep_quality
from rillframe.llm.queries import PIECES
from rillframe.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, all columns as they are.

    Null and empty texts are judged by their all-zero statistics; null keys and repeated rows like others. Null labels teach nothing.
    """
    ship(spark)
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more.

    Null, empty and blank texts link with nothing and stay, repeated or not. A null doc_id comes last; ties go to the least hash of the text, and of
    rows that repeat both one stays.
    """
    ship(spark)
    return keep_first(docs, width=5, per_cent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the scan reports masked in their texts and n_chars counted anew.

    Null texts come out empty, empty ones stay so. Null keys and repeated rows are rows like others.
    """
    ship(spark)
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents up to its target of words: a row for each epoch, the last one of a source cut where the target is met.

    Null, empty and blank texts hold no words, so the mix takes nothing from them. A null source is a source, null keys and repeated rows are rows
    like others; rows of one hash come by doc_id, size and place.
    """
    ship(spark)
    return take_mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_pieces, lossless): a sampled segmentation of each text, from which it can be decoded.

    Null and empty texts have no pieces. A null doc_id draws as an empty one; rows that repeat doc_id and text draw alike.
    """
    ship(spark)
    return encode_sampled(docs, PIECES, keep=["doc_id", "source"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("pieces", pieces)]

#: SQL expresses neither the classifier nor the segmentations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
