"""Corpus pipeline: documents -> clean, distinct, uncontaminated documents -> the order to train on them.

Stages take ``(spark, docs, sf_dir)``; what a stage returns is written as Parquet and read again as the
next one's documents. All but the last return the columns of the documents, whatever these are called; the
last returns the training mix. Every stage judges all rows its predecessor kept:

* toxicity: rejects documents that the string-kernel machine scores 0.5 or more;
* quality: rejects documents that fail the base rules or whose posterior quality is below 0.5;
* near_duplicates: of documents linked by five-word shingles at Jaccard 0.8 or more, the one with the
  smallest id stays; rows equal in id and text count once; documents without words are linked with nothing;
* decontamination: rejects documents that hold a benchmark item (0.8 of its five-word shingles);
* mixing: per document its size, its source's size and target, the words taken and the training position.

Null texts and ids, repeated rows and empty tables go through every stage (see each operator).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from leadloom.llm import common, decontam, jaccard, mixing, quality  # noqa: E402
from leadloom.llm.queries import toxic_scores  # noqa: E402


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, place = common.numbered(docs)
    scored = toxic_scores(spark, rows, sf_dir, list(place.values()), key=place["doc_id"], text=place["text"])
    return common.renamed(scored.where(F.col("score") < 0.5), place)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.by_first_position(mixing.mix(docs))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "position")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Stages that learn a model have no SQL; tests hold the pipeline against a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir))
        common.drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
