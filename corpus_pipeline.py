"""A corpus pipeline: five stages, each of which works on all rows that the one before has kept.

Defined cases: null and empty texts fail the first stage's base rules and go; an empty table stays empty through all stages;
of rows equal in doc_id and text one stays, as they are one class of near-duplicates; rows of one doc_id with other texts are judged
apart; columns besides doc_id, text and n_chars pass through the first four stages whatever their names, and the last one has its own columns.

A stage's own tables are deleted when its result is written, and its input when the next one's is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import line_dedup, minhash, quality, segmentation, templates
from shardloom.llm.common import forget, stored_alone, table
from shardloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score below the threshold go."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of windows of three lines go from the texts; n_chars follows."""
    return line_dedup.shortened(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark question go."""
    return templates.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, rank and ids of the sampled segmentations of every text, with their scores and the check of their decoding."""
    return segmentation.sample(docs, vocabulary("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The likelihood ratios, signatures and random draws are hashes that SQL doesn't have; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        before, docs = docs, stored_alone(lambda: stage(spark, docs, sf_dir), f"stage-{i}-{name.replace(' ', '-')}")  # noqa: B023
        forget(before)
