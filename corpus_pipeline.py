"""From documents to sampled token ids: quality rules, near-dedup, substring dedup, decontamination, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strataweb.llm import _common as c
from strataweb.llm import decontaminate, pieces, quality, simhash, substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule, of hosts that aren't rejected.

    Null, empty and short texts fail; documents without a source are judged on their own, repeated rows each.
    """
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Null and empty texts are one group; documents without a doc_id stay, and so do rows that repeat the doc_id that stays.
    """
    return simhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; a document that has none left goes, one that loses none stays as it is.

    Null and empty texts stay; documents without a doc_id keep their words.
    """
    return substrings.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, c.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each document, with their ids and inclusion scores.

    A null text has a row of nulls, an empty one the empty segmentation; equal keys and texts get equal samples.
    """
    return pieces.sampled(docs, "doc_id", "lang", "source")


#: In every stage other columns, whatever their names, stay as they are until the last, and no documents give no rows.
STAGES = [
    ("quality rules", quality_rules), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("decontamination", decontamination), ("encoding", encoding),
]
#: Fingerprints by XXH64 and lattice sampling are beyond SQL; tests/llm/test_cases.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again; a stage's table goes once the next one's is written."""
    docs, top = c.table(spark, sf_dir, "documents"), f"{c.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            c.remove(spark, f"{top}/{k - 1}")
    return docs
