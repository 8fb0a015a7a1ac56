"""The corpus pipeline: stages that each apply one operator to all documents that the stage before kept.

A stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``. ``run`` writes each
stage's result to the shared folder and reads it back as the next stage's input, so that a lost executor costs no more
than a part of one stage.

Defined results: a null ``doc_id``, ``lang`` or ``source`` costs no row (see each operator); null, empty and blank texts
go with the first stage; repeated rows and ties are one document from the third stage on; very long texts are worked on
whole; an empty table gives no windows; further columns are carried along up to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import decontam, line_dedup, ngram_join, packing, quality_rules
from sediment.llm.tables import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and blank texts are rejected."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sites' boilerplate lines; one that was nothing else goes, and so do null and blank texts."""
    return line_dedup.drop_boilerplate(docs).where(F.trim(F.col("text"), F.lit(" \t\r\n")) != "")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of similar documents connect; all without a word stay, null texts too."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark items have; one that was mostly those goes. Null texts stay null."""
    return decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of a fixed number of tokens, filled with the documents' pieces; null and empty texts have none."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]

#: Groups of similar documents, the automaton and the bitset program have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
