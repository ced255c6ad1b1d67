"""Corpus pipeline over ``documents``: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. SQL can't express the trained field of the first stage or the merges of the last, so
there is no ORACLE_SQL; the tests hold run() against brute force.

Defined cases, the stages' own taken together: a null, empty or wordless text fails the quality rules and
goes in the first stage; a null doc_id or any other null column is kept as it is; repeated rows are judged
alike, lose the same lines, and one of them stays in the jaccard join, as of all texts that tie; very
long texts are worked on whole; empty documents, labels or benchmark tables give an empty result, base rules
alone, or no contamination; columns that ``documents`` has beyond the usual ones pass all stages but the last,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, common, decontaminate, jaccard, lines, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier one."""
    return lines.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at the similarity."""
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and hash of each document's ids, and a hash of what they decode to."""
    return bpe.digests(docs, *bpe.public())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level bpe", byte_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared checkpoint folder before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
