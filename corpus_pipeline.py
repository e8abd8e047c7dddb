"""The pipeline over documents: languages, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and what the one before kept; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import jaccard_join, langid, packing, secret_scan
from weft.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with it in lang; those that the classifier rejects go."""
    return langid.keep_identified(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group that n-gram Jaccard connects."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets cut out of their texts."""
    return secret_scan.redacted(docs.select(*COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: the training sequence it is packed into, and where."""
    return packing.best_fit_packing(docs)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("best-fit packing", sequences)]

#: SQL can express neither the classifier nor the packing; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
