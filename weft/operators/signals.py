"""Signals and their algebra. Scores add up where both sides have a document; NOT is taken over a universe of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, SCORE = "_doc_id", "_score"


def signal(df: DataFrame, doc_id: str | Column, score: str | Column | float = 0.0) -> DataFrame:
    """A signal from the rows of df: ids that are null are left out."""
    value = F.lit(score) if isinstance(score, (int, float)) else F.col(score) if isinstance(score, str) else score
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return df.select(key.cast("bigint").alias(ID), value.cast("double").alias(SCORE)).where(F.col(ID).isNotNull())


def union(*signals: DataFrame) -> DataFrame:
    """OR: every document of any signal, scores summed: one shuffle for any number of signals."""
    return reduce(DataFrame.unionByName, signals).groupBy(ID).agg(F.sum(SCORE).alias(SCORE))


def intersect(*signals: DataFrame) -> DataFrame:
    """AND: documents that all signals have, scores summed: one shuffle for any number of signals."""
    tagged = [s.select(ID, SCORE, F.lit(i).alias("_of")) for i, s in enumerate(signals)]
    every = reduce(DataFrame.unionByName, tagged).groupBy(ID).agg(F.sum(SCORE).alias(SCORE), F.count_distinct("_of").alias("_n"))
    return every.where(F.col("_n") == len(signals)).select(ID, SCORE)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(ID), ID, "left_anti")


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    """NOT: documents of the universe that a lacks, with score 0. Rows that a three-valued predicate left undecided are in it."""
    return universe.select(ID).join(a.select(ID), ID, "left_anti").select(ID, F.lit(0.0).alias(SCORE))


def top_k(a: DataFrame, k: int) -> DataFrame:
    """The k best scores; of equals the least id."""
    return a.orderBy(F.desc(SCORE), ID).limit(k)


def with_scores(a: DataFrame, score: Column) -> DataFrame:
    return a.select(ID, score.cast("double").alias(SCORE))


def threshold(a: DataFrame, least: float) -> DataFrame:
    """Scores above `least`, less it: sparse features."""
    return a.where(F.col(SCORE) > least).select(ID, (F.col(SCORE) - least).alias(SCORE))


def attach(base: DataFrame, a: DataFrame, doc_id: str) -> DataFrame:
    """base's rows of the signal's documents, with _score."""
    return base.join(a.withColumnRenamed(ID, "_signal_id"), F.col(doc_id) == F.col("_signal_id")).drop("_signal_id")


def facets(rows: DataFrame, *fields: str) -> DataFrame:
    """(facet_field, facet_value, facet_count) over rows; nulls don't count. One pass for all fields."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet_field"), F.col(f).cast("string").alias("facet_value")) for f in fields))).alias("x")
    return rows.select(each).select("x.*").where("facet_value is not null").groupBy("facet_field", "facet_value").agg(F.count("*").alias("facet_count"))


def staged(first: DataFrame, *stages: tuple[DataFrame | None, int | float]) -> DataFrame:
    """A cascade: (signal, cutoff) pairs. Survivors so far take the stage's score, or keep theirs where it has none; the cutoff
    keeps that many (an integer) or those with at least that score."""
    now = first
    for own, cutoff in stages:
        if own is not None:
            now = now.join(own.withColumnRenamed(SCORE, "_new"), ID, "left").select(ID, F.coalesce("_new", SCORE).alias(SCORE))
        now = top_k(now, cutoff) if isinstance(cutoff, int) else now.where(F.col(SCORE) >= cutoff)
    return now
