"""Readability of spans and pages, and the quality of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_median(scored: DataFrame, keys: Sequence[str], score: str = "score", weight: str = "n_chars") -> DataFrame:
    """The first score, from below, at which the cumulative weight passes half (whole division) of the total.

    Equal scores are summed first, so a group's window holds its distinct scores only.
    """
    distinct = scored.groupBy(*keys, score).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    run = distinct.withColumn("__run", F.sum("__w").over(w.orderBy(score))).withColumn("__all", F.sum("__w").over(w))
    return run.where(F.col("__run") > F.floor(F.col("__all") / 2)).groupBy(*keys).agg(F.min(score).alias(score))


def roll_up(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overall quality by shares of scanned and broken pages, with mean and least confidence.

    none without pages' text, low over half scanned, medium over 0.3 broken, else high.
    """
    scanned = F.avg((F.col("page_class") == "scanned").cast("double"))
    broken = F.avg((F.col("page_class") == "broken_vector").cast("double"))
    return pages.groupBy(key).agg(
        F.when(F.sum("n_chars") == 0, F.lit("none")).when(scanned > 0.5, F.lit("low")).when(broken > 0.3, F.lit("medium")).otherwise(F.lit("high")).alias("overall"),
        scanned.alias("scanned_share"),
        broken.alias("broken_share"),
        F.avg("confidence").alias("mean_confidence"),
        F.min("confidence").alias("least_confidence"),
    )


def coverage(words: Column, known: Column) -> Column:
    """Share of words that a list holds; without words 0."""
    n = F.size(words)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.filter(words, lambda w: F.array_contains(known, w))) / n)


def in_word_list(words: DataFrame, listed: DataFrame, word: str = "word") -> DataFrame:
    """Words that a list holds, in any case. The list is joined by hash; Spark broadcasts it if it is small."""
    return words.join(listed.select(F.lower(word).alias("__listed")).distinct(), F.lower(word) == F.col("__listed"), "left_semi")
