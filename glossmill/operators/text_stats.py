"""Statistics of words and letters over a collection, and quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_text
from .relational import numbered


def all_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): each run of letters of each text, lower-cased; stop words stay."""
    return docs.select(F.explode(F.regexp_extract_all(F.lower(ascii_text(F.col(text_col))), F.lit("([a-z]+)"), 1)).alias("word"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n)."""
    return all_words(docs, text_col).groupBy("word").agg(F.count("*").alias("n"))


def summary_row(counts: DataFrame) -> DataFrame:
    """One row: words, types and the mean length of a word."""
    return counts.agg(F.sum("n").alias("n_words"), F.count("*").alias("n_types"), (F.sum(F.length("word") * F.col("n")) / F.sum("n")).alias("mean_length"))


def word_length_histogram(counts: DataFrame) -> DataFrame:
    """(length, n) over all occurrences."""
    return counts.groupBy(F.length("word").alias("length")).agg(F.sum("n").alias("n"))


def letter_histogram(counts: DataFrame) -> DataFrame:
    """(letter, n) over all occurrences."""
    letters = counts.select(F.explode(F.regexp_extract_all("word", F.lit("(.)"), 1)).alias("letter"), "n")
    return letters.groupBy("letter").agg(F.sum("n").alias("n"))


def frequency_of_frequencies(counts: DataFrame) -> DataFrame:
    """(n, types): how many words occur n times."""
    return counts.groupBy("n").agg(F.count("*").alias("types"))


def ranked_frequencies(counts: DataFrame) -> DataFrame:
    """(word, n, rank): words from frequent to rare, ties by word.

    Words are dealt by range of count and word, and ranks follow from the sizes of the ranges, so no task
    sees the vocabulary, nor all the words that occur once.
    """
    rows = counts.select("word", "n", (-F.col("n")).alias("_down"))
    return numbered(rows, ["_down", "word"], "rank").select("word", "n", "rank")


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(predicted, actual, n)."""
    return rows.groupBy(F.col(predicted).alias("predicted"), F.col(actual).alias("actual")).agg(F.count("*").alias("n"))


def cluster_precision(rows: DataFrame, cluster: str, category: str) -> DataFrame:
    """(cluster, n, precision): the share of the most frequent category."""
    counts = rows.groupBy(F.col(cluster).alias("cluster"), F.col(category).alias("category")).agg(F.count("*").alias("n"))
    return counts.groupBy("cluster").agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("precision"))
