"""Cuts of long texts where the vocabulary changes.

A text is taken in blocks of 20 tokens. Each gap between blocks gets the overlap of the word sets
beside it, summed with its neighbours' and smoothed; a gap whose valley is deeper than the mean
by less than a deviation is a cut. Texts with fewer than three blocks have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Differences up to this come from the order of sums.
_NOISE = 1e-12


def blocks(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block, words): the distinct lower-case words of each run of ``size`` words."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9]+)"), 1)
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / size).cast("int"))
    rows = rows.select("doc_id", F.explode(F.transform(starts, lambda k: F.struct(k.alias("block"), F.array_distinct(F.slice("all", k * size + 1, size)).alias("words")))).alias("b"))
    return rows.select("doc_id", "b.block", "b.words")


def gap_scores(found: DataFrame) -> DataFrame:
    """(doc_id, block, overlap, smooth, depth) of the gap after each block but the last."""
    order = Window.partitionBy("doc_id").orderBy("block")
    near = order.rowsBetween(-1, 1)
    after = F.lead("words").over(order)
    rows = found.withColumn("after", after).filter("after is not null")
    rows = rows.select("doc_id", "block", (F.size(F.array_intersect("words", "after")) / F.size(F.array_union("words", "after"))).alias("overlap"))
    rows = rows.withColumn("smooth", F.avg("overlap").over(near))
    depth = F.lag("smooth").over(order) + F.lead("smooth").over(order) - 2 * F.col("smooth")
    return rows.withColumn("depth", F.coalesce(depth, F.lit(0.0)))


def cuts(scores: DataFrame, compatible: bool = False) -> DataFrame:
    """(doc_id, block, depth): gaps deeper than mean - deviation and above 0 (both by more than ``_NOISE``).

    ``compatible`` divides the root of the summed squares by the count in place of a deviation.
    """
    all_ = Window.partitionBy("doc_id")
    mean = F.avg("depth").over(all_)
    spread = F.sum(F.pow(F.col("depth"), 2)).over(all_) - F.count("*").over(all_) * mean * mean
    spread = F.sqrt(F.greatest(spread, F.lit(0.0)))
    dev = spread / F.count("*").over(all_) if compatible else spread / F.sqrt(F.count("*").over(all_))
    return scores.withColumn("limit", mean - dev).filter((F.col("depth") > F.col("limit") + _NOISE) & (F.col("depth") > _NOISE)).select("doc_id", "block", "depth")
