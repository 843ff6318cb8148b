"""Folders of files as a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_digest, media_kind, path_words


def scan_folder(spark: SparkSession, path: str, known: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """(path, size, modified, kind, content) of all files below a folder whose path is not in ``known``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    if known is not None:
        rows = rows.join(known.select("path").distinct(), "path", "left_anti")
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), media_kind(F.col("path")).alias("kind"), "content")


def documentation_text(source: Column) -> Column:
    """The documentation blocks (``=head`` to ``=cut``) of a program's source."""
    blocks = F.regexp_extract_all(source, F.lit(r"(?ms)^=(?:pod|head\d|over|item)\b(.*?)(?:^=cut|\z)"), 1)
    return F.regexp_replace(F.array_join(blocks, "\n"), r"(?m)^=\w+", "")


def visible_text(html: Column) -> Column:
    """Mark-up, scripts and styles as blanks: the pattern form of reading a page."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), r"\s+", " "))


def file_texts(files: DataFrame) -> DataFrame:
    """(path, digest, description, text): text files as they are, pages without mark-up, programs'
    documentation; of all others the words of the path."""
    text = F.decode("content", "UTF-8")
    path = F.lower("path")
    own = F.when(path.rlike(r"\.html?$"), visible_text(text)).when(path.rlike(r"\.(pl|pm|pod)$"), documentation_text(text)).when(path.rlike(r"\.(txt|text|md|csv)$"), text).otherwise(path_words(F.col("path")))
    return files.select("path", content_digest(F.col("content")).alias("digest"), path_words(F.col("path")).alias("description"), own.alias("text"))
