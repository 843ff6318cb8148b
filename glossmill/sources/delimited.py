"""Colon-separated rows with escapes, and seed lists of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_fields(line: Column) -> Column:
    """The fields of a line: parted by ``:``, where ``!`` keeps the next character as it is."""
    closed = F.when(line.rlike("^(?:[^!]|!.)*:$"), line).otherwise(F.concat(line, F.lit(":")))
    found = F.regexp_extract_all(closed, F.lit("((?:[^:!]|!.)*):"), 1)
    return F.transform(found, lambda f: F.regexp_replace(f, "!(.)", "$1"))


def read_delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of text columns; missing fields are null, comment lines (#) and empty ones are left out."""
    rows = spark.read.text(path).filter("value != '' and not startswith(value, '#')").select(split_fields(F.col("value")).alias("f"))
    return rows.select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def write_delimited(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as such lines."""
    df.select(joined_fields(df.columns).alias("value")).write.mode(mode).text(path)


def joined_fields(columns: list[str]) -> Column:
    """The reverse of ``split_fields``; nulls are empty."""
    return F.concat(*(F.concat(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "([:!])", "!$1"), F.lit(":")) for c in columns))


def read_seeds(spark: SparkSession, path: str, priority: float = 5000.0) -> DataFrame:
    """The ``seed_links`` of a file."""
    return seed_links(spark.read.text(path), priority)


def seed_links(lines: DataFrame, priority: float = 5000.0) -> DataFrame:
    """(url, status, priority) of lines (value): one link a line, ``#`` comments, ``!`` before links to skip."""
    rows = lines.select(F.trim("value").alias("l")).filter("l != '' and not startswith(l, '#')")
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("l", r"^!\s*", ""), "^https?://", ""), "/$", "")
    return rows.select(url.alias("url"), F.when(F.col("l").startswith("!"), "Skip").otherwise("New").alias("status"), F.lit(priority).alias("priority"))
