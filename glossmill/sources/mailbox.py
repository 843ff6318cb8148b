"""Mail files as a table of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import mail_date
from ..scratch import written


def parse_messages(raw: DataFrame, separator: str = r"(?im)^-*\s*end of message.*$") -> DataFrame:
    """(source, number, sender, recipient, copy, subject, at, text) of texts (source, value) that hold
    several messages; parts without any header are left out, absent fields are null."""
    return _messages(raw.select("source", F.posexplode(F.split("value", separator)).alias("number", "m")))


def _messages(rows: DataFrame) -> DataFrame:
    """The fields of messages (source, number, m)."""
    cut = F.split(F.regexp_replace("m", r"^\s+", ""), r"\r?\n\r?\n", 2)
    rows = rows.select("source", "number", F.get(cut, F.lit(0)).alias("head"), F.get(cut, F.lit(1)).alias("text"))

    def header(name: str):
        found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*)$", 1)
        return F.when(found != "", F.trim(F.regexp_replace(found, r"\s+", " ")))

    at = mail_date(F.coalesce(header("date"), header("sent")))
    out = rows.select("source", "number", header("from").alias("sender"), header("to").alias("recipient"), header("cc").alias("copy"), header("subject").alias("subject"), at.alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    return out.filter("sender is not null or recipient is not null or subject is not null")


def read_split_mailbox(spark: SparkSession, path: str, separator: str = "\n\nFrom ") -> DataFrame:
    """The messages of all files at a path, as ``parse_messages`` gives them, where one text stands between messages.

    A file of any size is read by as many tasks as it has splits: a message belongs to the split in which it begins.
    Messages are numbered through each file, from the counts of its splits.
    """
    found = spark.read.option("lineSep", separator).text(path)
    found = found.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("m"))
    found = written(found, "messages")
    splits = found.groupBy("source", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = found.join(splits, ["source", "_start"]).select("source", (F.col("_before") + F.col("_id") - F.col("_first")).cast("int").alias("number"), "m")
    return _messages(numbered)


def read_mailbox(spark: SparkSession, path: str) -> DataFrame:
    """The messages of all files at a path; a file is read by one task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return parse_messages(files)
