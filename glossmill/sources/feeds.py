"""News feeds and tagged news files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feed_items(feeds: DataFrame) -> DataFrame:
    """(source, link, title, description) of the items of feeds (source, xml); items without a link are left out."""
    items = feeds.select("source", F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), 1)).alias("item"))

    def part(tag: str):
        inner = F.regexp_extract("item", rf"(?is)<{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)
        return F.when(inner != "", F.trim(inner))

    return items.select("source", part("link").alias("link"), part("title").alias("title"), part("description").alias("description")).filter("link is not null")


def tagged_stories(files: DataFrame, least_chars: int = 1000) -> DataFrame:
    """(source, number, topics, places, people, orgs, body) of SGML files (source, value); short bodies are left out."""
    stories = files.select("source", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<REUTERS\b[^>]*>(.*?)</REUTERS>"), 1)).alias("number", "s"))

    def codes(tag: str):
        return F.regexp_extract_all(F.regexp_extract("s", rf"(?is)<{tag}>(.*?)</{tag}>", 1), F.lit("(?i)<D>(.*?)</D>"), 1)

    body = F.regexp_extract("s", "(?is)<BODY>(.*?)</BODY>", 1)
    rows = stories.select("source", "number", codes("TOPICS").alias("topics"), codes("PLACES").alias("places"), codes("PEOPLE").alias("people"), codes("ORGS").alias("orgs"), body.alias("body"))
    return rows.filter(F.length("body") >= least_chars)


def weak_labels(stories: DataFrame) -> DataFrame:
    """(source, number, pos, token, type): words of the ``tagged_stories`` that their own codes name, place, person
    or org; a code's parts (``new-york``, ``de-clercq``) count each, if they have three letters or more."""
    def typed(column: str, kind: str):
        parts = F.flatten(F.transform(column, lambda x: F.split(F.lower(x), "[^a-z0-9]+")))
        return F.transform(parts, lambda w: F.struct(w, F.lit(kind))).cast("array<struct<word:string,type:string>>")

    codes = F.concat(typed("places", "place"), typed("people", "person"), typed("orgs", "org"))
    codes = F.array_distinct(F.filter(codes, lambda x: F.length(x["word"]) > 2))
    words = stories.select("source", "number", codes.alias("codes"), F.posexplode(F.regexp_extract_all("body", F.lit("([A-Za-z0-9]+)"), 1)).alias("pos", "token"))
    hits = F.filter("codes", lambda x: x["word"] == F.lower("token"))
    return words.filter(F.col("token").rlike("^[A-Z]")).select("source", "number", "pos", "token", F.explode(hits).alias("h")).select("source", "number", "pos", "token", "h.type")
