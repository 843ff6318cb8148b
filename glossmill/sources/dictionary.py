"""Dictionary files: synset data and index lines as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the pointer symbols.
POINTERS = {
    "!": "antonym", "@": "hypernym", "~": "hyponym", "#m": "member_holonym", "#s": "substance_holonym", "#p": "part_holonym",
    "%m": "member_meronym", "%s": "substance_meronym", "%p": "part_meronym", "=": "attribute", "*": "entailment", ">": "cause",
    "^": "also_see", "$": "verb_group", "&": "similar_to", "<": "participle_of_verb", "\\": "pertainym",
}


def data_lines(lines: DataFrame) -> DataFrame:
    """(synset, pos, words, pointers, gloss) of synset lines (value): ``offset lex type count word id ...
    pointers ... | gloss``, numbers of words in hexadecimal. Licence lines (leading blanks) are left out."""
    rows = lines.filter(~F.col("value").startswith(" ")).select(F.split(F.split_part("value", F.lit(" | "), F.lit(1)), " +").alias("f"), F.trim(F.split_part("value", F.lit(" | "), F.lit(2))).alias("gloss"))

    def field(k):
        return F.get("f", F.lit(k) - 1)

    n = F.conv(field(4), 16, 10).cast("int")
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.regexp_replace(field(5 + 2 * i), r"\(.*\)$", ""))
    m = field(5 + 2 * n).cast("int")

    def pointer(i):
        at = 6 + 2 * n + 4 * i
        return F.struct(field(at).alias("symbol"), F.concat(field(at + 2), field(at + 1)).alias("target"))

    pointers = F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), pointer)).otherwise(F.array().cast("array<struct<symbol:string,target:string>>"))
    pos = F.when(field(3) == "s", "a").otherwise(field(3))
    return rows.select(F.concat(pos, field(1)).alias("synset"), pos.alias("pos"), words.alias("words"), pointers.alias("pointers"), "gloss")


def dictionary_tables(data: DataFrame, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """words, synsets and relations from ``data_lines``; ``counts`` is (word, synset, tag_count)."""
    members = data.select("synset", "pos", "gloss", F.explode("words").alias("name"))
    rows = members.select(F.lower("name").alias("word"), "pos", "synset", F.col("name").rlike("^[A-Z]").alias("is_entity"))
    if counts is None:
        rows = rows.withColumn("tag_count", F.lit(0).cast("long"))
    else:
        rows = rows.join(counts, ["word", "synset"], "left").withColumn("tag_count", F.coalesce("tag_count", F.lit(0).cast("long")))
    names = F.create_map(*(F.lit(x) for pair in POINTERS.items() for x in pair))
    links = data.select("synset", F.explode("pointers").alias("p")).select(names[F.col("p.symbol")].alias("relation"), F.col("synset").alias("source"), F.col("p.target").alias("target"))
    return {
        "words": rows.select("word", "pos", "synset", "tag_count", "is_entity"),
        "synsets": members.select("synset", F.lower("name").alias("word"), "gloss"),
        "relations": links.filter("relation is not null"),
    }


def exception_lines(lines: DataFrame, pos: str) -> DataFrame:
    """(word, base, pos) of exception lines (value): a form and its bases."""
    f = F.split(F.trim("value"), " +")
    return lines.filter("value != ''").select(F.element_at(f, 1).alias("word"), F.explode(F.slice(f, 2, F.size(f))).alias("base"), F.lit(pos).alias("pos"))


def tagged_words(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, word, tag) of a tagged text (doc_id, value) of the form ``word <t>``."""
    pairs = F.regexp_extract_all("value", F.lit(r"(\S+\s+<[a-z]>)"), 1)
    rows = lines.select("doc_id", F.posexplode(pairs).alias("pos", "p"))
    return rows.select("doc_id", "pos", F.regexp_extract("p", r"^(\S+)", 1).alias("word"), F.regexp_extract("p", "<([a-z])>$", 1).alias("tag"))


def marked_entities(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, token, type) of lines (doc_id, value) with ``<TYPE>token</TYPE>`` inside; comments are left out."""
    parts = F.regexp_extract_all("value", F.lit(r"(<[A-Za-z_]+>[^<]*</[A-Za-z_]+>|[A-Za-z0-9']+|[^\sA-Za-z0-9<>])"), 1)
    rows = lines.filter("not startswith(value, '#')").select("doc_id", F.posexplode(parts).alias("pos", "p"))
    kind = F.lower(F.regexp_extract("p", "^<([A-Za-z]+)[A-Za-z_]*>", 1))
    inner = F.regexp_extract("p", "^<[A-Za-z_]+>([^<]*)<", 1)
    return rows.select("doc_id", "pos", F.when(kind == "", F.col("p")).otherwise(inner).alias("token"), F.when(kind != "", kind).alias("type"))


def sense_counts(lines: DataFrame) -> DataFrame:
    """(word, synset, tag_count) of sense lines (value): ``word%type:... offset number count``, the type a
    number from 1 to 5 for noun, verb, adjective, adverb and adjective again."""
    f = F.split("value", " +")
    kind = F.regexp_extract("value", "%([1-5]):", 1)
    pos = F.translate(kind, "12345", "nvara")
    rows = lines.filter(kind != "").select(F.split_part(f[0], F.lit("%"), F.lit(1)).alias("word"), F.concat(pos, f[1]).alias("synset"), F.try_element_at(f, F.lit(4)).cast("long").alias("tag_count"))
    return rows.groupBy("word", "synset").agg(F.max("tag_count").alias("tag_count"))


def index_lines(lines: DataFrame) -> DataFrame:
    """(word, pos, n_senses) of index lines (value): ``word pos count ...``; licence lines are left out."""
    f = F.split(F.trim("value"), " +")
    return lines.filter("value != '' and not startswith(value, ' ')").select(f[0].alias("word"), f[1].alias("pos"), F.try_element_at(f, F.lit(3)).cast("long").alias("n_senses"))


def function_words(lines: DataFrame) -> DataFrame:
    """(word, pos, synset, others, gloss) of function word lines (value): ``word:tag:like words:gloss``, ``#`` for
    comments. Words that are alike share a synset, which is named by its tag and its words in order."""
    rows = lines.filter("value rlike '^[^#:]+:.:'").select(F.split("value", ":", 4).alias("f"))
    others = F.filter(F.split(F.trim(F.get("f", F.lit(2))), r"\s+"), lambda w: w != "")
    every = F.array_sort(F.array_distinct(F.concat(F.array(F.get("f", F.lit(0))), others)))
    gloss = F.trim(F.coalesce(F.get("f", F.lit(3)), F.lit("")))
    rows = rows.select(F.get("f", F.lit(0)).alias("word"), F.get("f", F.lit(1)).alias("pos"), every.alias("every"), gloss.alias("gloss"))
    return rows.select("word", "pos", F.concat("pos", F.lit(":"), F.array_join("every", " ")).alias("synset"), F.array_remove("every", F.col("word")).alias("others"), "gloss")
