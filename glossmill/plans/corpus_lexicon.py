"""A dictionary that the corpus itself gives, for the queries of the lexicon, tag and entity operators.

No dictionary is shipped. A word of ``documents`` is taken for a noun, verb or adjective as often as it follows a word that
such words follow (an article, a particle, a form of to be); the words of one part of speech with one stem, here their first
six letters, are a synset, under the synset of the least stem with the same three letters. A word that never begins with a
small letter is a name. Words that ``conversations`` use are asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Words before which nouns, verbs and adjectives stand, in the languages of the tables.
BEFORE = {
    "n": "the a an this der die das ein den des le la les un une el los las".split(),
    "v": "to and zu und et que y he it".split(),
    "a": "is are was be ist sich est es del".split(),
}
WORD = "[A-Za-zÀ-ÿ]+"
LEAST = 3  # occurrences of a word as one part of speech


def words_with_previous(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep, token, previous) of each word; previous is null for the first."""
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    each = F.transform("w", lambda x, i: F.struct(x.alias("token"), F.when(i > 0, F.lower(F.get("w", i - 1))).alias("previous")))
    return texts.select(*keep, found.alias("w")).select(*keep, F.inline(each))


def _part_of_speech(previous: Column) -> Column:
    rows = [F.when(previous.isin(words), F.lit(pos)) for pos, words in BEFORE.items()]
    return F.coalesce(*rows)


def _stem(letters: int) -> Column:
    return F.concat("pos", F.lit(":"), F.substring("word", 1, letters))


def tagged_words(documents: DataFrame) -> DataFrame:
    """(word, small, previous, pos): each word, whether in small letters, and the part of speech that the word before asks for."""
    rows = words_with_previous(documents)
    return rows.select(F.lower("token").alias("word"), (F.col("token") == F.lower("token")).alias("small"), "previous", _part_of_speech(F.col("previous")).alias("pos"))


def counted_words(documents: DataFrame) -> DataFrame:
    """(word, small, previous, pos, n): how often ``tagged_words`` has each row, where a ``previous`` that asks for no part
    of speech is null. Words are counted batch by batch, and the counts are stored: texts are read once."""
    asking = {w for words in BEFORE.values() for w in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        for batch in batches:
            counts: Counter[tuple[str, bool, str | None]] = Counter()
            for text in batch.column(0):
                if text.is_valid and (words := find(text.as_py())):
                    low = [w.lower() for w in words]
                    counts.update(zip(low, map(str.__eq__, words, low), [None, *(w if w in asking else None for w in low[:-1])], strict=True))
            word, small, previous = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(small, pa.bool_()), pa.array(previous, pa.string()), pa.array(counts.values(), pa.int64())], ["word", "small", "previous", "n"])

    found = documents.select("text").mapInArrow(run, "word string, small boolean, previous string, n long").groupBy("word", "small", "previous").agg(F.sum("n").alias("n"))
    return written(found.select("word", "small", "previous", _part_of_speech(F.col("previous")).alias("pos"), "n"), "counts")


def dictionary(documents: DataFrame) -> dict[str, DataFrame]:
    """words, synsets, relations, exceptions and signatures, as the lexicon operators take them."""
    rows = counted_words(documents)
    counts = [F.struct(F.lit(pos).alias("pos"), F.coalesce(F.sum(F.when(F.col("pos") == pos, F.col("n"))), F.lit(0)).alias("tag_count")) for pos in BEFORE]
    words = rows.groupBy("word").agg(F.array(*counts).alias("c"), (~F.bool_or("small")).alias("is_entity"))
    words = words.select("word", F.inline("c"), "is_entity").filter(F.col("tag_count") >= LEAST)
    words = written(words.select("word", "pos", _stem(6).alias("synset"), "tag_count", "is_entity"), "words")
    stems = words.select("synset", F.substring("synset", 1, 5).alias("s")).distinct()
    above = stems.groupBy("s").agg(F.min("synset").alias("target"))
    hypernyms = stems.join(above, "s").filter("synset <> target").select(F.lit("hypernym").alias("relation"), F.col("synset").alias("source"), "target")
    once = words.select("word").distinct()
    opposite = once.select("word", F.concat(F.lit("un"), "word").alias("other")).join(once.select(F.col("word").alias("other")), "other")
    antonyms = opposite.select(F.lit("antonym").alias("relation"), F.col("word").alias("source"), F.col("other").alias("target"))
    verbs = words.filter("pos = 'v'").select(F.col("word").alias("base"))
    ends = once.filter(F.col("word").endswith("en")).withColumn("base", F.expr("substring(word, 1, length(word) - 2)"))
    before = rows.filter("pos is not null").join(words.select("word", "pos", "synset"), ["word", "pos"]).groupBy("synset", F.col("previous").alias("term")).agg(F.sum("n").alias("n"))
    total = before.groupBy("synset").agg(F.sum("n").alias("total"))
    return {
        "words": words,
        "synsets": words.select("synset", "word", F.lit("").alias("gloss")).distinct(),
        "relations": hypernyms.union(antonyms),
        "exceptions": ends.join(verbs, "base").select("word", "base", F.lit("v").alias("pos")),
        "signatures": before.join(total, "synset").select("synset", "term", (F.col("n") / F.col("total")).alias("p")),
    }


def asked_words(conversations: DataFrame) -> DataFrame:
    """(word): what the conversations use."""
    return words_with_previous(conversations).select(F.lower("token").alias("word")).distinct()


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: The same tables as common table expressions.
SQL = f"""cut AS (SELECT regexp_extract_all(text, '{WORD}') AS w FROM documents),
    used AS (SELECT lower(w[i]) AS word, w[i] = lower(w[i]) AS small, lower(w[i - 1]) AS previous FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM cut)),
    tagged AS (SELECT *, CASE {" ".join(f"WHEN previous IN ({_listed(words)}) THEN '{pos}'" for pos, words in BEFORE.items())} END AS pos FROM used),
    names_ AS (SELECT word, NOT bool_or(small) AS is_entity FROM used GROUP BY word),
    words AS (SELECT word, pos, pos || ':' || substr(word, 1, 6) AS synset, count(*) AS tag_count, any_value(is_entity) AS is_entity FROM tagged JOIN names_ USING (word) WHERE pos IS NOT NULL GROUP BY word, pos HAVING count(*) >= {LEAST}),
    synsets AS (SELECT DISTINCT synset, word FROM words),
    stems AS (SELECT DISTINCT synset, substr(synset, 1, 5) AS s FROM words),
    relations AS (SELECT 'hypernym' AS relation, synset AS source, target FROM stems JOIN (SELECT s, min(synset) AS target FROM stems GROUP BY s) USING (s) WHERE synset <> target
        UNION ALL SELECT 'antonym', a.word, b.word FROM (SELECT DISTINCT word FROM words) a JOIN (SELECT DISTINCT word FROM words) b ON b.word = 'un' || a.word),
    exceptions AS (SELECT a.word, b.word AS base, 'v' AS pos FROM (SELECT DISTINCT word FROM words) a JOIN words b ON a.word = b.word || 'en' AND b.pos = 'v'),
    befores AS (SELECT synset, previous AS term, count(*) AS n FROM tagged JOIN words USING (word, pos) GROUP BY ALL),
    signatures AS (SELECT synset, term, n / sum(n) OVER (PARTITION BY synset) AS p FROM befores)"""
ASKED_SQL = f"asked AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{WORD}'))) AS word FROM conversations)"
