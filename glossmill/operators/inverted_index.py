"""The inverted index in long form, retrieval by postings, and paged search.

Postings are (prefix, term, doc_id, tf). ``write_index`` lays them out by prefix, the first two
letters, so that a search reads only the folders of its terms. Rows without an id have none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boolean_query import boolean_terms, evaluated, query_terms, text_match
from ..functions.text import LONGEST_TERM, content_words, stopwords
from ..scratch import written
from .relational import numbered
from .vectors import term_frequencies
from .word_index import WordIndex


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: str = "") -> DataFrame:
    """(prefix, term, doc_id, tf) of all content words of at most 35 characters."""
    tf = term_frequencies(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, content_words(F.col(text_col), kinds))
    return tf.filter(F.length("term") <= LONGEST_TERM).select(F.substring("term", 1, 2).alias("prefix"), "term", "doc_id", "tf")


def with_collocations(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Postings where each distinct collocation (doc_id, phrase) of a document counts once more for each of its words."""
    parts = phrases.distinct().select("doc_id", F.explode(F.split("phrase", "[ _]+")).alias("term"))
    more = parts.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).select(F.substring("term", 1, 2).alias("prefix"), "term", "doc_id", "tf")
    return index.union(more).groupBy("prefix", "term", "doc_id").agg(F.sum("tf").alias("tf"))


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Postings as Parquet by prefix, sorted by term inside, so that row groups can be skipped."""
    index.repartitionByRange("prefix", "term").sortWithinPartitions("prefix", "term", "doc_id").write.mode(mode).partitionBy("prefix").parquet(path)


def add_documents(index: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index with these documents; those that it had before are indexed anew."""
    return remove_documents(index, docs.select(F.col(id_col).alias("doc_id"))).unionByName(postings(docs, id_col, text_col))


def remove_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index less all postings of these ids."""
    return index.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(index.columns)


def _term_condition(query: str, fuzzy: bool) -> Column | None:
    parts = [w for t in query_terms(query) for w in t.lower().split()]
    out = None
    for part in parts:
        word = "".join(c for c in part if (c.isascii() and c.isalnum()) or c == "*")
        if not word.strip("*"):
            continue
        start = word.split("*")[0][:2]
        if fuzzy:
            one = F.col("term").contains(word.replace("*", ""))
        elif "*" in word:
            one = F.col("term").like(word.replace("*", "%"))
            if start:
                one = one & F.col("prefix").startswith(start)
        else:
            one = (F.col("prefix") == start) & (F.col("term") == word)
        out = one if out is None else out | one
    return out


def retrieve(index: DataFrame, query: str, fuzzy: bool = False) -> DataFrame:
    """(doc_id, weight): documents with any word of the query and the sum of their counts.

    Of an index in folders by prefix only those of the words are read; a fuzzy search, or a word
    that begins with a wildcard, reads all of them.
    """
    wanted = _term_condition(query, fuzzy)
    found = index.filter(F.lit(False)) if wanted is None else index.filter(wanted)
    return found.groupBy("doc_id").agg(F.sum("tf").alias("weight"))


def _needs_words(query: str) -> bool:
    """Whether every document that satisfies the query has one of its words in the postings. Stop words, words of one or
    two letters, phrases and wildcards may hold where postings have nothing."""
    terms = boolean_terms(query)
    if not terms:
        return False
    plain = lambda t: t.isascii() and t.isalnum() and 3 <= len(t) <= LONGEST_TERM and t[0].isalpha() and t.lower() not in stopwords()
    return not evaluated(query, {t: np.bool_(not plain(t)) for t in terms})


def impact_blocks(index: DataFrame, size: int = 1000) -> DataFrame:
    """Postings in blocks, (term, block, most, entries): documents are ranked by their number of words, and a block holds
    ``size`` of them in a row; ``most`` is the greatest count of the term in it. Documents of one block are alike in
    length, so that a block's greatest counts say what its documents can reach."""
    lengths = index.groupBy("doc_id").agg((-F.sum("tf")).alias("_down"))
    places = numbered(lengths, ["_down", "doc_id"], "_place", first=0).select("doc_id", F.floor(F.col("_place") / size).alias("block"))
    rows = index.join(places, "doc_id").groupBy("term", "block")
    return rows.agg(F.max("tf").alias("most"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("entries"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks by term, so that a search skips the row groups of other terms; ``most`` is read without the entries."""
    blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(path)


def top_documents(blocks: DataFrame, words: list[str], k: int = 10, first_blocks: int = 4, seen: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, weight): the k documents with the greatest sum of counts of the words, ties to the lesser id.

    The greatest counts alone bound what a block's documents can reach. The few blocks of the highest bounds are
    scored first; their k-th weight is a threshold, below which no block is read. ``seen`` takes how many
    blocks there are and were read.
    """
    own = blocks.filter(F.col("term").isin([w.lower() for w in words]))
    bounds = written(own.groupBy("block").agg(F.sum("most").alias("bound")), "bounds")
    best = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(first_blocks).collect()]

    def scored(chosen: DataFrame) -> DataFrame:
        rows = own.join(chosen, "block", "left_semi").select(F.inline("entries"))
        return rows.groupBy("doc_id").agg(F.sum("tf").alias("weight")).orderBy(F.desc("weight"), "doc_id").limit(k)

    lead = written(scored(bounds.filter(F.col("block").isin(best)).select("block")), "lead")
    held = [r.weight for r in lead.select("weight").collect()]  # k at most
    rest = bounds.filter(~F.col("block").isin(best) & (F.col("bound") >= (min(held) if len(held) == k else 0))).select("block")
    if seen is not None:
        seen |= {"blocks": bounds.count(), "read": len(best) + rest.count()}
    return lead.union(scored(rest)).orderBy(F.desc("weight"), "doc_id").limit(k)


def search(docs: DataFrame, index: DataFrame, query: str, fuzzy: bool = False, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", words: WordIndex | None = None) -> DataFrame:
    """The documents that satisfy the query, with ``weight`` (in place of a column of that name).

    Candidates come from the postings if every document that satisfies the query must have one of its words there; else all
    documents are candidates, with weight 0 where they have none. ``where`` filters before the texts are read; the
    boolean predicate decides. With ``words`` it is evaluated on that index, and no text is read.
    """
    rows = (docs if where is None else docs.filter(where)).drop("weight")
    weights = retrieve(index, query, fuzzy).withColumnRenamed("doc_id", id_col)
    if words is not None:
        rows = rows.join(words.matching(query, fuzzy, docs, id_col, text_col).withColumnRenamed("doc_id", id_col), id_col, "left_semi")
    needed = not fuzzy and _needs_words(query)
    found = rows.join(weights, id_col, "inner" if needed and words is None else "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    return found if words is not None else found.filter(text_match(F.col(text_col), query, fuzzy))


def page(rows: DataFrame, number: int, size: int = 10, order: list[Column] | None = None) -> DataFrame:
    """Page ``number`` (from 1, clamped to what there is) of rows in order, with their ``position``.

    Only the rows up to the end of the page are ranked: an ordered limit goes first.
    """
    order = order or [F.desc("weight"), F.asc("doc_id")]
    rows = written(rows, "found")  # counted and ranked, found once
    total = rows.count()
    last = max(1, -(-total // size))
    number = min(max(number, 1), last)
    top = rows.orderBy(*order).limit(number * size)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).filter(F.col("position") > (number - 1) * size)


def pages_of(total: int, number: int, size: int = 10) -> dict[str, int]:
    """First, previous, next and last page beside a clamped page number."""
    last = max(1, -(-total // size))
    number = min(max(number, 1), last)
    return {"first": 1, "previous": max(1, number - 1), "page": number, "next": min(last, number + 1), "last": last}
