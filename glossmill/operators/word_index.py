"""A stored full-text index of all words with their places, in segments, which answers boolean queries without texts.

A word is a run of ASCII letters, digits and underscores in lower case, as the edges of ``text_match`` see it; stop
words and short words count too. Postings are (prefix, term, doc_id, tf, starts), where starts are places in
characters. A query's words, wildcards at either end of a word and phrases are looked up as sets of documents, and the
query is evaluated on which of them a document has, so NOT needs ids alone. A phrase joins the places of its words,
each with the one or two characters that may lie between. What such places cannot tell (a wildcard inside a term, a
mark before or after it) is asked of the texts, if they are given.

The index is a folder: each change appends a segment (postings and documents of what is added, and ids that no earlier
segment counts for), and nothing that lies there is written again. The manifest's last version names the segments that
count; ``merged`` joins them into one. One writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boolean_query import boolean_terms, evaluated, text_match

_WORD = re.compile(r"[A-Za-z0-9_]+", re.ASCII)
_POSTINGS = "prefix string, term string, doc_id {id}, tf long, starts array<int>"
_DOCUMENTS, _TOMBSTONES = "doc_id {id}, n_chars long", "doc_id {id}"
_MANIFEST, _CONTENTS = "version long, segment long, id_type string", "segment long, name string"


def word_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(prefix, term, doc_id, tf, starts) of every word of every text; rows without an id have none."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                terms, starts, owner = [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    held: dict[str, list[int]] = {}
                    for m in _WORD.finditer(text or ""):
                        held.setdefault(m[0].lower(), []).append(m.start())
                    terms += held
                    starts += held.values()
                    owner += [k] * len(held)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(starts, pa.list_(pa.int32()))], ["term", "doc_id", "starts"])

    found = rows.mapInArrow(run, f"term string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, starts array<int>")
    return found.select(F.substring("term", 1, 2).alias("prefix"), "term", "doc_id", F.size("starts").cast("long").alias("tf"), "starts")


@dataclass
class WordIndex:
    """The index in a folder that all executors share."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(spark: SparkSession, path: str, id_type: str = "long") -> WordIndex:
        """A new index without documents; the folder must be new."""
        spark.createDataFrame([(0, 0, id_type)], _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
        spark.createDataFrame([(0, "nothing")], _CONTENTS).coalesce(1).write.parquet(f"{path}/contents")
        return WordIndex(spark, path)

    def _version(self) -> tuple[int, list[int], int, str]:
        """The last version, its segments, the last segment of all, and the type of ids."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()  # one row a segment and version
        last = max(r.version for r in rows)
        return last, sorted(r.segment for r in rows if r.version == last), max(r.segment for r in rows), rows[0].id_type

    def _commit(self, version: int, segments: list[int], id_type: str) -> None:
        self.spark.createDataFrame([(version, s, id_type) for s in segments], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _table(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        """The rows of some segments of a table, or none where it was never written."""
        schema = schema.format(id=self._version()[3])
        empty = self.spark.createDataFrame([], f"segment long, {schema}")
        has = {r.segment for r in self.spark.read.schema(_CONTENTS).parquet(f"{self.path}/contents").filter(F.col("name") == name).collect()}  # a row a segment
        read = lambda s: self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{s}").withColumn("segment", F.lit(s).cast("long"))
        return reduce(DataFrame.unionByName, [read(s) for s in segments if s in has], empty)

    def _written(self, segment: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            if name == "postings":
                # Terms in order, so that a search skips the row groups that have none of its words.
                df = df.repartitionByRange("prefix", "term").sortWithinPartitions("prefix", "term", "doc_id")
            df.write.parquet(f"{self.path}/{name}/{segment}")
        self.spark.createDataFrame([(segment, name) for name in tables], _CONTENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/contents")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """These documents, in place of what the index has under their ids. Ids must be distinct."""
        version, segments, last, id_type = self._version()
        rows = docs.filter(F.col(id_col).isNotNull())
        ids = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))
        self._written(last + 1, postings=word_places(rows, id_col, text_col), documents=ids, tombstones=ids.select("doc_id"))
        self._commit(version + 1, [*segments, last + 1], id_type)

    def remove(self, ids: DataFrame) -> None:
        """No documents under these ids (doc_id)."""
        version, segments, last, id_type = self._version()
        self._written(last + 1, tombstones=ids.select("doc_id").distinct())
        self._commit(version + 1, [*segments, last + 1], id_type)

    def merged(self, most: int = 1) -> bool:
        """Join the segments into one if there are more than so many; whether it was done."""
        version, segments, last, id_type = self._version()
        if len([s for s in segments if s]) <= most:
            return False
        postings = self._live(self._table("postings", _POSTINGS, segments)).drop("segment")
        self._written(last + 1, postings=postings, documents=self.documents().drop("segment"))
        self._commit(version + 1, [last + 1], id_type)
        return True

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of documents that no later segment has replaced or removed."""
        _, segments, _, _ = self._version()
        gone = self._table("tombstones", _TOMBSTONES, segments).groupBy("doc_id").agg(F.max("segment").alias("gone"))
        return rows.join(gone, "doc_id", "left").filter(F.coalesce(F.col("gone") <= F.col("segment"), F.lit(True))).drop("gone")

    def documents(self) -> DataFrame:
        """(segment, doc_id, n_chars)."""
        return self._live(self._table("documents", _DOCUMENTS, self._version()[1])).select("segment", "doc_id", "n_chars")

    def postings(self, terms: Column | None = None) -> DataFrame:
        """The postings that count, of terms that satisfy a condition on ``prefix`` and ``term``."""
        rows = self._table("postings", _POSTINGS, self._version()[1])
        return self._live(rows if terms is None else rows.filter(terms)).drop("segment")

    # --- queries

    def _word(self, word: str, first: bool, last: bool) -> DataFrame:
        """(doc_id, s, e): where the letters ``word`` lie in words, at the start of one and at the end of one if asked."""
        term, n = F.col("term"), len(word)
        if first and last:
            condition = (F.col("prefix") == word[:2]) & (term == word)
        elif first:
            condition = F.col("prefix").startswith(word[:2]) & term.startswith(word)
        else:
            condition = term.endswith(word) if last else term.contains(word)
        every = F.sequence(F.lit(0), F.length(term) - n)
        inside = F.array(F.lit(0)) if first else F.array(F.length(term) - n) if last else F.filter(every, lambda i: F.substring(term, i + 1, F.lit(n)) == word)
        rows = self.postings(condition).select("doc_id", F.explode("starts").alias("at"), inside.alias("i"))
        if first and last:
            return rows.select("doc_id", F.col("at").alias("s"), (F.col("at") + n).alias("e"))
        return rows.select("doc_id", "at", F.explode("i").alias("i")).select("doc_id", (F.col("at") + F.col("i")).alias("s"), (F.col("at") + F.col("i") + n).alias("e"))

    def having(self, term: str, fuzzy: bool = False, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id) of the documents that have a word or phrase, as ``text_match`` finds it."""
        words, gaps = re.findall("[A-Za-z0-9]+", term), re.split("[A-Za-z0-9]+", term)
        open_ = fuzzy or "*" in term
        ends = {gaps[0], gaps[-1]} - {""}
        inner = gaps[1:-1]
        if not words or any("*" in g for g in inner) or any(g.strip("*") for g in ends):
            if docs is None:
                raise ValueError(f"only the texts can tell where {term!r} is")
            return docs.filter(text_match(F.col(text_col), f'"{term}"', fuzzy)).select(F.col(id_col).alias("doc_id"))
        words = [w.lower() for w in words]
        if len(words) == 1:
            return self._word(words[0], not open_, not open_).select("doc_id").distinct()
        found = self._word(words[0], not open_, False).select("doc_id", "e").distinct()
        for k, word in enumerate(words[1:]):
            least = len(inner[k])
            ahead = found.select("doc_id", F.explode(F.array(*(F.col("e") + g for g in range(least, 2 * least + 1)))).alias("s")).distinct()
            final = k == len(words) - 2
            found = ahead.join(self._word(word, False, final and not open_), ["doc_id", "s"]).select("doc_id", "e").distinct()
        return found.select("doc_id").distinct()

    def matching(self, query: str, fuzzy: bool = False, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id) of the documents whose text satisfies the query: those for which ``text_match`` is true."""
        terms = boolean_terms(query)
        live = self.documents()
        if terms == []:
            return live.select("doc_id")
        if terms is None:
            return live.select("doc_id").filter(F.lit(False))
        hits = [self.having(t, fuzzy, docs, id_col, text_col).select("doc_id", F.lit(i).alias("i")) for i, t in enumerate(terms)]
        has = reduce(DataFrame.union, hits).groupBy("doc_id").agg(F.collect_set("i").alias("has"))
        without = bool(evaluated(query, {t: np.bool_(False) for t in terms}))  # whether a document without any of them does
        rows = live.join(has, "doc_id", "left" if without else "inner")
        has = F.coalesce("has", F.array().cast("array<int>"))
        return rows.filter((F.col("n_chars") >= 2) & evaluated(query, {t: F.array_contains(has, i) for i, t in enumerate(terms)})).select("doc_id")
