"""Term vectors in long form (doc_id, term, weight) and what is computed of them.

A document without terms has no rows. Ties are broken by term or id. Rows that share an id are
one document. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_words
from ..scratch import written


#: Groups of terms by which candidates are bounded.
_FOLDS = 64


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Column | None = None) -> DataFrame:
    """(doc_id, term, tf): how often each content word is in each document."""
    found = content_words(F.col(text_col)) if words is None else words
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df, total): documents with each term, and its occurrences."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def l1_normalized(vectors: DataFrame, weight: str = "weight", decimals: int | None = None) -> DataFrame:
    """Weights divided by their sum in the document; where that is 0 they stay."""
    total = F.sum(weight).over(Window.partitionBy("doc_id"))
    share = F.when(total == 0, F.col(weight)).otherwise(F.col(weight) / total)
    return vectors.withColumn("weight", F.round(share, decimals) if decimals is not None else share)


def frequency_vectors(tf: DataFrame, normalize: bool = True) -> DataFrame:
    """(doc_id, term, weight) with term frequencies as weights."""
    raw = tf.select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
    return l1_normalized(raw) if normalize else raw


def tfidf_vectors(tf: DataFrame, n_docs: int | None = None, normalize: bool = True) -> DataFrame:
    """(doc_id, term, weight): tf times (log2 N - log2 df + 1); N is the documents with a term unless given.

    The frequencies are written once, since they are read for the documents, the terms and the weights.
    """
    tf = written(tf, "tf")
    n = tf.select("doc_id").distinct().count() if n_docs is None else n_docs
    df = document_frequencies(tf).select("term", "df")
    idf = F.log2(F.lit(float(max(n, 1)))) - F.log2("df") + 1
    raw = tf.join(df, "term").select("doc_id", "term", (F.col("tf") * idf).alias("weight"))
    return l1_normalized(raw) if normalize else raw


def strongest(vectors: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` strongest terms of each document and their rank."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return vectors.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def truncated_weights(vectors: DataFrame, decimals: int = 3) -> DataFrame:
    """Weights cut, not rounded, to so many decimals."""
    return vectors.withColumn("weight", F.floor(F.round(F.col("weight") * 10**decimals, 6)) / 10**decimals)


def as_maps(vectors: DataFrame) -> DataFrame:
    """(doc_id, vector map<string,double>), one row a document."""
    return vectors.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "weight")))).alias("vector"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Weights divided by the document's length, so that dot products are cosines."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
    return vectors.select("doc_id", "term", F.when(norm == 0, F.lit(0.0)).otherwise(F.col("weight") / norm).alias("weight"))


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """(a, b, sim) with a < b for all documents that share a term: for small collections.

    Long lists of documents by term make this grow with their squares; ``similar_pairs`` does not.
    """
    unit = unit_vectors(vectors)
    a = unit.select("term", F.col("doc_id").alias("a"), F.col("weight").alias("wa"))
    b = unit.select("term", F.col("doc_id").alias("b"), F.col("weight").alias("wb"))
    both = a.join(b, (a.term == b.term) & (F.col("a") < F.col("b")))
    return both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim")).withColumn("sim", F.greatest("sim", F.lit(0.0)))


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) with a < b and sim >= threshold, exactly, without all pairs of a frequent term.

    Terms are ordered from rare to frequent. The shortest suffix of a document whose length stays
    below the threshold cannot reach it alone, so a similar pair shares a term of both prefixes;
    only these meet in the join. Candidates whose terms, dealt to ``_FOLDS`` groups, have lengths that
    cannot reach the threshold go (the dot product is at most that of the lengths by group); the
    others are computed in full. Weights must not be negative.
    """
    unit = unit_vectors(vectors).filter("weight > 0")
    df = unit.groupBy("term").agg(F.count("*").alias("df"))
    suffix = Window.partitionBy("doc_id").orderBy(F.desc("df"), F.desc("term"))
    ranked = unit.join(df, "term").withColumn("left", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(suffix)))
    prefix = ranked.filter((F.col("left") >= threshold - 1e-9) & (F.col("df") > 1)).select("term", "doc_id")
    a, b = prefix.select("term", F.col("doc_id").alias("a")), prefix.select("term", F.col("doc_id").alias("b"))
    pairs = a.join(b, (a.term == b.term) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    group = F.pmod(F.xxhash64("term"), F.lit(_FOLDS))
    lengths = unit.groupBy("doc_id").agg(*(F.sqrt(F.sum(F.when(group == i, F.col("weight") * F.col("weight")).otherwise(0.0))).alias(f"n{i}") for i in range(_FOLDS)))
    lengths = lengths.select("doc_id", F.array(*(f"n{i}" for i in range(_FOLDS))).alias("n"))
    most = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, q: s + q)
    pairs = pairs.join(lengths.toDF("a", "x"), "a").join(lengths.toDF("b", "y"), "b").filter(most >= threshold - 1e-9).select("a", "b")
    wa = unit.select(F.col("doc_id").alias("a"), "term", F.col("weight").alias("wa"))
    wb = unit.select(F.col("doc_id").alias("b"), "term", F.col("weight").alias("wb"))
    full = pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    return full.filter(F.col("sim") >= threshold)


def vector_classes(tf: DataFrame) -> DataFrame:
    """(doc_id, lead): the least id of the documents with the very same term frequencies."""
    entry = F.concat_ws(":", "term", F.col("tf").cast("string"))
    signed = tf.groupBy("doc_id").agg(F.sha2(F.concat_ws(" ", F.array_sort(F.collect_list(entry))), 256).alias("sign"))
    return signed.select("doc_id", "sign").join(signed.groupBy("sign").agg(F.min("doc_id").alias("lead")), "sign").select("doc_id", "lead")


def leads_of(vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """The vectors of one document of each class, the lead."""
    return vectors.join(classes.filter("doc_id = lead").select("doc_id"), "doc_id", "left_semi")


def class_edges(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) that link what all pairs of members link: the pairs of leads, and each member with its lead."""
    return pairs.select("a", "b").union(classes.filter("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")))


def member_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, sim) of all members, from the pairs of leads; those of one class have 1."""
    x, y = classes.toDF("x", "a"), classes.toDF("y", "b")
    across = pairs.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")
    inside = x.join(y, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("sim"))
    return across.union(inside)


def jaccard_pairs(tf: DataFrame) -> DataFrame:
    """(a, b, jaccard) of term sets, with a < b, for documents that share a term."""
    n = tf.groupBy("doc_id").agg(F.count("*").alias("n"))
    a, b = tf.select("term", F.col("doc_id").alias("a")), tf.select("term", F.col("doc_id").alias("b"))
    both = a.join(b, (a.term == b.term) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return sized.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def related(pairs: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, rank, other, sim): the k most similar documents of each."""
    both = pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("other"), "sim").union(pairs.select("b", "a", "sim"))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("sim", 9)), "other")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def related_to(queries: DataFrame, vectors: DataFrame, classes: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, rank, other, sim): the k most similar of all documents for each of ``queries`` (doc_id).

    ``classes`` are the ``vector_classes`` of the documents: only leads are compared. Of each class the
    k + 1 least ids can be among the k others, and a class whose lead is not among the first has none.
    """
    unit = unit_vectors(leads_of(vectors, classes))
    asked = classes.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    sought = asked.select(F.col("lead").alias("doc_id")).distinct()
    a = unit.join(sought, "doc_id", "left_semi").select("term", F.col("doc_id").alias("a"), F.col("weight").alias("wa"))
    b = unit.select("term", F.col("doc_id").alias("b"), F.col("weight").alias("wb"))
    sims = a.join(b, "term").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    best = Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b")
    near = sims.withColumn("place", F.row_number().over(best)).filter((F.col("place") <= k + 1) | (F.col("a") == F.col("b")))
    least = classes.withColumn("place", F.row_number().over(Window.partitionBy("lead").orderBy("doc_id"))).filter(F.col("place") <= k + 1)
    found = asked.select("doc_id", F.col("lead").alias("a")).join(near.select("a", "b", "sim"), "a").join(least.select(F.col("lead").alias("b"), F.col("doc_id").alias("other")), "b")
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("sim", 9)), "other")
    return found.filter("other != doc_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("doc_id", "rank", "other", "sim")


def expanded(vectors: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Vectors with the synonyms (term, synonym) of each term at its weight, normalised again."""
    more = vectors.join(synonyms, "term").select("doc_id", F.col("synonym").alias("term"), "weight")
    both = vectors.select("doc_id", "term", "weight").union(more).groupBy("doc_id", "term").agg(F.sum("weight").alias("weight"))
    return l1_normalized(both)


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices in long form (i, j, value)."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("value").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def similarity_histogram(pairs: DataFrame) -> DataFrame:
    """(bin, n): similarities by tenth, each rounded to one decimal; the last bin holds 0.9 and 1."""
    return pairs.groupBy(F.least(F.floor(F.round("sim", 1) * 10 + 0.5), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cluster_threshold(pairs: DataFrame, n_docs: int, usual: float = 0.2, lower: float = 0.15, share: float = 0.05) -> DataFrame:
    """One row: pairs above ``usual``, their share of all pairs, and the threshold that follows."""
    over = F.count(F.when(F.col("sim") > usual, 1))
    part = F.lit(0.0) if n_docs < 2 else over * 2 / F.lit(n_docs * (n_docs - 1))
    return pairs.agg(over.alias("n_over"), part.alias("share")).withColumn("threshold", F.when(F.col("share") < share, lower).otherwise(usual))
