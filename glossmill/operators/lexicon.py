"""Dictionary and thesaurus over tables that the user brings.

``words`` is (word, pos, synset, tag_count, is_entity), one row for each sense; ``synsets``
(synset, word, gloss); ``relations`` (relation, source, target) between synsets, or between
words for the relations of words; ``exceptions`` (word, base, pos). Words are lower case with
underscores in place of blanks. Where these lie in memory is left to the planner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffix, replacement and part of speech of the base-word rules, and relation names.
SUFFIX_RULES = [
    ("s", "", "n"), ("ses", "s", "n"), ("xes", "x", "n"), ("zes", "z", "n"), ("ches", "ch", "n"), ("shes", "sh", "n"), ("men", "man", "n"),
    ("ies", "y", "n"), ("s", "", "v"), ("ies", "y", "v"), ("es", "e", "v"), ("es", "", "v"), ("ed", "e", "v"), ("ed", "", "v"), ("ing", "", "v"),
    ("ing", "e", "v"), ("er", "", "a"), ("est", "", "a"), ("er", "e", "a"), ("est", "e", "a"),
]
WORD_RELATIONS = "antonym pertainym participle_of_verb also_see adj._derivation".split()
SYNSET_RELATIONS = (
    "hypernym hyponym member_holonym substance_holonym part_holonym member_meronym substance_meronym "
    "part_meronym attribute entailment cause verb_group similar_to"
).split()


def lexical_form(word: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(word), " +", "_"))


def base_words(queries: DataFrame, words: DataFrame, exceptions: DataFrame, exceptions_only: bool = False) -> DataFrame:
    """(word, base, pos) of each query word: by the exceptions, then by the suffix rules, where the
    result is a word of that part of speech. With ``exceptions_only`` words with an exception stop there."""
    asked = queries.select(lexical_form(F.col("word")).alias("word")).distinct()
    known = asked.join(exceptions.select("word", "base", "pos"), "word")
    rest = asked.join(known.select("word").distinct(), "word", "left_anti") if exceptions_only else asked
    tried = []
    for suffix, new, pos in SUFFIX_RULES:
        base = F.concat(F.substring("word", F.lit(1), F.length("word") - len(suffix)), F.lit(new))
        tried.append(F.when(F.col("word").endswith(suffix), F.struct(base.alias("base"), F.lit(pos).alias("pos"))))
    options = rest.select("word", F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("o")).select("word", "o.base", "o.pos")
    dictionary = words.select(F.col("word").alias("base"), "pos").distinct()
    return known.union(options.join(dictionary, ["base", "pos"]).select("word", "base", "pos")).distinct()


def membership(queries: DataFrame, words: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(word, found): 1 in the dictionary, 2 by a base word, else 0."""
    asked = queries.select(lexical_form(F.col("word")).alias("word")).distinct()
    exact = words.select("word").distinct().withColumn("e", F.lit(1))
    by_base = base_words(queries, words, exceptions).select("word").distinct().withColumn("b", F.lit(2))
    return asked.join(exact, "word", "left").join(by_base, "word", "left").select("word", F.coalesce("e", "b", F.lit(0)).alias("found"))


def word_pos(words: DataFrame) -> DataFrame:
    """(word, tags): the letters of all parts of speech, sorted."""
    return words.groupBy("word").agg(F.array_join(F.sort_array(F.collect_set("pos")), "").alias("tags"))


def entity_flag(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(word, is_entity): whether the word is normally a name; unknown words are."""
    flags = words.groupBy("word").agg(F.bool_or("is_entity").alias("is_entity"))
    return queries.select(lexical_form(F.col("word")).alias("word")).distinct().join(flags, "word", "left").select("word", F.coalesce("is_entity", F.lit(True)).alias("is_entity"))


def senses(queries: DataFrame, words: DataFrame, first_only: bool = False, pos: str | None = None) -> DataFrame:
    """(word, pos, synset, tag_count): senses from frequent to rare; only the first on request."""
    asked = queries.select(lexical_form(F.col("word")).alias("word")).distinct()
    rows = asked.join(words.select("word", "pos", "synset", "tag_count"), "word")
    if pos:
        rows = rows.filter(F.col("pos").isin(list(pos)))
    if first_only:
        order = Window.partitionBy("word").orderBy(F.desc("tag_count"), "synset")
        rows = rows.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
    return rows


def synset_words(queries: DataFrame, words: DataFrame, synsets: DataFrame, first_only: bool = True, pos: str | None = None) -> DataFrame:
    """(word, other): the words of its first synset, or of all."""
    return senses(queries, words, first_only, pos).join(synsets.select("synset", F.col("word").alias("other")), "synset").select("word", "other").distinct()


def similar_words(queries: DataFrame, words: DataFrame, synsets: DataFrame, exceptions: DataFrame, full: bool = False) -> DataFrame:
    """(word, other): synonyms of the first sense that do not contain the word; where there are
    none, those of its base forms, then those of all senses."""
    first = synset_words(queries, words, synsets, first_only=not full).filter(~F.contains(F.col("other"), F.col("word")))
    left = queries.select(lexical_form(F.col("word")).alias("word")).distinct().join(first.select("word").distinct(), "word", "left_anti")
    bases = base_words(left, words, exceptions).select("word", F.col("base").alias("b"))
    of_bases = synset_words(bases.select(F.col("b").alias("word")), words, synsets).withColumnRenamed("word", "b")
    second = bases.join(of_bases, "b").filter(~F.contains(F.col("other"), F.col("word"))).select("word", "other").distinct()
    left = left.join(second.select("word").distinct(), "word", "left_anti")
    third = synset_words(left, words, synsets, first_only=False).filter(~F.contains(F.col("other"), F.col("word")))
    return first.union(second).union(third)


def related_words(queries: DataFrame, relation: str, words: DataFrame, synsets: DataFrame, relations: DataFrame) -> DataFrame:
    """(word, other) by a named relation; none for a name that is not known."""
    rows = relations.filter(F.col("relation") == relation)
    if relation in WORD_RELATIONS:
        asked = queries.select(lexical_form(F.col("word")).alias("word")).distinct()
        return asked.join(rows.select(F.col("source").alias("word"), F.col("target").alias("other")), "word").distinct()
    if relation not in SYNSET_RELATIONS:
        rows = rows.filter(F.lit(False))
    found = senses(queries, words).select("word", "synset").join(rows, F.col("synset") == F.col("source")).select("word", "target")
    return found.join(synsets.select(F.col("synset").alias("target"), F.col("word").alias("other")), "target").select("word", "other").distinct()


def prefix_matches(queries: DataFrame, words: DataFrame, least: int = 10, most: int = 12, tries: int = 10) -> DataFrame:
    """(query, word): for a word that is not known, words that share its longest prefix with at
    least ``least`` matches (the shortest tried, where none has so many); ``most`` of them by name.

    Matches are counted once for each prefix of the vocabulary, and only the prefix that is chosen meets words, the
    first ``most`` of them: a query never meets all words of a short prefix.
    """
    asked = queries.select(lexical_form(F.col("word")).alias("query")).distinct().join(words.select(F.col("word").alias("query")).distinct(), "query", "left_anti")
    lengths = F.sequence(F.length("query"), F.greatest(F.length("query") - (tries - 1), F.lit(1)), F.lit(-1))
    prefixes = asked.select("query", F.explode(F.transform(lengths, lambda n: F.substring("query", F.lit(1), n))).alias("prefix"))
    vocabulary = words.select("word").distinct()
    cut = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring("word", F.lit(1), n))).alias("prefix"))
    counted = prefixes.join(cut.groupBy("prefix").agg(F.count("*").alias("n")), "prefix")
    best = counted.groupBy("query").agg(F.max(F.struct(F.least("n", F.lit(least)).alias("enough"), F.when(F.col("n") >= least, F.length("prefix")).otherwise(-F.length("prefix")).alias("l"), "prefix")).alias("b"))
    best = best.select("query", F.col("b.prefix").alias("prefix"))
    order = Window.partitionBy("prefix").orderBy("word")
    first = cut.join(best.select("prefix").distinct(), "prefix", "left_semi").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    return best.join(first, "prefix").select("query", "word")


def sense_scores(targets: DataFrame, contexts: DataFrame, words: DataFrame, signatures: DataFrame, unseen: float = -100.0) -> DataFrame:
    """(target, synset, score): log2 p(sense) plus log2 p(context word given sense) over the context.

    ``targets`` is (target, word), ``contexts`` (target, term), ``signatures`` (synset, term, p). Every context word
    counts as not seen first, and only those that some signature has meet the senses.
    """
    found = targets.join(words.select("word", "synset", "tag_count"), "word")
    total = F.sum("tag_count").over(Window.partitionBy("target"))
    prior = found.select("target", "synset", F.when((F.col("tag_count") > 0) & (total > 0), F.log2(F.col("tag_count") / total)).otherwise(F.lit(unseen)).alias("prior"))
    n = contexts.filter("term is not null").groupBy("target").agg(F.count("*").alias("n"))
    telling = contexts.join(signatures.select("term").distinct(), "term", "left_semi").join(found.select("target", "synset"), "target")
    more = (F.coalesce(F.log2("p"), F.lit(unseen)) - unseen).alias("more")
    told = telling.join(signatures, ["synset", "term"]).select("target", "synset", more).groupBy("target", "synset").agg(F.sum("more").alias("more"))
    rows = prior.join(n, "target", "left").join(told, ["target", "synset"], "left")
    return rows.select("target", "synset", (F.col("prior") + unseen * F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0.0))).alias("score"))


def best_senses(scores: DataFrame) -> DataFrame:
    """(target, synset): the highest score, ties to the least synset."""
    return scores.groupBy("target").agg(F.min(F.struct((-F.col("score")).alias("s"), "synset")).alias("b")).select("target", "b.synset")


def collocations(words: DataFrame, skip: tuple[str, ...] = ("genus", "family", "order")) -> DataFrame:
    """(lead, phrase, n_tokens): entries of several words by their first one; Latin ranks are left out."""
    kept = words.select("word").distinct().filter(F.col("word").contains("_"))
    kept = reduce(lambda d, s: d.filter(~F.col("word").startswith(f"{s}_") & ~F.col("word").endswith(f"_{s}")), skip, kept)
    parts = F.split("word", "_")
    return kept.select(F.element_at(parts, 1).alias("lead"), F.replace("word", F.lit("_"), F.lit(" ")).alias("phrase"), F.size(parts).alias("n_tokens"))


def single_exceptions(exceptions: DataFrame) -> DataFrame:
    """One base (the least) for each (word, pos)."""
    return exceptions.groupBy("word", "pos").agg(F.min("base").alias("base"))
