"""Questions: n-grams, ranked answer sentences, matches with known questions, and answer types.

Queries are a bounded table (query_id, text); documents are not bounded, and meet the queries'
n-grams by join. Ties go to the least ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from .vectors import cosine_pairs, related, strongest, term_frequencies, tfidf_vectors, truncated_weights

# N-gram and match weights, the shape of the answer-type network.
GRAM_WEIGHTS = {1: 1.0, 2: 1.5, 3: 4.0}
ENTITY_WEIGHT, NOUN_WEIGHT = 8.0, 16.0
INPUTS, HIDDEN, OUTPUTS = 5, 4, 2


def query_grams(queries: DataFrame, id_col: str = "query_id", text_col: str = "text", distinct: bool = True) -> DataFrame:
    """(query_id, size, gram): the distinct runs of one to three lower-case words; with repeats if they need not be."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit("([a-z]+)"), 1)
    rows = queries.select(F.col(id_col).alias("query_id"), words.alias("w")).filter(F.size("w") > 0)

    def runs(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.struct(F.lit(n).alias("size"), F.array_join(F.slice("w", i, n), " ").alias("gram")))
        return F.when(F.size("w") >= n, made).otherwise(F.array().cast("array<struct<size:int,gram:string>>"))

    found = rows.select("query_id", F.explode(F.concat(*(runs(n) for n in GRAM_WEIGHTS))).alias("g")).select("query_id", "g.size", "g.gram")
    return found.distinct() if distinct else found


def _held(parts: DataFrame, key: str, text_col: str, asked: DataFrame) -> DataFrame:
    """(key, gram): runs of words of the parts that some query asks for. Queries are bounded, so what they ask goes to all
    tasks, and no other run leaves its own."""
    grams = query_grams(parts, key, text_col, distinct=False).select(F.col("query_id").alias(key), "gram")
    return grams.join(F.broadcast(asked.select("gram").distinct()), "gram", "left_semi").select(key, "gram")


def _once(held: DataFrame, key: str) -> DataFrame:
    """Distinct rows with those of a part in one task, so that its scores are summed where they are."""
    return held.repartition(key).dropDuplicates([key, "gram"])


def answer_scores(parts: DataFrame, queries: DataFrame, key: str = "doc_id", text_col: str = "text", id_col: str = "query_id", query_col: str = "text", bonus: Column | None = None) -> DataFrame:
    """(query_id, key, score): for each part of text, each distinct n-gram that it shares with the
    query counts the weight of its size over the number of the query's n-grams of that size."""
    asked = query_grams(queries, id_col, query_col)
    sizes = asked.groupBy("query_id", "size").agg(F.count("*").alias("n"))
    weight = F.create_map(*(x for n, w in GRAM_WEIGHTS.items() for x in (F.lit(n), F.lit(w))))
    asked = asked.join(sizes, ["query_id", "size"]).select("query_id", "gram", (weight[F.col("size")] / F.col("n")).alias("w"))
    held = _once(_held(parts, key, text_col, asked), key)
    found = held.join(F.broadcast(asked), "gram").groupBy("query_id", key).agg(F.sum("w").alias("score"))
    if bonus is None:
        return found
    return found.join(parts.select(key, bonus.alias("_bonus")), key).withColumn("score", F.col("score") + F.coalesce("_bonus", F.lit(0.0))).drop("_bonus")


def expanded_query(neighbours: DataFrame) -> DataFrame:
    """(query_id, word, weight): the weights that all of a query's nouns (``neighbour_weights`` of each,
    with its ``seed``) give to a word, summed."""
    return neighbours.groupBy("query_id", "word").agg(F.sum("weight").alias("weight"))


def sentence_scores(
    parts: DataFrame, queries: DataFrame, idf: DataFrame, collocations: DataFrame, wanted: DataFrame, entities: DataFrame, nouns: DataFrame, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(query_id, key, score) of answer sentences in full: the share of the query's idf mass (``idf`` is
    term, idf; terms of collocations count double), pairs and runs of three by their share, 8 where the
    sentence has an entity (key, type) of a type that is wanted (query_id, type), and 16 times the share of
    the weight of the query's nouns (query_id, word, weight) that it holds."""
    asked = query_grams(queries)
    known = asked.filter("size = 1").join(idf.select(F.col("term").alias("gram"), "idf"), "gram")
    twice = collocations.select(F.explode(F.split(F.lower("phrase"), "[ _]+")).alias("gram")).distinct().withColumn("k", F.lit(2.0))
    known = known.join(twice, "gram", "left").withColumn("mass", F.col("idf") * F.coalesce("k", F.lit(1.0)))
    total = known.groupBy("query_id").agg(F.sum("mass").alias("all"))
    single = known.join(total, "query_id").filter("all > 0").select("query_id", "gram", (GRAM_WEIGHTS[1] * F.col("mass") / F.col("all")).alias("w"))
    sizes = asked.groupBy("query_id", "size").agg(F.count("*").alias("n"))
    longer = asked.filter("size > 1").join(sizes, ["query_id", "size"])
    longer = longer.select("query_id", "gram", (F.when(F.col("size") == 2, GRAM_WEIGHTS[2]).otherwise(GRAM_WEIGHTS[3]) / F.col("n")).alias("w"))
    all_nouns = nouns.groupBy("query_id").agg(F.sum("weight").alias("all"))
    noun = nouns.join(all_nouns, "query_id").filter("all > 0").select("query_id", F.lower("word").alias("gram"), (NOUN_WEIGHT * F.col("weight") / F.col("all")).alias("w"))
    weights = single.union(longer).union(noun).select("query_id", "gram", "w", F.lit(0.0).alias("typed"))
    named = lambda kind: F.concat(F.lit("\0"), kind)  # noqa: E731  a type as a run that no text has
    types = wanted.distinct().select("query_id", named(F.col("type")).alias("gram"), F.lit(0.0).alias("w"), F.lit(ENTITY_WEIGHT).alias("typed"))
    held = _once(_held(parts, key, text_col, weights).union(entities.select(key, named(F.col("type")))), key)
    return held.join(F.broadcast(weights.union(types)), "gram").groupBy("query_id", key).agg((F.sum("w") + F.max("typed")).alias("score"))


def training_patterns(questions_: DataFrame, profile: DataFrame, actual: DataFrame, positive: int = 2, negative_share: float = 0.25) -> DataFrame:
    """(question_id, category, s1..s5, label): the likeness of a question's terms (question_id, kind, term,
    weight) of five kinds to each category's (``category_profile``). Patterns of the actual category
    (question_id, category) come ``positive`` times, of the others so large a share, chosen by hash."""
    kinds = ["phrase", "cat_term", "iword", "noun", "vector"]

    def unit(rows: DataFrame, keys: list[str]) -> DataFrame:
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*keys, "kind")))
        return rows.select(*keys, "kind", "term", (F.col("weight") / norm).alias("w")).filter("w is not null")

    a = unit(questions_, ["question_id"])
    b = unit(profile, ["category"]).withColumnRenamed("w", "v")
    sims = a.join(b, ["kind", "term"]).groupBy("question_id", "category", "kind").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    wide = sims.groupBy("question_id", "category").pivot("kind", kinds).agg(F.first("s"))
    categories = sorted(r.category for r in profile.select("category").distinct().collect())  # a row an answer type
    pairs = questions_.select("question_id").distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories)).cast("array<string>")))
    rows = pairs.join(wide, ["question_id", "category"], "left").join(actual.select("question_id", F.col("category").alias("_actual")), "question_id")
    rows = rows.select("question_id", "category", *(F.coalesce(k, F.lit(0.0)).alias(f"s{i}") for i, k in enumerate(kinds, 1)), (F.col("category") == F.col("_actual")).alias("label"))
    chosen = F.pmod(F.xxhash64("question_id", "category"), F.lit(10_000)) < int(negative_share * 10_000)
    times = F.when(F.col("label"), positive).otherwise(F.when(chosen, 1).otherwise(0))
    return rows.withColumn("_t", F.explode(F.array_repeat(F.lit(1), times))).drop("_t")


def faq_entries(faqs: DataFrame, terms: int = 250, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Of questions (doc_id, text): their idf vectors of the ``terms`` strongest terms, cut to three decimals, and
    (doc_id, rank, other, sim) of the ``k`` most similar questions of each."""
    vectors = truncated_weights(strongest(tfidf_vectors(term_frequencies(faqs)), terms).drop("rank"))
    return vectors, related(cosine_pairs(vectors), k)


def best_answers(scores: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The k best parts of each query, with ``rank``. Of each task only its own k best are sent on; no other is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def best() -> pa.Table:
            rows = pa.Table.from_batches(held)
            rows = rows.take(pc.sort_indices(rows, [("query_id", "ascending"), ("_order", "descending"), (key, "ascending")])).combine_chunks()
            query = rows.column("query_id")
            begins = np.flatnonzero(np.concatenate([[True], pc.fill_null(pc.not_equal(query[1:], query[:-1]), True).to_numpy()]))
            return rows.take(pa.array(np.flatnonzero(np.arange(len(rows)) - np.repeat(begins, np.diff([*begins, len(rows)])) < k)))

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) > 200_000:
                held = best().combine_chunks().to_batches()
        if held:
            yield from best().to_batches()

    rounded = scores.withColumn("_order", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("_order"), key)
    return rounded.mapInArrow(run, rounded.schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_order")


def faq_score(query: dict[str, Column], entry: dict[str, Column], contained: Column | None = None) -> Column:
    """A quarter each of the likeness of nouns (51 fold), phrases, question words and vectors; 100 if contained."""
    score = 0.25 * (51 * cosine(query["nouns"], entry["nouns"]) + cosine(query["phrases"], entry["phrases"]) + cosine(query["iwords"], entry["iwords"]) + cosine(query["vector"], entry["vector"]))
    return F.round(score if contained is None else F.when(contained, F.lit(100.0)).otherwise(score), 2)


def neighbour_weights(seeds: DataFrame, synonyms: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """(query_id, word, weight): seeds keep their weight, synonyms get 64, their hypernyms 8; the first of these counts."""
    near = seeds.join(synonyms, "word").select("query_id", F.col("other").alias("word"))
    far = seeds.select("query_id", "word").union(near).join(hypernyms, "word").select("query_id", F.col("other").alias("word"))
    rows = seeds.select("query_id", "word", F.col("weight").cast("double").alias("weight"), F.lit(0).alias("k"))
    rows = rows.union(near.select("query_id", "word", F.lit(64.0), F.lit(1))).union(far.select("query_id", "word", F.lit(8.0), F.lit(2)))
    return rows.groupBy("query_id", "word").agg(F.min(F.struct("k", (-F.col("weight")).alias("w"))).alias("b")).select("query_id", "word", (-F.col("b.w")).alias("weight"))


def noun_weights(tokens: DataFrame, nouns: DataFrame) -> DataFrame:
    """(query_id, word, weight): the first two nouns after the question word, 256 halved by each step.

    ``tokens`` is (query_id, pos, token) after the question word, from 1.
    """
    low = tokens.select("query_id", "pos", F.lower("token").alias("word")).join(nouns.select("word").distinct(), "word", "left_semi")
    order = Window.partitionBy("query_id").orderBy("pos")
    return low.withColumn("k", F.row_number().over(order)).filter("k <= 2").select("query_id", "word", (F.lit(256.0) / F.pow(F.lit(2.0), F.col("k") - 1)).alias("weight"))


def category_profile(rows: DataFrame, least: int = 10, most: int = 500) -> DataFrame:
    """(category, kind, term, weight) of training questions (question_id, category, kind, term): shares
    of the category's terms of a kind, for categories with ``least`` questions."""
    enough = rows.groupBy("category").agg(F.count_distinct("question_id").alias("n")).filter(F.col("n") >= least).select("category")
    counts = rows.join(enough, "category").groupBy("category", "kind", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("category", "kind").orderBy(F.desc("n"), "term")
    top = counts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    return top.select("category", "kind", "term", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("category", "kind")), 5).alias("weight"))


def network_outputs(inputs: list[Column], weights: Column) -> tuple[Column, Column]:
    """The YES and NO outputs of a 5-4-2 sigmoid network whose 34 weights are an array: for each
    hidden node its bias and inputs, then for each output its bias and hidden nodes."""

    def node(values: list[Column], start: int) -> Column:
        total = reduce(lambda a, b: a + b, (v * F.element_at(weights, start + 2 + i) for i, v in enumerate(values)), F.element_at(weights, start + 1))
        return 1 / (1 + F.exp(-total))

    hidden = [node(inputs, h * (INPUTS + 1)) for h in range(HIDDEN)]
    first = HIDDEN * (INPUTS + 1)
    return node(hidden, first), node(hidden, first + HIDDEN + 1)


def answer_types(scored: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, category, score): the best categories with YES above and NO below a half; else miscellaneous.

    ``scored`` is (query_id, category, yes, no).
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "category")
    good = scored.filter("yes > 0.5 and no < 0.5").withColumn("score", F.col("yes") - F.col("no")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k)
    rest = scored.select("query_id").distinct().join(good.select("query_id").distinct(), "query_id", "left_anti")
    return good.select("query_id", "category", "score").union(rest.select("query_id", F.lit("miscellaneous"), F.lit(0.0)))


def train_network(patterns: DataFrame, rate: float = 0.10, momentum: float = 0.60, most: int = 1000, goal: float = 0.02, seed: int = 5, sample_rows: int = 10_000) -> list[float]:
    """The 34 weights by batch back-propagation on patterns (s1..s5, label): at most ``sample_rows`` of
    them, those with the least hashes."""
    columns = [f"s{i}" for i in range(1, INPUTS + 1)]
    rows = patterns.select(*columns, "label").orderBy(F.xxhash64(*columns, "label")).limit(sample_rows).toPandas()
    x = np.column_stack([np.ones(len(rows)), rows[columns].to_numpy(float)])
    y = np.column_stack([rows["label"].to_numpy(float), 1 - rows["label"].to_numpy(float)])
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(-0.3, 0.3, (INPUTS + 1, HIDDEN)), rng.uniform(-0.3, 0.3, (HIDDEN + 1, OUTPUTS))
    da, db = np.zeros_like(a), np.zeros_like(b)
    for _ in range(most if len(rows) else 0):
        h = np.column_stack([np.ones(len(x)), 1 / (1 + np.exp(-x @ a))])
        out = 1 / (1 + np.exp(-h @ b))
        if np.mean((y - out) ** 2) < goal:
            break
        slope = (y - out) * out * (1 - out)
        back = (slope @ b.T)[:, 1:] * h[:, 1:] * (1 - h[:, 1:])
        db = rate * h.T @ slope + momentum * db
        da = rate * x.T @ back + momentum * da
        a, b = a + da, b + db
    return [*a.T.ravel().tolist(), *b.T.ravel().tolist()]


def checked_questions(lines: DataFrame, types: list[str]) -> DataFrame:
    """(line_no, problem) of a question file (line_no, number, question, answer): missing or repeated
    numbers, answers not of the form ``text###type``, types that are not known."""
    repeated = F.count("*").over(Window.partitionBy("number")) > 1
    kind = F.element_at(F.split("answer", "###"), -1)
    problem = (
        F.when(F.col("number").isNull(), "no number")
        .when(repeated, "repeated number")
        .when(~F.coalesce(F.col("answer").contains("###"), F.lit(False)), "no answer type")
        .when(~kind.isin(types), "unknown answer type")
    )
    return lines.withColumn("problem", problem).filter("problem is not null").select("line_no", "problem")
