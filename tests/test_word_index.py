"""The stored word index against the boolean predicate over the texts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from glossmill.functions.boolean_query import boolean_terms, text_match
from glossmill.operators import inverted_index
from glossmill.operators.word_index import WordIndex

TEXTS = [
    "The quick brown fox", "ab1cd ab cd", "ab, cd", "abxycd", "ab xyz cd", "a b c d", "e_business and e-business", "e  business", None, "", "a", "the AI tion", "TION", "ai ai ai",
    "state-of-the-art", "of the\nart", "oft the", "xof the", "of theory", "ünter the über", "😀the😀 end", "1 2 3", "under_score", "the end of the road the end", "fox fox brown fox",
]
QUERIES = [
    "the", "the OR tion OR ai", "NOT the", "fox AND NOT brown", "(the OR ai) NOT fox", '"ab cd"', "ab cd", '"of the"', '"of the art"', '"the end" OR "of the"', "e_business", "e-business", "th*", "*nd", "of*", "st*te", '"-end"', "a", "ai", "NOT (NOT the)", "", "(the", "the AND", '"the end of the road"', "score", "under_score", '"fox brown" OR "1 2"', '"a b c d"', "'oft the'",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    words = "the of and fox ab cd a b end ai tion e_b x1".split()
    texts = [*TEXTS, *("".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n", "_", " - ", ""]) for _ in range(rng.randint(2, 14))) for _ in range(150))]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, term string, segment int").repartition(4)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    index = WordIndex.create(spark, str(tmp_path_factory.mktemp("index") / "words"))
    index.add(docs)
    return index


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize("query", QUERIES)
def test_same_as_the_predicate(docs, index, query):
    expected = ids(docs.filter(text_match(F.col("text"), query)))
    assert ids(index.matching(query, docs=docs)) == expected


@pytest.mark.parametrize("query", ["the", '"ab cd"', "en", '"f th" OR tion'])
def test_fuzzy(docs, index, query):
    assert ids(index.matching(query, True, docs)) == ids(docs.filter(text_match(F.col("text"), query, True)))


@pytest.mark.parametrize("query", ["the OR tion OR ai", "fox OR NOT brown", "brown fox", '"of the"', "(ab AND cd) OR end", "fox* OR a", "AI"])
def test_search_loses_nothing(docs, index, query):
    postings, expected = inverted_index.postings(docs), ids(docs.filter(text_match(F.col("text"), query)))
    assert ids(inverted_index.search(docs, postings, query)) == expected
    found = inverted_index.search(docs, postings, query, words=index)
    assert ids(found) == expected and "text" in found.columns


def test_plain_words_read_no_text(docs, index):
    plan = index.matching("(the OR fox) AND NOT ai")._jdf.queryExecution().executedPlan().toString()
    assert "/postings/" in plan and "text#" not in plan


def test_only_texts_can_tell(index):
    with pytest.raises(ValueError, match="texts"):
        index.matching("st*te")


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_changes_touch_only_their_segment(spark, docs, tmp_path):
    path = str(tmp_path / "words")
    index = WordIndex.create(spark, path)
    assert ids(index.matching("NOT the")) == []
    index.add(docs.filter("doc_id < 100"))
    before = files(path)
    index.add(docs.filter("doc_id >= 90"))
    after = files(path)
    assert all(after[f] == t for f, t in before.items()) and all("/2/" in f or "manifest" in f or "contents" in f for f in after.keys() - before.keys())
    index.remove(docs.filter("doc_id % 7 = 0").select("doc_id"))
    changed = docs.filter("doc_id % 7 = 0 and doc_id < 50").withColumn("text", F.lit("fox now"))
    index.add(changed)
    now = docs.filter("doc_id % 7 <> 0").union(changed)
    assert all(files(path)[f] == t for f, t in after.items())
    for query in ("the", "NOT the", "fox AND now", '"ab cd" OR end'):
        assert ids(index.matching(query, docs=now)) == ids(now.filter(text_match(F.col("text"), query)))
    assert index.merged() and not index.merged()
    for query in ("NOT the", "fox AND now"):
        assert ids(index.matching(query)) == ids(now.filter(text_match(F.col("text"), query)))
    assert index.postings().filter("term = 'now'").count() == changed.count()


def test_terms_of_a_query():
    assert boolean_terms('a "b c" AND NOT a') == ["a", "b c"] and boolean_terms("") == [] and boolean_terms("(a") is None and boolean_terms(None) == []
