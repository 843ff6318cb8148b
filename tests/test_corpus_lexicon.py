import math

from glossmill.operators import lexicon
from glossmill.plans import corpus_lexicon
from pyspark.sql import functions as F


def test_words_are_counted_before_they_meet_the_dictionary(spark):
    docs = spark.createDataFrame([(1, "The Fox saw the fox. to fox"), (2, "the fox to run, DER Ärger der Ärger"), (3, None), (4, "")], "doc_id long, text string")
    asking = [w for words in corpus_lexicon.BEFORE.values() for w in words]
    rows = corpus_lexicon.tagged_words(docs).withColumn("previous", F.when(F.col("previous").isin(asking), F.col("previous"))).groupBy("word", "small", "previous", "pos").agg(F.count("*").alias("n"))
    assert sorted(map(str, corpus_lexicon.counted_words(docs).collect())) == sorted(map(str, rows.collect()))
    found = corpus_lexicon.dictionary(docs)
    assert [tuple(r) for r in found["words"].collect()] == [("fox", "n", "n:fox", 3, False)]
    assert "text" not in found["signatures"]._jdf.queryExecution().optimizedPlan().toString()  # stored counts, no texts


def test_only_words_of_signatures_meet_senses(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    targets = frame([("a", "fox"), ("b", "fox"), ("c", "owl")], "target string, word string")
    contexts = frame([("a", "the"), ("a", "red"), ("a", "zzz"), ("b", "zzz")], "target string, term string")
    words = frame([("fox", "n1", 3), ("fox", "v1", 1), ("owl", "n2", 0)], "word string, synset string, tag_count long")
    signatures = frame([("n1", "the", 0.5), ("n1", "red", 0.25), ("v1", "to", 1.0), ("v1", "red", 0.0)], "synset string, term string, p double")
    found = lexicon.sense_scores(targets, contexts, words, signatures)
    scores = {(r.target, r.synset): round(r.score, 6) for r in found.collect()}
    fox, verb = math.log2(0.75), -2.0
    assert scores == {("a", "n1"): round(fox - 1 - 2 - 100, 6), ("a", "v1"): verb - 300, ("b", "n1"): round(fox - 100, 6), ("b", "v1"): verb - 100, ("c", "n2"): -100}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
