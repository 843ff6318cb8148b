"""The best documents from blocks of postings against all postings."""

import random

from pyspark.sql import functions as F

from glossmill.operators import inverted_index


def test_same_as_all_postings_with_fewer_blocks(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["fox", "owl", "river", "stone", "cloud", "grass"]) for _ in range(max(1, int(rng.paretovariate(0.8)))))) for i in range(900)]
    index = inverted_index.postings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    blocks = inverted_index.impact_blocks(index, 20).cache()
    assert blocks.agg(F.sum(F.size("entries"))).first()[0] == index.count()
    for words, k in ((["fox", "OWL"], 10), (["cloud"], 3), (["fox", "owl", "river", "stone"], 25), (["nothing"], 5), (["fox"], 10_000)):
        seen = {}
        got = [tuple(r) for r in inverted_index.top_documents(blocks, words, k, seen=seen).collect()]
        expected = inverted_index.retrieve(index, " OR ".join(w.lower() for w in words)).orderBy(F.desc("weight"), "doc_id").limit(k)
        assert got == [tuple(r) for r in expected.collect()]
        assert seen["read"] < seen["blocks"] / 3 or k > 900 or words == ["nothing"]
