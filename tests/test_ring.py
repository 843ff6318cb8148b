"""The order of similar nodes on a circle against a greedy choice of edges in Python."""

import random

import pytest

from glossmill.operators import graphs, inverted_index, vectors  # noqa: F401

SCHEMA = "a long, b long, sim double"


def greedy(edges, nodes):
    """The edges from the strongest on that join ends of different chains."""
    degree, root, out = {}, {n: n for n in nodes}, set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if degree.get(a, 0) < 2 and degree.get(b, 0) < 2 and find(a) != find(b):
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
            root[find(a)] = find(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ring_takes_the_greedy_edges(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(60)) + [100, 101]
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(170)})
    edges = [(a, b, rng.choice([0.2, 0.4, 0.4, 0.7]) if seed == 1 else rng.random()) for a, b in edges]
    ring = graphs.ring_order(spark.createDataFrame(edges, SCHEMA).repartition(3), spark.createDataFrame([(n,) for n in nodes], "node long")).collect()
    assert sorted(r.position for r in ring) == list(range(len(nodes))) and sorted(r.node for r in ring) == nodes
    by_place = sorted(ring, key=lambda r: r.position)
    beside = {tuple(sorted((x.node, y.node))) for x, y in zip(by_place, by_place[1:]) if x.chain == y.chain}
    assert beside == greedy(edges, nodes)
    assert all(r.length == sum(x.chain == r.chain for x in ring) for r in ring)


def test_three_topics_stay_apart(spark):
    topics = [
        ["rain storm wind flood coast", "storm wind rain damage coast", "flood rain river wind storm", "wind storm coast flood rain"],
        ["goal match team striker league", "team match goal coach league", "league striker goal team match", "coach team goal striker match"],
        ["bank shares profit market fund", "market profit bank shares index", "fund market shares bank profit", "index profit shares market bank"],
    ]
    texts = [(i * 10 + j, t) for i, topic in enumerate(topics) for j, t in enumerate(topic)] + [(99, "unlike anything else here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = vectors.cosine_pairs(vectors.frequency_vectors(vectors.term_frequencies(docs)))
    nodes = docs.selectExpr("doc_id as node")
    ring = graphs.ring_order(pairs, nodes)
    order = [r.node // 10 for r in ring.orderBy("position").collect()]
    assert sum(x != y for x, y in zip(order, order[1:])) == 3  # each topic in one run, then the lone text
    for share in (0.0, 0.5, 1.0):
        found = {r.node: r.cluster for r in graphs.ring_clusters(pairs, ring, share).collect()}
        assert found[99] is None
        groups = {frozenset(n for n in found if found[n] == c) for c in set(found.values()) - {None}}
        assert groups == {frozenset(i * 10 + j for j in range(4)) for i in range(3)}


def test_no_edges_and_no_nodes(spark):
    edges = spark.createDataFrame([], SCHEMA)
    assert graphs.ring_order(edges, spark.createDataFrame([], "node long")).count() == 0
    ring = graphs.ring_order(edges, spark.createDataFrame([(2,), (1,)], "node long"))
    assert [r.node for r in ring.orderBy("position").collect()] == [1, 2]
    assert all(r.cluster is None for r in graphs.ring_clusters(edges, ring).collect())
