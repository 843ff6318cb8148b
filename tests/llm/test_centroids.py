"""Centroid clustering against plain Lloyd rounds in integers."""

import hashlib
import random

import numpy as np
import pytest

from glossmill.llm import centroids


def lloyd(rows, k, rounds, size, scale, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and abs(x) < float("inf") for x in v):
            kept.append((i, [int(np.floor(float(x) * scale)) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    heads = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, h)), c) for c, h in enumerate(heads))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(heads)):
            group = [v for (_, v), o in zip(kept, own) if o == c]
            if group:
                heads[c] = [sum(x) // len(group) for x in zip(*group)]
    last = [(i, *nearest(v)) for i, v in kept]
    each = [sum(d for _, d, o in last if o == c) for c in range(len(heads))]
    digest = [hashlib.sha256(",".join(map(str, h)).encode()).hexdigest() for h in heads]
    return sorted(((i, c, d, each[c], sum(each), digest[c]) for i, d, c in last), key=str)


FIELDS = "vec_id long, embedding array<float>, label int, v string, cluster string, distance long, lower int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2, 3) for i, v in rows], FIELDS).repartition(3)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("k,groups", [(8, None), (8, 1), (5, 5), (1, None)])
def test_same_as_plain_rounds(spark, k, groups):
    rng = random.Random(k)
    rows = [(i, [float(np.float32(rng.gauss(i % 4, 0.6))) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.25, 0.5, 0.0, 0.125, 1.0]) for i in range(150)]  # a hot vector
    rows += [(1, [0.0] * 6), (1, [0.0] * 6), (None, [1.0] * 6), (2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None] * 3), (2004, [float("nan")] * 6), (2005, [float("inf")] + [0.0] * 5)]
    found = centroids.cluster_vectors(table(spark, rows), k=k, rounds=7, size=6, scale=64, groups=groups)
    assert got(found) == lloyd(rows, k, 7, 6, 64)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-4, 5) for y in range(-4, 5))] * 2
    assert got(centroids.cluster_vectors(table(spark, rows), k=6, rounds=5, size=2, scale=1)) == lloyd(rows, 6, 5, 2, 1)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert got(centroids.cluster_vectors(table(spark, rows), k=8, rounds=3, size=2)) == lloyd(rows, 8, 3, 2, 1024)
    assert got(centroids.cluster_vectors(table(spark, [(1, None)]), size=2)) == []


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(table(spark, [(1, [1e30, 0.0])]), size=2).collect()


def test_filters_leave_out_most_distances():
    rng = np.random.default_rng(4)
    middles = rng.integers(-5000, 5000, (32, 8))
    v = middles[rng.integers(0, 32, 4000)] + rng.integers(-40, 40, (4000, 8))
    groups = centroids.centroid_groups(middles, 8)
    start = (np.full(4000, -1, np.int32), np.full(4000, np.inf), np.full((4000, len(groups)), -np.inf))
    *state, done = centroids.Assigner(middles, middles, groups).assign(v, *start)
    assert done == 4000 * 32
    after = middles + rng.integers(-3, 4, middles.shape)
    *state, done = centroids.Assigner(after, middles, groups).assign(v, *state)
    assert done < 4000 * 4
    plain = np.array([centroids._square_distances(v, c) for c in after]).argmin(axis=0)
    assert (state[0] == plain).all()
