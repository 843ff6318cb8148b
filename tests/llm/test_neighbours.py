"""Multiprobe hashing against exact search."""

import itertools
import os
import random

import numpy as np
import pytest

from glossmill.llm import neighbours, queries

FIELDS = "vec_id long, embedding array<float>, label int, key string, v string, ids int, place long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2, 3) for i, v in rows], FIELDS).repartition(3)


def exact(rows, every, top):
    """For each query the (id, score) of all candidates in order."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in good:
        if q % every == 0:
            best = {c: max(float((a * b).sum()) for a in good[q] for b in vs if len(a) == len(b)) for c, vs in good.items() if c != q and any(len(a) == len(b) for a in good[q] for b in vs)}
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:top]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_few_vectors_are_searched_whole(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(120)]  # many ties and zero vectors
    rows += [(200 + i, [1.0, 1.0, 0.0]) for i in range(60)] + [(40, [0.0, 3.0, 1.0]), (3, [5.0, 5.0, 5.0])]
    rows += [(300, None), (301, []), (302, [0.0, -0.0, 0.0]), (303, [1.0, None, 2.0]), (304, [float("nan"), 1.0, 1.0]), (305, [float("inf"), 1.0, 1.0]), (None, [9.0, 9.0, 9.0]), (320, [-0.0, 1.0, 0.0])]
    rows += [(400, [1.0, 2.0]), (401, [3.0, 1.0]), (402, [0.5] * 3)] + rows[:9]
    found = got(neighbours.nearest_neighbours(table(spark, rows), every=20, top=7))
    assert found == {q: n for q, n in exact(rows, 20, 7).items() if n}
    assert [i for i, _ in found[400]] == [401]


def test_no_vectors_and_no_queries(spark):
    assert neighbours.nearest_neighbours(table(spark, [])).count() == 0
    assert neighbours.nearest_neighbours(table(spark, [(1, [1.0]), (2, [2.0])])).count() == 0
    assert neighbours.nearest_neighbours(table(spark, [(20, [1.0])])).count() == 0


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_scores(spark, norms, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 24)
    monkeypatch.setattr(neighbours, "PART", 40)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 12))
    v = middles[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 12)) * 0.5
    v = v * rng.lognormal(0, 0.5, (3000, 1)) if norms else v / np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)] + [(5000 + i, v[7].astype(np.float32).tolist()) for i in range(1500)]  # a third is one vector
    found, true = got(neighbours.nearest_neighbours(table(spark, rows), every=50, top=10)), exact(rows, 50, 10)
    assert set(found) == set(true) and all(len(n) == 10 for n in found.values())
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in true[q]}) / 10 for q in true])
    assert recall >= 0.9
    x = dict(rows)
    for q, near in found.items():
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))
        for i, score in near:
            assert score == float((np.array(x[q], np.float32).astype(float) * np.array(x[i], np.float32).astype(float)).sum())


def test_probes_go_by_distance_to_the_edges():
    for k in (1, 2, 3):
        found = neighbours.probe_template(k, 100)
        assert len(found) == 3**k and not found[0].any()
        assert len({tuple(r) for r in found}) == len(found)
        assert all(r[j] + r[2 * k - 1 - j] < 2 for r in found for j in range(k))
    hashed = neighbours.StableHash(1, 3, 5, 1.0, 1.0)
    x = hashed.queries(np.array([[0.3, -1.0, 0.4, 0.2]]))
    visited = hashed.probes(x, 0, 27)[0]
    assert visited[0] == hashed.codes(x, 0)[0] and len(set(visited.tolist())) == 27
    a, b, factors, shift = hashed._functions(0, 4)
    slots = np.floor((x @ a + b) / neighbours.WIDTH).astype(np.int64)[0]
    around = {int(((slots + np.array(d)) * factors).sum() + shift) for d in itertools.product((-1, 0, 1), repeat=3)}
    assert around == set(visited.tolist())


def test_recall_on_the_tables(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found, true = got(queries.op11_multiprobe_neighbours(spark, folder)), exact(rows, 20, 20)
    assert set(found) == set(true)
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in true[q]}) / len(true[q]) for q in true]) >= 0.9
