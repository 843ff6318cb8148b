"""Centroid clustering with grouped bounds (Yinyang) on exact integers.

Components become integers, so that distances, sums and their floors are exact and no order of
addition matters. The starting centroids are put into groups once. A vector keeps its centroid, an
upper bound of the distance to it and a lower bound for the other centroids of each group. When
centroids move, bounds move by as much; a vector whose upper bound stays below all its lower bounds
keeps its centroid unread (the global filter), then groups are left out likewise, then centroids
within a group, and the centroids that survive are compared exactly. Bounds are widened by more
than rounding can take from them, and equality never filters, so ties go to the smaller number.

Each round writes the vectors with their state to the shared folder and reads back only those that
changed their centroid: their differences, summed in each task and then by centroid, move the
sums. Only k sums of k centroids reach the driver. When none changes, later rounds would not
either.

Defined cases: vectors null, of another length, or with components null or not finite are left out;
rows without an id take part and come last as starting centroids; rows that share an id are vectors
of their own; with fewer than k vectors each is a centroid; an empty table gives no rows. Components
of absolute value over 2**27 after scaling are an error, since their squared distances need not fit a
long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Rounds, written

_LARGEST = float(1 << 27)
#: Bounds are widened by this factor, far more than the rounding of a few operations.
_SLACK = 1e-9


def integer_vectors(table: DataFrame, size: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, each component x as floor(scale * x)."""
    vec = F.col(vec_col)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = table.filter((F.size(vec) == size) & F.forall(vec, good)).select(F.col(id_col).alias("vec_id"), vec.cast("array<double>").alias("v"))
    scaled = lambda x: F.floor(
        F.when(F.abs(x * scale) <= _LARGEST, x * scale).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("double"))
    )
    return kept.select("vec_id", F.transform("v", scaled).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _square_distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def centroid_groups(centroids: np.ndarray, n: int) -> list[np.ndarray]:
    """The numbers of the centroids in each of at most n groups of near ones."""
    heads, own = centroids[:n].astype(float), np.zeros(len(centroids), int)
    for _ in range(5):
        own = np.argmin([_square_distances(centroids.astype(float), h) for h in heads], axis=0)
        heads = np.array([centroids[own == g].mean(axis=0) if (own == g).any() else h for g, h in enumerate(heads)])
    return [np.flatnonzero(own == g) for g in range(len(heads)) if (own == g).any()]


class Assigner:
    """Finds the nearest centroid of vectors whose bounds hold for the centroids before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray, groups: list[np.ndarray]):
        self.centroids, self.groups = centroids, groups
        self.moved = np.array([np.sqrt(float(_square_distances(c[None], b)[0])) for c, b in zip(centroids, before, strict=True)]) * (1 + _SLACK)

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper and lower for the present centroids, and how many distances were computed;
        a cluster of -1 is none yet, with bounds that filter nothing."""
        cluster, upper, before = cluster.copy(), upper.copy(), lower
        upper += np.where(cluster >= 0, self.moved[cluster], 0)
        lower = before - np.array([self.moved[g].max() for g in self.groups])
        open_ = np.flatnonzero(upper >= lower.min(axis=1))  # the global filter
        if not len(open_):
            return cluster, upper, lower, 0
        exact = np.full((len(open_), len(self.centroids)), np.iinfo(np.int64).max)
        bound = np.empty(exact.shape)
        for g, members in enumerate(self.groups):
            bound[:, members] = before[open_, g, None] - self.moved[members]
        best, own, done = upper[open_], cluster[open_], 0

        def scan(rows: np.ndarray, c: int) -> None:
            nonlocal done
            d = _square_distances(v[open_[rows]], self.centroids[c])
            exact[rows, c] = d
            root = np.sqrt(d.astype(float))
            bound[rows, c] = root * (1 - _SLACK)
            best[rows] = np.minimum(best[rows], root * (1 + _SLACK))
            done += len(rows)

        for c in np.unique(own[own >= 0]):  # the distance to the own centroid tightens the bound
            rows = np.flatnonzero(own == c)
            best[rows] = np.inf
            scan(rows, c)
        for g, members in enumerate(self.groups):
            near = lower[open_, g] <= best  # the group filter
            for c in members:
                scan(np.flatnonzero(near & (own != c) & (bound[:, c] <= best)), c)  # the local filter
        new = exact.argmin(axis=1)
        rows = np.arange(len(open_))
        cluster[open_] = new
        upper[open_] = np.sqrt(exact[rows, new].astype(float)) * (1 + _SLACK)
        bound[rows, new] = np.inf
        for g, members in enumerate(self.groups):
            lower[open_, g] = bound[:, members].min(axis=1)
        return cluster, upper, lower, done


def _assigned(state: DataFrame, assigner: Assigner, exact: bool = False) -> DataFrame:
    """The state after one assignment; ``before`` is the centroid that each vector had."""
    id_type = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, own = _matrix(batch.column("v")), batch.column("cluster").to_numpy()
            cluster, upper, lower, _ = assigner.assign(v, own, batch.column("upper").to_numpy(), _matrix(batch.column("lower")))
            bounds = pa.array(np.arange(len(own) + 1) * len(assigner.groups), pa.int32())
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster), pa.array(own), pa.array(upper), pa.ListArray.from_arrays(bounds, pa.array(lower.ravel()))]
            if exact:
                columns[1] = pa.array(_square_distances(v, assigner.centroids[cluster]))
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "distance" if exact else "v", "cluster", "before", "upper", "lower"])

    return state.mapInArrow(run, f"vec_id {id_type}, {'distance long' if exact else 'v array<long>'}, cluster int, before int, upper double, lower array<double>")


def _moves(state: DataFrame, k: int, size: int) -> dict[int, tuple[int, list[int]]]:
    """For each centroid, by how much its number of vectors and their sum change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size + 1), object)  # Python integers: a task may sum any number
        for batch in batches:
            if batch.num_rows:
                v = np.hstack([np.ones((batch.num_rows, 1), np.int64), _matrix(batch.column("v"))])
                for name, sign in (("cluster", 1), ("before", -1)):
                    own = batch.column(name).to_numpy()
                    for c in np.unique(own[own >= 0]):
                        total[c] += sign * v[own == c].sum(axis=0)
        c, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array([str(x) for x in total[c, j]], pa.string())], ["c", "j", "x"])

    parts = state.filter("cluster <> before").select("v", "cluster", "before").mapInArrow(run, "c int, j int, x string")
    out: dict[int, tuple[int, list[int]]] = {}
    for row in parts.groupBy("c", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k * (size + 1) numbers at most
        out.setdefault(row.c, [0] * (size + 1))[row.j] = int(row.x)
    return {c: (x[0], x[1:]) for c, x in out.items()}


def _first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids, after the seed and a colon, have the least sha256 in hex."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("o", order).orderBy(F.col("o").asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def cluster_vectors(table: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, groups: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256
    after ``rounds`` rounds of assignment and floor(sum / count), and a last assignment.

    ``groups`` is the number of groups of centroids, by default a quarter of k (a tenth from 40 on).
    The k centroids go to every task: k * size integers.
    """
    vectors = written(integer_vectors(table, size, scale, id_col, vec_col), "vectors")
    centroids = _first_centroids(vectors, k, seed)
    if not len(centroids):
        empty = vectors.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
        return empty.filter("false")
    held = centroid_groups(centroids, min(len(centroids), groups or max(1, k // 4 if k < 40 else k // 10)))
    start = F.lit(float("-inf"))
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array(*[start] * len(held)).alias("lower"))
    turns = Rounds(table.sparkSession, "state")
    counts, sums, before = [0] * len(centroids), [[0] * size for _ in centroids], centroids
    for _ in range(rounds):
        state = turns.written(_assigned(state, Assigner(centroids, before, held)))
        moves = _moves(state, len(centroids), size)
        for c, (n, x) in moves.items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], x, strict=True)]
        before = centroids
        centroids = np.array([[x // counts[c] for x in sums[c]] if counts[c] else centroids[c] for c in range(len(centroids))], np.int64)
        if not moves:
            break
    last = written(_assigned(state, Assigner(centroids, before, held), exact=True).select("vec_id", "cluster", "distance"), "assigned")
    per = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()  # k rows at most
    inertia = {r.cluster: int(r.x) for r in per}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest()) for c in range(len(centroids))]
    named = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
