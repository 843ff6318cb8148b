"""Nearest neighbours by multiprobe p-stable hashing, reranked exactly.

Inner products become distances: vectors are scaled so that the longest has length one and given one
more component that makes every length one; queries are made of length one, with that component
zero. The nearest vector is then the one of largest inner product. A table has K hash functions
floor((a.x + b) / w) with normal a; a bucket is K slots. A query visits its own bucket and those next
to it in some slots, in the order of the template of perturbation sets, by expected distance to the
slots' edges: the likelier hits come first. Candidates of all tables are scored in the task that holds the
bucket, so no pair leaves it unless it is among a query's nearest there.

What is fitted: K is the least number at which sampled vectors would share a bucket with about
``BUCKET`` others, and the number of probes is the least at which ``TARGET`` of the true
neighbours of sampled queries, found by an exact pass over all vectors, are reached; where ``MOST_PROBES``
do not reach them, K becomes smaller. The samples are ``SAMPLE`` vectors and ``SAMPLE_QUERIES``
queries, least by hash, so that both passes are bounded; all vectors are indexed.

Equal vectors are one entry with the least ids, as many as can be among the nearest, and equal queries
are searched once. A bucket with many entries is dealt to parts, each of which a query visits; the limit
grows with the table so that at most ``_CROWDED`` such buckets are known to every task. Queries are sent
to the parts of the index that hold their buckets, once to each.

Defined cases: vectors null, empty, zero, or with components null or not finite take no part, nor do rows
without an id; vectors of different length are not compared; rows that share an id and the vector
count once, and a query is never its own neighbour, whatever rows share its id; ties go to the
smaller id; a query with fewer candidates has fewer rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .words import mix

#: Entries that a bucket should have, its most before it is dealt to parts, and a table that is one bucket.
BUCKET, PART, WHOLE = 1024, 4096, 256
#: Vectors and queries that the index is fitted to.
SAMPLE, SAMPLE_QUERIES = 4096, 128
#: The share of true neighbours of sampled queries that probes must reach, and the most probes of a table.
TARGET, MOST_PROBES = 0.96, 4096
#: Width of a slot; all vectors have length one, so their projections have deviation one.
WIDTH = 3.0
_CROWDED = 1_000_000
_PLACE = 16 << 20  # bytes of entries in a place of the index
_SALTS = 16


@cache
def probe_template(functions: int, probes: int) -> np.ndarray:
    """Perturbation sets by expected success: rows of 0 and 1 over the 2K moves of a query in order of
    their distance. Moves j and 2K-1-j belong to one function, so a set has at most one of them."""
    k, n = functions, 2 * functions
    expected = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (n + 1 - j) / (k + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, n + 1)]
    sets: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))] if n else []
    while heap and len(sets) < probes:
        score, moves = heapq.heappop(heap)
        if not any(n - 1 - m in moves for m in moves):
            sets.append(moves)
        last = moves[-1]
        if last + 1 < n:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*moves[:-1], last + 1)))
            if n - 1 - last not in moves[:-1]:  # nothing that grows from a set with both moves is valid
                heapq.heappush(heap, (score + expected[last + 1], (*moves, last + 1)))
    out = np.zeros((len(sets), n), np.int64)
    for i, moves in enumerate(sets):
        out[i, list(moves)] = 1
    return out


@dataclass(frozen=True)
class StableHash:
    """The hash functions of all tables, the same in every task."""

    tables: int
    functions: int
    seed: int
    longest: float  # the greatest length of a vector, in units of ``unit``
    unit: float

    def _functions(self, table: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        rng = np.random.default_rng((self.seed, table, size))
        a, b = rng.normal(size=(size + 1, 32))[:, : self.functions], rng.uniform(0, WIDTH, 32)[: self.functions]
        factors = rng.integers(-(1 << 62), 1 << 62, 33)
        return a, b, factors[: self.functions] | 1, factors[32]

    def entries(self, v: np.ndarray) -> np.ndarray:
        """Vectors of length one for those given."""
        x = v / self.unit / self.longest
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
        return np.hstack([x, rest[:, None]])

    def queries(self, v: np.ndarray) -> np.ndarray:
        x = v / np.abs(v).max(axis=1, keepdims=True)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return np.hstack([x, np.zeros((len(x), 1))])

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each vector of length one."""
        a, b, factors, shift = self._functions(table, x.shape[1] - 1)
        return (np.floor((x @ a + b) / WIDTH).astype(np.int64) * factors).sum(axis=1) + shift

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The buckets that each query visits, in order."""
        a, b, factors, shift = self._functions(table, x.shape[1] - 1)
        place = (x @ a + b) / WIDTH
        slot = np.floor(place)
        edge = place - slot
        order = np.argsort(np.hstack([edge, 1 - edge]), axis=1, kind="stable")
        step = np.concatenate([-factors, factors])[order]
        base = (slot.astype(np.int64) * factors).sum(axis=1) + shift
        return base[:, None] + step @ probe_template(self.functions, n).T


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors, their rows and their matrix."""
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(bounds)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[bounds[:-1][rows, None] + np.arange(size)].astype(np.float64)


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added in an order that depends on their length alone."""
    return (x * y).sum(axis=1)


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(key, id, v) of the vectors that take part; equal vectors have one key."""
    v = F.col(vec_col)
    zero = F.lit(0).cast(table.schema[vec_col].dataType.elementType)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = table.filter(F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, good) & F.exists(v, lambda x: x != zero))
    kept = kept.select(F.col(id_col).alias("id"), F.transform(v, lambda x: x + zero).alias("v"))  # minus zero becomes zero
    key = F.substring(F.sha2(F.to_json(F.struct("v")), 256), 1, 32)
    return kept.withColumn("key", key).groupBy("key", "id").agg(F.first("v").alias("v"))


def _entries(vectors: DataFrame, most: int) -> DataFrame:
    """(key, v, ids): each distinct vector with its least ids in order."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    kept = vectors.withColumn("o", rank).filter(F.col("o") <= most)  # each task keeps as many of a hot vector
    return kept.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


class _Best:
    """The best entries so far of each query: by score, then least id."""

    def __init__(self, queries: int, most: int):
        self.score = np.full((queries, most), -np.inf)
        self.first = np.zeros((queries, most), np.int64)
        self.row = np.full((queries, most), -1)

    def offer(self, queries: np.ndarray, scores: np.ndarray, first: np.ndarray, rows: np.ndarray) -> None:
        """Scores of some queries with the entries ``rows``, whose least ids are ``first``."""
        most = self.score.shape[1]
        wide = lambda x: np.broadcast_to(x, scores.shape)
        score = np.hstack([self.score[queries], scores])
        ids, row = np.hstack([self.first[queries], wide(first)]), np.hstack([self.row[queries], wide(rows)])
        order = np.lexsort(np.stack([ids, -score]), axis=1)[:, :most]
        for own, new in ((self.score, score), (self.first, ids), (self.row, row)):
            own[queries] = np.take_along_axis(new, order, axis=1)


def _nearest_of(sample: dict[int, np.ndarray], entries: DataFrame, most: int) -> dict[tuple[int, int], np.ndarray]:
    """For each sampled query, as (length, row), the vectors nearest to it, by one pass over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {size: (_Best(len(q), most), []) for size, q in sample.items()}
        for batch in batches:
            for _, x in _matrices(batch.column("v")):
                if x.shape[1] in held:
                    best, kept = held[x.shape[1]]
                    q = sample[x.shape[1]]
                    scores = q @ x.T
                    scores[(q[:, :1] == x[:, 0]) & (scores >= _scores(q, q)[:, None] * (1 - 1e-12))] = -np.inf  # itself
                    best.offer(np.arange(len(scores)), scores, np.zeros(len(x), np.int64), np.arange(len(x)) + sum(map(len, kept)))
                    kept.append(x)
                    rows = np.unique(best.row[best.row >= 0])  # only these are needed on
                    kept[:] = [np.concatenate(kept)[rows]]
                    best.row[:] = np.where(best.row >= 0, np.searchsorted(rows, best.row), -1)
        for size, (best, kept) in held.items():
            q, j = np.nonzero(np.isfinite(best.score))
            if len(q):
                x = kept[0][best.row[q, j]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), size)), pa.array(q), pa.array(best.score[q, j]), lists], ["size", "q", "score", "v"])

    rows = entries.select("v").mapInArrow(run, "size long, q long, score double, v array<double>")
    rank = F.row_number().over(Window.partitionBy("size", "q").orderBy(F.desc("score")))
    out: dict[tuple[int, int], list] = {}
    for r in rows.withColumn("o", rank).filter(F.col("o") <= most).collect():  # SAMPLE_QUERIES * most
        out.setdefault((r.size, r.q), []).append(r.v)
    return {k: np.array(x) for k, x in out.items()}


def fitted(entries: DataFrame, queries: DataFrame, tables: int, most: int, seed: int) -> tuple[StableHash, int]:
    """The hash functions for these entries and how many probes of a table reach ``TARGET``."""
    by_hash = lambda df, n: df.orderBy(F.xxhash64("key"), "key").limit(n).select("v").collect()
    unit = entries.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))))).first()[0]
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x.cast("double") / unit) * (x.cast("double") / unit))
    n, longest = entries.agg(F.count("*"), F.max(square)).first()
    longest = float(np.sqrt(longest)) * (1 + 1e-9)
    sample: dict[int, list] = {}
    for r in by_hash(entries, SAMPLE):
        sample.setdefault(len(r.v), []).append(r.v)
    most_common = np.array(max(sample.values(), key=len), float)

    def crowd(k: int) -> float:
        hashed = StableHash(1, k, seed, longest, unit)
        held = np.unique(hashed.codes(hashed.entries(most_common), 0), return_counts=True)[1].astype(float)
        return n * (held * (held - 1)).sum() / max(1, len(most_common) * (len(most_common) - 1))

    if n <= WHOLE:
        return StableHash(tables, 0, seed, longest, unit), 1
    functions = next((k for k in range(1, 32) if crowd(k) <= BUCKET), 32)
    asked: dict[int, list] = {}
    for r in by_hash(queries, SAMPLE_QUERIES):
        asked.setdefault(len(r.v), []).append(r.v)
    asked = {size: np.array(v, float) for size, v in asked.items()}
    true = _nearest_of(asked, entries, most)
    while functions:
        hashed = StableHash(tables, functions, seed, longest, unit)
        reached = []
        for (size, q), near in true.items():
            x, y = hashed.queries(asked[size][q : q + 1]), hashed.entries(near)
            at = np.full(len(near), MOST_PROBES)
            for t in range(tables):
                visited = {c: i for i, c in reversed(list(enumerate(hashed.probes(x, t, MOST_PROBES)[0].tolist())))}
                at = np.minimum(at, [visited.get(c, MOST_PROBES) for c in hashed.codes(y, t).tolist()])
            reached.append(at)
        at = np.sort(np.concatenate([*reached, np.empty(0, int)]))
        needed = at[min(len(at) - 1, int(np.ceil(TARGET * len(at))) - 1)] + 1 if len(at) else 1
        if needed <= MOST_PROBES:
            return hashed, int(needed)
        functions -= 1
    return StableHash(tables, 0, seed, longest, unit), 1


@dataclass
class _Crowded:
    """Buckets of many entries, and to how many parts their entries are dealt."""

    codes: np.ndarray
    parts: np.ndarray
    places: int

    def parts_of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.ones(len(codes), np.int64)
        i = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[i] == codes, self.parts[i], 1)

    def place(self, codes: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix(codes.view(np.uint64) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.places)).astype(np.int64)


_NAMES = ["place", "kind", "code", "codes", "key", "v", "ids"]


def _crowded(entries: DataFrame, hashed: StableHash, n: int) -> _Crowded:
    limit = max(PART, n * hashed.tables // _CROWDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _matrices(batch.column("v")):
                x = hashed.entries(x)
                for t in range(hashed.tables):
                    codes, held = np.unique(hashed.codes(x, t), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(held)], ["code", "n"])

    counts = entries.select("v").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = sorted((r.code, -(-r.n // limit)) for r in counts.filter(F.col("n") > limit).collect())  # _CROWDED at most
    size = entries.agg(F.sum(F.size("v"))).first()[0] * 8 * hashed.tables
    places = max(entries.sparkSession.sparkContext.defaultParallelism, -(-size // _PLACE))
    return _Crowded(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), places)


def _index_rows(entries: DataFrame, hashed: StableHash, crowded: Broadcast) -> DataFrame:
    """Each entry in the place of its bucket, for each table."""
    schema, types = _row_schema(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column("v")):
                x, own = hashed.entries(x), batch.take(pa.array(rows))
                # Entries of a crowded bucket are dealt by their own digest.
                deal = np.array([int(k[:15], 16) for k in own.column("key").to_pylist()], np.int64)
                for t in range(hashed.tables):
                    codes = hashed.codes(x, t)
                    place = crowded.value.place(codes, deal % crowded.value.parts_of(codes))
                    n = len(rows)
                    columns = [pa.array(place), pa.array(np.zeros(n, np.int32)), pa.array(codes), pa.nulls(n, types["codes"]), pa.nulls(n, pa.string()), own.column("v"), own.column("ids")]
                    yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return entries.mapInArrow(run, schema)


def _query_rows(queries: DataFrame, hashed: StableHash, probes: int, crowded: Broadcast, like: DataFrame) -> DataFrame:
    """Each query in every place that holds a bucket that it visits, with the buckets visited there."""
    schema, types = _row_schema(like)
    step = max(1, (1 << 19) // (probes * hashed.tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, v in _matrices(batch.column("v")):
                for i in range(0, len(rows), step):
                    x, own = hashed.queries(v[i : i + step]), batch.take(pa.array(rows[i : i + step]))
                    codes = np.hstack([hashed.probes(x, t, probes) for t in range(hashed.tables)])
                    q, codes = np.repeat(np.arange(len(x)), codes.shape[1]), codes.ravel()
                    parts = crowded.value.parts_of(codes)
                    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    q, codes = np.repeat(q, parts), np.repeat(codes, parts)
                    place = crowded.value.place(codes, part)
                    order = np.lexsort((codes, place, q))
                    q, codes, place = q[order], codes[order], place[order]
                    new = np.ones(len(q), bool)  # two parts of a bucket in one place are visited once
                    new[1:] = (q[1:] != q[:-1]) | (place[1:] != place[:-1]) | (codes[1:] != codes[:-1])
                    q, codes, place = q[new], codes[new], place[new]
                    head = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (place[1:] != place[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(q)), pa.int32()), pa.array(codes))
                    n, own = len(head), own.take(pa.array(q[head]))
                    columns = [pa.array(place[head]), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), lists, own.column("key"), own.column("v"), pa.nulls(n, types["ids"])]
                    yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return queries.mapInArrow(run, schema)


def _row_schema(entries: DataFrame) -> tuple[str, dict[str, pa.DataType]]:
    v, ids = (entries.schema[c].dataType.simpleString() for c in ("v", "ids"))
    return f"place long, kind int, code long, codes array<long>, key string, v {v}, ids {ids}", {"codes": pa.list_(pa.int64()), "ids": pa.list_(pa.int64())}


class _Place:
    """The entries of a place, by length and bucket."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()
        self.ids = pa.concat_arrays([b.column("ids") for b in rows])
        self.held: dict[int, tuple] = {}
        codes = np.concatenate([b.column("code").to_numpy() for b in rows])
        first = self.ids.flatten().to_numpy()[self.ids.offsets.to_numpy()[:-1] - self.ids.offsets[0].as_py()]
        for at, x in _matrices(pa.concat_arrays([b.column("v") for b in rows])):
            order = np.argsort(codes[at], kind="stable")
            buckets, bounds = np.unique(codes[at][order], return_index=True)
            self.held[x.shape[1]] = (buckets, np.append(bounds, len(at)), x[order], at[order], first[at][order])

    def answers(self, batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
        """(key, score, ids) of the best entries that each query meets here."""
        lists = batch.column("codes")
        bounds, codes = lists.offsets.to_numpy(), lists.values.to_numpy()
        for rows, v in _matrices(batch.column("v")):
            if v.shape[1] not in self.held:
                continue
            buckets, ends, x, at, first = self.held[v.shape[1]]
            for i in range(0, len(rows), 1024):
                some, q = rows[i : i + 1024], v[i : i + 1024]
                n = bounds[some + 1] - bounds[some]
                who = np.repeat(np.arange(len(some)), n)
                asked = codes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[some], n)]
                where = np.minimum(np.searchsorted(buckets, asked), len(buckets) - 1)
                who, where = who[buckets[where] == asked], where[buckets[where] == asked]
                order = np.argsort(where, kind="stable")
                who, where = who[order], where[order]
                best = _Best(len(some), most)
                for bucket, own in zip(np.unique(where), np.split(who, np.flatnonzero(np.diff(where)) + 1), strict=True) if len(where) else ():
                    a, b = ends[bucket], ends[bucket + 1]
                    best.offer(own, q[own] @ x[a:b].T, first[a:b], np.arange(a, b))
                who, j = np.nonzero(best.row >= 0)
                row = best.row[who, j]
                score = _scores(q[who], x[row])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some[who])), pa.array(score), self.ids.take(pa.array(at[row]))], ["key", "score", "ids"])


def _met(rows: DataFrame, most: int) -> DataFrame:
    """(key, score, ids) of what queries meet; in a place entries come before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, place = None, [], None
        for batch in batches:
            places, kinds = batch.column("place").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
                if b <= a:
                    continue
                if places[a] != now:
                    now, held, place = places[a], [], None
                if kinds[a] == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    place = place or _Place(held)
                    yield from place.answers(pa.RecordBatch.from_struct_array(batch.slice(a, b - a).to_struct_array().take(pa.array(np.arange(b - a)))), most)

    return rows.repartition("place").sortWithinPartitions("place", "kind").mapInArrow(run, f"key string, score double, ids {rows.schema['ids'].dataType.simpleString()}")


def nearest_neighbours(table: DataFrame, every: int = 20, top: int = 20, tables: int = 2, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``top`` of the candidates found that have the
    largest inner product with it. Queries are the rows whose id ``every`` divides, or those given."""
    vectors = written(_vectors(table, id_col, vec_col), "vectors")
    asks = F.col("id") % every == 0 if queries is None else queries
    entries = written(_entries(vectors, top + 1), "entries")
    asked = written(vectors.filter(asks).select("key", "id"), "asked")
    whole = written(entries.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v"), "queries")
    if whole.isEmpty():
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).filter("false")
    hashed, probes = fitted(entries, whole, tables, top, seed)
    if not hashed.functions:
        hashed = StableHash(1, 0, seed, hashed.longest, hashed.unit)  # one bucket holds all
    crowded = table.sparkSession.sparkContext.broadcast(_crowded(entries, hashed, entries.count()))
    rows = _index_rows(entries, hashed, crowded).union(_query_rows(whole, hashed, probes, crowded, entries))
    found = _met(rows, top + 1).select("key", "score", F.explode("ids").alias("vec_id")).groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    order = F.desc("score"), F.col("vec_id")
    found = found.withColumn("o", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("o") <= top + 1)
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))  # many queries may have one vector
    each = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).withColumnRenamed("id", "query_id")
    pairs = each.join(found, ["key", "salt"]).filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
