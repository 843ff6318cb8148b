"""Packing of tokenized documents into training sequences by length patterns.

The histogram of piece lengths (at most ``capacity`` entries, whatever the corpus) is fitted
on the driver: patterns of up to three lengths that fill a sequence, on a grid of lengths, get
repeat counts by non-negative least squares; the counts are rounded down to what there is, and
the residual pieces go, longest first, where the least room remains. The plan is a list of
runs "this pattern, so many times", so its size follows the number of distinct lengths and not
of documents. Each piece then looks up its place by its rank among the pieces of its length;
ranks are made in salted groups of bounded size.

Defined cases: a null or empty text is the end token alone; only documents longer than
``capacity`` are cut; repeated rows are packed as often as they come; a table without rows
gives none.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .memory import tidy

#: Texts of these characters are cut into words here, in the tokenizer's way; all others go
#: to the tokenizer as they are.
_PLAIN = re.compile("[\\t\\n\\r\\x0b\\x0c\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
_PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_CACHE_WORDS = 400_000
_TOKENIZERS: dict[str, TokenIds] = {}


class TokenIds:
    """Token ids of texts as little-endian 32-bit bytes, with a cache of words.

    The word-level tokenizer lower-cases, drops white space and encodes each word by itself,
    so the ids of a text are those of its words in a row.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> TokenIds:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_words(self, words: list[str]) -> Iterator[bytes]:
        """The same for single words, many at a call: the last token of each word is marked."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                data, at = ids.tobytes(), [0, *(ends * 4).tolist()]
                yield from map(data.__getitem__, map(slice, at[:-1], at[1:]))
            else:
                yield from self._encoded(part)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        cut = [_PIECE.findall(t.lower()) if t and "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        new = list(set().union(*(c for c in cut if c)).difference(self.cache))
        self.cache.update(zip(new, self._encoded_words(new), strict=True))
        for words, text in zip(cut, texts, strict=True):
            if not text:
                yield b""
            elif words is None:
                yield self._encoded([text])[0]
            else:
                yield b"".join(map(self.cache.__getitem__, words))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TokenIds.load(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                out: list[list] = [[], [], [], [], [], []]
                for r, ids in enumerate(encode(rows.column("text").to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        values = (r, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if keep_ids else None)
                        for x, v in zip(out, values, strict=True):
                            x.append(v)
                cols = [rows.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(out[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return pairs.mapInArrow(tidy(run), fields)


def nonnegative_fit(a: np.ndarray, b: np.ndarray, sweeps: int = 400) -> np.ndarray:
    """Least squares of a @ x = b with x >= 0, by coordinate descent on the normal equations."""
    gram, x = a.T @ a, np.zeros(a.shape[1])
    gradient = -(a.T @ b)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(x)):
            step = max(-x[j], -gradient[j] / gram[j, j])
            if step:
                x[j] += step
                gradient += step * gram[:, j]
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def length_patterns(units: int) -> list[tuple[int, ...]]:
    """All multisets of one to three positive whole numbers that sum to ``units``."""
    out: list[tuple[int, ...]] = [(units,)]
    out += [(a, units - a) for a in range(units - 1, (units - 1) // 2, -1) if a >= units - a]
    out += [(a, b, units - a - b) for a in range(units - 2, 0, -1) for b in range(min(a, units - a - 1), 0, -1) if b >= units - a - b >= 1]
    return out


class _Left:
    """Pieces that are left, by length."""

    def __init__(self, counts: dict[int, int]):
        self.counts = Counter({k: v for k, v in counts.items() if v})
        self.lengths = sorted(self.counts)

    def longest(self, low: int, high: int) -> int | None:
        """The greatest length left in low to high."""
        i = bisect.bisect_right(self.lengths, high) - 1
        return self.lengths[i] if i >= 0 and self.lengths[i] >= low else None

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length], self.lengths[bisect.bisect_left(self.lengths, length)]


def packing_plan(counts: dict[int, int], capacity: int, units: int = 64, short: int = 2) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Runs of (pattern, sequences): a pattern is ((length, times), ...) and sums to capacity at most.

    Lengths of up to ``short`` grid units take no part in the fit; they fill what it leaves.
    """
    unit = -(-capacity // units)
    left = _Left(counts)
    runs: list[tuple[list[int], int]] = []
    histogram = np.zeros(units + 1)
    for length, n in counts.items():
        histogram[-(-length // unit)] += n
    histogram[: short + 1] = 0
    patterns = [p for p in length_patterns(units) if all(x > short for x in p)]
    a = np.zeros((units + 1, len(patterns)))
    for j, p in enumerate(patterns):
        for x in p:
            a[x, j] += 1
    for p, times in zip(patterns, np.floor(nonnegative_fit(a, histogram) + 1e-9).astype(int), strict=True):
        while times > 0:
            chosen: list[int] = []
            for k, x in enumerate(p):
                room = capacity - sum(chosen)
                last = k == len(p) - 1
                length = left.longest((x - 1) * unit + 1 if not last else 1, room if last else min(room, x * unit))
                if length is None:
                    break
                chosen.append(length)
            if len(chosen) < len(p):
                break
            need = Counter(chosen)
            n = min(times, *(left.counts[x] // k for x, k in need.items()))
            if not n:
                break
            for x, k in need.items():
                left.take(x, n * k)
            runs.append((chosen, n))
            times -= n
    return _best_fit(runs, left, capacity)


def _best_fit(runs: list[tuple[list[int], int]], left: _Left, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Place what is left, longest first, into the least room that holds it, else anew."""
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[tuple[int, int], ...], n: int, room: int) -> None:
        if not room:
            done.append((pattern, n))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((pattern, n))

    for chosen, n in runs:
        put(tuple(Counter(chosen).items()), n, capacity - sum(chosen))
    for length in reversed(left.lengths):
        c = left.counts[length]
        while c:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, pattern, n = capacity, (), -(-c // (capacity // length))
            times = min(room // length, max(1, c // n))
            filled = min(n, c // times)
            put((*pattern, (length, times)), filled, room - times * length)
            if pattern and n > filled:
                put(pattern, n - filled, room)
            c -= filled * times
    return done + [run for room in rooms for run in open_[room]]


def _places(plan: list) -> dict[str, np.ndarray]:
    """For each length and rank from which a run takes pieces of it: where they go."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length, times in pattern:
            rows.append((length, taken[length], sequence, times, offset))
            taken[length] += n * times
            offset += length * times
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), table.T, strict=True))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, group_rows: int = 2_000) -> DataFrame:
    """Each piece of each document with its sequence_id and the offset of its first token there.

    ``group_rows`` bounds the groups in which pieces of one length are ranked.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(_places(packing_plan(counts, capacity)))
    salts = spark.createDataFrame([(k, -(-v // group_rows)) for k, v in counts.items()] or [(0, 1)], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), "salts"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1).join(groups, ["length", "salt"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        key = p["length"] * (1 << 48) + p["rank"]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            in_run = rank - p["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(p["sequence"][at] + in_run // p["times"][at]), pa.array(p["offset"][at] + length * (in_run % p["times"][at]))],
                [*columns, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*columns).schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")
