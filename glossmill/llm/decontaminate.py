"""Benchmark decontamination with suffix arrays over the training text.

Each chunk of documents is a shard. The benchmark's vocabulary numbers the words; a shard's
suffix array holds, in lexicographic order, its suffixes that begin with as many known words
as the shortest window has (no other suffix can match). Every suffix of every benchmark item
is looked up by binary search; the range found gives all places of its window and its items. The
suffixes of a document that is hit and of its items are then sorted to their full depth: the longest
match of an item's suffix is with one of its two neighbours among the document's.

The shards are independent, so nothing is shuffled. The benchmark goes to all tasks in blocks of
about ``block_bytes`` (of a large item more). With several blocks the documents pass them one after
another: each pass writes what its block covers, and its block is dropped before the next is sent.
Words are known by a keyed hash, with a secret for each run.

Defined cases: a null or empty text has no words and is not contaminated; an item without
words has no window; an item with fewer than ``window`` words is one window; items that share
an id count once; an item without an id counts under the empty string. Of equally long matches of
an item the first in the item, then in the document, is given. Repeated documents
give a row each. Columns other than the id and the text are not read by ``find_contamination``
and pass through ``remove_contaminated`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .memory import tidy
from .words import ALNUM, WordKey, Words, words_of

RANGES = "array<struct<first:long,end:long>>"
#: Rows or words that are expanded at once.
_SPREAD = 1 << 18
MATCHES = "array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"


@dataclass
class BenchmarkSuffixes:
    """The windows of the items: distinct keys by length and the items that have them."""

    window: int
    names: list[str]
    key: WordKey
    vocabulary: np.ndarray
    bits: int
    lengths: list[int] = field(default_factory=list)
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    first: dict[int, np.ndarray] = field(default_factory=dict)  # distinct items of key i: first[i] to first[i+1]
    item: dict[int, np.ndarray] = field(default_factory=dict)
    texts: dict[int, list[np.ndarray]] = field(default_factory=dict)  # the numbered words of each text of an item

    def packed(self, known: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Sortable byte keys of the ``length`` words from each position; 0 past the end."""
        per = 63 // self.bits
        cols = -(-length // per)
        out = np.zeros((len(at), cols), ">u8")
        for c in range(cols):
            key = np.zeros(len(at), np.uint64)
            for j in range(c * per, min(length, (c + 1) * per)):
                key = (key << np.uint64(self.bits)) | known[at + j]
            out[:, c] = key
        return out.view(f"S{8 * cols}").ravel()

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for known words, else 0."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.uint64)
        i = np.searchsorted(self.vocabulary, hashes)
        i[i == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[i] == hashes, i + 1, 0).astype(np.uint64)


def benchmark_suffixes(rows: list[tuple[str | None, str | None]], window: int, secret: WordKey) -> BenchmarkSuffixes:
    """Number the items' words and sort their windows."""
    names = sorted({a or "" for a, _ in rows})
    number = {a: i for i, a in enumerate(names)}
    items, hashes = [], []
    for part in words_of(pa.array([b for _, b in rows], pa.string()), ALNUM, True):
        h = part.hashes(secret)
        for r in range(part.rows):
            items.append(number[rows[part.first + r][0] or ""])
            hashes.append(h[part.bounds[r] : part.bounds[r + 1]])
    vocabulary = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]))
    out = BenchmarkSuffixes(window, names, secret, vocabulary, max(1, int(len(vocabulary) + 1).bit_length()))
    found: dict[int, list] = {}
    for item, h in zip(items, hashes, strict=True):
        if len(h):
            length = min(window, len(h))
            at = np.arange(len(h) - length + 1)
            words = out.numbers(h)
            out.texts.setdefault(item, []).append(words)
            found.setdefault(length, []).append((out.packed(words, at, length), np.full(len(at), item)))
    for length, parts in sorted(found.items()):
        key, item = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, number_of = np.unique(key, return_inverse=True)
        pairs = np.unique(number_of * len(names) + item)
        out.lengths.append(length)
        out.keys[length], out.item[length] = keys, pairs % len(names)
        out.first[length] = np.searchsorted(pairs // len(names), np.arange(len(keys) + 1))
    return out


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i in lo[k] to hi[k]-1, with their k."""
    n = hi - lo
    k = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[k], k


def _runs_of_known(known: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, how many known words of its document follow without a gap, itself included."""
    stops = np.flatnonzero(known == 0)
    stops = np.sort(np.concatenate([stops, ends]))
    at = np.arange(len(known))
    return np.where(known == 0, 0, stops[np.searchsorted(stops, at, "right")] - at)


def _search(column: pa.Array, tests: BenchmarkSuffixes) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: its words, their numbers, which of them lie in a window, and in order the
    distinct pairs row * items + item of rows and the items with a window there."""
    for part in words_of(column, ALNUM, True):
        hit, known = np.zeros(len(part.starts), bool), np.zeros(len(part.starts), np.uint64)
        pairs = np.empty(0, np.int64)
        if tests.lengths and len(part.starts):
            known = tests.numbers(part.hashes(tests.key))
            left = _runs_of_known(known, part.bounds[1:][np.diff(part.bounds) > 0])
            padded = np.concatenate([known, np.zeros(tests.window, np.uint64)])
            covered = np.zeros(len(known) + 1, np.int64)
            owners = part.owners()
            for length in tests.lengths:
                at = np.flatnonzero(left >= length)
                if not len(at):
                    continue
                keys = tests.packed(padded, at, length)
                order = np.argsort(keys, kind="stable")
                suffixes, keys = at[order], keys[order]
                lo = np.searchsorted(keys, tests.keys[length], "left")
                hi = np.searchsorted(keys, tests.keys[length], "right")
                i, k = _spread(lo, hi)
                if not len(i):
                    continue
                at = suffixes[i]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + length, -1)
                windows = np.unique(owners[at] * len(tests.keys[length]) + k)  # of a window that occurs often, one a row
                row, k = windows // len(tests.keys[length]), windows % len(tests.keys[length])
                first, last = tests.first[length][k], tests.first[length][k + 1]
                cuts = np.searchsorted(np.cumsum(last - first), np.arange(0, (last - first).sum(), _SPREAD)[1:])
                for a, b in zip([0, *cuts], [*cuts, len(k)], strict=True):
                    j, m = _spread(first[a:b], last[a:b])
                    pairs = np.union1d(pairs, row[a:b][m] * len(tests.names) + tests.item[length][j])
            hit = np.cumsum(covered[:-1]) > 0
        yield part, known, hit, pairs


class _SuffixOrder:
    """The suffixes of a sequence in lexicographic order, sorted to full depth by doubling."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        while 2 ** len(self.ranks) < 2 * n and self.ranks[-1].max(initial=0) < n - 1:
            step, now = 2 ** (len(self.ranks) - 1), self.ranks[-1]
            after = np.zeros(n, np.int64)
            after[:-step] = now[step:] + 1
            self.ranks.append(np.unique(now * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        self.order = np.argsort(self.ranks[-1], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and at b share from their start; no two may be the same."""
        a, b = np.broadcast_arrays(a, b)
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            same = inside[self.ranks[level][a[inside]] == self.ranks[level][b[inside]]]
            for x in (a, b, out):
                x[same] += 1 << level
        return out


def _longest_in(doc: np.ndarray, hit: np.ndarray, items: list[list[np.ndarray]]) -> list[tuple[int, int, int]]:
    """For each item the longest match: word of the document, word of the item, length."""
    runs = np.flatnonzero(hit)
    breaks = np.flatnonzero(np.diff(runs, prepend=-2) > 1)
    texts = [doc[r] for r in np.split(runs, breaks[1:])]
    places = [*np.split(runs, breaks[1:])]
    n_doc = len(texts)
    texts += [t for item in items for t in item]
    owner = np.repeat(np.arange(len(items)), [len(item) for item in items])
    top = int(max(t.max(initial=0) for t in texts)) + 1
    pieces = [np.append(t.astype(np.int64), top + i) for i, t in enumerate(texts)]  # what ends a text is like nothing else
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    suffixes = _SuffixOrder(np.concatenate(pieces))
    n = begins[n_doc]  # the document's part
    at_doc = np.concatenate([np.append(p, -1) for p in places])
    order = suffixes.order
    ours = (order < n) & (at_doc[np.minimum(order, n - 1)] >= 0)
    rank = np.arange(len(order))
    above = np.maximum.accumulate(np.where(ours, rank, -1))
    below = np.minimum.accumulate(np.where(ours, rank, len(order))[::-1])[::-1]
    mine = np.flatnonzero(order >= n)
    best = np.zeros(len(mine), np.int64)
    for near in (above[mine], below[mine]):
        there = np.flatnonzero((near >= 0) & (near < len(order)))
        best[there] = np.maximum(best[there], suffixes.common(order[mine[there]], order[near[there]]))
    at = order[mine]
    text = np.searchsorted(begins, at, "right") - 1
    item, place = owner[text - n_doc], at - begins[text]
    sort = np.lexsort((place, -best, item))
    lead = sort[np.flatnonzero(np.diff(item[sort], prepend=-1))]
    doc_at = np.flatnonzero(at_doc >= 0)
    out = []
    for i in lead:
        same = doc_at[suffixes.common(np.full(len(doc_at), at[i]), doc_at) >= best[i]]
        out.append((int(at_doc[same].min()), int(place[i]), int(best[i])))
    return out


def _longest(part: Words, known: np.ndarray, hit: np.ndarray, pairs: np.ndarray, tests: BenchmarkSuffixes) -> tuple[np.ndarray, ...]:
    """The longest match of each row and item: row, item, word of the row, word of the item, length."""
    row, item = pairs // max(1, len(tests.names)), pairs % max(1, len(tests.names))
    found = []
    for r in np.unique(row):
        a, b = part.bounds[r], part.bounds[r + 1]
        own = item[row == r]
        size = np.cumsum([sum(map(len, tests.texts[i])) for i in own])
        for some in np.split(own, np.searchsorted(size, np.arange(_SPREAD, size[-1], _SPREAD))):
            if len(some):
                found += [(r, i, *x) for i, x in zip(some, _longest_in(known[a:b], hit[a:b], [tests.texts[i] for i in some]), strict=True)]
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The sorted windows of each block of items, and whether it is the last; the rows of an item are in one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words"))
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item"), F.lit(n))
    secret = WordKey.drawn()
    for k in range(n):
        rows = [(r.item, r.words) for r in items.filter(block == k).collect()]  # about block_bytes
        yield docs.sparkSession.sparkContext.broadcast(benchmark_suffixes(rows, window, secret)), k == n - 1


def _ranges(hit: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """The runs of hit words of each row, as [first, end) counted in the row."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    first, end = edge[::2], edge[1::2]
    inner = bounds[1:-1]
    cut = inner[hit[np.clip(inner - 1, 0, None)] & hit[np.clip(inner, None, len(hit) - 1)]] if len(hit) else inner[:0]
    cut = np.unique(cut[(cut > 0) & (cut < len(hit))])  # a run across rows is one for each
    first, end = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([end, cut]))
    row = np.searchsorted(bounds, first, "right") - 1
    structs = pa.StructArray.from_arrays([pa.array(first - bounds[row]), pa.array(end - bounds[row])], ["first", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, bounds), pa.int32()), structs)


def _found(part: Words, known: np.ndarray, hit: np.ndarray, pairs: np.ndarray, tests: BenchmarkSuffixes) -> list[pa.Array]:
    """n_words, hits and matches of a chunk's rows."""
    row, item, at, place, words = _longest(part, known, hit, pairs, tests)
    cut = np.searchsorted(row, np.arange(part.rows + 1))
    structs = pa.StructArray.from_arrays([pa.array([tests.names[i] for i in item], pa.string()), pa.array(at), pa.array(place), pa.array(words)], ["item_id", "doc_word", "item_word", "n_words"])
    return [pa.array(np.diff(part.bounds)), _ranges(hit, part.bounds), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), structs)]


def _searched(rows: DataFrame, tests: Broadcast) -> DataFrame:
    """(doc_id, n_words, hits, matches) of (doc_id, text) in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *found in _search(batch.column("text"), tests.value):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, part.rows), *_found(part, *found, tests.value)], ["doc_id", "n_words", "hits", "matches"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, hits {RANGES}, matches {MATCHES}")


def _searched_in_turn(rows: DataFrame, first: Broadcast, others: Iterator[tuple[Broadcast, bool]]) -> DataFrame:
    """The same in several blocks: rows are numbered, each block's hits are written, and joined last."""
    rows = written(rows.withColumn("n", F.monotonically_increasing_id()), "numbered")
    numbered = rows.select(F.col("n").alias("doc_id"), "text")
    counts = hits = None
    for tests in _each(first, others):
        found = written(_searched(numbered, tests), "found")
        tests.destroy()
        counts = found.select("doc_id", "n_words") if counts is None else counts
        found = found.filter("size(hits) > 0").select("doc_id", "hits", "matches")
        hits = found if hits is None else hits.union(found)
    whole = hits.groupBy("doc_id").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("matches")).alias("matches"))
    none = [F.array().cast(t) for t in (RANGES, MATCHES)]
    whole = counts.join(whole, "doc_id", "left").select(F.col("doc_id").alias("n"), "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("matches", none[1]).alias("matches"))
    return rows.select("n", "doc_id").join(whole, "n").drop("n")


def _each(first: Broadcast, others: Iterator[tuple[Broadcast, bool]]) -> Iterator[Broadcast]:
    yield first
    for tests, _ in others:
        yield tests


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 64 << 20) -> DataFrame:
    """For each document: n_words, n_hit (words inside a benchmark window), n_items,
    items_sha256 (of the item ids sorted as strings and joined by commas), contaminated,
    longest_match (in words; 0 without), and matches: for each item, in order of its id, the longest
    verbatim match and its places."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _blocks(docs, benchmark, window, block_bytes)
    first, alone = next(blocks)
    rows = _searched(rows, first) if alone else _searched_in_turn(rows, first, blocks)
    ids = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    matches = F.array_sort("matches")
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).alias("longest_match")
    rows = rows.select("doc_id", "n_words", _covered(F.col("hits")).alias("n_hit"), F.size("matches").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), longest, matches.alias("matches"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "longest_match", "matches")


def _covered(hits: Column) -> Column:
    """How many words lie in any of the ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(r["end"] - F.greatest(r["first"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], r["end"]).alias("to"))
    return F.aggregate(F.array_sort(hits), start, step, lambda s: s["n"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", block_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has no word inside a benchmark window."""
    place = docs.columns.index(text_col)
    rows = docs
    for tests, last in _blocks(docs, benchmark, window, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], tests: Broadcast = tests) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [~np.logical_or.reduceat(np.append(hit, False), part.bounds[:-1]) | (np.diff(part.bounds) == 0) for part, _, hit, _ in _search(batch.column(place), tests.value)]
                yield batch.filter(pa.array(np.concatenate([*clean, np.empty(0, bool)])))

        rows = rows.mapInArrow(tidy(run), docs.schema)
        if not last:
            rows = written(rows, "clean")
            tests.destroy()
    return rows
