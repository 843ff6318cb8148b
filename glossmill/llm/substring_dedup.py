"""Removal of word windows that occur earlier in the corpus, behind a count-min prefilter.

First pass: each partition counts its windows in a count-min sketch and sends the cells it
touched; blocks of cells are merged where they meet, and only "counted twice or more" remains,
one bit a cell. Neighbouring windows share a counter: a window's counter is the least hash of
the 8-word grams inside it, counted once for each run of windows that share it. Equal windows
have equal counters and different documents count each, so the count is never too low, and
windows repeated inside one document are found there. Whole texts are counted likewise.

Second pass: windows estimated as repeated, and no others, are grouped by two 64-bit
hashes of word hashes that are keyed with a secret of the run; those that do not have the least document id cover the words that go. Texts that are
equal are one text in this pass, held by the least id.

The sketch has about four bytes of text to a cell, between 2**20 and ``2**max_bits`` cells in
two rows, so what is broadcast has at most ``2**max_bits / 4`` bytes; a larger corpus passes more
windows on to the exact pass and loses none.

Defined cases: a null or empty text has no words; texts shorter than a window stay whole; rows
without an id come after all others, and not before one another; rows that share an id are
not compared with one another. Repeated rows give a row each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .words import NOT_SPACE, WordKey, Words, mix, signed, window_hashes, words_of

GRAM = 8
_BLOCK_BITS = 16
_FLUSH = 1 << 21
_TEXT_SEED = np.uint64(0x6A09E667F3BCC909)


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each key in either row of the sketch."""
    second = mix(keys ^ np.uint64(0x3C6EF372FE94F82B))
    shift = np.uint64(64 - bits)
    return mix(keys) >> shift, (second >> shift) + np.uint64(1 << bits)


class RepeatSketch:
    """The merged sketch: one bit a cell, set where the count is two or more."""

    def __init__(self, bits: int, bitmap: bytes):
        self.bits, self.bitmap = bits, bitmap

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        bitmap = np.frombuffer(self.bitmap, np.uint8)
        out = np.ones(len(keys), bool)
        for cell in _cells(keys, self.bits):
            out &= (bitmap[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


class _Windows:
    """Of a chunk's windows that lie inside one document: word, document, hash and counter."""

    def __init__(self, part: Words, words: np.ndarray, size: int):
        grams = min(GRAM, size)
        span = size - grams + 1
        least, width = window_hashes(words, grams, 1), 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        if width < span:
            least = np.minimum(least[: width - span], least[span - width :]) if len(least) > span - width else least[:0]
        owner = part.owners()
        n = max(0, len(words) - size + 1)
        self.at = np.flatnonzero(owner[:n] == owner[size - 1 :]) if n else np.empty(0, np.int64)
        self.row = owner[self.at]
        self.hash = window_hashes(words, size)[self.at]
        self.counter = least[self.at]
        self.new = np.ones(len(self.at), bool)
        self.new[1:] = (self.counter[1:] != self.counter[:-1]) | (self.row[1:] != self.row[:-1])

    def estimated(self, sketch: RepeatSketch) -> np.ndarray:
        """For each window, whether its counter is two or more."""
        if not len(self.at):
            return np.zeros(0, bool)
        return sketch.repeated(self.counter[self.new])[np.cumsum(self.new) - 1]

    def again(self, rows: int) -> np.ndarray:
        """For each window, whether it begins earlier in its own document too."""
        out = np.ones(len(self.at), bool)
        bounds = np.searchsorted(self.row, np.arange(rows + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b > a:
                out[a + np.unique(self.hash[a:b], return_index=True)[1]] = False
        return out


def _chunks(batch: pa.RecordBatch, key: WordKey) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    for part in words_of(batch.column("text"), NOT_SPACE, False):
        yield batch.slice(part.first, part.rows), part, part.hashes(key)


def _text_keys(rows: pa.RecordBatch, part: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts that have a window, and which rows these are."""
    full = np.flatnonzero(np.diff(part.bounds) >= size)
    return mix(rows.column("t1").to_numpy().view(np.uint64)[full] ^ _TEXT_SEED), full


def build_sketch(texts: DataFrame, key: WordKey, size: int, max_bits: int) -> Broadcast:
    """The merged sketch of all windows and texts of (text, t1)."""
    spark = texts.sparkSession
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max_bits, max(20, int(n_bytes // 4).bit_length()))

    def flush(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.unique(np.concatenate([c for k in keys for c in _cells(k, bits)]), return_counts=True)
        block = (cells >> np.uint64(_BLOCK_BITS)).astype(np.int64)
        low = (cells & np.uint64((1 << _BLOCK_BITS) - 1)).astype("<u2")
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        out: list[list] = [[], [], []]
        for a, b in zip(starts, np.append(starts[1:], len(block)), strict=True):
            twice = counts[a:b] > 1
            for x, v in zip(out, (block[a], low[a:b][~twice].tobytes(), low[a:b][twice].tobytes()), strict=True):
                x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["block", "once", "twice"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for batch in batches:
            for rows, part, words in _chunks(batch, key):
                windows = _Windows(part, words, size)
                for k in (windows.counter[windows.new], _text_keys(rows, part, size)[0]):
                    keys.append(k)
                    held += len(k)
                if held > _FLUSH:
                    yield from flush(keys)
                    keys, held = [], 0
        if held:
            yield from flush(keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << _BLOCK_BITS, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total > 1, bitorder="little").tobytes()], pa.binary())], ["block", "bitmap"])

        for batch in batches:
            for block, once, twice in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "twice")), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now = block
                    total[:] = 0
                cells = np.frombuffer(once, "<u2")
                total[cells] = np.minimum(total[cells] + 1, 2)
                total[np.frombuffer(twice, "<u2")] = 2
        if now is not None:
            yield done()

    partial = texts.select("text", "t1").mapInArrow(count, "block long, once binary, twice binary")
    merged = partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bitmap binary")
    bitmap = bytearray(1 << (bits + 1 - 3))
    width = 1 << (_BLOCK_BITS - 3)
    for row in merged.toLocalIterator(prefetchPartitions=True):
        bitmap[row.block * width : (row.block + 1) * width] = row.bitmap
    return spark.sparkContext.broadcast(RepeatSketch(bits, bytes(bitmap)))


def _copies(texts: DataFrame, key: WordKey, sketch: Broadcast, size: int) -> DataFrame:
    """The rows whose whole text is estimated as repeated, with n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part, _ in _chunks(batch, key):
                keys, full = _text_keys(rows, part, size)
                picked = full[sketch.value.repeated(keys)]
                out = rows.take(pa.array(picked))
                yield out.append_column("n_words", pa.array(np.diff(part.bounds)[picked]))

    return texts.mapInArrow(run, f"doc_id {_type(texts)}, text string, t1 long, t2 long, n_words long")


def _type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _in_pass(rows: pa.RecordBatch, part: Words, sketch: RepeatSketch, size: int) -> np.ndarray:
    """Which rows take part: all but those that one row of their text stands for."""
    keep = np.ones(part.rows, bool)
    keys, full = _text_keys(rows, part, size)
    keep[full[sketch.repeated(keys)]] = False
    return keep | rows.column("stands").to_numpy(zero_copy_only=False)


def _candidate_windows(texts: DataFrame, key: WordKey, sketch: Broadcast, size: int) -> DataFrame:
    """(a, h, doc_id, place): the first place in its text of each window estimated as repeated;
    place has 32 bits of the text's hash above the word's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part, words in _chunks(batch, key):
                w = _Windows(part, words, size)
                pick = np.flatnonzero(w.estimated(sketch.value) & _in_pass(rows, part, sketch.value, size)[w.row] & ~w.again(part.rows))
                row = w.row[pick]
                place = (rows.column("t1").to_numpy()[row] << 32) | (w.at[pick] - part.bounds[row])
                yield pa.RecordBatch.from_arrays([pa.array(signed(w.counter[pick])), pa.array(signed(w.hash[pick])), rows.column("doc_id").take(pa.array(row)), pa.array(place)], ["a", "h", "doc_id", "place"])

    return texts.mapInArrow(run, f"a long, h long, doc_id {_type(texts)}, place long")


def _to_finish(texts: DataFrame, key: WordKey, sketch: Broadcast, size: int, keep_text: bool) -> DataFrame:
    """A row for each text: finished, or with its text where windows may go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part, words in _chunks(batch, key):
                w = _Windows(part, words, size)
                again = w.again(part.rows)
                open_ = np.bincount(w.row[w.estimated(sketch.value) | again], minlength=part.rows) > 0
                keep = _in_pass(rows, part, sketch.value, size)
                text = rows.column("text").to_pylist()
                kept = [None if o else b" ".join((t or "").encode().split()) for t, o in zip(text, open_, strict=True)]
                out = pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in ("doc_id", "t1", "t2", "stands")), pa.array(np.diff(part.bounds)),
                        pa.array([t if o else None for t, o in zip(text, open_, strict=True)], pa.string()),
                        pa.array([k if k is None else hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                        pa.array([k.decode() if keep_text and k is not None else None for k in kept], pa.string()),
                    ],
                    ["doc_id", "t1", "t2", "stands", "n_words", "text", "kept_sha256", "kept_text"],
                )
                yield out.filter(pa.array(keep))

    return texts.mapInArrow(run, f"doc_id {_type(texts)}, t1 long, t2 long, stands boolean, n_words long, text string, kept_sha256 string, kept_text string")


def _finished(rows: DataFrame, key: WordKey, size: int, keep_text: bool) -> DataFrame:
    """Remove the words of windows that begin earlier, in this text or (``late``) before it."""
    names = ["doc_id", "t1", "t2", "stands", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = np.zeros(batch.num_rows, np.int64)
            digests = batch.column("kept_sha256").to_pylist()
            texts = batch.column("kept_text").to_pylist()
            late = batch.column("late")
            for rows, part, words in _chunks(batch, key):
                w = _Windows(part, words, size)
                starts = [w.at[w.again(part.rows)]]
                for i in range(part.rows):
                    if digests[part.first + i] is None and late[part.first + i].is_valid:
                        starts.append(late[part.first + i].values.to_numpy() + part.bounds[i])
                edge = np.zeros(len(words) + size + 1, np.int64)
                for s in starts:
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + size, -1)
                covered = np.cumsum(edge)[: len(words)] > 0
                body = rows.column("text")
                for i in range(part.rows):
                    if digests[part.first + i] is None:
                        gone = covered[part.bounds[i] : part.bounds[i + 1]]
                        kept = b" ".join(compress(body[i].as_py().encode().split(), ~gone))
                        removed[part.first + i] = gone.sum()
                        digests[part.first + i] = hashlib.sha256(kept).hexdigest()
                        texts[part.first + i] = kept.decode() if keep_text else None
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(removed), pa.array(digests, pa.string()), pa.array(texts, pa.string())], [*names, "n_removed", "kept_sha256", "kept_text"])

    return rows.mapInArrow(run, f"doc_id {_type(rows)}, t1 long, t2 long, stands boolean, n_words long, n_removed long, kept_sha256 string, kept_text string")


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, max_bits: int = 29) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text: the words that
    no window covers whose words begin earlier too, joined by one space."""
    key = WordKey.drawn()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.xxhash64(F.lit(x), F.col(text_col)).alias(n) for n, x in (("t1", key.seed >> 65), ("t2", key.seed & (1 << 63) - 1))))
    sketch = build_sketch(texts, key, window, max_bits)
    copies = _copies(texts, key, sketch, window)
    first = copies.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    first = written(first.select("doc_id", "text", "t1", "t2"), "first_copies")
    members = written(copies.select("doc_id", "t1", "t2", "n_words"), "copies")
    once = texts.withColumn("stands", F.lit(False)).union(first.withColumn("stands", F.lit(True)))

    windows = _candidate_windows(once, key, sketch, window)
    least = windows.groupBy("a", "h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = windows.join(least, ["a", "h"]).filter("least is not null and (doc_id is null or doc_id > least)")
    late = late.groupBy(F.col("doc_id").alias("d"), F.shiftrightunsigned("place", 32).alias("t")).agg(F.collect_list(F.col("place").bitwiseAND((1 << 32) - 1)).alias("late"))
    rows = _to_finish(once, key, sketch, window, keep_text)
    rows = rows.join(late, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1").bitwiseAND((1 << 32) - 1) == F.col("t")), "left").drop("d", "t")
    result = _finished(rows, key, window, keep_text)

    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    stand = result.filter("stands").select("t1", "t2", F.col("doc_id").alias("least"), F.col("n_removed").alias("r"), F.col("kept_sha256").alias("k"), F.col("kept_text").alias("x"))
    own = F.col("doc_id").eqNullSafe(F.col("least"))
    copied = members.join(stand, ["t1", "t2"]).select(
        "doc_id", "n_words",
        F.when(own, F.col("r")).otherwise(F.col("n_words")).alias("n_removed"),
        F.when(own, F.col("k")).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"),
        F.when(own, F.col("x")).otherwise(F.lit("")).alias("kept_text"),
    )
    return result.filter("not stands").select(*columns).union(copied.select(*columns))
