"""Removal of repeated passages by overlapping windows of three lines.

Each three consecutive lines of a document are hashed to 128 bits; windows that occur again,
anywhere, are found by one grouping with partial aggregation. Every occurrence but the first
(by document id, then by line) covers its lines; covered positions merge, and those lines go.
Repeats inside one document are found where its text is cut, so only the least id of a window
has to be known to other documents. The windows of frequent passages meet in a join that
adaptive execution can split.

Defined cases: lines end at each line feed, blank ones count; a null text has no lines and
stays null; fewer than three lines have no window; rows without an id come after all others,
and not before one another; rows that share an id are not compared with one another. A text
of which nothing stays is empty. Other columns pass through unchanged, but for ``n_chars``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy


def _later_windows(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, t, late): where windows begin whose lines begin a document of lesser id."""
    lines = texts.select("doc_id", "t", F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= size)
    window = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (size - 1)),
        lambda i: F.struct(*(F.xxhash64(*([F.lit(seed)] if seed else []), *(F.element_at("lines", i + j) for j in range(size))).alias(f"h{seed + 1}") for seed in range(2))),
    )
    windows = lines.select("doc_id", "t", F.posexplode(window).alias("at", "w")).select("doc_id", "t", "at", "w.*")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = windows.join(least, ["h1", "h2"]).filter("least is not null and (doc_id is null or doc_id > least)")
    return late.groupBy("doc_id", "t").agg(F.collect_list("at").alias("late"))


def _cut(text: str, late: list[int] | None, size: int) -> tuple[int, int, str]:
    """Lines, lines that go, and the text of the others."""
    lines = text.split("\n")
    edge = np.zeros(len(lines) + size + 1, np.int64)
    starts = set(late or ())
    seen: set[tuple[str, ...]] = set()
    for i in range(len(lines) - size + 1):
        window = tuple(lines[i : i + size])
        if window in seen:
            starts.add(i)
        seen.add(window)
    if not starts:
        return len(lines), 0, text
    at = np.fromiter(starts, np.int64, len(starts))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    gone = np.cumsum(edge)[: len(lines)] > 0
    return len(lines), int(gone.sum()), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)


def _joined(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Each row as ``row``, with its text and the later windows in it."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("t"))
    late = _later_windows(rows.select("doc_id", "text", "t"), size).toDF("d", "u", "late")
    return rows.join(late, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left")


def find_repeated_lines(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and kept_text."""
    rows = _joined(docs, size, id_col, text_col).select("doc_id", "text", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [(0, 0, None) if text is None else _cut(text, late, size) for text, late in zip(batch.column("text").to_pylist(), batch.column("late").to_pylist(), strict=True)]
            n, removed, kept = ([c[k] for c in cut] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_lines long, n_removed long, kept_text string")


def remove_repeated_lines(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with such lines cut from the text, and its length, if they have one, set anew."""
    rows = _joined(docs, size, id_col, text_col).select("row", "late")
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            kept = [None if text is None else _cut(text, late, size)[2] for text, late in zip(columns[place].to_pylist(), batch.column("late").to_pylist(), strict=True)]
            columns[place] = pa.array(kept, pa.string())
            if length_col in names:
                k = names.index(length_col)
                columns[k] = pa.array([None if t is None else len(t) for t in kept], pa.int64()).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(tidy(run), docs.schema)
