import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glossmill.llm import fingerprints
from glossmill.llm.fingerprints import FOUND, NEXT, PARAGRAPH, TEXT, TO_NEXT, fingerprint_edits, peel, sketches, subtract, with_next


def ordered(docs):
    return sorted(docs, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0), reverse=True)


def paragraphs(text):
    return {p for p in re.split(PARAGRAPH, text) if p}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs):
    rows, out = ordered(docs), []
    for i, (d, text) in enumerate(rows):
        text, other = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(alike(text, edited), 9), round(alike(text, other), 9)))
    return sorted(out, key=str)


def got(found):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found), key=str)


@pytest.fixture(scope="module")
def docs(corpus):
    sentences = [f"Sentence number {i} says so. Another {i}! " for i in range(400)]
    more = [(-5 - i, "".join(sentences[i * 3 : i * 3 + 5 * i])) for i in range(40)] + [(10**12, "far 😀é. off"), (None, "none. here.")]
    return [*{d: (d, t) for d, t in corpus if d != 5000}.values(), *more]


def test_same_as_brute_force(make_docs, docs):
    found = fingerprint_edits(make_docs(docs)).collect()
    assert got(found) == brute(docs)
    text = dict(docs)
    by = {}
    for r in found:
        by.setdefault(text[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len({frozenset(paragraphs(t)) for t in by})


def test_neighbours_across_buckets(make_docs, docs):
    for some in (docs, [(d, t) for d, t in docs if d != 10**12] + [(-9 * 10**18, "low"), (9 * 10**18, "high"), (9 * 10**18 + 1, "higher")]):
        rows = ordered(some)
        expected = sorted(((d, t or "", rows[(i + 1) % len(rows)][1] or "") for i, (d, t) in enumerate(rows)), key=str)
        for size in (100, 2000, 1 << 30):
            found = with_next(make_docs(some), bucket_bytes=size).select("bucket", "doc_id", "text", "next_text").collect()
            assert sorted((tuple(r[1:]) for r in found), key=str) == expected
            assert len({r.bucket for r in found}) > {100: 60, 2000: 8, 1 << 30: 0}[size]


def test_peeling_recovers_both_sides(spark):
    rows = [(i, list(range(i, i + 30)), list(range(i + 3, i + 32))) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    cells = sketches(df, ["i"], [(kind, F.lit(6), 1, F.col(c)) for kind, c in ((TEXT, "a"), (NEXT, "b"))])
    cells = peel(subtract(cells, ["i"], {TO_NEXT: (TEXT, NEXT)}), ["i"], (TO_NEXT,), 9, keep=True).filter(F.col("kind") == TO_NEXT)
    found = {}
    for r in cells.collect():
        found.setdefault(r.i, []).append((r.cell, r.digest, r.n))
    full = {i: x for i, x in found.items() if all(c == FOUND for c, _, _ in x)}
    assert len(full) > 150
    for i, a, b in rows:
        if i in full:
            assert {(k, n) for _, k, n in full[i]} == {(k, 1) for k in set(a) - set(b)} | {(k, -1) for k in set(b) - set(a)}


def test_what_is_left_goes_to_wider_sketches(make_docs, docs, monkeypatch):
    """With room for too few digests many rows are left over, again and again."""
    wider = fingerprints._wider
    monkeypatch.setattr(fingerprints, "_wider", lambda rows, keys, room, seed, known: wider(rows, keys, F.lit(room) / 48, seed, known))
    monkeypatch.setattr(fingerprints, "_place", lambda key, width, part, seed: F.pmod(F.xxhash64(key, F.lit(seed + part)), F.greatest(width.cast("long"), F.lit(1))) + F.greatest(width.cast("long"), F.lit(1)) * part)
    assert got(fingerprint_edits(make_docs(docs)).collect()) == brute(docs)


def test_no_cell_is_shuffled(make_docs, docs):
    cells = sketches(with_next(make_docs(docs)).withColumn("a", F.array("t")), ["bucket", "place"], [(TEXT, F.lit(4), 1, F.col("a"))])
    plan = peel(cells, ["bucket", "place"], (TEXT,), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Python") == 0


def test_one_row_and_none(make_docs):
    assert fingerprint_edits(make_docs([])).count() == 0
    assert got(fingerprint_edits(make_docs([(3, "abcdef. gh")])).collect()) == brute([(3, "abcdef. gh")])
    assert [r.near_next for r in fingerprint_edits(make_docs([(3, None), (4, "")])).collect()] == [1.0, 1.0]
    twice = fingerprint_edits(make_docs([(3, "a. b"), (3, "a. b"), (3, "c. d")])).collect()
    assert len(twice) == 3


def test_texts_stay_where_they_are_for_few_rows(spark, make_docs, monkeypatch):
    docs = make_docs([(i, f"a {i}. b {i % 7}. c") for i in range(60)])
    texts = docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    nothing = F.lit(None).cast("long")
    open_ = texts.filter("i in (3, 9, 20)").select(F.col("i").alias("row"), F.col("i").alias("doc_id"), F.col("h").alias("t"), (F.col("i") - 1).alias("next_id"), nothing.alias("to_edited"), nothing.alias("to_next"))
    open_ = open_.join(texts.toDF("next_id", "next_t"), "next_id")
    plans, rows = [], []
    monkeypatch.setattr(fingerprints, "_edited", lambda df, keys, real=fingerprints._edited: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, keys))
    for few in (100_000, 0):
        monkeypatch.setattr(fingerprints, "_FEW", few)
        rows.append(sorted(tuple(r) for r in fingerprints._again(docs.select("doc_id", "text"), open_, 8, 6).collect()))
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]
    assert rows[0] == rows[1] and len(rows[0]) == 3 and all(None not in r for r in rows[0])
