import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmill.llm.line_dedup import find_repeated_lines, remove_repeated_lines
from glossmill.llm.queries import ORACLE_SQL


def brute(docs, size=3):
    least = {}
    rank = lambda d: (1, 0) if d is None else (0, d)
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        for i in range(len(lines) - size + 1):
            k = tuple(lines[i : i + size])
            least[k] = min(least.get(k, rank(d)), rank(d))
    out = []
    for d, t in docs:
        lines, gone, seen = [] if t is None else t.split("\n"), set(), set()
        for i in range(len(lines) - size + 1):
            k = tuple(lines[i : i + size])
            if k in seen or least[k] < rank(d):
                gone |= set(range(i, i + size))
            seen.add(k)
        out.append((d, len(lines), len(gone), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(corpus):
    rng = random.Random(6)
    some = [f"line {i % 9}" for i in range(40)]
    out = [(8000 - i, "\n".join([f"own {i}", *some[(a := rng.randrange(30)) : a + rng.randint(1, 8)], "", "", "", f"end {i}"])) for i in range(50)]
    return [*corpus, *out, corpus[1], (None, out[0][1]), (None, out[0][1]), (8000, "a\nb\nc\na\nb\nc"), (1, "\n" * 6)]


def test_same_as_brute_force(make_docs, docs):
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in find_repeated_lines(make_docs(docs)).collect()), key=str)
    assert got == brute(docs)
    assert sum(r[2] > 0 for r in got) > 40


def test_rows_pass_through(make_docs, docs):
    given = make_docs(docs)
    cut = remove_repeated_lines(given)
    assert cut.columns == given.columns
    rows = cut.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(((r[0], r[3]) for r in brute(docs)), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.words == "x" and r.rank == 3 for r in rows)


def test_oracle_says_the_same(make_docs, docs):
    unique = list({d: (d, t) for d, t in docs if d is not None}.values())
    documents = pa.table({"doc_id": [d for d, _ in unique], "text": [t for _, t in unique]})  # noqa: F841
    expected = duckdb.sql(ORACLE_SQL["op5_line_dedup"]).fetchall()
    found = find_repeated_lines(make_docs(unique)).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256))
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_empty(make_docs):
    assert find_repeated_lines(make_docs([])).count() == 0
