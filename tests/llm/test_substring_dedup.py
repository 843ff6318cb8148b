import hashlib
import random
import re

import pytest

from glossmill.llm.substring_dedup import dedup_substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, size):
    least, words = {}, []
    last = (1, 0)
    for d, t in docs:
        w = WORD.findall(t or "")
        words.append((d, w))
        key = last if d is None else (0, d)
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            least[g] = min(least.get(g, key), key)
    out = []
    for d, w in words:
        key, gone, seen = last if d is None else (0, d), set(), set()
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if least[g] < key or g in seen:
                gone |= set(range(i, i + size))
            seen.add(g)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [3, 8, 20])
def test_same_as_brute_force(make_docs, corpus, size):
    rng = random.Random(2)
    docs = [*corpus, corpus[0], (None, corpus[1][1]), (None, corpus[1][1]), (None, "solo " * 50)]
    for i in range(60):
        words = corpus[-1][1].split()
        a = rng.randrange(len(words) - 100)
        docs.append((7000 - i, "  ".join([f"u{i}", *words[a : a + rng.randint(15, 60)], "Ü", f"v{i}\n"])))
    docs.append((0, "other text of the same id " + corpus[0][1]))
    found = dedup_substrings(make_docs(docs), size, keep_text=True).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str)
    assert got == brute(docs, size)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found)
    assert sum(r[2] > 0 for r in got) > 30


def test_full_sketch_loses_nothing(make_docs, corpus, monkeypatch):
    from glossmill.llm import substring_dedup as module

    monkeypatch.setattr(module, "max", lambda a, b: 16, raising=False)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(make_docs(corpus), 5).collect()), key=str)
    assert got == brute(corpus, 5)


def test_empty(make_docs):
    assert dedup_substrings(make_docs([])).count() == 0


def test_words_of_special_form_are_not_one(make_docs):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo powers of two."""
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = dedup_substrings(make_docs([(1, " ".join([one] * 20)), (2, " ".join([other] * 20)), (3, " ".join([one] * 20))]), 20).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: 0, 3: 20}


def test_words_made_for_an_unkeyed_hash(make_docs):
    one, other = "rs18bf38k17b4gxy", "8cmzhkvd9b1dwzlg"  # which eight bytes at a time took for one
    rows = dedup_substrings(make_docs([(1, " ".join([one] * 20)), (2, " ".join([other] * 20)), (3, " ".join([one] * 20))]), 20).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: 0, 3: 20}
