"""Source divergence against a dense brute-force version."""

import random
import re
from collections import Counter, defaultdict

import pytest

from glossmill.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
FIELDS = "doc_id long, text string, lang string, source string, words string, place int, block string, term string"


def brute(rows, least=3, most=200):
    docs = [((lang or "", source or ""), [w.translate(LOWER) for w in TERM.findall(text or "")]) for text, lang, source in rows]
    seen = defaultdict(Counter)
    for (lang, _), words in docs:
        seen[lang].update(set(words))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in seen.items()}
    count = defaultdict(Counter)
    for (lang, source), words in docs:
        count[lang, source].update(w for w in words if w in kept[lang])
    out = []
    for lang in kept | {g[0]: None for g in count}:
        terms, groups = kept.get(lang, set()), {s: c for (k, s), c in count.items() if k == lang}
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(terms)) for t in terms}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in terms)) for o in groups if o != s]
            marked = [(t, f(p[s][t], q[t])) for t in c if p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", marked)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[: most if part == "term" else None]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1)]
    return sorted(out)


def got(spark, rows, **how):
    full = [(i, *r, "x", 1, "y", "z") for i, r in enumerate(rows)]
    found = divergence.source_divergence(spark.createDataFrame(full, FIELDS).repartition(4), **how)
    return sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcÉéß中😀") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for i in range(220):
        source = "hot" if i % 3 == 0 else rng.choice(["s1", "s2", "ß3", None, ""])
        text = "".join(rng.choice(vocabulary[: 40 + 10 * (i % 7)]).swapcase() + rng.choice([" ", "\n", "-", "_", "9", ". "]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de", None]), source))
    rows += [(None, "en", "s1"), (None, "xx", "alone"), ("", "xx", "other"), ("w " * 30000 + "longterm" * 3000, "en", "s2"), ("12 34 [] `", "fr", "s9")] + [("same text here", "en", "copies")] * 40
    return rows


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"most_terms": 5, "block_bytes": 40}), (3, {"least_documents": 1, "block_bytes": 64})])
def test_same_as_brute_force(spark, seed, how, monkeypatch):
    monkeypatch.setattr(divergence, "_PLACE", 4000)
    rows = corpus(seed)
    assert got(spark, rows, **how) == brute(rows, how.get("least_documents", 3), how.get("most_terms", 200))


def test_no_rows_and_no_terms(spark):
    assert got(spark, []) == []
    rows = [("once", "en", "a"), (None, "en", "b")]
    assert got(spark, rows) == brute(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_a_word_goes_to_its_block_once_for_a_batch_and_source(spark):
    rows = [("en", "s", "Ab cd " * 3000), ("en", "s", "ab é中😀 ab"), ("en", "r", "cd"), ("en", "r", ""), ("fr", "s", "ab")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    sent = divergence._block_words(docs, divergence.WordKey.drawn(), 2, 1).collect()
    assert sum(len(r.words) for r in sent) == sum(len(w) + 1 for w in ("ab", "cd", "é中😀", "cd", "ab"))
    terms = spark.createDataFrame([("en", "ab"), ("en", "é中😀"), ("en", "zz"), ("fr", "ab")], "lang string, term string")
    counted = divergence.count_terms(docs, terms)
    assert sorted(tuple(r) for r in counted.collect()) == [("en", "s", "ab", 3002), ("en", "s", "é中😀", 1), ("fr", "s", "ab", 1)]


def test_a_task_holds_the_words_of_one_group_at_a_time(monkeypatch):
    monkeypatch.setattr("glossmill.llm.words.CHUNK_BYTES", 4000)
    rng = random.Random(5)
    rows = [(g, " ".join(f"{'abcdefgh'[g]}{rng.choice('xyzß')}{rng.choice('uvw')}{'q' * rng.randint(0, 30)}" for _ in range(40))) for g in [*range(8)] * 40]
    for by_row in (False, True):
        want = Counter((g, w) for g, text in rows for w in (set if by_row else list)(text.split()))
        seen, largest = [], 0
        found = divergence._counted_words(divergence.pa.array([t for _, t in rows]), divergence.np.array([g for g, _ in rows]), divergence.WordKey.drawn(), by_row)
        for own, _, n, words in found:
            seen += zip(zip(own.tolist(), words.to_pylist(), strict=True), n.tolist(), strict=True)
            largest = max(largest, len(own))
        assert len(seen) == len(want) and dict(seen) == want
        assert largest < len(want) / 3  # not the batch
    one = divergence._counted_words(divergence.pa.array(["a b", None, "", "b " * 5000]), divergence.np.zeros(4, int), divergence.WordKey.drawn())
    assert [sorted(zip(w.to_pylist(), n.tolist(), strict=True)) for _, _, n, w in one] == [[("a", 1), ("b", 5001)]]
    assert not list(divergence._counted_words(divergence.pa.array([], divergence.pa.string()), divergence.np.zeros(0, int), divergence.WordKey.drawn()))
