import hashlib
import re

from glossmill.llm.decontaminate import find_contamination, remove_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words = WORD.findall(lower(text))
        hit, names = set(), set()
        for item, body in items:
            w = WORD.findall(lower(body))
            k = min(window, len(w))
            for i in range(len(w) - k + 1) if w else ():
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == w[i : i + k]:
                        hit |= set(range(j, j + k))
                        names.add(item)
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(str(n) for n in names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def items_of(corpus):
    texts = [t for _, t in corpus if t and len(t) < 2000]
    return [(i, body) for i, body in enumerate([" ".join(texts[3].split()[4:40]), texts[10], texts[12].upper(), "l1", "zzz unseen", "", None, "one two three", texts[3], " ".join(corpus[-1][1].split()[500:530])])]


def test_same_as_brute_force(spark, make_docs, corpus):
    docs = [*corpus, corpus[0], corpus[0]]
    items = items_of(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 300):  # in one block, and in several
        found = find_contamination(make_docs(docs), bench, block_bytes=size)
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == brute(docs, items)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    assert sum(r[-1] for r in got) > 20
    dirty = {r[0] for r in got if r[-1]}
    for size in (1 << 20, 300):
        left = remove_contaminated(make_docs(docs), bench, block_bytes=size)
        assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_longest_match_and_place(spark, make_docs):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z"), (2, "w1 w2"), (None, None)]
    rows = find_contamination(make_docs(docs), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    by_id = {r.doc_id: r for r in rows}
    assert [tuple(m) for m in by_id[1].matches] == [("7", 2, 5, 20)]
    assert by_id[1].n_hit == 20 and not by_id[2].contaminated and by_id[None].n_words == 0


def test_empty_tables(spark, make_docs, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(make_docs([]), none).count() == 0
    assert not any(r.contaminated for r in find_contamination(make_docs(corpus[:9]), none).collect())


def test_words_of_special_form_are_not_one(spark, make_docs):
    """A Thue-Morse word and its complement."""
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    found = find_contamination(make_docs([(1, " ".join([other] * 12)), (2, " ".join([one] * 12))]), spark.createDataFrame([(1, " ".join([one] * 10))], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 0, 2: 12}


def longest_brute(doc, item):
    a, b = WORD.findall(lower(doc)), WORD.findall(lower(item))
    best, before = (0, 0, 0), {}
    for i in range(len(a)):
        now = {}
        for j in range(len(b)):
            if a[i] == b[j]:
                n = now[j] = before.get(j - 1, 0) + 1
                best = max(best, (n, -(j - n + 1), -(i - n + 1)))
        before = now
    return -best[2], -best[1], best[0]


def test_repeats_in_document_and_item(spark, make_docs):
    docs = [(1, "a " * 60 + "b " * 20 + "a " * 35), (2, "a b " * 40 + "c"), (3, "b a b a b a b a b a b q " * 3), (4, "a " * 9)]
    items = [(1, "a " * 30), (2, "b a " * 25 + "c"), (3, "a " * 12 + "b " * 12), (4, "a b")]
    rows = find_contamination(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == brute(docs, items)
    texts, bodies = dict(docs), dict(items)
    for r in rows:
        for m in r.matches:
            assert tuple(m)[1:] == longest_brute(texts[r.doc_id], bodies[int(m.item_id)])
        assert r.longest_match == max((m.n_words for m in r.matches), default=0)


def test_long_repeats_need_little_memory():
    import tracemalloc

    import pyarrow as pa

    from glossmill.llm import decontaminate
    from glossmill.llm.words import WordKey

    text = "a " * 20_000
    tests = decontaminate.benchmark_suffixes([("1", text)], 10, WordKey(1))
    tracemalloc.start()
    ((part, *found),) = decontaminate._search(pa.array([text]), tests)
    matches = decontaminate._longest(part, *found, tests)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert found[1].all() and [int(x[0]) for x in matches] == [0, 0, 0, 0, 20_000]


#: Two words that an unkeyed hash of eight bytes at a time took for one.
TWINS = ("rs18bf38k17b4gxy", "8cmzhkvd9b1dwzlg")


def test_words_made_for_an_unkeyed_hash(spark, make_docs):
    docs = [(1, " ".join([TWINS[0]] * 12)), (2, " ".join([TWINS[1]] * 12))]
    found = find_contamination(make_docs(docs), spark.createDataFrame([(1, " ".join([TWINS[1]] * 10))], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 0, 2: 12}
