import random
import re

import pytest

from glossmill.llm import near_duplicates as operator
from glossmill.operators.graphs import components
from glossmill.llm.near_duplicates import collections_for, drop_near_duplicates, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(docs, percent):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return sorted(((d, len(s), least.get(root(i)), d == least.get(root(i))) for i, (d, s) in enumerate(sets)), key=str)


def got(found):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def copies(corpus):
    """Edits of one text in every number, so that links chain and buckets stay unsettled."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    out = [*corpus, corpus[0], (None, corpus[0][1])]
    for i in range(120):
        words = list(base)
        for _ in range(i % 12):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        out.append((2000 + i, " ".join(words)))
        if i % 12 > 6:
            words[rng.randrange(150)] = "again"
            out.append((3000 - i, " ".join(words)))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_same_as_brute_force(make_docs, copies, percent):
    found = near_duplicates(make_docs(copies), percent)
    assert got(found) == brute(copies, percent)


def test_one_of_each_group_stays(make_docs, copies):
    docs = make_docs(copies)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = {(c if s else ("blank", d)) for d, s, c, _ in brute(copies, 80)}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(expected) and {c for c in expected if not isinstance(c, tuple)} <= set(ids)


def test_empty_and_blank(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    rows = got(near_duplicates(make_docs([(2, ""), (1, ""), (3, None), (None, "a"), (None, "A")])))
    assert rows == sorted([(2, 0, 2, True), (1, 0, 1, True), (3, 0, 3, True), (None, 1, None, True), (None, 1, None, True)], key=str)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 4)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    group = {}
    for a, b in pairs:
        if a is not None and a != b:
            one, two = group.setdefault(a, {a}), group.setdefault(b, {b})
            if one is not two:
                one |= two
                for x in two:
                    group[x] = one
    assert found == {x: min(g) for x, g in group.items()}
    assert collections_for(0.85) == 16


@pytest.fixture
def tasks(spark):
    """Runs a function and counts the tasks that it took, with 20 partitions to each shuffle."""
    context, settings = spark.sparkContext, {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}

    def count(run):
        group = f"tasks-{random.random()}"
        context.setJobGroup(group, group)
        run()
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in context.statusTracker().getJobIdsForGroup(group) for s in context.statusTracker().getJobInfo(j).stageIds}
        return sum(i.numCompletedTasks for s in stages if (i := context.statusTracker().getStageInfo(s)))

    for k, v in settings.items():
        spark.conf.set(k, v)
    yield count
    context.setLocalProperty("spark.jobGroup.id", None)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_take_few_tasks(spark, tasks):
    """With many partitions, tasks of a few rows each were most of the disk (logs, small files) of near-dedup."""
    stars = spark.createDataFrame([(i % 7, i) for i in range(7, 200)], "a int, b int").coalesce(2)
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int").coalesce(2)
    assert tasks(lambda: components(stars).collect()) < 130
    assert tasks(lambda: components(path).collect()) < 900


def test_rounds_of_leads_end_when_they_settle_little(make_docs, copies, monkeypatch):
    calls = []
    monkeypatch.setattr(operator, "SETTLING", 0.0)
    monkeypatch.setattr(operator, "_stars", lambda rows, make=operator._stars: calls.append(1) or make(rows))
    assert got(near_duplicates(make_docs(copies), 85)) == brute(copies, 85) and len(calls) == 2


def test_long_words_that_sum_alike_stay_apart(make_docs):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo powers of two."""
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    rows = got(near_duplicates(make_docs([(1, one), (2, one.translate(str.maketrans("ab", "ba")))])))
    assert rows == [(1, 1, 1, True), (2, 1, 2, True)]


def test_frequent_shingles_are_compared_in_blocks(make_docs, monkeypatch):
    """Many texts of one template, alike in chains only: leads leave them open, blocks settle them."""
    monkeypatch.setattr("glossmill.llm.near_duplicates._TOGETHER", 7)
    monkeypatch.setattr("glossmill.llm.near_duplicates.STARS", 1)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        text = list(words)
        for j in range(i % 20):
            text[(j * 5 + i // 20) % 100] = f"y{rng.randrange(3)}"
        rows.append((i, " ".join(text)))
    assert got(near_duplicates(make_docs(rows), 85)) == brute(rows, 85)


def test_words_made_for_an_unkeyed_hash(make_docs):
    one, other = "rs18bf38k17b4gxy", "8cmzhkvd9b1dwzlg"  # which eight bytes at a time took for one
    rows = got(near_duplicates(make_docs([(1, one), (2, other), (3, f"a b c {one} d"), (4, f"a b c {other} d")])))
    assert rows == brute([(1, one), (2, other), (3, f"a b c {one} d"), (4, f"a b c {other} d")], 80) and all(r[3] for r in rows)
