import random

import corpus_pipeline
import pytest
from test_decontaminate import brute as brute_hits
from test_language_id import held, texts
from test_line_dedup import brute as brute_lines
from test_near_duplicates import brute as brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in three made languages with copies, near copies, repeated lines and benchmark passages."""
    rng = random.Random(8)
    rows = [(i, text, lang) for i, text, lang in texts(300, seed=9)]
    shared = [" ".join(t.split()[:4]) for _, t, _ in rows[:6]]
    items = [(k, rows[200 + k][1]) for k in range(4)] + [(9, None), (10, "")]
    for i in range(300, 360):
        _, text, lang = rng.choice(rows[:300])
        words = text.split()
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "other"
        if i % 5 == 0:
            words = [*words, "\n" + "\n".join(shared[:4]), *words[:3]]
        if i % 7 == 0:
            words += items[i % 4][1].split()
        rows.append((i, " ".join(words), lang))
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 34 !!", "cc"), (403, "中文字 " * 60, None), (404, rows[5][1], None)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), items


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, folder):
    path, items = folder
    given = spark.read.parquet(f"{path}/documents.parquet")
    columns, rows = given.columns, pairs(given)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    stages = dict(corpus_pipeline.STAGES)

    known = stages[names[0]](spark, given, path)
    assert known.columns == columns
    left = pairs(known)
    assert {400, 401, 402, 403}.isdisjoint(d for d, _ in left)
    assert set(left) <= set(rows) and len(left) >= len(rows) - 8

    cut = stages[names[1]](spark, known, path)
    assert cut.columns == columns
    expected = sorted(((r[0], r[3]) for r in brute_lines(left)), key=str)
    assert pairs(cut) == expected and expected != left

    one = stages[names[2]](spark, cut, path)
    assert one.columns == columns
    groups = {c if s else ("blank", d) for d, s, c, _ in brute_groups(expected, 80)}
    chosen = pairs(one)
    assert len(chosen) == len(groups) < len(expected) and set(chosen) <= set(expected)

    clean = stages[names[3]](spark, one, path)
    assert clean.columns == columns
    dirty = {r[0] for r in brute_hits(chosen, items) if r[-1]}
    final = pairs(clean)
    assert final == [r for r in chosen if r[0] not in dirty] and dirty

    packed = corpus_pipeline.run(spark, path).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(d for d, _ in final)
    full = {}
    for r in packed:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert max(full.values()) <= 4096
    assert any(held(d) for d, _ in final)


def test_no_documents(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
