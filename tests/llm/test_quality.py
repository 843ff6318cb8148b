import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm.quality import OrdinalModel, fit_ordinal, grade_documents


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioudnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        text = [rng.choice(words) for _ in range(rng.randint(10, 120))]
        if grade == 0:
            for _ in range(2):
                text[rng.randrange(len(text))] = rng.choice(["badword", "vequ" + rng.choice(words)])
        if grade == 1:
            text = rng.choice([[w + "!!" for w in text], [text[0]] * len(text), [w.upper() for w in text]])
        out.append((i, " ".join(text), grade))
    return out


def test_held_out_grades(spark, make_docs):
    docs = made(1500)
    ratings = spark.createDataFrame([(d, g) for d, _, g in docs if d % 3] + [(None, 1), (4, None), (10**6, 1)], "doc_id long, grade int")
    odd = [(2001, None), (2002, ""), (None, docs[0][1]), (0, docs[0][1])]
    rows = grade_documents(make_docs([*((d, t) for d, t, _ in docs), *odd]), ratings, epochs=150).collect()
    assert len(rows) == len(docs) + 4
    by = {r.doc_id: r for r in rows}
    held = [(by[d], g) for d, _, g in docs if d % 3 == 0]
    assert np.mean([r.kept == (g == 2) for r, g in held]) > 0.93
    means = [np.mean([r.expected_grade for r, g in held if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    for r in rows:
        assert len(r.at_least) == 2 and r.at_least[0] >= r.at_least[1] == r.tail_probability
        assert abs(sum(r.at_least) - r.expected_grade) < 1e-9
    again = grade_documents(make_docs([(d, t) for d, t, _ in docs[:50]]), spark.createDataFrame([], "doc_id long, grade int")).collect()
    assert all(r.kept and r.expected_grade is None for r in again)
    assert grade_documents(make_docs([]), ratings).count() == 0


def test_thresholds_follow_the_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, 3000)
    grades = np.digitize(x + rng.normal(0, 0.3, 3000), [3, 6])
    bounds = np.cumsum(np.append(0, x + 1))
    model = fit_ordinal(np.concatenate([np.arange(100, 100 + k + 1) for k in x]), bounds, grades, 3, epochs=30)
    assert model.thresholds[0] < model.thresholds[1]
    p = model.at_least(np.concatenate([np.arange(100, 100 + k + 1) for k in range(9)]), np.cumsum([0, *range(1, 10)]))
    assert ((p.sum(axis=1).round().astype(int)) == [0, 0, 0, 1, 1, 1, 2, 2, 2]).sum() >= 7
    assert np.allclose(OrdinalModel(np.zeros(4), np.array([0.0])).at_least(np.array([], int), np.array([0, 0])), 0.5)


def test_a_grade_out_of_range_is_an_error(spark, make_docs):
    with pytest.raises(ValueError):
        grade_documents(make_docs([(1, "a b")]), spark.createDataFrame([(1, 3)], "doc_id long, grade int"))


def test_graded_labels_of_the_tables(spark):
    """Held-out accuracy on the tables: fitted without every third label, which is then graded."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.select("doc_id", grade.alias("grade")).filter("doc_id is not null")
    found = grade_documents(docs, rated.filter("doc_id % 3 != 0"))
    rows = found.join(rated.filter("doc_id % 3 = 0"), "doc_id").collect()
    means = [np.mean([r.expected_grade for r in rows if r.grade == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert np.mean([round(r.expected_grade) == r.grade for r in rows]) > 0.7
