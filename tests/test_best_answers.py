import random

from glossmill.operators import questions


def test_best_answers_are_chosen_in_tasks(spark):
    rng = random.Random(6)
    rows = [(q, d, rng.randint(0, 9) / 3) for q in range(7) for d in rng.sample(range(400), 300)]
    scores = spark.createDataFrame(rows, "query_id long, doc_id long, score double").repartition(5)
    found = questions.best_answers(scores, 4)
    expected = [(q, d, r) for q in range(7) for r, (_, d) in enumerate(sorted((-round(s, 9), d) for x, d, s in rows if x == q)[:4], 1)]
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found.collect()) == sorted(expected)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert questions.best_answers(scores.limit(0)).collect() == []


def test_only_runs_that_are_asked_leave_their_task(spark):
    docs = spark.createDataFrame([(1, "red fox red fox"), (1, "a red fox"), (2, "owl"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "Red fox")], "query_id long, text string")
    found = questions.answer_scores(docs, asked)
    assert [tuple(r) for r in found.collect()] == [(9, 1, 2.5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [doc_id") < plan.index("RepartitionByExpression") < plan.index("LeftSemi")  # from the top down
