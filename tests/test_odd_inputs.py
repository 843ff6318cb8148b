"""Queries and their SQL on rows that the tables have seldom."""

import duckdb
import pandas as pd

from glossmill.operators import mail
from glossmill.plans import message_queries, registry


def same(spark, name, frame, table, **columns):
    """The rows of a query of one table given as a frame, which must be those of its SQL."""
    con = duckdb.connect()
    con.register(table, frame)
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), ", ".join(f"{c} {t}" for c, t in columns.items()))
    make = getattr(message_queries, name)
    found = make(spark, rows) if make.__code__.co_varnames[0] == "spark" else make(rows)
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    expected = sorted(cursor.fetchall(), key=str)
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == expected
    return expected


def test_a_document_without_words_gets_the_added_one(spark):
    docs = pd.DataFrame([(1, "red foxes"), (5, "!! 12"), (10, ""), (20, "red red owls"), (6, "red"), (25, None)], columns=["doc_id", "text"])
    found = same(spark, "maintained_index", docs, "documents", doc_id="long", text="string")
    assert {(5, 1, 1), (10, 1, 1), (20, 3, 4)} <= set(found)


def test_messages_come_once_and_a_similarity_of_the_limit_counts(spark):
    # The fields of a message of user give 'subject' 5, 'user' 10 and 'mail', 'example' 6 each, 'team0' 1; a word of weight n makes the similarity 11 / sqrt(198 + n * n).
    rows = [(60, 0, "user", "same words"), (120, 0, "user", "same words"), (60, 1, "user", None), (120, 1, "user", None), (1, 0, "system", "other")]
    rows += [(4 * i, 2, "user", " ".join(["filling"] * n)) for i, n in enumerate(range(48, 60), 1)]
    found = dict(same(spark, "filed_messages", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]), "conversations", conv_id="long", turn="long", role="string", text="string"))
    assert 60000 in found and 120000 not in found and 60001 in found and 120001 not in found


def test_the_similarity_of_the_limit_is_reached(spark):
    """A weight of a fifth of the length, which floating point makes a little less."""
    part = 0.005
    vectors = spark.createDataFrame([(1, "user", part), (1, "x", 2 * part), (1, "y", 2 * part), (1, "z", 4 * part)], "doc_id long, term string, weight double")
    centres = spark.createDataFrame([("a", "user", 1.0)], "category string, term string, weight double")
    found = mail.nearest_centroid(vectors, centres, 0.2).first()
    assert found.sim < 0.2 and found.category == "a"


def test_a_done_link_is_judged_by_its_own_page(spark):
    page = lambda words: f"<p>{words} {'text ' * 20}</p>"
    rows = [(1, "http://a.example/x", page("und und")), (4, "http://a.example/x", page("que")), (3, "http://a.example/y", page("und")), (7, None, page("und")), (6, None, page("und")), (10, "http://b.example", None)]
    found = {r[0]: r for r in same(spark, "recomputed_links", pd.DataFrame(rows, columns=["page_id", "url", "html"]), "pages", page_id="long", url="string", html="string")}
    assert found[1][2] == 2000 and found[4][2] == 500 and found[7][2] == 1000 and len(found) == 6
