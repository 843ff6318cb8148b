import random

import pytest
from pyspark.sql import functions as F

from glossmill.functions import records
from glossmill.operators import crawl, graphs, inverted_index, lexicon, mail, news, phrases, questions, relational, summaries, tagging, typed_tokens, web
from glossmill.plans import sample_lexicon


def test_odd_marked_sections_do_not_stop_a_page(spark):
    pages = spark.createDataFrame([(1, "u", "<p>before</p><![foo[bar]]><p>after</p>"), (2, "u", "<p>fine</p>"), (3, "u", None)], "page_id long, url string, html string")
    found = {r.page_id: r for r in web.parse_pages(pages).collect()}
    assert "before" in found[1].text and found[1].error and found[2].error is None and found[3].text == ""


def test_search_reads_the_folders_of_its_words_only(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red foxes jump"), (2, "foxglove and owls"), (3, "red owls")], "doc_id long, text string")
    path = str(tmp_path / "index")
    inverted_index.write_index(inverted_index.postings(docs), path)
    stored = spark.read.parquet(path)
    for asked, expected in (("foxes", {1}), ("fox*", {1, 2}), ("red OR owls", {1, 2, 3})):
        found = inverted_index.retrieve(stored, asked)
        assert {r.doc_id for r in found.collect()} == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan


def test_tags_resolve_from_left_to_right(spark):
    """Against a plain loop over rules, on random sentences."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(8)]
    lex = [(w, t, rng.randint(1, 9)) for w in words for t in rng.sample("nvad", rng.randint(1, 3))]
    sentences = [[rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    rules = []
    for w in words:
        tags = [t for x, t, _ in lex if x == w]
        rules += [("WB", rng.random(), rng.choice(tags), w, other) for other in "nv"] + [("WF", rng.random(), rng.choice(tags), other, w) for other in "da"]
    tokens = spark.createDataFrame([(1, i, j, w) for i, s in enumerate(sentences) for j, w in enumerate(s)], "doc_id long, sent int, pos int, token string")
    found = tagging.tag_sentences(tokens, spark.createDataFrame(lex, "word string, tag string, n long"), spark.createDataFrame(rules, "kind string, frequency double, tag string, part1 string, part2 string"))
    options = {w: [t for _, t in sorted((-n, t) for x, t, n in lex if x == w)] for w in words}
    for r in found.collect():
        tags = ["".join(options[w]) for w in sentences[r.sent]]
        for i, w in enumerate(sentences[r.sent]):
            if len(tags[i]) > 1:
                hits = [(-f, t) for kind, f, t, a, b in rules if kind == "WB" and a == w and i + 1 < len(tags) and b in tags[i + 1]]
                hits += [(-f, t) for kind, f, t, a, b in rules if kind == "WF" and b == w and i and a in tags[i - 1]]
                closed = [t for t in options[w] if t in tagging.FUNCTION_TAGS]
                tags[i] = min(hits)[1] if hits else closed[-1] if closed else options[w][0]
        assert list(r.tags) == tags and list(r.tokens) == sentences[r.sent]


def test_unknown_words_take_the_tags_of_their_bases(spark):
    t = sample_lexicon.tables(spark)
    known = t["words"].groupBy("word", F.col("pos").alias("tag")).agg(F.sum("tag_count").alias("n"))
    more = tagging.with_bases(known, lexicon.base_words(t["asked"], t["words"], t["exceptions"]))
    tokens = spark.createDataFrame([(1, 0, 0, "hounds"), (1, 0, 1, "chased"), (1, 0, 2, "zzz")], "doc_id long, sent int, pos int, token string")
    found = {r.token: [c.tag for c in r.candidates] for r in tagging.candidate_tags(tokens, more).collect()}
    assert found == {"hounds": ["n"], "chased": ["v"], "zzz": ["n"]}


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_dense_clusters(spark, share):
    rng = random.Random(5)
    links = {(a, b) for a in range(24) for b in range(a + 1, 24) if a // 6 == b // 6 and rng.random() < 0.75}
    members = [(i, i // 6) for i in range(25)]
    found = graphs.dense_clusters(spark.createDataFrame(sorted(links), "a int, b int"), spark.createDataFrame(members, "node int, cluster int"), share)
    got = {r.node: r.cluster for r in found.collect()}
    groups = {}
    for node, cluster in got.items():
        groups.setdefault(cluster, set()).add(node)
    assert len(got) == 25 and any(len(g) > 1 for c, g in groups.items() if c is not None)
    for cluster, group in groups.items():
        for a in group if cluster is not None else ():
            assert sum((min(a, b), max(a, b)) in links for b in group if b != a) >= share * (len(group) - 1) - 1e-9 and len(group) > 1


def test_recategorised_messages_move_centroids(spark):
    centres = spark.createDataFrame([("a", {"x": 0.5, "y": 0.5}, 100.0), ("b", {"z": 1.0}, 100.0), ("c", {"q": 1.0}, 50.0)], "category string, centroid map<string,double>, size double")
    moves = spark.createDataFrame([("a", "b", {"x": 1.0}, 20.0), ("c", "c", {"q": 1.0}, 5.0)], "old string, new string, vector map<string,double>, length double")
    found = {r.category: (r.centroid, r["size"]) for r in mail.recategorised(centres, moves).collect()}
    assert found["c"] == ({"q": 1.0}, 50.0) and found["a"][1] == 80.0 and found["b"][1] == 120.0
    assert found["a"][0].get("x", 0.0) < found["a"][0]["y"] and found["b"][0]["x"] > 0.1
    assert all(abs(sum(c.values()) - 1) < 1e-9 for c, _ in found.values())


def test_expanded_queries_sum_and_negatives_are_thinned(spark):
    weights = spark.createDataFrame([(1, "dog", 128.0), (1, "dog", 64.0), (1, "cat", 8.0)], "query_id long, word string, weight double")
    assert {(r.word, r.weight) for r in questions.expanded_query(weights).collect()} == {("dog", 192.0), ("cat", 8.0)}
    asked = spark.createDataFrame([(i, "vector", f"t{i % 4}", 1.0) for i in range(400)], "question_id long, kind string, term string, weight double")
    profile = spark.createDataFrame([(f"c{i}", "vector", f"t{i}", 1.0) for i in range(4)], "category string, kind string, term string, weight double")
    actual = spark.createDataFrame([(i, f"c{i % 4}") for i in range(400)], "question_id long, category string")
    rows = questions.training_patterns(asked, profile, actual).collect()
    assert sum(r.label for r in rows) == 800 and 200 < sum(not r.label for r in rows) < 400
    assert all(r.s5 == (1.0 if r.label else 0.0) and r.s1 == 0 for r in rows)


def test_crawls_restart_and_records_keep_names(spark):
    links = spark.createDataFrame([("a.x/1", "Visiting"), ("b.x/1", "New"), ("c.x/1", "Done")], "url string, status string")
    assert {(r.url, r.status) for r in crawl.restarted(links, blocked=["b.x"]).collect()} == {("a.x/1", "New"), ("c.x/1", "Done")}
    assert [r.url for r in crawl.restarted(links, selected=["b.x"]).collect()] == ["b.x/1"]
    one = spark.createDataFrame([("a###1___b###2___a###3___broken",), ("",), (None,)], "t string")
    got = one.select(records.with_settings(F.col("t"), {"c": "x"}), records.without_settings(F.col("t"), ["a"])).collect()
    assert [tuple(r) for r in got] == [("a###1___b###2___c###x", "b###2"), ("c###x", ""), (None, None)]


def test_overlap_of_long_texts(spark):
    a = "one two three four five"
    rows = spark.createDataFrame([(a, "x two three four y"), (a, a), (a, ""), (None, a)], "a string, b string").select(summaries.overlap("a", "b").alias("o")).collect()
    assert [round(r.o, 3) for r in rows] == [round(7 / 9, 3), 1.0, 0.0, 0.0]


def test_unique_sources(spark):
    table = spark.createDataFrame([(1, "u1"), (2, "u2")], "id int, url string")
    changes = spark.createDataFrame([(2, "u1"), (3, "u3"), (4, "u3"), (1, "u1")], "id int, url string")
    kept, bad = relational.unique_or_rejected(table, changes, "id", "url")
    assert {tuple(r) for r in kept.collect()} == {(1, "u1"), (2, "u2"), (3, "u3")} and {r.id for r in bad.collect()} == {2, 4}


def test_phrases_by_tags_and_tokens_by_tables(spark):
    docs = spark.createDataFrame([(1, "quick fox runs. quick fox runs. quick fox sleeps. slowly fox slowly fox.")], "doc_id long, text string")
    tags = spark.createDataFrame([("quick", "a"), ("fox", "n"), ("runs", "v"), ("slowly", "r")], "word string, tag string")
    every = {r.phrase for r in phrases.key_phrases(docs).collect()}
    assert {r.phrase for r in phrases.key_phrases(docs, tags=tags).collect()} == {"Quick Fox"} and len(every) > 1
    lex = typed_tokens.token_lexicon(spark.createDataFrame([("Dr.", "a"), (".nl", "ic"), (":D", "e")], "name string, kind string"), spark.createDataFrame([("New Town",)], "phrase string"))
    assert [t for t, _, _ in typed_tokens.typed("Dr. Who saw new town :D at x.nl", lex)] == ["Dr.", "Who", "saw", "new town", ":D", "at", "x.nl"]
    made = spark.createDataFrame([("The U.S. army of Dr. Who and 3 new towns",)], "t string").select(typed_tokens.content_tokens(typed_tokens.assemble(F.col("t")))).first()[0]
    assert made == ["u.s.", "army", "dr.", "new", "towns"]


def test_collected_news(spark):
    rows = [(1, "Red foxes jump over quiet rivers and hunt at night near quiet rivers today."), (2, "Red foxes hunt near rivers while owls watch the quiet night of rivers and foxes."), (3, "Stock prices fell sharply. Traders sold shares and stock prices fell once more."), (4, "Red foxes jump over quiet rivers and hunt at night near quiet rivers today.")]
    found = news.collected(spark.createDataFrame(rows, "doc_id long, text string"))
    stories = {r.doc_id: r for r in found["stories"].collect()}
    assert set(stories) == {1, 2, 3} and stories[1].cluster == stories[2].cluster == 1 and stories[3].cluster is None and all(r.summary for r in stories.values())
    assert {(r.doc_id, r.other) for r in found["related"].collect()} == {(1, 2), (2, 1)}
    assert [r["size"] for r in found["clusters"].collect()] == [2] and found["index"].filter("term = 'foxes'").count() == 2


def test_summaries_with_synonyms(spark):
    text = (
        "The hound barked loudly beside the garden gate until midnight passed. A tired dog slept soundly near an old fireplace the whole winter. "
        "Nothing else of interest happened in that village yesterday evening. Heavy rain poured onto empty streets during most early mornings."
    )
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    same = spark.createDataFrame([("hound", "dog"), ("dog", "hound")], "term string, synonym string")
    plain, more = (summaries.summaries(docs, size=2, threshold=0.1, synonyms=s).first() for s in (None, same))
    assert plain.n_chosen == more.n_chosen == 2 and "hound" in more.summary
