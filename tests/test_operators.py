import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.operators import crawl, entities, graphs, inverted_index, latent, lexicon, mail, news, questions, relational, summaries, tagging, text_stats, vectors, web
from glossmill.operators.sentences import sentence_spans, sentences
from glossmill.operators.typed_tokens import TokenLexicon, typed
from glossmill.plans import message_queries, text_queries

DOCS = [
    (1, "Red foxes jump over quiet rivers. Red foxes hunt at night near quiet rivers."),
    (2, "Red foxes hunt near rivers while owls watch the quiet night."),
    (3, "Stock prices fell sharply. Traders sold shares and stock prices fell again."),
    (4, "Traders sold stock as prices fell sharply on Monday."),
    (5, None),
    (6, ""),
    (7, "Red foxes hunt near rivers while owls watch the quiet night."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in DOCS], "doc_id long, text string, term string, weight double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_similar_pairs_are_all_pairs_above(docs):
    v = vectors.tfidf_vectors(vectors.term_frequencies(docs))
    full = [(a, b, round(s, 6)) for a, b, s in rows(vectors.cosine_pairs(v)) if s >= 0.3]
    assert [(a, b, round(s, 6)) for a, b, s in rows(vectors.similar_pairs(v, 0.3))] == full and len(full) >= 3
    maps = {r.doc_id: r.vector for r in vectors.as_maps(v).collect()}
    assert abs(sum(maps[1].values()) - 1) < 1e-9 and 5 not in maps
    assert rows(vectors.matrix_product(v.sparkSession.createDataFrame([(0, 0, 2.0), (0, 1, 1.0)], "i int, j int, value double"), v.sparkSession.createDataFrame([(0, 0, 3.0), (1, 0, 4.0)], "i int, j int, value double"))) == [(0, 0, 10.0)]
    more = vectors.expanded(v.filter("doc_id = 4"), v.sparkSession.createDataFrame([("stock", "equity")], "term string, synonym string"))
    assert {"equity", "stock"} <= {r.term for r in more.collect()}


def test_components_and_stars(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 120)]
    edges = spark.createDataFrame(pairs, "a int, b int")
    group = {}
    for a, b in pairs:
        if a != b:
            x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
            if x is not y:
                x |= y
                group.update({n: x for n in x})
    assert rows(graphs.components(edges)) == sorted((n, min(g)) for n, g in group.items())
    weights = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("weight", F.lit(1.0))
    stars = dict(rows(graphs.star_clusters(edges, weights)))
    links = {frozenset(p) for p in pairs}
    assert set(stars) == set(group) and all(n == lead or frozenset((n, lead)) in links for n, lead in stars.items())
    assert all(stars[lead] == lead for lead in stars.values())


def test_index_and_search(spark, docs, tmp_path):
    index = inverted_index.postings(docs)
    inverted_index.write_index(index, str(tmp_path / "index"))
    again = spark.read.parquet(str(tmp_path / "index"))
    assert rows(inverted_index.retrieve(again, "stock foxes")) == rows(inverted_index.retrieve(index, "stock foxes"))
    assert [r[0] for r in rows(inverted_index.search(docs, index, "foxes AND owls").select("doc_id"))] == [2, 7]
    assert [r[0] for r in rows(inverted_index.search(docs, index, "NOT foxes").select("doc_id"))] == [3, 4]
    assert [r[0] for r in rows(inverted_index.search(docs, index, "trad*").select("doc_id"))] == [3, 4]
    assert inverted_index.remove_documents(index, docs.filter("doc_id = 3").select("doc_id")).filter("doc_id = 3").isEmpty()
    found = inverted_index.search(docs, index, "foxes OR prices").select("doc_id", "weight")
    assert [(r.doc_id, r.position) for r in inverted_index.page(found, 9, 2).orderBy("position").collect()] == [(7, 5)]
    assert inverted_index.pages_of(25, 3) == {"first": 1, "previous": 2, "page": 3, "next": 3, "last": 3}
    assert inverted_index.postings(docs.limit(0)).count() == 0


def test_sentences_and_tokens(docs):
    text = 'Dr. Smith met J. Doe at the old station near the river today. "They talked for hours about it." Then they left, quite late, for the north.'
    parts = [text[a:b].strip() for a, b in sentence_spans(text, least=1)]
    assert [p[:4] for p in parts] == ["Dr. ", '"The', "Then"] and sentence_spans("", 1) == [] and sentence_spans("short") == [(0, 5)]
    found = sentences(docs, "news", least=1)
    assert {r.doc_id for r in found.collect()} == {1, 2, 3, 4, 7}
    kinds = {t: k for t, _, k in typed("Dr. Who paid 1,200.50 for a-b tests :-) at http://x.org/a or me@x.org on 10.0.0.1, New York rocks 5% U.S. example.com.", TokenLexicon(collocations=frozenset({"new york"})))}
    assert kinds["Dr."] == "a" and kinds["1,200.50"] == "n" and kinds["a-b"] == "b" and kinds[":-)"] == "e" and kinds["me@x.org"] == "i" and kinds["10.0.0.1"] == "i"
    assert kinds["New York"] == "c" and kinds["5%"] == "n" and kinds["U.S."] == "a" and kinds["example.com"] == "i" and kinds["http://x.org/a"] == "i" and typed(None) == []


def test_summaries_and_news(docs):
    found = {r.doc_id: r for r in summaries.summaries(docs, size=2).collect()}
    assert set(found) == {1, 2, 3, 4, 7} and all(r.n_chosen >= 1 and r.summary for r in found.values())
    assert summaries.overlap_share("a b c d", "x b c y") == pytest.approx(5 / 7)
    got = docs.filter("doc_id = 1").select(summaries.snippets(F.col("text"), ["rivers", "hunt"], 30, before="<b>", after="</b>")).first()[0]
    assert got and all(x.startswith("...") for x in got) and any("<b>" in x for x in got)
    assert [r.doc_id for r in news.distinct_stories(docs).orderBy("doc_id").collect()] == [1, 2, 3, 4, 6]
    members, pairs = news.story_groups(docs, 0.3)
    cluster = dict(rows(members.filter("cluster is not null")))
    assert cluster[2] == cluster[7] and cluster[3] == cluster[4] != cluster[2]
    titles = news.clusters(members, docs).collect()
    assert sum(r["size"] for r in titles) == len(cluster) and all(r.title for r in titles)


def test_story_groups_link_all_pairs_above(spark, docs):
    _, pairs = news.story_groups(docs)
    v = vectors.tfidf_vectors(vectors.term_frequencies(docs.filter("length(text) > 50")))
    full = [(a, b, round(s, 6)) for a, b, s in rows(vectors.cosine_pairs(v)) if s >= 0.2]
    assert [(a, b, round(s, 6)) for a, b, s in rows(pairs)] == full and (2, 7, 1.0) in full


def test_registered_story_groups(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfgh") for _ in range(5)) for _ in range(150)]
    some = [(i, " ".join(rng.choice(words) for _ in range(15))) for i in range(60)]
    stories = spark.createDataFrame(some + [(100 + i, t) for i, t in some[:9]], "doc_id long, text string")
    linked = vectors.cosine_pairs(vectors.tfidf_vectors(vectors.term_frequencies(stories))).filter("sim >= 0.2")
    assert 0 < linked.filter("sim < 0.6").count()
    assert rows(text_queries.story_groups(stories).filter("cluster is not null")) == rows(graphs.components(linked))


def test_related_and_components_of_all_documents(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfgh") for _ in range(5)) for _ in range(150)]
    some = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(120)]
    stories = spark.createDataFrame(some + [(200 + i, some[i % 4 and 50][1]) for i in range(40)], "doc_id long, text string")
    full = vectors.cosine_pairs(vectors.frequency_vectors(vectors.term_frequencies(stories)))
    expected = [(r.doc_id, r["rank"], r.other, round(r.sim, 6)) for r in vectors.related(full).filter("doc_id % 50 = 0").collect()]
    found = [(r.doc_id, r["rank"], r.other, r.sim) for r in message_queries.related_documents_top10(stories).collect()]
    assert sorted(found) == sorted(expected) and len(found) == 40
    assert rows(text_queries.document_components(stories)) == rows(graphs.components(full.filter("sim >= 0.2")))


def test_latent_factors(spark):
    rng = np.random.default_rng(1)
    a = rng.random((12, 7)) * (rng.random((12, 7)) > 0.4)
    v = spark.createDataFrame([(i, f"t{j}", float(a[i, j])) for i in range(12) for j in range(7) if a[i, j]], "doc_id int, term string, weight double")
    terms, found, values = latent.latent_factors(v, 2, rounds=12)
    assert np.allclose(values, np.linalg.svd(a)[1][:2], rtol=1e-3)
    assert latent.latent_rank(9) == 3 and latent.latent_similarities(found, found.limit(3), 2).count() == 36


def test_lexicon(spark):
    words = spark.createDataFrame([("big", "a", "a1", 5, False), ("large", "a", "a1", 4, False), ("big", "a", "a2", 1, False), ("mature", "a", "a2", 1, False), ("walk", "v", "v1", 3, False), ("goose", "n", "n1", 2, False), ("bird", "n", "n2", 2, False), ("paris", "n", "n3", 1, True), ("new_york_city", "n", "n4", 1, True)], "word string, pos string, synset string, tag_count long, is_entity boolean")
    synsets = words.select("synset", "word", F.lit("").alias("gloss"))
    exceptions = spark.createDataFrame([("geese", "goose", "n")], "word string, base string, pos string")
    relations = spark.createDataFrame([("hypernym", "n1", "n2"), ("antonym", "big", "small")], "relation string, source string, target string")
    ask = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert rows(lexicon.base_words(ask("walked", "geese", "zzz"), words, exceptions)) == [("geese", "goose", "n"), ("walked", "walk", "v")]
    assert rows(lexicon.membership(ask("walked", "Big", "zzz"), words, exceptions)) == [("big", 1), ("walked", 2), ("zzz", 0)]
    assert rows(lexicon.similar_words(ask("big"), words, synsets, exceptions)) == [("big", "large")]
    assert rows(lexicon.similar_words(ask("big"), words, synsets, exceptions, full=True)) == [("big", "large"), ("big", "mature")]
    assert rows(lexicon.related_words(ask("goose"), "hypernym", words, synsets, relations)) == [("goose", "bird")]
    assert rows(lexicon.related_words(ask("big"), "antonym", words, synsets, relations)) == [("big", "small")]
    assert lexicon.related_words(ask("big"), "nothing", words, synsets, relations).count() == 0
    assert rows(lexicon.entity_flag(ask("Paris", "bird", "qqq"), words)) == [("bird", False), ("paris", True), ("qqq", True)]
    assert rows(lexicon.collocations(words)) == [("new", "new york city", 3)]
    assert rows(lexicon.prefix_matches(ask("birx"), words, least=1))[0] == ("birx", "bird")
    signatures = spark.createDataFrame([("a1", "house", 0.5), ("a2", "man", 0.5)], "synset string, term string, p double")
    scores = lexicon.sense_scores(spark.createDataFrame([(1, "big")], "target int, word string"), spark.createDataFrame([(1, "man")], "target int, term string"), words, signatures)
    assert rows(lexicon.best_senses(scores)) == [(1, "a2")]


def test_tagging(spark):
    lex = spark.createDataFrame([("the", "d", 9), ("run", "v", 5), ("run", "n", 4), ("long", "a", 3)], "word string, tag string, n long")
    tokens = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate("The run was long .".split())], "doc_id int, sent int, pos int, token string")
    rules = spark.createDataFrame([("WF", 0.9, "n", "d", "run")], "kind string, frequency double, tag string, part1 string, part2 string")
    assert tagging.tag_sentences(tokens, lex, rules).first().tags == ["d", "n", "n", "a", "u"]
    assert tagging.tag_sentences(tokens, lex, rules.limit(0)).first().tags[1] == "v"
    tagged = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate([("the", "d"), ("run", "n"), ("ends", "v"), ("the", "d"), ("run", "n")])], "doc_id int, pos int, word string, tag string")
    got = {(r.kind, r.part1, r.part2): (r.tag, r.frequency) for r in tagging.tag_rules(tagged).collect()}
    assert got[("WF", "d", "run")] == ("n", 1.0) and got[("WB", "the", "n")] == ("d", 1.0)


def test_entities(spark):
    words = "Anna flew to Rome . Later anna met Mr Blue in Oslo".split()
    tokens = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(words)], "doc_id int, sent int, pos int, token string")
    gazetteer = spark.createDataFrame([("anna", "person"), ("rome", "place"), ("rome", "org")], "name string, type string")
    rules = spark.createDataFrame([("bword_to", "place", 0.9), ("bword_in", "place", 0.8), ("start_up", "org", 0.1), ("bword_mr", "person", 0.9)], "feature string, type string, value double")
    found = {(r.pos, r.token): r.type for r in entities.extract_entities(tokens, gazetteer, rules).collect()}
    assert found[(0, "Anna")] == "person" and found[(6, "anna")] == "person" and found[(3, "Rome")] in ("place", "org") and (1, "flew") not in found
    fixed = rows(entities.with_corrections(gazetteer, spark.createDataFrame([("Rome Inc", "org"), ("rome", "place")], "name string, type string")))
    assert ("rome", "place") in fixed and ("inc", "part_org") in fixed and fixed.count(("rome", "org")) == 0


def _tokens(spark, *sentences):
    return spark.createDataFrame([(1, s, i, t) for s, words in enumerate(sentences) for i, t in enumerate(words.split())], "doc_id int, sent int, pos int, token string")


def _types(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.sent, r.pos)):
        out.setdefault(r.sent, []).append((r.token, r.type))
    return out


def test_names_of_several_words(spark):
    gazetteer = spark.createDataFrame([("New York", "place_city"), ("new_york_times", "org"), ("york", "place"), ("times square", "place"), ("bank of america", "org"), ("bank of", "tech"), ("bank", "part_org")], "name string, type string")
    tokens = _tokens(spark, "In NEW YORK the New York Times Square", "a bank of america and Bank of America . Bank of", "New York")
    spans = entities.name_spans(tokens, gazetteer)
    assert rows(spans.select("sent", "first", "last", "name", "type")) == [
        (0, 1, 2, "new york", "place"), (0, 4, 6, "new york times", "org"), (1, 5, 7, "bank of america", "org"), (1, 9, 10, "bank of", "tech"), (2, 0, 1, "new york", "place"),
    ]
    assert entities.name_spans(tokens, gazetteer.limit(0)).count() == 0


def test_parts_of_names_between_and_beside(spark):
    gazetteer = spark.createDataFrame([("acme", "org"), ("holding", "org"), ("and", "org"), ("river", "part_place"), ("severn", "place"), ("very", "part_place")], "name string, type string")
    dictionary = spark.createDataFrame([("river", "n", False), ("very", "r", False)], "word string, tags string, is_entity boolean")
    tokens = _tokens(spark, "Acme and Holding", "the Severn River is Very far", "River boats", "Severn . Very")
    typed = entities.seeded(entities.with_tags(tokens, dictionary), gazetteer)
    got = {(r.sent, r.pos): r.types for r in entities.resolved_parts(typed, gazetteer).collect()}
    assert [got[0, i] for i in range(3)] == [["org"]] * 3
    assert got[1, 2] == ["place"] and got[1, 4] == [] and got[2, 0] == [] and got[3, 2] == []  # very is no noun


def test_neighbours_and_runs(spark):
    gazetteer = spark.createDataFrame([("patriot", "org"), ("blue lake inc", "org"), ("wyndham hotel", "org"), ("anna", "person")], "name string, type string")
    dictionary = spark.createDataFrame([("big", "a", False), ("monday", "n", True), ("hence", "r", False)], "word string, tags string, is_entity boolean")
    typed = [(0, 0, "North", "miscellaneous"), (0, 1, "American", "miscellaneous"), (0, 2, "Patriot", "org"), (0, 3, "said", None), (1, 0, "Wyndham", "miscellaneous"), (1, 1, "Hotel", "miscellaneous"), (1, 2, "Corp", "miscellaneous"),
             (2, 0, "Anna", "person"), (2, 1, "Green", "miscellaneous"), (2, 2, "Hence", "miscellaneous"), (2, 3, "Red", "miscellaneous"), (3, 0, "Big", "miscellaneous"), (3, 1, ".", None), (3, 2, "Monday", "miscellaneous")]
    tokens = spark.createDataFrame([(1, *r) for r in typed], "doc_id int, sent int, pos int, token string, type string")
    got = {(r.sent, r.pos): r.type for r in entities.resolved_neighbours(entities.with_tags(tokens, dictionary), gazetteer).collect()}
    assert [got[0, i] for i in range(4)] == ["org", "org", "org", None]
    assert [got[1, i] for i in range(3)] == ["org"] * 3  # a run less the ending of a firm
    assert [got[2, i] for i in range(4)] == ["person", "person", None, "miscellaneous"]  # hence is no noun and is a common word
    assert got[3, 0] is None and got[3, 2] == "miscellaneous"


def test_common_words_and_types_of_the_document(spark):
    rules = spark.createDataFrame([("in_dictionary", "place", 0.2), ("in_dictionary", "org", 0.9)], "feature string, type string, value double")
    dictionary = spark.createDataFrame([("reading", "nv", False), ("bath", "n", False), ("apple", "nv", False)], "word string, tags string, is_entity boolean")
    typed = [(0, 0, "Reading", "place"), (0, 1, "Reading", "place"), (0, 2, "reading", "place"), (1, 0, "Bath", "place"), (1, 1, "Apple", "org"), (2, 0, "Apple", None), (2, 1, "apple", None), (2, 2, "Bath", "miscellaneous"), (3, 0, "Apple", "person")]
    tokens = spark.createDataFrame([(1, *r) for r in typed], "doc_id int, sent int, pos int, token string, type string")
    kept = entities.without_common_words(entities.with_tags(tokens, dictionary), rules)
    assert {(r.sent, r.pos): r.type for r in kept.collect() if r.sent < 2} == {(0, 0): None, (0, 1): "place", (0, 2): None, (1, 0): "place", (1, 1): "org"}
    got = {(r.sent, r.pos): r.type for r in entities.consistent_types(kept).collect()}
    assert got[2, 0] == got[3, 0] == "org" and got[2, 1] is None and got[2, 2] == "place" and got[0, 0] == "place"


def test_entities_of_a_news_story(spark):
    """Names of firms in a business story: whole names, parts, endings, and the same type all through."""
    gazetteer = spark.createDataFrame(
        [("reuters", "org"), ("new york", "place"), ("wyndham hotel", "org"), ("inc", "part_org"), ("corp", "part_org"), ("interstate hotels", "org"), ("interstate", "org"), ("patriot american hospitality", "org"), ("patriot", "org"), ("tuesday", "time")], "name string, type string"
    )
    dictionary = spark.createDataFrame([("said", "v", False), ("it", "p", False), ("on", "r", False), ("completion", "n", False), ("casinos", "n", True)], "word string, tags string, is_entity boolean")
    rules = spark.createDataFrame([("start_up", "org", 0.2)], "feature string, type string, value double").limit(0)
    story = (
        "NEW YORK ( Reuters ) - Hotel investment trust Patriot American Hospitality Inc . said Tuesday it had agreed to acquire Interstate Hotels Corp , a company",
        "On the Interstate deal and its acquisition of Wyndham Hotel Corp . and WHG Reuters",
    )
    got = _types(entities.extract_entities(_tokens(spark, *story), gazetteer, rules, dictionary))
    assert got[0] == [
        ("NEW", "place"), ("YORK", "place"), ("Reuters", "org"), ("Hotel", "org"), ("Patriot", "org"), ("American", "org"), ("Hospitality", "org"), ("Inc", "org"), ("Tuesday", "time"), ("Interstate", "org"), ("Hotels", "org"), ("Corp", "org"),
    ]
    assert got[1] == [("Interstate", "org"), ("Wyndham", "org"), ("Hotel", "org"), ("Corp", "org"), ("WHG", "org"), ("Reuters", "org")]


def test_questions(spark):
    parts = spark.createDataFrame([(1, "the old red bridge stands"), (2, "a bridge"), (3, "none")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "old red bridge")], "query_id long, text string")
    best = questions.best_answers(questions.answer_scores(parts, asked)).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in best] == [(1, 6.5), (2, round(1 / 3, 6))]
    rng = np.random.default_rng(0)
    x = rng.random((60, 5))
    patterns = spark.createDataFrame([(*map(float, r), bool(r[0] > 0.5)) for r in x], "s1 double, s2 double, s3 double, s4 double, s5 double, label boolean")
    weights = questions.train_network(patterns)
    assert len(weights) == 34
    yes, no = questions.network_outputs([F.col(f"s{i}") for i in range(1, 6)], F.array(*(F.lit(w) for w in weights)))
    right = patterns.select((yes > no).alias("y"), "label").filter("y = label").count()
    assert right >= 50
    scored = spark.createDataFrame([(1, "time", 0.9, 0.1), (1, "place", 0.8, 0.1), (1, "org", 0.7, 0.1), (2, "time", 0.2, 0.9)], "query_id int, category string, yes double, no double")
    assert [(r.query_id, r.category) for r in questions.answer_types(scored).orderBy("query_id", F.desc("score")).collect()] == [(1, "time"), (1, "place"), (2, "miscellaneous")]
    lines = spark.createDataFrame([(1, 1, "q", "a###time"), (2, 1, "q", "a###time"), (3, None, "q", "a"), (4, 4, "q", "b"), (5, 5, "q", "b###foo")], "line_no int, number int, question string, answer string")
    assert [r[1] for r in rows(questions.checked_questions(lines, ["time"]))] == ["repeated number", "repeated number", "no number", "no answer type", "unknown answer type"]


def test_mail(spark):
    box = spark.createDataFrame(
        [(1, "2024-01-02 00:00:00", '"Doe, Jo" <jo@x.org>, al@x.org', "Bo@y.org", "budget plans", "budget numbers attached"), (2, "2024-01-02 00:00:00", '"Doe, Jo" <jo@x.org>, al@x.org', "Bo@y.org", "again", "budget numbers attached"), (3, None, "a@x.org", "b@y.org", None, "x")],
        "id int, at string, sender string, recipient string, subject string, text string",
    ).withColumn("at", F.to_timestamp("at"))
    assert [r.id for r in mail.fresh_messages(box).collect()] == [1]
    assert mail.fresh_messages(box, box).count() == 0
    assert rows(mail.network_edges(box.filter("id = 1"))) == [("al@x.org", "bo@y.org", 1), ("jo@x.org", "bo@y.org", 1)]
    v = {r.term: r.tf for r in mail.field_terms(box.filter("id = 1")).collect()}
    assert v["budget"] == 6 and v["plans"] == 5 and v["numbers"] == 1
    centre = F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.5))
    other = F.create_map(F.lit("b"), F.lit(1.0))
    moved, back, set_ = spark.range(1).select(mail.moved_centroid(centre, F.lit(30), other, F.lit(10)).alias("x"), mail.moved_centroid(centre, F.lit(30), other, F.lit(10), add=False).alias("y"), mail.reweighted(centre, "a", 0.2).alias("z")).first()
    assert moved == pytest.approx({"a": 0.375, "b": 0.625}) and back == pytest.approx({"a": 1.0}) and set_ == pytest.approx({"a": 0.2, "b": 0.8})
    tasks = spark.createDataFrame([(1, "Receive", "jo@x.org", "budget numbers", "Once", "2024-01-05"), (2, "Receive", "jo@x.org", "holiday", "Once", "2024-01-05"), (3, "Receive", "jo@x.org", "budget", "Once", "2023-01-05")], "id int, type string, address string, description string, period string, date string")
    windows = mail.task_windows(tasks, "2024-01-10")
    assert rows(mail.task_status(windows, box)) == [(1, "Complete"), (2, "Incomplete"), (3, "Incomplete")]
    assert [r.id for r in mail.current_tasks(tasks, "2024-01-10").orderBy("id").collect()] == [1, 2]


def test_web_and_crawl(spark):
    html = '<html><head><title>Big Story</title><meta name="keywords" content="alpha"><style>x{}</style></head><body background="bg.png"><h1>Head</h1><a href="b.html">next <b>page</b></a><a href="mailto:x">m</a><img src="/i.gif"><script>no()</script><a href="b.html">again</a></body>'
    pages = spark.createDataFrame([(1, "http://a.org/x/p.html", html), (2, "http://a.org/x/q.html", None)], "page_id int, url string, html string")
    parsed = {r.page_id: r for r in web.parse_pages(pages).collect()}
    assert parsed[1].links == {"b.html": "next page again"} and parsed[1].text.startswith("Big Story alpha Head") and "no()" not in parsed[1].text
    assert parsed[1].weighted[16] == "Head" and parsed[1].weighted[4].startswith("Big Story") and parsed[2].text == ""
    assert [(r.url, r.anchor) for r in web.page_links(web.parse_pages(pages)).collect()] == [("a.org/x/b.html", "next page again")]
    assert rows(web.page_images(web.parse_pages(pages)).select("image")) == [("a.org/i.gif",), ("a.org/x/bg.png",)]
    links = spark.createDataFrame([("s/1", "s/2", "x"), ("s/1", "t/9", "x"), ("s/2", "s/3", "x"), ("s/3", "s/1", "x")], "page string, url string, anchor string")
    start = spark.createDataFrame([("s/1",)], "url string")
    reached = {r.url: r.level for r in crawl.crawl(start, links, 5).collect()}
    assert reached == {"s/1": 0, "s/2": 1, "t/9": 1, "s/3": 2}
    assert {r.url for r in crawl.crawl(start, links, 5, blocked=["t"]).collect()} == {"s/1", "s/2", "s/3"}


def test_relational(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(relational.upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert relational.like_pattern("a_b*", True) == "%a\\_b%%"
    tree = spark.createDataFrame([("b", "a"), ("c", "b")], "c string, p string")
    assert ("a", "c", 2) in rows(relational.closure(tree, "c", "p"))
    with pytest.raises(ValueError):
        relational.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "c string, p string"), "c", "p", most_levels=3)
    ids = [r.id for r in relational.numbered(spark.range(50).withColumn("x", -F.col("id")).drop("id"), ["x"]).orderBy("x").collect()]
    assert ids == list(range(1, 51))
    lost = spark.createDataFrame([(1, "old/f.txt", "d1"), (2, "old/g.txt", "d2")], "id int, path string, digest string")
    there = spark.createDataFrame([("new/f.txt", "d1"), ("new/g.txt", "zz")], "path string, digest string")
    assert rows(relational.repaired_paths(lost, there)) == [(1, "old/f.txt", "new/f.txt")]
    assert rows(text_stats.cluster_precision(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "c int, k string"), "c", "k")) == [(1, 3, pytest.approx(2 / 3))]
