"""Queries of the dictionary, tag, entity and question operators, with a dictionary that the corpus gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stopwords
from ..operators import entities, lexicon, questions, tagging, vectors
from ..scratch import written
from . import corpus_lexicon
from .registry import query

_DICT = f"WITH {corpus_lexicon.SQL}, {corpus_lexicon.ASKED_SQL}"


def _tables(documents: DataFrame, conversations: DataFrame) -> dict[str, DataFrame]:
    return corpus_lexicon.dictionary(documents) | {"asked": written(corpus_lexicon.asked_words(conversations), "asked")}


def _suffix_sql() -> str:
    parts = []
    for suffix, new, pos in lexicon.SUFFIX_RULES:
        parts.append(f"SELECT word, substr(word, 1, length(word) - {len(suffix)}) || '{new}' AS base, '{pos}' AS pos FROM asked WHERE word LIKE '%{suffix}'")
    return " UNION ALL ".join(parts)


_BASES = f"""tried AS ({_suffix_sql()}), bases AS (SELECT DISTINCT word, e.base, e.pos FROM asked JOIN exceptions e USING (word)
    UNION SELECT t.word, t.base, t.pos FROM tried t WHERE EXISTS (SELECT 1 FROM words w WHERE w.word = t.base AND w.pos = t.pos))"""
#: The words of the first sense of each asked word, and of all its senses.
_SENSES = """ranked AS (SELECT a.word, w.pos, w.synset, w.tag_count, row_number() OVER (PARTITION BY a.word ORDER BY w.tag_count DESC, w.synset) AS k FROM asked a JOIN words w USING (word)),
    first_words AS (SELECT DISTINCT r.word, s.word AS other FROM ranked r JOIN synsets s USING (synset) WHERE k = 1),
    all_words AS (SELECT DISTINCT r.word, s.word AS other FROM ranked r JOIN synsets s USING (synset))"""


@query(f"{_DICT}, {_BASES} SELECT word, base, pos FROM bases")
def lexicon_base_words(documents, conversations):
    t = _tables(documents, conversations)
    return lexicon.base_words(t["asked"], t["words"], t["exceptions"])


@query(f"{_DICT}, {_BASES} SELECT word, CASE WHEN word IN (SELECT word FROM words) THEN 1 WHEN word IN (SELECT word FROM bases) THEN 2 ELSE 0 END AS found FROM asked")
def lexicon_membership(documents, conversations):
    t = _tables(documents, conversations)
    return lexicon.membership(t["asked"], t["words"], t["exceptions"])


@query(f"{_DICT} SELECT word, string_agg(DISTINCT pos, '' ORDER BY pos) AS tags FROM words GROUP BY word")
def lexicon_word_tags(documents):
    return lexicon.word_pos(corpus_lexicon.dictionary(documents)["words"])


@query(f"{_DICT} SELECT word, coalesce((SELECT bool_or(is_entity) FROM words w WHERE w.word = a.word), true) AS is_entity FROM asked a")
def lexicon_name_flags(documents, conversations):
    t = _tables(documents, conversations)
    return lexicon.entity_flag(t["asked"], t["words"])


@query(f"{_DICT}, {_SENSES} SELECT word, other FROM first_words")
def lexicon_synset_words(documents, conversations):
    t = _tables(documents, conversations)
    return lexicon.synset_words(t["asked"], t["words"], t["synsets"])


@query(
    f"""{_DICT}, {_BASES}, {_SENSES}, one AS (SELECT * FROM first_words WHERE NOT contains(other, word)),
    b AS (SELECT DISTINCT bases.word, s.word AS other FROM bases JOIN (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tag_count DESC, synset) AS k FROM words) w ON w.word = bases.base AND w.k = 1
        JOIN synsets s ON s.synset = w.synset WHERE bases.word NOT IN (SELECT word FROM one) AND NOT contains(s.word, bases.word)),
    three AS (SELECT * FROM all_words WHERE NOT contains(other, word) AND word NOT IN (SELECT word FROM one) AND word NOT IN (SELECT word FROM b))
    SELECT word, other FROM one UNION ALL SELECT word, other FROM b UNION ALL SELECT word, other FROM three"""
)
def lexicon_synonyms(documents, conversations):
    t = _tables(documents, conversations)
    return lexicon.similar_words(t["asked"], t["words"], t["synsets"], t["exceptions"])


@query(
    f"""{_DICT} SELECT DISTINCT 'hypernym' AS relation, a.word, s.word AS other FROM asked a JOIN words w USING (word) JOIN relations r ON r.relation = 'hypernym' AND r.source = w.synset JOIN synsets s ON s.synset = r.target
    UNION ALL SELECT DISTINCT 'antonym', a.word, r.target FROM asked a JOIN relations r ON r.relation = 'antonym' AND r.source = a.word"""
)
def lexicon_related_words(documents, conversations):
    t = _tables(documents, conversations)
    parts = [
        lexicon.related_words(t["asked"], name, t["words"], t["synsets"], t["relations"]).select(F.lit(name).alias("relation"), "word", "other")
        for name in ("hypernym", "antonym", "no such relation")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    f"""{_DICT}, w AS (SELECT DISTINCT word FROM words), u AS (SELECT word FROM asked WHERE word NOT IN (SELECT word FROM w)),
    p AS (SELECT word, n, substr(word, 1, n) AS prefix FROM (SELECT word, unnest(range(1, length(word) + 1)) AS n FROM w)), held AS (SELECT prefix, count(*) AS hits FROM p GROUP BY prefix),
    c AS (SELECT query, n, prefix, hits FROM (SELECT word AS query, n, substr(word, 1, n) AS prefix FROM (SELECT word, unnest(range(1, length(word) + 1)) AS n FROM u) WHERE n > length(word) - 10) JOIN held USING (prefix)),
    best AS (SELECT query, CASE WHEN max(n) FILTER (hits >= 3) IS NOT NULL THEN max(n) FILTER (hits >= 3) ELSE min(n) FILTER (hits = m) END AS n
        FROM (SELECT *, max(hits) OVER (PARTITION BY query) AS m FROM c) GROUP BY query),
    r AS (SELECT query, p.word FROM best JOIN p ON p.prefix = substr(query, 1, best.n)),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY word) AS k FROM r) SELECT query, word FROM k WHERE k <= 4"""
)
def lexicon_prefix_matches(documents, conversations):
    t = _tables(documents, conversations)
    return lexicon.prefix_matches(t["asked"], t["words"], least=3, most=4)


#: Words of first turns that have several senses, and the words of the turn.
_SCORES = f"""first_ AS (SELECT conv_id, lower(unnest(regexp_extract_all(text, '{corpus_lexicon.WORD}'))) AS word FROM conversations WHERE turn = 0),
    several AS (SELECT word FROM words GROUP BY word HAVING count(*) > 1),
    targets AS (SELECT DISTINCT conv_id || ':' || word AS target, conv_id, word FROM first_ JOIN several USING (word)),
    contexts AS (SELECT DISTINCT target, f.word AS term FROM targets t JOIN first_ f ON f.conv_id = t.conv_id AND f.word <> t.word),
    prior AS (SELECT target, synset, log2(tag_count / sum(tag_count) OVER (PARTITION BY target)) AS prior FROM targets JOIN words USING (word)),
    scores AS (SELECT p.target, p.synset, any_value(prior) + sum(CASE WHEN c.term IS NULL THEN 0.0 ELSE coalesce(log2(s.p), -100.0) END) AS score
        FROM prior p LEFT JOIN contexts c USING (target) LEFT JOIN signatures s ON s.synset = p.synset AND s.term = c.term GROUP BY ALL)"""


def _sense_scores(documents: DataFrame, conversations: DataFrame) -> DataFrame:
    t = corpus_lexicon.dictionary(documents)
    first = corpus_lexicon.words_with_previous(conversations.filter("turn = 0"), "conv_id").select("conv_id", F.lower("token").alias("word")).distinct()
    several = t["words"].groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word")
    targets = first.join(several, "word").select("conv_id", "word", F.concat_ws(":", "conv_id", "word").alias("target"))
    contexts = targets.join(first.withColumnRenamed("word", "term"), "conv_id").filter("term <> word").select("target", "term")
    return lexicon.sense_scores(targets.select("target", "word"), contexts, t["words"], t["signatures"])


@query(f"{_DICT}, {_SCORES} SELECT target, synset, round(score, 4) AS score FROM scores")
def sense_scores(documents, conversations):
    return _sense_scores(documents, conversations).withColumn("score", F.round("score", 4))


@query(f"{_DICT}, {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 6) DESC, synset) AS k FROM scores) SELECT target, synset FROM r WHERE k = 1")
def best_senses(documents, conversations):
    return lexicon.best_senses(_sense_scores(documents, conversations).withColumn("score", F.round("score", 6)))


#: Entries of two words: a capital, and a word that follows it often.
_PHRASES = f"""entries AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM cut)),
    phrases AS (SELECT lower(a) || '_' || lower(b) AS word FROM entries WHERE regexp_matches(a, '^[A-ZÀ-Þ]') GROUP BY 1 HAVING count(*) >= {corpus_lexicon.LEAST})"""


def _phrases(documents: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(corpus_lexicon.WORD), F.lit(0))
    pairs = documents.select(found.alias("w")).select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("a"), F.get("w", i + 1).alias("b")))).alias("p")).select("p.*")
    rows = pairs.filter(F.col("b").isNotNull() & F.col("a").rlike("^[A-ZÀ-Þ]")).groupBy(F.concat_ws("_", F.lower("a"), F.lower("b")).alias("word")).agg(F.count("*").alias("n"))
    return rows.filter(F.col("n") >= corpus_lexicon.LEAST).select("word")


@query(
    f"""{_DICT}, {_PHRASES} SELECT split_part(word, '_', 1) AS lead, replace(word, '_', ' ') AS phrase, CAST(len(string_split(word, '_')) AS BIGINT) AS n_tokens
    FROM phrases WHERE word NOT LIKE 'the\\_%' ESCAPE '\\' AND word NOT LIKE '%\\_the' ESCAPE '\\' AND word NOT LIKE 'la\\_%' ESCAPE '\\' AND word NOT LIKE '%\\_la' ESCAPE '\\'"""
)
def collocation_table(documents):
    return lexicon.collocations(_phrases(documents), skip=("the", "la")).withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query(f"{_DICT} SELECT word, pos, min(base) AS base FROM (SELECT a.word, b.word AS base, 'v' AS pos FROM asked a JOIN words b ON a.word IN (b.word || 'en', b.word || 'e', b.word || 'er')) GROUP BY ALL")
def single_exceptions(documents, conversations):
    t = _tables(documents, conversations)
    ends = F.array(*(F.when(F.col("word").endswith(e), F.substring("word", F.lit(1), F.length("word") - len(e))) for e in ("en", "e", "er")))
    bases = t["asked"].select("word", F.explode(F.array_compact(ends)).alias("base")).join(t["words"].select(F.col("word").alias("base")).distinct(), "base")
    return lexicon.single_exceptions(bases.select("word", "base", F.lit("v").alias("pos")))


# --- tags and entities over conversations

_TOKEN = "([A-Za-z0-9]+|[^A-Za-z0-9\\s])"
_TOKENS = r"""toks AS (SELECT conv_id || '/' || turn AS doc_id, 0 AS sent, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]') AS t FROM conversations),
    tk AS (SELECT doc_id, sent, i - 1 AS pos, t[i] AS token FROM (SELECT doc_id, sent, t, unnest(range(1, len(t) + 1)) AS i FROM toks))"""
#: word, tag, count: the tags of some words of the tables' languages.
_TAGS = [
    ("the", "d", 90), ("that", "d", 30), ("that", "c", 20), ("of", "i", 80), ("und", "c", 70), ("que", "c", 60), ("in", "i", 50), ("in", "r", 5), ("de", "i", 40),
    ("tion", "n", 9), ("ment", "n", 7), ("ment", "v", 7), ("ing", "v", 8), ("ing", "n", 4), ("hello", "u", 3), ("help", "v", 5), ("help", "n", 4), ("thanks", "n", 2),
]
_TAG_SQL = "tags(word, tag, n) AS (VALUES " + ", ".join(f"('{w}', '{t}', {n})" for w, t, n in _TAGS) + ")"


def _conversation_tokens(conversations: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(_TOKEN), 1)
    return conversations.select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), F.lit(0).alias("sent"), F.posexplode(found).alias("pos", "token"))


@query(
    f"""WITH {_TOKENS}, {_TAG_SQL}, one AS (SELECT doc_id, sent, pos, token, CASE WHEN NOT regexp_matches(token, '[A-Za-z0-9]') THEN 'u' WHEN regexp_matches(token, '^[+-]?[0-9][0-9.,]*%?$') THEN 'a'
            WHEN NOT EXISTS (SELECT 1 FROM tags WHERE word = lower(token)) THEN 'n' END AS only_ FROM tk),
    k AS (SELECT doc_id, sent, pos, only_ AS tag, 1 AS n FROM one WHERE only_ IS NOT NULL UNION ALL
        SELECT doc_id, sent, pos, tag, n + CASE WHEN tag = 'n' AND pos > 0 AND regexp_matches(token, '^[A-Z]') THEN 25 ELSE 0 END FROM one JOIN tags ON word = lower(token) WHERE only_ IS NULL)
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, string_agg(tag || ':' || n, ' ' ORDER BY n DESC, tag) AS candidates FROM k GROUP BY doc_id, sent, pos"""
)
def tag_candidates(conversations):
    lexicon_ = conversations.sparkSession.createDataFrame(_TAGS, "word string, tag string, n long")
    found = tagging.candidate_tags(_conversation_tokens(conversations), lexicon_)
    listed = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["tag"], c["n"].cast("string"))), " ")
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), listed.alias("candidates"))


_GAZETTEER = [("hello", "person"), ("help", "org"), ("help", "place_town"), ("que", "place"), ("and", "person"), ("der", "org"), ("les", "place"), ("the", "org")]
_NAMES = "names(name, type) AS (VALUES " + ", ".join(f"('{n}', '{t.split('_')[0]}')" for n, t in _GAZETTEER) + ")"
_SEEDED = f"""{_TOKENS}, {_NAMES}, g AS (SELECT doc_id, sent, pos, token, list_sort(list(DISTINCT type)) AS types FROM tk JOIN names ON name = lower(token)
        WHERE regexp_matches(token, '^[A-Z]') OR type = 'person' GROUP BY ALL),
    seeded AS (SELECT tk.doc_id, tk.sent, tk.pos, tk.token, CASE WHEN g.types IS NOT NULL THEN g.types WHEN regexp_matches(tk.token, '^[0-9][0-9.,]*$') THEN ['number']
        WHEN regexp_matches(tk.token, '^[A-Z]') AND length(tk.token) > 1 AND lower(tk.token) NOT IN ({", ".join(f"'{w}'" for w in stopwords())}) THEN ['miscellaneous'] ELSE [] END AS types
        FROM tk LEFT JOIN g USING (doc_id, sent, pos))"""


def _gazetteer(frame: DataFrame) -> DataFrame:
    return frame.sparkSession.createDataFrame(_GAZETTEER, "name string, type string")


@query(f"WITH {_SEEDED} SELECT doc_id, CAST(pos AS BIGINT) AS pos, token, array_to_string(types, ' ') AS types FROM seeded WHERE len(types) > 0")
def entity_seeds(conversations):
    found = entities.seeded(_conversation_tokens(conversations), _gazetteer(conversations)).filter(F.size("types") > 0)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", F.array_join("types", " ").alias("types"))


@query(
    f"""WITH {_SEEDED}, x AS (SELECT *, lower(lag(token) OVER o) AS b, lower(lead(token) OVER o) AS a FROM seeded WINDOW o AS (PARTITION BY doc_id, sent ORDER BY pos)),
    f AS (SELECT types[1] AS type, list_distinct(list_concat(['in_' || t FOR t IN types], list_filter([
        CASE WHEN NOT regexp_matches(token, '[^A-Z]') THEN 'all_up' END, CASE WHEN regexp_matches(token, '^[A-Z]') THEN 'start_up' END, CASE WHEN b IS NULL THEN 'sentence_start' END,
        CASE WHEN a IS NULL OR a IN ('.', '?', '!') THEN 'sentence_end' END,
        CASE WHEN regexp_matches(a, '^[0-9]') THEN 'atag_number' WHEN regexp_matches(a, '^[^a-z0-9]$') THEN 'atag_u' WHEN regexp_matches(a, '^[a-z]') THEN 'aword_' || a END,
        CASE WHEN regexp_matches(b, '^[0-9]') THEN 'btag_number' WHEN regexp_matches(b, '^[^a-z0-9]$') THEN 'btag_u' WHEN regexp_matches(b, '^[a-z]') THEN 'bword_' || b END
    ], lambda v: v IS NOT NULL))) AS features FROM x WHERE len(types) = 1),
    n AS (SELECT type, count(*) AS n FROM f GROUP BY type), t AS (SELECT count(*) AS total FROM f),
    c AS (SELECT type, unnest(features) AS feature FROM f)
    SELECT feature, c.type, round(count(*) / any_value(n) * any_value(n) / any_value(total), 6) AS value FROM c JOIN n USING (type), t GROUP BY feature, c.type"""
)
def entity_rules(conversations):
    typed = entities.features(entities.seeded(_conversation_tokens(conversations), _gazetteer(conversations))).filter(F.size("types") == 1)
    return entities.likelihood_rules(typed.withColumn("type", F.element_at("types", 1))).withColumn("value", F.round("value", 6))


_CUSTOMERS = "SELECT lower(c_mktsegment) AS name, 'org' AS type FROM customer UNION SELECT lower(n_name), 'place' FROM nation UNION SELECT lower(r_name), 'place_region' FROM region"


@query(
    f"""WITH g AS ({_CUSTOMERS}), fixed AS (SELECT lower(n_name) || ' ' || lower(r_name) AS name, 'place_nation' AS type FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'building', 'tech'),
    parts AS (SELECT unnest(string_split(name, ' ')) AS name, 'part_' || type AS type FROM fixed WHERE contains(name, ' '))
    SELECT DISTINCT name, type FROM (SELECT * FROM g WHERE name NOT IN (SELECT name FROM fixed) UNION ALL SELECT * FROM fixed UNION ALL SELECT * FROM parts WHERE name <> '')"""
)
def gazetteer_corrections(customer, nation, region):
    known = customer.select(F.lower("c_mktsegment").alias("name"), F.lit("org").alias("type")).union(nation.select(F.lower("n_name"), F.lit("place"))).union(region.select(F.lower("r_name"), F.lit("place_region"))).distinct()
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.initcap(F.concat_ws(" ", "n_name", "r_name")).alias("name"), F.lit("place_nation").alias("type"))
    return entities.with_corrections(known, named.union(named.sparkSession.createDataFrame([("Building", "tech")], "name string, type string")))


# --- questions

def _seeds(conversations: DataFrame, words: DataFrame) -> DataFrame:
    """The first two nouns of each conversation."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(corpus_lexicon.WORD), F.lit(0))
    tokens = conversations.filter("turn = 0").select(F.col("conv_id").alias("query_id"), F.posexplode(found).alias("pos", "token"))
    return questions.noun_weights(tokens, words.filter("pos = 'n'").select("word").distinct())


def _neighbours(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(word, other) of synonyms, and of words and those of the synset above theirs."""
    named = t["synsets"].select("synset", "word")
    synonyms = named.join(named.withColumnRenamed("word", "other"), "synset").filter("word != other").select("word", "other").distinct()
    above = named.join(t["relations"].filter("relation = 'hypernym'"), F.col("synset") == F.col("source")).select("word", "target")
    return synonyms, above.join(named.select(F.col("synset").alias("target"), F.col("word").alias("other")), "target").select("word", "other").distinct()


#: The first two nouns of each conversation.
_SEEDS = f"""nouns AS (SELECT DISTINCT word FROM words WHERE pos = 'n'),
    turns AS (SELECT conv_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, regexp_extract_all(lower(text), '{corpus_lexicon.WORD}') AS w FROM conversations WHERE turn = 0)),
    seeds AS (SELECT query_id, word, CASE k WHEN 1 THEN 256.0 ELSE 128.0 END AS weight FROM (
        SELECT conv_id AS query_id, w[i] AS word, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k FROM turns WHERE w[i] IN (SELECT word FROM nouns)) WHERE k <= 2)"""


@query(
    f"""{_DICT}, {_SEEDS},
    syn AS (SELECT DISTINCT a.word, b.word AS other FROM synsets a JOIN synsets b USING (synset) WHERE a.word != b.word),
    hyp AS (SELECT DISTINCT a.word, b.word AS other FROM synsets a JOIN relations r ON r.relation = 'hypernym' AND r.source = a.synset JOIN synsets b ON b.synset = r.target),
    near_ AS (SELECT query_id, other AS word FROM seeds JOIN syn USING (word)),
    far_ AS (SELECT query_id, hyp.other AS word FROM (SELECT query_id, word FROM seeds UNION ALL SELECT * FROM near_) JOIN hyp USING (word)),
    every AS (SELECT query_id, word, weight, 0 AS k FROM seeds UNION ALL SELECT query_id, word, 64.0, 1 FROM near_ UNION ALL SELECT query_id, word, 8.0, 2 FROM far_),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, word ORDER BY k, weight DESC) AS o FROM every) SELECT CAST(query_id AS BIGINT) AS query_id, word, CAST(weight AS DOUBLE) AS weight FROM r WHERE o = 1"""
)
def neighbour_weights(documents, conversations):
    t = corpus_lexicon.dictionary(documents)
    return questions.neighbour_weights(_seeds(conversations, t["words"]), *_neighbours(t))


@query(
    f"""{_DICT}, {_SEEDS}, one AS (SELECT query_id || ':' || word AS seed, query_id, word, weight FROM seeds),
    syn AS (SELECT DISTINCT a.word, b.word AS other FROM synsets a JOIN synsets b USING (synset) WHERE a.word != b.word),
    hyp AS (SELECT DISTINCT a.word, b.word AS other FROM synsets a JOIN relations r ON r.relation = 'hypernym' AND r.source = a.synset JOIN synsets b ON b.synset = r.target),
    near_ AS (SELECT seed, query_id, other AS word FROM one JOIN syn USING (word)),
    far_ AS (SELECT seed, query_id, hyp.other AS word FROM (SELECT seed, query_id, word FROM one UNION ALL SELECT * FROM near_) JOIN hyp USING (word)),
    every AS (SELECT seed, query_id, word, weight, 0 AS k FROM one UNION ALL SELECT seed, query_id, word, 64.0, 1 FROM near_ UNION ALL SELECT seed, query_id, word, 8.0, 2 FROM far_),
    r AS (SELECT *, row_number() OVER (PARTITION BY seed, word ORDER BY k, weight DESC) AS o FROM every)
    SELECT CAST(query_id AS BIGINT) AS query_id, word, CAST(sum(weight) AS DOUBLE) AS weight FROM r WHERE o = 1 GROUP BY query_id, word"""
)
def expanded_questions(documents, conversations):
    """The weights that both nouns of a conversation, each by itself, give to words, summed."""
    t = corpus_lexicon.dictionary(documents)
    seeds = _seeds(conversations, t["words"]).groupBy("query_id", "word").agg(F.max("weight").alias("weight"))
    named = seeds.select(F.concat_ws(":", "query_id", "word").alias("query_id"), "word", "weight", F.col("query_id").alias("of"))
    found = questions.neighbour_weights(named.drop("of"), *_neighbours(t)).join(named.select("query_id", "of"), "query_id")
    return questions.expanded_query(found.select(F.col("of").alias("query_id"), "word", "weight"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations),
    t AS (SELECT conv_id || '/' || turn AS query_id, i AS pos, w[i] AS word FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] IN ('help', 'the', 'que', 'und', 'tion')),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM t) SELECT query_id, word, CASE k WHEN 1 THEN 256.0 ELSE 128.0 END::DOUBLE AS weight FROM r WHERE k <= 2"""
)
def question_nouns(conversations):
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    tokens = conversations.select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.posexplode(found).alias("pos", "token"))
    nouns = conversations.sparkSession.createDataFrame([(w,) for w in ("help", "the", "que", "und", "tion")], "word string")
    return questions.noun_weights(tokens, nouns)


@query(
    """WITH l AS (SELECT conv_id * 1000 + turn AS line_no, CASE WHEN turn % 5 != 0 THEN conv_id + turn % 2 * 100000 END AS number,
        CASE turn % 4 WHEN 0 THEN text || '###person' WHEN 1 THEN text || '###place' WHEN 2 THEN text || '###nonsense' ELSE text END AS answer FROM conversations),
    c AS (SELECT *, count(*) OVER (PARTITION BY number) AS n FROM l)
    SELECT line_no, CASE WHEN number IS NULL THEN 'no number' WHEN n > 1 THEN 'repeated number' WHEN NOT coalesce(contains(answer, '###'), false) THEN 'no answer type' ELSE 'unknown answer type' END AS problem
    FROM c WHERE number IS NULL OR n > 1 OR NOT coalesce(contains(answer, '###'), false) OR string_split(answer, '###')[-1] NOT IN ('person', 'place')"""
)
def question_file_check(conversations):
    ending = F.element_at(F.array(F.lit("###person"), F.lit("###place"), F.lit("###nonsense"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    lines = conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.when(F.col("turn") % 5 != 0, F.col("conv_id") + F.col("turn") % 2 * 100000).alias("number"), F.lit("?").alias("question"), F.concat("text", ending).alias("answer")
    )
    return questions.checked_questions(lines, ["person", "place"])


@query(
    """WITH v AS (SELECT vec_id, embedding[1:5] AS s, (label % 2 = 0) AS l FROM embeddings), w AS (SELECT list_transform(range(34), lambda i: (i % 7 - 3) / 4.0) AS w),
    h AS (SELECT vec_id, list_transform(range(4), lambda h: 1 / (1 + exp(-(w[h * 6 + 1] + list_sum(list_transform(range(5), lambda i: s[i + 1]::DOUBLE * w[h * 6 + 2 + i])))))) AS h, w FROM v, w),
    o AS (SELECT vec_id, list_transform(range(2), lambda o: 1 / (1 + exp(-(w[25 + o * 5] + list_sum(list_transform(range(4), lambda i: h[i + 1] * w[26 + o * 5 + i])))))) AS o FROM h)
    SELECT vec_id, round(o[1], 6) AS yes, round(o[2], 6) AS no FROM o"""
)
def answer_network(embeddings):
    weights = F.transform(F.sequence(F.lit(0), F.lit(33)), lambda i: (i % 7 - 3) / 4.0)
    yes, no = questions.network_outputs([F.element_at("embedding", i + 1).cast("double") for i in range(5)], weights)
    return embeddings.select("vec_id", F.round(yes, 6).alias("yes"), F.round(no, 6).alias("no"))


_TRAIN = r"""rows_ AS (SELECT item_id AS question_id, CASE WHEN regexp_matches(lower(text), '\bthe\b') THEN 'the' ELSE 'other' END AS category,
    unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM benchmark)"""


@query(
    f"""WITH {_TRAIN}, ok AS (SELECT category FROM rows_ GROUP BY 1 HAVING count(DISTINCT question_id) >= 3),
    c AS (SELECT category, term, count(*) AS n FROM rows_ JOIN ok USING (category) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, term) AS k FROM c)
    SELECT category, 'word' AS kind, term, round(n / sum(n) OVER (PARTITION BY category), 5) AS weight FROM r WHERE k <= 50"""
)
def question_profiles(benchmark):
    category = F.when(F.lower("text").rlike(r"\bthe\b"), "the").otherwise("other")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)
    rows = benchmark.select(F.col("item_id").alias("question_id"), category.alias("category"), F.lit("word").alias("kind"), F.explode(words).alias("term"))
    return questions.category_profile(rows, least=3, most=50)


@query(
    f"""{_DICT}, tf AS (SELECT conv_id AS doc_id, w.word AS term, count(*)::DOUBLE AS tf FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) c
        JOIN (SELECT DISTINCT word FROM words) w USING (word) GROUP BY ALL),
    v AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) AS w FROM tf), syn(term, synonym) AS (VALUES ('the', 'le'), ('the', 'der'), ('und', 'and'), ('que', 'that')),
    e AS (SELECT doc_id, term, sum(w) AS w FROM (SELECT * FROM v UNION ALL SELECT doc_id, synonym, w FROM v JOIN syn USING (term)) GROUP BY ALL)
    SELECT doc_id, term, round(w / sum(w) OVER (PARTITION BY doc_id), 6) AS weight FROM e"""
)
def expanded_vectors(spark, documents, conversations):
    known = corpus_lexicon.dictionary(documents)["words"].select("word").distinct()
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    rows = conversations.select(F.col("conv_id").alias("doc_id"), F.explode(words).alias("word")).join(known, "word")
    tf = rows.groupBy("doc_id", F.col("word").alias("term")).agg(F.count("*").alias("tf"))
    synonyms = spark.createDataFrame([("the", "le"), ("the", "der"), ("und", "and"), ("que", "that")], "term string, synonym string")
    return vectors.expanded(vectors.frequency_vectors(tf), synonyms).select("doc_id", "term", F.round("weight", 6).alias("weight"))
