import random
from collections import Counter

from glossmill.operators import lexicon, typed_tokens


def test_types_are_counted_as_tokens_are_typed(spark):
    rng, own = random.Random(3), typed_tokens.TokenLexicon(emoticons=("xD", ".:"))
    pieces = ["Mr", "e.g.", "a", ".", "Hello.", "B.", "x.y@z.com", " ", "1.5", ".5", "http://a.b/c.", "foo.com", "-", ":)", "'", "U.S.", "Inc.", "co", "/", "9.9.9.9", "2,000", "É", "\n", "_", "xD", ","]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for lex in (typed_tokens.TokenLexicon(), own, typed_tokens.TokenLexicon(collocations=frozenset(["a b."]))):
        assert all(typed_tokens.counted(t, lex) == Counter(kind for _, _, kind in typed_tokens.typed(t, lex)) for t in texts)
    docs = spark.createDataFrame([(1, "Mr Fox, 5"), (1, "Fox"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, typed_tokens.type_counts(docs).collect())) == [(1, "a", 1), (1, "n", 1), (1, "u", 1), (1, "x", 2)]
    assert "ArrowEvalPython" not in typed_tokens.type_counts(docs)._jdf.queryExecution().executedPlan().toString()  # no rows of tokens


def test_prefixes_do_not_meet_all_their_words(spark):
    rng = random.Random(4)
    known = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    asked = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    found = lexicon.prefix_matches(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w,) for w in known], "word string"), least=3, most=4, tries=5)
    expected = set()
    for q in asked:
        tried = {n: [w for w in known if w.startswith(q[:n])] for n in range(len(q), max(len(q) - 5, 0), -1)} if q not in known else {}
        enough = [n for n, w in tried.items() if len(w) >= 3]
        most = max((len(w) for w in tried.values()), default=0)
        n = max(enough) if enough else min((n for n, w in tried.items() if w and len(w) == most), default=None)
        expected |= {(q, w) for w in sorted(tried.get(n, []))[:4]}
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 50
    big = lexicon.prefix_matches(spark.createDataFrame([(f"a{i}x",) for i in range(2000)], "word string"), spark.createDataFrame([(f"a{i}",) for i in range(2000)], "word string"), least=3, most=4)
    plan = big._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [prefix") < plan.index("Window")  # the words of a prefix are counted before any query meets them
