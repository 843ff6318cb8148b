"""A small dictionary of our own, for queries and tests of the lexicon operators.

The library ships no dictionary; users bring theirs in the same form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: word, part of speech, synset, tag count, whether it is a name.
WORDS = [
    ("dog", "n", "n1", 40, False), ("hound", "n", "n1", 3, False), ("watch_dog", "n", "n1", 1, False), ("dog", "v", "v1", 2, False),
    ("chase", "v", "v1", 9, False), ("pursue", "v", "v1", 7, False), ("chase", "n", "n6", 4, False), ("pursuit", "n", "n6", 3, False),
    ("canine", "n", "n2", 5, False), ("animal", "n", "n3", 60, False), ("beast", "n", "n3", 4, False), ("cat", "n", "n4", 30, False),
    ("feline", "n", "n5", 4, False), ("box", "n", "n7", 11, False), ("box", "v", "v2", 3, False), ("church", "n", "n8", 9, False),
    ("fish", "n", "n9", 14, False), ("fish", "v", "v3", 5, False), ("man", "n", "n10", 90, False), ("city", "n", "n11", 33, False),
    ("town", "n", "n11", 21, False), ("run", "v", "v4", 50, False), ("run", "n", "n12", 12, False), ("race", "n", "n12", 10, False),
    ("hot", "a", "a1", 25, False), ("warm", "a", "a2", 12, False), ("cold", "a", "a3", 20, False), ("cool", "a", "a4", 8, False),
    ("big", "a", "a5", 44, False), ("large", "a", "a5", 30, False), ("wide", "a", "a6", 6, False), ("goose", "n", "n13", 4, False),
    ("lisbon", "n", "n14", 3, True), ("ada", "n", "n15", 2, True), ("genus_felis", "n", "n5", 1, False), ("hot_dog", "n", "n16", 2, False),
    ("fire_dog", "n", "n17", 1, False), ("in", "p", "p1", 400, False), ("and", "c", "c1", 900, False), ("the", "d", "d1", 999, False),
]
GLOSSES = {"n1": "a tame animal that barks", "n3": "a living thing that moves", "n4": "a tame animal that purrs", "v1": "go after", "a5": "of great size"}
#: relation, source, target: synsets, or words for relations of words.
RELATIONS = [
    ("hypernym", "n1", "n2"), ("hypernym", "n2", "n3"), ("hypernym", "n4", "n5"), ("hypernym", "n5", "n3"), ("hyponym", "n3", "n2"), ("hyponym", "n3", "n5"),
    ("similar_to", "a1", "a2"), ("similar_to", "a3", "a4"), ("antonym", "hot", "cold"), ("antonym", "cold", "hot"), ("also_see", "big", "wide"),
]
#: word, base, part of speech.
EXCEPTIONS = [("geese", "goose", "n"), ("ran", "run", "v"), ("men", "man", "n"), ("men", "men", "n")]
ASKED = ["Dogs", "hounds", "boxes", "churches", "fishes", "men", "cities", "chased", "pursuing", "chasing", "hotter", "widest", "bigger", "geese", "ran", "dog", "hot dog", "large", "lisbon", "unheardof", "ho", "ca", "Town", "cat", "hot", "big", "beast"]
#: word to be resolved in a context, and the chance of terms in a sense.
CONTEXTS = [("t1", "dog", ["barks", "tame"]), ("t2", "dog", ["after", "thief"]), ("t3", "run", ["hill"]), ("t4", "cat", [])]
SENSE_TERMS = [("n1", "barks", 0.25), ("n1", "tame", 0.25), ("v1", "after", 0.5), ("v1", "thief", 0.125), ("n12", "hill", 0.5), ("v4", "hill", 0.25)]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """words, synsets, relations, exceptions and asked, as the lexicon operators take them."""
    return {
        "words": spark.createDataFrame(WORDS, "word string, pos string, synset string, tag_count long, is_entity boolean"),
        "synsets": spark.createDataFrame([(s, w, GLOSSES.get(s)) for w, _, s, _, _ in WORDS], "synset string, word string, gloss string"),
        "relations": spark.createDataFrame(RELATIONS, "relation string, source string, target string"),
        "exceptions": spark.createDataFrame(EXCEPTIONS, "word string, base string, pos string"),
        "asked": spark.createDataFrame([(w,) for w in ASKED], "word string"),
        "targets": spark.createDataFrame([(t, w) for t, w, _ in CONTEXTS], "target string, word string"),
        "contexts": spark.createDataFrame([(t, c) for t, _, cs in CONTEXTS for c in cs], "target string, term string"),
        "signatures": spark.createDataFrame(SENSE_TERMS, "synset string, term string, p double"),
    }


def values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


def sql_tables() -> str:
    """The same tables as common table expressions."""
    return ", ".join(
        f"{name} AS (SELECT * FROM {values(rows)})"
        for name, rows in {
            "words(word, pos, synset, tag_count, is_entity)": WORDS,
            "synsets(synset, word, gloss)": [(s, w, GLOSSES.get(s)) for w, _, s, _, _ in WORDS],
            "relations(relation, source, target)": RELATIONS,
            "exceptions(word, base, pos)": EXCEPTIONS,
            "asked(word)": sorted({(w.lower().replace(" ", "_"),) for w in ASKED}),
            "targets(target, word)": [(t, w) for t, w, _ in CONTEXTS],
            "contexts(target, term)": [(t, c) for t, _, cs in CONTEXTS for c in cs],
            "signatures(synset, term, p)": SENSE_TERMS,
        }.items()
    )
