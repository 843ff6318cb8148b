"""A suffix stemmer by ordered rules.

Words are lower-cased and cleared of possessives and marks at the ends; what is no run of a to z
then stays as it is. The rules of a step are tried in order, the first that fits counts; in the
derivational steps the part before the suffix must hold enough vowel groups, else nothing changes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffix and replacement, by step.
_REPAIR = [
    ("at", "ate"), ("bl", "ble"), ("iz", "ize"), ("bb", "b"), ("dd", "d"), ("ff", "f"), ("gg", "g"), ("mm", "m"), ("nn", "n"), ("pp", "p"), ("rr", "r"),
    ("tt", "t"), ("ww", "w"), ("xx", "x"),
]
_STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("iser", "ise"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("isation", "ise"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulnes", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
_STEP_4 = [
    ("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""), ("able", ""), ("ible", ""), ("ant", ""), ("ement", ""), ("ment", ""), ("ent", ""),
    ("sion", "s"), ("tion", "t"), ("ou", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""), ("ise", ""),
]
_ONE_GROUP = re.compile("[^aeiou][aeiouy]")
_TWO_GROUPS = re.compile("[^aeiou][aeiouy].*[^aeiou][aeiouy]")


_DERIVED = [(_STEP_2, _ONE_GROUP), (_STEP_3, _ONE_GROUP), (_STEP_4, _TWO_GROUPS)]


def _first(word: str, rules: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The stem and the replacement by the first rule whose suffix the word has."""
    for suffix, new in rules:
        if word.endswith(suffix):
            return word[: -len(suffix)], new
    return None


def stem_word(word: str | None) -> str | None:
    if word is None:
        return None
    w = re.sub("'s$", "", word.lower())
    w = re.sub("^[^a-z]+|[^a-z]+$", "", w)
    if not re.fullmatch("[a-z]+", w):
        return w
    if re.search("[^s]s$", w):
        cut = _first(w, [("sses", "ss"), ("ies", "i"), ("s", "")])
        w = cut[0] + cut[1]
    if w.endswith("eed") and re.search("[aeiouy][^aeiouy].*eed$", w):
        w = w[:-1]
    elif (m := re.fullmatch("(.*[aeiou].*)ed", w)) or (m := re.fullmatch("(.*[aeiouy].*)ing", w)):
        w = m[1]
        if cut := _first(w, _REPAIR):
            w = cut[0] + cut[1]
        elif re.fullmatch("[^aeiouy]+[aeiouy][^aeiouy]", w):
            w += "e"
    if re.search("[aeiouy].*y$", w):
        w = w[:-1] + "i"
    for rules, enough in _DERIVED:
        if (cut := _first(w, rules)) and enough.search(cut[0]):
            w = cut[0] + cut[1]
    if w.endswith("e") and (_TWO_GROUPS.search(w[:-1]) or (re.search("[aeiou][^aeiouy].*e", w) and not re.search("[^aeiou][aeiouy][^aeiouwxy]e$", w))):
        w = w[:-1]
    if w.endswith("ll") and _TWO_GROUPS.search(w[:-2]):
        w = w[:-1]
    return w[:-1] + "y" if len(w) > 1 and w.endswith("i") else w


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """The stem of each word; each distinct word of a batch is stemmed once."""
    known = {w: stem_word(w) for w in words.dropna().unique()}
    return words.map(known)


def stem_vocabulary(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms: Python sees the vocabulary alone, not each occurrence."""
    return terms.select(F.col(term_col).alias("term")).distinct().withColumn("stem", stem("term"))
