"""Boolean full-text predicates compiled to one Column, and mark-up of the matches.

A query has words, ``"phrases"``, ``*`` wildcards, AND, OR, NOT and parentheses. Words side by
side must all occur; OR binds tighter than AND; NOT holds for the next word, phrase or group.
Words match whole and in either case unless asked otherwise; characters of a term that are no
letters or digits match any one or two characters, so that ``e_business`` finds ``e-business``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word's edge by ASCII letters, digits and underscores alone; Java's own may look beyond ASCII.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_LEXEME = re.compile(r"""\s*(?:(\()|(\))|"([^"]*)"|'([^']*)'|([^\s()"]+))""")


def _lexemes(query: str) -> list[tuple[str, str]]:
    out = []
    for m in _LEXEME.finditer(query):
        left, right, double, single, word = m.groups()
        if left or right:
            out.append(("mark", left or right))
        elif word is None:
            out.append(("term", double if double is not None else single))
        elif word.upper() in ("AND", "OR", "NOT"):
            out.append(("mark", word.upper()))
        else:
            out.append(("term", word))
    return [x for x in out if x[1]]


def term_pattern(term: str, fuzzy: bool = False) -> str:
    """The regular expression of a word or phrase."""
    body = "".join(c if c.isascii() and c.isalnum() else r"[\w-]*" if c == "*" else ".{1,2}" for c in term)
    return body if fuzzy or "*" in term else EDGE + body + EDGE


class _Reader:
    def __init__(self, lexemes: list[tuple[str, str]], leaf):
        self.rest, self.leaf = lexemes[::-1], leaf

    def next_is(self, *marks: str) -> bool:
        return bool(self.rest) and self.rest[-1][0] == "mark" and self.rest[-1][1] in marks

    def all_of(self) -> Column:
        out = self.any_of()
        while self.next_is("AND"):
            self.rest.pop()
            out = out & self.any_of()
        return out

    def any_of(self) -> Column:
        out = self.together()
        while self.next_is("OR"):
            self.rest.pop()
            out = out | self.together()
        return out

    def together(self) -> Column:
        out = self.one()
        while self.rest and not self.next_is("AND", "OR", ")"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.next_is("NOT"):
            self.rest.pop()
            return ~self.one()
        if self.next_is("("):
            self.rest.pop()
            out = self.all_of()
            if not self.next_is(")"):
                raise ValueError("unbalanced parentheses")
            self.rest.pop()
            return out
        if not self.rest or self.rest[-1][0] == "mark":
            raise ValueError("a word is missing")
        return self.leaf(self.rest.pop()[1])


def text_match(text: Column, query: str, fuzzy: bool = False, case_sensitive: bool = False) -> Column:
    """Whether the text satisfies the query: true for an empty query, false for a malformed one
    and for texts of fewer than 2 characters or null."""
    lexemes = _lexemes(query or "")
    if not lexemes:
        return F.lit(True)
    flags = "(?s)" if case_sensitive else "(?is)"
    reader = _Reader(lexemes, lambda term: text.rlike(flags + term_pattern(term, fuzzy)))
    try:
        found = reader.all_of()
        if reader.rest:
            raise ValueError("unbalanced parentheses")
    except ValueError:
        return F.lit(False)
    return F.coalesce((F.length(text) >= 2) & found, F.lit(False))


def evaluated(query: str, values: dict):
    """The query over values of its terms, which know ``&``, ``|`` and ``~``; a malformed query raises ValueError."""
    reader = _Reader(_lexemes(query), values.__getitem__)
    found = reader.all_of()
    if reader.rest:
        raise ValueError("unbalanced parentheses")
    return found


def boolean_terms(query: str | None) -> list[str] | None:
    """The distinct terms of a query as they are written, in order: none for an empty query, None for a malformed one."""
    lexemes = _lexemes(query or "")
    terms = list(dict.fromkeys(t for kind, t in lexemes if kind == "term"))
    try:
        if lexemes:
            evaluated(query, dict.fromkeys(terms, _Anything()))
    except ValueError:
        return None
    return terms


class _Anything:
    """A value for which only the form of a query matters."""

    def __and__(self, other):
        return self

    __or__ = __and__

    def __invert__(self):
        return self


def query_terms(query: str) -> list[str]:
    """Words and phrases of a query, longest first."""
    return sorted({t for kind, t in _lexemes(query or "") if kind == "term"}, key=lambda t: (-len(t), t))


def has_negation(query: str) -> bool:
    return ("mark", "NOT") in _lexemes(query or "")


def highlight(text: Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """The text with each match of a term of the query between marks, longest terms first."""
    terms = query_terms(query)
    if not terms:
        return text
    pattern = "|".join(re.sub(r"[^A-Za-z0-9]", lambda m: r"\w*" if m[0] == "*" else r"[^A-Za-z0-9]{1,2}", t) for t in terms)
    return F.regexp_replace(text, rf"(?i){EDGE}({pattern}){EDGE}", f"{before}$1{after}")
