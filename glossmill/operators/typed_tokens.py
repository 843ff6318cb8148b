"""Tokens with types: words, abbreviations, numbers, internet names, emoticons, joined words, collocations.

Types are x word, a abbreviation, b joined word, c collocation, e emoticon, i internet name,
n number, u mark. The lexicon is a parameter; its tables go to the tasks with the function.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stopwords

SCHEMA = "array<struct<token:string,end:int,type:string>>"


@dataclass(frozen=True)
class TokenLexicon:
    """What the typing pass knows: lower-case abbreviations, country codes, emoticons, collocations."""

    abbreviations: frozenset[str] = frozenset("mr mrs ms dr prof jr sr inc ltd co corp etc u.s e.g i.e".split())
    domains: frozenset[str] = frozenset("com org net edu gov mil int info de fr es uk us".split())
    emoticons: tuple[str, ...] = (":-)", ":-(", ":)", ":(", ";-)", ";)")
    collocations: frozenset[str] = field(default_factory=frozenset)


def _pattern(lexicon: TokenLexicon) -> re.Pattern[str]:
    faces = "|".join(re.escape(e) for e in sorted(lexicon.emoticons, key=len, reverse=True)) or r"(?!)"
    domains = "|".join(sorted(lexicon.domains)) or r"(?!)"
    return re.compile(
        rf"(?P<i>[a-zA-Z]+://\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])|(?:[\w-]+\.)+(?i:{domains})\b)"
        rf"|(?P<e>{faces})"
        r"|(?P<n>(?<![\w.])[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?%?(?![A-Za-z0-9])|(?<![\w])\.\d+)"
        r"|(?P<d>(?:[A-Za-z]+\.){2,}|[A-Z]\.(?=\s)|[A-Za-z]+\.)"
        r"|(?P<b>[A-Za-z0-9]+(?:['/+&_-][A-Za-z0-9]+)+)"
        r"|(?P<x>[A-Za-z0-9]+)|(?P<u>[^\sA-Za-z0-9])",
        re.ASCII,
    )


def typed(text: str | None, lexicon: TokenLexicon = TokenLexicon(), pattern: re.Pattern[str] | None = None) -> list[tuple[str, int, str]]:
    """(token, index of its last character, type) of a text; none of a null text."""
    out: list[tuple[str, int, str]] = []
    flat = re.sub(r"[^\x20-\x7a]", " ", text or "")
    scan, at = pattern or _pattern(lexicon), 0
    while m := scan.search(flat, at):
        kind, token = m.lastgroup, m[0]
        if kind == "d":
            known = token.rstrip(".").lower() in lexicon.abbreviations
            if not (known or token.count(".") > 1 or len(token) == 2 and token[0].isupper()):
                token, kind = token[:-1], "x"
            else:
                kind = "a"
        elif kind == "x" and token[0].isupper() and token.lower() in lexicon.abbreviations:
            kind = "a"
        at = m.start() + len(token)
        out.append((token, at - 1, kind))
    return _joined(out, lexicon) if lexicon.collocations else out


def _joined(tokens: list[tuple[str, int, str]], lexicon: TokenLexicon) -> list[tuple[str, int, str]]:
    """Runs of words that are a collocation as one token, the longest first."""
    longest = max(len(c.split()) for c in lexicon.collocations)
    out, i = [], 0
    while i < len(tokens):
        for n in range(min(longest, len(tokens) - i), 1, -1):
            run = " ".join(t for t, _, _ in tokens[i : i + n])
            if run.lower() in lexicon.collocations and not (run[0].islower() and re.search(" [A-Z]", run)):
                out.append((run, tokens[i + n - 1][1], "c"))
                i += n
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def assemble(text: Column, lexicon: TokenLexicon = TokenLexicon()) -> Column:
    """array<struct<token,end,type>> of each text."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.Series:
        pattern = _pattern(lexicon)
        return pd.Series([[{"token": a, "end": b, "type": c} for a, b, c in typed(t, lexicon, pattern)] for t in texts])

    return run(text)


def _counting_pattern(lexicon: TokenLexicon) -> re.Pattern[str] | None:
    """The pattern with plain words before blanks and like marks first, which no other kind can begin; None for lexicons
    of which that is not so."""
    if lexicon.collocations or any(re.match("[A-Za-z.]", e) for e in lexicon.emoticons):
        return None
    return re.compile(r"(?P<w>[A-Za-z]++(?=[ ,;!?()]|\Z))|" + _pattern(lexicon).pattern, re.ASCII)


def counted(text: str | None, lexicon: TokenLexicon = TokenLexicon(), pattern: re.Pattern[str] | None = None) -> Counter[str]:
    """How many tokens of each type ``typed`` finds, without the tokens. A word that ends in a mark that is not its own is
    a word and that mark, since nothing else of the pattern begins with a mark after a letter."""
    pattern = pattern or _counting_pattern(lexicon)
    if pattern is None:
        return Counter(t[2] for t in typed(text, lexicon))
    kinds: Counter[str] = Counter()
    for m in pattern.finditer(re.sub(r"[^\x20-\x7a]", " ", text or "")):
        kind = m.lastgroup
        if kind in "wx":
            token = m[0]
            kind = "a" if token[0].isupper() and token.lower() in lexicon.abbreviations else "x"
        elif kind == "d":
            token = m[0]
            if token.rstrip(".").lower() in lexicon.abbreviations or token.count(".") > 1 or len(token) == 2 and token[0].isupper():
                kind = "a"
            else:
                kind = "x"
                kinds["u"] += 1
        kinds[kind] += 1
    return kinds


def type_counts(docs: DataFrame, lexicon: TokenLexicon = TokenLexicon(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, type, n): how many tokens of each type are in each document. Tokens are counted text by text, and only
    counts leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _counting_pattern(lexicon)
        for batch in batches:
            at, types, numbers = [], [], []
            for i, text in enumerate(batch.column(1)):
                for kind, n in counted(text.as_py(), lexicon, pattern).items():
                    at.append(i)
                    types.append(kind)
                    numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(types, pa.string()), pa.array(numbers, pa.int64())], ["doc_id", "type", "n"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, type string, n long")
    return found.groupBy("doc_id", "type").agg(F.sum("n").alias("n"))


def token_lexicon(abbreviations: DataFrame, collocations: DataFrame | None = None, most: int = 200_000) -> TokenLexicon:
    """The lexicon of tables: abbreviations (name, kind) of kind ``a`` abbreviation, ``ic`` country code, ``e``
    emoticon, and collocations (phrase). Both go to all tasks: over ``most`` rows are an error."""
    rows = abbreviations.select(F.lower("name").alias("low"), "name", "kind").limit(most + 1).collect()
    phrases = [] if collocations is None else collocations.select(F.lower("phrase").alias("p")).limit(most + 1).collect()
    if max(len(rows), len(phrases)) > most:
        raise ValueError(f"the token lexicon has more than {most} rows")
    of = lambda kind: [r for r in rows if r.kind == kind]
    return TokenLexicon(frozenset(r.low.rstrip(".") for r in of("a")), frozenset(r.low.lstrip(".") for r in of("ic")), tuple(sorted(r.name for r in of("e"))), frozenset(r.p for r in phrases))


def content_tokens(assembled: Column, kinds: str = "", keep_stopwords: bool = False) -> Column:
    """array<string>: of assembled tokens those that begin with a letter or a dot, have three characters or
    more and are no stop words, lower-cased."""
    low = F.transform(assembled, lambda t: F.lower(t["token"]))
    fine = lambda w: w.rlike("^[a-z.]") & (F.length(w) >= 3) & (F.lit(keep_stopwords) | ~w.isin(stopwords(kinds)))
    return F.filter(low, fine)
