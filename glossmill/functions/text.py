"""Tokens, content words and small text functions, all as Column expressions.

A null text gives null. In ASCII mode, the default, all characters outside code points 32 to
122 count as blanks; Unicode mode keeps letters and digits of any script together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and short forms.
COMMON_STOPWORDS = """
    about add ago after all also an and another any are as at be
    because been before being between big both but by came can come
    could did do does due each else end far few for from get got had
    has have he her here him himself his how if in into is it its
    just let lie like low make many me might more most much must
    my never no nor not now of off old on only or other our out over
    per pre put re said same see she should since so some still such
    take than that the their them then there these they this those
    through to too under up use very via want was way we well were
    what when where which while who will with would yes yet you your
""".split()
WEB_STOPWORDS = """
    address adobe background book com edu foreground net org spam www
    net ftp jpeg gif jpg png web gmt htm html bin com
""".split()
NEWS_STOPWORDS = "reuters ap iht upi".split()
EMAIL_STOPWORDS = "address book spam fyi acknowledge".split()
SHORT_FORMS = {"n't": "not", "'nt": "not", "'d": "would", "'ll": "will", "'ve": "have", "'m": "am", "'re": "are"}

LONGEST_TERM = 35
_EXTRA = {"web": WEB_STOPWORDS, "news": NEWS_STOPWORDS, "email": EMAIL_STOPWORDS}


def stopwords(kinds: str = "") -> list[str]:
    """The common stop words and those of each kind named (web, news, email), sorted."""
    words = set(COMMON_STOPWORDS)
    for kind in kinds.split():
        words |= set(_EXTRA.get(kind, ()))
    return sorted(words)


def ascii_text(text: Column) -> Column:
    """All characters outside code points 32 to 122 as blanks."""
    return F.regexp_replace(text, r"[^\x20-\x7a]", " ")


def tokens(text: Column, ascii_only: bool = True) -> Column:
    """Runs of letters and digits, runs of blanks (as one blank) and single other characters."""
    if ascii_only:
        found = F.regexp_extract_all(ascii_text(text), F.lit("([A-Za-z0-9]+| +|[^A-Za-z0-9 ])"), 1)
    else:
        found = F.regexp_extract_all(F.regexp_replace(text, r"\s", " "), F.lit(r"([\p{L}\p{N}]+| +|[^\p{L}\p{N} ])"), 1)
    return F.transform(found, lambda t: F.when(t.startswith(" "), F.lit(" ")).otherwise(t))


def raw_tokens(text: Column) -> Column:
    """As ``tokens``, with runs of blanks as long as they are: lengths sum to the text's."""
    return F.regexp_extract_all(ascii_text(text), F.lit("([A-Za-z0-9]+| +|[^A-Za-z0-9 ])"), 1)


def content_words(text: Column, kinds: str = "", keep_stopwords: bool = False, ascii_only: bool = True) -> Column:
    """Lower-cased words of 3 characters or more that begin with a letter and are no stop words."""
    pattern = "([a-z0-9]+)" if ascii_only else r"([\p{L}\p{N}]+)"
    words = F.regexp_extract_all(F.lower(ascii_text(text) if ascii_only else text), F.lit(pattern), 1)

    def wanted(w: Column) -> Column:
        good = (F.length(w) >= 3) & w.rlike("^[a-z]" if ascii_only else r"^\p{L}")
        return good if keep_stopwords else good & ~w.isin(stopwords(kinds))

    return F.filter(words, wanted)


def clean_text(text: Column) -> Column:
    """Line ends as blanks; the length stays."""
    return F.translate(text, "\n\r", "  ")


def content_digest(text: Column) -> Column:
    """Base64 of the MD5 digest without padding, by which copies are known."""
    return F.rtrim(F.base64(F.unhex(F.md5(text))), F.lit("="))


def trim_field(text: Column, size: int = 10) -> Column:
    """Long values cut to size - 1 characters and a note of how many more there are."""
    note = F.concat(F.substring(text, 1, size - 1), F.lit("...."), (F.length(text) - size).cast("string"), F.lit(" chars..."))
    return F.when(F.length(text) > size, note).otherwise(text)


def expand_short_form(token: Column) -> Column:
    """A token with a short form as two words, else as one; ``ai`` before it stands for ``are``."""
    out = F.array(token)
    for short, full in SHORT_FORMS.items():
        stem = F.substring(token, F.lit(1), F.length(token) - len(short))
        stem = F.when(stem.contains("ai"), F.lit("are")).otherwise(stem)
        out = F.when(token.endswith(short) & (F.length(token) > len(short)), F.array(stem, F.lit(full))).otherwise(out)
    return out


def distinct_terms(text: Column) -> Column:
    """Terms of a query in order, each once; a quoted phrase is one term."""
    found = F.regexp_extract_all(text, F.lit(r'("[^"]*"|\S+)'), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(F.translate(t, '"', ""))), lambda t: F.length(t) > 0))


def path_words(path: Column) -> Column:
    """The words of a file path: components that begin with a letter or digit, cut at underscores,
    without the last one's extension."""
    parts = F.split(F.regexp_replace(path, r"(?<=[\\/])([^\\/]*?)\.[^\\/]*$", "$1"), r"[\\/]")
    parts = F.filter(parts, lambda p: p.rlike("^[0-9a-zA-Z]") & ~p.rlike("^[a-zA-Z]:"))
    return F.array_join(F.flatten(F.transform(parts, lambda p: F.split(p, "_"))), " ")


def media_kind(path: Column) -> Column:
    """image, audio, video, doc or null, by the extension."""
    # Extensions by kind.
    kinds = {"image": "jpg|jpeg|gif|png", "audio": "au|ra|mp3|wav|midi|mid", "video": "ram", "doc": "pdf|ps|doc|xls|ppt|htm|html|pl|pm"}
    out = F.lit(None).cast("string")
    for kind, extensions in kinds.items():
        out = F.when(path.rlike(rf"(?i)\.({extensions})$"), F.lit(kind)).otherwise(out)
    return out


def question_words(text: Column) -> Column:
    """Question words: one at the start first, then all others in order."""
    # Question words.
    pattern = "(name|how|what|when|where|which|who|why)"
    first = F.lower(F.regexp_extract(text, rf"(?i)^\W*{pattern}\b", 1))
    every = F.regexp_extract_all(F.lower(text), F.lit(rf"\b{pattern}\b"), 1)
    return F.array_distinct(F.filter(F.concat(F.array(first), every), lambda w: w != ""))


def question_kind(text: Column) -> Column:
    """The kind of answer that the question word asks for."""
    low = F.lower(text)
    return F.when(low.rlike(r"\bwhen\b"), "time").when(low.rlike(r"\bwhere\b"), "place").when(low.rlike(r"\bwho\b"), "person").otherwise("miscellaneous")


def made_sentence(key: Column, leads: list[str], subjects: list[str], verbs: list[str], objects: list[str]) -> Column:
    """A sentence of a lead-in, subject, verb and object drawn by the hash of a key: test text that repeats."""

    def drawn(words: list[str], turn: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(len(words))).cast("int") + 1)

    return F.concat(F.concat_ws(" ", *(drawn(w, i) for i, w in enumerate((leads, subjects, verbs, objects)))), F.lit("."))
