"""Part-of-speech tags: candidates from a lexicon, context rules, and the rules' training.

``lexicon`` is (word, tag, n). Rules are (kind, frequency, tag, part1, part2): of kind WB, where
part1 is the word and part2 the next tag, and WF, where part1 is the previous tag and part2 the
word. Sentences are rows with an array of tokens; each is tagged from left to right, since a rule
sees the tags that were resolved before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

# Tags of function words, which decide by themselves.
FUNCTION_TAGS = "cipod"
#: Characters of texts that a task holds at a time.
_CHARS = 4 << 20


def with_bases(lexicon: DataFrame, bases: DataFrame) -> DataFrame:
    """The lexicon, and for words that it lacks the tags of their base words (word, base, pos), counted once."""
    more = bases.join(lexicon.select("word").distinct(), "word", "left_anti").select("word", F.col("pos").alias("tag"), F.lit(1).cast("long").alias("n"))
    return lexicon.select("word", "tag", F.col("n").cast("long").alias("n")).union(more.distinct())


def candidate_tags(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, sent, pos, token, candidates): each token's tags with counts, the most frequent first.

    Marks are ``u``, numbers ``a``, words that are not known ``n``; capitals inside a sentence
    count 25 more for ``n``. The lexicon is joined on the word.
    """
    low = F.lower("token")
    entries = lexicon.groupBy("word", "tag").agg(F.sum("n").alias("n"))
    entries = entries.groupBy("word").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag"))).alias("known"))
    rows = tokens.withColumn("_low", low).join(entries, F.col("_low") == F.col("word"), "left")

    def alone(tag: str):
        return F.array(F.struct(F.lit(-1).cast("long").alias("m"), F.lit(tag).alias("tag")))

    more = F.when((F.col("pos") > 0) & F.col("token").rlike("^[A-Z]"), 25).otherwise(0)
    known = F.array_sort(F.transform("known", lambda k: F.struct((k["m"] - F.when(k["tag"] == "n", more).otherwise(0)).cast("long").alias("m"), k["tag"].alias("tag"))))
    found = F.when(~F.col("token").rlike("[A-Za-z0-9]"), alone("u")).when(F.col("token").rlike(r"^[+-]?[0-9][0-9.,]*%?$"), alone("a")).otherwise(F.coalesce(known, alone("n")))
    return rows.withColumn("candidates", F.transform(found, lambda c: F.struct(c["tag"].alias("tag"), (-c["m"]).alias("n")))).drop("_low", "word", "known")


def _resolve(sentence: list[dict]) -> list[str]:
    """Tags from left to right; each token brings its candidates and the rules of its word."""
    tags = ["".join([c["tag"] for c in x["candidates"]]) for x in sentence]
    for i, x in enumerate(sentence):
        if len(tags[i]) == 1:
            continue
        tried = []
        for r in x["rules"] if x["rules"] is not None else ():
            beside = i + 1 if r["kind"] == "WB" else i - 1
            if 0 <= beside < len(sentence) and r["other"] in tags[beside]:
                tried.append((-r["frequency"], r["tag"]))
        fixed = [c["tag"] for c in x["candidates"] if c["tag"] in FUNCTION_TAGS]
        tags[i] = min(tried)[1] if tried else fixed[-1] if fixed else x["candidates"][0]["tag"]
    return tags


def tag_sentences(tokens: DataFrame, lexicon: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, sent, tokens, tags): one row a sentence. A token meets the rules of its word by join."""
    other = F.when(F.col("kind") == "WB", F.col("part2")).otherwise(F.col("part1")).alias("other")
    word = F.when(F.col("kind") == "WB", F.col("part1")).otherwise(F.col("part2")).alias("_word")
    by_word = rules.select(word, F.struct("kind", other, "tag", "frequency").alias("r")).groupBy("_word").agg(F.array_sort(F.collect_list("r")).alias("rules"))
    rows = candidate_tags(tokens, lexicon).withColumn("_low", F.lower("token"))
    known = F.when(F.size("candidates") > 1, F.col("rules")).alias("rules")  # others need none
    found = rows.join(by_word, F.col("_low") == F.col("_word"), "left").select("doc_id", "sent", F.struct("pos", "token", "candidates", known).alias("t"))
    found = found.groupBy("doc_id", "sent").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "sent": part["sent"], "tokens": [[x["token"] for x in t] for t in part["t"]], "tags": [_resolve(list(t)) for t in part["t"]]})

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return found.mapInPandas(run, f"doc_id {id_type}, sent {tokens.schema['sent'].dataType.simpleString()}, tokens array<string>, tags array<string>")


def tag_rules(tagged: DataFrame, weight: float = 1.0) -> DataFrame:
    """Rules from tagged words (doc_id, pos, word, tag).

    Each word counts for the tag it has before the next tag (WB) and after the previous one (WF);
    for a word and its context the most frequent tag stays, and frequencies are shares of the word.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = tagged.withColumn("after", F.lead("tag").over(order)).withColumn("before", F.lag("tag").over(order)).withColumn("word", F.lower("word"))
    back = rows.filter("after is not null").select(F.lit("WB").alias("kind"), "tag", F.col("word").alias("part1"), F.col("after").alias("part2"), "word")
    ahead = rows.filter("before is not null").select(F.lit("WF").alias("kind"), "tag", F.col("before").alias("part1"), F.col("word").alias("part2"), "word")
    return _rules_of_counts(back.union(ahead).groupBy("kind", "word", "part1", "part2", "tag").agg((F.count("*") * F.lit(weight)).alias("n")))


def _rules_of_counts(counts: DataFrame) -> DataFrame:
    """Rules from how often (n) each word has a tag in a context."""
    best = Window.partitionBy("kind", "word", "part1", "part2").orderBy(F.desc("n"), "tag")
    top = counts.withColumn("k", F.row_number().over(best)).filter("k = 1")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("kind", "word"))
    return top.select("kind", share.alias("frequency"), "tag", "part1", "part2")


def dealt_texts(texts: DataFrame, words: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, text) with the ``bucket`` that they are dealt to, and (of, word): which of ``words`` (word) are tokens
    (of ``pattern``) in a bucket, in small letters. Texts are shuffled by bucket; of their words only the distinct ones
    of a bucket meet tables, which may be of any size."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = texts.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-chars // _CHARS)))).cast("int").alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for batch in batches:
            used: dict[int, set[str]] = {}
            for bucket, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    used.setdefault(bucket, set()).update(find(text.as_py()))
            for bucket, tokens in used.items():
                low = {t.lower() for t in tokens}
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(low), pa.int32()), pa.array(low, pa.string())], ["of", "word"])

    used = dealt.select("bucket", "text").mapInArrow(run, "of int, word string").distinct()
    return dealt, written(used.join(words.select("word").distinct(), "word").select("of", "word"), "used")


def _lines(texts: pa.Table, pattern: re.Pattern[str]) -> Iterator[tuple[int, int, list[tuple[int, str]]]]:
    """(row, line, [(place, token)]) of lines that have any; rows that share an id are one document."""
    ids, rows = texts.column("doc_id").to_pylist(), {}
    for i, key in enumerate(ids):
        rows.setdefault(key, []).append(i)
    column = texts.column("text")
    for own in rows.values():
        parts = [t.split("\n") for t in (column[i].as_py() for i in own) if t is not None]
        for line in range(max(map(len, parts), default=0)):
            found = [x for p in parts if line < len(p) for x in enumerate(pattern.findall(p[line]))]
            if found:
                yield own[0], line, found if len(parts) == 1 else sorted(found)


def rules_of_texts(dealt: DataFrame, used: DataFrame, best: DataFrame, pattern: str) -> DataFrame:
    """``tag_rules`` of the tokens of texts' lines (``dealt_texts``), each word with its one tag in ``best`` (word, tag);
    words without are left out."""

    def run(some: pa.Table, known: pa.Table) -> pa.Table:
        tags = dict(zip(known.column("word").to_pylist(), known.column("tag").to_pylist(), strict=True))
        counts: Counter[tuple[str, str, str]] = Counter()
        for _, _, tokens in _lines(some, re.compile(pattern)):
            words = [w for w in (t.lower() for _, t in tokens) if w in tags]
            for a, b in zip(words, words[1:], strict=False):
                counts["WB", a, tags[b]] += 1
                counts["WF", b, tags[a]] += 1
        kinds, words, others = zip(*counts, strict=True) if counts else ((), (), ())
        columns = [pa.array(c, pa.string()) for c in (kinds, words, others, [tags[w] for w in words])]
        return pa.Table.from_arrays([*columns, pa.array(counts.values(), pa.int64())], ["kind", "word", "other", "tag", "n"])

    found = dealt.groupBy("bucket").cogroup(used.join(best, "word").groupBy("of")).applyInArrow(run, "kind string, word string, other string, tag string, n long")
    back = F.col("kind") == "WB"
    parts = found.select("kind", "word", F.when(back, F.col("word")).otherwise(F.col("other")).alias("part1"), F.when(back, F.col("other")).otherwise(F.col("word")).alias("part2"), "tag", "n")
    return _rules_of_counts(parts.groupBy("kind", "word", "part1", "part2", "tag").agg(F.sum("n").cast("double").alias("n")))


def tag_texts(dealt: DataFrame, used: DataFrame, lexicon: DataFrame, rules: DataFrame, pattern: str) -> DataFrame:
    """``tag_sentences`` of the tokens of texts' lines (``dealt_texts``), without a row for each token."""
    entries = lexicon.groupBy("word", "tag").agg(F.sum("n").alias("n"))
    entries = entries.groupBy("word").agg(F.collect_list(F.struct("tag", "n")).alias("known"))
    other = F.when(F.col("kind") == "WB", F.col("part2")).otherwise(F.col("part1")).alias("other")
    word = F.when(F.col("kind") == "WB", F.col("part1")).otherwise(F.col("part2")).alias("word")
    by_word = rules.select(word, F.struct("kind", other, "tag", "frequency").alias("r")).groupBy("word").agg(F.array_sort(F.collect_list("r")).alias("rules"))
    several = F.size("known") > 1  # others need no rules, nor their count
    words = entries.join(by_word, "word", "left").select("word", F.when(~several, F.get("known", F.lit(0))["tag"]).alias("only"), F.when(several, F.col("known")).alias("known"), F.when(several, F.col("rules")).alias("rules"))
    kind = dealt.schema["doc_id"].dataType.simpleString()

    def run(some: pa.Table, known: pa.Table) -> pa.Table:
        entry = {w: ([{"tag": o, "n": 1}] if o else k, r) for w, o, k, r in zip(*(known.column(c).to_pylist() for c in ("word", "only", "known", "rules")), strict=True)}
        seen: dict[tuple[str, bool], dict] = {}

        def of(token: str, inside: bool) -> dict:
            """The token with its candidates and rules, as ``_resolve`` takes it."""
            more = inside and "A" <= token[0] <= "Z"
            if (found := seen.get((token, more))) is None:
                tags, own = entry.get(token.lower(), (None, None))
                if not re.search("[A-Za-z0-9]", token):
                    tags = None
                    alone = "u"
                else:
                    number = re.search(r"^[+-]?[0-9][0-9.,]*%?$", token)
                    tags, alone = (None, "a") if number else (tags, "n")
                ranked = sorted((-(k["n"] + (25 if more and k["tag"] == "n" else 0)), k["tag"]) for k in tags) if tags else [(-1, alone)]
                found = seen[token, more] = {"token": token, "candidates": [{"tag": t} for _, t in ranked], "rules": own if len(ranked) > 1 else None}
            return found

        at, lines, tokens, tags = [], [], [], []
        for row, line, found in _lines(some, re.compile(pattern)):
            at.append(row)
            lines.append(line)
            tokens.append([t for _, t in found])
            tags.append(_resolve([of(t, i > 0) for i, t in found]))
        columns = [some.column("doc_id").take(pa.array(at, pa.int64())), pa.array(lines, pa.int32()), pa.array(tokens, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.string()))]
        return pa.Table.from_arrays(columns, ["doc_id", "sent", "tokens", "tags"])

    return dealt.groupBy("bucket").cogroup(used.join(words, "word").groupBy("of")).applyInArrow(run, f"doc_id {kind}, sent int, tokens array<string>, tags array<string>")


def tagging_precision(rows: DataFrame) -> DataFrame:
    """One row: n, right and precision of (predicted, actual)."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("actual")).alias("right")).withColumn("precision", F.col("right") / F.col("n"))
