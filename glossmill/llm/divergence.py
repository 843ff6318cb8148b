"""How far the sources of each language are apart: a two-pass vocabulary automaton.

The first pass counts in how many documents of a language each term occurs, exactly, and keeps the
terms of enough documents. The second pass recounts their occurrences: kept terms, padded with a
delimiter on either side, become Aho-Corasick automata that run over the texts' words. A vocabulary grows
with the corpus, so it is dealt by hash to blocks of about ``block_bytes``; texts are cut into words
once, and each distinct word of a batch and source goes, between delimiters, to the block that its term
would be in, in strings of a few kilobytes, with the number of its occurrences. A block's words are dealt to several places, each with the block's terms before them,
so neither a block nor a hot source is held by one task. The texts of a batch are taken group by group and
those of a place source by source, so that a task holds the words or counts of one at a time.

Counts above zero are sparse postings. A source's smoothed share of a term is 1 + floor(1e9 * (count +
1) / (N + V)); the divergence of shares p from q is floor((p - q)^2 / q). Terms that neither of two
sources has are counted, not listed; terms that one has are summed by their share, since equal
counts give equal shares; only terms that both have are paired, inside the task that holds the
term's postings. A term's postings are as many as its language has sources, and the result itself has
a row for each pair of sources.

Defined cases: a null text, language or source is empty; a group without kept terms has a row for each
other source of its language; a language without kept terms has value 0 in these; repeated rows are
documents each. Columns beside text, lang and source are not read. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .memory import give_back, tidy
from .words import WordKey, Words, mix, text_bytes, words_of

#: Bytes of terms, runs of letters and of everything beyond ASCII, once A to Z are lower case: a to z and everything beyond ASCII.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PIECE = 8 << 10  # bytes of words in a row
_PLACE = 128 << 20  # bytes of texts whose words meet in a place
_ROWS_AT_ONCE = 256  # rows of words that become Python strings at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MATCH = np.dtype([("end", np.int64), ("term", np.int64)])
_PAIRS = 1 << 21  # pairs of postings that are expanded at once


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value comes first, and for each value the number of its distinct one."""
    encoded = pa.array(values).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    first = np.empty(len(encoded.dictionary), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first, codes


def _totals(codes: np.ndarray, n: np.ndarray, several: int) -> np.ndarray:
    """Sums of ``n`` by code; they are far below 2**53."""
    return np.bincount(codes, n, several).astype(np.int64)


def _named(part: Words, which: np.ndarray) -> pa.Array:
    """Some of the words as strings."""
    size = (part.ends - part.starts)[which]
    bounds = np.append(0, np.cumsum(size))
    body = part.buf[np.arange(bounds[-1]) + np.repeat(part.starts[which] - bounds[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(body))


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """group, hash, number and word of each distinct word of each group, from parts in which each is distinct."""
    if len(parts) == 1:
        return parts[0]
    own, hashes, n = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])
    first, codes = _distinct(mix(hashes + own.astype(np.uint64) * _ODD))
    words = pa.chunked_array([x[3] for x in parts]).take(pa.array(first)).combine_chunks()
    return own[first], hashes[first], _totals(codes, n, len(first)), words


def _counted_words(column: pa.Array, group: np.ndarray, key: WordKey, by_row: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """group, hash, occurrences (``by_row``: rows) and word of each distinct word of each group, each group
    whole in one of the results. Rows are taken in order of groups, so that beside a chunk of texts only the
    distinct words of one group are held."""
    if len(group) and (group != group[0]).any():
        order = np.argsort(group, kind="stable")
        column, group = column.take(pa.array(order)), group[order]
    held: list[tuple] = []
    for part in words_of(column, _LETTERS, True):
        hashes, owner = part.hashes(key), part.owners()
        once = _distinct(mix(hashes + owner.astype(np.uint64) * _ODD))[0] if by_row else np.arange(len(hashes))  # of a row's copies one
        hashes, own = hashes[once], group[owner[once] + part.first]
        first, codes = _distinct(mix(hashes + own.astype(np.uint64) * _ODD))
        if len(first):
            held.append((own[first], hashes[first], np.bincount(codes, minlength=len(first)), _named(part, once[first])))
        last = group[part.first + part.rows - 1]
        if not held or (held[0][0] == last).all() and sum(len(x[0]) for x in held[1:]) < len(held[0][0]):
            continue
        own, hashes, n, words = _merged(held)
        done, open_ = np.flatnonzero(own != last), np.flatnonzero(own == last)
        held = [(own[open_], hashes[open_], n[open_], words.take(pa.array(open_)))] if len(open_) else []
        if len(done):
            yield own[done], hashes[done], n[done], words.take(pa.array(done))
    if held:
        yield _merged(held)


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term) of the terms in at least so many documents of the language. A task tells terms of
    a batch of texts apart by a keyed hash of 64 bits and sends each with its number of documents."""
    key = WordKey.drawn()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: dict = {}
            langs = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.int64)
            named = pa.array(list(names), pa.string())
            for lang, _, n, terms in _counted_words(batch.column("text"), langs, key, by_row=True):
                yield pa.RecordBatch.from_arrays([named.take(pa.array(lang)), terms.cast(pa.string()), pa.array(n)], ["lang", "term", "n"])

    each = docs.select("lang", "text").mapInArrow(tidy(run), "lang string, term string, n long")
    return each.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def _pieces(own: np.ndarray, blocks: np.ndarray, n: np.ndarray, words: pa.Array) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(group, block, words that end with a delimiter each, occurrences of each) of about ``_PIECE`` bytes."""
    order = np.lexsort((blocks, own))
    own, blocks, n = own[order], blocks[order], n[order]
    buf, offsets = text_bytes(words.take(pa.array(order)))
    size = np.diff(offsets) + 1
    ends = np.cumsum(size)
    if not len(ends):
        return
    out = np.full(ends[-1], 10, np.uint8)
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False
    out[inside] = buf
    new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0))
    for a, b in zip(new, np.append(new[1:], len(own)), strict=True):
        first = ends[a] - size[a]
        cuts = np.unique(np.searchsorted(ends[a:b], np.arange(first, ends[b - 1], _PIECE)[1:])) + a
        for i, j in zip([a, *cuts], [*cuts, b], strict=True):
            if j > i:
                yield int(own[a]), int(blocks[a]), out[ends[i] - size[i] : ends[j - 1]].tobytes(), n[i:j].astype("<i8").tobytes()


def _block_words(docs: DataFrame, key: WordKey, n_blocks: int, places: int) -> DataFrame:
    """(lang, block, place, kind 1, source, words, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            names: dict = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(langs, sources, strict=True)], np.int64)
            named = list(names)
            for own, hashes, n, words in _counted_words(batch.column("text"), group, key):
                rows: list[tuple] = []
                for g, b, text, times in _pieces(own, (hashes % np.uint64(n_blocks)).astype(np.int64), n, words):
                    turn += 1
                    rows.append((named[g][0], b, (hash(named[g]) + turn) % places, 1, named[g][1], text.decode(), times))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES, strict=True)], _NAMES)

    return docs.select("lang", "source", "text").mapInArrow(tidy(run), _ROWS)


_NAMES = ["lang", "block", "place", "kind", "source", "words", "times"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary()]
_ROWS = "lang string, block long, place long, kind int, source string, words string, times binary"


def _block_terms(terms: DataFrame, key: WordKey, n_blocks: int, places: int) -> DataFrame:
    """(lang, block, place, kind 0, no source, term, no times), for each place of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words_of(batch.column("term"), _LETTERS, False):
                rows = batch.slice(part.first, part.rows)
                blocks = (part.hashes(key) % np.uint64(n_blocks)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array(blocks), rows.column("term")], ["lang", "block", "term"])

    dealt = terms.mapInArrow(tidy(run), "lang string, block long, term string")
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long"))).alias("place")
    return dealt.select("lang", "block", place, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("source"), F.col("term").alias("words"), F.lit(None).cast("binary").alias("times"))


class _Counter:
    """The automaton of a place's terms, and the counts of the source whose words pass it now."""

    def __init__(self) -> None:
        self.terms: list[str] = []
        self.automaton: ahocorasick.Automaton | None = None
        self.source: str | None = None
        self.counts: np.ndarray | None = None

    def add(self, source: str, words: str, times: bytes) -> None:
        if not self.terms:
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(self.terms):
                self.automaton.add_word(f"\n{term}\n", i)
            self.automaton.make_automaton()
        found = np.fromiter(self.automaton.iter(f"\n{words}"), _MATCH)
        # A match ends at the delimiter after its word.
        codes = np.frombuffer(words.encode(), np.uint8) if words.isascii() else np.frombuffer(words.encode("utf-32-le"), np.uint32)
        word = np.searchsorted(np.flatnonzero(codes == 10) + 1, found["end"])
        if self.counts is None:
            self.source, self.counts = source, np.zeros(len(self.terms), np.int64)
        np.add.at(self.counts, found["term"], np.frombuffer(times, "<i8")[word])

    def done(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The counts of the source so far, which are given up."""
        if self.counts is None:
            return
        rows = np.flatnonzero(self.counts)
        terms = pa.array([self.terms[i] for i in rows], pa.string())
        names = (pa.array([x] * len(rows), pa.string()) for x in (lang, self.source))
        yield pa.RecordBatch.from_arrays([*names, terms, pa.array(self.counts[rows])], ["lang", "source", "term", "n"])
        self.counts = None


def count_terms(docs: DataFrame, terms: DataFrame, block_bytes: int = 2 << 20) -> DataFrame:
    """(lang, source, term, n): how often each kept term of the language occurs in the source."""
    key = WordKey.drawn()
    largest = terms.groupBy("lang").agg(F.sum(F.octet_length("term")).alias("x")).agg(F.max("x")).first()[0] or 0
    n_blocks = max(1, -(-largest // block_bytes))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = max(1, -(-size // (n_blocks * _PLACE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counter = None, _Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS_AT_ONCE):
                some = batch.slice(k, _ROWS_AT_ONCE)
                for lang, block, place, kind, source, words, times in zip(*(some.column(c).to_pylist() for c in _NAMES), strict=True):
                    if (lang, block, place) != now:
                        if now is not None:
                            yield from counter.done(now[0])
                        now, counter = (lang, block, place), _Counter()
                        give_back()  # the automaton before
                    if kind == 0:
                        counter.terms.append(words)
                        continue
                    if source != counter.source:
                        yield from counter.done(lang)
                    counter.add(source, words, times)
        if now is not None:
            yield from counter.done(now[0])

    rows = _block_terms(terms, key, n_blocks, places).union(_block_words(docs, key, n_blocks, places))
    own = ["lang", "block", "place"]
    counted = rows.repartition(*own).sortWithinPartitions(*own, "kind", "source").mapInArrow(tidy(run), "lang string, source string, term string, n long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (n + 1) / (total + terms)), exactly; null without terms."""
    scaled = F.lit(10**9).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    whole = F.call_function("div", scaled, F.when(terms > 0, total + terms).cast("decimal(20,0)"))
    return (whole + 1).cast("long")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _shared_terms(postings: DataFrame) -> DataFrame:
    """(lang, source, item, shared): over the terms that both sources have, what their divergence is
    beyond what each would have if the other, and then both, had none. ``held`` is per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for batch in batches:
            held = batch.column("held")
            size = np.diff(held.offsets.to_numpy())
            flat = held.flatten()
            if not len(flat):
                continue
            p, z = (flat.field(c).to_numpy() for c in ("p", "z"))
            owner = np.repeat(np.arange(len(size)), size)
            langs = batch.column("lang").to_pylist()
            names: dict = {}
            code = np.array([names.setdefault((langs[o], s), len(names)) for o, s in zip(owner, flat.field("source").to_pylist(), strict=True)], np.int64)
            named = list(names)
            ends = np.cumsum(size)
            first, width = (ends - size)[owner], size[owner]
            cuts = np.searchsorted(np.cumsum(width), np.arange(0, width.sum(), _PAIRS)[1:])
            for a, b in zip([0, *cuts], [*cuts, len(p)], strict=True):
                n = width[a:b]
                i = np.repeat(np.arange(a, b), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]
                i, j = i[i != j], j[i != j]
                apart = lambda x, y: (x - y) ** 2 // y
                value = apart(p[i], p[j]) - apart(p[i], z[j]) - apart(z[i], p[j]) + apart(z[i], z[j])
                pair, where = np.unique(code[i] * len(named) + code[j], return_inverse=True)
                sums = np.zeros(len(pair), np.int64)
                np.add.at(sums, where, value)
                for k, x in zip(pair.tolist(), sums.tolist(), strict=True):
                    key = (*named[k // len(named)], named[k % len(named)][1])
                    total[key] = total.get(key, 0) + x
            if len(total) > 200_000:
                yield _pair_rows(total)
                total = {}
        yield _pair_rows(total)

    return postings.mapInArrow(tidy(run), "lang string, source string, item string, x string").groupBy("lang", "source", "item").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("shared"))


def _pair_rows(total: dict[tuple, int]) -> pa.RecordBatch:
    rows = [[k[i] for k in total] for i in range(3)] + [[str(x) for x in total.values()]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in rows], ["lang", "source", "item", "x"])


def _pairs(stats: DataFrame, postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language."""
    shares = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    other = stats.select("lang", F.col("source").alias("item"), "z")
    wide = lambda c: F.sum(F.col("n").cast("decimal(20,0)") * c.cast("decimal(19,0)"))
    alone = shares.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(wide(_apart("p", "z")).alias("out"), wide(_apart("z", "p")).alias("back"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "back")
    one = stats.select("lang", "source", "z", "terms", F.col("held").alias("h"))
    two = stats.select("lang", F.col("source").alias("item"), F.col("z").alias("y"), F.col("held").alias("g"))
    rows = one.join(two, "lang").filter("source <> item")
    for more in (alone.drop("back"), back, _shared_terms(terms)):
        rows = rows.join(more, ["lang", "source", "item"], "left")
    zero = F.lit(0).cast("decimal(38,0)")
    neither = (F.col("terms") - F.col("h") - F.col("g")).cast("decimal(20,0)") * _apart("z", "y").cast("decimal(19,0)")
    value = F.when(F.col("terms") > 0, sum((F.coalesce(c, zero) for c in ("out", "back", "shared")), neither)).otherwise(zero)
    return rows.select("lang", "source", "item", value.cast("long").alias("value"))


def source_divergence(
    docs: DataFrame, least_documents: int = 3, most_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block_bytes: int = 2 << 20
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows say how far the source's shares of terms are
    from each other source's of the language; ``term`` rows name its ``most_terms`` terms whose share is
    most above that of the language. Ranks go by value, descending, then by item."""
    empty = F.lit("")
    docs = docs.select(*(F.coalesce(F.col(c), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = written(kept_terms(docs, least_documents), "kept")
    counts = written(count_terms(docs, kept, block_bytes), "counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = docs.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total", "held"])
    stats = written(groups.withColumn("z", _share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    whole = stats.groupBy("lang").agg(F.sum("total").alias("all"))

    postings = counts.join(stats.select("lang", "source", "total", "terms", "z"), ["lang", "source"])
    postings = postings.select("lang", "source", "term", "n", "z", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    terms = postings.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "p", "z")).alias("held"))
    terms = written(terms, "terms")
    marked = terms.join(whole, "lang").join(sizes, "lang").select("lang", "term", _share(F.col("n"), F.col("all"), F.col("terms")).alias("q"), F.inline("held"))
    marked = marked.filter("p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    marked = marked.select("*", rank).filter(F.col("rank") <= most_terms)
    listed = terms.select("lang", F.inline("held"))
    pairs = _pairs(stats, listed, terms).select("*", rank)
    out = [F.lit(part).alias("part") for part in ("pair", "term")]
    return pairs.select("lang", "source", out[0], "item", "value", "rank").union(marked.select("lang", "source", out[1], "item", "value", "rank"))
