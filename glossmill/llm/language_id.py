"""Language identification with interpolated Kneser-Ney character models.

Characters are lower-cased; each run of characters that are no letters is one blank; letters beyond
the basic plane count as the two units of UTF-16. The
4-grams of all training texts are counted in Spark by language, exactly. Lower orders follow from
the 4-gram types (Kneser-Ney counts in how many contexts a shorter gram is seen) by groupings of
their own. What is known of a gram and language are the nodes: its count, and as a context the sum
and number of what follows. Only names, discounts and the number of letters reach the driver.

Texts are dealt to blocks of bounded size by a hash. Each block's distinct grams are joined with
the nodes, and the block is scored against its own part of the model, so no machine needs to hold
the whole. Grams that no language has seen fall back to the next order.

The lowest cross-entropy by character decides. It is rejected if it exceeds what training texts
of that language and length (in powers of two) reach: their ``quantile``, times ``slack``. A length
with fewer than ``_ENOUGH`` of them has the greater of the limits of the nearest lengths that have so
many; a language without any such length has the greatest of its own limits, or else of all.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; so
is every text if nothing can be learned. A null language teaches nothing. Rows without an id
count as training rows. Ties between languages go to the first by name. Repeated rows count as
often as they come, and get a row each. Over ``max_languages`` names are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .memory import give_back, tidy

ORDER = 4
_CHUNK = 1 << 18
_ROWS = 256  # texts that become Python strings at once
_FLUSH = 1 << 22
#: Characters of a block of texts; fewer where that makes less than so many blocks.
_BLOCK, _SMALL, _LEAST_BLOCKS = 1 << 23, 1 << 18, 63
_VALUES = ("n", "total", "types")
#: Training texts from which a length has a limit of its own; lengths in powers of two.
_ENOUGH, _BINS = 20, 64
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Each code point, but 0 for all that are no letters."""
    if not _LETTERS:
        codes = np.arange(0x110000, dtype=np.uint32)
        codes[[not chr(i).isalpha() for i in range(0x110000)]] = 0
        _LETTERS.append(codes)
    return _LETTERS[0]


def _units(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit units of code points and where texts begin in them: letters beyond the basic plane are
    two units each, as in UTF-16, which no other letter shares."""
    far = codes > 0xFFFF
    if not far.any():
        return codes.astype(np.uint16), offsets
    starts = np.arange(len(codes)) + np.cumsum(far) - far
    out = np.repeat(codes, 1 + far)
    above = codes[far] - 0x10000
    out[starts[far]], out[starts[far] + 1] = 0xD800 + (above >> 10), 0xDC00 + (above & 0x3FF)
    return out.astype(np.uint16), np.append(starts, len(out))[offsets]


def _chunks(texts: list[str | None] | pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[str]]]:
    """Texts in lower case, about ``_CHUNK`` characters at a time, and the number of the first."""
    i, part, held = 0, [], 0
    for k in range(0, len(texts), _ROWS):
        some = texts[k : k + _ROWS]
        for text in some if isinstance(some, list) else some.to_pylist():
            part.append((text or "").lower())
            held += len(part[-1]) + 1
            if held >= _CHUNK:
                yield i, part
                i, part, held = i + len(part), [], 0
    if part:
        yield i, part


def _grams(texts: list[str | None] | pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of texts: number of the first, packed 4-grams, where each text's begin, letters of each."""
    for i, part in _chunks(texts):
        codes = _letters()[np.frombuffer(" ".join([*part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes, offsets = _units(codes, np.cumsum([0, *(len(t) + 1 for t in part)]))
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        before = np.empty_like(codes)
        before[0], before[1:] = 0, codes[:-1]
        before[first] = 0
        keep = (codes != 0) | (before != 0)
        bounds = np.append(0, np.cumsum(keep))[offsets]
        codes = codes[keep].astype(np.uint64)
        inside = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
        grams = codes.copy()
        for back in range(1, ORDER):
            shifted = np.zeros_like(codes)
            shifted[back:] = codes[:-back]
            shifted[inside < back] = 0
            grams |= shifted << np.uint64(16 * back)
        letters = np.add.reduceat(codes != 0, bounds[:-1][np.diff(bounds) > 0], dtype=np.int64) if len(codes) else np.empty(0, np.int64)
        n_letters = np.zeros(len(part), np.int64)
        n_letters[np.diff(bounds) > 0] = letters
        yield i, grams, bounds, n_letters


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all of (lang, text), exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        size = 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, grams, bounds, _ in _grams(batch.column("text")):
                for j in range(len(bounds) - 1):
                    held.setdefault(langs[first + j], []).append(grams[bounds[j] : bounds[j + 1]].copy())
                size += len(grams)
                if size > _FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters of each gram."""
    return grams & np.uint64((1 << 16 * order) - 1)


def _discount(once, twice):
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


@dataclass
class Fit:
    """What all parts of a model share: its languages, discounts by (order, language) and number of letters; and the nodes."""

    names: list[str]
    discounts: np.ndarray
    letters: int
    nodes: DataFrame | None = None


class LanguageModels:
    """Models of all languages over some grams: fitted to 4-gram counts here, or a part of a ``Fit``."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        names = sorted(counts)
        discounts, rows, letters = np.full((ORDER + 1, len(names)), 0.5), [], set()
        for j, name in enumerate(names):
            grams, n = counts[name]
            for order in range(ORDER, 0, -1):
                discounts[order, j] = _discount((n == 1).sum(), (n == 2).sum())
                rows.append((np.full(len(grams), order), grams, np.full(len(grams), j), n, 0 * n, 0 * n))
                contexts, at = np.unique(grams >> np.uint64(16), return_inverse=True)
                total, types = np.bincount(at, n), np.bincount(at)
                rows.append((np.full(len(contexts), order - 1), contexts, np.full(len(contexts), j), 0 * total, total, types))
                if order == 1:
                    letters.update(grams.tolist())
                grams, n = np.unique(_suffix(grams, order - 1), return_counts=True)
        order, gram, lang, *values = (np.concatenate(x) for x in zip(*rows, strict=True))
        self._take(Fit(names, discounts, len(letters)), order, gram, *((np.arange(len(gram)), lang, v) for v in values))

    @classmethod
    def of(cls, fit: Fit, nodes: pa.Table) -> LanguageModels:
        """The part of a fit that some of its nodes make."""
        made, several = cls.__new__(cls), len(fit.names)
        values = []
        for name in _VALUES:
            column = nodes.column(name).combine_chunks()
            packed = pc.list_flatten(column).to_numpy(zero_copy_only=False)
            rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int32)
            values.append((rows, (packed % several).astype(np.int32), packed // several))
        made._take(fit, nodes.column("order").to_numpy(), nodes.column("gram").to_numpy().view(np.uint64), *values)
        return made

    def _take(self, fit: Fit, order: np.ndarray, gram: np.ndarray, *values: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Nodes and, for each kind of value, (row of the node, language, value)."""
        self.names, self.discounts, self.letters = fit.names, fit.discounts, fit.letters
        self.grams: list[np.ndarray] = []
        place = np.zeros(len(gram), np.int32)
        for k in range(ORDER + 1):
            grams, place[order == k] = np.unique(gram[order == k], return_inverse=True)
            self.grams.append(grams)
        self.values = []
        for row, lang, value in values:
            row, lang, value = row[value > 0], lang[value > 0], value[value > 0]
            group = order[row].astype(np.int32) * np.int32(len(self.names)) + lang
            by = np.argsort(group, kind="stable")
            begins = np.searchsorted(group[by], np.arange((ORDER + 1) * len(self.names) + 1))
            self.values.append((begins, place[row[by]], value[by].astype(np.float64)))

    def _find(self, order: int, grams: np.ndarray) -> np.ndarray:
        """The place of each gram, one beyond the last if it has no node."""
        known = self.grams[order]
        at = np.searchsorted(known, grams)
        if not len(known):
            return at
        return np.where(known[np.minimum(at, len(known) - 1)] == grams, at, len(known))

    def _dense(self, order: int, lang: int, value: int) -> np.ndarray:
        out = np.zeros(len(self.grams[order]) + 1)
        begins, place, values = self.values[value]
        rows = slice(*begins[order * len(self.names) + lang :][:2])
        out[place[rows]] = values[rows]
        return out

    def _by_language(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        """For each language, the log probability of each gram's last character after the others."""
        now, inverse = np.unique(grams, return_inverse=True)
        orders = []
        for k in range(ORDER, 0, -1):
            shorter, below = np.unique(_suffix(now, k - 1), return_inverse=True)
            orders.insert(0, (k, self._find(k, now), self._find(k - 1, now >> np.uint64(16)), below))
            now = shorter
        for j in range(len(self.names)):
            p = np.full(len(now), 1.0 / (self.letters + 1))
            for k, at, context, below in orders:
                n, total, types = self._dense(k, j, 0)[at], self._dense(k - 1, j, 1)[context], self._dense(k - 1, j, 2)[context]
                d, some = self.discounts[k, j], np.maximum(total, 1)
                p = np.where(n > 0, (n - d) / some, 0) + np.where(total > 0, d * types / some, 1) * p[below]
            yield np.log(p)[inverse]

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """For each gram and language, the log probability of its last character after the others."""
        return np.column_stack(list(self._by_language(grams)))

    def judge(self, texts: list[str | None] | pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, ...]:
        """Of each text: number of the best language (-1: und), its cross-entropy, score, characters."""
        best, entropy, score, size = [], [], [], []
        for _, grams, bounds, letters in _grams(texts):
            n = np.diff(bounds)
            total = np.zeros((len(n), len(self.names)))
            if len(grams):
                for j, found in enumerate(self._by_language(grams)):
                    total[n > 0, j] = np.add.reduceat(found, bounds[:-1][n > 0])
            top = total.argmax(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                entropy.append(np.where(n > 0, -total.max(axis=1) / n, np.inf))
            score.append(np.where(letters > 0, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0))
            best.append(np.where(letters > 0, top, -1))
            size.append(n)
        if not best:
            return tuple(np.empty(0, t) for t in (np.int64, float, float, np.int64))
        return tuple(np.concatenate(x) for x in (best, entropy, score, size))


def fit_languages(docs: DataFrame, max_languages: int = 256) -> Fit | None:
    """The fit to all rows of (lang, text) whose lang is not null; None without any gram.

    Its nodes are (order, gram, n, total, types). The last three are lists with an entry for each
    language that has a value: it times the number of languages, plus the language's number.
    """
    counts = written(count_grams(docs.filter("lang is not null").select("lang", "text")), "grams")
    names = sorted(r.lang for r in counts.select("lang").distinct().limit(max_languages + 1).collect())
    if not names:
        return None
    if len(names) > max_languages:
        raise ValueError(f"over {max_languages} languages to learn")
    numbers = docs.sparkSession.createDataFrame(list(enumerate(names)), "number int, lang string")
    table = counts.join(F.broadcast(numbers), "lang").select(F.col("number").alias("lang"), "gram", "n")  # max_languages rows
    parts, none = [], F.lit(0).cast("long")
    for order in range(ORDER, 0, -1):
        parts.append(table.select(F.lit(order).alias("order"), "gram", "lang", "n", none.alias("total"), none.alias("types")))
        followed = table.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("gram")).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        parts.append(followed.select(F.lit(order - 1).alias("order"), "gram", "lang", none.alias("n"), "total", "types"))
        table = table.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1).cast("long")).alias("gram")).agg(F.count("*").alias("n"))
    several = F.lit(len(names)).cast("long")
    packed = (F.collect_list(F.when(F.col(c) > 0, F.col(c) * several + F.col("lang"))).alias(c) for c in _VALUES)
    nodes = reduce(DataFrame.unionAll, parts).groupBy("order", "gram").agg(*packed)
    nodes = written(nodes.select("order", "gram", *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in _VALUES)), "nodes")
    grams = nodes.select("order", "gram", F.explode("n").alias("x")).select("order", "gram", (F.col("x") % several).cast("int").alias("lang"), F.expr(f"x div {len(names)}").alias("n"))
    discounts = np.full((ORDER + 1, len(names)), 0.5)
    for r in grams.groupBy("order", "lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
        discounts[r.order, r.lang] = _discount(r.once, r.twice)
    return Fit(names, discounts, grams.filter("order = 1").select("gram").distinct().count(), nodes)


def _dealt(texts: DataFrame, blocks: int, id_col: str, text_col: str) -> DataFrame:
    """(_block, _rows): the rows of ``texts`` dealt to blocks, many in one compressed value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            of = batch.column(batch.num_columns - 1).to_numpy()
            batch = batch.take(pa.array(np.argsort(of, kind="stable")))
            found, n = np.unique(of, return_counts=True)
            packed = []
            for begin, size in zip(np.cumsum(n) - n, n, strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(begin, size))
                packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(packed, pa.binary())], ["_block", "_rows"])

    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int")
    return texts.withColumn("_block", block).mapInArrow(tidy(run), "_block int, _rows binary").repartition(blocks, "_block")


def _unpacked(packed: pa.Array | pa.ChunkedArray) -> Iterator[pa.Table]:
    for value in packed:
        yield pa.ipc.open_stream(value.as_buffer()).read_all()


def _wanted(dealt: DataFrame, text_col: str) -> DataFrame:
    """(_block, order, gram): the distinct grams of each block and what scoring asks of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for block, rows in zip(batch.column("_block").to_pylist(), _unpacked(batch.column("_rows")), strict=True):
                for _, grams, _, _ in _grams(rows.column(text_col)):
                    held.setdefault(block, []).append(np.unique(grams))
                    size += len(held[block][-1])
                if size > _FLUSH:
                    held = {b: [np.unique(np.concatenate(parts))] for b, parts in held.items()}
                    size = 0
        for block, parts in held.items():
            grams = np.unique(np.concatenate(parts))
            for order in range(ORDER, -1, -1):
                n = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.full(n, order, np.int32)), pa.array(grams.view(np.int64))], ["_block", "order", "gram"])
                if order:
                    grams = np.unique(np.concatenate([_suffix(grams, order - 1), grams >> np.uint64(16)]))

    return dealt.mapInArrow(tidy(run), "_block int, order int, gram long")


def _judged(texts: DataFrame, fit: Fit, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """_pred, _entropy, _score and _size beside the columns ``keep`` of ``texts``."""
    size = texts.agg(F.sum(F.length(text_col))).first()[0] or 0
    dealt = _dealt(texts, 1 + max(min(_LEAST_BLOCKS, size // _SMALL), size // _BLOCK), id_col, text_col)
    known = _wanted(dealt, text_col).join(fit.nodes, ["order", "gram"]).select("_block", "order", "gram", *_VALUES)
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    shared = Fit(fit.names, fit.discounts, fit.letters)

    def run(packed: pa.Table, nodes: pa.Table) -> pa.Table:
        rows = pa.concat_tables(_unpacked(packed.column("_rows")))
        best, entropy, score, size = LanguageModels.of(shared, nodes).judge(rows.column(text_col))
        names = [shared.names[b] if b >= 0 else "und" for b in best]
        give_back()  # before the next block comes
        return pa.Table.from_arrays([*(rows.column(c) for c in keep), pa.array(names, pa.string()), pa.array(entropy), pa.array(score), pa.array(size)], [*keep, "_pred", "_entropy", "_score", "_size"])

    return dealt.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(run, f"{fields}, _pred string, _entropy double, _score double, _size long")


def _bin(size):
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def _limits(judged: DataFrame, names: list[str], quantile: float, slack: float) -> DataFrame:
    """(_pred, _bin, _limit) from training rows, for each language and length."""
    rows = judged.filter("not _held_out and _pred = _lang").groupBy("_pred", _bin("_size").alias("_bin"))
    found = rows.agg(F.count("*").alias("n"), (F.percentile_approx("_entropy", quantile, 10_000) * slack).alias("limit")).collect()  # languages times lengths
    every, out = [r.limit for r in found], []
    for name in names:
        own = {r._bin: r.limit for r in found if r._pred == name and r.n >= _ENOUGH}
        some = [r.limit for r in found if r._pred == name] or every
        for k in range(_BINS):
            near = [own[max(b)] for b in [[x for x in own if x <= k]] if b] + [own[min(b)] for b in [[x for x in own if x >= k]] if b]
            limit = own.get(k, max(near or some, default=float("inf")))
            out.append((name, k, float(limit)))
    return judged.sparkSession.createDataFrame(out, "_pred string, _bin int, _limit double")


def _decided(docs: DataFrame, quantile: float, slack: float, id_col: str, text_col: str, lang_col: str, keep: Column, keep_text: bool = False) -> DataFrame | None:
    """_row (``keep`` of each row), _text if it is kept, _held_out, _pred, _entropy, _score and _rejected; None if nothing can be learned."""
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1
    # Rows travel as one column, so that no name of theirs meets one of these.
    texts = docs.select(keep.alias("_row"), held_out.alias("_held_out"), F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fit = fit_languages(texts.filter("not _held_out").select(F.col("_lang").alias("lang"), F.col("_text").alias("text")))
    if fit is None:
        return None
    judged = written(_judged(texts, fit, "_id", "_text", ["_row", "_held_out", "_lang"] + ["_text"] * keep_text), "judged")
    limits = _limits(judged, fit.names, quantile, slack)
    found = judged.withColumn("_bin", _bin("_size")).join(F.broadcast(limits), ["_pred", "_bin"], "left")  # languages times lengths
    return found.withColumn("_rejected", (F.col("_pred") == "und") | F.coalesce(F.col("_entropy") > F.col("_limit"), F.lit(False)))


def identify_languages(docs: DataFrame, quantile: float = 0.9995, slack: float = 1.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected, entropy.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out: nothing is learned from them.
    """
    found = _decided(docs, quantile, slack, id_col, text_col, lang_col, F.col(id_col))
    if found is None:
        held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1
        return docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(float("inf")).alias("entropy"))
    return found.select(F.col("_row").alias("doc_id"), *(F.col(f"_{c}").alias(a) for c, a in (("held_out", "held_out"), ("pred", "lang_pred"), ("score", "score"), ("rejected", "rejected"), ("entropy", "entropy"))))


def keep_identified(docs: DataFrame, quantile: float = 0.9995, slack: float = 1.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, unchanged."""
    # A text travels once, outside the row that it belongs to.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    found = _decided(docs, quantile, slack, id_col, text_col, lang_col, row, keep_text=True)
    if found is None:
        return docs.limit(0)
    return found.filter("not _rejected").select(*((F.col("_text") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns))
