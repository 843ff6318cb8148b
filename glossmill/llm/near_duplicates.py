"""Near-duplicate documents: MinHash with tensored banding, verified on full shingle sets.

A document has m small collections of r minhashes each; a table key joins two of them, so
m*(m-1)/2 tables of 2r minhashes need m*r minhash functions only. m follows from the
similarity: the least number at which two documents just similar enough share no table with a
chance of 1e-5 at most.

Documents of equal shingle sets are one class from the start, and classes are numbered. A
collection value that only one class has can be in no shared key, so keys are formed from the
others. In each bucket every class is compared with its lead, the class with most copies; links
join classes to components. A bucket is settled when all its classes but the leads it had are of
one component; else another lead is taken. What ``STARS`` rounds, or fewer that settle little, leave open is settled exactly:
those classes are joined on the rarest shingles of each (a similar pair must share one of them),
with bounds by size and position, only across components, and in blocks where a shingle is
frequent. Sizes rule pairs out before sets are fetched, and only classes that share a bucket have
their sets made.

Defined cases: a document with fewer words than a shingle has its whole sequence as the one
shingle; a null, empty or blank text has none and links with nothing; rows without an id share
the component of what they link with, which is null if no row there has an id; rows that share
an id are documents of their own; ``drop_near_duplicates`` keeps one row of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graphs import components
from ..scratch import Rounds, written
from .memory import tidy
from .words import NOT_SPACE, WordKey, Words, mix, signed, window_hashes, words_of

ROWS = 3
#: Rounds of leads before what is open is settled by rare shingles.
STARS = 4
#: Share of the rows of buckets that a round may leave open for another one to follow.
SETTLING = 0.9
#: Classes of a shingle that meet in one place.
_TOGETHER = 2000
#: Places to which the classes of a component are dealt.
_PLACES = 32


def collections_for(similarity: float, rows: int = ROWS, miss: float = 1e-5) -> int:
    """The least m at which fewer than two of m collections agree with a chance of ``miss`` at most."""
    p, m = similarity**rows, 2
    while (1 - p) ** m + comb(m, 1) * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def _shingle_sets(part: Words, k: int, key: WordKey) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in a row, and where each row's begin."""
    words = part.hashes(key)
    all_ = window_hashes(words, k)
    sets = []
    for a, b in zip(part.bounds[:-1], part.bounds[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(all_[a : b - k + 1]))
        elif b > a:
            sets.append(window_hashes(words[a:b], b - a) + np.uint64(b - a))
        else:
            sets.append(words[:0])
    return np.concatenate([*sets, words[:0]]), np.cumsum([0, *map(len, sets)])


def _reduced(op: np.ufunc, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """op over each row's values; 0 for rows without any."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.diff(bounds) > 0
    if full.any():
        out[full] = op.reduceat(values, bounds[:-1][full])
    return out


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(values)))


def _digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = _reduced(np.add, mix(values), bounds)
    two = _reduced(np.add, mix(values ^ np.uint64(0x5851F42D4C957F2D)), bounds)
    return signed(one), signed(two)


def _pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))


def signatures(docs: DataFrame, m: int, k: int, seed: int, key: WordKey, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, the digest d1 and d2 of the shingle set, its m collections."""
    pairs = _pairs(docs, id_col, text_col)
    rng = np.random.default_rng(seed)
    flips = rng.integers(0, 1 << 63, m * ROWS, np.uint64)
    factors = rng.integers(0, 1 << 63, m * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words_of(batch.column("text"), NOT_SPACE, True):
                values, bounds = _shingle_sets(part, k, key)
                d1, d2 = _digests(values, bounds)
                halves = np.empty((part.rows, m), np.uint64)
                work = np.empty_like(values)
                for i in range(m):
                    half = np.full(part.rows, i + 1, np.uint64)
                    for j in range(i * ROWS, i * ROWS + ROWS):
                        np.bitwise_xor(values, flips[j], out=work)
                        np.multiply(work, factors[j], out=work)
                        half = mix(half * np.uint64(0x9E3779B97F4A7C15) + _reduced(np.minimum, work, bounds))
                    halves[:, i] = half
                rows = batch.slice(part.first, part.rows)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text_hash"), pa.array(n), pa.array(d1), pa.array(d2), _lists(halves[n > 0].ravel(), np.cumsum([0, *np.where(n > 0, m, 0)]))],
                    ["doc_id", "text_hash", "n_shingles", "d1", "d2", "halves"],
                )

    id_type = pairs.schema["doc_id"].dataType.simpleString()
    return pairs.mapInArrow(tidy(run), f"doc_id {id_type}, text_hash long, n_shingles long, d1 long, d2 long, halves array<long>")


def shingle_sets(texts: DataFrame, k: int, key: WordKey) -> DataFrame:
    """(c, shingles) of (c, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words_of(batch.column("text"), NOT_SPACE, True):
                values, bounds = _shingle_sets(part, k, key)
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(part.first, part.rows), _lists(values, bounds)], ["c", "shingles"])

    return texts.select("c", "text").mapInArrow(tidy(run), "c long, shingles array<long>")


def _classes(signs: DataFrame) -> DataFrame:
    """One row for each shingle set: its number c, copies, n, least id, a row that has it, halves."""
    full = signs.filter("n_shingles > 0").groupBy("d1", "d2")
    rows = full.agg(
        F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("sample"), F.first("halves").alias("halves")
    )
    return rows.withColumn("c", F.monotonically_increasing_id())


def _table_keys(classes: DataFrame) -> DataFrame:
    """(key, c, copies, n): the table keys of each class that another class might share."""
    halves = classes.select("c", "copies", "n", F.posexplode("halves").alias("i", "u"))
    common = halves.groupBy("i", "u").agg(F.count("*").alias("held")).filter("held > 1").drop("held")
    held = halves.join(common, ["i", "u"], "left_semi").groupBy("c", "copies", "n").agg(F.array_sort(F.collect_list(F.struct("i", "u"))).alias("own"))
    own = F.col("own")
    each = F.transform(
        F.sequence(F.lit(1), F.size("own") - 1),
        lambda a: F.transform(F.slice(own, a + 1, F.size(own)), lambda y: F.xxhash64(F.element_at(own, a), y)),
    )
    return held.filter(F.size("own") > 1).select(F.explode(F.flatten(each)).alias("key"), "c", "copies", "n")


def _size_bound(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair of classes c, d of (c, component, d, other) once, as a < b, with their components ca < cb."""
    rows = pairs.groupBy(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
    return rows.agg(F.min(F.least("component", "other")).alias("ca"), F.min(F.greatest("component", "other")).alias("cb"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components (a, b) of the pairs (a, b, ca, cb) with 100 * intersection >= percent * union. Only sets
    of classes in a pair are moved, and one exchange of them serves both joins; the partners of a class that
    has very many are split by adaptive execution."""
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "named")
    sets = sets.join(named, "c", "left_semi")
    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t")).cast("long")
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("s") + F.size("t") - both)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _across(unsettled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (c, component, d, other) of classes (c, component) of different components: each pair
    that is similar enough is among them. Classes that share a frequent shingle meet block by block."""
    rows = unsettled.join(sets, "c").select("c", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    shared = rows.groupBy("s").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("c").orderBy("df", "s")) - 1
    rows = rows.join(shared, "s").withColumn("p", rank).filter(100 * (F.col("n") - F.col("p")) >= percent * F.col("n")).filter("df > 1")
    rows = written(rows.withColumn("blocks", F.ceil(F.col("df") / _TOGETHER)).withColumn("own", F.pmod(F.xxhash64("c"), "blocks")), "prefixes")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    a = rows.select("s", F.col("own").alias("x"), every.alias("y"), F.col("c").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("p").alias("pa"))
    b = rows.select("s", every.alias("x"), F.col("own").alias("y"), F.col("c").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    near = (
        (F.col("a") < F.col("b"))
        & (F.col("ca") != F.col("cb"))
        & _size_bound("na", "nb", percent)
        & ((100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= percent * (F.col("na") + F.col("nb")))
    )
    return a.join(b, (a.s == b.s) & (a.x == b.x) & (a.y == b.y) & near).select(F.col("a").alias("c"), F.col("ca").alias("component"), F.col("b").alias("d"), F.col("cb").alias("other"))


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the component of their class c, by default itself."""
    return rows.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))


def _stars(rows: DataFrame) -> DataFrame:
    """``rows`` (key, c, copies, n, component) of the buckets that hold several components, with each
    bucket's lead and whether the row is that."""
    leads = rows.groupBy("key").agg(F.max(F.struct("copies", "c", "n", "component")).alias("lead"), F.min("component").alias("x"), F.max("component").alias("y"))
    return rows.join(leads.filter("x != y").drop("x", "y"), "key").withColumn("leads", F.col("c") == F.col("lead.c"))


def _links(classes: DataFrame, texts: DataFrame, percent: int, shingle: int, key: WordKey) -> DataFrame:
    """(node, component) of the classes that are linked."""
    rounds = Rounds(classes.sparkSession, "stars")
    keys = rounds.written(_table_keys(classes).withColumn("component", F.col("c")))
    stars = rounds.written(_stars(keys))
    sample = written(classes.join(stars.select("c").distinct(), "c", "left_semi").select("c", F.col("sample.doc_id").alias("i"), F.col("sample.text_hash").alias("h")), "sample")
    # The sample grows with the collection: the plan is that of a large one at every size.
    texts = texts.join(sample.hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    sets = written(shingle_sets(texts, shingle, key).groupBy("c").agg(F.first("shingles").alias("shingles")), "sets")

    found = compared = None
    left = stars.count()
    for _ in range(STARS):
        pairs = stars.filter((F.col("component") != F.col("lead.component")) & _size_bound("n", "lead.n", percent))
        pairs = _once(pairs.select("c", "component", F.col("lead.c").alias("d"), F.col("lead.component").alias("other")))
        pairs = written(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        compared = pairs.select("a", "b") if compared is None else compared.union(pairs.select("a", "b"))
        links = _verified(pairs, sets, percent)
        found = components(links if found is None else links.union(found))
        stars = rounds.written(_stars(_named(stars.filter("not leads").select("key", "c", "copies", "n"), found)))
        before, left = left, stars.count()
        if not left:
            return found
        if left > SETTLING * before:
            break
    unsettled = written(stars.select("c", "component").distinct(), "unsettled")
    pairs = _once(_across(unsettled, sets, percent)).join(compared, ["a", "b"], "left_anti")
    return components(_verified(written(pairs, "pairs"), sets, percent).union(found))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable over links of
    similarity percent/100 or more), kept (doc_id is component_id), text_hash, and the number
    ``component`` of its component, null without shingles."""
    key = WordKey.drawn()
    signs = written(signatures(docs, collections_for(percent / 100), shingle, seed, key, id_col, text_col), "signatures")
    classes = written(_classes(signs), "classes")
    found = _links(classes, _pairs(docs, id_col, text_col), percent, shingle, key)
    named = written(_named(classes.select("c", "d1", "d2", "first_id"), found), "named")
    place = F.pmod(F.xxhash64("c"), F.lit(_PLACES)).cast("int").alias("place")
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = ids.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(_PLACES - 1))))
    ids = named.withColumn("place", place).join(ids, ["component", "place"]).select("d1", "d2", "component", "component_id")
    linked = signs.filter("n_shingles > 0").join(ids, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", "text_hash", "component")
    alone = signs.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("long").alias("component"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each component; texts without words all stay.

    The rows that go are named by id and text hash, and taken out by one anti join; only of rows
    that stay and come several times one is picked.
    """
    found = written(near_duplicates(docs, percent, shingle, seed, id_col, text_col).filter("component is not null").select("component", "kept", "doc_id", "text_hash"), "components")
    own = F.struct("doc_id", "text_hash")
    kept = found.filter("kept")  # of most components one row
    stays = kept.groupBy(F.col("component").alias("_c")).agg(F.min(own).alias("_own")).select("_c", F.col("_own.doc_id").alias("_d"), F.col("_own.text_hash").alias("_t"))
    others = kept.join(stays, (F.col("component") == F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left_anti")
    key = F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")
    gone = written(found.filter("not kept").select(*key).union(others.select(*key)).distinct(), "gone")
    again = kept.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    again = written(again.join(gone, ["_i", "_h"], "left_anti"), "again")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_h"))
    stay = rows.join(gone, same, "left_anti")
    if again.isEmpty():
        return stay.select("_row.*")
    once = stay.join(again, same, "left_semi").groupBy("_id", "_text").agg(F.first("_row").alias("_row"))
    return stay.join(again, same, "left_anti").select("_row.*").union(once.select("_row.*"))
