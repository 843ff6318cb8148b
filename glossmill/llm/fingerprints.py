"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions alone.

A fingerprint is a small table of cells in three parts. Each distinct paragraph (line or
sentence) is a 64-bit digest that goes to one cell of each part; a cell has the number of its
digests and the exclusive-or of the digests and of their check sums. Two fingerprints subtract
cell by cell, so that common paragraphs vanish. Peeling recovers the others: a cell that holds
one digest, by its check sum, gives it away, and the digest is taken out of its other cells;
parts take turns, so that no digest is taken twice. If cells are left in the end, the difference
was too large, and the digests go to wider sketches, with other places, until all is recovered.

Sketches are rows (one for each cell in use, so that wide sketches cost no more than narrow ones):
digests are exploded to cells, cells are summed by hash aggregation, and each turn of peeling is one
more explode and sum. All of it is grouped by the bucket of a row first, by which texts are
partitioned once; no cell is ever shuffled.

Neighbours are found without a global sort: ids are cut into buckets of about equal bytes at
quantiles, and a bucket's first row is sent to the bucket before it too. The quantiles come from a
sample, which moves the borders only; all rows of an id share a bucket.

Defined cases: a null text is empty, as is the text of no paragraphs; two empty texts are alike
(1); ids are whole numbers, however far apart; rows without an id come last; rows that share an id
are ordered by their text's hash; the only row is its own neighbour. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

PARTS = 3
#: Where a paragraph ends.
PARAGRAPH = r"\n+|(?<=[.!?]) "
#: Kinds of cells: a text's, its edited text's and its neighbour's fingerprint, and two differences.
TEXT, EDITED, NEXT, TO_EDITED, TO_NEXT, ROW = range(6)
#: Cells below 0 hold the digests that were found, and what is known of the row.
FOUND, KNOWN = -1, -2
_SAMPLE = 1 << 20
_WEIGHT = 1 << 16
_FEW = 100_000  # rows whose ids and hashes go to all texts


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of the paragraphs of a text."""
    parts = F.filter(F.split(text, PARAGRAPH, -1), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(97))


def _place(key: Column, width: Column, part: int, seed: int) -> Column:
    """The cell of a digest in one part; cells count through the parts."""
    return F.pmod(F.xxhash64(key, F.lit(seed + part)), width) + width * part


def _cell(at: Column, n: Column, k: Column, h: Column, digest: Column | None = None) -> Column:
    return F.struct(at.cast("long").alias("cell"), (F.lit(None) if digest is None else digest).cast("long").alias("digest"), n.cast("long").alias("n"), k.alias("k"), h.alias("h"))


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the same place as one; empty ones go."""
    cells = rows.groupBy(*keys, "kind", "width", "known", "cell", "digest").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return cells.filter("cell < 0 or n != 0 or k != 0 or h != 0")


def sketches(rows: DataFrame, keys: list[str], wanted: list[tuple[int, Column, int, Column]], seed: int = 0, known: Column | None = None) -> DataFrame:
    """The cells of each row's digests: ``wanted`` has (kind, width, sign, array of digests), and a
    null array adds nothing. ``known`` travels with the row in a cell of its own."""
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("int")
    if known is None:
        known = nothing
    entry = lambda kind, width, sign, own, more: F.struct(F.lit(kind).alias("kind"), width.cast("long").alias("width"), F.lit(sign).alias("sign"), own.alias("own"), more.alias("known"))
    entries = [entry(kind, width, sign, own, F.when(F.lit(False), known)) for kind, width, sign, own in wanted]
    entries.append(entry(ROW, F.lit(1), 0, F.array(zero), known))
    each = rows.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.kind", "e.width", "e.sign", "e.known", F.explode("e.own").alias("key"))
    key, check = F.col("key"), _check(F.col("key"))
    places = F.array(*(_cell(_place(key, F.col("width"), j, seed), F.col("sign"), key, check) for j in range(PARTS)))
    cells = F.when(F.col("kind") == ROW, F.array(_cell(F.lit(KNOWN), zero, zero, zero))).otherwise(places)
    return _summed(each.select(*keys, "kind", "width", "known", F.explode(cells).alias("c")).select(*keys, "kind", "width", "known", "c.*"), keys)


def subtract(cells: DataFrame, keys: list[str], differences: dict[int, tuple[int, int]]) -> DataFrame:
    """``cells`` and, for each difference, the cells of one kind less those of another."""
    kind, goes = F.col("kind"), []
    for to, (one, other) in differences.items():
        goes.append(F.when(kind.isin(one, other), F.struct(F.lit(to).alias("kind"), F.when(kind == one, F.col("n")).otherwise(-F.col("n")).alias("n"))))
    goes = F.array_compact(F.array(F.struct("kind", "n"), *goes))
    rest = [c for c in cells.columns if c not in ("kind", "n")]
    return _summed(cells.select(*rest, F.explode(goes).alias("g")).select(*rest, "g.*"), keys)


def peel(cells: DataFrame, keys: list[str], kinds: tuple[int, ...], turns: int, seed: int = 0, keep: bool = False) -> DataFrame:
    """The cells left of each difference after so many turns, and what was found: the number of
    digests in the cell ``FOUND``, or with ``keep`` one such cell for each digest, its n the side."""
    zero = F.lit(0).cast("long")
    key, width, n = F.col("k"), F.col("width"), F.col("n")
    for turn in range(turns):
        part = turn % PARTS
        inside = (F.col("cell") >= width * part) & (F.col("cell") < width * (part + 1)) & F.col("kind").isin(*kinds)
        pure = inside & (F.abs(n) == 1) & (F.col("h") == _check(key))
        found = _cell(F.lit(FOUND), n if keep else F.lit(1), zero, zero, key if keep else None)
        others = [_cell(_place(key, width, j, seed), -n, key, F.col("h")) for j in range(PARTS) if j != part]
        same = F.struct("cell", "digest", "n", "k", "h")
        moved = cells.select(*keys, "kind", "width", "known", F.explode(F.when(pure, F.array(found, *others)).otherwise(F.array(same))).alias("c"))
        cells = _summed(moved.select(*keys, "kind", "width", "known", "c.*"), keys)
    return cells


def _differing(kind: int) -> Column:
    """How many digests of a row's difference were found; null if cells are left."""
    mine = F.col("kind") == kind
    return F.when(~F.max(F.coalesce(mine & (F.col("cell") >= 0), F.lit(False))), F.coalesce(F.sum(F.when(mine & (F.col("cell") == FOUND), F.col("n"))), F.lit(0)))


def _fingerprint(kind: int) -> Column:
    """The cells in use, in order: place, number, digests, check sums."""
    cells = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("cell", "n", "k", "h"))))
    packed = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["cell"]), 2, "0"), F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 16, "0")))
    return F.base64(F.unhex(F.array_join(packed, "")))


def _bucket_bounds(rows: DataFrame, bucket_bytes: int, most: int) -> list[int]:
    """Ids that cut the rows of (doc_id, size) into buckets of about ``bucket_bytes``."""
    n, size = rows.agg(F.count("*"), F.sum("size")).first()
    buckets = min(most, -(-(size or 0) // bucket_bytes), n)
    if buckets < 2:
        return []
    every = -(-n // _SAMPLE)
    sample = rows.filter("doc_id is not null").filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    weighed = sample.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.least("size", F.lit(16 * bucket_bytes)) / _WEIGHT).cast("int"))))
    cuts = weighed.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets))).first()[0]
    return sorted(set(cuts or []))


def with_next(docs: DataFrame, bucket_bytes: int = 4 << 20, most_buckets: int = 1 << 14) -> DataFrame:
    """Each row of (doc_id, text) with its neighbour, by descending id, after the last the first:
    bucket, place (in the bucket), doc_id, t, text, next_id, next_t and next_text. Rows of a
    bucket are in one partition. Where ``most_buckets`` do not do, buckets are larger, and spill."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    bounds = _bucket_bounds(rows.select("doc_id", (F.octet_length("text") + 64).cast("long").alias("size")), bucket_bytes, most_buckets)
    steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)))
    cuts = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array(F.lit(None).cast("long"))
    # How many cuts are at most the id, by halving; rows without an id are below them all.
    below = F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= len(bounds)) & (F.try_element_at(cuts, i + s) <= F.col("doc_id")), i + s).otherwise(i))
    at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below + 1)
    tops = {r.at: r.top for r in rows.select(at.alias("at"), F.struct("doc_id", "t").alias("row")).groupBy("at").agg(F.max("row").alias("top")).collect()}  # a row a bucket
    number = {a: i for i, a in enumerate(sorted(tops))}
    n = len(number) or 1
    ordered = [tops[a] for a in sorted(tops)] or [None]
    numbers = F.array(*(F.lit(number.get(i, 0)) for i in range(len(bounds) + 2)))
    ids = F.array(*(F.lit(t.doc_id if t else None).cast("long") for t in ordered))
    hashes = F.array(*(F.lit(t.t if t else 0).cast("long") for t in ordered))
    rows = rows.withColumn("bucket", F.element_at(numbers, at + 1))
    first = F.col("doc_id").eqNullSafe(F.element_at(ids, F.col("bucket") + 1)) & (F.col("t") == F.element_at(hashes, F.col("bucket") + 1))
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    above = F.struct(F.pmod(F.col("bucket") + 1, F.lit(n)).alias("bucket"), F.lit(True).alias("guest"))
    rows = rows.withColumn("goes", F.explode(F.when(first, F.array(home, above)).otherwise(F.array(home)))).select("goes.bucket", "goes.guest", "doc_id", "t", "text")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("t").desc())
    rows = rows.repartition(n, "bucket").withColumn("place", F.row_number().over(order))
    following = [F.lead(c).over(order).alias(f"next_{name}") for c, name in (("doc_id", "id"), ("t", "t"), ("text", "text"))]
    return rows.select("*", *following).filter("not guest").drop("guest")


def _edited(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of (text, next_text): n_chars, edited_sha256, and the digests a, e and b of the text, the
    edited text and the next; other columns are those in ``keys``."""
    third = F.expr("cast(floor(length(text) / 3) as int)")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    return rows.select(*keys, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *(digests(F.col(c)).alias(k) for c, k in (("text", "a"), ("edited", "e"), ("next_text", "b"))))


def _wider(rows: DataFrame, keys: list[str], room: int, seed: int, known: Column) -> DataFrame:
    """The cells left of the differences that are not known yet (``to_edited`` and ``to_next`` are
    null), after peeling sketches of ``room`` cells a part for each digest."""
    wanted = []
    for kind, name, other in ((TO_EDITED, "to_edited", "e"), (TO_NEXT, "to_next", "b")):
        width = room * (F.size("a") + F.size(other)) + 16 * room
        for sign, side in ((1, "a"), (-1, other)):
            wanted.append((kind, width, sign, F.when(F.col(name).isNull(), F.col(side))))
    cells = sketches(rows, keys, wanted, seed, known)
    return peel(cells, keys, (TO_EDITED, TO_NEXT), 6, seed)


def _likeness(differ: str, other: str) -> Column:
    total = F.col("n_a") + F.col(other)
    return F.when(total == 0, 1.0).otherwise((total - F.col(differ)) / (total + F.col(differ)))


def fingerprint_edits(docs: DataFrame, width: int = 8, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20) -> DataFrame:
    """Per row: doc_id, n_chars; edited_sha256 of the text whose last third is replaced by as much of
    the next; both fingerprints; near_edited and near_next: the likeness to the edited and the next text.

    Fingerprints of ``width`` (up to 80) cells a part are subtracted and peeled first; where they hold too little,
    sketches with room for all digests are, and for what is left (rows in a hundred thousand) ever wider ones.
    """
    if PARTS * width > 255:
        raise ValueError("a fingerprint has 255 cells at most")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = ["bucket", "place"]
    names = ["doc_id", "t", "next_id", "next_t"]
    rows = _edited(with_next(docs, bucket_bytes), keys + names)

    known = F.struct(*names, "n_chars", "edited_sha256", "a", "e", "b")
    cells = sketches(rows, keys, [(kind, F.lit(width), 1, F.col(c)) for kind, c in ((TEXT, "a"), (EDITED, "e"), (NEXT, "b"))], known=known)
    cells = peel(subtract(cells, keys, {TO_EDITED: (TEXT, EDITED), TO_NEXT: (TEXT, NEXT)}), keys, (TO_EDITED, TO_NEXT), 3 * PARTS)
    rows = cells.groupBy(*keys).agg(
        _differing(TO_EDITED).alias("to_edited"), _differing(TO_NEXT).alias("to_next"), _fingerprint(TEXT).alias("fingerprint"), _fingerprint(EDITED).alias("edited_fingerprint"), F.first("known", True).alias("known")
    ).select(*keys, "to_edited", "to_next", "fingerprint", "edited_fingerprint", "known.*")

    sizes = [F.size(c).alias(f"n_{c}") for c in "aeb"]
    known = F.struct(*names, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "to_edited", "to_next", *sizes)
    cells = _wider(rows, keys, 4, PARTS, known)
    found = cells.groupBy(*keys).agg(_differing(TO_EDITED).alias("e"), _differing(TO_NEXT).alias("x"), F.first("known", True).alias("known"))
    columns = [*names, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "n_a", "n_e", "n_b"]
    found = found.select(*(F.col(f"known.{c}").alias(c) for c in columns), F.coalesce("known.to_edited", "e").alias("to_edited"), F.coalesce("known.to_next", "x").alias("to_next"))
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "fingerprints")

    open_ = found.filter("to_edited is null or to_next is null").select("row", *names, "to_edited", "to_next")
    room, seed, later = 4, PARTS, None
    while not (open_ := written(open_.repartition(8, "row"), "open")).isEmpty():  # few rows
        room, seed = 2 * room, seed + PARTS
        solved = written(_again(docs, open_, room, seed), "wider")
        done = solved.filter("to_edited is not null and to_next is not null")
        later = done if later is None else later.union(done)
        open_ = open_.drop("to_edited", "to_next").join(solved.filter("to_edited is null or to_next is null"), "row")
    if later is not None:
        later = later.select("row", F.col("to_edited").alias("e"), F.col("to_next").alias("x"))
        found = found.join(later, "row", "left").withColumns({"to_edited": F.coalesce("to_edited", "e"), "to_next": F.coalesce("to_next", "x")})
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", _likeness("to_edited", "n_e").alias("near_edited"), _likeness("to_next", "n_b").alias("near_next"))


def _again(docs: DataFrame, open_: DataFrame, room: int, seed: int) -> DataFrame:
    """(row, to_edited, to_next) of some rows with wider sketches; their texts are fetched by id and hash.
    Up to ``_FEW`` rows are sent to the texts, which stay where they are; more meet them in a shuffle."""
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("i", "text", F.xxhash64("text").alias("h"))
    asked, few = open_, open_.count() <= _FEW
    for name, of in (("text", ("doc_id", "t")), ("next_text", ("next_id", "next_t"))):
        wanted = asked.select(*of).distinct().toDF("d", "t")
        own = texts.join(F.broadcast(wanted) if few else wanted, F.col("i").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t"))).groupBy("i", "h").agg(F.first("text").alias(name))
        open_ = open_.join(own, F.col(of[0]).eqNullSafe(F.col("i")) & (F.col(of[1]) == F.col("h"))).drop("i", "h")
    rows = _edited(open_, ["row", "to_edited", "to_next"])
    cells = _wider(rows, ["row"], room, seed, F.struct("to_edited", "to_next"))
    found = cells.groupBy("row").agg(_differing(TO_EDITED).alias("e"), _differing(TO_NEXT).alias("x"), F.first("known", True).alias("known"))
    return found.select("row", F.coalesce("known.to_edited", "e").alias("to_edited"), F.coalesce("known.to_next", "x").alias("to_next"))
