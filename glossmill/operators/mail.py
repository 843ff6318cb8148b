"""Message archives: field-weighted vectors, category centroids, networks of correspondents, tasks.

Messages are (id, at, sender, recipient, copy, subject, text, category, ...); absent fields may be
null and count as empty. Ties go to the least id or name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..functions.text import content_digest, content_words
from .inverted_index import page, search
from .vectors import frequency_vectors, l1_normalized, strongest, unit_vectors

# Field weights, limits.
FIELD_WEIGHTS = {"text": 1, "subject": 5, "sender": 5, "recipient": 1, "copy": 1}
VECTOR_TERMS = 100
LEAST_SIMILARITY = 0.2
TASK_SIMILARITY = 0.10
LEAST_WEIGHT = 0.001
MISCELLANEOUS = "Miscellaneous"


def field_terms(messages: DataFrame, id_col: str = "id", weights: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, term, tf): terms of all fields, each as often as its field weighs."""

    def weighted(field: str, k: int) -> Column:
        return F.transform(content_words(F.col(field), "email"), lambda w: F.struct(w.alias("term"), F.lit(k).cast("long").alias("k")))

    parts = [weighted(field, k) for field, k in (weights or FIELD_WEIGHTS).items() if field in messages.columns]
    empty = F.array().cast("array<struct<term:string,k:long>>")
    every = F.flatten(F.array(*(F.coalesce(p, empty) for p in parts)))
    rows = messages.select(F.col(id_col).alias("doc_id"), F.explode(every).alias("e"))
    return rows.groupBy("doc_id", "e.term").agg(F.sum("e.k").alias("tf"))


def message_vectors(messages: DataFrame, id_col: str = "id", terms: int = VECTOR_TERMS) -> DataFrame:
    """(doc_id, term, weight): the strongest terms of each message, summing to 1."""
    return l1_normalized(strongest(frequency_vectors(field_terms(messages, id_col)), terms).drop("rank"))


def centroids(tf: DataFrame, categories: DataFrame, terms: int = VECTOR_TERMS) -> DataFrame:
    """(category, term, weight) of the summed terms of each category (doc_id, category); the
    miscellaneous one has none."""
    known = categories.filter((F.col("category") != MISCELLANEOUS) & F.col("category").isNotNull())
    summed = tf.join(known, "doc_id").groupBy("category", "term").agg(F.sum("tf").alias("tf"))
    vectors = frequency_vectors(summed.withColumnRenamed("category", "doc_id"))
    return l1_normalized(strongest(vectors, terms).drop("rank")).withColumnRenamed("doc_id", "category")


def nearest_centroid(vectors: DataFrame, centres: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(doc_id, category, sim): the most similar centroid; below ``least`` (of twelve
    decimals, so that one that reaches it exactly counts) the miscellaneous category.

    Documents meet centroids on shared terms alone.
    """
    a = unit_vectors(vectors)
    b = unit_vectors(centres.withColumnRenamed("category", "doc_id")).select(F.col("doc_id").alias("category"), "term", F.col("weight").alias("w"))
    sims = a.join(b, "term").groupBy("doc_id", "category").agg(F.sum(F.col("weight") * F.col("w")).alias("sim"))
    best = sims.groupBy("doc_id").agg(F.max(F.round("sim", 12)).alias("top"), F.min(F.struct((-F.round("sim", 12)).alias("s"), "category", "sim")).alias("b"))
    found = vectors.select("doc_id").distinct().join(best, "doc_id", "left")
    near = F.coalesce(F.round("b.sim", 12) >= least, F.lit(False))
    return found.select("doc_id", F.when(near, F.col("b.category").cast("string")).otherwise(F.lit(MISCELLANEOUS)).alias("category"), F.coalesce("b.sim", F.lit(0.0)).alias("sim"))


def moved_centroid(centroid: Column, size: Column, vector: Column, length: Column, add: bool = True, delta: float | Column = 0.0, terms: int = VECTOR_TERMS) -> Column:
    """A map<string,double> after a message joined or left its category.

    The message weighs length * (1 + delta) / (size +- length), the centroid the rest; terms of
    little weight go, the strongest stay, and weights sum to 1.
    """
    if add:
        w = F.least(length * (1.0 + delta) / (size + length), F.lit(1.0))
    else:
        w = F.when(size > length, F.least(length * (1.0 + delta) / (size - length), F.lit(1.0))).otherwise(F.lit(1.0))
    own = F.transform_values(centroid, lambda _, v: v * (1 - w))
    other = F.transform_values(vector, lambda _, v: v * w)
    if add:
        both = F.map_zip_with(own, other, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    else:
        both = F.transform_values(own, lambda k, v: v - F.coalesce(other[k], F.lit(0.0)))
    entries = F.transform(F.map_entries(F.map_filter(both, lambda _, v: v >= LEAST_WEIGHT)), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k")))
    top = F.slice(F.array_sort(entries), 1, terms)
    total = F.aggregate(top, F.lit(0.0), lambda s, e: s - e["w"])
    return F.map_from_entries(F.transform(top, lambda e: F.struct(e["k"], (-e["w"] / total))))


def reweighted(centroid: Column, term: str, weight: float) -> Column:
    """A centroid with one term's weight set and the others scaled so that all sum to 1."""
    rest = F.aggregate(F.map_values(F.map_filter(centroid, lambda k, _: k != term)), F.lit(0.0), lambda s, v: s + v)
    scaled = F.transform_values(F.map_filter(centroid, lambda k, _: k != term), lambda _, v: F.when(rest == 0, v).otherwise(v * (1 - weight) / rest))
    return F.map_concat(scaled, F.create_map(F.lit(term), F.lit(weight)))


def fresh_messages(incoming: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Messages with sender, recipient and time whose (sender, time, digest) is new, each once, with ``digest``."""
    rows = incoming.filter("sender is not null and recipient is not null and at is not null").withColumn("digest", content_digest(F.col("text")))
    key = ["sender", "at", "digest"]
    if archive is not None:
        held = archive.select("sender", "at", content_digest(F.col("text")).alias("digest")).distinct()
        rows = rows.join(held, key, "left_anti")
    order = Window.partitionBy(*key).orderBy("id")
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def archived(incoming: DataFrame, centres: DataFrame, archive: DataFrame | None = None, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """New messages filed: ``messages`` with digest and category, their ``vectors``, and the ``edges`` of the
    network with the new messages added to the counts it had."""
    rows = fresh_messages(incoming, archive)
    vectors = message_vectors(rows)
    found = nearest_centroid(vectors, centres).select(F.col("doc_id").alias("id"), "category")
    placed = rows.drop("category").join(found, "id", "left").withColumn("category", F.coalesce("category", F.lit(MISCELLANEOUS)))
    return {"messages": placed, "vectors": vectors, "edges": added_edges(network_edges(rows), edges)}


def added_edges(new: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(source, target, n): counts of a stored network and new ones summed."""
    both = new if edges is None else edges.select("source", "target", "n").unionByName(new)
    return both.groupBy("source", "target").agg(F.sum("n").alias("n"))


def recategorised(centroids_: DataFrame, moves: DataFrame) -> DataFrame:
    """(category, centroid, size) after messages moved: ``moves`` is (old, new, vector map, length), one
    row a message, ``centroids_`` (category, centroid map, size).

    A message weighs more the more its likeness to the two differs; those that one category loses or wins
    are taken as one message of their mean vector, so the order of moves does not matter.
    """
    own = centroids_.select("category", "centroid", "size")
    old = own.select(F.col("category").alias("old"), F.col("centroid").alias("_from"))
    new = own.select(F.col("category").alias("new"), F.col("centroid").alias("_to"))
    rows = moves.filter("old != new").join(old, "old", "left").join(new, "new", "left")
    none = F.create_map().cast("map<string,double>")
    delta = F.abs(cosine("vector", F.coalesce("_from", none)) - cosine("vector", F.coalesce("_to", none)))
    rows = rows.withColumn("delta", delta)
    every = rows.select(F.col("old").alias("category"), F.lit(False).alias("add"), "vector", "length", "delta").union(rows.select("new", F.lit(True), "vector", "length", "delta"))
    total = every.groupBy("category", "add").agg(F.sum("length").alias("length"), F.avg("delta").alias("delta"), F.count("*").alias("n"))
    terms = every.select("category", "add", F.explode("vector").alias("term", "w")).groupBy("category", "add", "term").agg(F.sum("w").alias("w"))
    terms = terms.join(total, ["category", "add"]).groupBy("category", "add", "length", "delta").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", F.col("w") / F.col("n"))))).alias("vector"))
    out = own
    for add in (False, True):
        side = terms.filter(F.col("add") == add).select("category", "vector", "length", "delta")
        moved = moved_centroid(F.col("centroid"), F.col("size"), F.col("vector"), F.col("length"), add, F.col("delta"))
        size = F.col("size") + F.col("length") * (1 if add else -1)
        out = out.join(side, "category", "left").select("category", F.when(F.col("vector").isNull() | (F.col("category") == MISCELLANEOUS), F.col("centroid")).otherwise(moved).alias("centroid"), F.when(F.col("vector").isNull(), F.col("size")).otherwise(F.greatest(size, F.lit(0))).alias("size"))
    return out


def message_filter(statuses: list[str] | None = None, categories: list | None = None, start: str | None = None, end: str | None = None, at: str = "at") -> Column:
    """A condition on messages (status, category, deleted, at): not deleted, of these statuses and
    categories (None: all), and strictly between two times; messages without a time count where none is asked."""
    out = ~F.coalesce(F.col("deleted"), F.lit(False))
    if statuses is not None:
        out = out & F.coalesce(F.lower("status").isin([s.lower() for s in statuses]), F.lit(False))
    if categories is not None:
        out = out & F.coalesce(F.col("category").isin(categories), F.lit(False))
    if start is not None:
        out = out & (F.col(at) > F.lit(start).cast("timestamp"))
    if end is not None:
        out = out & (F.col(at) < F.lit(end).cast("timestamp"))
    return out


def search_messages(messages: DataFrame, index: DataFrame, query: str, where: Column | None = None, fuzzy: bool = False, number: int = 1, size: int = 10) -> DataFrame:
    """A page of the messages that satisfy a query and ``where`` (``message_filter``), the latest first,
    with weight and position. ``index`` is a stored index: of it only the folders of the words are read."""
    found = search(messages, index, query, fuzzy, message_filter() if where is None else where, "id")
    return page(found, number, size, [F.desc("at"), F.asc("id")])


def addresses(field: Column) -> Column:
    """array<struct<name,address>> of a header field; commas inside quotes do not part."""
    parts = F.regexp_extract_all(field, F.lit(r'((?:"[^"]*"|[^,"])+)'), 1)

    def one(p: Column) -> Column:
        address = F.lower(F.regexp_extract(p, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1))
        name = F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>", ""), '"', ""))
        return F.struct(name.alias("name"), F.when(address == "", F.lower(F.trim(p))).otherwise(address).alias("address"))

    return F.filter(F.transform(parts, one), lambda x: x["address"] != "")


def network_edges(messages: DataFrame, sender: str = "sender", recipient: str = "recipient") -> DataFrame:
    """(source, target, n): directed counts of messages between addresses; ``added_edges`` sums them with stored ones."""
    rows = messages.select(F.explode(addresses(F.col(sender))).alias("s"), F.col(recipient).alias("r")).select("s", F.explode(addresses(F.col("r"))).alias("t"))
    return rows.groupBy(F.col("s.address").alias("source"), F.col("t.address").alias("target")).agg(F.count("*").alias("n"))


def top_correspondents(edges: DataFrame, k: int = 3) -> DataFrame:
    """(target, source, n, rank): who writes most to each address."""
    order = Window.partitionBy("target").orderBy(F.desc("n"), "source")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def weekly_counts(messages: DataFrame, person: str) -> DataFrame:
    """(week, sent, received) of one address."""
    sent = F.count_if(F.lower(F.col("sender")).contains(person.lower()))
    got = F.count_if(F.lower(F.col("recipient")).contains(person.lower()))
    return messages.groupBy(F.date_trunc("week", "at").alias("week")).agg(sent.alias("sent"), got.alias("received")).filter("sent > 0 or received > 0")


def expanded_recipients(recipients: DataFrame, nicknames: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, address): names (id, name) replaced by a list's members (list, address), else by a
    nickname's address (nickname, address), else as they are."""
    low = recipients.select("id", F.lower(F.trim("name")).alias("name"))
    found = low.join(lists.select(F.lower("list").alias("name"), F.col("address").alias("member")), "name", "left")
    found = found.join(nicknames.select(F.lower("nickname").alias("name"), F.col("address").alias("own")), "name", "left")
    return found.select("id", F.coalesce("member", "own", "name").alias("address")).distinct()


#: Places to which the messages of an address in a week are dealt.
_PLACES = 8


def task_windows(tasks: DataFrame, today: str) -> DataFrame:
    """Tasks (id, date, period, ...) with ``from_date`` and ``to_date``: a day around the weekday
    (Weekly), a week around the day of this month (Monthly), a month around the date (Annual), a
    month from a week before (Once)."""
    day = F.to_date(F.lit(today))
    weekday = F.date_add(day, F.pmod(F.weekday("date") - F.weekday(day) + 3, F.lit(7)) - 3)
    monthday = F.least(F.dayofmonth("date"), F.dayofmonth(F.last_day(day)))
    month = F.date_add(F.trunc(day, "month"), monthday - 1)
    period = F.lower("period")
    date = F.to_date("date")
    start = F.when(period == "weekly", F.date_sub(weekday, 1)).when(period == "monthly", F.date_sub(month, 7)).when(period == "annual", F.date_sub(date, 30)).otherwise(F.date_sub(date, 7))
    end = F.when(period == "weekly", F.date_add(weekday, 1)).when(period == "monthly", F.date_add(month, 7)).when(period == "annual", F.date_add(date, 30)).otherwise(F.date_add(date, 23))
    return tasks.withColumn("from_date", start).withColumn("to_date", end)


def task_status(tasks: DataFrame, messages: DataFrame, least: float = TASK_SIMILARITY) -> DataFrame:
    """(id, status): Complete if a message of the address in the window is similar to the description.

    Tasks have id, type (Receive or Send), address, description, from_date and to_date. Tasks and messages of an address
    meet by week and in one of ``_PLACES`` places, so that an address with most of the messages is not one group.
    """
    who = messages.select(
        F.col("id").alias("mail"), F.to_date("at").alias("day"), F.explode(F.array(F.struct(F.lit("receive").alias("type"), F.lower("sender").alias("who")), F.struct(F.lit("send").alias("type"), F.lower("recipient").alias("who")))).alias("e")
    ).select("mail", "day", "e.type", F.explode(F.transform(addresses(F.col("e.who")), lambda a: a["address"])).alias("address"))
    week = lambda day: F.floor(F.unix_date(day) / 7)
    who = who.withColumn("week", week(F.col("day"))).withColumn("place", F.pmod(F.xxhash64("mail"), F.lit(_PLACES)))
    wanted = tasks.select(F.col("id").alias("task"), F.lower("type").alias("type"), F.lower("address").alias("address"), "from_date", "to_date").filter("from_date <= to_date")
    wanted = wanted.withColumn("week", F.explode(F.sequence(week(F.col("from_date")), week(F.col("to_date"))))).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_PLACES - 1).cast("long"))))
    pairs = wanted.join(who, ["type", "address", "week", "place"]).filter(F.col("day").between(F.col("from_date"), F.col("to_date"))).select("task", "mail").distinct()
    words = F.explode(content_words(F.col("description"), "email"))
    described = tasks.select(F.col("id").alias("doc_id"), words.alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    a = unit_vectors(frequency_vectors(described)).select(F.col("doc_id").alias("task"), "term", F.col("weight").alias("x"))
    b = unit_vectors(frequency_vectors(field_terms(messages))).select(F.col("doc_id").alias("mail"), "term", F.col("weight").alias("y"))
    sims = pairs.join(a, "task").join(b, ["mail", "term"]).groupBy("task", "mail").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))
    done = sims.filter(F.col("sim") > least).select("task").distinct().withColumn("done", F.lit(True))
    joined = tasks.join(done, tasks["id"] == done["task"], "left")
    return joined.select("id", F.when(F.col("done"), "Complete").otherwise("Incomplete").alias("status"))


def current_tasks(tasks: DataFrame, today: str) -> DataFrame:
    """Tasks without single ones older than three months; annual dates moved to this year."""
    day = F.to_date(F.lit(today))
    period = F.lower("period")
    kept = tasks.filter(~((period == "once") & (F.to_date("date") < F.add_months(day, -3))))
    rolled = F.add_months(F.to_date("date"), 12 * (F.year(day) - F.year("date")))
    return kept.withColumn("date", F.when(period == "annual", rolled).otherwise(F.to_date("date")))


def category_counts(messages: DataFrame, below: DataFrame) -> DataFrame:
    """(category, n): messages of each category and those under it; ``below`` is (ancestor, node, depth)."""
    rows = messages.groupBy("category").agg(F.count("*").alias("n"))
    return below.join(rows, F.col("node") == F.col("category"), "left").groupBy(F.col("ancestor").alias("category")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def purged(rows: DataFrame, index: DataFrame, flag: str = "deleted", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows and postings without those that are flagged as deleted."""
    gone = rows.filter(F.col(flag)).select(F.col(id_col).alias("doc_id"))
    return rows.filter(~F.coalesce(F.col(flag), F.lit(False))), index.join(gone, "doc_id", "left_anti").select(index.columns)
