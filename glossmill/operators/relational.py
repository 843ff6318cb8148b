"""Relational helpers that keyed tables, trees and lists of a text archive need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The table with the changes in place of rows of the same key; of several changes the last by ``order``."""
    if order:
        last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
        changes = changes.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").select(table.columns).unionByName(changes)


def removed(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table less the rows of these keys."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti").select(table.columns)


def checked_numbers(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose texts in ``columns`` are all numbers or null, and the others."""
    good = reduce(lambda a, b: a & b, (F.col(c).isNull() | F.col(c).rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$") for c in columns), F.lit(True))
    return rows.filter(good), rows.filter(~good)


def unique_or_rejected(table: DataFrame, changes: DataFrame, key: str, unique: str) -> tuple[DataFrame, DataFrame]:
    """The table with changes by ``key``, and the changes that were not made because another row, of the
    table or an earlier change (lesser key), has their value of ``unique`` (as sources have one address each)."""
    held = table.select(F.col(key).alias("_k"), F.col(unique).alias("_u"))
    order = Window.partitionBy(unique).orderBy(key)
    rows = changes.withColumn("_r", F.row_number().over(order))
    clash = rows.join(held, (F.col(unique) == F.col("_u")) & (F.col(key) != F.col("_k")), "left_semi").select(F.col(key).alias("_c")).union(rows.filter("_r > 1").select(key)).distinct()
    good = changes.join(clash, F.col(key) == F.col("_c"), "left_anti")
    bad = changes.join(clash, F.col(key) == F.col("_c"), "left_semi")
    return upsert(table, good, [key]), bad


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregation, without sorting the groups."""
    others = [c for c in rows.columns if c not in keys]
    top = F.max(F.struct(*order, *(c for c in others if c not in order))).alias("top")
    return rows.groupBy(*keys).agg(top).select(*keys, *(F.col(f"top.{c}") for c in others))


def like_pattern(text: str, fuzzy: bool = False) -> str:
    """A LIKE pattern: ``*`` stands for any run, all else for itself; fuzzy looks anywhere."""
    body = "".join("%" if c == "*" else "\\" + c if c in "_%\\" else c for c in text)
    return f"%{body}%" if fuzzy else body


def between_open(column: Column, start, end) -> Column:
    return (column > start) & (column < end)


def between_closed(column: Column, start, end) -> Column:
    return (column >= start) & (column <= end)


def where_all(conditions: dict[str, object]) -> Column:
    """All columns equal to their values; None is met by null."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in conditions.items()), F.lit(True))


def numbered(rows: DataFrame, order: list[str], name: str = "id", first: int = 1) -> DataFrame:
    """Gapless ids by order, without one task for all rows: a range partitioning is counted, then numbered."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    parted = written(parted, "numbered")
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parted.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_before") + first).drop("_p", "_m", "_first", "_before")


def closure(edges: DataFrame, child: str, parent: str, most_levels: int = 64) -> DataFrame:
    """(ancestor, node, depth): each node below each ancestor, itself at depth 0.

    One join for each level; cycles end at ``most_levels`` with an error.
    """
    links = edges.select(F.col(parent).alias("p"), F.col(child).alias("c"))
    nodes = links.select(F.col("c").alias("x")).union(links.select("p")).filter("x is not null").distinct()
    now = nodes.select(F.col("x").alias("ancestor"), F.col("x").alias("node"), F.lit(0).alias("depth"))
    out = now
    for level in range(1, most_levels + 1):
        now = written(now.join(links, F.col("node") == F.col("p")).select("ancestor", F.col("c").alias("node"), F.lit(level).alias("depth")), "level")
        if now.isEmpty():
            return out
        out = out.union(now)
    raise ValueError(f"the tree has more than {most_levels} levels or a cycle")


def orphans_to(rows: DataFrame, removed: DataFrame, category: str, fallback) -> DataFrame:
    """Rows whose category is removed, moved to ``fallback``."""
    gone = removed.select(F.col(category).alias("_gone")).distinct()
    marked = rows.join(gone, F.col(category) == F.col("_gone"), "left")
    return marked.withColumn(category, F.when(F.col("_gone").isNotNull(), F.lit(fallback)).otherwise(F.col(category))).drop("_gone")


def repaired_paths(index: DataFrame, files: DataFrame) -> DataFrame:
    """(id, old_path, path) of entries (id, path, digest) whose file is gone and lies elsewhere:
    equal base name, confirmed by the digest."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    lost = index.join(files.select("path"), "path", "left_anti").withColumn("name", name).withColumnRenamed("path", "old_path")
    found = files.withColumn("name", name).withColumnRenamed("digest", "_digest")
    both = lost.join(found, "name").filter(F.col("digest") == F.col("_digest"))
    return both.groupBy("id", "old_path").agg(F.min("path").alias("path"))


def share_of_total(rows: DataFrame, value: str, by: list[str], name: str = "share") -> DataFrame:
    """Each value divided by the sum of its group."""
    return rows.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*by)))
