"""Networks as text for graph viewers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import numbered


def vertices(edges: DataFrame) -> DataFrame:
    """(name, vertex): the ends of (source, target, n), numbered by name from 1."""
    names = edges.select(F.lower("source").alias("name")).union(edges.select(F.lower("target"))).filter("name is not null").distinct()
    return numbered(names, ["name"], "vertex")


def network_lines(edges: DataFrame) -> DataFrame:
    """(section, key, line) of the network's file: vertices, then arcs."""
    ids = vertices(edges)
    label = F.regexp_replace("name", "@.*$", "")
    points = ids.select(F.lit(1).alias("section"), F.col("vertex").alias("key"), F.format_string('%d "%s"', "vertex", label).alias("line"))
    low = edges.groupBy(F.lower("source").alias("source"), F.lower("target").alias("target")).agg(F.sum("n").alias("n"))
    arcs = low.join(ids.toDF("source", "a"), "source").join(ids.toDF("target", "b"), "target")
    lines = arcs.select(F.lit(3), (F.col("a") * 1_000_000_000 + F.col("b")), F.format_string("%d %d %d", "a", "b", "n"))
    heads = edges.sparkSession.createDataFrame([(0, 0, f"*Vertices {ids.count()}"), (2, 0, "*Arcs")], "section int, key long, line string")
    return points.union(lines).union(heads)


def compressed_columns(matrix: DataFrame) -> DataFrame:
    """(section, key, line) of a matrix (term, doc_id, value) in the compressed-column exchange form: the sizes,
    where each column begins, the row of each value, the values. Terms and columns are numbered from 1 in order."""
    cells = matrix.filter("value != 0")
    rows = numbered(cells.select("term").distinct(), ["term"], "i")
    columns = numbered(cells.select("doc_id").distinct(), ["doc_id"], "j")
    placed = numbered(cells.join(rows, "term").join(columns, "doc_id").select("i", "j", "value"), ["j", "i"], "k")
    starts = placed.groupBy("j").agg(F.min("k").alias("k"), F.max("k").alias("last"))
    n = placed.agg(F.max("i"), F.max("j"), F.count("*")).first()
    head = matrix.sparkSession.createDataFrame([(0, 0, f"{n[0] or 0} {n[1] or 0} {n[2]}"), (1, (n[1] or 0) + 1, str(n[2] + 1))], "section int, key long, line string")
    lines = starts.select(F.lit(1), F.col("j").cast("long"), F.col("k").cast("string")).union(placed.select(F.lit(2), F.col("k").cast("long"), F.col("i").cast("string")))
    return head.union(lines).union(placed.select(F.lit(3), F.col("k").cast("long"), F.col("value").cast("string")))


def write_network(edges: DataFrame, path: str) -> None:
    """The lines in order as text parts."""
    network_lines(edges).repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("line").write.mode("overwrite").text(path)
