"""Backup and restore of tables, with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import upsert


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as Parquet under ``path`` (binary columns left out) and a manifest (name, columns, n_rows)."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        kept = [c for c, kind in df.dtypes if kind != "binary"]
        df.select(*kept).write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, kept, spark.read.parquet(f"{path}/{name}").count()))
    manifest = spark.createDataFrame(rows, "name string, columns array<string>, n_rows long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest_table")
    return manifest


def restore(spark: SparkSession, path: str, names: list[str] | None = None, into: dict[str, DataFrame] | None = None, keys: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Tables of a backup, all or those named; where ``into`` has a table, its rows of equal key are replaced."""
    there = [r.name for r in spark.read.parquet(f"{path}/_manifest_table").select("name").collect()]  # a row a table
    out = {n: spark.read.parquet(f"{path}/{n}") for n in there if names is None or n in names}
    for name, df in (into or {}).items():
        if name in out:
            out[name] = upsert(df, out[name], (keys or {})[name])
    return out
