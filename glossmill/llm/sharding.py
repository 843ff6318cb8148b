"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

A seeded hash of the id picks the shard so that one more shard takes rows only into itself:
shard i takes a row from the lesser ones with a chance of 1/(i+1), decided by the id, and the
last shard that takes it has it. The first pass scatters the rows of a shard uniformly into
buckets that fit in memory, by another seeded hash; how many follows from the bytes of the
shard. The second pass reads one bucket at a time, brings it into a fixed order, shuffles it
(Spark's ``shuffle`` is a Fisher-Yates shuffle, seeded by the partition, whose number follows from
the bytes) and numbers its rows after those of the buckets before it.

Defined cases: a null text has no bytes; rows without an id share a shard; rows that share an
id share its shard, and where they would overfill a bucket they are scattered by a random salt
that is written first; repeated rows are kept as often as they come. Columns of any type and
name travel in the struct ``record``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

ROW_BYTES = 16
#: Buckets whose beginnings (24 bytes each) may go to all tasks.
_MOST_SENT = 1 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard of a key among ``shards``."""
    taken = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.pmod(F.xxhash64(key, i, F.lit(seed)), (i + 1).cast("long")) == 0)
    return F.array_max(taken)


def shard_records(docs: DataFrame, shards: int = 40, seed: int = 11, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """Each row as ``record`` with its size, shard, grown_shard (with one shard more), bucket and
    slot: its number in the shard after the shuffle. With ``in_order`` partitions ascend by shard and slot."""
    key = F.col(id_col)
    more = F.pmod(F.xxhash64(key, F.lit(shards), F.lit(seed)), F.lit(shards + 1).cast("long")) == 0
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"),
        F.xxhash64(key, F.lit(seed), F.lit("bucket")).alias("scatter"),
        F.xxhash64(key, F.col(text_col)).alias("order"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        shard_of(key, shards, seed).alias("shard"),
        more.alias("more"),
    )
    held = {r.shard: r.bytes for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # a row a shard
    buckets = F.array(*(F.lit(max(1, -(-held.get(i, 0) // bucket_bytes))) for i in range(shards)))
    bucket = F.pmod("scatter", F.element_at(buckets, F.col("shard") + 1).cast("long")).cast("int")
    placed = rows.withColumn("bucket", bucket)
    filled = written(placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "buckets")
    if filled.filter((F.col("bytes") > 4 * bucket_bytes) & (F.col("n") > 1)).limit(1).count():
        rows = written(rows.withColumn("scatter", F.xxhash64("scatter", F.floor(F.rand(seed) * (1 << 30)))), "scattered")
        placed = rows.withColumn("bucket", bucket)
        filled = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = filled.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))

    parts = max(1, sum(-(-b // bucket_bytes) for b in held.values()))
    if in_order:
        if parts > _MOST_SENT:
            raise ValueError(f"ordered shards have {_MOST_SENT} buckets at most: raise bucket_bytes")
        begins = F.broadcast(begins)
    dealt = (placed.repartitionByRange if in_order else placed.repartition)(parts, "shard", "bucket")
    whole = dealt.groupBy("shard", "bucket").agg(F.collect_list(F.struct("order", "more", "size", "record")).alias("rows"))
    ordered = F.array_sort("rows", lambda a, b: F.when(a.order < b.order, -1).when(a.order > b.order, 1).otherwise(0))
    whole = whole.join(begins, ["shard", "bucket"]).select("shard", "bucket", "begins", ordered.alias("rows")).sortWithinPartitions("shard", "bucket")
    drawn = whole.select("shard", "bucket", "begins", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
    return drawn.select(
        "row.record", "row.size", "shard", F.when(F.col("row.more"), F.lit(shards)).otherwise(F.col("shard")).alias("grown_shard"), "bucket", (F.col("begins") + F.col("at")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shards as Parquet, a folder a shard; files by name, and rows in them, are in the order of ``slot``."""
    rows = shard_records(docs, in_order=True, **options)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
