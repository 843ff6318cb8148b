"""Common runs by automaton, and mailboxes that are read in splits."""

import random
import time

from pyspark.sql import functions as F

from glossmill.operators import summaries
from glossmill.sources import mailbox


def longest(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = last[j] + 1
        best, last = max(best, *now), now
    return best


def test_common_runs_are_the_longest():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 25))] for _ in "ab")
        assert summaries.common_run(a, b) == longest(a, b)


def test_common_runs_take_linear_time():
    rng = random.Random(2)

    def seconds(n):
        a, b = ([rng.choice(["x", "y", "z"]) for _ in range(n)] for _ in "ab")
        began = time.perf_counter()
        summaries.common_run(a, b)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 40 * max(seconds(10_000), 0.005)
    assert summaries.common_run(["x"] * 50_000, ["x"] * 49_000 + ["y"]) == 49_000


def test_a_mailbox_is_read_in_splits(spark, tmp_path):
    rng = random.Random(3)
    messages = [f"From: a{i}@x.example\nTo: b@y.example\nSubject: number {i}\nDate: 2024-01-{i % 28 + 1:02d}\n\nbody of {i}\n" + "\n".join("word " * rng.randint(0, 60) for _ in range(rng.randint(1, 9))) for i in range(700)]
    (tmp_path / "one.txt").write_text("\n=====\n".join(messages))
    (tmp_path / "two.txt").write_text("\n=====\n".join(messages[:3]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", "\n=====\n").text(str(tmp_path)).rdd.getNumPartitions() > 20
        found = mailbox.read_split_mailbox(spark, str(tmp_path), "\n=====\n")
        got = sorted(tuple(r) for r in found.select(F.element_at(F.split("source", "/"), -1).alias("f"), "number", "sender", "subject", "text").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = [("one.txt", i, f"a{i}@x.example", f"number {i}", m.split("\n\n", 1)[1]) for i, m in enumerate(messages)]
    expected += [("two.txt", *r[1:]) for r in expected[:3]]
    assert got == sorted(expected)
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    assert sorted(map(tuple, mailbox.parse_messages(whole, "\n=====\n").drop("source", "at").collect())) == sorted(map(tuple, found.drop("source", "at").collect()))
