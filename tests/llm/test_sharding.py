from collections import Counter, defaultdict

import pytest

from glossmill.llm.sharding import shard_records, write_shards


def rows_of(df):
    return [(r.record.doc_id, r.record.text, r.size, r.shard, r.grown_shard, r.bucket, r.slot) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(corpus):
    return [*corpus, corpus[3], corpus[3], (None, "no id"), (None, None), *((20_000 + i, f"text {i} é") for i in range(1500))]


def test_slots_sizes_and_growth(make_docs, docs):
    rows = rows_of(shard_records(make_docs(docs), shards=7, bucket_bytes=4000))
    assert Counter((d, t) for d, t, *_ in rows) == Counter(docs)
    assert all(size == len((t or "").encode()) + 16 for _, t, size, *_ in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r[3]].append(r[6])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(7))
    counts = [len(s) for s in slots.values()]
    assert max(counts) < 1.5 * min(counts)
    grown = {d: s for d, _, _, s, *_ in rows_of(shard_records(make_docs(docs), shards=8, bucket_bytes=4000))}
    for d, _, _, shard, more, *_ in rows:
        assert grown[d] == more and more in (shard, 7)
    assert 0.5 / 8 < sum(r[4] == 7 for r in rows) / len(rows) < 2 / 8
    assert len({(r[3], r[5]) for r in rows}) > 14


def test_shuffled_the_same_way_again(make_docs, docs):
    one, two = (sorted(rows_of(shard_records(make_docs(docs), shards=3, bucket_bytes=3000)), key=str) for _ in range(2))
    assert one == two
    other = sorted(rows_of(shard_records(make_docs(docs), shards=3, bucket_bytes=3000, seed=5)), key=str)
    assert one != other
    order = [d for d, *_ in sorted(one, key=lambda r: (r[3], r[6])) if d is not None and d >= 20_000]
    up = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 0.4 < up / len(order) < 0.6


def test_one_id_with_most_rows(make_docs):
    docs = [(1, "same " * 20)] * 400 + [(2, "b")] * 3
    rows = rows_of(shard_records(make_docs(docs), shards=2, bucket_bytes=2000))
    assert Counter((d, t) for d, t, *_ in rows) == Counter(docs)
    sizes = Counter((r[3], r[5]) for r in rows)
    assert max(sizes.values()) < 60
    for shard in (0, 1):
        s = sorted(r[6] for r in rows if r[3] == shard)
        assert s == list(range(len(s)))


def test_write_and_empty(make_docs, corpus, spark, tmp_path):
    assert shard_records(make_docs([])).count() == 0
    write_shards(make_docs(corpus), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(corpus) and {"record", "slot", "shard"} <= set(back.columns)


def test_files_are_in_slot_order(make_docs, corpus, spark, tmp_path):
    path = tmp_path / "out"
    write_shards(make_docs([(i, t) for i, (_, t) in enumerate(corpus * 2)]), str(path), shards=3, bucket_bytes=4000)
    for shard in range(3):
        slots = [r.slot for f in sorted((path / f"shard={shard}").glob("*.parquet")) for r in spark.read.parquet(str(f)).select("slot").collect()]
        assert len(slots) > 50 and slots == list(range(len(slots)))
