import zlib
from collections import defaultdict

import pytest

from tamarack.llm import sharding


@pytest.mark.parametrize("shards", [4, 16, 1])
def test_law_and_slots(spark, docs, plain, shards):
    rows = sharding.shard(spark, docs, shards).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in plain), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    by = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(shards):
        assert abs(sum(r.size for r in by[s]) - total / shards) <= largest + 0.02 * total / shards


def test_groups_lie_together(spark):
    rows = [(i, f"text {i % 500} " + "x" * (i % 500 % 37)) for i in range(4000)]
    got = sharding.shard(spark, spark.createDataFrame(rows, "doc_id long, text string"), 8, whole=0.05).collect()
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) / min(sizes.values()) < 1.1


def test_a_large_group_is_parted_and_order_is_stable(spark):
    rows = spark.createDataFrame([(i, "same") for i in range(900)] + [(i, f"t{i}") for i in range(900, 1800)], "doc_id long, text string")
    a = sorted(map(tuple, sharding.shard(spark, rows, 16).collect()))
    b = sorted(map(tuple, sharding.shard(spark, rows.repartition(7), 16).collect()))
    assert a == b
    sizes = defaultdict(int)
    for r in a:
        sizes[r[4]] += r[1]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 12


def test_empty(spark, empty):
    assert sharding.shard(spark, empty).count() == 0
