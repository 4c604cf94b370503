from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import mixing


def waterfill(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] or sizes[s] == 0}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped |= over


def test_targets_and_draws(spark, docs, plain):
    rows = mixing.mix(spark, docs, shards=4, block_words=50).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((i, s, size(t)) for i, t, _, s in plain)
    sizes = defaultdict(int)
    for _, t, _, s in plain:
        sizes[s] += size(t)
    want, taken, largest = waterfill(sizes), defaultdict(int), defaultdict(int)
    blocks = defaultdict(set)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.size * len(r.draws)
        largest[r.source] = max(largest[r.source], r.size)
        assert len(r.draws) <= 3
        for d in r.draws:
            blocks[(r.source, d.block)].add(d.shard)
            assert 0 <= d.shard < 4
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert all(len(x) == 1 for x in blocks.values())


def test_reruns_agree(spark, docs):
    a, b = (sorted(map(str, mixing.mix(spark, d).collect())) for d in (docs, docs.repartition(9)))
    assert a == b


def test_quotas_add_up(spark):
    sources = spark.createDataFrame([(0, 40), (1, 7), (2, 0), (3, 201)], "sid int, blocks long")
    for shards in (1, 5, 16):
        rows = {r.sid: r.ends for r in mixing.quotas(sources, shards, 3).collect()}
        assert {s: e[-1] for s, e in rows.items()} == {0: 40, 1: 7, 2: 0, 3: 201}
        table = np.array([np.diff([0, *rows[s]]) for s in range(4)])
        assert (table >= 0).all() and table.shape == (4, shards)
        assert table.sum(axis=0).max() - table.sum(axis=0).min() <= 1


@pytest.mark.parametrize(("population", "good", "drawn"), [(10, 4, 5), (1000, 300, 20), (50, 50, 20), (50, 0, 20), (7, 3, 7), (100000, 40000, 30000)])
def test_hypergeometric(spark, population, good, drawn):
    n = 4000
    got = [r.x for r in spark.range(n).select(F.expr(mixing.hypergeometric(str(population), str(good), str(drawn), f"(id + 0.5D) / {n}")).alias("x")).collect()]
    p = good / population
    mean, var = drawn * p, drawn * p * (1 - p) * (population - drawn) / max(1, population - 1)
    assert all(max(0, drawn + good - population) <= x <= min(drawn, good) for x in got)
    assert np.mean(got) == pytest.approx(mean, abs=0.02 + 0.01 * var**0.5)
    assert np.var(got) == pytest.approx(var, rel=0.05, abs=0.02)


def test_mixed_repeats_rows(spark, docs, plain):
    got = mixing.mixed(spark, docs)
    assert got.columns == docs.columns
    draws = Counter()
    for r in mixing.mix(spark, docs).collect():
        draws[r.doc_id] += len(r.draws)
    have = Counter(r.doc_id for r in got.collect())
    assert {k: v for k, v in draws.items() if v} == dict(have)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 1001])
def test_permuted_is_a_permutation(spark, n):
    got = [r.y for r in spark.range(n).select(mixing.permuted("id", str(n), "'salt'").alias("y")).collect()]
    assert sorted(got) == list(range(n))
    if n >= 100:
        assert abs(np.corrcoef(got, range(n))[0, 1]) < 0.25 and sum(abs(a - b) == 1 for a, b in zip(got, got[1:], strict=False)) < n / 10


def test_the_tree_deals_what_is_taken(spark, docs, monkeypatch):
    plans = []
    own = mixing.quotas

    def seen(blocks, shards, seed):
        out = own(blocks, shards, seed)
        plans.append(({r.sid: r.blocks for r in blocks.collect()}, {r.sid: r.ends for r in out.collect()}))
        return out

    monkeypatch.setattr(mixing, "quotas", seen)
    rows = mixing.mix(spark, docs, shards=4, block_words=50).collect()
    quota, ends = plans[0]
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    for sid, name in enumerate(names):
        at = {(d.block, d.shard) for r in rows if r.source == name for d in r.draws}
        # a block is in one shard, the one whose part of the quota it falls in
        assert all(0 <= b < quota[sid] and s == sum(e <= b for e in ends[sid]) for b, s in at)
        assert ends[sid][-1] == quota[sid]
    assert len({d.shard for r in rows for d in r.draws}) == 4

    # without the tree's last shard, its blocks are not taken; without the tree nothing is
    def short(blocks, shards, seed):
        return own(blocks, shards, seed).withColumn("ends", F.transform("ends", lambda e: F.least(e, F.element_at("ends", -2))))

    monkeypatch.setattr(mixing, "quotas", short)
    fewer = {(r.doc_id, r.order_key): len(r.draws) for r in mixing.mix(spark, docs, shards=4, block_words=50).collect()}
    for r in rows:
        assert fewer[(r.doc_id, r.order_key)] == sum(d.shard < 3 for d in r.draws)


def test_rows_lie_in_the_order_of_the_shards(spark, docs):
    draws = {}
    for r in mixing.mix(spark, docs, shards=4, block_words=50).collect():
        draws.setdefault(r.doc_id, []).extend((d.shard, d.shuffle_key % (1 << 64) >> 1) for d in r.draws)
    once = {i: d[0] for i, d in draws.items() if len(d) == 1}
    got = mixing.mixed(spark, docs, shards=4, block_words=50).withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == sum(map(len, draws.values()))
    for part in {r.part for r in got}:
        places = [once[r.doc_id] for r in got if r.part == part and r.doc_id in once]
        assert places == sorted(places)


def test_empty(spark, empty):
    assert mixing.mix(spark, empty).count() == 0
