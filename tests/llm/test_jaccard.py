import random
import re
from itertools import combinations

import numpy as np
import pytest

from tamarack.llm import jaccard


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, min(own, default=None) if sets[i] else doc, links[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [768, 3])
def test_against_brute_force(spark, docs, plain, block):
    got = jaccard.similar(spark, docs, block=block).select("doc_id", "class_id", "n_links")
    assert sorted(map(tuple, got.collect()), key=str) == brute([(i, t) for i, t, _, _ in plain])


@pytest.mark.parametrize(("block", "few"), [(768, 64), (3, 64), (3, 0), (4, 2)])
def test_distinct_keeps_one_of_each(spark, docs, plain, monkeypatch, block, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    got = jaccard.distinct(spark, docs, block=block)
    assert got.columns == docs.columns
    classes = brute([(i, t) for i, t, _, _ in plain])
    named = {c for i, c, _ in classes if i is not None}
    kept = [r.doc_id for r in got.collect() if r.doc_id is not None]
    assert sorted(kept) == sorted(named)


def test_least_matches_is_the_posterior():
    rng = np.random.default_rng(1)
    for n in (24, 96):
        m = jaccard.least_matches(n, 0.8, 0.01)
        for k, over in ((m, True), (m - 1, False)):
            assert ((rng.beta(k + 1, n - k + 1, 400_000) >= 0.8).mean() >= 0.01) == over


def test_empty(spark, empty):
    assert jaccard.similar(spark, empty).count() == 0
    assert jaccard.distinct(spark, empty).count() == 0


def chains(rng, groups, n):
    """Texts of which each is near the one before, so that ends of a chain are far apart, and texts that only look alike."""
    rows = []
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(60)]
        for _ in range(n):
            rows.append(" ".join(words))
            words = words[:]
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows += [" ".join(words[:40] + [f"y{rng.randrange(10**6)}" for _ in range(20)]) for _ in range(3)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("few", [64, 3, 0])
def test_distinct_follows_chains(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = chains(random.Random(few), 4, 25)
    got = jaccard.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=8)
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_rows_dealt_grow_with_the_group(spark, monkeypatch):
    dealt = []
    linked = jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda tables, cells, *rest: dealt.append(cells.count()) or linked(tables, cells, *rest))
    words = [f"w{i}" for i in range(120)]
    per = {}
    for n in (400, 800, 1600):
        rows = [(i, " ".join([*words, f"copy{i}"])) for i in range(n)] + [(10**6 + i, " ".join([*words[:70], *(f"s{i}v{j}" for j in range(50))])) for i in range(5)]
        dealt.clear()
        assert jaccard.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), block=64).count() == 6
        per[n] = sum(dealt) / n
    assert per[1600] < 1.3 * per[400]


def test_an_empty_block_adds_no_links(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for group in range(24):
        words = [f"g{group}w{rng.randrange(10_000)}" for _ in range(300)]
        rows += [(3 * group + i, " ".join([*words, f"end{i}"])) for i in range(3)]
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", max(len(t) for _, t in rows) * 3 // 2)
    got = jaccard.similar(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in got} == {(i, i // 3 * 3, 2, 2) for i, _ in rows}


def test_nothing_that_grows_is_broadcast(spark, docs, monkeypatch):
    plans, keep = [], jaccard.Scratch.keep

    def noted(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, name)

    monkeypatch.setattr(jaccard.Scratch, "keep", noted)
    for made in (jaccard.similar(spark, docs), jaccard.distinct(spark, docs)):
        plans.append(made._jdf.queryExecution().executedPlan().toString())
    # distinct finds its rows in the input by ``common.matched``, by Spark's own size check
    assert len(plans) > 10 and not [p for p in plans[:-1] if "BroadcastHashJoin" in p]
