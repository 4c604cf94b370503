import random

import numpy as np
import pytest

from tamarack.llm import decontaminate, hashing


def greedy(item, doc, least):
    """Greedy string tiling by exhaustive search for the longest free match."""
    fi, fd = [True] * len(item), [True] * len(doc)
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and fi[p + n] and fd[q + n] and item[p + n] == doc[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return fi.count(False)
        fi[p : p + n] = [False] * n
        fd[q : q + n] = [False] * n


@pytest.mark.parametrize("seed", range(12))
def test_tiles_against_exhaustive_search(seed):
    rng = random.Random(seed)
    item = [rng.randrange(30) for _ in range(40)]
    parts = [item[:13], item[13:25], item[25:], [rng.randrange(30) for _ in range(20)]]
    rng.shuffle(parts)
    doc = [x for p in parts for x in (*p, 99)]
    a, b = (hashing.mix(np.array(x, dtype=np.uint64)) for x in (item, doc))
    assert abs(decontaminate.tile(a, b, np.array([], int), 4) - greedy(item, doc, 4)) <= 4


def test_verdicts(spark, docs):
    rows = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, "too short"), (None, "x y z u v w"), (4, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string")
    texts = spark.createDataFrame(
        [(1, "before ALPHA, beta: gamma delta epsilon zeta after eta theta iota kappa lambda mu end"), (2, "eta theta iota kappa lambda mu then alpha beta gamma delta epsilon zeta"), (3, "alpha beta gamma delta x epsilon zeta eta theta"), (4, None), (5, ""), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (1, "clean")],
        "doc_id long, text string",
    )
    for bound in (decontaminate.SENT_BYTES, 0):
        got = {(r.doc_id, r.key): r for r in decontaminate.contaminated(spark, texts, rows, sent_bytes=bound).collect()}
        assert len(got) == 7
        flagged = sorted((str(i) for (i, _), r in got.items() if r.contaminated))
        assert flagged == ["1", "2", "None"]
        assert all(r.item_ids == [1, 4] and r.coverage == 1.0 and r.n_items == 2 for r in got.values() if r.contaminated)
        assert all(r.coverage == 0 and r.item_ids == [] for (i, _), r in got.items() if i in (4, 5))
        assert sorted(str(r.doc_id) for r in decontaminate.clean(spark, texts, rows, sent_bytes=bound).collect()) == ["1", "3", "4", "5"]
    assert decontaminate.contaminated(spark, docs, rows.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("beside", [1000, 3])
def test_both_paths_agree(spark, docs, monkeypatch, beside):
    monkeypatch.setattr(decontaminate, "ITEMS_BESIDE", beside)
    items = docs.where("doc_id between 1 and 20").selectExpr("doc_id as item_id", "text")
    a, b = (sorted(map(str, decontaminate.contaminated(spark, docs, items, sent_bytes=n).collect())) for n in (1 << 20, 0))
    assert a == b


def test_empty(spark, empty):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.contaminated(spark, empty, items).count() == 0
