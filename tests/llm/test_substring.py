import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tamarack.llm import hashing, substring


def brute(rows, window):
    lists = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in lists for p in range(len(w) - window + 1))
    out = []
    for i, w in lists:
        gone = {q for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "seed"), [(35, 8), (12, 3), (6, 6), (5, 1)])
def test_against_brute_force(spark, docs, plain, window, seed):
    got = substring.dedup_substrings(spark, docs, window, seed)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(i, t) for i, t, _, _ in plain], window)


@pytest.mark.parametrize(("window", "seed"), [(35, 8), (12, 3)])
def test_maximal_repeats(spark, docs, plain, window, seed):
    """Spans are equal at their partner, cover what is removed, and are joined as far as they go on."""
    rows = substring.maximal_repeats(spark, docs, window, seed).collect()
    lists = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in plain]
    of = {}
    for i, w in lists:
        of.setdefault(i, []).append(w)
    covered, spans = {}, {}
    for r in rows:
        size = r.stop - r.start
        assert size >= window
        assert any(w[r.start : r.stop] == x[r.other_start : r.other_start + size] and len(w[r.start : r.stop]) == size for w in of[r.doc_id] for x in of[r.other_id])
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
        spans.setdefault((r.doc_id, bytes(r.key), r.other_id, r.other_start - r.start), []).append((r.start, r.stop))
    for own in spans.values():
        own.sort()
        assert all(b[0] > a[1] - window + 1 for a, b in zip(own, own[1:], strict=False))
    assert max(r.stop - r.start for r in rows) > 2 * window
    gone = {i: n for i, _, n, _, _ in brute([(i, t) for i, t, _, _ in plain], window) if len(of[i]) == 1}
    assert {i: len(covered.get(i, ())) for i in gone} == gone


def test_empty(spark, empty):
    assert substring.dedup_substrings(spark, empty).count() == 0


def test_words_are_the_same_in_any_piece(monkeypatch):
    texts = [b"a bb  ccc\n", b"", "é ü\x0b漢字 x".encode(), b"z" * 500 + b" y", b" "]
    whole = hashing.words(texts)
    monkeypatch.setattr(hashing, "PIECE", 7)
    parts = hashing.words(texts)
    for a, b in zip(whole, parts, strict=True):
        assert np.array_equal(a, b)
    assert whole[4].tolist() == [3, 0, 4, 2, 0]
    assert [bytes(whole[0][s:e]) for s, e in zip(whole[1], whole[2], strict=True)] == [w for t in texts for w in t.split()]
