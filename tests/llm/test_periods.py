import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import common, hashing, periods


def brute(words, least=24, times=3):
    """(start, length, period) of all runs, by trying every period and extending."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def found(words, least, times):
    text = np.array([*words, max(words, default=0) + 1], np.int64)
    return sorted(zip(*(x.tolist() for x in periods.runs_of(text, least, times))))


def repetitive(rng, n, letters):
    out = []
    while len(out) < n:
        piece = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        out += piece * rng.choice([1, 1, 2, 3, 5]) + piece[: rng.randrange(len(piece) + 1)]
    return out[:n]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_all_runs_of_short_texts(words):
    assert found(words, 2, 2) == brute(words, 2, 2)


@pytest.mark.parametrize("seed", range(40))
def test_all_runs_of_repetitive_texts(seed):
    rng = random.Random(seed)
    words = repetitive(rng, rng.randint(50, 400), rng.choice([1, 2, 3, 8]))
    assert found(words, 2, 2) == brute(words, 2, 2)
    assert found(words, 24, 3) == brute(words)


@pytest.mark.parametrize("name", ["fibonacci", "ones", "thue"])
def test_words_known_for_their_squares(name):
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    words = {"fibonacci": b, "ones": [7] * 300, "thue": [bin(i).count("1") % 2 for i in range(300)]}[name]
    assert found(words, 2, 2) == brute(words, 2, 2)


def test_many_texts_at_once(monkeypatch):
    monkeypatch.setattr(periods, "TREE_WORDS", 900)
    rng = random.Random(8)
    texts = [[str(w) for w in repetitive(rng, rng.randint(0, 300), rng.choice([2, 5, 400]))] for _ in range(60)]
    texts += [texts[3]] * 4
    _, _, _, hashes, counts = hashing.words([" ".join(t).encode() for t in texts])
    start, length, period = periods.runs_in(hashes, counts)
    first = np.cumsum(counts) - counts
    of = hashing.owner(counts)[start]
    for i, t in enumerate(texts):
        assert sorted(zip((start - first[i])[of == i].tolist(), length[of == i].tolist(), period[of == i].tolist())) == brute(t)


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_rows(spark, docs, plain, empty):
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periods.periodic_runs(docs).collect()}
    want = set()
    for i, t, *_ in plain:
        words = re.findall(common.WORD, t or "")
        runs = brute(words) if len(words) < 2000 else []
        want.add((i, len(words), tuple(runs), collapsed(words, runs)))
    assert got == want and any(r[2] for r in got)
    assert periods.periodic_runs(empty).collect() == []


def test_longest_period_and_long_text(spark):
    rng = random.Random(2)
    piece = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    r = periods.periodic_runs(spark.createDataFrame([(1, "x " + " ".join(piece * 3) + " y"), (2, " ".join(piece * 2))], "doc_id long, text string")).collect()
    assert [list(map(tuple, x.runs)) for x in sorted(r)] == [[(1, 90_000, 30_000)], []]


def test_query(spark):
    sf, want = "/root/testdata/sf0.001", set()
    for i, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words, h = re.findall(common.WORD, text or ""), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((i, len(runs), *shown, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(collapsed(words, runs))))
    assert {tuple(r) for r in periods.op13_periodic_runs(spark, sf).collect()} == want
    assert sum(r[1] > 0 for r in want) > 10
