import numpy as np
import pytest

from tamarack.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, whitened int"


def brute(vectors, k=16):
    """n, deviations, whitened entries (signs free) and shares, in numpy over integers of any size."""
    x = [[int(np.floor(float(np.float32(c)) * 64)) + 1_000_000 for c in v] for v in vectors]
    fit = [list(v) for v in dict.fromkeys(map(tuple, x))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = lambda rows: np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in rows])
    values, components = np.linalg.eigh(centred(fit).T @ centred(fit) / n)
    values, components = values[::-1], components[:, ::-1]
    return n, deviation, centred(x) @ components[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(300, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32)
    return np.concatenate([base, base[:1].repeat(150, axis=0), base[5:9]])


def same_up_to_sign(got, want):
    for a, b in zip(got.T, want.T):
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)


def test_against_numpy(spark, vectors):
    rows = [(i, v.tolist(), "clash", 1) for i, v in enumerate(vectors)]
    odd = [(900, None, "", 0), (901, [], "", 0), (902, [1.0, None] * 10, "", 0), (903, [float("nan")] * 20, "", 0), (904, [float("-inf")] * 20, "", 0), (905, [1.0] * 19, "", 0)]
    got, fitted, error = whitening.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(5))
    found = {r.vec_id: r for r in got.collect()}
    assert sorted(found) == list(range(len(vectors))) and error < 1e-9
    n, deviation, want, share = brute(vectors)
    assert fitted.n == n == 300 and np.allclose(fitted.explained, share, rtol=1e-10)
    assert [sum(c * c for c in found[i].centred) for i in range(len(vectors))] == deviation
    same_up_to_sign(np.array([found[i].whitened for i in range(len(vectors))]), want)


def test_little_or_no_variance(spark):
    line = [(i, [float(i), 2.0 * i, 5.0], "", 0) for i in range(9)] + [(None, [3.0, 6.0, 5.0], "", 0)]
    got, fitted, error = whitening.whiten(spark.createDataFrame(line, SCHEMA))
    assert len(fitted.variances) == 1 and error < 1e-9 and {len(r.whitened) for r in got.collect()} == {1}
    for rows in ([], [(1, None, "", 0)], [(1, [1.0, 2.0], "", 0)] * 3):
        got, fitted, error = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and fitted is None and error is None


def test_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        whitening.whiten(spark.createDataFrame([(i, [1e17 * i, 1.0], "", 0) for i in range(4)], SCHEMA))[0].collect()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, deviation, want, share = brute([r.embedding for r in rows])
    got = whitening.op12_embedding_whitening(spark, sf).collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-6
    by = {(r.vec_id, r.component): r for r in got}
    assert all(by[r.vec_id, 1].deviation == d for r, d in zip(rows, deviation))
    assert np.allclose([by[rows[0].vec_id, c + 1].explained for c in range(16)], share)
    same_up_to_sign(np.array([[by[r.vec_id, c + 1].whitened for c in range(16)] for r in rows]), want)
