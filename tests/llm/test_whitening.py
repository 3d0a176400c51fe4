import math
import random
from fractions import Fraction

import numpy as np
import pytest

from loomery.llm.whitening import Moments, fit_whitening, grid, moments, op13_whitening, packed_keys, symmetric_qr, unpacked_keys, whiten

SF = "/root/testdata/sf0.001"


def brute(rows, components=4):
    """{(row's place, component): (n, deviation, |whitened|, explained)} by exact sums and numpy's own solver."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array(fit, float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for place, (_, x) in enumerate(kept):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(components):
            white = (np.array(x) - mean) @ vectors[:, -1 - k] / math.sqrt(values[-1 - k])
            out[place, k + 1] = (n, deviation, abs(white), values[-1 - k] / values.sum())
    return [i for i, _ in kept], out


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, want = brute(rows)
    place = {i: p for p, i in enumerate(ids)}
    got = op13_whitening(spark, SF).collect()
    assert len(got) == len(want)
    whitened = {}
    for r in got:
        n, deviation, white, explained = want[place[r.vec_id], r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - white) < 1e-7 and abs(r.explained / explained - 1) < 1e-9
        assert r.identity_error < 1e-8
        whitened[r.vec_id, r.component] = r.whitened
    if len(ids) == got[0].n:  # no copies: the covariance of what came out is the identity
        w = np.array([[whitened[i, k] for k in (1, 2, 3, 4)] for i in ids])
        assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-8


@pytest.mark.parametrize("n", [1, 2, 3, 10, 65])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(rng.normal(size=n)), np.ones((n, n)), np.zeros((n, n)), np.diag([1e6] * n) + 1e-3, rng.normal(size=(n, 1)) @ np.ones((1, n))):
        a = a + a.T
        values, vectors = symmetric_qr(a)
        size = max(1.0, np.abs(a).max())
        assert np.all(np.diff(values) <= 0)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * size
        assert np.allclose(values[::-1], np.linalg.eigvalsh(a), atol=1e-11 * size)


def test_moments_merge_in_any_cut(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**40), 2**40, size=(500, 5))
    whole, merged = Moments(5), Moments(5)
    whole.add(x)
    for part in (x[:0], x[:1], x[1:7], x[7:]):
        one = Moments(5)
        one.add(part)
        merged.merge(Moments.of(one.state()))
    assert merged.n == 500 and merged.sums() == whole.sums() == [sum(map(int, c)) for c in x.T]
    want = np.cov(x.T.astype(float), bias=True)
    for m in (whole, merged):
        assert np.allclose(m.covariance(), want, rtol=1e-12, atol=1e-12 * want.max())
    frame = spark.createDataFrame([(k,) for k in packed_keys(x)], "x binary").repartition(23)
    spread = moments(frame, 5, lambda b: unpacked_keys(b.column(0).to_pylist(), 5))  # two rounds of merging
    assert spread.sums() == whole.sums() and np.allclose(spread.covariance(), want, rtol=1e-12, atol=1e-12 * want.max())


def test_keys():
    x = np.array([[0, -1], [32767, -32768], [32768, 0], [-32769, 1], [2**31, 0], [-(2**63), 2**63 - 1]])
    keys = packed_keys(x)
    assert [len(k) // 2 for k in keys] == [2, 2, 4, 4, 8, 8] and np.array_equal(unpacked_keys(keys, 2), x)
    assert grid(np.array([[-0.0, 0.999 / 256, -1e-9, 1e300]])).tolist() == [[0, 0, -1, 2**63 - 1024]]


def test_odd_rows(spark):
    rng = random.Random(6)
    base = [(i, [rng.gauss(0, 1) * (k + 1) for k in range(6)]) for i in range(60)]
    rows = base + [(7, base[3][1]), (None, base[4][1]), *[(100 + i, base[0][1]) for i in range(40)]]
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (205, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, whitened string, `a.b` int").repartition(5)
    model = fit_whitening(frame)
    got = whiten(frame, model)
    assert got.columns == ["vec_id", "embedding", "whitened", "a.b", "_whitened", "deviation"]
    ids, want = brute(rows)
    out = got.collect()
    assert sorted(str(r.vec_id) for r in out) == sorted(map(str, ids)) and model.n == 60
    by_vector = {}
    for place, (i, v) in enumerate(rows):
        by_vector[tuple(v)] = [want[place, k] for k in (1, 2, 3, 4)]
    for r in out:
        for (n, deviation, white, explained), got_white in zip(by_vector[tuple(r.embedding)], r._whitened):
            assert int(r.deviation) == deviation and abs(abs(got_white) - white) < 1e-8


def test_nothing_varies(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert fit_whitening(frame).n == 1 and whiten(frame, fit_whitening(frame)).count() == 0
    assert whiten(frame.limit(0), fit_whitening(frame.limit(0))).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>")
    model = fit_whitening(line)
    assert len(model.values) == 1 and all(len(r.whitened) == 1 for r in whiten(line, model).collect())


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e17 * (i - 3), 3.5e16 * i * i]) for i in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    x = [[max(-(2**63), min(2**63 - 1024, c)) for c in v] for v in x]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((8 * a - s) ** 2 for a, s in zip(v, sums)) for (i, _), v in zip(rows, x)}
    for r in whiten(frame, fit_whitening(frame)).collect():
        assert r.deviation is None if want[r.vec_id] >= 10**38 else int(r.deviation) == want[r.vec_id]
