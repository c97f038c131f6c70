"""Whitening against numpy on the whole table; the eigensolver against known spectra."""

import numpy as np
import pytest

from hushframe.llm import feast, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, tmp_path, rows, schema=SCHEMA, name="vectors"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def check(rows, got, most=8):
    """``rows``: (vec_id, usable vector)."""
    c = np.array([v for _, v in rows], np.float32).astype(float)
    x = np.floor(c * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    y = x - total / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = [i for i in range(min(most, len(values))) if values[i] > 1e-9 * values[0]]
    assert len(got) == n * len(keep)
    by = {(r.vec_id, r.component): r for r in got}
    ids = {v: k for k, (v, _) in enumerate(rows)}
    for i in keep:
        white = y @ vectors[:, i] / np.sqrt(values[i])
        mine = np.array([by[v, i + 1].whitened for v, _ in rows])
        assert min(np.abs(mine - white).max(), np.abs(mine + white).max()) < 1e-8
    for (v, component), r in by.items():
        assert r.n == n and r.deviation == sum(int(d) ** 2 for d in n * x[ids[v]].astype(object) - total)
        assert abs(r.explained / (values[component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


@pytest.mark.parametrize("size, rank", [(12, 12), (3, 3), (20, 5), (1, 1)])
def test_equals_numpy(spark, tmp_path, size, rank):
    rng = np.random.default_rng(size)
    exact = rng.integers(-50, 50, (300, rank)) @ rng.integers(-9, 9, (rank, size)) / 1024
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(exact)]
    full = [(k, v, 1) for k, v in rows]
    odd = [(900, None, 1), (901, [None] * size, 2), (902, [float("nan")] * size, None), (903, [float("inf")] * size, 1), (904, [1.0] * (size + 1), 1), (905, [], 1)]
    df = table(spark, tmp_path, full + odd)
    check(rows, whitening.vector_components(df).collect())


def test_repeats_extra_columns_and_null_ids(spark, tmp_path):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, [0.0, 5.0])]
    full = [(i, v, 1, "a", 7, 0.5) for i, v in rows]
    df = table(spark, tmp_path, full, SCHEMA + ", vector string, cell int, whitened double")
    got = whitening.vector_components(df).collect()
    assert len(got) == 8 and {r.n for r in got} == {4}
    assert sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 1 for r in got) == 4


def test_without_variance(spark, tmp_path):
    assert whitening.vector_components(table(spark, tmp_path, [(k, [1.5, 2.5], 0) for k in range(9)])).count() == 0
    assert whitening.vector_components(table(spark, tmp_path, [(1, [1.5, 2.5], 0)], name="one")).count() == 0
    assert whitening.vector_components(table(spark, tmp_path, [(1, None, 0)], name="none")).count() == 0


def test_sums_of_large_entries_are_exact(spark, tmp_path):
    rows = [(1, [float(1 << 40), 1.0]), (2, [-float(1 << 40), 2.0]), (3, [12345.0, -7.0]), (4, [0.25, 1e30])]
    df = table(spark, tmp_path, [(i, v, 0) for i, v in rows])
    good = whitening.usable(df)
    model = whitening.fit(good)
    assert model.n == 3 and model.sums == [sum(int(np.floor(v[k] * 1024)) + 100_000 for _, v in rows[:3]) for k in range(2)]
    assert {r.deviation for r in whitening.whiten(good, model).collect()} != {0}


@pytest.mark.parametrize("spectrum", [
    [5.0, 5.0, 5.0, 1.0, 1.0, 0.5, 0.0, 0.0], [1e6, 1.0, 1e-3, 1e-3 * (1 + 1e-7), 1e-9], [3.0] * 12, [2.0 ** -k for k in range(30)], list(range(1, 80)),
])
def test_contours_find_every_wanted_pair(spark, spectrum):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))
    v = (q * np.array(spectrum)) @ q.T
    v = (v + v.T) / 2
    for shift in (0.75, 1e-6, 4.0):
        assert feast.below(v, shift) == sum(e < shift for e in spectrum)
    values, vectors = feast.largest(spark, v, 8)
    want = sorted((e for e in spectrum if e > max(spectrum) * len(spectrum) * 1e-13), reverse=True)[:8]
    assert np.allclose(values, want, rtol=1e-9, atol=max(spectrum) * 1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-6
    assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * max(spectrum)
