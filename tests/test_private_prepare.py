"""Private preparation: the ledger adds up, each statistic moves by no more than its sensitivity, noise has its scale."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.operators import private_prepare as pp
from hushframe.plans import sweeps

BOUNDS = {"a": (0.0, 10.0), "b": (-5.0, 5.0)}
VALUES = {"t": ["x", "y", "z"]}


def frame(spark, n=200):
    rows = [(i, [float(i % 12), None, float("nan")][i % 3 if i % 7 == 0 else 0], float(i % 11) - 5, ["x", "y", "w", None][i % 4], i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, t string, y int")


def test_the_ledger_sums_to_what_was_asked(spark):
    ledger = pp.Ledger(2.0)
    fs = pp.fit_private_features(frame(spark), BOUNDS, VALUES, ledger, 1.5, "y", ["id"], seed=1)
    assert abs(sum(e for _, e in ledger.spent) - 1.5) < 1e-12 and abs(ledger.left - 0.5) < 1e-12
    assert [n for n, _ in ledger.spent] == ["median of a", "median of b", "categories of t", "scales"]
    with pytest.raises(ValueError, match="only 0.5"):
        ledger.spend("more", 0.6)
    assert ledger.rest("fit") == pytest.approx(0.5)
    with pytest.raises(ValueError):
        ledger.rest("again")
    out = fs.apply(frame(spark))
    assert fs.width == 5 and out.filter("features is null").count() == 0
    with pytest.raises(ValueError, match="public bounds or values for b, t"):
        pp.fit_private_features(frame(spark), {"a": (0, 1)}, {}, pp.Ledger(1.0), 1.0, "y", ["id"])


def test_one_row_moves_a_statistic_by_its_sensitivity_at_most(spark, monkeypatch):
    """Without noise, with any row removed: histogram and category cells by 1 in total, moments by 1, h and h * h."""
    monkeypatch.setattr(pp, "laplace_value", lambda u, scale: 0.0)
    monkeypatch.setattr(pp, "laplace", lambda u, scale: F.lit(0.0))
    df = frame(spark, 40)
    hist = lambda d: np.array([r["n"] for r in pp.noisy_histogram(d, "a", BOUNDS["a"], 1.0, 1, 8).orderBy("cell").collect()])
    cats = lambda d: np.array(list(pp.noisy_categories(d, "t", VALUES["t"], 1.0, 1).values()))

    def sums(d):
        off = F.coalesce(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), pp.finite("b"))), F.lit(0.0))
        return np.array(d.agg(F.count("*"), F.sum(off), F.sum(off * off)).first(), float)

    whole = hist(df), cats(df), sums(df)
    for gone in (0, 7, 13, 14, 39):
        less = df.filter(F.col("id") != gone)
        assert np.abs(whole[0] - hist(less)).sum() <= 1 and np.abs(whole[1] - cats(less)).sum() <= 1
        moved = np.abs(whole[2] - sums(less))
        assert moved[0] == 1 and moved[1] <= 5 and moved[2] <= 25
    # without noise the statistics are those of the clipped values
    b = np.clip([r["b"] for r in df.collect()], -5, 5)
    mean, deviation = pp.noisy_moments(df, {"b": BOUNDS["b"]}, 1.0, 1)["b"]
    assert mean == pytest.approx(b.mean()) and deviation == pytest.approx(b.std())
    a = [min(max(v, 0.0), 10.0) for v in (r["a"] for r in df.collect()) if v is not None and np.isfinite(v)]
    assert abs(pp.noisy_median(df, "a", BOUNDS["a"], 1.0, 1, 1_000) - np.median(a)) <= 1.0


def test_noise_has_the_scale_of_its_share(spark):
    df = frame(spark, 30)
    cells = [r["n"] for s in range(12) for r in pp.noisy_histogram(df, "a", (100.0, 200.0), 0.25, s, 64).filter("cell > 0").collect()]
    # empty cells get noise too: mean |Laplace(4)| is 4
    assert abs(np.mean(np.abs(cells)) - 4.0) < 0.6 and abs(np.mean(cells)) < 0.6


def test_a_private_fit_gets_what_the_preparation_left(spark, monkeypatch):
    ready = sweeps.prepare(frame(spark), "toy", ["id"], "y", "classification", prep_epsilon=1.0, bounds=BOUNDS, categories=VALUES, prep_seed=3)
    seen, plain = [], sweeps.private.dp_fit
    monkeypatch.setattr(sweeps.private, "dp_fit", lambda model, train, epsilon, *a, **o: seen.append(epsilon) or plain(model, train, epsilon, *a, **o))
    out = sweeps.privacy_sweep(ready, (0.5, 3.0), (1.0,), ("nb",), (sweeps.DP,), seed=1, timings=False).collect()
    assert seen == [2.0]
    assert {r["Epsilon"] for r in out if r["Error"]} == {0.5} and {r["Epsilon"] for r in out if not r["Error"]} == {3.0}
