"""Saves that are cut off, repeated or made twice at once, and sweeps that go on after a failure."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from hushframe.plans import runs, sweeps
from hushframe.sources import results
from hushframe.sources.results import LONG_SCHEMA


def row(spark, value, model="lr", error=None, k=None):
    return spark.createDataFrame([("d", "classification", model, "DP", 1.0, None, k, "F1" if error is None else "Failed", value, error)], LONG_SCHEMA)


def test_a_repeated_save_counts_once_and_the_last_success_wins(spark, tmp_path):
    path = str(tmp_path / "r")
    assert results.finished_results(spark, path).count() == 0
    for value, error in ((None, "first"), (0.5, None), (0.6, None), (None, "later")):
        results.save_results(row(spark, value, error=error), path)
    results.save_results(row(spark, 0.7, k=5), path)
    results.save_results(row(spark, None, "nb", "only"), path)
    got = results.finished_results(spark, path)
    assert got.columns == spark.createDataFrame([], LONG_SCHEMA).columns
    assert got.count() == 3
    assert {(r["Model"], r["K"], r["Value"], r["Error"]) for r in got.collect()} == {("lr", None, 0.6, None), ("lr", 5, 0.7, None), ("nb", None, None, "only")}


@pytest.fixture(scope="module")
def ready(spark):
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 > 8).cast("int").alias("y"))
    return sweeps.prepare(df, "toy", ["id"], "y", "classification")


OPTIONS = dict(epsilons=(5.0,), norms=(3.0,), keys=("nb", "lr"), seed=1, timings=False, methods=("Baseline", "DP"))


def key(rows):
    return sorted((r["Model"], r["Method"], str(r["Epsilon"]), r["Metric"], r["Value"]) for r in rows.collect())


def test_killed_between_write_and_return(spark, ready, tmp_path, monkeypatch):
    """The save that was cut off is on disk and not known to the sweep: the next run leaves one copy of every point."""
    whole = key(sweeps.resume_sweep(ready, str(tmp_path / "whole"), **OPTIONS))
    path, plain, saves = str(tmp_path / "killed"), sweeps.save_results, []

    def killed(rows, where):
        plain(rows, where)
        saves.append(1)
        if len(saves) == 2:
            raise KeyboardInterrupt

    monkeypatch.setattr(sweeps, "save_results", killed)
    with pytest.raises(KeyboardInterrupt):
        sweeps.resume_sweep(ready, path, **OPTIONS)
    # a retry that does not look at what is there writes the same points again
    monkeypatch.setattr(sweeps, "save_results", plain)
    sweeps.privacy_sweep(ready, save=lambda rows: plain(rows, path), **OPTIONS)
    assert key(results.finished_results(spark, path)) == whole
    assert key(sweeps.resume_sweep(ready, path, **OPTIONS)) == whole


def test_two_sweeps_at_once(spark, ready, tmp_path):
    path = str(tmp_path / "twice")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: sweeps.resume_sweep(ready, path, **OPTIONS).count(), range(2)))
    got = key(results.finished_results(spark, path))
    assert len(got) == len(set(r[:4] for r in got)) == 4 * 6


def test_one_k_and_one_model_fail_and_are_tried_again(spark, tmp_path, monkeypatch):
    df = spark.range(200).select(
        "id", (F.col("id") * 7 % 101).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("z"), (F.col("id") * 7 % 101 > 50).cast("int").alias("y"),
    )
    train, test, path = df.filter("id % 5 <> 0"), df.filter("id % 5 = 0"), str(tmp_path / "k")
    mean, fit = sweeps.generalize_mean, sweeps.models.fit
    ks = iter((False, True))
    monkeypatch.setattr(sweeps, "generalize_mean", lambda rows, cols: 1 / 0 if next(ks) else mean(rows, cols))
    monkeypatch.setattr(sweeps.models, "fit", lambda model, *a, **o: 1 / 0 if model == "lr" else fit(model, *a, **o))
    run = lambda done=(): sweeps.kanon_utility(
        train, test, "toy", ["id"], "y", "classification", (5, 40), ("nb", "lr"), rule="widest", done=done, save=lambda rows: results.save_results(rows, path)
    )
    run()
    got = results.finished_results(spark, path)
    failed = {(r["K"], r["Model"]) for r in got.filter("Error is not null").collect()}
    held = {(r["K"], r["Model"]) for r in got.filter("Error is null").collect()}
    assert (5, "lr") in failed and (5, "nb") in held and failed | held == {(k, m) for k in (5, 40) for m in ("nb", "lr")}
    assert {"ProcessTime", "TrainTime", "InfTime", "F1"} <= {r["Metric"] for r in got.filter("K = 5 and Model = 'nb'").collect()}
    monkeypatch.setattr(sweeps, "generalize_mean", mean)
    monkeypatch.setattr(sweeps.models, "fit", fit)
    again = run(held)
    assert {(r["K"], r["Model"]) for r in again.select("K", "Model").distinct().collect()} == failed
    assert results.finished_results(spark, path).filter("Error is not null").count() == 0
    assert run(failed | held).count() == 0


def test_membership_by_dataset_goes_on_by_point(spark, tmp_path, monkeypatch):
    from hushframe.sources import registry

    loads = []
    df = spark.range(240).select(
        F.col("id").cast("string").alias(runs.KEY), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 > 8).cast("int").alias("HeartDisease"),
    )
    monkeypatch.setattr(runs, "load_keyed", lambda spark, name, root: loads.append(name) or (df.withColumnRenamed("HeartDisease", registry.SPECS[name].target), registry.SPECS[name]))
    path, plain = str(tmp_path / "mia"), sweeps.score_point

    def broken(p, model, method, *rest):
        if method == "DP":
            raise ZeroDivisionError("once")
        return plain(p, model, method, *rest)

    monkeypatch.setattr(sweeps, "score_point", broken)
    options = dict(epsilons=(5.0,), norms=(3.0,), keys=("nb",), attack_trees=3)
    first = runs.run_membership(spark, ["heart", "insurance"], "", path, **options).collect()
    assert {(r["Dataset"], r["Strategy"], r["Error"] is None) for r in first} == {("heart", "Baseline", True), ("heart", "DP", False)}
    monkeypatch.setattr(sweeps, "score_point", plain)
    again = runs.run_membership(spark, ["heart"], "", path, **options).collect()
    assert len(again) == 2 and all(0 <= r["MI_AttackAccuracy"] <= 1 and r["Error"] is None for r in again)
    runs.run_membership(spark, ["heart"], "", path, **options)
    assert loads == ["heart", "heart"]
