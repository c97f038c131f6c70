import pytest
from pyspark.sql import functions as F

from hushframe.operators.aggregates import MODELS
from hushframe.plans import runs
from hushframe.sources import registry


def line(*cells):
    return ",".join(map(str, cells))


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")

    def write(path, lines):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("\n".join(lines) + "\n")

    heart = [line(30 + i % 40, "MF"[i % 2], "ATA", 120 + i % 30, 200 + i % 90, i % 2, "Normal", 100 + i % 70, "NY"[i % 2], i % 4, "Up", int(i % 40 > 20)) for i in range(160)]
    write("classification/heart.csv", [line(*registry.HEART), *heart])
    charges = [line(20 + i % 40, ["male", "female"][i % 2], 20 + i % 15, i % 4, ["yes", "no"][i % 3 == 0], "north", 1000 + 50 * (i % 40)) for i in range(160)]
    write("regression/insurance.csv", ["age,sex,bmi,children,smoker,region,charges", *charges, "19,male,,0,yes,north,5"])
    adult = [line(20 + i % 50, [" State-gov ", "?"][i % 2], i, "HS", i % 16, "Married", "Exec", "Wife", "White", "Male", i % 7, 0, 20 + i % 40, "US", ["<=50K", ">50K"][i % 3 == 0]) for i in range(120)]
    write("classification/adult.csv", [line(*registry.ADULT), *adult])
    sick = [line(15 + i % 40, *[i % 3] * 25, "?", "?", *[0] * 7, int(i % 9 == 0)) for i in range(180)]
    write("classification/kag_risk_factors_cervical_cancer.csv", [line(*registry.CERVICAL), *sick])
    return str(root)


def test_run_dataset_saves_and_continues(spark, raw, tmp_path):
    path = str(tmp_path / "results")
    options = dict(epsilons=(5.0,), norms=(1.0,), methods=("Baseline", "DP", "Quantized"), timings=False)
    got = runs.run_dataset(spark, "heart", raw, path, ks=(5,), keys=("lr", "nb"), **options)
    points = {(r["Model"], r["Method"], r["K"]) for r in got.filter("Metric = 'F1'").collect()}
    assert points == {("lr", "Baseline", None), ("nb", "Baseline", None), ("lr", "DP", None), ("nb", "DP", None), ("lr", "Quantized", None), ("lr", "KAnon", 5), ("nb", "KAnon", 5)}
    assert got.filter("Error is not null").count() == 0
    count = got.count()
    again = runs.run_dataset(spark, "heart", raw, path, ks=(5,), keys=("lr", "nb"), **options)
    assert again.count() == count


def test_smote_where_the_registry_says_so(spark, raw):
    rows, spec = runs.load_keyed(spark, "cervical", raw)
    assert spec.smote
    ready = runs.sweeps.prepare(rows, "cervical", [runs.KEY], spec.target, spec.task, balance=spec.smote)
    sizes = {r["label"]: r["count"] for r in ready.train.groupBy("label").count().collect()}
    assert sizes[0.0] == sizes[1.0] and ready.rows == sum(sizes.values())
    assert ready.train.filter(F.col(runs.KEY).startswith("smote-")).count() > 0 and not ready.test.filter(F.col(runs.KEY).startswith("smote-")).count()


def test_reidentification_runs(spark, raw):
    rows, _ = runs.load_attacked(spark, "adult", raw)
    assert {r["workclass"] for r in rows.select("workclass").distinct().collect()} == {"State-gov", "?"}
    assert {r["income"] for r in rows.select("income").distinct().collect()} == {0, 1}
    report = {r["k"]: r for r in runs.run_reidentification(spark, "adult", raw, (5, 20), utility=False).collect()}
    assert report[5]["min_size"] >= 5 and report[20]["min_size"] >= 20 and report[5]["mean_basic"] <= 0.2
    insured = runs.run_reidentification(spark, "insurance", raw, (4,), trees=3, depth=3).first()
    assert insured["min_size"] >= 4 and insured["ml_mse"] > 0
    charges, _ = runs.load_attacked(spark, "insurance", raw)
    assert charges.count() == 160 and charges.agg(F.max("charges")).first()[0] == 2950.0
    with pytest.raises(ValueError, match="attack roles"):
        runs.load_attacked(spark, "heart", raw)


def test_models_exist():
    assert set(MODELS) == {"lr", "nb", "dt", "rf"}
