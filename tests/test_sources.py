import pytest
from pyspark.sql import functions as F

from hushframe.operators import clean
from hushframe.plans import reports, sweeps
from hushframe.sources import registry, results
from hushframe.sources.results import LONG_SCHEMA


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    adult = ["39, State-gov,77516,Bachelors,13,Never-married,Adm,Not-in-family,White,Male,2174,0,40,United-States,<=50K",
             "50,?,83311,Bachelors,13,Married,Exec,Husband,White,Male,0,0,13,United-States,>50K",
             "50,?,83999,Masters,13,Married,Exec,Husband,White,Male,0,0,13,United-States,>50K.",
             "50,?,83999,HS,13,Married,Exec,Husband,White,Male,0,0,13,United-States,>50K."]
    write(root / "classification/adult.csv", [",".join(registry.ADULT), *adult])
    names = registry.SPECS["data"].schema.names
    cell = lambda i, d: ",".join([str(i), d, *["1.5"] * 30, ""])
    write(root / "classification/data.csv", [",".join(names), cell(1, "M"), cell(1, "M"), cell(2, "B"), cell(3, "X")])
    c = registry.CERVICAL
    row = lambda age, first, biopsy: ",".join([age, *["1.0"] * 25, first, first, *["0"] * 7, biopsy])
    write(root / "classification/kag_risk_factors_cervical_cancer.csv", [",".join(c), row("18", "?", "0"), row("20", "?", "1"), row("?", "3", "0")])
    compas = registry.COMPAS
    base = {k: "1" for k in compas} | {"days_b_screening_arrest": "5", "is_recid": "0", "c_charge_degree": "F", "name": "a b"}
    person = lambda **kw: ",".join({**base, **kw}[k] for k in compas)
    write(
        root / "classification/compas-scores-two-years.csv",
        [",".join(compas), person(), person(days_b_screening_arrest="31"), person(days_b_screening_arrest=""), person(is_recid="-1"),
         person(c_charge_degree="O"), person(c_charge_degree="", is_recid="")],
    )
    crime = lambda last, sparse: ",".join(["8", "?", "?", "Some town", "1", *["0.5"] * 121, sparse, last])
    write(root / "regression/communities.data", [crime("0.2", "?"), crime("0.4", "?"), crime("?", "0.1"), crime("0.1", "?")])
    write(root / "regression/insurance.csv", ["age,sex,bmi,children,smoker,region,charges", "19,female,27.9,0,yes,southwest,100.0",
                                               "19,female,27.9,0,yes,southwest,100.0", "18,male,33.7,1,no,southeast,0.0"])
    heart = registry.HEART
    write(root / "classification/heart.csv", [",".join(heart), "40,M,ATA,140,289,0,Normal,172,N,0,Up,0"])
    credit = registry.SPECS["creditcard"].schema.names
    write(root / "classification/creditcard.csv", [",".join(f'"{n}"' for n in credit), ",".join(["1.0"] * 30 + ["0"])])
    return str(root)


def test_registry_loads_and_cleans(spark, raw):
    adult, spec = registry.load(spark, "adult", raw)
    rows = adult.select("age", "workclass", "`education.num`", "income").orderBy("age").collect()
    assert [tuple(r) for r in rows] == [(39, "State-gov", 13, 0), (50, None, 13, 1), (50, None, 13, 1)]
    assert spec.task == "classification" and "fnlwgt" not in adult.columns
    cells, _ = registry.load(spark, "data", raw)
    assert sorted(r[0] for r in cells.select("diagnosis").collect()) == [0, 1] and len(cells.columns) == 31
    cervical, _ = registry.load(spark, "cervical", raw)
    assert "STDs: Time since first diagnosis" not in cervical.columns and dict(cervical.dtypes)["Age"] == "double"
    assert cervical.count() == 3 and cervical.filter("Age IS NULL").count() == 1
    compas, _ = registry.load(spark, "compas", raw)
    assert compas.columns == list(registry.COMPAS_KEPT) and compas.count() == 2
    crime, spec = registry.load(spark, "communities", raw)
    assert crime.columns[-1] == registry.CRIME_TARGET and "c126" not in crime.columns and crime.columns[0] == "c5" and crime.count() == 3
    insurance, spec = registry.load(spark, "insurance", raw)
    assert insurance.count() == 2 and insurance.agg(F.min("charges")).first()[0] == 0.0 and spec.task == "regression"
    assert registry.load(spark, "heart", raw)[0].count() == 1
    credit = registry.load(spark, "creditcard", raw)[0]
    assert "Time" not in credit.columns and credit.count() == 1
    with pytest.raises(ValueError):
        registry.load(spark, "nobody", raw)


def test_row_key_is_content(spark, raw):
    adult, _ = registry.load(spark, "adult", raw)
    keyed = registry.with_row_key(adult)
    keys = {r[0] for r in keyed.select("row_key").collect()}
    assert len(keys) == 2 and keys == {r[0] for r in registry.with_row_key(adult.repartition(3)).select("row_key").collect()}


def test_roles_and_trim(spark):
    df = spark.createDataFrame([(" a ", 1, True, 2.5)], "` t ` string, i int, b boolean, `d.x` double")
    trimmed = clean.trim_all(df)
    assert trimmed.columns == ["t", "i", "b", "d.x"] and trimmed.first()["t"] == "a"
    assert clean.feature_roles(trimmed, "i") == (["d.x"], ["t", "b"])
    with pytest.raises(ValueError):
        clean.drop_columns(df, ["gone"], missing_ok=False)


def test_results_round_trip(spark, tmp_path):
    rows = results.results_union(
        spark.createDataFrame([("a", "lr", "Baseline", "classification", 0.5)], "Dataset string, Model string, Type string, Task_Type string, Baseline_F1 double"),
        spark.createDataFrame([("a", "lr", "DP", "classification", 0.4)], "Dataset string, Model string, Type string, Task_Type string, `DP_F1_Eps0.1_Norm1.0` double"),
    )
    for name in ("wide.csv", "wide.parquet"):
        results.write_results(rows, str(tmp_path / name))
        back = results.read_results(spark, str(tmp_path / name))
        long = {(r["Method"], r["Epsilon"], r["Score"]) for r in reports.unpivot_utility(back).collect()}
        assert long == {("Baseline", "None", 0.5), ("DP", "0.1", 0.4)}
    assert results.project_present(rows).columns == ["Dataset", "Model", "Type", "Task_Type"]
    results.write_report(rows, str(tmp_path / "report"))
    assert (tmp_path / "report/Task_Type=classification/Dataset=a").is_dir()


def test_metric_names():
    cols = ["Baseline_F1", "DP_F1_Eps0.1_Norm1.0", "DP_PHE_AUC_Eps1.0_Norm10", "FHE_F1_Eps1.0_Norm10", "FHE_DP_R2_Eps5.0_Norm100",
            "DP_F1", "Baseline_F1_Eps1.0_Norm1.0", "DP_Accuracy_Eps0.1_Norm1.0", "Time_DP", "KAnon_F1_K10"]
    got = [(m, k, e, n) for _, m, k, e, n in reports.parse_metric_names(cols, ("F1", "R2", "AUC"))]
    assert got == [("Baseline", "F1", "None", "None"), ("DP", "F1", "0.1", "1.0"), ("DP-PHE", "AUC", "1.0", "10"),
                   ("DP-FHE", "F1", "1.0", "10"), ("DP-FHE-W", "R2", "5.0", "100")]
    assert reports.parse_metric_names(["KAnon_F1_K10"], ("F1",), kanon=True)[0][1:4] == ("KAnon", "F1", "K=10")
    assert reports.parse_metric_names(["DP_CompileTime_Eps0.1_Norm1.0"], ("CompileTime",)) == []


@pytest.fixture(scope="module")
def ready(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 17).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("t"),
        (F.col("id") % 17 > 8).cast("int").alias("y"),
    )
    return sweeps.prepare(df, "toy", ["id"], "y", "classification")


def test_sweep_isolates_failures_and_tries_again(spark, ready, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    options = dict(epsilons=(50.0,), norms=(3.0,), keys=("lr", "nb"), seed=1, timings=False, methods=("Baseline", "Quantized", "Quantized_DP"))
    plain = sweeps.score_point

    def broken(p, model, method, *rest):
        if method == "Quantized_DP":
            raise ZeroDivisionError("while fitting")
        scorer, scored = plain(p, model, method, *rest)
        if method == "Quantized":
            # the plan is fine, running it is not
            scored = scored.withColumn("prediction", F.raise_error(F.lit("while scoring " * 60)).cast("double"))
        return scorer, scored

    monkeypatch.setattr(sweeps, "score_point", broken)
    first = sweeps.resume_sweep(ready, path, **options)
    failed = {r["Method"]: r["Error"] for r in first.filter("Metric = 'Failed'").collect()}
    assert set(failed) == {"Quantized", "Quantized_DP"} and "ZeroDivisionError" in failed["Quantized_DP"] and failed["Quantized"].count("while scoring") >= 60
    f1 = {(r["Model"], r["Method"]): r["Value"] for r in first.filter("Metric = 'F1'").collect()}
    assert set(f1) == {("lr", "Baseline"), ("nb", "Baseline")} and f1[("lr", "Baseline")] > 0.9
    monkeypatch.setattr(sweeps, "score_point", plain)
    again = sweeps.resume_sweep(ready, path, **options)
    f1 = {(r["Model"], r["Method"]) for r in again.filter("Metric = 'F1'").collect()}
    assert f1 == {("lr", "Baseline"), ("nb", "Baseline"), ("lr", "Quantized"), ("lr", "Quantized_DP")}
    assert again.filter("Error is not null").count() == 0
    count = again.count()
    assert sweeps.resume_sweep(ready, path, **options).count() == count


def test_points_are_saved_as_they_end(ready):
    saved = []
    sweeps.privacy_sweep(ready, methods=("Baseline",), keys=("nb", "lr"), timings=False, save=lambda rows: saved.append(rows.first()["Model"]))
    assert saved == ["nb", "lr"]


def test_sweep_reaches_the_reports(ready):
    long = sweeps.privacy_sweep(ready, (0.5, 50.0), (0.25, 3.0), ("lr", "dt"), seed=1)
    wide = reports.pivot_export(long.filter("Metric in ('F1', 'AUC', 'TrainTime', 'InfTime')"))
    direct, back = reports.utility_of(long), reports.unpivot_utility(wide)
    key = lambda df: sorted((r["Model"], r["Method"], r["Metric_Type"], r["Epsilon"], r["Data_Norm"], r["Score"]) for r in df.collect())
    assert key(direct) == key(back) and len(key(direct)) == 2 * (2 + 8 + 2 + 4)
    best = {(r["Model"], r["Method"]) for r in reports.best_tradeoff_cls(back).collect()}
    assert best == {("lr", "Baseline"), ("lr", "DP"), ("lr", "Quantized"), ("lr", "Quantized_DP"), ("dt", "Baseline"), ("dt", "DP"), ("dt", "Quantized")}
    sizes = ready.train.groupBy(F.lit("toy").alias("Dataset")).agg(F.count("*").alias("Dataset_Rows"))
    cost = {(r["Model"], r["Method"]): r for r in reports.cost_report(reports.unpivot_cost(wide), sizes).collect()}
    assert cost["lr", "Baseline"]["Overhead_Factor"] == 1.0 and cost["lr", "DP"]["Overhead_Factor"] != 1.0


def test_export_refuses_two_values_for_a_cell(spark):
    rows = [("d", "m", "classification", "DP", 1.0, n, None, "F1", v, None) for n, v in ((0.5, 0.1), (0.5, 0.2))]
    with pytest.raises(Exception, match="two values for one cell"):
        reports.pivot_export(spark.createDataFrame(rows, LONG_SCHEMA)).collect()


def test_grid_points():
    every = ("Baseline", "DP", "Quantized", "Quantized_DP")
    reg = sweeps.grid_points("regression", (1.0,), (1.0, 10.0), ("lr", "nb", "dt", "rf"), every)
    assert [p[:2] for p in reg if p[0] != "lin_reg"] == [("dt_reg", "Baseline"), ("rf_reg", "Baseline")]
    assert sum(p[1] == "DP" for p in reg) == 2
    cls = sweeps.grid_points("classification", (1.0,), (1.0,), ("lr", "rf"), every[1:])
    assert ("rf", "Quantized", None, None) in cls and ("nb", "Quantized", None, None) not in sweeps.grid_points("classification", (1.0,), (1.0,), ("nb",), every) and ("lr", "Quantized", None, None) in cls and ("rf", "DP", 1.0, 1.0) in cls


def test_kanon_with_text_columns(spark):
    df = spark.range(300).select(
        "id", (F.col("id") * 7 % 101).cast("double").alias("x"), F.when(F.col("id") % 4 == 0, "p").otherwise("q").alias("t"),
        (F.col("id") * 7 % 101 > 50).cast("int").alias("y"),
    )
    out = sweeps.kanon_utility(df.filter("id % 5 <> 0"), df.filter("id % 5 = 0"), "toy", ["id"], "y", "classification", (5, 40), ("nb",))
    assert {(r["K"], r["Metric"]) for r in out.collect()} >= {(5, "F1"), (40, "F1")}
