import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe.operators import anonymize as A
from hushframe.operators import risk

SIX = [(20, 10, "M"), (21, 11, "M"), (22, 12, "M"), (60, 50, "F"), (61, 51, "F"), (62, 52, "F")]


def recursion(pdf: pd.DataFrame, qi: list[str], k: int) -> list[frozenset]:
    """Brute force: the widest-span recursion on a small frame."""
    spans = {c: pdf[c].max() - pdf[c].min() for c in qi}

    def go(idx):
        if len(idx) < 2 * k:
            return [frozenset(idx)]
        part = pdf.loc[idx]
        best, axis = 0.0, None
        for c in qi:
            s = (part[c].max() - part[c].min()) / spans[c] if spans[c] > 0 else 0.0
            if s > best:
                best, axis = s, c
        if axis is None:
            return [frozenset(idx)]
        right = part[axis] > part[axis].median()
        left, right = list(part.index[~right]), list(part.index[right])
        if min(len(left), len(right)) < k:
            return [frozenset(idx)]
        return go(left) + go(right)

    return go(list(pdf.index))


def tied_frame(n=900, seed=3):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 1000, n))  # a third and more in one value
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": rng.normal(size=n).round(2), "c": rng.integers(0, 3, n)})


def classes(pdf, pid="pid"):
    return {frozenset(g) for g in pdf.groupby(pid)["id"].apply(list)}


def test_six_rows(spark):
    df = spark.createDataFrame(SIX, "age int, income int, sex string")
    out = A.generalize_mean(A.mondrian(df, ["age", "income"], 2), ["age", "income"]).toPandas()
    assert sorted(set(out["age"])) == [21.0, 61.0] and sorted(set(out["income"])) == [11.0, 51.0]
    mode = A.generalize_mode(A.mondrian(df, ["age", "income"], 2), ["sex"]).toPandas()
    assert set(zip(mode["pid"], mode["sex"])) == {("0", "M"), ("1", "F")}


@pytest.mark.parametrize("local_rows, exact_rows", [(10**6, 10**6), (150, 10**6), (300, 50)])
def test_equals_plain_recursion(spark, local_rows, exact_rows):
    pdf = tied_frame()
    df = spark.createDataFrame(pdf)
    got = A.mondrian(df, ["a", "b", "c"], 10, local_rows=local_rows, exact_rows=exact_rows).toPandas()
    assert classes(got) == set(recursion(pdf.set_index("id", drop=False), ["a", "b", "c"], 10))


def test_sweep_equals_separate_builds(spark):
    df = spark.createDataFrame(tied_frame())
    ks = [5, 20, 90]
    for rule in ("widest", "random"):
        swept = A.mondrian_sweep(df, ["a", "b", "c"], ks, rule=rule, local_rows=400).toPandas()
        for k in ks:
            alone = A.mondrian(df.repartition(7), ["a", "b", "c"], k, rule=rule, local_rows=10**6).toPandas()
            assert classes(swept, f"pid_{k}") == classes(alone)
            assert swept.groupby(f"pid_{k}").size().min() >= k


def test_many_nodes_take_the_shuffled_path(spark, monkeypatch):
    df = spark.createDataFrame(tied_frame())
    want = classes(A.mondrian(df, ["a", "b"], 30).toPandas())
    monkeypatch.setattr(A, "DRIVER_NODES", 0)
    monkeypatch.setattr(A, "BROADCAST_ROWS", 0)
    assert classes(A.mondrian(df, ["a", "b"], 30, local_rows=400).toPandas()) == want


def test_nulls_are_generalized(spark):
    rows = [(i, float(i) if i % 3 else None, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    seen = []
    for local_rows, exact_rows in ((80, 10**6), (120, 30), (10**6, 10**6)):
        out = A.mondrian(df, ["a", "b"], 10, local_rows=local_rows, exact_rows=exact_rows)
        seen.append(classes(out.toPandas()))
        assert out.count() == 300 and out.filter("pid IS NULL").count() == 0
        assert A.generalize_mean(out, ["a", "b"]).filter("a IS NULL").count() == 0
    assert seen[0] == seen[1] == seen[2]


def test_categorical_pick_is_a_leaf(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(40)], "id int, t string")
    assert A.mondrian(df, ["t"], 2, categorical=["t"], rule="random").select("pid").distinct().count() == 1


def test_bad_calls(spark):
    df = spark.createDataFrame(SIX, "age int, income int, sex string")
    with pytest.raises(ValueError):
        A.mondrian(df, ["age"], 7)
    with pytest.raises(ValueError):
        A.mondrian(df, ["age"], 2, rule="other")
    with pytest.raises(ValueError):
        A.mondrian(df, ["sex"], 2, categorical=["sex"])


def test_means_keep_totals_and_risk_bounds(spark):
    df = spark.createDataFrame(tied_frame())
    out = A.mondrian(df, ["a", "b"], 10).cache()
    means = A.generalize_mean(out, ["a", "b"])
    total = lambda t: t.agg(F.sum("a"), F.sum("b")).first()
    assert np.allclose(total(out), total(means))
    pids = {10: "pid"}
    basic = risk.risk_basic(out, pids, ["id"], None).toPandas().set_index("id")["prob_basic"]
    extra = risk.risk_enhanced(out, pids, ["id"], ["c"], None).toPandas().set_index("id")["prob_enhanced"]
    assert (basic <= 0.1).all() and (extra >= basic.loc[extra.index]).all() and len(extra) == len(basic) == 900
    whole = risk.risk_summary(out, pids, ["c"]).first()
    rows = risk.risk_summary(out, pids, ["c"], ["id"], 900).first()
    assert np.allclose(whole, rows)


def test_missing_extra_attribute_matches_nobody(spark):
    df = spark.createDataFrame([(1, "p", None), (2, "p", "s"), (3, "p", "s")], "id int, pid string, e string")
    got = {r["id"]: r["prob_enhanced"] for r in risk.risk_enhanced(df, {2: "pid"}, ["id"], ["e"]).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.5}
    s = risk.risk_summary(df, {2: "pid"}, ["e"]).first()
    assert np.isclose(s["mean_enhanced"], (1 + 0.5 + 0.5) / 3) and s["pct_enhanced"] == 100.0


def test_non_finite_values_do_not_depend_on_the_path(spark):
    odd = [float("nan"), float("inf"), float("-inf"), None]
    rows = [(i, odd[i % 4] if i % 5 == 0 else float(i * 37 % 101), float(i * i % 53)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    found = []
    for local in (8, 100, 10**6):
        out = A.mondrian(df, ["a", "b"], 5, local_rows=local)
        found.append({r["id"]: r["pid"] for r in out.collect()})
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) > 5


def test_any_column_names(spark):
    df = spark.range(200).selectExpr("id as n", "cast(id % 7 as double) as path", "id as axis", "id as cut", "id as bit", "cast(id as double) as _q0", "id as v")
    out = A.mondrian(df, ["path", "_q0"], 10, local_rows=30)
    assert out.columns == [*df.columns, "pid"] and out.count() == 200
    sizes = [r["count"] for r in out.groupBy("pid").count().collect()]
    assert min(sizes) >= 10 and len(sizes) > 4


def test_only_narrow_rows_reach_python(spark, monkeypatch):
    """What is finished inside tasks does not depend on the caller's other columns."""
    seen, plain = [], A._finish_locally

    def watched(rows, *rest):
        seen.append((rows.columns, rows.toPandas().memory_usage(deep=True).sum()))
        return plain(rows, *rest)

    monkeypatch.setattr(A, "_finish_locally", watched)
    df = spark.range(400).select("id", (F.col("id") * 7 % 101).alias("a"), (F.col("id") % 13).alias("b"))
    wide = df.select("*", *[F.concat(F.lit("x" * 200), F.col("id").cast("string")).alias(f"w{i}") for i in range(8)], F.lit(1).alias("_row"), F.lit("p").alias("path"))
    results = [A.mondrian_sweep(d, ["a", "b"], [5, 20], local_rows=60) for d in (df, wide)]
    assert set(seen[0][0]) == set(seen[1][0]) == {"_row", "_q0", "_q1", "path", "pid_5", "pid_20"}
    assert abs(seen[0][1] - seen[1][1]) < 0.05 * seen[0][1]
    classes = [{r["id"]: (r["pid_5"], r["pid_20"]) for r in d.collect()} for d in results]
    assert classes[0] == classes[1] and len(classes[0]) == 400
    assert results[1].columns == [*wide.columns, "pid_5", "pid_20"] and results[1].filter("_row = 1 and path = 'p'").count() == 400


def test_a_task_takes_large_nodes(spark, monkeypatch):
    """A table of 700,000 rows is split once on the cluster; each half is finished by one task."""
    kept, keep = [], A._keep
    monkeypatch.setattr(A, "_keep", lambda *a: kept.append(1) or keep(*a))
    df = spark.range(700_000).withColumn("v", F.col("id").cast("double"))
    out = A.mondrian(df, ["v"], 100_000)
    # cuts and halves of one level, and the table of the classes reached
    assert len(kept) == 3
    assert sorted(r["count"] for r in out.groupBy("pid").count().collect()) == [175_000] * 4
