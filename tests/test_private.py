import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hushframe.operators import quantized, membership, models, moments, private
from hushframe.operators.smote import nearest_vectors, smote


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2)).clip(-3, 3)
    y = (x @ [2.0, -1.0] + 0.5 + rng.logistic(size=3000) > 0).astype(int)
    t = x @ [0.6, -0.2] + 0.1
    rows = [(i, float(a), float(b), int(c), float(d)) for i, ((a, b), c, d) in enumerate(zip(x, y, t))]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int, t double")
    return df.withColumn("features", array_to_vector(F.array("a", "b"))).cache()


def test_private_fits_approach_plain_ones(line):
    w, b = private.dp_logistic(line, F.array("a", "b"), 2, "label", 1e6, 5.0, seed=1)
    # n * lambda = 1 on rows shrunk to norm 1 still pulls the weights in, the direction stays
    assert w[0] > 0 > w[1] and abs(w[0] / w[1] + 2.0) < 0.4 and b > 0
    w, b = private.dp_linear(line, [F.col("a"), F.col("b")], "t", 1e7, 3.0, (-4.0, 4.0), seed=1)
    assert np.allclose([*w, b], [0.6, -0.2, 0.1], atol=1e-3)
    stats = private.dp_gnb_stats(line, [F.col("a"), F.col("b")], "label", 1e7, [0, 1], 1).collect()
    truth = {r["label"]: r for r in line.groupBy("label").agg(F.avg("a").alias("m"), F.var_pop("b").alias("v"), F.count("a").alias("n")).collect()}
    for r in stats:
        want = truth[r["label"]]
        assert np.allclose([r["mean0"], r["var1"], r["n"]], [want["m"], want["v"], want["n"]], atol=1e-3)


def test_objective_noise_budget():
    _, loose = private.objective_noise(10.0, 1000, 3, 1)
    ridge, tight = private.objective_noise(0.1, 1000, 3, 1)
    assert np.linalg.norm(tight) > np.linalg.norm(loose) and ridge > 1 / 1000
    lengths = [np.linalg.norm(private.objective_noise(1.0, 100, 4, s)[1]) for s in range(400)]
    eps = 1.0 - math.log(1 + 0.5 + 0.0625)
    assert abs(np.mean(lengths) - 4 * 2 / eps) < 1.0  # Gamma(d, 2/eps) has mean d * 2/eps


def test_one_row_changes_sums_within_sensitivity(spark, line):
    x = [F.col("a"), F.col("b")]
    far = spark.createDataFrame([(-1, 99.0, -99.0, 1, 99.0)], "id int, a double, b double, label int, t double")
    more = line.drop("features").unionByName(far)
    # same seed, same noise: the difference is the clipped row alone
    one = {r["label"]: r for r in private.dp_gnb_stats(line, x, "label", 1.0, [0, 1], 9).collect()}
    two = {r["label"]: r for r in private.dp_gnb_stats(more, x, "label", 1.0, [0, 1], 9).collect()}
    assert one[0] == two[0]
    assert np.isclose(two[1]["n"] - one[1]["n"], 1.0)
    assert abs(two[1]["mean0"] * two[1]["n"] - one[1]["mean0"] * one[1]["n"]) <= 3.0 + 1e-6
    rows = more.select(F.array("a", "b").alias("v"))
    norms = private.scaled_rows(rows, F.col("v"), 2.0).select(F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)).alias("n"))
    assert norms.agg(F.max("n")).first()[0] <= 1.0 + 1e-9


def test_empty_classes_and_leaves_get_noise(spark, line):
    stats = {r["label"]: r["n"] for r in private.dp_gnb_stats(line, [F.col("a")], "label", 0.01, [0, 1, 7], 3).collect()}
    assert set(stats) == {0, 1, 7}
    s = private.tree_structure(2, 6, [(-3.0, 3.0)] * 2, 3)
    leaves = private.assign_leaves(line, F.array("a", "b"), ["id"], s, 6, 3)
    assert leaves.count() == 3000
    cells = private.dp_leaf_counts(leaves, "label", 2, 6, [0, 1], 1.0, 3)
    assert cells.count() == 2 * 64 * 2 and cells.filter("weight = 0").count() == 0


@pytest.mark.parametrize("model", ["lr", "nb", "dt", "rf"])
def test_dp_fit_scores(line, model):
    scorer = private.dp_fit(model, line, 50.0, 3.0, 2, ["id"], seed=4, depth=8, trees=8, n=line.count())
    out = scorer(line)
    acc = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert acc > 0.6 and out.filter(F.abs(F.col("prob")[0] + F.col("prob")[1] - 1) > 1e-9).count() == 0


def test_dp_fit_rejects(line):
    with pytest.raises(ValueError):
        private.dp_fit("svm", line, 1.0, 1.0, 2)
    with pytest.raises(ValueError):
        private.dp_fit("lr", line, 0.0, 1.0, 2)
    with pytest.raises(ValueError):
        private.dp_fit("lin_reg", line, 1.0, 1.0, 2, label="t")
    with pytest.raises(ValueError):
        models.fit("svm", line)


def test_wide_moments_equal_narrow(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    df = spark.createDataFrame([(r.tolist(), float(i % 3), float(i)) for i, r in enumerate(x)], "_x array<double>, _w double, _r double")
    narrow = moments.weighted_moments(df, 4)
    monkeypatch.setattr(moments, "NARROW", 0)
    wide = moments.weighted_moments(df.repartition(3), 4)
    w = np.arange(200) % 3
    for h, g in (narrow, wide):
        assert np.allclose(h, x.T @ (x * w[:, None])) and np.allclose(g, x.T @ np.arange(200))


def test_weight_noise_depends_on_parameters():
    a = private.perturb_values([9.0, 0.1], 1.0, 1.0, 5)
    b = private.perturb_values([9.0, 0.1], 0.5, 1.0, 5)
    assert a != b and (a[0] - 5.0) * 2 != pytest.approx(b[0] - 5.0)
    with pytest.raises(ValueError):
        private.perturb_values([1.0], 0.0, 1.0)


def test_calibration_covers_every_row(spark):
    rows = spark.createDataFrame([(i, float(i), -1.0) for i in range(500)] + [(500, float("inf"), 7.0), (501, None, float("nan"))], "id int, a double, b double")
    assert quantized.calibrate(rows, [F.col("a"), F.col("b")]) == [499 / 127, 7 / 127]


def test_fit_must_converge(line):
    x = F.array("a", "b")
    with pytest.raises(RuntimeError, match="after 1 steps"):
        private.dp_logistic(line, x, 2, "label", 1.0, 3.0, seed=3, steps=1)
    w, b = private.dp_logistic(line, x, 2, "label", 1.0, 3.0, seed=3)
    assert all(np.isfinite([*w, b]))


def test_non_finite_features_count_as_zero(spark):
    plain = [(i, float(i % 5), float(i % 3), i % 2) for i in range(60)]
    zero = spark.createDataFrame(plain + [(99, 0.0, 1.0, 1)], "id int, a double, b double, label int")
    odd = spark.createDataFrame(plain + [(99, float("nan"), 1.0, 1)], "id int, a double, b double, label int")
    fit = lambda df: private.dp_logistic(df, F.array("a", "b"), 2, "label", 2.0, 3.0, seed=3)
    # sums of doubles may differ in the last bit from run to run
    for a, b in zip(fit(zero), fit(odd)):
        assert a == pytest.approx(b, rel=1e-12)


def test_row_count_is_public(line):
    with pytest.raises(ValueError, match="public number of rows"):
        private.dp_fit("lr", line, 1.0, 1.0, 2)


def test_quantized_score_is_close(line):
    x = [F.col("a"), F.col("b")]
    steps = quantized.calibrate(line, x)
    s = quantized.quantized_linear_score(x, [2.0, -1.0], 0.5, steps)
    err = line.select(F.abs(s - (2 * F.col("a") - F.col("b") + 0.5)).alias("e")).agg(F.avg("e")).first()[0]
    assert err < 0.1


def brute_neighbours(points, k):
    out = {}
    for i, (a, x) in enumerate(points):
        d = sorted((float(((np.array(x) - np.array(y)) ** 2).sum()), b) for j, (b, y) in enumerate(points) if j != i)
        out[a] = [b for _, b in d[:k]]
    return out


@pytest.mark.parametrize("chunk", [8, 64, 2048])
def test_nearest_vectors_are_exact(spark, chunk):
    rng = np.random.default_rng(chunk)
    grid = {(int(a), int(b)) for a, b in rng.integers(0, 25, size=(150, 2))}  # many equal distances
    points = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(sorted(grid))]
    df = spark.createDataFrame(points, "id bigint, x array<double>").repartition(4)
    got = {}
    for r in nearest_vectors(df, 2, 5, chunk).orderBy("id", "rk").collect():
        got.setdefault(r["id"], []).append(r["near"])
    assert got == brute_neighbours(points, 5)


def test_smote_balances_and_stays_between(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(v), 1.0, 0) for i, v in enumerate(rng.normal(size=200))]
    rows += [(1000 + i, 5.0 if i < 8 else float(i), 2.0, 1) for i in range(12)]  # two thirds are copies
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    out = smote(df, ["a", "b"], "y", "id", chunk_rows=4).toPandas()
    assert len(out) == 188 and (out["y"] == 1).all() and out["a"].between(5.0, 11.0).all()
    assert (out["b"] == 2.0).all() and out.groupby("id").size().isin([15, 16]).all()
    assert not out.duplicated(["id", "copy"]).any()


def test_membership_of_a_memorizing_model(spark):
    rows = [(i, int(i % 2), i < 400) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, label int, member boolean")

    def scorer(part):
        sure = F.when(F.col("member"), 0.95).otherwise(0.6)
        p = F.when(F.col("label") == 1, sure).otherwise(1 - sure)
        return part.withColumn("prob", F.array(1 - p, p)).drop("member")

    table = membership.attack_split(membership.attack_table(scorer, df.filter("member"), df.filter("NOT member"), ["id"]), ["id"])
    forest = membership.forest_attack(table, [0, 1], trees=5, depth=3)
    assert membership.attack_accuracy(forest, ["id"]).first()[0] > 0.95
    assert membership.attack_accuracy(membership.threshold_attack(table, 0.9), ["id"]).first()[0] == 1.0
    assert membership.attack_accuracy(membership.threshold_attack(table, 0.0), ["id"]).first()[0] == 0.5
