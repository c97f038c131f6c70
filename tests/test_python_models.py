"""A user's model behind the scorer interface, up to a membership attack on it."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hushframe.operators import membership
from hushframe.operators.python_models import python_scorer


# the workers do not have this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Logistic:
    """Remembers the rows it was fitted on, so that an attack has something to find."""

    def __init__(self, known):
        self.known = {tuple(r) for r in known}
        self.most = 0

    def __call__(self, x):
        self.most = max(self.most, len(x))
        p = 1 / (1 + np.exp(-x.sum(axis=1)))
        p = np.array([float(v > 0.5) if tuple(r) in self.known else v for r, v in zip(x, p)])
        return np.stack((1 - p, p), axis=1)


def rows(spark, n, start=0):
    rng = np.random.default_rng(start)
    x = np.round(rng.standard_normal((n, 3)), 6)
    data = [(start + i, [float(v) for v in r], float(r.sum() > 0)) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id int, x array<double>, label double").withColumn("features", array_to_vector("x")), x


def test_scores_and_attack(spark):
    train, x = rows(spark, 300)
    test, z = rows(spark, 300, 1_000)
    model = Logistic(x)
    score = python_scorer(spark, model, 3, call_bytes=8 * 3 * 7)
    for df, values in ((train, x), (test, z)):
        got = {r["id"]: r for r in score(df.repartition(5)).collect()}
        first = min(got)
        want = model(values)
        assert all(np.allclose(got[first + i]["prob"], p) and got[first + i]["prediction"] == int(np.argmax(p)) for i, p in enumerate(want))
    table = membership.attack_split(membership.attack_table(score, train, test, ["id"]), ["id"])
    inferred = membership.threshold_attack(table, 1.0)
    assert membership.attack_accuracy(inferred, ["id"]).first()[0] > 0.95


def test_calls_are_bounded_and_never_empty(spark):
    df, _ = rows(spark, 100)

    def predict(x):
        assert 0 < len(x) <= 4 and x.shape[1] == 3
        return x[:, 0]

    score = python_scorer(spark, predict, 3, classes=0, call_bytes=8 * 3 * 4)
    got = score(df.repartition(3)).collect()
    assert all(r["prediction"] == r["x"][0] for r in got) and len(got) == 100
    assert score(df.limit(0)).count() == 0 and score(df.filter("id < 0").repartition(4)).collect() == []


def test_failures_say_what_failed(spark):
    df, _ = rows(spark, 10)

    def broken(x):
        raise KeyError("weights")

    with pytest.raises(Exception, match="the model failed on 10 rows: KeyError"):
        python_scorer(spark, broken, 3)(df.coalesce(1)).collect()
    with pytest.raises(Exception, match="was expected"):
        python_scorer(spark, lambda x: x, 3)(df).collect()
    with pytest.raises(Exception):
        python_scorer(spark, spark.sparkContext, 3)
