"""Plain models by name.  A scorer is any function that adds ``prob`` and ``prediction``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.scalars import tree_sum
from hushframe.operators import binned_forest
from hushframe.operators.features import with_class_weights

Scorer = Callable[[DataFrame], DataFrame]
CLASSIFIERS = ("lr", "nb", "dt", "rf")
REGRESSORS = ("lin_reg", "dt_reg", "rf_reg")
VAR_SMOOTHING = 1e-9


def task_of(model: str) -> str:
    if model in CLASSIFIERS:
        return "classification"
    if model in REGRESSORS:
        return "regression"
    raise ValueError(f"no model is called {model}")


def _ml_scorer(fitted) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        out = fitted.transform(df)
        if "probability" in out.columns:
            out = out.withColumn("prob", vector_to_array("probability")).drop("probability", "rawPrediction")
        return out

    score.model = fitted
    return score


def fit(
    model: str,
    train: DataFrame,
    label: str = "label",
    features: str = "features",
    seed: int = 42,
    trees: int = 50,
    depth: int = 10,
    bins: int = 32,
    balanced: bool = True,
) -> Scorer:
    """Fit one of lr, nb, dt, rf, lin_reg, dt_reg, rf_reg on a feature vector column.

    A balanced rf over many rows is grown by ``binned_forest``, else by Spark.
    """
    task_of(model)
    if model == "nb":
        return fit_gaussian_nb(train, label, features)
    common = {"featuresCol": features, "labelCol": label}
    tree = {"maxDepth": depth, "maxBins": bins, "seed": seed}
    weighted = model in ("lr", "dt", "rf") and balanced
    rows, n = train, None
    if weighted:
        rows, n = with_class_weights(train, label)
        common["weightCol"] = "weight"
    if model == "rf" and weighted and n >= binned_forest.MANY_ROWS:
        from hushframe.operators.python_models import python_scorer

        width = train.select(features).first()[0].size
        if binned_forest.fits(train, n, label, width, trees, depth, bins):
            forest = binned_forest.fit_binned(train, n, width, trees, depth, bins, seed, label, features)
            return python_scorer(train.sparkSession, forest, width, forest.shares.shape[2], features)
    if model == "lr":
        # mean loss with 1/n regularisation is sum loss with C = 1; balanced weights add up to n
        est = LogisticRegression(
            maxIter=1000, tol=1e-6, regParam=1.0 / max(train.count() if n is None else n, 1), elasticNetParam=0.0, standardization=False, **common
        )
    elif model == "lin_reg":
        est = LinearRegression(regParam=0.0, solver="normal", **common)
    elif model == "dt":
        est = DecisionTreeClassifier(**tree, **common)
    elif model == "dt_reg":
        est = DecisionTreeRegressor(**tree, **common)
    elif model == "rf":
        est = RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", **tree, **common)
    else:
        est = RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", **tree, **common)
    return _ml_scorer(est.fit(rows))


def linear_coefficients(scorer: Scorer) -> tuple[list[float], float]:
    """Weights and intercept of a linear or logistic scorer."""
    if hasattr(scorer, "weights"):
        return list(scorer.weights), float(scorer.intercept)
    fitted = scorer.model
    return [float(w) for w in fitted.coefficients], float(fitted.intercept)


def linear_score(x: Column, weights: Sequence[float], intercept: float) -> Column:
    """Dot product of an array column with literal weights."""
    return tree_sum([F.lit(float(intercept)), *[F.lit(float(w)) * x[i] for i, w in enumerate(weights)]])


def linear_scorer(weights: Sequence[float], intercept: float, task: str, features: str = "features") -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        s = linear_score(vector_to_array(F.col(features)), weights, intercept)
        out = df.withColumn("_s", s)
        if task == "regression":
            return out.withColumnRenamed("_s", "prediction")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_s")))
        return (
            out.withColumn("_p", p)
            .withColumn("prob", F.array(F.lit(1.0) - F.col("_p"), F.col("_p")))
            .withColumn("prediction", (F.col("_p") > 0.5).cast("double"))
            .drop("_s", "_p")
        )

    score.weights, score.intercept = list(weights), float(intercept)
    return score


# --- Gaussian naive Bayes with fixed priors --------------------------------------


def gnb_stats(train: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """Mean and population variance per class and column, wide: ``m<i>``, ``v<i>``."""
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
    return train.groupBy(label).agg(*aggs)


def gnb_log_likelihood(x: Sequence[Column], means: Sequence[float], variances: Sequence[float], prior: float) -> Column:
    const = math.log(prior) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in variances)
    off = [c - F.lit(float(m)) for c, m in zip(x, means)]
    return F.lit(const) - tree_sum([d * d / F.lit(2.0 * v) for d, v in zip(off, variances)])


def gnb_scorer(
    means: dict[float, Sequence[float]], variances: dict[float, Sequence[float]], inputs: Callable[[int], Column],
    priors: dict[float, float] | None = None,
) -> Scorer:
    """Score two or more classes by softmax of the joint log likelihood."""
    labels = sorted(means)
    priors = priors or {y: 1.0 / len(labels) for y in labels}

    def score(df: DataFrame) -> DataFrame:
        x = [inputs(i) for i in range(len(means[labels[0]]))]
        # one plain column per class and step: generated code, each value computed once
        ll, ex = [f"_l{i}" for i in range(len(labels))], [f"_e{i}" for i in range(len(labels))]
        out = df.withColumns({c: gnb_log_likelihood(x, means[y], variances[y], priors[y]) for c, y in zip(ll, labels)})
        out = out.withColumn("_top", F.greatest(*ll) if len(ll) > 1 else F.col(ll[0]))
        out = out.withColumns({e: F.exp(F.col(c) - F.col("_top")) for e, c in zip(ex, ll)})
        out = out.withColumn("_z", reduce(lambda a, b: a + b, [F.col(e) for e in ex]))
        best = F.lit(None).cast("double")
        for c, y in reversed(list(zip(ll, labels))):
            best = F.when(F.col(c) == F.col("_top"), F.lit(float(y))).otherwise(best)
        return out.withColumns({"prob": F.array(*[F.col(e) / F.col("_z") for e in ex]), "prediction": best}).drop(*ll, *ex, "_top", "_z")

    return score


def fit_gaussian_nb(train: DataFrame, label: str = "label", features: str = "features") -> Scorer:
    """Gaussian naive Bayes with equal priors; variances get 1e-9 of the largest column variance."""
    from pyspark.ml.stat import Summarizer

    stat = Summarizer.metrics("mean", "variance", "count")
    rows = train.groupBy(label).agg(stat.summary(F.col(features)).alias("s")).collect()
    whole = train.agg(stat.summary(F.col(features)).alias("s")).first()["s"]
    pop = lambda s: [float(v) * (s["count"] - 1) / s["count"] if s["count"] > 1 else 0.0 for v in s["variance"]]
    eps = VAR_SMOOTHING * max(pop(whole), default=0.0)
    means = {float(r[label]): [float(m) for m in r["s"]["mean"]] for r in rows}
    variances = {float(r[label]): [max(v + eps, 1e-300) for v in pop(r["s"])] for r in rows}

    def score(df: DataFrame) -> DataFrame:
        out = df.withColumn("_x", vector_to_array(F.col(features)))
        return gnb_scorer(means, variances, lambda i: F.col("_x")[i])(out).drop("_x")

    return score
