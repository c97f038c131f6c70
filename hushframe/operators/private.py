"""Differentially private fits: bounded distributed aggregates plus noise.

Algorithms from published papers: objective perturbation (Chaudhuri, Monteleoni,
Sarwate 2011), the functional mechanism for least squares (Zhang et al. 2012),
private naive Bayes (Vaidya et al. 2013) and random decision trees with noisy
leaves (Fletcher, Islam 2017).  Bounds, classes and row counts are public
arguments.  ``seed=None`` draws a fresh secret; a fixed seed is for tests only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.noise import fresh_seed, laplace, laplace_value, uniform, uniform_value
from hushframe.functions.scalars import clip
from hushframe.operators.models import Scorer, gnb_scorer, linear_scorer
from hushframe.operators.moments import weighted_moments
from hushframe.session import stage

NB_BOUND = 3.0
WEIGHT_CAP = 5.0
MIN_VARIANCE = 1e-9


def _secret(seed: str | int | None) -> str | int:
    return fresh_seed() if seed is None else seed


def _check_epsilon(epsilon: float) -> None:
    if not epsilon > 0:
        raise ValueError("epsilon must be > 0")


# --- linear models ----------------------------------------------------------------


def scaled_rows(df: DataFrame, x: Column, data_norm: float) -> DataFrame:
    """Add ``_x``: the row clipped to L2 norm ``data_norm``, intercept appended, norm <= 1.

    A missing or non-finite entry counts as 0.
    """
    x = F.transform(x, lambda v: F.when(F.abs(v) < F.lit(float("inf")), v).otherwise(F.lit(0.0)))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    shrink = F.lit(1.0) / F.greatest(norm, F.lit(float(data_norm))) / F.lit(math.sqrt(2.0))
    return df.withColumn("_x", F.concat(F.transform(x, lambda v: v * shrink), F.array(F.lit(1.0 / math.sqrt(2.0)))))


def objective_noise(epsilon: float, n: int, width: int, seed: str | int) -> tuple[float, np.ndarray]:
    """Ridge strength and noise vector of objective perturbation for logistic loss (c = 1/4)."""
    lam, c = 1.0 / n, 0.25
    eps = epsilon - math.log(1 + 2 * c / (n * lam) + (c / (n * lam)) ** 2)
    extra = 0.0
    if eps <= 0:
        extra = max(c / (n * (math.exp(epsilon / 4) - 1)) - lam, 0.0)
        eps = epsilon / 2
    length = sum(-math.log(uniform_value(seed, "gamma", i)) for i in range(width)) * 2 / eps
    gauss = np.array(
        [
            math.sqrt(-2 * math.log(uniform_value(seed, "radius", i))) * math.cos(2 * math.pi * uniform_value(seed, "angle", i))
            for i in range(width)
        ]
    )
    return lam + extra, length * gauss / np.linalg.norm(gauss)


def logistic_newton(df: DataFrame, n: int, width: int, ridge: float, noise: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Minimise the perturbed logistic objective; gradient and Hessian are one job per step.

    ``df`` has ``_x`` (norm <= 1) and ``_y`` in {-1, 1}.  With ``tol`` > 0 the gradient must
    reach it within ``steps``, else the fit raises: its guarantee holds at the minimum only.
    """
    w = np.zeros(width)
    for step in range(steps + (tol > 0)):
        dot = F.aggregate(
            F.zip_with("_x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v
        )
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_y") * F.col("_d")))
        rows = df.withColumn("_d", dot).withColumn("_p", p)
        rows = rows.select("_x", (F.col("_p") * (1 - F.col("_p"))).alias("_w"), (-F.col("_y") * F.col("_p")).alias("_r"))
        h, g = weighted_moments(rows, width)
        grad = g / n + ridge * w + noise / n
        size = np.linalg.norm(grad)
        if tol > 0 and size <= tol:
            break
        if step == steps:
            raise RuntimeError(f"the private fit has gradient {size:.3g} after {steps} steps, {tol:.3g} was asked for")
        if step and size > last:
            # the step went too far: half of it is tried from where it started
            move = move / 2
            w = before - move
            continue
        before, last, move = w, size, np.linalg.solve(h / n + ridge * np.eye(width), grad)
        w = before - move
    return w


def dp_logistic(
    train: DataFrame, x: Column, width: int, label: str, epsilon: float, data_norm: float, n: int | None = None,
    seed: str | int | None = None, steps: int = 50, tol: float = 1e-9,
) -> tuple[list[float], float]:
    """Weights and intercept on the original scale.  ``n``, the number of rows, is public.

    Rows longer than ``data_norm`` are clipped for the fit; scoring uses them as they are.
    """
    _check_epsilon(epsilon)
    # every Newton step reads these rows again, so they are prepared once
    rows = stage(
        scaled_rows(train, x, data_norm).select(
            "_x", F.when(F.col(label) > 0.5, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("_y")
        )
    )
    n = rows.count() if n is None else n
    ridge, noise = objective_noise(epsilon, n, width + 1, _secret(seed))
    w = logistic_newton(rows, n, width + 1, ridge, noise, steps, tol)
    scale = data_norm * math.sqrt(2.0)
    return [float(v) / scale for v in w[:-1]], float(w[-1]) / math.sqrt(2.0)


def dp_linear(
    train: DataFrame, x: Sequence[Column], label: str, epsilon: float, bound: float, y_bounds: tuple[float, float],
    seed: str | int | None = None, floor: float = 1e-6,
) -> tuple[list[float], float]:
    """Least squares from noisy second moments; features clipped to +-bound, target to y_bounds."""
    _check_epsilon(epsilon)
    seed, d = _secret(seed), len(x)
    low, high = y_bounds
    mid, half = (low + high) / 2.0, max((high - low) / 2.0, 1e-12)
    rows = train.select(
        F.array(F.lit(1.0), *[clip(c, -bound, bound) / F.lit(float(bound)) for c in x]).alias("_x"),
        F.lit(1.0).alias("_w"),
        ((clip(F.col(label).cast("double"), low, high) - F.lit(mid)) / F.lit(half)).alias("_r"),
    )
    h, g = weighted_moments(rows, d + 1)
    # one row changes the upper triangle by at most 1 per entry, and x'y likewise
    sensitivity = (d + 1) * (d + 2) / 2.0 + (d + 1)
    scale = sensitivity / epsilon
    for i in range(d + 1):
        for j in range(i, d + 1):
            h[i, j] += laplace_value(uniform_value(seed, "xx", i, j), scale)
            h[j, i] = h[i, j]
        g[i] += laplace_value(uniform_value(seed, "xy", i), scale)
    values, vectors = np.linalg.eigh(h)
    values = np.maximum(values, floor * max(values.max(), 1.0))
    w = vectors @ ((vectors.T @ g) / values)
    return [float(v) * half / bound for v in w[1:]], float(w[0]) * half + mid


def perturb_weights(weights: DataFrame, epsilon: float, data_norm: float, seed: str | int | None = None, cap: float = WEIGHT_CAP) -> DataFrame:
    """Clip ``weight`` to +-cap and add Laplace(data_norm / epsilon), keyed by ``name``.

    A heuristic without a derived sensitivity: not a differential-privacy guarantee.
    """
    _check_epsilon(epsilon)
    u = uniform(_secret(seed), F.lit(float(epsilon)), F.lit(float(data_norm)), "name")
    return weights.withColumn("noisy_weight", clip("weight", -cap, cap) + laplace(u, data_norm / epsilon))


def perturb_values(weights: Sequence[float], epsilon: float, data_norm: float, seed: str | int | None = None, cap: float = WEIGHT_CAP) -> list[float]:
    """The same for a handful of driver-side coefficients."""
    _check_epsilon(epsilon)
    seed = _secret(seed)
    draw = lambda i: laplace_value(uniform_value(seed, float(epsilon), float(data_norm), i), data_norm / epsilon)
    return [min(cap, max(-cap, float(w))) + draw(i) for i, w in enumerate(weights)]


# --- naive Bayes ------------------------------------------------------------------


def dp_gnb_stats(
    train: DataFrame, x: Sequence[Column], label: str, epsilon: float, classes: Sequence[int],
    seed: str | int | None = None, bounds: tuple[float, float] = (-NB_BOUND, NB_BOUND),
) -> DataFrame:
    """Noisy ``label``, ``n``, ``mean<i>``, ``var<i>`` for every public class, empty ones included."""
    _check_epsilon(epsilon)
    seed, d = _secret(seed), len(x)
    low, high = bounds
    mid, h = (low + high) / 2.0, (high - low) / 2.0
    centred = [clip(c, low, high) - F.lit(mid) for c in x]
    sums = train.groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("c"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(centred)],
        *[F.sum(c * c).alias(f"q{i}") for i, c in enumerate(centred)],
    )
    public = train.sparkSession.createDataFrame([(int(c),) for c in classes], "label int")
    noisy = public.join(sums, "label", "left")

    def released(c: str, scale: float) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("double") + laplace(uniform(seed, F.lit(c), "label"), scale)

    n = F.greatest(released("c", 3.0 / epsilon), F.lit(1.0))
    noisy = noisy.select(
        "label", n.alias("n"),
        *[released(f"s{i}", 3.0 * d * h / epsilon).alias(f"s{i}") for i in range(d)],
        *[released(f"q{i}", 3.0 * d * h * h / epsilon).alias(f"q{i}") for i in range(d)],
    )
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    return noisy.select(
        "label", "n",
        *[(mean(i) + F.lit(mid)).alias(f"mean{i}") for i in range(d)],
        *[F.greatest(F.col(f"q{i}") / F.col("n") - mean(i) * mean(i), F.lit(MIN_VARIANCE)).alias(f"var{i}") for i in range(d)],
    )


def dp_gnb_model(stats: DataFrame, d: int) -> tuple[dict, dict, dict]:
    """Means, variances and noisy class shares, a few numbers per class."""
    rows = stats.collect()
    total = sum(r["n"] for r in rows)
    key = lambda r: float(r["label"])
    return (
        {key(r): [r[f"mean{i}"] for i in range(d)] for r in rows},
        {key(r): [r[f"var{i}"] for i in range(d)] for r in rows},
        {key(r): r["n"] / total for r in rows},
    )


# --- random trees -----------------------------------------------------------------


def tree_structure(trees: int, depth: int, bounds: Sequence[tuple[float, float]], seed: str | int) -> list[tuple[list[int], list[float]]]:
    """Split features and thresholds in heap order, from the seed and the bounds alone."""
    out = []
    for t in range(trees):
        features, cuts = [], []
        boxes = [list(bounds)]
        for node in range(2**depth - 1):
            box = boxes[node]
            f = min(int(uniform_value(seed, "feature", t, node) * len(box)), len(box) - 1)
            low, high = box[f]
            cut = low + uniform_value(seed, "cut", t, node) * (high - low)
            features.append(f)
            cuts.append(cut)
            boxes += [box[:f] + [(low, cut)] + box[f + 1 :], box[:f] + [(cut, high)] + box[f + 1 :]]
        out.append((features, cuts))
    return out


def _leaf_of(x: np.ndarray, tree: np.ndarray, feats: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """Heap walk of a batch of rows, each in its own tree."""
    rows, node = np.arange(len(x)), np.zeros(len(x), dtype=int)
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, feats[tree, node]] > cuts[tree, node])
    return node - (2**depth - 1)


def _arrays(structure: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([f for f, _ in structure]), np.array([c for _, c in structure])


def assign_leaves(df: DataFrame, x: Column, keys: Sequence[str], structure: list, depth: int, seed: str | int) -> DataFrame:
    """Add ``tree`` (one per row, by hash) and ``leaf``, the position among the 2^depth leaves.

    The walk runs on Arrow batches: the public structure travels once per task, not once per row.
    """
    feats, cuts = _arrays(structure)

    @F.pandas_udf(T.IntegerType())
    def leaf(v: pd.Series, tree: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series(dtype="int32")
        return pd.Series(_leaf_of(np.stack(v.to_numpy()), tree.to_numpy(), feats, cuts, depth).astype("int32"))

    own = F.floor(uniform(seed, F.lit("tree"), *keys) * F.lit(len(structure))).cast("int")
    return df.withColumn("tree", own).withColumn("leaf", leaf(x, F.col("tree")))


def dp_leaf_counts(leaves: DataFrame, label: str, trees: int, depth: int, classes: Sequence[int], epsilon: float, seed: str | int) -> DataFrame:
    """Noisy ``tree``, ``leaf``, ``label``, ``weight``; every cell of the grid gets noise, empty ones too."""
    grid = leaves.sparkSession.range(trees * 2**depth).select(
        (F.col("id") / F.lit(2**depth)).cast("int").alias("tree"),
        (F.col("id") % F.lit(2**depth)).cast("int").alias("leaf"),
        F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("label"),
    )
    counts = leaves.groupBy("tree", "leaf", F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("c"))
    noisy = F.coalesce(F.col("c"), F.lit(0)) + laplace(uniform(seed, F.lit("leaf"), "tree", "leaf", "label"), 1.0 / epsilon)
    return grid.join(counts, ["tree", "leaf", "label"], "left").select("tree", "leaf", "label", noisy.alias("weight"))


def _forest_scorer(structure: list, weights: np.ndarray, classes: Sequence[int], depth: int, x: Column) -> Scorer:
    """Average leaf shares over all trees; ``weights`` is trees x leaves x classes."""
    share = np.maximum(weights, 0.0)
    total = share.sum(axis=2, keepdims=True)
    share = np.where(total > 0, share / np.where(total > 0, total, 1.0), 1.0 / len(classes))
    feats, cuts = _arrays(structure)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def probabilities(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()) if len(v) else np.zeros((0, 1))
        acc = np.zeros((len(m), share.shape[2]))
        for t in range(len(feats)):
            acc += share[t, _leaf_of(m, np.full(len(m), t), feats, cuts, depth)]
        return pd.Series(list(acc / len(feats)))

    names = F.array(*[F.lit(float(c)) for c in classes])

    def score(df: DataFrame) -> DataFrame:
        out = df.withColumn("prob", probabilities(x))
        best = F.array_position("prob", F.array_max("prob")).cast("int")
        return out.withColumn("prediction", F.element_at(names, best))

    return score


# --- by name ----------------------------------------------------------------------


def dp_fit(
    model: str, train: DataFrame, epsilon: float, data_norm: float, width: int, keys: Sequence[str] = (),
    label: str = "label", features: str = "features", classes: Sequence[int] = (0, 1),
    y_bounds: tuple[float, float] | None = None, seed: str | int | None = None, depth: int = 10, trees: int = 50,
    n: int | None = None,
) -> Scorer:
    """Private lr, lin_reg, nb, dt or rf on a feature vector column of ``width`` entries.

    ``n`` is the public number of training rows, which logistic regression needs.
    """
    _check_epsilon(epsilon)
    seed = _secret(seed)
    x = vector_to_array(F.col(features))
    if model == "lr":
        if n is None:
            raise ValueError("the public number of rows is required for a private logistic regression")
        rows = train.select(x.alias("_v"), label)
        w, b = dp_logistic(rows, F.col("_v"), width, label, epsilon, data_norm, n=n, seed=seed)
        return linear_scorer(w, b, "classification", features)
    if model == "lin_reg":
        if y_bounds is None:
            raise ValueError("public target bounds are required for a private regression")
        rows = train.select(x.alias("_v"), label)
        w, b = dp_linear(rows, [F.col("_v")[i] for i in range(width)], label, epsilon, data_norm, y_bounds, seed)
        return linear_scorer(w, b, "regression", features)
    if model == "nb":
        rows = train.select(x.alias("_v"), label)
        stats = dp_gnb_stats(rows, [F.col("_v")[i] for i in range(width)], label, epsilon, classes, seed)
        means, variances, priors = dp_gnb_model(stats, width)

        def score(df: DataFrame) -> DataFrame:
            return gnb_scorer(means, variances, lambda i: F.col("_v")[i], priors)(df.withColumn("_v", x)).drop("_v")

        return score
    if model in ("dt", "rf"):
        count = 1 if model == "dt" else trees
        structure = tree_structure(count, depth, [(-data_norm, data_norm)] * width, seed)
        leaves = assign_leaves(train.select(*keys, label, features), x, keys, structure, depth, seed)
        weights = np.zeros((count, 2**depth, len(classes)))
        place = {int(c): i for i, c in enumerate(classes)}
        for r in dp_leaf_counts(leaves, label, count, depth, classes, epsilon, seed).collect():
            weights[r["tree"], r["leaf"], place[r["label"]]] = r["weight"]
        return _forest_scorer(structure, weights, classes, depth, x)
    raise ValueError(f"no private fit is called {model}")
