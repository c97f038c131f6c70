"""Experiments over a prepared dataset: evaluation, privacy, k-anonymity, re-identification and membership sweeps.

The driver walks the grid of parameters; rows stay distributed.  A point's
predictions are written once inside its own error boundary, so a technique that fails
while fitting or while scoring costs nothing but itself, and its result can be saved
before the next point starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators import deep_forest, membership, metrics, models, private, private_prepare, quantized, quantized_trees
from hushframe.operators.aggregates import DATA_NORMS, EPSILONS, K_VALUES, MODELS, REGRESSION_NAMES, tag_union, untag
from hushframe.operators.anonymize import class_column, generalize_mean, generalize_mode, mondrian_sweep
from hushframe.operators.features import fit_features
from hushframe.operators.joins import pending_grid
from hushframe.operators.risk import class_summary, risk_summary
from hushframe.operators.smote import smote
from hushframe.operators.splits import hash_split, stratified_split
from hushframe.session import cut_lineage, stage
from hushframe.sources.results import KEYS, LONG_SCHEMA, MEMBERSHIP_SCHEMA, finished_results, save_results

LINEAR = ("lr", "lin_reg")
# The techniques, named as the reports know them.
BASELINE, DP, QUANTIZED, QUANTIZED_DP, KANON = "Baseline", "DP", "Quantized", "Quantized_DP", "KAnon"


@dataclass
class Prepared:
    """Train and test rows as key, label, features; what a private fit may know of them."""

    name: str
    task: str
    train: DataFrame
    test: DataFrame
    keys: list[str]
    width: int
    classes: list[int]
    y_bounds: tuple[float, float] | None = None
    # the number of training rows, taken as public
    rows: int | None = None
    # what a private preparation has spent; a private fit gets the rest of its epsilon
    prep_epsilon: float = 0.0


def split_rows(df: DataFrame, keys: Sequence[str], target: str, task: str, seed: str | int = 42) -> DataFrame:
    """``is_test`` for a fifth of the rows, stratified for classification."""
    if task == "classification":
        return stratified_split(df, keys, target, 0.2, seed)
    return hash_split(df, keys, 0.2, seed)


def prepare(
    df: DataFrame, name: str, keys: Sequence[str], target: str, task: str, y_bounds: tuple[float, float] | None = None,
    classes: Sequence[int] = (0, 1), seed: str | int = 42, balance: bool = False, prep_epsilon: float = 0.0,
    bounds: Mapping[str, tuple[float, float]] | None = None, categories: Mapping[str, Sequence[str]] | None = None,
    prep_seed: str | int | None = None,
) -> Prepared:
    """Split, fit the preparation on train, and write the prepared rows once for the whole sweep.

    With ``balance`` the rarer class of the training rows is filled up by SMOTE.  With
    ``prep_epsilon`` the preparation itself is private, from public ``bounds`` and
    ``categories``; every private fit then has that much less to spend.
    """
    keys = list(keys)
    parts = stage(split_rows(df, keys, target, task, seed))
    train, test = (parts.filter(c).drop("is_test") for c in (~F.col("is_test"), F.col("is_test")))
    if prep_epsilon:
        ledger = private_prepare.Ledger(prep_epsilon)
        fs = private_prepare.fit_private_features(train, bounds or {}, categories or {}, ledger, prep_epsilon, target, keys, prep_seed)
    else:
        fs = fit_features(train, target, skip=keys)
    made = lambda part: stage(
        fs.apply(part).select(*keys, F.col(target).cast("double").alias("label"), "features")
    )
    ready = made(train)
    if balance:
        ready = stage(ready.unionByName(synthetic_rows(ready, keys, fs.width, seed)))
    return Prepared(name, task, ready, made(test), keys, fs.width, list(classes), y_bounds, ready.count(), prep_epsilon)


def synthetic_rows(train: DataFrame, keys: Sequence[str], width: int, seed: str | int) -> DataFrame:
    """SMOTE rows of prepared training rows; their one text key tells the row they come from and the copy."""
    if len(keys) != 1 or dict(train.dtypes)[keys[0]] != "string":
        raise ValueError("synthetic rows need a single text key")
    x = [f"x{i}" for i in range(width)]
    rows = train.select(F.xxhash64(*keys).alias("_k"), "label", vector_to_array("features").alias("_v"))
    rows = rows.select("_k", "label", *[F.col("_v")[i].alias(c) for i, c in enumerate(x)])
    made = smote(rows, x, "label", "_k", seed=seed)
    named = F.concat_ws("-", F.lit("smote"), F.col("_k").cast("string"), F.col("copy").cast("string")).alias(keys[0])
    return made.select(named, F.col("label").cast("double").alias("label"), array_to_vector(F.array(*x)).alias("features"))


def model_names(task: str, keys: Sequence[str] = MODELS) -> list[str]:
    if task == "classification":
        return list(keys)
    return [REGRESSION_NAMES[k] for k in keys if k in REGRESSION_NAMES]


def predictions(
    scored: DataFrame, p: Prepared, model: str, method: str, epsilon: float | None = None, data_norm: float | None = None,
    k: int | None = None,
) -> DataFrame:
    """Long predictions of one grid point."""
    score = F.col("prob")[1] if "prob" in scored.columns else F.col("prediction").cast("double")
    lit = lambda v, t: F.lit(v).cast(t)
    return scored.select(
        F.lit(p.name).alias("Dataset"), F.lit(p.task).alias("Task_Type"), F.lit(model).alias("Model"),
        F.lit(method).alias("Method"), lit(epsilon, "double").alias("Epsilon"), lit(data_norm, "double").alias("Data_Norm"),
        lit(k, "int").alias("K"), F.col("label").cast("double").alias("label"),
        F.col("prediction").cast("double").alias("prediction"), score.alias("score"),
    )


POINT = ["Dataset", "Task_Type", "Model", "Method", "Epsilon", "Data_Norm", "K"]


def measure(preds: DataFrame, task: str) -> DataFrame:
    """All metrics of all grid points in long form."""
    if task == "regression":
        wide = metrics.regression_metrics(preds, POINT)
        names = {"MSE": "mse", "MAE": "mae", "R2": "r2"}
    else:
        wide = metrics.classification_metrics(preds, POINT)
        merge = lambda other: [F.col(f"w.{c}").eqNullSafe(F.col(f"o.{c}")) for c in POINT]
        for extra, name in ((metrics.auc(preds, POINT), "auc"), (metrics.auc_hard(preds, POINT), "auc_hard")):
            cond = F.lit(True)
            for c in merge(extra):
                cond = cond & c
            wide = wide.alias("w").join(F.broadcast(extra.alias("o")), cond, "left").select("w.*", f"o.{name}")
        names = {"Accuracy": "accuracy", "Precision": "precision", "Recall": "recall", "F1": "f1", "AUC": "auc", "AUC_hard": "auc_hard"}
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("Metric"), F.col(c).alias("Value")) for m, c in names.items()]))
    return wide.select(*POINT, cells.alias("_c")).select(*POINT, "_c.*", F.lit(None).cast("string").alias("Error"))


def _cells(spark: SparkSession, name: str, task: str, rows: Iterable[tuple]) -> DataFrame:
    """Driver-side cells (timings, failures): model, method, epsilon, norm, k, metric, value, error."""
    return spark.createDataFrame([(name, task, *r) for r in rows], LONG_SCHEMA)


def _long_rows(p: Prepared, rows: Iterable[tuple]) -> DataFrame:
    return _cells(p.train.sparkSession, p.name, p.task, rows)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# --- one technique at one grid point ------------------------------------------------


def score_point(p: Prepared, model: str, method: str, epsilon: float | None, data_norm: float | None, seed: str | int | None) -> tuple[models.Scorer, DataFrame]:
    """Fit one technique on the training rows; returns its scorer and the scored test rows.

    ``Quantized`` scores a plain linear fit, a tree or a forest in 8-bit integers,
    ``Quantized_DP`` perturbs linear weights first.
    """
    if method == BASELINE:
        scorer = models.fit(model, p.train)
        return scorer, scorer(p.test)
    if method == DP:
        ledger = private_prepare.Ledger(epsilon)
        if p.prep_epsilon:
            ledger.spend("preparation", p.prep_epsilon)
        scorer = private.dp_fit(
            model, p.train, ledger.rest("fit"), data_norm, p.width, p.keys, classes=p.classes, y_bounds=p.y_bounds, seed=seed, n=p.rows
        )
        return scorer, scorer(p.test)
    if method not in (QUANTIZED, QUANTIZED_DP):
        raise ValueError(f"no technique is called {method}")
    if method == QUANTIZED and model in quantized_trees.TREE_MODELS:
        scorer = quantized_trees.scorer(quantized_trees.fit(model, p.train, p.width), p.width)
        return scorer, scorer(p.test)
    if model not in LINEAR:
        raise ValueError(f"{method} is not supported for {model}")
    fitted = models.fit(model, p.train, balanced=False)
    w, b = models.linear_coefficients(fitted)
    if method == QUANTIZED_DP:
        *w, b = private.perturb_values([*w, b], epsilon, data_norm, seed)
    inputs = [F.col("_v")[i] for i in range(p.width)]
    steps = quantized.calibrate(p.train.select(vector_to_array("features").alias("_v")), inputs)

    def scorer(df: DataFrame) -> DataFrame:
        s = quantized.quantized_linear_score(inputs, w, b, steps)
        return _decided(df.withColumn("_v", vector_to_array("features")).withColumn("score", s).drop("_v"), p.task)

    return scorer, scorer(p.test)


def _decided(df: DataFrame, task: str) -> DataFrame:
    if task == "regression":
        return df.withColumn("prediction", F.col("score"))
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    out = df.withColumn("_p", chance).withColumn("prob", F.array(F.lit(1.0) - F.col("_p"), F.col("_p")))
    return out.withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")


def grid_points(task: str, epsilons: Sequence[float], norms: Sequence[float], keys: Sequence[str], methods: Sequence[str]) -> list[tuple]:
    """(model, method, epsilon, norm): methods without parameters appear once per model."""
    out = []
    for model in model_names(task, keys):
        linear = task == "classification" or model == "lin_reg"
        for method in methods:
            if method == BASELINE or (method == QUANTIZED and linear and (model in LINEAR or model in quantized_trees.TREE_MODELS)):
                out.append((model, method, None, None))
            elif method in (DP, QUANTIZED_DP) and linear and (method == DP or model in LINEAR):
                out += [(model, method, float(e), float(n)) for e in epsilons for n in norms]
    return out


def run_point(p: Prepared, point: tuple, seed: str | int | None, timings: bool) -> DataFrame:
    """Result rows of one grid point; an error while fitting, scoring or measuring becomes a row."""
    model, method, eps, norm = point
    try:
        start = metrics.clock()
        _, scored = score_point(p, model, method, eps, norm, seed)
        fitted = metrics.clock()
        # the write is the scoring pass; every metric reads it
        kept = stage(predictions(scored, p, model, method, eps, norm))
        ended = metrics.clock()
        rows = cut_lineage(measure(kept, p.task))
        if not timings:
            return rows
        cells = [(model, method, eps, norm, None, m, v, None) for m, v in (("TrainTime", fitted - start), ("InfTime", ended - fitted))]
        return rows.unionByName(_long_rows(p, cells))
    except Exception as e:  # noqa: BLE001 - isolated per technique, recorded in the result
        return _long_rows(p, [(model, method, eps, norm, None, "Failed", None, f"{type(e).__name__}: {e}")])


def privacy_sweep(
    p: Prepared, epsilons: Sequence[float] = EPSILONS, norms: Sequence[float] = DATA_NORMS, keys: Sequence[str] = MODELS,
    methods: Sequence[str] = (BASELINE, DP, QUANTIZED, QUANTIZED_DP), done: DataFrame | None = None,
    seed: str | int | None = None, timings: bool = True, save: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Long results of every grid point that is not in ``done``.

    A technique that fails leaves a row with its error instead of ending the sweep.
    With ``timings`` each fit and each scoring pass is measured in seconds; ``save`` gets
    the rows of each point as soon as it has ended.
    """
    points = grid_points(p.task, epsilons, norms, keys, methods)
    spark = p.train.sparkSession
    if done is not None:
        grid = spark.createDataFrame(points, "Model string, Method string, Epsilon double, Data_Norm double")
        left = pending_grid(grid.withColumn("Dataset", F.lit(p.name)), done, ["Dataset", "Model", "Method", "Epsilon", "Data_Norm"])
        open_points = {(r["Model"], r["Method"], r["Epsilon"], r["Data_Norm"]) for r in left.collect()}
        points = [x for x in points if x in open_points]
    parts = []
    for point in points:
        rows = run_point(p, point, seed, timings)
        if save is not None:
            save(rows)
        parts.append(rows)
    return union_all(parts) if parts else spark.createDataFrame([], LONG_SCHEMA)


def resume_sweep(p: Prepared, path: str, **options: object) -> DataFrame:
    """Run what ``path`` does not hold yet, save each point as it ends, return everything.

    A point is done when it has a metric; one that only failed is tried again.
    """
    spark = p.train.sparkSession
    held = cut_lineage(finished_results(spark, path).filter(F.col("Error").isNull()).select(*KEYS[:5]).distinct())
    privacy_sweep(p, done=held, save=lambda rows: save_results(rows, path), **options)
    return finished_results(spark, path)


# --- k-anonymity ----------------------------------------------------------------------


def kanon_utility(
    train: DataFrame, test: DataFrame, name: str, keys: Sequence[str], target: str, task: str, ks: Sequence[int] = K_VALUES,
    model_keys: Sequence[str] = MODELS, rule: str = "random", seed: str | int = 42, classes: Sequence[int] = (0, 1),
    done: Iterable[tuple[int, str]] = (), save: Callable[[DataFrame], None] | None = None, timings: bool = True, **options: object,
) -> DataFrame:
    """Anonymize train and test together at every k, refit the preparation, train and measure.

    Every k and every model inside it has its own error boundary; points (k, model) in
    ``done`` are left out and ``save`` gets each point's rows as soon as it has ended.
    With ``timings`` a point also has the seconds of its anonymization, fit and scoring;
    one build of the partition serves all k, so its time counts for each of them.
    """
    from hushframe.operators.clean import feature_roles

    spark, held = train.sparkSession, set(done)
    todo = {k: [m for m in model_names(task, model_keys) if (k, m) not in held] for k in ks}
    todo = {k: found for k, found in todo.items() if found}
    if not todo:
        return spark.createDataFrame([], LONG_SCHEMA)
    both = tag_union(train, test)
    numeric, text = feature_roles(train.drop(*keys), target)
    qi = numeric if rule == "widest" else [c for c in train.columns if c in numeric + text]
    start = metrics.clock()
    assigned = stage(
        mondrian_sweep(both, qi, list(todo), categorical=[] if rule == "widest" else text, rule=rule, seed=seed, **options)
    )
    built = metrics.clock() - start
    cells = lambda k, rows: _cells(spark, name, task, [(m, KANON, None, None, k, c, v, e) for m, c, v, e in rows])
    parts = []

    def ended(rows: DataFrame) -> None:
        if save is not None:
            save(rows)
        parts.append(rows)

    for k, names in todo.items():
        try:
            start = metrics.clock()
            rows = generalize_mean(assigned.select(*both.columns, F.col(class_column(k)).alias("pid")), numeric)
            if text and rule == "random":
                rows = generalize_mode(rows, text)
            rows = stage(rows.drop("pid"))
            process = built + metrics.clock() - start
            part_train, part_test = untag(rows)
            fs = fit_features(part_train, target, skip=keys)
            made = lambda part: fs.apply(part).select(*keys, F.col(target).cast("double").alias("label"), "features")  # noqa: B023,E731
            ready = Prepared(name, task, stage(made(part_train)), stage(made(part_test)), list(keys), fs.width, list(classes))
        except Exception as e:  # noqa: BLE001 - isolated per k, recorded for each of its models
            for model in names:
                ended(cells(k, [(model, "Failed", None, f"{type(e).__name__}: {e}")]))
            continue
        for model in names:
            try:
                start = metrics.clock()
                scorer = models.fit(model, ready.train)
                fitted = metrics.clock()
                kept = stage(predictions(scorer(ready.test), ready, model, KANON, k=k))
                scored = metrics.clock()
                out = cut_lineage(measure(kept, task))
                if timings:
                    took = {"ProcessTime": process, "TrainTime": fitted - start, "InfTime": scored - fitted}
                    out = out.unionByName(cells(k, [(model, c, v, None) for c, v in took.items()]))
            except Exception as e:  # noqa: BLE001 - isolated per model, recorded in the result
                out = cells(k, [(model, "Failed", None, f"{type(e).__name__}: {e}")])
            ended(out)
    return union_all(parts)


# --- re-identification ------------------------------------------------------------------


def reid_report(
    df: DataFrame, key: Sequence[str], qi: Sequence[str], extra: Sequence[str], target: str, task: str, ks: Sequence[int],
    targets: int | None = None, seed: str | int = 42, utility: bool = True, trees: int = 100, depth: int | None = None, **options: object,
) -> DataFrame:
    """Risk per k of the published table, beside what its quasi-identifiers are still worth to a forest.

    The class assignment is written once; risk and utility of every k read it.  The
    forest's trees grow to the end; with a ``depth`` it is Spark's own, capped there.
    """
    key, qi, extra = list(key), list(qi), list(extra)
    rows = df.select(*key, *qi, *[c for c in extra if c not in qi], target)
    assigned = stage(mondrian_sweep(rows, qi, ks, **options))
    pids = {k: class_column(k) for k in ks}
    risk = risk_summary(assigned, pids, extra, key, targets, seed=seed)
    report = class_summary(assigned, pids).join(risk, "k")
    if not utility:
        return report
    model = "rf" if task == "classification" else "rf_reg"

    def worth(table: DataFrame) -> dict[str, float]:
        from pyspark.ml.feature import VectorAssembler

        ready = VectorAssembler(inputCols=qi, outputCol="features").transform(
            hash_split(table, key, 0.3, seed).select("is_test", *qi, F.col(target).cast("double").alias("label"), *[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)])
        )
        train, test = ready.filter(~F.col("is_test")), ready.filter("is_test")
        if depth is None:
            classes = int(train.agg(F.max("label")).first()[0] or 0) + 1 if task == "classification" else 0
            forest = deep_forest.fit_forest(train, len(qi), [f"_key{i}" for i in range(len(key))], classes=classes, trees=trees, seed=seed)
            scored = stage(deep_forest.score_forest(test, forest).select("label", "prediction"))
        else:
            scored = models.fit(model, train, trees=trees, depth=depth, balanced=False)(test)
        m = metrics.classification_metrics(scored) if task == "classification" else metrics.regression_metrics(scored)
        return {c: round(v, 4) for c, v in m.first().asDict().items()}

    base = worth(assigned)
    cells = []
    for k in ks:
        table = generalize_mean(assigned.select(*rows.columns, F.col(pids[k]).alias("pid")), qi)
        got = worth(table)
        cells.append((k, base, got))
    spark = df.sparkSession
    if task == "classification":
        flat = [(k, g["accuracy"], g["f1"], b["accuracy"], b["f1"]) for k, b, g in cells]
        ml = spark.createDataFrame(flat, "k int, ml_accuracy double, ml_f1 double, _a double, _f double").select(
            "k", "ml_accuracy", "ml_f1",
            metrics.utility_drop("_a", "ml_accuracy").alias("accuracy_drop_pct"),
            metrics.utility_drop("_f", "ml_f1").alias("f1_drop_pct"),
        )
    else:
        flat = [(k, g["mse"], g["mae"], g["r2"], b["mse"], b["r2"]) for k, b, g in cells]
        ml = spark.createDataFrame(flat, "k int, ml_mse double, ml_mae double, ml_r2 double, _m double, _r double").select(
            "k", "ml_mse", "ml_mae", "ml_r2",
            metrics.utility_drop("_m", "ml_mse", rise=True).alias("mse_increase_pct"),
            metrics.utility_drop("_r", "ml_r2", absolute=True).alias("r2_drop_pct"),
        )
    return report.join(ml, "k")


# --- membership inference -----------------------------------------------------------------


def mia_points(epsilons: Sequence[float], norms: Sequence[float], keys: Sequence[str]) -> list[tuple]:
    """(model, strategy, epsilon, norm): plain and private fits of every model, weight-perturbed logistic regression."""
    points = [(m, BASELINE, None, None) for m in keys]
    points += [(m, DP, float(e), float(n)) for m in keys for n in norms for e in epsilons]
    return points + [(m, QUANTIZED_DP, float(e), float(n)) for m in keys if m == "lr" for n in norms for e in epsilons]


def mia_sweep(
    p: Prepared, epsilons: Sequence[float] = EPSILONS, norms: Sequence[float] = DATA_NORMS, keys: Sequence[str] = MODELS,
    done: Iterable[tuple] = (), seed: str | int | None = None, attack_trees: int = membership.ATTACK_TREES,
    save: Callable[[DataFrame], None] | None = None, threshold: float | None = None,
) -> DataFrame:
    """Attack accuracy of every point that is not in ``done``.

    The attack is a forest, or with ``threshold`` a call by the model's own confidence.
    ``save`` gets each point's row as soon as it has ended.
    """
    spark = p.train.sparkSession
    if p.task != "classification":
        return spark.createDataFrame([], MEMBERSHIP_SCHEMA)
    rows, held = [], set(done)
    for model, method, eps, norm in [x for x in mia_points(epsilons, norms, keys) if x not in held]:
        try:
            scorer, _ = score_point(p, model, method, eps, norm, seed)
            table = stage(membership.attack_split(membership.attack_table(scorer, p.train, p.test, p.keys), p.keys))
            if threshold is None:
                inferred = membership.forest_attack(table, p.classes, trees=attack_trees)
            else:
                inferred = membership.threshold_attack(table, threshold)
            acc = membership.attack_accuracy(inferred, p.keys).first()[0]
            row = (p.name, model, method, eps, norm, acc, None)
        except Exception as e:  # noqa: BLE001 - isolated per technique, recorded in the result
            row = (p.name, model, method, eps, norm, None, f"{type(e).__name__}: {e}")
        rows.append(row)
        if save is not None:
            save(spark.createDataFrame([row], MEMBERSHIP_SCHEMA))
    return spark.createDataFrame(rows, MEMBERSHIP_SCHEMA)
