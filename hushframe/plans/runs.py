"""Whole runs by dataset name: load, key, prepare, sweep every technique, anonymize, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.scalars import col
from hushframe.operators import clean
from hushframe.operators.aggregates import DATA_NORMS, EPSILONS, K_VALUES, MODELS
from hushframe.operators.features import label_encode
from hushframe.operators.splits import hash_split
from hushframe.plans import sweeps
from hushframe.session import stage
from hushframe.sources import registry
from hushframe.sources.results import MEMBERSHIP_SCHEMA, finished_results, save_results

KEY = "row_key"


def load_keyed(spark: SparkSession, name: str, root: str) -> tuple[DataFrame, registry.DatasetSpec]:
    """Cleaned rows of a registered dataset with a content key, written once."""
    rows, spec = registry.load(spark, name, root)
    return stage(registry.with_row_key(rows, KEY)), spec


def load_attacked(spark: SparkSession, name: str, root: str) -> tuple[DataFrame, registry.DatasetSpec]:
    """Rows as the re-identification runs see them: trimmed, complete, raw target.

    Question marks stay values and nothing is logged; a class target becomes its code.
    """
    spec = registry.SPECS.get(name)
    if spec is None or not spec.quasi_identifiers:
        raise ValueError(f"no attack roles are registered for {name}")
    rows = clean.drop_any_null(clean.trim_all(registry.read_table(spark, spec, f"{root}/{spec.path}")))
    if spec.task == "classification":
        # names may hold dots, so the target is encoded under plain ones
        names, at = rows.columns, rows.columns.index(spec.target)
        coded = label_encode(rows.toDF(*[f"c{i}" for i in range(len(names))]), f"c{at}", "_code")
        rows = coded.select(*[(F.col("_code").cast("int") if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
    return stage(registry.with_row_key(rows, KEY)), spec


def run_dataset(
    spark: SparkSession, name: str, root: str, path: str, ks: Sequence[int] = K_VALUES, y_bounds: tuple[float, float] | None = None,
    keys: Sequence[str] = MODELS, seed: str | int = 42, **options: object,
) -> DataFrame:
    """Every technique on one dataset; results are appended to ``path`` as they are made.

    A second call continues where the first one ended.
    """
    rows, spec = load_keyed(spark, name, root)
    ready = sweeps.prepare(rows, name, [KEY], spec.target, spec.task, y_bounds, seed=seed, balance=spec.smote)
    sweeps.resume_sweep(ready, path, keys=keys, seed=seed, **options)
    done = finished_results(spark, path).filter((F.col("Dataset") == name) & F.col("Error").isNull() & F.col("K").isNotNull())
    held = {(r["K"], r["Model"]) for r in done.select("K", "Model").distinct().collect()}
    parts = stage(hash_split(rows, [KEY], 0.2, seed))
    train, test = (parts.filter(c).drop("is_test") for c in (~F.col("is_test"), F.col("is_test")))
    sweeps.kanon_utility(
        train, test, name, [KEY], spec.target, spec.task, ks, keys, seed=seed, done=held, save=lambda out: save_results(out, path),
        timings=bool(options.get("timings", True)),
    )
    return finished_results(spark, path).filter(F.col("Dataset") == name)


def run_membership(
    spark: SparkSession, names: Sequence[str], root: str, path: str, keys: Sequence[str] = MODELS, seed: str | int = 42, **options: object,
) -> DataFrame:
    """Membership attacks on every classification dataset of ``names``; each point is saved as it ends.

    A second call continues where the first one ended: a dataset that is complete is not
    even loaded, and of the others the points without a result are run.
    """
    grid = {k: options[k] for k in ("epsilons", "norms") if k in options}
    wanted = set(sweeps.mia_points(grid.get("epsilons", EPSILONS), grid.get("norms", DATA_NORMS), keys))
    for name in names:
        done = finished_results(spark, path, MEMBERSHIP_SCHEMA).filter((F.col("Dataset") == name) & F.col("Error").isNull())
        held = {tuple(r) for r in done.select("Model", "Strategy", "Epsilon", "Data_Norm").collect()}
        if wanted <= held or registry.SPECS[name].task != "classification":
            continue
        rows, spec = load_keyed(spark, name, root)
        ready = sweeps.prepare(rows, name, [KEY], spec.target, spec.task, seed=seed, balance=spec.smote)
        sweeps.mia_sweep(ready, keys=keys, seed=seed, done=held, save=lambda out: save_results(out, path), **options)
    return finished_results(spark, path, MEMBERSHIP_SCHEMA).filter(F.col("Dataset").isin(list(names)))


def run_reidentification(spark: SparkSession, name: str, root: str, ks: Sequence[int] = K_VALUES, **options: object) -> DataFrame:
    """Risk per k of a registered dataset under its attack roles, over the whole table."""
    rows, spec = load_attacked(spark, name, root)
    # roles may hold dots; the report works on plain names
    plain = {c: f"c{i}" for i, c in enumerate(rows.columns) if c != KEY}
    rows = rows.select(KEY, *[col(c).alias(p) for c, p in plain.items()])
    roles = [[plain[c] for c in names] for names in (spec.quasi_identifiers, spec.extra)]
    return sweeps.reid_report(rows, [KEY], *roles, plain[spec.target], spec.task, ks, **options)
