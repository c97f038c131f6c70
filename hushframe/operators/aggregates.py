"""Arg-max rows, pivots, row sums, tagged unions, parameter grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.scalars import col


def argmax_by(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str] = ()) -> DataFrame:
    """Row with the highest score per group, ties by the smallest ``tie`` columns.

    A struct aggregate: merged map-side, so a large group is never sorted.
    """
    row = F.struct(*[col(c) for c in df.columns])
    order = F.struct(-col(score), *[col(c) for c in tie])
    best = df.filter(col(score).isNotNull()).groupBy(*keys).agg(F.min_by(row, order).alias("_row"))
    return best.select("_row.*")


def pivot_mean(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Mean of ``value`` per name as columns; a missing cell is 0."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.avg(value)).na.fill(0.0, list(names))


def row_sum(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Sum of those of ``cols`` the table has; null counts as 0."""
    total = F.lit(0.0)
    for c in cols:
        if c in df.columns:
            total = total + F.coalesce(col(c), F.lit(0.0))
    return df.withColumn(name, total)


def tag_union(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both tables with a ``split`` tag to part them again."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def untag(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    part = lambda tag: df.filter(F.col("split") == tag).drop("split")
    return part("train"), part("test")


def observed_bounds(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.min(col(c)).alias("low"), F.max(col(c)).alias("high"))


def classes(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct().orderBy(c)


# Model keys of a sweep and what they are called for regression.
MODELS = ("lr", "nb", "dt", "rf")
REGRESSION_NAMES = {"lr": "lin_reg", "dt": "dt_reg", "rf": "rf_reg"}
EPSILONS = (0.1, 0.5, 1.0, 5.0, 10.0)
DATA_NORMS = (1.0, 10.0, 100.0)
K_VALUES = (2, 10, 50, 100)


def param_grid(
    datasets: DataFrame,
    epsilons: Sequence[float] = EPSILONS,
    norms: Sequence[float] = DATA_NORMS,
    models: Sequence[str] = MODELS,
) -> DataFrame:
    """Grid points per row of ``datasets(Dataset, Task_Type)``.

    Baselines have null parameters.  Regression renames the models, has no naive
    Bayes and only the linear model under privacy.
    """
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    is_reg = F.col("Task_Type") == "regression"
    named = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("cls"), F.lit(REGRESSION_NAMES.get(m)).cast("string").alias("reg"))
                for m in models
            ]
        )
    ).alias("m")
    by_model = (
        datasets.select("Dataset", "Task_Type", named)
        .withColumn("Model", F.when(is_reg, F.col("m.reg")).otherwise(F.col("m.cls")))
        .filter(F.col("Model").isNotNull())
        .drop("m")
    )
    none = F.lit(None).cast("double")
    baseline = by_model.select(
        "Dataset", "Task_Type", "Model", F.lit("Baseline").alias("Type"), none.alias("Epsilon"), none.alias("Data_Norm")
    )
    private = (
        by_model.filter(~is_reg | (F.col("Model") == "lin_reg"))
        .withColumn("Type", F.lit("DP"))
        .withColumn("Epsilon", F.explode(doubles(epsilons)))
        .withColumn("Data_Norm", F.explode(doubles(norms)))
    )
    return baseline.unionByName(private)
