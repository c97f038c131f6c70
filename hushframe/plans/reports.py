"""Reports over result tables: wide to long, best per method, cost, trade-off curve."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.scalars import col, format_norm, metric_name, try_number
from hushframe.operators.aggregates import argmax_by, pivot_mean, row_sum
from hushframe.operators.joins import join_best, overhead_factor

# Column prefixes of a wide result row and their report labels.
METHODS = {"Baseline": "Baseline", "DP": "DP", "DP_PHE": "DP-PHE", "FHE": "DP-FHE", "FHE_DP": "DP-FHE-W"}
CURVE_METHODS = {"DP": "DP", "DP_PHE": "DP-PHE", "FHE": "FHE", "FHE_DP": "DP-FHE"}
# Techniques of this library's own sweeps, named alike in long rows and in wide columns.
OWN_METHODS = {"Quantized": "Quantized", "Quantized_DP": "Quantized_DP"}
UTILITY_METRICS = ("F1", "R2", "AUC")
COST_METRICS = ("TrainTime", "InfTime", "CompileTime")
COMPILED = ("FHE", "FHE_DP")
IDS = ("Dataset", "Model", "Task_Type")


def parse_metric_names(columns: Sequence[str], metrics: Sequence[str], kanon: bool = False) -> list[tuple[str, str, str, str, str]]:
    """(column, method, metric, epsilon, norm) of each column that is a known metric."""
    labels = METHODS | OWN_METHODS
    prefixes = "|".join(sorted(labels, key=len, reverse=True))
    shape = re.compile(rf"({prefixes})_({'|'.join(metrics)})(?:_Eps([0-9.]+)_Norm([0-9.]+))?")
    anon = re.compile(rf"KAnon_({'|'.join(metrics)})_K([0-9]+)")
    out = []
    for c in columns:
        m = shape.fullmatch(c)
        if m:
            prefix, metric, eps, norm = m.groups()
            bare = prefix in ("Baseline", "Quantized")
            if bare != (eps is None) or (metric == "CompileTime" and prefix not in COMPILED):
                continue
            out.append((c, labels[prefix], metric, eps or "None", norm or "None"))
        elif kanon and (m := anon.fullmatch(c)):
            out.append((c, "KAnon", m[1], f"K={m[2]}", "None"))
    return out


def unpivot_metrics(wide: DataFrame, metrics: Sequence[str], ids: Sequence[str] = IDS, positive: bool = False, kanon: bool = False) -> DataFrame:
    """Long rows (ids, Method, Metric_Type, Score, Epsilon, Data_Norm) of the numeric cells.

    Names are schema, so they are parsed once on the driver; each cell carries its
    parsed name through a single explode, with no join.
    """
    cells = [
        F.struct(
            F.lit(method).alias("Method"), F.lit(metric).alias("Metric_Type"), try_number(c).alias("Score"),
            F.lit(eps).alias("Epsilon"), F.lit(norm).alias("Data_Norm"),
        )
        for c, method, metric, eps, norm in parse_metric_names(wide.columns, metrics, kanon)
    ]
    if not cells:
        raise ValueError("no metric columns in the table")
    long = wide.select(*[col(c) for c in ids], F.explode(F.array(*cells)).alias("_c")).select(*ids, "_c.*")
    present = F.col("Score").isNotNull() & ~F.isnan("Score")
    return long.filter(present & (F.col("Score") > 0) if positive else present)


def unpivot_utility(wide: DataFrame, kanon: bool = False) -> DataFrame:
    return unpivot_metrics(wide, UTILITY_METRICS, kanon=kanon)


def unpivot_cost(wide: DataFrame) -> DataFrame:
    long = unpivot_metrics(wide, COST_METRICS, positive=True)
    return long.select(*IDS, "Method", F.col("Metric_Type").alias("Metric"), F.col("Score").alias("Seconds"))


def _best(long: DataFrame, metric: str) -> DataFrame:
    keys = ["Dataset", "Task_Type", "Model", "Method"]
    # several source rows may hold the same score: the first parameters in order win
    best = argmax_by(long.filter(F.col("Metric_Type") == metric), keys, "Score", ["Epsilon", "Data_Norm"])
    return best.select(*keys, F.col("Score").alias(f"Best_{metric}_Score"), "Epsilon", "Data_Norm")


def best_tradeoff_cls(long: DataFrame) -> DataFrame:
    """Best F1 and best AUC per dataset, model and method, highest F1 first."""
    rows = long.filter(F.col("Task_Type") == "classification")
    on = ["Dataset", "Task_Type", "Model", "Method"]
    return join_best(_best(rows, "F1"), _best(rows, "AUC"), on, ("_f1", "_auc")).orderBy(
        "Task_Type", "Dataset", F.desc("Best_F1_Score")
    )


def best_tradeoff_reg(long: DataFrame) -> DataFrame:
    rows = long.filter(F.col("Task_Type") != "classification")
    return _best(rows, "R2").orderBy("Task_Type", "Dataset", F.desc("Best_R2_Score"))


def cost_report(long: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean seconds per phase, total and factor over the baseline; ``sizes``: Dataset, Dataset_Rows."""
    pivot = pivot_mean(long, ["Dataset", "Model", "Task_Type", "Method"], "Metric", "Seconds", COST_METRICS)
    total = row_sum(pivot, COST_METRICS, "Total_Time_Sec")
    return overhead_factor(total).join(sizes, "Dataset", "left").orderBy("Task_Type", "Dataset", "Overhead_Factor")


def tradeoff_curve(wide: DataFrame, epsilons: Sequence[str], norm: float = 1.0, ids: Sequence[str] = ("Dataset", "Model")) -> DataFrame:
    """F1 per method and epsilon at one norm beside the baseline; gaps stay null."""
    shown = "1.0" if norm == 1.0 else f"{norm:g}"

    def f1(name: str):
        return F.max(try_number(name)) if name in wide.columns else F.max(F.lit(None).cast("double"))

    one = wide.groupBy(*ids).agg(
        f1("Baseline_F1").alias("Baseline"),
        *[f1(f"{p}_F1_Eps{e}_Norm{shown}").alias(f"{p}|{e}") for p in CURVE_METHODS for e in epsilons],
    )
    points = F.array(
        *[
            F.struct(F.lit(e).alias("Epsilon"), *[F.col(f"`{p}|{e}`").alias(label) for p, label in CURVE_METHODS.items()])
            for e in epsilons
        ]
    )
    return one.select(*ids, "Baseline", F.explode(points).alias("_p")).select(*ids, "Baseline", "_p.*")


def pivot_export(long: DataFrame, names: Sequence[str] | None = None, ids: Sequence[str] = IDS) -> DataFrame:
    """Long results back to one wide row: a column per method, metric and parameters.

    Two different values for one cell are an error, never a choice.
    """
    eps, norm = F.col("Epsilon").cast("double"), F.col("Data_Norm").cast("double")
    k = F.col("K").cast("int") if "K" in long.columns else None
    named = long.withColumn("_name", metric_name("Method", "Metric", eps, norm, k))
    twice = F.concat(F.lit("two values for one cell of "), F.max("_name"))
    cell = F.when(F.min("Value") == F.max("Value"), F.min("Value")).when(F.count("Value") > 0, F.raise_error(twice).cast("double"))
    return named.groupBy(*ids).pivot("_name", list(names) if names else None).agg(cell)


def utility_of(long: DataFrame) -> DataFrame:
    """Result rows of a sweep as the rows of ``unpivot_utility``."""
    shown = lambda c: F.coalesce(c, F.lit("None"))
    eps = F.coalesce(F.concat(F.lit("K="), F.col("K").cast("string")), F.col("Epsilon").cast("string"))
    return long.filter(F.col("Metric").isin(*UTILITY_METRICS) & F.col("Value").isNotNull() & ~F.isnan("Value")).select(
        *IDS, "Method", F.col("Metric").alias("Metric_Type"), F.col("Value").alias("Score"), shown(eps).alias("Epsilon"),
        shown(format_norm("Data_Norm")).alias("Data_Norm"),
    )


def cost_of(long: DataFrame) -> DataFrame:
    """Timings of a sweep as the rows of ``unpivot_cost``."""
    return long.filter(F.col("Metric").isin(*COST_METRICS) & (F.col("Value") > 0)).select(
        *IDS, "Method", "Metric", F.col("Value").alias("Seconds")
    )


__all__ = [
    "best_tradeoff_cls", "best_tradeoff_reg", "cost_report", "format_norm", "parse_metric_names", "pivot_export",
    "cost_of", "tradeoff_curve", "unpivot_cost", "unpivot_metrics", "unpivot_utility", "utility_of",
]
