"""Lookup joins that stay safe when the lookup table or one key is large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.session import cut_lineage

# A lookup table is broadcast only when it was counted and is no larger.
BROADCAST_ROWS = 200_000
# A key with more rows than this is served by a broadcast of the hot keys alone.
HOT_ROWS = 1_000_000


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return table.limit(rows + 1).count() <= rows


def attach(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    weight: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the columns of ``table`` (one row per ``on``) to ``rows``.

    The table is materialised once and counted.  Small: broadcast, the rows do
    not move.  Large: if ``weight`` names the number of rows per key, keys
    heavier than ``hot_rows`` (at most total/hot_rows of them) are broadcast and
    only the remaining, bounded keys are shuffled; without ``weight`` AQE splits
    skewed shuffle partitions.
    """
    on = list(on)
    table = cut_lineage(table)
    if is_small(table, broadcast_rows):
        return rows.join(F.broadcast(table), on, how)
    if weight is None:
        return rows.join(table, on, how)
    total = table.agg(F.sum(weight)).first()[0] or 0
    bound = max(hot_rows, total // broadcast_rows + 1)
    hot = table.filter(F.col(weight) > bound)
    if hot.isEmpty():
        return rows.join(table, on, how)
    warm = table.filter(F.col(weight) <= bound)
    cold_rows = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on, "inner").unionByName(cold_rows.join(warm, on, how))


def overhead_factor(costs: DataFrame, baseline_method: str = "Baseline") -> DataFrame:
    """Total cost over the baseline's for the same dataset and model; 1.0 without a baseline."""
    base = costs.filter(F.col("Method") == baseline_method).groupBy("Dataset", "Model").agg(
        F.max("Total_Time_Sec").alias("_base")
    )
    return (
        costs.join(base, ["Dataset", "Model"], "left")
        .withColumn(
            "Overhead_Factor",
            F.when(F.col("_base") > 0, F.col("Total_Time_Sec") / F.col("_base")).otherwise(F.lit(1.0)),
        )
        .drop("_base")
    )


def join_best(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner equi-join where equally named other columns get a suffix per side."""
    on = list(on)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, on, "inner")


def pending_grid(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid points without a finished result; null parameters match null."""
    g, d = grid.alias("g"), done.select(*keys).distinct().alias("d")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"g.{k}").eqNullSafe(F.col(f"d.{k}"))
    return g.join(d, cond, "left_anti")
