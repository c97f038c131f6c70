"""Row-level expressions: clipping, labels, logistic scores, names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def tree_sum(terms: Sequence[Column]) -> Column:
    """Sum of many columns as a balanced expression, so wide models do not nest deeply."""
    terms = list(terms)
    while len(terms) > 1:
        pairs = [a + b for a, b in zip(terms[::2], terms[1::2])]
        terms = pairs + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def clip(c: str | Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; a null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def sigmoid(score: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(score)))


def sigmoid_label(score: str | Column) -> Column:
    """1 when the logistic score is above one half, else 0."""
    return (sigmoid(score) > F.lit(0.5)).cast("int")


def label_contains(c: str | Column, text: str) -> Column:
    return col(c).contains(text).cast("int")


def label_map(c: str | Column, mapping: Mapping[str, int]) -> Column:
    """Label by lookup; a value outside the mapping becomes null."""
    out = F.lit(None).cast("int")
    for value, label in mapping.items():
        out = F.when(col(c) == F.lit(value), F.lit(label)).otherwise(out)
    return out


def log1p_target(c: str | Column) -> Column:
    return F.log1p(col(c))


def try_number(c: str | Column) -> Column:
    """Parse as double, null when it is not a number."""
    return F.trim(col(c).cast("string")).try_cast("double")


def format_norm(c: str | Column) -> Column:
    """``1.0`` keeps its decimal, other whole norms print without one, the rest as they are."""
    c = col(c)
    whole = (c == F.floor(c)) & (c != F.lit(1.0))
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def metric_name(method: str | Column, metric: str | Column, eps: Column, norm: Column, k: Column | None = None) -> Column:
    """Wide column name ``method_metric_Eps{e}_Norm{n}`` or ``..._K{k}``; no suffix without parameters."""
    stem = F.concat_ws("_", col(method), col(metric))
    private = F.concat(F.lit("_Eps"), eps.cast("string"), F.lit("_Norm"), format_norm(norm))
    parts = [stem, F.coalesce(private, F.lit(""))]
    if k is not None:
        parts.append(F.coalesce(F.concat(F.lit("_K"), k.cast("string")), F.lit("")))
    return F.concat(*parts)
