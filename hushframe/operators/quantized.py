"""Scoring on 8-bit quantized features: plain integer column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.scalars import clip, tree_sum

BITS = 8


def _round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def calibrate(train: DataFrame, x: Sequence[Column], bits: int = BITS) -> list[float]:
    """Step size per feature from the largest finite magnitude over all training rows."""
    top = 2 ** (bits - 1) - 1
    size = lambda c: F.abs(c.cast("double"))
    row = train.agg(*[F.max(F.when(size(c) < F.lit(float("inf")), size(c))).alias(f"_x{i}") for i, c in enumerate(x)]).first()
    return [v / top if v else 1.0 for v in row]


def quantized_weights(weights: Sequence[float], steps: Sequence[float], bits: int = BITS) -> tuple[list[int], float]:
    """Integer weights with the feature steps folded in, and their common step."""
    top = 2 ** (bits - 1) - 1
    folded = [w * s for w, s in zip(weights, steps)]
    step = max((abs(v) for v in folded), default=0.0) / top or 1.0
    return [int(np.floor(v / step + 0.5)) for v in folded], step


def quantized_linear_score(x: Sequence[Column], weights: Sequence[float], intercept: float, steps: Sequence[float], bits: int = BITS) -> Column:
    """Integer dot product of clipped, rounded features and weights, scaled back once."""
    top = 2 ** (bits - 1) - 1
    whole, step = quantized_weights(weights, steps, bits)
    terms = [clip(_round(c / F.lit(s)).cast("double"), -top, top).cast("bigint") * F.lit(w) for c, w, s in zip(x, whole, steps)]
    return tree_sum(terms).cast("double") * F.lit(step) + F.lit(float(intercept))
