"""Second-moment sums over the rows: the one distributed step of every linear fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to this width the products stay in generated code; wider ones use one matrix product per batch.
NARROW = 12


def weighted_moments(df: DataFrame, width: int, x: str = "_x", w: str = "_w", r: str = "_r") -> tuple[np.ndarray, np.ndarray]:
    """``sum w x x'`` and ``sum r x`` for an array column ``x``; one job, d*d numbers come back."""
    if width <= NARROW:
        cells = [(i, j) for i in range(width) for j in range(i, width)]
        row = df.agg(
            *[F.sum(F.col(w) * F.col(x)[i] * F.col(x)[j]).alias(f"h{i}_{j}") for i, j in cells],
            *[F.sum(F.col(r) * F.col(x)[i]).alias(f"g{i}") for i in range(width)],
        ).first()
        h = np.zeros((width, width))
        for i, j in cells:
            h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
        return h, np.array([row[f"g{i}"] or 0.0 for i in range(width)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, g = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            m = np.stack(b[x].to_numpy()) if len(b) else np.zeros((0, width))
            h += m.T @ (m * b[w].to_numpy()[:, None])
            g += m.T @ b[r].to_numpy()
        rows = np.vstack([h, g])
        i, j = np.indices(rows.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": rows.ravel()})

    sums = df.select(x, w, r).mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width + 1, width))
    for c in sums.collect():
        out[c["i"], c["j"]] = c["v"]
    return out[:width], out[width]
