"""Embedding whitening: principal components of all vectors, scaled to unit variance.

Entries become integers, so the sums that make mean and covariance are exact and the
same in every order: one pass sums the entries, a second the products of entries less
their rounded mean, and the rest of the mean is taken off exactly.  What the driver
gets is one number per pair of dimensions, whatever the number of vectors.

Defined cases: vectors that are null, hold a null or non-finite entry or one of 2**52 or
more in absolute value (no long holds it) are left out, and so are vectors whose length
is not the most frequent one (the longer of equally frequent ones); repeated rows count
as often as they occur; a null id stays null; components without variance are left out,
so equal vectors alone give no row; a deviation that passes 64 bits is null; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.feast import largest
from hushframe.session import stage

COMPONENTS = 8
# Fixed by the contract.
SCALE, OFFSET = 1024, 100_000
LIMIT = float(1 << 52)
BATCH = 4_096


@dataclass
class Whitening:
    """Number of vectors, sums by dimension, eigenvalues and vectors (columns), trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(embeddings: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the vectors that take part, as doubles."""
    rows = embeddings.select(F.col(ident).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LIMIT)))
    rows = rows.filter(F.col("vector").isNotNull() & good)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc())
    first = sizes.first()
    return rows.filter(F.size("vector") == (first.d if first else 0))


def _integers(batches: Iterator, size: int) -> Iterator:
    """(batch, entries as integers) in bounded pieces."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            # an integer beyond 2**53 has no half, so nothing is lost in the float
            c = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)
            yield part, np.floor(c * SCALE).astype(np.int64) + OFFSET


def _fits(values: np.ndarray, terms: int, bits: int) -> bool:
    """Whether sums of ``terms`` products of two of the values stay below 2**bits."""
    most = int(np.abs(values).max(initial=0))
    return most * most * terms < 1 << bits


def _summed(rows: DataFrame, size: int, cells: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Exact sums over all vectors of the ``cells`` (numbers, integers) of a block of them."""

    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for _, x in _integers(batches, size):
            numbers, values = cells(x)
            total = values.astype(object) if total is None else total + values
        if total is not None:
            value = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), value], ["cell", "value"])

    found = rows.select("vector").mapInArrow(part, "cell long, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value"))
    return {r.cell: int(r.value) for r in found.collect()}


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Mean and principal components of ``usable`` rows; None without a row."""
    first = rows.select(F.size("vector").alias("d")).first()
    if first is None or not first.d:
        return None
    size = first.d

    def sums(x):
        exact = x if int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object)
        return np.arange(size + 1), np.concatenate(([len(x)], exact.sum(0)))

    found = _summed(rows, size, sums)
    n, total = found[0], [found[i + 1] for i in range(size)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    upper = np.triu_indices(size)

    def products(x):
        y = x - np.array(centre, np.int64)
        # floats are exact below 2**53, longs below 2**63
        if _fits(y, len(y), 53):
            square = (y.astype(float).T @ y.astype(float)).astype(np.int64)
        else:
            y = y if _fits(y, len(y), 62) else y.astype(object)
            square = y.T @ y
        return upper[0] * size + upper[1], square[upper]

    squares = _summed(rows, size, products)
    rest = [s - n * c for s, c in zip(total, centre)]
    covariance = np.empty((size, size))
    for i, j in zip(*map(np.ndarray.tolist, upper)):
        covariance[i, j] = covariance[j, i] = (n * squares[i * size + j] - rest[i] * rest[j]) / (n * n)
    values, vectors = largest(rows.sparkSession, covariance, components)
    return Whitening(n, total, values, vectors, float(np.trace(covariance)))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): projections on all components, divided by their standard deviation."""
    size, n = len(model.sums), model.n
    centre = [(2 * s + n) // (2 * n) for s in model.sums]
    rest = [s - n * c for s, c in zip(model.sums, centre)]
    shared = rows.sparkSession.sparkContext.broadcast(model)
    ident = rows.schema["vec_id"].dataType.simpleString()

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        scaled = m.vectors / np.sqrt(m.values)
        exact, small = np.array(rest, object), np.array([r / n for r in rest])
        for part, x in _integers(batches, size):
            y = x - np.array(centre, np.int64)
            wide = int(np.abs(y).max(initial=0)) * n + max(map(abs, rest)) >= 1 << 31
            far = (y.astype(object) if wide else y) * n - (exact if wide else exact.astype(np.int64))
            squares = [int(v) for v in (far * far).sum(1)] if wide or size >= 1 << 20 else _row_sums(far)
            white = (y - small) @ scaled
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([v if v < 1 << 63 else None for v in squares], pa.int64()),
                    pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), white.shape[1]).cast(pa.list_(pa.float64())),
                ],
                ["vec_id", "deviation", "whitened"],
            )

    return rows.select("vec_id", "vector").mapInArrow(apply, f"vec_id {ident}, deviation long, whitened array<double>")


def _row_sums(far: np.ndarray) -> list[int]:
    """Exact sums of squares of entries below 2**31: high and low halves apart."""
    squares = far * far
    high, low = (squares >> 32).sum(1), (squares & 0xFFFFFFFF).sum(1)
    return [(int(h) << 32) + int(v) for h, v in zip(high, low)]


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity."""
    w = [F.element_at("whitened", i + 1) for i in range(components)]
    off = [F.abs(F.covar_pop(w[i], w[j]) - F.lit(float(i == j))) for i in range(components) for j in range(i + 1)]
    return max(whitened.agg(*[o.alias(f"c{k}") for k, o in enumerate(off)]).first())


def vector_components(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component."""
    rows = usable(embeddings)
    kind = rows.schema["vec_id"].dataType.simpleString()
    model = fit(rows, components)
    count = 0 if model is None else len(model.values)
    if not count:
        return embeddings.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    white = stage(whiten(rows, model))
    error = identity_error(white, count)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "white"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("white").alias("whitened"), F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
