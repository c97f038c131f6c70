"""Largest eigenpairs of a symmetric matrix by contour integrals (FEAST) with inertia counts.

The signs of the pivots of V - sI tell how many eigenvalues lie below s, so bisection
finds a bound above which the wanted ones lie and cuts the range into intervals of few.
On a circle through both ends of an interval, a Gauss-Legendre sum of complex shifted
solves projects a block of vectors onto the interval's eigenvectors; Rayleigh-Ritz takes
them out of the block.  The solves of all intervals and nodes are independent, one Spark
row each.  An interval is done when it holds as many pairs as the pivots counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

NODES = 8
# An interval with more eigenvalues is cut, unless it is too short.
MOST = 6
ROUNDS = 30
SEED = 42


def below(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``matrix`` below ``shift``: negative pivots of a Bunch-Kaufman elimination."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, negative = len(a), 0, 0
    alpha = (1 + np.sqrt(17)) / 8

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        column = np.abs(a[k + 1:, k])
        most = column.max(initial=0.0)
        if most == 0:
            negative += int(a[k, k] < 0)
            k += 1
            continue
        r, two = k + 1 + int(column.argmax()), False
        if abs(a[k, k]) < alpha * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * most * most:
                if abs(a[r, r]) >= alpha * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            # a pivot of two rows has one eigenvalue of either sign
            negative += 1
            block, rest = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            negative += int(a[k, k] < 0)
            rest = a[k + 1:, k].copy()
            a[k + 1:, k + 1:] -= np.outer(rest, rest / a[k, k])
            k += 1
    return negative


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(from, to, eigenvalues) that together hold the ``wanted`` largest eigenvalues, above zero by more than rounding."""
    size = len(matrix)
    top = float(np.abs(matrix).sum(1).max()) * (1 + 1e-12)
    zero = top * size * 1e-14
    if not top > 0:
        return []
    above = lambda s: size - below(matrix, s)
    low, high, count = zero, top, above(zero)
    wanted = min(wanted, count)
    if not wanted:
        return []
    while count > wanted and high - low > top * 1e-13:
        middle = (low + high) / 2
        found = above(middle)
        if found >= wanted:
            low, count = middle, found
        else:
            high = middle
    todo, out = [(low, top, count, 0)], []
    while todo:
        a, b, n, beyond = todo.pop()
        middle = (a + b) / 2
        if n <= MOST and (b - a) < 4 * abs(a) or b - a < top * 1e-9:
            out.append((a, b, n))
            continue
        right = above(middle) - beyond
        todo += [part for part in ((a, middle, n - right, beyond + right), (middle, b, right, beyond)) if part[2]]
    return sorted(out)


def _solved(spark: SparkSession, matrix, work: list[tuple[int, complex, complex, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sum of Re(factor * (shift I - V)^-1 Y) by interval; one row per shift."""

    def solve(batches: Iterator) -> Iterator:
        import pandas as pd

        v = matrix.value
        for batch in batches:
            blocks = []
            for r in batch.itertuples():
                y = np.frombuffer(r.y).reshape(len(v), -1)
                x = np.linalg.solve(complex(r.re, r.im) * np.eye(len(v)) - v, y.astype(complex))
                blocks.append((complex(r.fre, r.fim) * x).real.tobytes())
            yield pd.DataFrame({"interval": batch.interval, "block": blocks})

    rows = [(i, *map(float, (z.real, z.imag, f.real, f.imag)), y.tobytes()) for i, z, f, y in work]
    frame = spark.createDataFrame(rows, "interval int, re double, im double, fre double, fim double, y binary").repartition(len(rows))
    out: dict[int, np.ndarray] = {}
    # a few vectors of the matrix's length per shift, summed in a fixed order
    for i, block in sorted(map(tuple, frame.mapInPandas(solve, "interval int, block binary").collect())):
        out[i] = out.get(i, 0) + np.frombuffer(block)
    return out


def largest(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest positive eigenvalues, falling, and their unit eigenvectors as columns.

    Fewer where the matrix has fewer positive eigenvalues.  Of each vector the largest
    entry in absolute value is positive.
    """
    parts = intervals(matrix, wanted)
    if not parts:
        return np.empty(0), np.empty((len(matrix), 0))
    size, scale = len(matrix), np.abs(matrix).sum(1).max()
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - nodes))
    rng = np.random.Generator(np.random.PCG64(SEED))
    guess = {i: rng.standard_normal((size, min(size, max(2 * n, n + 4)))) for i, (_, _, n) in enumerate(parts)}
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    left = {i: np.inf for i in guess}
    shared = spark.sparkContext.broadcast(matrix)
    for _ in range(ROUNDS):
        work = []
        for i in guess:
            a, b, _ = parts[i]
            work += [(i, (a + b) / 2 + (b - a) / 2 * t, w * (b - a) / 4 * t, guess[i]) for t, w in zip(turn, weights)]
        for i, block in _solved(spark, shared, work).items():
            a, b, n = parts[i]
            basis, _ = np.linalg.qr(block.reshape(size, -1))
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            vectors = basis @ small
            inside = (values > a) & (values <= b)
            off = np.linalg.norm(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max(initial=0.0) / scale
            if inside.sum() == n and off < 1e-11:
                done[i] = (values[inside], vectors[:, inside])
                # once more while that still halves the residual
                if off < 1e-15 or off > left[i] / 2:
                    del guess[i]
                    continue
                left[i] = off
            guess[i] = vectors
        if not guess:
            break
    shared.destroy()
    if len(done) < len(parts):
        raise RuntimeError("an interval does not hold the eigenvalues that the pivots count")
    values, vectors = np.concatenate([done[i][0] for i in done]), np.concatenate([done[i][1] for i in done], axis=1)
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return values, vectors
