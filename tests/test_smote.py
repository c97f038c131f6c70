"""Exact nearest vectors in few and many dimensions, and what the search compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.operators import smote


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(4)


def plain(x, k):
    out = set()
    for i, v in enumerate(x):
        d = ((x - v) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
        out |= {(i, int(j), rk) for rk, j in enumerate(order, 1)}
    return out


def clustered(rng, n, width, groups):
    centres = rng.standard_normal((groups, width)) * 20
    return centres[rng.integers(0, groups, n)] + rng.standard_normal((n, width))


@pytest.mark.parametrize("width, chunk, pivots", [(1, 7, 4), (2, 16, 64), (20, 32, 1024), (100, 32, 3), (20, 1_000, 5)])
def test_neighbours_equal_all_pairs(spark, width, chunk, pivots):
    rng = np.random.default_rng(width)
    x = np.unique(np.concatenate((clustered(rng, 300, width, 6), rng.integers(0, 2, (100, width)).astype(float))), axis=0)
    got = smote.nearest_vectors(frame(spark, x), width, 5, chunk, pivots).collect()
    assert {(r["id"], r["near"], r["rk"]) for r in got} == plain(x, 5)


def test_fewer_vectors_than_neighbours(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    for chunk in (1, 2, 10):
        assert {(r["id"], r["near"], r["rk"]) for r in smote.nearest_vectors(frame(spark, x), 1, 5, chunk).collect()} == plain(x, 5)


def compared(spark, x, chunk):
    """Compared pairs as a part of all, and the largest chunk."""
    placed, queries = smote.reachable(frame(spark, x), 5, chunk)
    sizes = placed.groupBy(F.col("cell").alias("to_cell"), F.col("chunk").alias("to_chunk")).agg(F.count(F.lit(1)).alias("n"))
    pairs = queries.join(sizes, ["to_cell", "to_chunk"]).agg(F.sum("n")).first()[0]
    return pairs / len(x) ** 2, sizes.agg(F.max("n")).first()[0]


@pytest.mark.parametrize("width", [20, 100])
def test_clusters_in_many_dimensions_are_pruned(spark, width):
    """No axis tells the clusters apart better than another, and still most pairs never meet."""
    share, largest = compared(spark, clustered(np.random.default_rng(width), 3_000, width, 30), 64)
    assert share < 0.15 and largest <= 64


def test_one_dense_cell_is_cut_into_chunks(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.standard_normal((2_000, 3)) * 1e-3, rng.standard_normal((50, 3)) * 100))
    share, largest = compared(spark, x, 50)
    assert largest <= 50 and share < 0.5
