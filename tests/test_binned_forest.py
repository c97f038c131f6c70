"""The balanced forest over many rows: plain recursion over the same draws, Spark's forest beside it, and when it is met."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hushframe.operators import binned_forest as bf
from hushframe.operators import models


def frame(spark, x, y):
    rows = [([float(v) for v in r], float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "x array<double>, label double").withColumn("features", array_to_vector("x")).repartition(4)


def gini(counts, weights):
    sums = counts * weights
    return sums.sum(), 1 - ((sums / sums.sum()) ** 2).sum()


def plain_tree(codes, y, w, weights, drawn, depth, level=0, place=0):
    """(feature, code, left, right) or shares; ``codes``: feature by row."""
    counts = np.array([w[y == k].sum() for k in range(len(weights))], float)
    leaf = counts * weights / (counts * weights).sum()
    if level == depth or (counts > 0).sum() < 2:
        return leaf
    total, impurity = gini(counts, weights)
    best = (1e-12, None)
    for f in drawn[level][place]:
        for code in range(codes.max()):
            left = codes[f] <= code
            sides = [np.array([w[(y == k) & side].sum() for k in range(len(weights))], float) for side in (left, ~left)]
            if min(s.sum() for s in sides) < 1:
                continue
            gain = impurity - sum(t / total * i for t, i in (gini(s, weights) for s in sides))
            if gain > best[0] + 1e-12:
                best = (gain, (f, code, left))
    if best[1] is None:
        return leaf
    f, code, left = best[1]
    below = [plain_tree(codes[:, s], y[s], w[s], weights, drawn, depth, level + 1, 2 * place + i) for i, s in enumerate((left, ~left))]
    if all(isinstance(b, np.ndarray) for b in below) and below[0].argmax() == below[1].argmax():
        return leaf
    return f, code, *below


def plain_shares(tree, codes):
    while isinstance(tree, tuple):
        tree = tree[3] if codes[tree[0]] > tree[1] else tree[2]
    return tree


@pytest.mark.parametrize("chunk, block", [(64, 1 << 16), (2, 100)])
def test_splits_equal_a_plain_recursion(spark, monkeypatch, chunk, block):
    """Also where a node's histograms and a task's points come in several pieces."""
    monkeypatch.setattr(bf, "CHUNK", chunk)
    monkeypatch.setattr(bf, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.random(600), rng.integers(0, 3, 600), rng.normal(size=600), np.ones(600)])
    y = (x[:, 0] + rng.random(600) > 0.9).astype(int) + (x[:, 1] == 2)
    df, trees, depth, bins = frame(spark, x, y), 4, 5, 8
    got = bf.fit_binned(df, 600, 4, trees, depth, bins, 7)
    blocks = bf.packed_blocks(df.select(F.col("label").cast("int").alias("y"), "x"), 600, got.cuts, trees, 7).collect()
    assert (len(blocks) > 1) == (block == 100)
    codes = np.concatenate([np.frombuffer(b["x"], np.uint8).reshape(4, -1) for b in blocks], axis=1)
    label = np.concatenate([np.frombuffer(b["y"], np.uint8) for b in blocks])
    w = np.concatenate([np.frombuffer(b["w"], np.uint8).reshape(trees, -1) for b in blocks], axis=1)
    weights = 600 / 3 / np.bincount(y)
    plain = []
    for t in range(trees):
        drawn = [bf.drawn_features(7, t, level, 4) for level in range(depth)]
        plain.append(plain_tree(codes, label, w[t], weights, drawn, depth))
    assert all(isinstance(t, tuple) for t in plain)
    want = [np.mean([plain_shares(t, c) for t in plain], axis=0) for c in bf.binned(x, got.cuts).T]
    assert np.allclose(got(x), want, atol=1e-12)


def test_cuts_lie_between_few_values_and_at_quantiles_of_many(spark):
    x = np.column_stack([np.arange(1_000) % 5, np.arange(1_000), np.arange(1_000) % 15])
    cuts = bf.find_cuts(frame(spark, x, np.zeros(1_000)).select("x"), 3, 10)
    assert list(cuts[0]) == [0.5, 1.5, 2.5, 3.5]
    assert len(cuts[1]) == 9 and np.allclose(cuts[1], np.arange(1, 10) * 100 - 1, atol=2)
    assert len(cuts[2]) == 9 and set(cuts[2]) < set(range(15))


def test_forest_does_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 20, (400, 3)), rng.integers(0, 2, 400)
    df = frame(spark, x, y)
    one, two = (bf.fit_binned(d, 400, 3, 3, 4, 32, 1) for d in (df, df.orderBy(F.rand(3)).repartition(7)))
    assert all((a == b).all() for a, b in ((one.feature, two.feature), (one.cut, two.cut), (one.shares, two.shares)))


def many(spark, copies=1):
    rows = spark.range(3_000).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    a, b = (F.xxhash64("id", F.lit(i)) % 10 / 10 for i in (1, 2))
    label = (F.when(F.col("id") % 25 == 0, a + b <= 0.9).otherwise(a + b > 0.9)).cast("double")
    return rows.select("id", array_to_vector(F.array(a, b, F.lit(1.0))).alias("features"), label.alias("label"))


def test_many_rows_are_not_walked_by_sparks_forest(spark, monkeypatch):
    """Above the bound no object per row is kept: equal rows are one point, their scores are as good as Spark's."""
    rows = many(spark).localCheckpoint()
    right = lambda scored: scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    plain = models.fit("rf", rows, trees=20, depth=5)(rows)
    monkeypatch.setattr(bf, "MANY_ROWS", 1_000)
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **_: pytest.fail("a forest over rows"))
    seen, pack = [], bf.packed_blocks

    def packed(*a):
        blocks = pack(*a)
        seen.append(sum(len(b["y"]) for b in blocks.collect()))
        return blocks

    monkeypatch.setattr(bf, "packed_blocks", packed)
    for copies in (1, 4):
        scored = models.fit("rf", many(spark, copies), trees=20, depth=5)(rows)
        assert sorted(scored.columns) == sorted(plain.columns) and scored.count() == 3_000
        assert abs(right(scored) - right(plain)) < 0.03 and right(scored) > 0.9
    assert seen[0] == seen[1] < 1_500


def test_rows_that_the_blocks_cannot_hold_stay_with_spark(spark):
    rows = many(spark)
    ask = lambda df, **o: bf.fits(df, 3_000, "label", **{"width": 3, "trees": 50, "depth": 10, "bins": 32, "many_rows": 1_000, **o})
    assert ask(rows)
    for label in (F.lit(0.5), F.lit(-1.0), F.lit(None).cast("double")):
        assert not ask(rows.withColumn("label", F.when(F.col("id") == 5, label).otherwise(F.col("label"))))
    assert not ask(rows, width=100_000) and not ask(rows, depth=30) and not ask(rows, bins=256) and not ask(rows, many_rows=3_001)
    with pytest.raises(Exception, match="infinite"):
        bf.fit_binned(rows.withColumn("features", array_to_vector(F.array(F.lit(float("nan"))))), 3_000, 1, 2, 2, 8, 1)
