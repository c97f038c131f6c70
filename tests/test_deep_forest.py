"""Uncapped forests against a plain recursion over the same draws."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from hushframe.operators import deep_forest as deep


def frame(spark, x, y):
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, x array<double>, label double").withColumn("features", array_to_vector("x")).repartition(4)


def plain_tree(rows, classes, seed, tree, draw, path=""):
    """Nested tuples (feature, threshold, left, right) or a list of leaf values; ``rows``: (x, y, w)."""
    total = sum(w for *_, w in rows)
    value = [sum(w for _, y, w in rows if y == k) / total for k in range(classes)] if classes else [sum(y * w for _, y, w in rows) / total]
    if len({y for _, y, _ in rows}) == 1:
        return value
    best, met = None, 0
    for f in sorted(range(len(rows[0][0])), key=lambda f: (deep._rank_key(seed, tree, path, f), f)):
        values = sorted({x[f] for x, *_ in rows})
        if len(values) < 2 or met == draw:
            continue
        met += 1
        for a, b in zip(values, values[1:]):
            score = 0.0
            for side in ([r for r in rows if r[0][f] <= a], [r for r in rows if r[0][f] > a]):
                n = sum(w for *_, w in side)
                sums = [sum(w for _, y, w in side if y == k) for k in range(classes)] if classes else [sum(y * w for _, y, w in side)]
                score += sum(s * s for s in sums) / n
            if best is None or score > best[0] + 1e-12:
                best = (score, f, a / 2 + b / 2)
    if best is None:
        return value
    _, f, t = best
    return f, t, *[plain_tree([r for r in rows if (r[0][f] > t) == right], classes, seed, tree, draw, path + "01"[right]) for right in (False, True)]


def plain_value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[3] if x[tree[0]] > tree[1] else tree[2]
    return tree


def plain_forest(df, x, y, classes, trees, seed, draw):
    bags = {}
    for r in deep.bag(df.select("id"), ["id"], trees, seed).collect():
        bags.setdefault(r["tree"], []).append((tuple(x[r["id"]]), y[r["id"]], r["w"]))
    return [plain_tree(bags[t], classes, seed, t, draw) for t in range(trees)]


@pytest.mark.parametrize("classes, local", [(3, 10**6), (3, 25), (0, 10**6), (0, 25)])
def test_splits_equal_a_plain_recursion(spark, classes, local):
    """Whether a node is grown on the cluster or in a task, every row gets the plain tree's value."""
    rng = np.random.default_rng(classes)
    x = rng.integers(0, 9, (90, 4)).astype(float)
    y = rng.integers(0, classes or 20, 90).astype(float)
    df, seed, trees = frame(spark, x, y), "s", 3
    forest = deep.fit_forest(df, 4, ["id"], classes=classes, trees=trees, seed=seed, local_rows=local)
    assert (forest.levels > 0) == (local < 50)
    plain = plain_forest(df, x, y, classes, trees, seed, 2 if classes else 4)
    got = {r["id"]: r for r in deep.score_forest(df, forest, scored_rows=20).collect()}
    assert len(got) == 90
    for i, v in enumerate(x):
        want = np.mean([plain_value(t, v) for t in plain], axis=0)
        mine = got[i]["prob"] if classes else [got[i]["prediction"]]
        assert np.allclose(mine, want, atol=1e-12)
        if classes:
            assert got[i]["prediction"] == int(np.argmax(mine))


def depth(feature, child):
    deepest, todo = 0, [(0, 0)]
    while todo:
        at, level = todo.pop()
        deepest = max(deepest, level)
        if feature[at] >= 0:
            todo += [(child[at], level + 1), (child[at] + 1, level + 1)]
    return deepest


def test_a_chain_is_followed_below_depth_thirty(spark):
    """Values that double while labels alternate: every split takes one value off, in one part and on the cluster."""
    x = np.array([[2.0**k] for k in range(80)] * 30)
    # the larger a value the heavier its class, so the largest is always split off first
    y = np.array([k % 2 for k in range(80)] * 30, float)
    df = frame(spark, x, y)
    forest = deep.fit_forest(df, 1, ["id"], trees=2, seed=1)
    parts = forest.parts.collect()
    depths = [depth(np.frombuffer(p["feature"], "<i4"), np.frombuffer(p["child"], "<i4")) for p in parts]
    assert max(depths) > 30
    got = deep.score_forest(df, forest).collect()
    assert all(r["prediction"] == r["label"] for r in got)
    cut = deep.fit_forest(df, 1, ["id"], trees=2, seed=1, local_rows=1_450)
    assert cut.levels > 0
    same = {r["id"]: r["prob"] for r in deep.score_forest(df, cut).collect()}
    assert same == {r["id"]: r["prob"] for r in got}


def test_equal_rows_with_other_labels_and_large_leaves(spark):
    x = np.array([[1.0, 5.0]] * 60 + [[2.0, 5.0]] * 60)
    y = np.array([0.0, 1.0] * 30 + [1.0] * 60)
    df = frame(spark, x, y)
    for local in (40, 10**6):
        forest = deep.fit_forest(df, 2, ["id"], trees=4, seed=3, local_rows=local)
        got = {tuple(r["x"]): r["prob"] for r in deep.score_forest(df, forest).collect()}
        assert got[2.0, 5.0] == [0.0, 1.0] and 0.3 < got[1.0, 5.0][0] < 0.7
    new = spark.createDataFrame([([9.0, 9.0],)], "x array<double>").withColumn("features", array_to_vector("x"))
    assert deep.score_forest(new, forest).first()["prediction"] == 1.0
    assert deep.score_forest(new.limit(0), forest).count() == 0


def test_draws_are_poisson_and_stable(spark):
    df = spark.range(2_000).withColumnRenamed("id", "k")
    rows = [(r["tree"], r["k"], r["w"]) for r in deep.bag(df, ["k"], 5, "x").collect()]
    assert sorted(rows) == sorted((r["tree"], r["k"], r["w"]) for r in deep.bag(df.repartition(7), ["k"], 5, "x").collect())
    assert abs(len(rows) / 10_000 - (1 - math.exp(-1))) < 0.02 and abs(sum(w for *_, w in rows) / 10_000 - 1) < 0.03


def test_nodes_of_a_level_are_split_together(spark, monkeypatch):
    """A tree of thousands of nodes asks for splits a few times per level, not once per node; the tree stays right."""
    rng = np.random.default_rng(4)
    x, y, w = rng.random((4_000, 3)), rng.integers(0, 2, 4_000).astype(float), np.ones(4_000)
    calls, split = [], deep.best_splits
    monkeypatch.setattr(deep, "best_splits", lambda *a: calls.append(1) or split(*a))
    feature, threshold, child, value = deep.grow(x, y, w, 0, "", "s", 1, 2)
    assert len(feature) > 2_000 and len(calls) < len(feature) / 4
    assert (value.reshape(-1, 2)[deep.walk(x, feature, threshold, child)].argmax(axis=1) == y).all()
    # a tree over a hundred rows of the same kind, node by node against the plain recursion
    some = [(tuple(a), b, c) for a, b, c in zip(x[:100], y[:100], w[:100])]
    plain = plain_tree(some, 2, "s", 0, 1)
    feature, threshold, child, value = deep.grow(x[:100], y[:100], w[:100], 0, "", "s", 1, 2)
    assert len(feature) > 2 and (value.reshape(-1, 2)[deep.walk(x, feature, threshold, child)] == [plain_value(plain, v) for v in x]).all()


def test_equal_rows_count_as_one(monkeypatch):
    """Rows with equal features weigh together: a tree over few distinct points sorts few points, and stays the same."""
    rng = np.random.default_rng(5)
    x, w = np.repeat(rng.random((40, 2)), 100, axis=0), np.ones(4_000)
    held, split = [], deep.best_splits
    monkeypatch.setattr(deep, "best_splits", lambda v, *a: held.append(len(v)) or split(v, *a))
    for classes, draw in ((2, 1), (0, 2)):
        y = rng.integers(0, 2, 4_000).astype(float)
        feature, threshold, child, value = deep.grow(x, y, w, 0, "", "s", draw, classes)
        assert max(held) <= 40
        plain = plain_tree([(tuple(a), b, 1.0) for a, b in zip(x, y)], classes, "s", 0, draw)
        got = value.reshape(-1, classes or 1)[deep.walk(x[::100], feature, threshold, child)]
        assert np.allclose(got, [plain_value(plain, v) for v in x[::100]], atol=1e-12)


def test_draws_of_many_paths_are_those_of_single_ones():
    """Texts of every length, by the lanes of the vectorized hash and by the library."""
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(1)
    for size in range(0, 100):
        text = rng.integers(0, 256, (3, size)).astype(np.uint8)
        assert deep.xxh64(text).tolist() == [xxh64_intdigest(t.tobytes(), 42) for t in text]
    trail = np.frombuffer(b"01" * 600, np.uint8).reshape(200, 6)
    few = [deep._feature_orders("s", 3, "10", t[None], 12)[0].tolist() for t in trail]
    assert deep._feature_orders("s", 3, "10", trail, 12).tolist() == few


@pytest.mark.parametrize("classes", [2, 0])
def test_subtrees_are_those_of_the_whole_tree(classes):
    """A tree whose subtrees are grown one by one gives every row the value it has in one piece."""
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 50, 6000), rng.integers(0, 6000, 6000), rng.normal(size=6000)], axis=1).astype(float)
    y, w = rng.integers(0, classes or 900, 6000).astype(float), rng.poisson(1, 6000) + 1.0
    order = np.lexsort((w, y, *x.T))
    x, y, w = x[order], y[order], w[order]
    whole = deep.grow(x, y, w, 3, "01", "s", 1, classes)
    parts = deep.grow_parts(x, y, w, 3, "01", "s", 1, classes, part_rows=300)
    assert len(parts) > 5 and sum(len(a[0]) for _, a in parts) == len(whole[0]) + len(parts) - 1
    want = whole[3].reshape(-1, classes or 1)[deep.walk(x, *whole[:3])]
    assert np.array_equal(deep.leaf_values(x, deep._packed(3, "01", parts).take([*reversed(range(len(parts)))]), classes or 1), want)


def test_trees_move_as_blocks(spark, monkeypatch):
    """Up to LOCAL_ROWS drawn rows a tree no row is copied as a Spark row for every tree; keys of any type draw as in ``bag``."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    df = frame(spark, rng.integers(0, 40, (300, 2)), rng.integers(0, 2, 300)).withColumn("id", F.when(F.col("id") > 3, F.concat(F.lit("k"), "id")))
    bags = [tuple(r) for r in deep.bag(df, ["id"], 5, 1).groupBy("tree").agg(F.sum("w")).orderBy("tree").collect()]
    routed = {tuple(r["x"]): r["prob"] for r in deep.score_forest(df, deep.fit_forest(df, 2, ["id"], trees=5, seed=1, local_rows=80)).collect()}
    monkeypatch.setattr(deep, "bag", lambda *a: pytest.fail("rows were exploded"))
    forest = deep.fit_forest(df, 2, ["id"], trees=5, seed=1)
    assert forest.levels == 0 and {r["tree"] for r in forest.parts.collect()} == {t for t, _ in bags}
    for scored_rows in (7, 10**6):
        got = deep.score_forest(df, forest, scored_rows=scored_rows).collect()
        assert len(got) == 300 and all(np.allclose(routed[tuple(r["x"])], r["prob"], atol=1e-12) for r in got)
