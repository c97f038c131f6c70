"""The forest attack on merged points: what it calls, and that Spark's forest over the rows is only met beyond a bound."""

import pytest
from pyspark.sql import functions as F

from hushframe.operators import deep_forest, membership


def table(spark, n=4_000):
    """Rows whose probability lies in a band of its own for members, one in twenty in the wrong band."""
    rows = spark.range(n).withColumn("member", (F.col("id") % 2).cast("int")).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    inside = F.when(F.col("id") % 20 < 19, F.col("member")).otherwise(1 - F.col("member"))
    p = F.lit(0.5) + F.lit(0.3) * inside + F.lit(0.1) * (F.xxhash64("id") % 1000 / 1000)
    return membership.attack_split(rows.withColumn("prob", F.array(F.lit(1.0) - p, p)), ["id"])


@pytest.mark.parametrize("merged_points", [100_000, 0])
def test_both_forests_tell_members_from_others(spark, merged_points):
    rows = table(spark).localCheckpoint()
    got = membership.forest_attack(rows, [0, 1], trees=20, merged_points=merged_points)
    assert got.columns == [*rows.columns, "inferred"] and dict(got.dtypes)["inferred"] == "int"
    assert got.count() == rows.filter("is_eval").count()
    assert 0.9 < got.agg(F.avg((F.col("inferred") == F.col("member")).cast("int"))).first()[0] < 0.99


def test_rows_of_one_point_are_not_walked_through_every_tree(spark, monkeypatch):
    """Few distinct points: the row forest is not called, and more rows of the same kind make no more points."""
    seen = []
    monkeypatch.setattr(membership, "RandomForestClassifier", lambda **_: pytest.fail("a forest over rows"))
    fit = deep_forest.fit_merged
    monkeypatch.setattr(deep_forest, "fit_merged", lambda points, *a, **o: seen.append(points.agg(F.count("n"), F.sum("n")).first()) or fit(points, *a, **o))
    for copies in (1, 5):
        rows = table(spark).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        assert membership.forest_attack(rows, [0, 1], trees=3).count() == copies * table(spark).filter("is_eval").count()
    (few, n), (many, m) = seen
    assert m == 5 * n and few < 300 and many < 300


def test_merged_rows_draw_as_rows_do(spark):
    """The weight of a tree's root is a Poisson draw of the number of rows; an outcome that all points share is certain."""
    points = spark.createDataFrame([([0.0], 0.0, 300), ([1.0], 1.0, 100)], "x array<double>, y double, n long")
    forest = deep_forest.fit_merged(points, 1, 2, trees=50, depth=1)
    again = deep_forest.fit_merged(points.orderBy(F.desc("n")).repartition(3), 1, 2, trees=50, depth=1)
    parts = lambda f: sorted((r["tree"], bytes(r["threshold"]), bytes(r["value"])) for r in f.parts.collect())
    assert parts(forest) == parts(again)
    import numpy as np

    roots = [np.frombuffer(v, "<f8").reshape(-1, 2)[0, 1] for _, _, v in parts(forest)]
    assert len(roots) == 50 and 0.2 < np.mean(roots) < 0.3 and len(set(roots)) > 25
    stump = deep_forest.fit_merged(points, 1, 2, trees=2, depth=0)
    assert all(len(r["feature"]) == 4 for r in stump.parts.collect())
