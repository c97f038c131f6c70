from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hushframe.operators import features


def test_code_table_gives_the_same_vectors_as_lists(spark, monkeypatch):
    rows = [(i, float(i % 7), ["x", "y", None, "z"][i % 4], f"v{i % 11}", "only") for i in range(90)]
    train = spark.createDataFrame(rows, "id int, a double, s string, t string, o string")
    test = spark.createDataFrame([(1, 2.0, "new", "v3", None), (2, None, None, None, "other"), (3, 1.0, "z", "v10", "only")], train.schema)
    found = []
    for listed in (10_000, 4, 0):
        monkeypatch.setattr(features, "LISTED", listed)
        fs = features.fit_features(train, skip=["id"])
        assert fs.width == len(fs.names) == 1 + 3 + 11 + 1 and (fs.codes is None) == (listed == 10_000)
        out = fs.apply(test)
        assert out.columns == [*test.columns, "features"]
        found.append({r["id"]: r["x"] for r in out.select("id", vector_to_array("features").alias("x")).collect()})
    assert found[0] == found[1] == found[2] and sum(found[0][1][1:4]) == 0


def test_two_hundred_thousand_categories(spark):
    train = spark.range(200_000).select("id", F.concat(F.lit("k"), F.col("id")).alias("s"))
    fs = features.fit_features(train, skip=["id"])
    assert fs.width == 200_000 and not fs.categories
    out = fs.apply(train.filter("id % 1000 = 0")).select(vector_to_array("features").alias("x"))
    places = out.select(F.expr("array_position(x, 1D)").alias("p"), F.expr("size(x)").alias("n")).collect()
    assert len({r["p"] for r in places}) == 200 and {r["n"] for r in places} == {200_000} and min(r["p"] for r in places) > 0
