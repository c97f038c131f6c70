import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.functions.noise import laplace, laplace_value, uniform, uniform_value
from hushframe.operators import ranks
from hushframe.operators.joins import attach
from hushframe.operators.splits import balanced_sample, sample_n, stratified_split


def values(seed=0):
    rng = np.random.default_rng(seed)
    heavy = np.concatenate([np.full(700, 3.5), 10.0 ** rng.uniform(-200, 200, 500), -rng.random(301)])
    even = np.concatenate([rng.normal(size=1000), np.full(600, 0.25)])
    return [("heavy", float(v)) for v in heavy] + [("even", float(v)) for v in even] + [("one", 1.0)]


def test_every_rank_is_exact(spark):
    data = values()
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    want = {g: sorted(v for x, v in data if x == g) for g in ("heavy", "even", "one")}
    asked = [(g, r, len(w)) for g, w in want.items() for r in sorted({0, len(w) // 3, len(w) // 2, len(w) - 1})]
    got = ranks.select_ranks(df, spark.createDataFrame(asked, "g string, rank bigint, n bigint"), ["g"], exact_rows=20, grid=16)
    assert {(r["g"], r["rank"]): r["v"] for r in got.collect()} == {(g, r): want[g][r] for g, r, _ in asked}


@pytest.mark.parametrize("exact_rows", [10**6, 40])
def test_medians(spark, exact_rows):
    data = values(1)
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r["median"] for r in ranks.median_by(df, ["g"], exact_rows=exact_rows).collect()}
    for g in got:
        assert np.isclose(got[g], np.median([v for x, v in data if x == g]), rtol=1e-12)
    wide = df.select(F.when(F.col("g") == "even", F.col("v")).alias("x.1"), F.col("v").alias("y"))
    m = ranks.column_medians(wide, ["x.1", "y"], exact_rows)
    assert np.isclose(m["x.1"], got["even"]) and np.isclose(m["y"], np.median([v for _, v in data]))


def test_running_total(spark):
    rng = np.random.default_rng(2)
    data = [("a" if i < 900 else "b", int(v), int(rng.integers(0, 9))) for i, v in enumerate(rng.permutation(1200))]
    df = spark.createDataFrame(data, "g string, o int, c int").repartition(5)
    got = {(r["g"], r["o"]): r["before_c"] for r in ranks.running_total(df, ["g"], ["o"], ["c"]).collect()}
    for g in "ab":
        seen = 0
        for _, o, c in sorted(x for x in data if x[0] == g):
            assert got[(g, o)] == seen
            seen += c


@pytest.mark.parametrize("buckets", [1, 8, 1 << 16])
def test_smallest_per_group(spark, buckets):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") < 1500, "big").otherwise("small"))
    u = {i: uniform_value(7, i) for i in range(2000)}
    quotas = spark.createDataFrame([("big", 333), ("small", 500)], "g string, quota bigint")
    got = ranks.smallest_per_group(df, ["g"], uniform(7, "id"), ["id"], quotas, buckets)
    taken = {r["id"] for r in got.filter("_taken").collect()}
    big = sorted(range(1500), key=lambda i: (u[i], i))[:333]
    assert got.count() == 2000 and taken == set(big) | set(range(1500, 2000))


def test_equal_draws_are_broken_by_key(spark):
    df = spark.range(100)
    quotas = spark.createDataFrame([(10,)], "quota bigint")
    got = ranks.smallest_per_group(df, [], F.lit(0.5), ["id"], quotas)
    assert sorted(r["id"] for r in got.filter("_taken").collect()) == list(range(10))


def test_quota_selection_narrows_until_small(spark, monkeypatch):
    """Eight buckets and a million rows: no ranked group is larger than the bound, and the rows are the smallest ones."""
    df = spark.range(1_000_000).withColumn("g", F.when(F.col("id") % 1000 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 3 == 0, "a").otherwise("b")))
    quotas = spark.createDataFrame([("a", 33_333), ("b", 600_000), (None, 7)], "g string, quota bigint")
    got = ranks.smallest_per_group(df, ["g"], uniform("s", "id"), ["id"], quotas, buckets=8, edge_rows=500)
    u = df.withColumn("u", uniform("s", "id")).select("id", "g", "u").toPandas()
    taken = got.filter("_taken").select("id").toPandas()["id"]
    want = set()
    for g, quota in (("a", 33_333), ("b", 600_000), (None, 7)):
        rows = u[u.g.isna()] if g is None else u[u.g == g]
        want |= set(rows.sort_values(["u", "id"]).id[:quota])
    assert set(taken) == want and got.columns == ["id", "g", "_taken"]
    # the plan's only window over rows is the ranking: its input is bounded
    sizes = []
    attach_ = ranks.attach
    monkeypatch.setattr(ranks, "attach", lambda rows, table, on, **o: sizes.append((rows.columns, table)) or attach_(rows, table, on, **o))
    ranks.smallest_per_group(df, ["g"], uniform("s", "id"), ["id"], quotas, buckets=8, edge_rows=500)
    edge = sizes[-2][1]
    assert edge.agg(F.max("_n")).first()[0] <= 500 and len(sizes) > 5


def test_quotas_at_the_ends_and_missing(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "id int, g int")
    quotas = spark.createDataFrame([(0, 0), (1, 500)], "g int, quota bigint")
    got = ranks.smallest_per_group(df, ["g"], uniform("s", "id"), ["id"], quotas, edge_rows=2).groupBy("g").agg(F.sum(F.col("_taken").cast("int")).alias("n")).collect()
    assert {r["g"]: r["n"] for r in got} == {0: 0, 1: 30, 2: 0}


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    test = lambda n: {r["id"] for r in stratified_split(df.repartition(n), ["id"], "y").filter("is_test").collect()}
    one = test(1)
    assert one == test(16) and len(one) == 600 and sum(i % 10 == 0 for i in one) == 60
    even = balanced_sample(df, "y", ["id"]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in even} == {0: 300, 1: 300}
    assert sample_n(df, ["id"], 10**9).count() == 3000 and sample_n(df, ["id"], 17).count() == 17


def test_attach_splits_hot_keys(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        got = attach(rows, table, ["k"], how=how, weight="n", broadcast_rows=10, hot_rows=100).collect()
        assert len(got) == 1000 and all(r["n"] == (700 if r["k"] == 0 else 1) for r in got)
    plain = attach(rows, table, ["k"], broadcast_rows=10)
    assert plain.count() == 1000


def test_noise_twins_and_scale(spark):
    df = spark.range(4000).select("id", uniform("s", "id").alias("u"), laplace(uniform("s", "id"), 2.0).alias("l"))
    rows = df.collect()
    assert all(r["u"] == uniform_value("s", r["id"]) for r in rows)
    assert all(abs(r["l"] - laplace_value(r["u"], 2.0)) < 1e-12 for r in rows)
    assert abs(np.mean([abs(r["l"]) for r in rows]) - 2.0) < 0.15  # mean |Laplace(b)| is b


def test_long_heads_and_samples_skip_the_heap(spark, monkeypatch):
    from hushframe.operators import splits

    df = spark.range(500).withColumn("v", F.col("id") * 2).repartition(4)
    want = sorted(r["id"] for r in sample_n(df, ["id"], 40).collect())
    monkeypatch.setattr(splits, "HEAP_ROWS", 5)
    assert sorted(r["id"] for r in splits.head_n(df, 120, ["id"]).collect()) == list(range(120))
    assert sorted(r["id"] for r in splits.sample_n(df, ["id"], 40).collect()) == want
