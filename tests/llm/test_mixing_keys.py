import math

from pyspark.sql import functions as F

from hushframe.functions.noise import uniform_value
from hushframe.llm import mixing

from frames import prose, write


def test_light_documents_keep_the_order_of_their_keys(spark, monkeypatch):
    """Mean word length 100: nearly all keys lie beyond 37, where 1 - exp(-key) is 1."""
    import hashlib

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    word = "x" * 100
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(word).alias("text"))
    draws = mixing._draws(rows, 1)
    got = {r.doc_id: r.taken for r in mixing.mix(draws, share=0.25).collect()}
    key = {i: -math.log(uniform_value(1, i, hashlib.md5(word.encode()).hexdigest())) * 91 for i in range(400)}
    want = set(sorted(key, key=key.get)[:100])
    assert {i for i, n in got.items() if n} == want


def test_the_ranked_documents_are_few(spark, monkeypatch):
    """However the weights are spread, the bucket in which the budget ends is cut until it is small."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"),
        F.repeat(F.lit("x"), (F.col("id") % 40 * 5 + 5).cast("int")).alias("text"),
    )
    draws = mixing._draws(rows, 1).localCheckpoint()
    by = draws.groupBy(F.concat(F.lit("="), "source").alias("_source")).agg(
        F.count("*").alias("_rows"), F.min("key").alias("_least"), F.max("key").alias("_largest"), (F.sum("size") * 0.9).alias("_left")
    )
    edges = {r._source: r for r in mixing._edges(draws.withColumn("_source", F.concat(F.lit("="), "source")), by).collect()}
    assert set(edges) == {"=a", "=b"}
    for name, e in edges.items():
        keys = sorted(r.key for r in draws.filter(F.col("source") == name[1:]).collect())
        before, inside = sum(k < e._low for k in keys), sum(e._low <= k <= e._high for k in keys)
        assert inside <= 20 and before == e._full and before < 0.9 * len(keys) <= before + inside


def test_weights_follow_the_quality_of_the_text(spark):
    """Prose weighs one; symbols, repeated lines and odd word lengths take from it."""
    rows = [("prose", 100, 500, 0, 20, 0), ("symbols", 100, 500, 10, 20, 0), ("repeated", 100, 500, 0, 20, 10), ("long", 100, 1_500, 0, 20, 0), ("empty", 0, 0, 3, 0, 0)]
    df = spark.createDataFrame(rows, "name string, size long, chars int, symbols int, lines int, repeated int")
    w = {r["name"]: r["w"] for r in df.select("name", mixing.quality_weight(*map(F.col, df.columns[1:])).alias("w")).collect()}
    assert w["prose"] == w["empty"] == 1.0 and w["symbols"] == w["repeated"] == 0.5 and abs(w["long"] - 1 / 6) < 1e-12


def test_worse_texts_are_taken_less(spark, tmp_path):
    """Of two kinds of equal size, one with every fifth word a symbol, the budget of half the source takes far more of the other."""
    good = [(k, prose(40, 31 * k)) for k in range(300)]
    bad = [(1_000 + k, " ".join(w if i % 5 else "#" for i, w in enumerate(prose(40, 31 * k).split()))) for k in range(300)]
    docs = write(spark, tmp_path, good + bad, source="s")
    taken = mixing.mix(mixing.stage(mixing._draws(docs, 1)), share=0.5).filter("epochs > 0").select("doc_id").toPandas().doc_id
    # weights 1 and 1/3: with 1 - e^-t + 1 - e^-t/3 = 1 the expected parts are 0.68 and 0.32
    assert len(taken) == 300 and abs((taken < 1_000).sum() - 205) < 30
