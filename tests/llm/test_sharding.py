import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe.llm import sharding
from hushframe.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_jump(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def expected(rows, n):
    return {
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_jump(i or 0, n), plain_jump(i or 0, n + 1))
        for i, t in rows
    }


def check(got: pd.DataFrame, rows, n):
    assert len(got) == len(rows)
    ids = [None if pd.isna(i) else int(i) for i in got.doc_id]
    seen = set(zip(ids, got["size"], got.text_crc32, got.shard, got.grown_shard))
    assert seen == expected(rows, n)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) <= {n}


@pytest.mark.parametrize("n", [1, 2, 16, 100])
def test_edge_rows(spark, tmp_path, n):
    rows = [(0, ""), (1, None), (None, "x"), (-5, "ü\n€"), (2**62, "a" * 50_000), (7, "same"), (7, "same"), (7, "same")]
    rows += [(3, "hot")] * 50 + [(i, f"t{i}") for i in range(100, 160)]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3).write.parquet(path)
    check(sharding.document_shards(spark.read.parquet(path), n).toPandas(), rows, n)


def test_empty_and_clashing_names(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert sharding.document_shards(spark.read.parquet(path)).count() == 0
    clash = str(tmp_path / "c")
    spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a").alias("_row"), F.lit(1).alias("_split"), F.lit(2).alias("_jump_key")).write.parquet(clash)
    got = sharding.shard_rows(spark.read.parquet(clash), F.col("doc_id"), 4)
    assert got.columns[:4] == ["shard", "doc_id", "_row", "_split"] or {"_row", "_split", "_jump_key"} <= set(got.columns)
    assert got.count() == 20


def test_more_jumps_than_the_first_pass(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "FIRST_JUMPS", 2)
    df = sharding.jump_hash(spark.range(500), F.col("id"), 40, "shard", "grown")
    assert {(r.id, r.shard, r.grown) for r in df.collect()} == {(i, plain_jump(i, 40), plain_jump(i, 41)) for i in range(500)}


def test_query_is_even(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = QUERIES["op1_jump_sharding"](spark, sf).toPandas()
    check(got, list(zip(docs.doc_id, docs.text)), 16)
    assert got.groupby("shard").size().max() < 3 * len(got) / 16
