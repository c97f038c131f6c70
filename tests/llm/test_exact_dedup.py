import hashlib
import string

import pandas as pd
from pyspark.sql import functions as F

from hushframe.llm import common, exact_dedup
from hushframe.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, kept int, _row string"
TABLE = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(text):
    return hashlib.sha256((text or "").translate(TABLE).encode()).hexdigest()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append(i)
    return {k: (max((i for i in ids if i is not None), default=None), len(ids)) for k, ids in groups.items()}


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got.itertuples():
        keep, size = want[r.text_sha256]
        assert (None if pd.isna(r.keep_id) else int(r.keep_id)) == keep and r.group_size == size
        if r.kept:
            assert pd.isna(r.doc_id) if keep is None else r.doc_id == keep
    assert got.groupby("text_sha256").kept.sum().eq(1).all()


ROWS = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "Ä"), (6, "ä"), (9, "dup"), (9, "dup"), (None, "n"), (None, "N"), (None, "dup"), (8, "x" * 40_000)]


def table(spark, tmp_path, rows, name="d"):
    path = str(tmp_path / name)
    spark.createDataFrame([(i, t, 7, "c") for i, t in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_edges(spark, tmp_path):
    rows = ROWS + [(i, "hot") for i in range(100, 200)]
    check(exact_dedup.document_copies(table(spark, tmp_path, rows)).toPandas(), rows)


def test_hot_groups_by_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 50)
    rows = ROWS + [(i, "hot") for i in range(100, 200)] + [(i, "warm") for i in range(300, 320)]
    check(exact_dedup.document_copies(table(spark, tmp_path, rows)).toPandas(), rows)


def test_drop_copies_keeps_columns(spark, tmp_path):
    got = exact_dedup.drop_copies(table(spark, tmp_path, ROWS))
    assert got.columns == ["doc_id", "text", "kept", "_row"]
    rows = got.collect()
    assert len(rows) == len(brute(ROWS)) == len({key(r.text) for r in rows})


def test_empty(spark, tmp_path):
    assert exact_dedup.document_copies(table(spark, tmp_path, [])).count() == 0
    assert exact_dedup.drop_copies(table(spark, tmp_path, [], "e")).count() == 0


def test_index_survives_reopening(spark, tmp_path):
    path = str(tmp_path / "index")

    def add(rows):
        index = exact_dedup.DigestIndex(spark, path, 4)
        df = spark.createDataFrame(rows, "doc_id long, row long, text string")
        index.add(df.select("doc_id", "row", exact_dedup.text_digest(F.col("text")).alias("digest")))
        out = {(r.keep_id, r.copies) for r in index.entries().collect()}
        index.close()
        return out

    assert add([(5, 0, "a"), (6, 1, "A"), (7, 2, "b")]) == {(6, 2), (7, 1)}
    assert add([(90, 3, "a"), (91, 4, "c")]) == {(6, 3), (7, 1), (91, 1)}


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    check(QUERIES["op7_exact_dedup"](spark, sf).toPandas(), list(zip(docs.doc_id, docs.text)))
