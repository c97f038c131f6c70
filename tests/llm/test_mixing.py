from collections import Counter, defaultdict

import pandas as pd
import pytest

from hushframe.llm import mixing
from hushframe.llm.queries import QUERIES

from frames import EDGE, prose, write
from plain import words


def plain_targets(sizes):
    """{source: target} by sharing again and again until no target is above its stop."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, stop = 1.5 * sum(sizes.values()), {s: 2.0 * n for s, n in sizes.items()}
    stopped = set()
    while len(stopped) < len(order):
        level = (total - sum(stop[s] for s in stopped)) / sum(weight[s] for s in order if s not in stopped)
        above = {s for s in order if s not in stopped and level * weight[s] > stop[s]}
        if not above:
            return {s: stop[s] if s in stopped else level * weight[s] for s in order}
        stopped |= above
    return stop


def check(got, rows):
    """``rows``: (doc_id, text, source)."""
    sizes, counts = defaultdict(int), Counter()
    for i, t, s in rows:
        sizes[s] += len(words(t))
        counts[(i, len(words(t)))] += 1
    none = lambda x: None if pd.isna(x) else int(x)
    assert Counter((none(r.doc_id), r.size) for r in got.rename(columns={"size": "size"}).itertuples(index=False)) == counts
    target = plain_targets(sizes)
    by = defaultdict(list)
    for r in got.itertuples(index=False):
        by[r.source_size, round(r.target, 6)].append(r)
    assert {(n, round(target[s], 6)) for s, n in sizes.items()} == set(by)
    for (n, goal), group in by.items():
        same = [s for s in sizes if sizes[s] == n and round(target[s], 6) == goal]
        most = max(r.size for r in group)
        assert abs(sum(r.taken for r in group) - goal * len(same)) <= len(same) * (most / 2 + 1e-6)
        epochs = int(goal // n) if n else 0
        for r in group:
            assert r.taken in (r.size * epochs, r.size * (epochs + 1)) and r.taken <= 2 * r.size


def table(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.mark.parametrize("bucket", [2_000, 3])
def test_edges(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rows = EDGE + [(100 + i, prose(5 + i % 40, i)) for i in range(200)]
    docs = write(spark, tmp_path, rows)
    got = mixing.document_mix(docs)
    first = got.toPandas()
    check(first, table(docs))
    again = mixing.document_mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "source_size", "taken"]
    assert first[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_hot_source(spark, tmp_path):
    rows = [(i, prose(3 + i % 9, i)) for i in range(300)]
    docs = write(spark, tmp_path, rows, source="one")
    check(mixing.document_mix(docs).toPandas(), table(docs))


def test_empty_and_wordless(spark, tmp_path):
    assert mixing.document_mix(write(spark, tmp_path, [])).count() == 0
    blank = mixing.document_mix(write(spark, tmp_path, [(1, ""), (2, None)], "blank")).toPandas()
    assert blank.taken.eq(0).all() and blank.target.eq(0).all()


def test_heavier_documents_come_first_more_often(spark):
    rows = spark.range(4_000).selectExpr("id as doc_id", "'s' as source", "if(id % 2 = 0, 'aaaaa bbbbb', 'a b') as text")
    got = mixing.mix(mixing._draws(rows, 1).withColumn("even", mixing.F.col("doc_id") % 2 == 0), share=0.5)
    taken = {r.even: r.n for r in got.groupBy("even").agg(mixing.F.sum("taken").alias("n")).collect()}
    assert taken[True] > 1.5 * taken[False] > 0


def test_mixed_documents_repeat_whole_rows(spark, tmp_path):
    docs = write(spark, tmp_path, EDGE + [(100 + i, prose(5 + i % 40, i)) for i in range(60)])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.document_mix(docs).collect():
        if r.size:
            want[(r.doc_id, r.size)] += r.taken
    have = Counter()
    for r in mixed.collect():
        if words(r.text):
            have[(r.doc_id, len(words(r.text)))] += len(words(r.text))
    assert have == Counter({k: v for k, v in want.items() if v})


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    check(QUERIES["op3_source_mixing"](spark, sf).toPandas(), list(zip(docs.doc_id, docs.text, docs.source)))


def test_mixed_documents_keep_clashing_columns(spark, tmp_path):
    rows = EDGE + [(i, prose(30 + i % 7, i)) for i in range(100, 140)]
    odd = write(spark, tmp_path, rows).selectExpr("*", "1 as _row_of_mix", "2 as _times", "3 as epochs", "'x' as key", "4 as size", "5 as target", "6 as _source")
    odd.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    got = mixing.mixed_documents(docs)
    assert got.columns == odd.columns
    taken = {r.doc_id: r.taken for r in mixing.document_mix(write(spark, tmp_path, rows[len(EDGE):], "plain")).collect()}
    assert set(taken) == set(range(100, 140))
    words_of = got.selectExpr("doc_id", "size").collect()
    assert words_of and all(r["size"] == 4 for r in words_of)
