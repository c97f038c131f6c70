from collections import Counter

import pytest

from hushframe.llm import common, exact_dedup, mixing, sharding

from frames import EDGE, prose, write


@pytest.fixture
def splits(spark):
    """Scans of the same files are cut finer each time, as when the live cores change between jobs."""

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def table(spark, tmp_path):
    return write(spark, tmp_path, EDGE + [(100 + i, prose(5 + i % 40, i % 70)) for i in range(200)], parts=7)


def test_places_do_not_depend_on_splits(spark, tmp_path, splits):
    docs = table(spark, tmp_path)
    seen = []
    for size in (64, 3_000, 1 << 27):
        splits(size)
        rows = common.with_place(docs, "place").collect()
        assert len({r.place for r in rows}) == len(rows) == docs.count()
        seen.append(Counter((r.place, r.doc_id, r.text) for r in rows))
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("operator", [exact_dedup.drop_copies, mixing.mixed_documents])
def test_rows_are_found_again_when_splits_change(spark, tmp_path, splits, monkeypatch, operator):
    docs = table(spark, tmp_path)
    want = Counter((r.doc_id, r.text) for r in operator(docs).collect())
    splits(1 << 27)
    late = operator(docs)
    # the ids are staged by now; the last scan sees other splits
    splits(64)
    assert Counter((r.doc_id, r.text) for r in late.collect()) == want


def test_slots_are_the_same_over_any_splits(spark, tmp_path, splits):
    docs = table(spark, tmp_path)
    splits(64)
    some = Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.document_shards(docs).collect())
    splits(1 << 27)
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.document_shards(docs).collect()) == some
