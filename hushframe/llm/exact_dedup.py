"""Exact dedup with a persistent digest index, bucketed and sorted by digest.

New rows are reduced to one entry per digest, the entries the index lacks are found
by a sort-merge anti-join on the index's own buckets, and appended.  Entries seen
again only add to the count.

Defined cases: a null text counts as the empty one; texts are equal when identical
after lower-casing A-Z; of equal texts the largest doc_id stays, null being the
smallest, and of repeated rows with that id one; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import ascii_lower, fresh, join_hot, text_of, with_place
from hushframe.operators.joins import is_small
from hushframe.session import ensure_checkpoint_dir, stage

# Rows of one index bucket; the bucket count of a new index follows from it.
BUCKET_ROWS = 4_000_000
MIN_BUCKETS = 16


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


class DigestIndex:
    """Digests of all texts seen so far with the row that stays and the copies counted.

    ``path`` is a folder on storage that all executors share; opening it again, in
    another session too, continues the index.  Appends are whole Spark writes: a
    failed one leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = MIN_BUCKETS):
        self.spark = spark
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, copies BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.buckets = buckets

    def entries(self) -> DataFrame:
        """One row per digest; the index's buckets serve the grouping, nothing moves."""
        return self.spark.table(self.name).groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row"), F.sum("copies").alias("copies")
        )

    def add(self, rows: DataFrame) -> None:
        """Appends ``rows`` (digest, doc_id, row); earlier batches keep what they have."""
        batch = (
            rows.groupBy("digest")
            .agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("copies"))
            .repartition(self.buckets, "digest")
        )
        known = self.spark.table(self.name).select("digest").hint("merge")
        new = batch.join(known, "digest", "left_anti").select(
            "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "copies"
        )
        again = batch.join(known, "digest", "left_semi").select(
            "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "copies"
        )
        new.unionByName(again).repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forgets the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def find_copies(scan: DataFrame) -> DataFrame:
    """Per row of ``scan`` (a plain scan with doc_id, text): row, doc_id, digest, keep_id, keep_row, copies.

    Digests are staged once; the upper half of the ids enters the index first and the
    rest is deduplicated against it, so that the largest id is the one that stays.
    """
    spark = scan.sparkSession
    staged = stage(
        with_place(scan.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row").select(
            "row", "doc_id", text_digest(text_of()).alias("digest")
        )
    )
    total, low, high = staged.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}"
    index = DigestIndex(spark, path, max(MIN_BUCKETS, -(-total // BUCKET_ROWS)))
    middle = 0 if low is None else low + (high - low) // 2
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    index.add(staged.filter(upper))
    index.add(staged.filter(~upper))
    return join_hot(staged, index.entries(), ["digest"], "copies", total)


def document_copies(documents: DataFrame) -> DataFrame:
    """One row per document, dropped ones too."""
    return find_copies(documents).select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(scan: DataFrame) -> DataFrame:
    """``scan`` with one row of each group of equal texts; columns as they were."""
    row = fresh(scan, "_row")[0]
    dropped = find_copies(scan).filter(F.col("row") != F.col("keep_row")).select(F.col("row").alias(row))
    dropped = stage(dropped)
    if is_small(dropped):
        dropped = F.broadcast(dropped)
    return with_place(scan, row).join(dropped, row, "left_anti").drop(row)
