"""Shards by jump consistent hashing: key and shard count alone decide, no ring table.

Law ``key``: going from n to n + 1 shards moves a row only into the new shard.

Defined cases: a null key hashes as 0; a null text has size 1 and the checksum of
the empty text; repeated rows land in one shard and get different slots; an empty
table gives an empty result.  A hot key stays in one shard (the law demands it), but
its rows are numbered where they were read, so no task gathers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import fresh, text_of, with_place

# Fixed values of the published algorithm: the 64-bit multiplier, as 32-bit halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD
# Almost every key needs about ln(shards) jumps; those that need more get a second pass.
FIRST_JUMPS = 64
# Rows are numbered in blocks of 2 ** BLOCK_BITS rows of a file.
BLOCK_BITS = 16


def _jumps(state: str, shards: int, steps: int) -> str:
    """SQL that jumps until j reaches ``shards``; 64-bit wrap-around in 32-bit halves."""
    c0, c1, m = MULTIPLIER_LOW & 0xFFFF, MULTIPLIER_LOW >> 16, 0xFFFFFFFF
    low = f"((s.lo * {c0}L & {m}L) + ((s.lo * {c1}L & 65535L) * 65536L) + 1L)"
    carry = f"(shiftright(s.lo * {c0}L, 32) + shiftright(s.lo * {c1}L, 16) + shiftright({low}, 32))"
    high = f"(({carry} + s.hi * {c0}L + (s.hi * {c1}L & 65535L) * 65536L + s.lo * {MULTIPLIER_HIGH}L) & {m}L)"
    jump = f"cast(floor((s.j + 1L) * (2147483648D / cast(shiftright(x.hi, 1) + 1L AS double))) AS bigint)"
    step = (
        f"element_at(transform(array(named_struct('hi', {high}, 'lo', {low} & {m}L)), "
        f"x -> named_struct('b', s.j, 'j', {jump}, 'hi', x.hi, 'lo', x.lo)), 1)"
    )
    return f"aggregate(sequence(1, {steps}), {state}, (s, i) -> if(s.j >= {shards}L, s, {step}))"


def jump_hash(df: DataFrame, key: Column, shards: int, shard: str, grown: str) -> DataFrame:
    """Adds the shard of ``key`` (a 64-bit integer) among ``shards`` and among one more."""
    k, state = fresh(df, "_jump_key", "_jump_state")
    start = f"named_struct('b', -1L, 'j', 0L, 'hi', shiftrightunsigned(`{k}`, 32), 'lo', `{k}` & 4294967295L)"
    steps = min(shards, FIRST_JUMPS)
    df = df.withColumn(k, F.coalesce(key.cast("long"), F.lit(0))).withColumn(state, F.expr(_jumps(start, shards, steps)))
    if steps < shards:
        again = _jumps(f"`{state}`", shards, shards)
        df = df.withColumn(state, F.expr(f"if(`{state}`.j >= {shards}L, `{state}`, {again})"))
    # the last jump also tells where the row goes when one shard is added
    s = F.col(f"`{state}`")
    return df.withColumns({
        shard: s["b"].cast("int"),
        grown: F.when(s["j"] == shards, F.lit(shards)).otherwise(s["b"]).cast("int"),
    }).drop(k, state)


def shard_rows(scan: DataFrame, key: Column, shards: int) -> DataFrame:
    """``scan`` (a plain file scan) with shard, grown_shard and a gapless slot per shard.

    Slots follow the order of files and rows in them: rows are numbered inside one
    shard and block of a file, and a small table of counts per block and shard gives
    each its first slot.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    row, split, first = fresh(scan, "_row", "_split", "_first")
    placed = jump_hash(with_place(scan, row), key, shards, "shard", "grown_shard").withColumn(split, F.shiftright(F.col(row), BLOCK_BITS))
    counts = placed.groupBy("shard", split).count()
    before = Window.partitionBy("shard").orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", split, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first))
    inside = Window.partitionBy("shard", split).orderBy(row)
    return (
        placed.withColumn("slot", F.row_number().over(inside).cast("long") - 1)
        .join(firsts, ["shard", split])
        .withColumn("slot", F.col("slot") + F.col(first))
        .drop(row, split, first)
    )


def write_shards(scan: DataFrame, key: Column, shards: int, path: str) -> None:
    """Writes whole rows as one folder per shard."""
    shard, grown = "shard", "grown_shard"
    jump_hash(scan, key, shards, shard, grown).drop(grown).write.partitionBy(shard).parquet(path)


def document_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: size, checksum, shard and slot under law ``key``."""
    text = text_of()
    narrow = documents.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return shard_rows(narrow, F.col("doc_id"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
