"""Near-duplicates by SimHash, and by exact Jaccard similarity of five-word shingle sets.

Texts meet where SimHash links them: a component of fingerprints (``simhash``: three bits at
most, found by one-wildcard variants) is a bucket.  SimHash alone loses most pairs at a
similarity of 0.8, so texts also meet in the buckets of a minhash: of 160 minima, 48 keys of seven each, so that a
pair at similarity 0.8 shares no key in 1 of 80,000 cases and nearer pairs still more
rarely.  Inside a bucket whole sets are compared, all with all, as one product of small
matrices over the shingles that two members share; members that share too few of theirs
with anyone leave before that.  Only stars of linked members leave the task, never
pairs.  Small buckets with the same members are compared once.

A large bucket is dealt into blocks, each of which also gets the bucket's few pivots.
After that nearly all members of a group are in one component; members that are not in
their bucket's main component meet all the others, block by block.

Defined cases: texts with equal shingle sets are one node, null and blank texts (the
empty set) too; a text of one to four words is one shingle; repeated rows are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.common import bounded_batches, fresh, join_hot, release_memory, with_place, with_row_id
from hushframe.llm.simhash import components, fingerprint, near_links, shingle_hashes
from hushframe.operators.joins import attach, is_small
from hushframe.session import release, stage

SHINGLE = 5
# Linked are sets with |A n B| / |A u B| >= NEAR / WHOLE.
NEAR, WHOLE = 4, 5
MINIMA, KEYS, PART = 160, 48, 7
SEED = 42
# Members and shingles of a bucket that is compared as it is, and of a block of a larger one.
SMALL, BLOCK, BLOCK_SHINGLES = 64, 1_024, 1 << 20
# Members of a large bucket that all its blocks get, on average.
PIVOTS = 16
# Shingles that are multiplied at once.
COLUMNS = 4_096


def _odd(name: int, count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, name])).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS, _SHIFTS = _odd(1, MINIMA), _odd(2, MINIMA)
_MIXERS, _STARTS = _odd(3, KEYS * PART).reshape(KEYS, PART), _odd(4, KEYS)
# which minima make a key: different ones inside a key, few in common between keys
_CHOSEN = np.random.Generator(np.random.PCG64([SEED, 5])).permuted(np.tile(np.arange(MINIMA), (KEYS, 1)), axis=1)[:, :PART]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(text, shingle))


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """The minhash keys of a set; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2_048):
        part = hashes[at:at + 2_048, None] * _FACTORS
        part += _SHIFTS
        np.minimum(least, part.min(0), out=least)
    keys = ((least >> np.uint64(16))[_CHOSEN] * _MIXERS).sum(1, dtype=np.uint64) + _STARTS
    return keys ^ (keys >> np.uint64(32))


@F.pandas_udf(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]))
def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    release_memory()
    for texts in batches:
        sets = [shingle_set(t) for t in texts]
        yield pd.DataFrame({
            "digest": [blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "size": [len(s) for s in sets],
            "keys": [bucket_keys(s).view(np.int64) for s in sets], "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64),
        })


@F.pandas_udf(T.BinaryType())
def _sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    release_memory()
    for texts in batches:
        yield pd.Series([shingle_set(t).tobytes() for t in texts])


def linked_sets(sets: list[np.ndarray]) -> np.ndarray:
    """For every set the least position of a set it is connected with by links among ``sets``."""
    label, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    owner = np.repeat(label, size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a link needs NEAR / WHOLE of either set in the other
    shared = np.bincount(owner[count[column] > 1], minlength=len(sets))
    able = np.nonzero((shared * WHOLE >= size * NEAR) & (size > 0))[0]
    if len(able) < 2:
        return label
    place = np.full(len(sets), -1)
    place[able] = np.arange(len(able))
    kept = (place[owner] >= 0) & (count[column] > 1)
    row, column = place[owner[kept]], column[kept]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    new = np.concatenate(([True], column[1:] != column[:-1]))
    column = np.cumsum(new) - 1
    common = np.zeros((len(able), len(able)), np.float32)
    for first in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(able), min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        common += part @ part.T
    union = size[able][:, None] + size[able][None, :] - common
    link = common * WHOLE >= union * NEAR
    mine = np.arange(len(able))
    while True:
        least = np.minimum(mine, np.where(link, mine[None, :], len(able)).min(1))
        least = np.minimum(least, least[least])
        if (least == mine).all():
            break
        mine = least
    label[able] = able[mine]
    return label


def stars(groups: DataFrame) -> DataFrame:
    """(node, root): what is linked inside every group (ids, sets), as stars."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory()
        for batch in batches:
            nodes, roots = [], []
            for g in range(batch.num_rows):
                # a pivot may have come twice
                ids, first = np.unique(np.array(batch.column(0)[g].as_py(), np.int64), return_index=True)
                raw = batch.column(1)[g].as_py()
                label = linked_sets([np.frombuffer(raw[i], np.uint64) for i in first])
                some = np.nonzero(label != np.arange(len(ids)))[0]
                nodes.append(ids[some])
                roots.append(ids[label[some]])
            columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in (nodes, roots)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "root"])

    return groups.mapInArrow(compare, "node long, root long")


def _starred(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Stars inside every (bucket, block) of ``rows`` (bucket, block, node)."""
    groups = rows.join(sets, "node").groupBy("bucket", "block").agg(F.collect_list("node").alias("ids"), F.collect_list("hashes").alias("sets"))
    return stars(groups.filter(F.size("ids") > 1).select("ids", "sets"))


def _blocks(members: str, shingles: str) -> F.Column:
    return F.greatest(F.ceil(F.col(members) / F.lit(BLOCK)), F.ceil(F.col(shingles) / F.lit(BLOCK_SHINGLES))).cast("int")


def simhash_keys(nodes: DataFrame) -> DataFrame:
    """(node, key) of the nodes (node, size, keys, fp) that SimHash links with another; the key is their component's."""
    marks = stage(nodes.filter("size > 0").groupBy("fp").agg(F.count("*").alias("n")))
    found = components(near_links(marks.select("fp")), "fp", "root").select(F.col("node").alias("fp"), "component")
    linked = stage(marks.join(found, "fp", "left").filter((F.col("n") > 1) | F.col("component").isNotNull()))
    keys = linked.select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key"), "n")
    total = linked.agg(F.sum("n")).first()[0] or 0
    return join_hot(nodes.filter("size > 0").select("node", "size", "fp"), keys, ["fp"], "n", total).select("node", "size", "key")


def near_components(nodes: DataFrame, scan_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of every node with a link; ``nodes`` is staged (node, size, keys, fp).

    ``scan_sets`` gives the sets (node, hashes) of the nodes of a table.
    """
    spread = nodes.select("node", "size", F.explode("keys").alias("key")).unionByName(stage(simhash_keys(nodes)))
    counts = stage(spread.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).filter("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    met = stage(join_hot(spread, counts, ["key"], "n", total))
    release(counts)
    small = (F.col("n") <= SMALL) & (F.col("shingles") <= BLOCK_SHINGLES)
    lists = met.filter(small).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    lists = stage(with_row_id(lists, "bucket"))
    large = met.filter(~small).withColumn("blocks", _blocks("n", "shingles"))
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    pivot = F.pmod(F.xxhash64("node", F.lit("pivot"), "key"), F.col("n")) < PIVOTS
    dealt = large.withColumn("block", F.explode(F.when(pivot, F.expr("sequence(0, blocks - 1)")).otherwise(F.array(own))))
    rows = lists.select(F.concat(F.lit("l"), "bucket").alias("bucket"), F.lit(0).alias("block"), F.explode("nodes").alias("node")).unionByName(
        dealt.select(F.concat(F.lit("k"), "key").alias("bucket"), "block", "node")
    )
    sets = stage(scan_sets(met.select("node").distinct()))
    first = stage(_starred(rows, sets))
    release(lists)
    found = components(first, "node", "root")
    if large.filter("blocks > 1").isEmpty():
        return found
    found = stage(found)
    # a bucket of several blocks: who is not in its main component yet meets everyone
    named = large.filter("blocks > 1").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stage(named.select("key", "node", "size", "blocks", "component"))
    most = named.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("head"))
    named = attach(named, stage(most), ["key"])
    apart = named.filter(F.col("component") != F.col("head"))
    sides = stage(apart.groupBy("key").agg(F.count("*").alias("apart"), F.sum("size").alias("apart_shingles")).withColumn("sides", _blocks("apart", "apart_shingles")).select("key", "sides"))
    both = attach(named, sides, ["key"])
    side, own = (F.pmod(F.xxhash64("node", F.lit(s)), F.col(c)).cast("int") for s, c in (("side", "sides"), ("own", "blocks")))
    left = both.filter(F.col("component") != F.col("head")).select("key", "node", side.alias("a"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("b"))
    right = both.select("key", "node", F.explode(F.expr("sequence(0, sides - 1)")).alias("a"), own.alias("b"))
    rows = left.unionByName(right).select(F.col("key").alias("bucket"), F.struct("a", "b").alias("block"), "node")
    more = stage(_starred(rows, sets))
    return components(first.unionByName(more), "node", "root")


def drop_near_copies(scan: DataFrame) -> DataFrame:
    """``scan`` (a plain file scan) with one row of each set of linked texts; columns as they were.

    The row with the smallest doc_id stays, and of repeated rows with it the first.
    """
    bounded_batches(scan)
    row = fresh(scan, "_row")[0]
    text = F.col("text").cast("string")
    docs = with_place(scan.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row")
    docs = stage(docs.select("row", "doc_id", _signed(text).alias("s")).select("row", "doc_id", "s.*"))
    groups = stage(docs.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("copies")))
    nodes = stage(docs.select(F.col("row").alias("node"), "size", "keys", "fp").join(groups.select("node"), "node", "left_semi"))

    def scan_sets(wanted: DataFrame) -> DataFrame:
        texts = with_place(scan.select("text"), "node").join(wanted, "node", "left_semi")
        return texts.select("node", _sets(text).alias("hashes"))

    found = near_components(nodes, scan_sets)
    named = stage(groups.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"), "copies"))
    total = named.agg(F.sum("copies")).first()[0] or 0
    named = stage(join_hot(docs.select("row", "doc_id", "digest"), named, ["digest"], "copies", total).select("row", "doc_id", "component"))
    release(nodes, groups, docs)
    kept = stage(named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("b")).select(F.col("b.row").alias(row)))
    dropped = stage(named.select(F.col("row").alias(row)).join(kept, row, "left_anti"))
    if is_small(dropped):
        dropped = F.broadcast(dropped)
    return with_place(scan, row).join(dropped, row, "left_anti").drop(row)
