"""SimHash near-duplicates, found by deletion variants of fingerprint segments.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit of
one of their two halves.  The distinct values of each half are indexed under their 32
one-wildcard variants; two values meet under a variant only if they differ in exactly
that bit, so an index entry never has more than two values.  Equal values and such
pairs make buckets of fingerprints.  A bucket with many fingerprints is cut the same
way along the half it does not share, first into quarters, then into eighths, where a
bucket can hold no more than 2,048 fingerprints.  Inside a bucket every pair is compared
in one small matrix, and of each linked set only the links to its smallest fingerprint
leave the task.

Defined cases: a null or blank text has fingerprint zero and is linked like any other;
a text of one or two words is one shingle; equal fingerprints are one node, whatever
the number of their documents; a component without any doc_id has a null id; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.common import join_hot
from hushframe.session import stage

SHINGLE = 3
DISTANCE = 3
SEED = 42
# A bucket with more fingerprints is cut further, while there are bits to cut.
BUCKET = 512


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all word shingles in order, repeats included; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    # on UTF-8 bytes, lower() changes A-Z only and split() cuts at the six ASCII spaces
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle + 1, 1)
    ends = ends[min(shingle, len(words)) - 1:]
    return np.fromiter(
        (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends.tolist())), np.uint64, last
    )


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit majority vote over the hashes of all word shingles; zero without a word."""
    hashes = shingle_hashes(text, shingle)
    last = len(hashes)
    votes = np.zeros(64, np.int64)
    for at in range(0, last, 65_536):
        part = hashes[at:at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > last).tobytes(), "big")


def with_fingerprint(documents: DataFrame, name: str, text: str = "text") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf(T.LongType())
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return documents.withColumn(name, fingerprints(F.col(text).cast("string")))


def _bits(fp: Column, shift: Column, width: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _buckets(members: DataFrame, width: int) -> DataFrame:
    """Cuts every scope of ``members`` (scope, rest, fp) into buckets by two segments of ``width`` bits.

    ``rest`` is the shift of the bits that the scope does not share; the result has
    (bucket, rest, fp) and the bucket's fingerprints as ``n``.
    """
    cut = members.withColumn("_seg", F.explode(F.array(F.lit(0), F.lit(1))))
    cut = cut.withColumn("_value", _bits(F.col("fp"), (F.col("rest") + F.col("_seg") * width).cast("int"), width))
    # the half that is not looked at is what a finer cut has left
    other = (F.col("rest") + (F.lit(1) - F.col("_seg")) * width).cast("int")
    values = cut.groupBy("scope", "_seg", "_value").agg(F.count("*").alias("n"))
    # few bytes become many rows here: a fixed number of tasks shares the work evenly
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = values.repartition(tasks, "_value", "_seg").withColumn("_bit", F.explode(F.array(*[F.lit(1 << b).cast("long") for b in range(width)])))
    variants = variants.withColumn("_key", F.col("_value").bitwiseAND(F.bitwise_not("_bit")))
    # a wildcard variant has at most two values: the one without the bit and the one with it
    pairs = (
        variants.groupBy("scope", "_seg", "_bit", "_key")
        .agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.sum("n").alias("n"))
        .filter(F.col("_low") != F.col("_high"))
        .select("scope", "_seg", "_low", "_high", "n")
    )
    same = values.filter(F.col("n") > 1).select("scope", "_seg", F.col("_value").alias("_low"), F.col("_value").alias("_high"), "n")
    found = stage(same.unionByName(pairs))
    # a bucket is reached from its one or two values
    ends = found.select("scope", "_seg", "_low", "_high", "n", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_value"))
    bucket = F.concat_ws("/", "scope", "_seg", F.hex("_low"), F.hex("_high"))
    return cut.withColumn("_other", other).join(ends, ["scope", "_seg", "_value"]).select(
        bucket.alias("scope"), F.col("_other").alias("rest"), "fp", "n"
    )


def _links(members: DataFrame) -> DataFrame:
    """(fp, root): every linked set inside a bucket as a star around its smallest fingerprint."""

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = [], []
            for fps in batch.fps:
                f = np.sort(np.unique(np.asarray(fps, np.int64)).view(np.uint64))
                near = np.bitwise_count(f[:, None] ^ f[None, :]) <= DISTANCE
                label = np.arange(len(f))
                while True:
                    # the smallest label in reach, until nothing changes
                    smaller = np.where(near, label[None, :], len(f)).min(1)
                    if (smaller == label).all():
                        break
                    label = smaller
                linked = np.nonzero(label != np.arange(len(f)))[0]
                left.append(f[linked])
                right.append(f[label[linked]])
            if left:
                yield pd.DataFrame({"fp": np.concatenate(left).view(np.int64), "root": np.concatenate(right).view(np.int64)})

    grouped = members.groupBy("scope").agg(F.collect_list("fp").alias("fps"))
    return grouped.select("fps").mapInPandas(stars, "fp long, root long")


def near_links(fingerprints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (fp, root) that connect exactly the fingerprints at DISTANCE or less; ``fingerprints`` has distinct ``fp``."""
    first = fingerprints.select(F.lit("").alias("scope"), F.lit(0).alias("rest"), "fp")
    members, out = stage(_buckets(first, 32)), []
    for width in (16, 8):
        out.append(_links(members.filter(F.col("n") <= bucket)))
        members = members.filter(F.col("n") > bucket)
        if members.isEmpty():
            break
        members = stage(_buckets(members.select("scope", "rest", "fp"), width))
    else:
        out.append(_links(members))
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links.distinct()


def components(links: DataFrame, a: str = "fp", b: str = "root") -> DataFrame:
    """(node, component) for every node with a link: the smallest node reachable.

    Large and small stars in turn: each round links every neighbour of a node to the
    smallest of them, so paths halve and a round moves only the links.  A node with many
    neighbours is never gathered, its minimum is a partial aggregate.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    while True:
        before = _summary(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if _summary(edges) == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _summary(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the links."""
    mark = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(mark), F.sum(F.shiftright(mark, 20))).first()
    return tuple(row)


def document_components(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint as hex, component_id."""
    docs = stage(with_fingerprint(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "fp").select("doc_id", "fp"))
    return _with_component(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_component(docs: DataFrame) -> DataFrame:
    """Adds component_id to staged (doc_id, fp, ...): hot fingerprints and all, rows move at most once."""
    nodes = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    found = components(near_links(nodes.select("fp")))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stage(named)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(named.join(ids, "component").select("fp", "component_id", "copies"))
    total = named.agg(F.sum("copies")).first()[0] or 0
    return join_hot(docs, named, ["fp"], "copies", total)
