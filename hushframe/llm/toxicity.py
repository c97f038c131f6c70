"""Toxicity scores by FTRL-proximal logistic regression over hashed word features.

Features of a text are the distinct hashes of its words, word pairs and triples, and of
pairs with one word skipped.  A fit reads a bounded sample of labelled documents, deals
it over a fixed number of tasks, runs FTRL-proximal with per-coordinate rates in each
and averages the weights.  The L1 term leaves few of them, so the model is a short
sorted list that every scoring task gets.

Defined cases: a null text is an empty one and scores by the bias alone; a null doc_id
counts as held out; labels of a repeated doc_id are joined by their maximum; without
any usable label every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import bounded_batches, fresh, release_memory

FOLDS = 5
# The bound on labelled documents in a fit (expected size of the sample).
MAX_LABELLED = 16_000
# Documents that one task learns from; a fit over fewer has one learner.
LEARNER_DOCS = 4_000
EPOCHS = 8
# A feature must occur in this many documents of a learner.
MIN_DOCS = 3
# Slots of the table that counts features before they are told apart.
TABLE = 1 << 22
ALPHA, BETA, L1, L2 = 3.0, 1.0, 10.0, 0.1
# Gradient of a toxic document against that of another: there are fewer of them.
TOXIC_WEIGHT = 4.0
NO_LABELS = -40.0
# A-Z to a-z, other ASCII characters that are neither letter nor digit to space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
# Odd multipliers that tell the feature kinds apart.
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(text: str | None) -> np.ndarray:
    """Hashes of all word features of a whole text, with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    a, b, c, d = _MIX
    pair, skip, triple = h[:-1] * a + h[1:] * b, h[:-2] * b + h[2:] * c, (h[:-2] * c + h[1:-1] * d + h[2:] * a)
    mixed = np.concatenate((h * d, pair ^ a, skip ^ b, triple ^ c))
    mixed ^= mixed >> np.uint64(29)
    return (mixed * b >> np.uint64(32)).astype(np.uint32)


@dataclass
class Model:
    """Bias and the non-zero weights by ascending feature hash."""

    bias: float
    hashes: np.ndarray
    weights: np.ndarray

    def filter(self) -> np.ndarray:
        """A small table that tells most features without weight at once."""
        table = np.zeros(1 << 20, bool)
        table[self.hashes >> np.uint32(12)] = True
        return table


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no fit may learn from."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def _learn(labels: np.ndarray, rows: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal over ``rows`` in the given order; returns bias, hashes and weights."""
    # most features occur once: a table of fixed size drops them before anything is sorted
    seen = np.zeros(TABLE, np.uint16)
    for r in rows:
        # adds once per slot and row, and never past what a row count can reach
        seen[r % TABLE] += 1
    rows = [r[seen[r % TABLE] >= MIN_DOCS] for r in rows]
    del seen
    flat = np.concatenate(rows)
    flat.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(len(flat), 1), bool), flat[1:] != flat[:-1])))
    known = flat[first[np.diff(np.append(first, len(flat))) >= MIN_DOCS]]
    del flat, first
    z, n = np.zeros(len(known)), np.zeros(len(known))
    z0 = n0 = 0.0
    spans = []
    for i, r in enumerate(rows):
        at = np.searchsorted(known, r).astype(np.int32)
        spans.append(at[known[np.minimum(at, len(known) - 1)] == r] if len(known) else at[:0])
        rows[i] = None

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(z, n):
        return -z / ((BETA + np.sqrt(n)) / ALPHA)

    for _ in range(EPOCHS):
        for y, at in zip(labels, spans):
            zs, ns = z[at], n[at]
            w = weight(zs, ns)
            w0 = bias(z0, n0)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + w0, -35, 35)))
            g = (p - y) * (TOXIC_WEIGHT if y else 1.0)
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w0
            n0 += g * g
    w = weight(z, n)
    kept = np.nonzero(w)[0]
    return bias(z0, n0), known[kept], w[kept]


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from the labelled documents outside the held-out fold."""
    bounded_batches(documents)
    usable = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.max(label) > 0).cast("int").alias("_y"))
    )
    count = usable.count()
    # a hash of the id draws the sample, so it is the same in every run and bounded by the parameter
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) / F.lit(1e6)
    sample = usable.filter(draw < F.lit(MAX_LABELLED / max(count, 1)))
    learners = max(1, min(count, MAX_LABELLED) // LEARNER_DOCS)
    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts, ys = (part.column(i).to_pylist() for i in range(3))
                found = [np.unique(features(t)).tobytes() for t in texts]
                dealt = [zlib.crc32(f"learner {i}".encode()) % learners for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dealt, pa.int32()), pa.array(ids, pa.string()), pa.array(ys, pa.int32()), pa.array(found, pa.binary())],
                    ["learner", "doc_id", "y", "features"],
                )

    def learn(table):
        import pyarrow as pa

        release_memory()
        ids, ys = table.column("doc_id").to_pylist(), table.column("y").to_numpy()
        # views of the rows as they came, no copy
        found = [np.frombuffer(f.as_buffer(), np.uint32) for f in table.column("features")]
        order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(f"order {ids[i]}".encode()), ids[i], len(found[i]), zlib.crc32(found[i])))
        bias, hashes, weights = _learn(ys[order], [found[i] for i in order])
        return pa.table({"hash": np.concatenate(([-1], hashes.astype(np.int64))), "weight": np.concatenate(([bias], weights))})

    rows = chosen.select(F.col("doc_id").cast("string"), "text", "_y").mapInArrow(extract, "learner int, doc_id string, y int, features binary")
    learned = rows.groupBy("learner").applyInArrow(learn, "hash long, weight double")
    # the sample bounds the distinct features, and L1 leaves a small part of them
    averaged = learned.groupBy("hash").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).orderBy("hash").toPandas()
    if averaged.empty:
        return Model(NO_LABELS, np.zeros(0, np.uint32), np.zeros(0))
    bias, rest = averaged[averaged.hash == -1].iloc[0], averaged[averaged.hash >= 0]
    return Model(float(bias.weight / bias.n), rest.hash.to_numpy(np.uint32), rest.weight.to_numpy() / bias.n)


def score(documents: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """Adds the score of every whole text as column ``name``; the model is broadcast."""
    bounded_batches(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_memory()
        m = shared.value
        table = m.filter()
        for texts in batches:
            sums = np.full(len(texts), m.bias)
            for i, t in enumerate(texts):
                f = features(t)
                f = np.unique(f[table[f >> np.uint32(12)]])
                if len(f) and len(m.hashes):
                    at = np.minimum(np.searchsorted(m.hashes, f), len(m.hashes) - 1)
                    sums[i] += m.weights[at[m.hashes[at] == f]].sum()
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(sums, -700, 700))))

    return documents.withColumn(name, scored(F.col(text).cast("string")))


def document_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(documents, labels)
    scores = score(documents.select("doc_id", "text"), model)
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` that score below 0.5; columns as they were."""
    name = fresh(documents, "_toxicity")[0]
    return score(documents, fit(documents, labels), name).filter(F.col(name) < 0.5).drop(name)
