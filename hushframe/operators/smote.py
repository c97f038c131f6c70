"""SMOTE: synthetic minority rows between a row and one of its k nearest neighbours.

The neighbour search is exact and never forms all pairs.  Equal vectors merge first
(with a count).  Sampled vectors are pivots: each vector belongs to the cell of its
nearest pivot, and a cell is cut into chunks of bounded size by the distance to the
pivot.  A row's k-th distance inside its own chunk bounds how far away a neighbour can
be; by the triangle inequality that rules out the cells whose border is further, and
within a cell the chunks whose distances to the pivot differ by more.  Only what is left
meets, chunk by chunk, and each pair of chunks leaves k candidates per row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushframe.functions.noise import uniform
from hushframe.operators.joins import attach
from hushframe.operators.ranks import running_total, smallest_per_group
from hushframe.session import cut_lineage

CHUNK_ROWS = 2048
# The most pivots; with more vectors a cell has more chunks instead.
PIVOTS = 1024
NEIGHBOURS = 5
# Synthetic rows generated per task row after spreading.
BURST = 1000
# Spans of one cell that are looked up in one task.
SPANS = 200_000
# Distances that rounding may have moved by this part still count as reachable.
SLACK = 1e-9


def _nearest(q: np.ndarray, p: np.ndarray, q_id: np.ndarray, p_id: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the k candidates with the smallest (distance, id), itself left out."""
    out = []
    for i in range(len(q)):
        d = ((p - q[i]) ** 2).sum(axis=1)
        other = np.flatnonzero(p_id != q_id[i])
        best = other[np.lexsort((p_id[other], d[other]))[:k]]
        out.append((best, d[best]))
    return out


def _listed(q_id: np.ndarray, p_id: np.ndarray, got: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({
        "id": np.repeat(q_id, [len(b) for b, _ in got]), "near": np.concatenate([p_id[b] for b, _ in got]), "dist": np.concatenate([d for _, d in got]),
    })


def _all_at_once(points: DataFrame, k: int) -> DataFrame:
    """Nearest vectors of a table that is one chunk."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf["x"].to_numpy()), pdf["id"].to_numpy()
        found = _nearest(x, x, ids, ids, k)
        return _listed(ids, ids, found).assign(rk=np.concatenate([np.arange(1, len(b) + 1) for b, _ in found]).astype("int32"))

    return points.select("id", "x", F.lit(0).alias("_g")).groupBy("_g").applyInPandas(
        lambda pdf: search(pdf[["id", "x"]]), "id bigint, near bigint, dist double, rk int"
    )


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, row by row so that no block grows with both sides."""
    return np.stack([np.sqrt(((pivots - v) ** 2).sum(axis=1)) for v in x])


def _cells(points: DataFrame, chunk_rows: int, most: int) -> tuple[DataFrame, np.ndarray]:
    """Vectors with their cell, their distance to its pivot and their chunk; the pivots."""
    count = points.count()
    wanted = max(1, min(most, count // chunk_rows))
    # a bounded number of vectors, drawn by a hash so that every run has the same
    drawn = points.select("x", F.xxhash64("id", F.lit("pivot")).alias("_h"), "id").orderBy("_h", "id").limit(wanted).toPandas()
    pivots = np.stack(drawn["x"].to_numpy()) if len(drawn) else np.empty((0, 0))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["x"].to_numpy()), pivots)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), far=d[np.arange(len(d)), cell])

    placed = points.select("id", "x").mapInPandas(assign, "id bigint, x array<double>, cell int, far double")
    ranked = running_total(placed.withColumn("_one", F.lit(1)), ["cell"], ["far", "id"], ["_one"])
    chunk = F.floor(F.col("before__one") / F.lit(chunk_rows)).cast("int")
    return cut_lineage(ranked.select("id", "x", "cell", "far", chunk.alias("chunk"))), pivots


def reachable(points: DataFrame, k: int = NEIGHBOURS, chunk_rows: int = CHUNK_ROWS, most: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The placed vectors (id, x, cell, chunk, far) and, for each, every chunk that may hold one of its k nearest.

    The second frame has (id, x, cell, chunk) and the other chunk as (to_cell, to_chunk).
    """
    placed, pivots = _cells(points, chunk_rows, most)

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf["x"].to_numpy()), pdf["id"].to_numpy()
        kth = np.array([np.sqrt(d[k - 1]) if len(d) == k else np.inf for _, d in _nearest(x, x, ids, ids, k)])
        out = []
        # blocks of rows, as every row may reach every cell
        for at in range(0, len(x), 256):
            d = _distances(x[at:at + 256], pivots)
            own, bound = d[:, int(pdf["cell"].iloc[0])], kth[at:at + 256] * (1 + SLACK) + SLACK * d.max(axis=1)
            # a vector of another cell is nearer to that pivot, so half the difference lies between
            row, cell = np.nonzero((d - own[:, None]) / 2 <= bound[:, None])
            out.append(pd.DataFrame({
                "id": ids[at + row], "to_cell": cell.astype("int32"), "low": d[row, cell] - bound[row], "high": d[row, cell] + bound[row],
            }))
        return pd.concat(out)

    spans = cut_lineage(placed.groupBy("cell", "chunk").applyInPandas(reach, "id bigint, to_cell int, low double, high double"))
    edges = placed.groupBy(F.col("cell").alias("to_cell"), F.col("chunk").alias("to_chunk")).agg(F.min("far").alias("first"), F.max("far").alias("last"))
    return placed, cut_lineage(placed.select("id", "x", "cell", "chunk").join(_touched(spans, edges), "id"))


def _touched(spans: DataFrame, edges: DataFrame, most: int = SPANS) -> DataFrame:
    """(id, to_cell, to_chunk) for the chunks of a cell that a span of distances touches.

    The chunks of a cell follow each other, so a span touches a run of them; the spans of
    a cell that very many reach are looked up in parts.
    """
    parts = spans.groupBy("to_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("parts"))
    left = attach(spans, parts, ["to_cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = edges.join(parts, "to_cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))

    def find(asked: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(chunks):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("id", "int64"), ("to_cell", "int32"), ("head", "int32"), ("tail", "int32"))})
        chunks = chunks.sort_values("to_chunk")
        head = np.searchsorted(chunks["last"].to_numpy(), asked["low"].to_numpy(), "left")
        tail = np.searchsorted(chunks["first"].to_numpy(), asked["high"].to_numpy(), "right") - 1
        return asked[["id", "to_cell"]].assign(head=head.astype("int32"), tail=tail.astype("int32"))

    runs = left.groupBy("to_cell", "part").cogroup(right.groupBy("to_cell", "part")).applyInPandas(find, "id bigint, to_cell int, head int, tail int")
    return runs.filter("head <= tail").select("id", "to_cell", F.explode(F.sequence("head", "tail")).alias("to_chunk"))


def nearest_vectors(
    points: DataFrame, width: int, k: int = NEIGHBOURS, chunk_rows: int = CHUNK_ROWS, most: int = PIVOTS
) -> DataFrame:
    """Exact nearest other vectors.  ``points``: unique ``id`` bigint and distinct ``x``.

    Returns ``id``, ``near``, ``dist`` (squared), ``rk`` (1 = nearest) with up to k
    rows per id, ties by the smaller id.
    """
    if len(points.limit(chunk_rows + 1).select("id").collect()) <= chunk_rows:
        return _all_at_once(points, k)
    placed, queries = reachable(points, k, chunk_rows, most)
    pairs = queries.select("cell", "chunk", "to_cell", "to_chunk").distinct()
    served = placed.select("id", "x", F.col("cell").alias("to_cell"), F.col("chunk").alias("to_chunk")).join(pairs, ["to_cell", "to_chunk"])
    key = ["cell", "chunk", "to_cell", "to_chunk"]
    # names of their own, as both sides come from the same vectors
    served = served.select(*[F.col(c).alias(f"r_{c}") for c in ("id", "x", *key)])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        q, p = np.stack(left["x"].to_numpy()), np.stack(right["r_x"].to_numpy())
        q_id, p_id = left["id"].to_numpy(), right["r_id"].to_numpy()
        return _listed(q_id, p_id, _nearest(q, p, q_id, p_id, k))

    found = queries.groupBy(*key).cogroup(served.groupBy(*[f"r_{c}" for c in key])).applyInPandas(meet, "id bigint, near bigint, dist double")
    rk = F.row_number().over(W.partitionBy("id").orderBy("dist", "near"))
    return found.withColumn("rk", rk).filter(F.col("rk") <= k)


def smote(
    df: DataFrame, features: Sequence[str], label: str, key: str, k: int = NEIGHBOURS, seed: str | int = 42,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Synthetic rows ``key``, ``copy``, features, label that balance the rarer class.

    Every minority row gets the same number of synthetic rows, the remainder goes
    to the smallest hashes.  Neighbour and position are hash-drawn per copy.
    """
    features = list(features)
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        raise ValueError("SMOTE needs two classes")
    minority = min(sizes, key=lambda c: (sizes[c], c))
    m, missing = sizes[minority], max(sizes.values()) - sizes[minority]
    each, rest = divmod(missing, m)
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.filter(F.col(label) == F.lit(minority)).select(F.col(key).cast("bigint").alias("key"), x.alias("x"))
    vectors = cut_lineage(rows.groupBy("x").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies")))
    near = nearest_vectors(vectors.select("id", "x"), len(features), k, chunk_rows)
    # its own copies come first, at distance 0
    own = vectors.filter(F.col("copies") > 1).select(
        "id", F.col("id").alias("near"), F.lit(0.0).alias("dist"), F.lit(0).alias("rk")
    )
    listed = near.select("id", "near", "dist", F.col("rk").cast("int").alias("rk")).unionByName(own)
    target = vectors.select(F.col("id").alias("near"), F.col("x").alias("near_x"), "copies")
    weight = F.when(F.col("rk") == 0, F.col("copies") - 1).otherwise(F.col("copies"))
    lists = (
        listed.join(target, "near")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("dist", "near", weight.alias("w"), "near_x"))).alias("near"))
    )
    quotas = df.sparkSession.createDataFrame([(rest,)], "quota bigint")
    marked = smallest_per_group(rows, [], uniform(seed, F.lit("extra"), "key"), ["key"], quotas)
    counted = marked.withColumn("todo", F.lit(each) + F.col("_taken").cast("bigint")).filter(F.col("todo") > 0)
    keyed = attach(counted.select("key", "x", "todo"), vectors, ["x"], weight="copies").drop("copies")
    whole = attach(keyed, lists, ["id"])
    # few minority rows may make many synthetic ones: spread bursts before expanding
    bursts = whole.withColumn("burst", F.explode(F.sequence(F.lit(0), F.floor((F.col("todo") - 1) / F.lit(BURST)))))
    bursts = bursts.repartition("key", "burst")
    first, stop = F.col("burst") * BURST, F.least((F.col("burst") + 1) * BURST, F.col("todo")) - 1
    drawn = bursts.withColumn("copy", F.explode(F.sequence(first, stop)))
    pick = F.floor(uniform(seed, F.lit("neighbour"), "key", "copy") * F.lit(min(k, m - 1)))
    walk = F.aggregate(
        "near",
        F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("array<double>").alias("x")),
        lambda a, n: F.struct(
            (a["upto"] + n["w"]).alias("upto"),
            F.when(a["x"].isNull() & (a["upto"] + n["w"] > F.col("pick")), n["near_x"]).otherwise(a["x"]).alias("x"),
        ),
    )["x"]
    gap = uniform(seed, F.lit("gap"), "key", "copy")
    made = drawn.withColumn("pick", pick).withColumn("to", walk).withColumn("gap", gap)
    return made.select(
        F.col("key").alias(key),
        "copy",
        *[(F.col("x")[i] + F.col("gap") * (F.col("to")[i] - F.col("x")[i])).alias(c) for i, c in enumerate(features)],
        F.lit(minority).alias(label),
    )
