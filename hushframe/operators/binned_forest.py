"""Random forest over many rows: binned features, levels counted on the cluster in packed blocks.

The rules are those of Spark's forest: features cut into bins by quantiles, a square root of
them drawn per node, Gini gain, Poisson draws, balanced class weights, leaves of one outcome
merged.  Spark's own keeps an object of several hundred bytes per row and adds into the
histograms of all trees at once.  Here rows are bytes, rows of equal bins and label are one
point with their number, and a task counts one tree after the other.  Counts are whole
numbers and draws belong to points, so the forest does not depend on how rows arrive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators.deep_forest import matrix
from hushframe.session import release, stage

# Rows from which a forest is grown here; fewer are Spark's.
MANY_ROWS = 250_000
# Points of a block, rows behind a task, and tasks up to which more rows make more of them.
BLOCK, SOME_ROWS, MOST_ROWS, TASKS = 1 << 16, 50_000, 4_000_000, 64
# Bytes of the histograms that a task holds, and nodes whose histograms are one shuffled row.
HELD_BYTES, CHUNK = 256 << 20, 64
# A cut above every code: rows of a leaf go on to the left.
NEVER = 255


@dataclass
class BinnedForest:
    """Cuts per feature; per tree the feature and cut of every node in heap order; shares per last node."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    shares: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares over all trees of a (rows, width) matrix."""
        out = np.zeros((len(x), self.shares.shape[2]))
        for begin in range(0, len(x), BLOCK):
            codes = binned(x[begin:begin + BLOCK], self.cuts)
            rows, sums = np.arange(codes.shape[1]), out[begin:begin + BLOCK]
            for feature, cut, shares in zip(self.feature, self.cut, self.shares):
                sums += shares[descend(codes, rows, feature, cut, self.depth)]
        return out / len(self.feature)


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Codes, feature by row: how many cuts lie below a value; not-a-number is above all cuts."""
    return np.stack([np.searchsorted(c, v).astype(np.uint8) for c, v in zip(cuts, x.T)])


def descend(codes: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place among the nodes of a level that every row reaches."""
    flat, begin = codes.ravel(), feature.astype(np.int64) * codes.shape[1]
    at = np.zeros(len(rows), np.int64)
    for _ in range(levels):
        at = 2 * at + 1 + (flat[begin[at] + rows] > cut[at])
    return at - (2**levels - 1)


def drawn_features(seed: int, tree: int, level: int, width: int) -> np.ndarray:
    """The features that each node of a level may split by."""
    order = np.random.default_rng([seed, tree, level]).random((2**level, width)).argsort(axis=1)
    return order[:, :drawn_of(width)]


def drawn_of(width: int) -> int:
    return math.ceil(math.sqrt(width))


def fits(train: DataFrame, n: int, label: str, width: int, trees: int, depth: int, bins: int, many_rows: int | None = None) -> bool:
    """Whether the rows are many, the labels whole numbers from 0, and a level's histograms within a task's bound."""
    if n < (MANY_ROWS if many_rows is None else many_rows) or not width or not 1 <= depth <= 12 or bins >= NEVER:
        return False
    found = [r[0] for r in train.select(F.col(label).cast("double")).distinct().limit(101).collect()]
    if len(found) > 100 or any(y is None or not 0 <= y < 100 or y != int(y) for y in found):
        return False
    return trees * 2 ** (depth - 1) * drawn_of(width) * bins * (int(max(found)) + 1) * 8 <= HELD_BYTES


def find_cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Cuts of every feature of ``x`` from all rows: between all values if they are few, else at quantiles."""
    points = [i / bins for i in range(1, bins)]
    x = [F.element_at("x", i + 1) for i in range(width)]
    many = rows.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(x)]).first()
    few = [i for i in range(width) if many[f"n{i}"] <= 2 * bins]
    seen = rows.agg(*[
        (F.collect_set(c) if i in few else F.percentile_approx(c, points, 100 * bins)).alias(f"v{i}") for i, c in enumerate(x)
    ]).first()
    values = [np.unique(np.array(seen[f"v{i}"], float)) for i in range(width)]
    # a few values more than bins are cut like many
    rest = [i for i in few if len(values[i]) > bins]
    exact = rows.agg(*[F.percentile_approx(x[i], points, 100 * bins).alias(f"v{i}") for i in rest]).first() if rest else {}
    cuts = []
    for i, v in enumerate(values):
        if i in few and i not in rest:
            cuts.append(v[:-1] / 2 + v[1:] / 2)
        else:
            cuts.append(np.unique(np.array(exact[f"v{i}"], float)) if i in rest else v)
    return cuts


def packed_blocks(rows: DataFrame, n: int, cuts: Sequence[np.ndarray], trees: int, seed: int) -> DataFrame:
    """Blocks of points: codes feature by point, labels, and the draws of every tree.

    The draws of mean one of n equal rows add up to a Poisson draw of mean n.
    """
    width = len(cuts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                x = matrix(pa.chunked_array([rows["x"]]))
                # as Spark's forest, which refuses such rows
                if x.shape[1] != width or not np.isfinite(x).all():
                    raise ValueError("features must be vectors of one length without NaN and infinite values")
                codes = np.ascontiguousarray(binned(x, cuts).T)
                ends = np.arange(0, codes.size + 1, width, dtype=np.int32)
                code = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([code, rows["y"]], ["code", "y"])

    def block(codes: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        x = np.ascontiguousarray(codes.T)
        w = np.random.default_rng([seed, crc32(x), crc32(y)]).poisson(n, (trees, len(n)))
        cells = [x.tobytes(), y.tobytes(), w.astype("u1" if w.max() < 256 else "<u4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["x", "y", "w"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for points in batches:
            codes = np.frombuffer(b"".join(points["code"].to_pylist()), np.uint8).reshape(-1, width)
            held.append((codes, points["y"].to_numpy().astype(np.uint8), points["n"].to_numpy()))
            many += len(codes)
            while many >= BLOCK:
                whole = [np.concatenate(c) for c in zip(*held)]
                yield block(*[c[:BLOCK] for c in whole])
                held, many = [tuple(c[BLOCK:] for c in whole)], many - BLOCK
        if many:
            yield block(*[np.concatenate(c) for c in zip(*held)])

    tasks = max(1, min(n // SOME_ROWS, TASKS), n // MOST_ROWS)
    points = rows.mapInArrow(coded, "code binary, y int").groupBy("code", "y").agg(F.count(F.lit(1)).alias("n"))
    # a number of tasks that the rows decide, and a fixed order inside, so that draws do not depend on the cluster
    ordered = points.repartition(tasks, "code", "y").sortWithinPartitions("code", "y")
    return stage(ordered.mapInArrow(blocks, "x binary, y binary, w binary"))


def best_cuts(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """(slot, code, gain, left counts, right counts) of each node's best cut by Gini gain; gain 0 without one.

    ``counts``: node, slot of the drawn feature, code, class.
    """
    left = counts.cumsum(axis=2)[:, :, :-1]
    right = counts.sum(axis=2)[:, :, None] - left
    weighed = [side * weights for side in (left, right, left + right)]
    total = [side.sum(axis=3) for side in weighed]
    squared = [np.divide((side**2).sum(axis=3), t, out=np.zeros_like(t), where=t > 0) for side, t in zip(weighed, total)]
    gain = np.divide(squared[0] + squared[1] - squared[2], total[2], out=np.zeros_like(total[2]), where=total[2] > 0)
    gain[(left.sum(axis=3) < 1) | (right.sum(axis=3) < 1)] = 0.0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    node, (slot, code) = np.arange(len(gain)), np.unravel_index(best, gain.shape[1:])
    return slot, code, flat[node, best], left[node, slot, code], right[node, slot, code]


def fit_binned(
    rows: DataFrame, n: int, width: int, trees: int, depth: int, bins: int, seed: int, label: str = "label", features: str = "features"
) -> BinnedForest:
    """Forest for balanced classes over ``n`` rows; labels are whole numbers from 0."""
    base = rows.select(F.col(label).cast("int").alias("y"), vector_to_array(F.col(features)).alias("x"))
    sizes = {r["y"]: r["n"] for r in base.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = max(sizes) + 1
    weights = np.array([n / len(sizes) / sizes[y] if y in sizes else 0.0 for y in range(classes)])
    cuts = find_cuts(base, width, bins)
    bins = max(len(c) for c in cuts) + 1
    blocks = packed_blocks(base, n, cuts, trees, seed)
    feature, cut, counts = grow_levels(blocks, trees, depth, width, bins, weights, seed)
    release(blocks)
    return BinnedForest(cuts, feature, cut, _shares(cut, counts * weights, depth), depth)


def grow_levels(
    blocks: DataFrame, trees: int, depth: int, width: int, bins: int, weights: np.ndarray, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and cut of every node in heap order, and its counts by class; a leaf's cut is NEVER."""
    nodes, classes = 2 ** (depth + 1) - 1, len(weights)
    # a node is a leaf until a split of it is found
    feature, cut = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), NEVER, np.uint8)
    counts, open_ = np.zeros((trees, nodes, classes)), np.ones((trees, 1), bool)
    for level in range(depth):
        first = 2**level - 1
        for r in _splits(blocks, feature, cut, open_, level, width, bins, weights, seed).collect():
            at, sides = first + r["node"], (r["left"], r["right"])
            if not level:
                counts[r["tree"], 0] = np.sum(sides, axis=0)
            if r["gain"] > 1e-12:
                feature[r["tree"], at], cut[r["tree"], at] = r["feature"], r["code"]
                counts[r["tree"], 2 * at + 1:2 * at + 3] = sides
        below = slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
        open_ = (counts[:, below] > 0).sum(axis=2) > 1
        if not open_.any():
            break
    return feature, cut, counts


def _splits(
    blocks: DataFrame, feature: np.ndarray, cut: np.ndarray, open_: np.ndarray, level: int, width: int, bins: int, weights: np.ndarray, seed: int
) -> DataFrame:
    """(tree, node, feature, code, gain, left, right) of the open nodes of a level."""
    trees, classes = len(feature), len(weights)
    top = 2**level - 1
    feature, cut = feature[:, :max(top, 1)], cut[:, :max(top, 1)]
    drawn = [drawn_features(seed, t, level, width) for t in range(trees)]
    slots = drawn[0].shape[1]
    shape = (2**level, slots, bins, classes)
    size = int(np.prod(shape))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for x, y, w in zip(*[batch[c].to_pylist() for c in ("x", "y", "w")]):
                codes, y = np.frombuffer(x, np.uint8).reshape(width, -1), np.frombuffer(y, np.uint8)
                draws = np.frombuffer(w, "u1" if len(w) == trees * len(y) else "<u4").reshape(trees, -1)
                flat = codes.ravel()
                for t in np.nonzero(open_.any(axis=1))[0]:
                    rows = np.nonzero(draws[t])[0]
                    at = descend(codes, rows, feature[t], cut[t], level)
                    inside = open_[t][at]
                    if not inside.all():
                        rows, at = rows[inside], at[inside]
                    label, begin = y[rows], drawn[t] * len(y)
                    cells = [((at * slots + s) * bins + flat[begin[at, s] + rows]) * classes + label for s in range(slots)]
                    found = np.bincount(np.concatenate(cells), np.tile(draws[t][rows], slots), size)
                    sums[t] = sums[t] + found if t in sums else found
        step = size // 2**level * CHUNK
        for t, c in sums.items():
            parts = [c[i:i + step] for i in range(0, size, step)]
            cells = [pa.array([int(t)] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["tree", "chunk", "c"])

    def split(part: pa.Table) -> pa.Table:
        t, chunk = part["tree"][0].as_py(), part["chunk"][0].as_py()
        sums = sum(np.frombuffer(c.as_py(), "<f8") for c in part["c"]).reshape(-1, *shape[1:])
        slot, code, gain, left, right = best_cuts(sums, weights)
        node = np.arange(len(sums)) + chunk * CHUNK
        kept = open_[t][node]
        lists = lambda side: pa.array(list(side[kept]), pa.list_(pa.float64()))
        return pa.table({
            "tree": pa.array([t] * int(kept.sum()), pa.int32()), "node": pa.array(node[kept], pa.int32()),
            "feature": pa.array(drawn[t][node, slot][kept], pa.int32()), "code": pa.array(code[kept], pa.int32()),
            "gain": gain[kept], "left": lists(left), "right": lists(right),
        })

    fields = "tree int, node int, feature int, code int, gain double, left array<double>, right array<double>"
    return blocks.mapInArrow(count, "tree int, chunk int, c binary").groupBy("tree", "chunk").applyInArrow(split, fields)


def _shares(cut: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """Class shares at the last level; leaves of one outcome merge into their parent, whose cut is taken out of ``cut``."""
    leaf = cut == NEVER
    outcome = counts.argmax(axis=2)
    for level in range(depth - 1, -1, -1):
        at = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        left, right = 2 * at + 1, 2 * at + 2
        leaf[:, at] |= leaf[:, left] & leaf[:, right] & (outcome[:, left] == outcome[:, right])
    cut[leaf] = NEVER
    for level in range(depth):
        at = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        counts[:, 2 * at + 1] = np.where(leaf[:, at, None], counts[:, at], counts[:, 2 * at + 1])
        leaf[:, 2 * at + 1] |= leaf[:, at]
    last = counts[:, 2**depth - 1:]
    total = last.sum(axis=2, keepdims=True)
    return np.divide(last, total, out=np.zeros_like(last), where=total > 0)
