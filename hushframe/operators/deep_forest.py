"""Forests without a depth cap: exact splits, grown on the cluster until a node fits into a task.

A tree sees every row as often as a Poisson draw of its key says.  While a node has more
rows than one task takes, its best split comes from prefix sums over the distinct values
of the features drawn for it, level by level for all trees at once.  Every smaller node
is grown to its pure leaves inside one task, by the same rule and the same draws, so the
forest does not depend on where that border lies.  A finished part of a tree is one row
of packed arrays; rows to score are sent to the parts they fall into, so no model of the
table's size is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.operators.joins import attach
from hushframe.operators.ranks import running_total
from hushframe.session import cut_lineage, stage

# Fixed value of the matched engine.
TREES = 100
# Rows of a node that one task grows to the end, and rows to score that meet one tree at once.
LOCAL_ROWS = 6_000_000
SCORED_ROWS = 4_000_000
# Rows that one task packs for the trees.
PACKED_ROWS = 250_000
# The part of all rows that a tree draws, a little more than 1 - 1 / e.
DRAWN = 0.64
# Cells of a matrix in which nodes of like size are split together; a node of more rows is split alone.
MATRIX_CELLS, WIDE_NODE = 1 << 20, 1 << 12
# Rows of a subtree that is grown for itself, within a processor's cache, and nodes whose draws are made one by one.
PART_ROWS, FEW_NODES = 1 << 18, 64
# Rows of a node from which it is split alone, without an index of its rows.
ALONE_ROWS = 1 << 14
# P(draw <= k) of a Poisson draw of mean one, beyond which a row counts once more.
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(9)])
PART = "tree int, path string, sub string, feature binary, threshold binary, child binary, value binary"
PACKED = {"feature": "<i4", "threshold": "<f8", "child": "<i4", "value": "<f8"}


@dataclass
class DeepForest:
    """Splits above the parts (tree, path, feature, threshold), parts, and what a leaf holds.

    A part is a node that one task has grown: its top (``sub`` is empty) and the subtrees that the
    top's nodes of feature -2 go on in, by their paths below it.
    """

    top: DataFrame
    parts: DataFrame
    trees: int
    classes: int
    levels: int


def bag(rows: DataFrame, keys: Sequence[str], trees: int, seed: str | int) -> DataFrame:
    """(tree, w, ...): every row once per tree that draws it, with the number of draws."""
    each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    bits = F.expr(f"shiftrightunsigned(xxhash64({', '.join(['_seed', 'tree', *[f'`{k}`' for k in keys]])}), 11)")
    u = bits.cast("double") * F.lit(2.0**-53)
    draws = sum((u >= F.lit(float(p))).cast("int") for p in POISSON)
    return each.withColumn("_seed", F.lit(str(seed))).withColumn("w", draws).filter("w > 0").drop("_seed")


def _rank_key(seed: str | int, tree: int, path: str, feature: int) -> int:
    """The draw that orders the features of a node; the cluster computes the same."""
    return _rank_keys(seed, tree, [path], [feature])[0]


def _rank_keys(seed: str | int, tree: int, paths: Sequence[str], features: Sequence[int]) -> list[int]:
    from xxhash import xxh64_intdigest

    ends = [f"|{f}" for f in features]
    drawn = [xxh64_intdigest(node + end, 42) for node in (f"{seed}|{tree}|{path}" for path in paths) for end in ends]
    return [h - (1 << 64) if h >> 63 else h for h in drawn]


def _rank_column(seed: str | int, feature: int) -> Column:
    return F.xxhash64(F.concat_ws("|", F.lit(str(seed)), F.col("tree").cast("string"), "path", F.lit(str(feature))))


def _feature_orders(seed: str | int, tree: int, path: str, trail: np.ndarray, width: int) -> np.ndarray:
    """The features of every node in the order in which they are drawn; a node's path is ``path`` and its row of ``trail``."""
    if len(trail) < FEW_NODES:
        keys = np.array(_rank_keys(seed, tree, [path + t.tobytes().decode() for t in trail], range(width)), np.int64).reshape(-1, width)
    else:
        begin, nodes = np.frombuffer(f"{seed}|{tree}|{path}".encode(), np.uint8), len(trail)
        text = np.concatenate([np.broadcast_to(begin, (nodes, len(begin))), trail], axis=1)
        keys = np.empty((nodes, width), np.int64)
        # features whose numbers have as many digits make texts of one length
        for digits in sorted({len(str(f)) for f in range(width)}):
            some = [f for f in range(width) if len(str(f)) == digits]
            ends = np.frombuffer("".join(f"|{f}" for f in some).encode(), np.uint8).reshape(len(some), -1)
            keys[:, some] = xxh64(np.concatenate([np.repeat(text, len(some), axis=0), np.tile(ends, (nodes, 1))], axis=1)).view(np.int64).reshape(nodes, -1)
    return np.argsort(keys, axis=1, kind="stable")


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def xxh64(text: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every row of a matrix of bytes, as the xxhash library has it."""
    p1, p2, p3, p4, p5 = _P
    n, size = text.shape
    rotl = lambda h, k: (h << np.uint64(k)) | (h >> np.uint64(64 - k))
    mixed = lambda v: rotl(v * p2, 31) * p1
    whole, first = size // 8, np.full(n, seed, np.uint64)
    lanes = np.ascontiguousarray(text[:, :8 * whole]).view("<u8").T
    if size >= 32:
        v = [first + p1 + p2, first + p2, first.copy(), first - p1]
        for at in range(0, size // 32 * 4, 4):
            v = [rotl(u + lanes[at + i] * p2, 31) * p1 for i, u in enumerate(v)]
        h = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
        for u in v:
            h = (h ^ mixed(u)) * p1 + p4
    else:
        h = first + p5
    h = h + np.uint64(size)
    for lane in lanes[size // 32 * 4:]:
        h = rotl(h ^ mixed(lane), 27) * p1 + p4
    rest = 8 * whole
    if size - rest >= 4:
        four = np.ascontiguousarray(text[:, rest:rest + 4]).view("<u4").ravel().astype(np.uint64)
        h, rest = rotl(h ^ (four * p1), 23) * p2 + p3, rest + 4
    for at in range(rest, size):
        h = rotl(h ^ (text[:, at].astype(np.uint64) * p5), 11) * p1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _scores(left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> np.ndarray:
    score = None
    for side in (left, right):
        squared = side[0] * side[0]
        for s in side[1:-1]:
            squared += s * s
        squared /= side[-1]
        score = squared if score is None else score + squared
    return score


def best_splits(node: np.ndarray, left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, score) of the best value to split at of every node.

    ``left`` and ``right`` hold what adds up on a side, weight last, for every value that a node can be
    split at; nodes lie one behind the other, their values in order.  The score of a side is the sum
    of its squared sums over its weight; the first of equally good values wins.
    """
    score = _scores(left, right)
    begins = np.flatnonzero(np.diff(node, prepend=-1))
    top = np.maximum.reduceat(score, begins) if len(begins) else score
    hit = np.flatnonzero(score == np.repeat(top, np.diff(begins, append=len(node))))
    hit = hit[np.diff(node[hit], prepend=-1) > 0]
    return hit, score[hit]


def _running(c: np.ndarray, first: np.ndarray, size: np.ndarray, whole: bool) -> np.ndarray:
    """Sums of ``c`` from the begin of each node; ``whole`` numbers are exact in one pass over all nodes."""
    if whole:
        upto = np.cumsum(c)
        return upto - np.repeat(upto[first] - c[first], size)
    # others add up node by node, nodes of like size as the rows of one matrix, so that no sum depends on another node
    out, scale = np.empty_like(c), np.ceil(np.log2(size)).astype(int)
    for b in np.unique(scale):
        for nodes in _bounded(np.nonzero(scale == b)[0], 1 << b):
            place = np.arange(size[nodes].max())
            inside = place < size[nodes][:, None]
            at = (first[nodes][:, None] + place)[inside]
            rows = np.zeros(inside.shape)
            rows[inside] = c[at]
            out[at] = np.cumsum(rows, axis=1)[inside]
    return out


def _ranked(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of every value among all different ones, and these."""
    order = np.argsort(c)
    s = c[order]
    new = np.append(True, s[1:] > s[:-1])
    codes = np.empty(len(c), np.int32)
    codes[order] = np.cumsum(new) - 1
    return codes, s[new]


def _dense(c: np.ndarray) -> np.ndarray:
    """The place of every whole number among all different ones."""
    many = int(c.max()) + 1
    if many > 4 * len(c) + 1024:
        return _ranked(c)[0]
    met = np.zeros(many, bool)
    met[c] = True
    return (np.cumsum(met) - 1).astype(np.int32)[c]


@dataclass
class Points:
    """Rows in which neighbours with equal features count as one.

    A cell (feature by point) is the place of a value among ``values`` of its feature, followed by
    ``bits`` bits that name the weights of the point's classes: ``table`` holds them for every name, and
    ``packed`` two classes in one number.  For a regression there are no such bits, and ``held`` is
    the weighted target, the weight, the least and the largest target.
    """

    cells: np.ndarray
    values: list[np.ndarray]
    bits: int = 0
    table: np.ndarray | None = None
    packed: list[np.ndarray] | None = None
    held: list[np.ndarray] | None = None


def _points(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> Points:
    at = np.append(0, np.flatnonzero((x[1:] != x[:-1]).any(axis=1)) + 1)
    merged = (lambda c: c) if len(at) == len(y) else lambda c: np.add.reduceat(c, at)
    codes, values = np.empty((x.shape[1], len(at)), np.int32), []
    for f, c in enumerate(x[at].T):
        codes[f], found = _ranked(c)
        values.append(found)
    if not classes:
        return Points(codes, values, held=[merged(y * w), merged(w), np.minimum.reduceat(y, at), np.maximum.reduceat(y, at)])
    weigh = [merged(np.where(y == k, w, 0.0)).astype(np.int64) for k in range(classes)]
    name = np.zeros(len(at), np.int64)
    for c in weigh:
        name = _dense(name * (int(c.max()) + 1) + c).astype(np.int64)
    table = np.empty((classes, int(name.max()) + 1), np.int64)
    for k, c in enumerate(weigh):
        table[k, name] = c
    packed = [table[k] + (table[k + 1] << 32 if k + 1 < classes else 0) for k in range(0, classes, 2)]
    bits = int(name.max()).bit_length()
    if max(len(v) for v in values).bit_length() + bits > 31:
        codes = codes.astype(np.int64)
    codes <<= bits
    codes |= name.astype(codes.dtype)
    return Points(codes, values, bits, table, packed)


def _unpacked(sums: Sequence[np.ndarray], classes: int) -> list[np.ndarray]:
    """Sums by class of packed sums, and of all classes."""
    out = [(s >> 32 * half if half else s & 0xFFFFFFFF).astype(float) for s in sums for half in (0, 1)][:classes]
    return [*out, sum(out[1:], out[0])]


def grow(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, path: str, seed: str | int, draw: int, classes: int, depth: int | None = None
):
    """Arrays (feature, threshold, child, value) of a tree grown to the end or to ``depth``; a leaf has feature -1.

    ``child`` is the left child, the right one follows it.  ``classes`` 0 is a regression.
    All nodes of a level are split together; weights are whole numbers.  Neighbouring rows
    with equal features, which no split parts, count as one.
    """
    return _grown(_points(x, y, w, classes), tree, path, seed, draw, classes, depth)[0]


def grow_parts(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, path: str, seed: str | int, draw: int, classes: int, part_rows: int = PART_ROWS):
    """The same tree as (path below ``path``, arrays): first its top, then subtrees of at most ``part_rows`` rows.

    In the top a node of feature -2 goes on in a subtree; ``child`` is its place in the order of their paths.
    """
    parts = []

    def aside(below: str, points: Points) -> None:
        parts.append((below, _grown(points, tree, path + below, seed, draw, classes)[0]))

    top, below = _grown(_points(x, y, w, classes), tree, path, seed, draw, classes, None, part_rows, aside)
    if below:
        feature, _, child, _ = top
        child[feature == -2] = np.argsort(np.argsort(np.array(below)))
    return [("", top), *sorted(parts, key=lambda part: part[0])]


def _grown(
    points: Points, tree: int, path: str, seed: str | int, draw: int, classes: int, depth: int | None = None, part_rows: int = 0,
    aside: Callable | None = None,
) -> tuple[tuple[np.ndarray, ...], list[str]]:
    """Arrays of the tree over points, and the paths of the nodes of feature -2 that ``aside`` was given, in their order."""
    cells, held, values, bits, packed = points.cells, points.held, points.values, points.bits, points.packed
    width, n = cells.shape
    cell_bits, name = max(len(v) for v in values).bit_length() + bits, (1 << bits) - 1
    feature, threshold, child, value, given = [], [], [], [], []
    start, size, trail, made, level = np.zeros(1, np.int64), np.array([n]), np.empty((1, 0), np.uint8), 1, 0
    if classes:
        counts = np.bincount(cells[0] & name, minlength=points.table.shape[1])
        totals = (points.table @ counts).astype(float)[:, None]
    while len(start):
        if classes:
            pure = (totals > 0).sum(axis=0) < 2
            means = (totals / sum(totals[1:], totals[0])).T
        else:
            last = start + size - 1
            total = _running(held[1], start, size, True)[last]
            pure = np.minimum.reduceat(held[2], start) == np.maximum.reduceat(held[3], start)
            means = (_running(held[0], start, size, False)[last] / total)[:, None]
        picked, cut, edge = np.full(len(start), -1), np.zeros(len(start)), np.zeros(len(start), np.int64)
        going = ~pure & (size > 1)
        if aside is not None and level:
            # small nodes beside large ones stay
            for i in np.flatnonzero(going & (size <= part_rows) & (size > part_rows // 16)):
                rows, picked[i], going[i] = slice(start[i], start[i] + size[i]), -2, False
                given.append(trail[i].tobytes().decode())
                below = held and [c[rows] for c in held]
                aside(given[-1], replace(points, cells=np.ascontiguousarray(cells[:, rows]), held=below))
        todo = np.flatnonzero(going) if level != depth else []
        if len(todo):
            drawn = _feature_orders(seed, tree, path, trail[todo], width)
            best, met, flat = np.full(len(todo), -np.inf), np.zeros(len(todo), int), cells.ravel()
            lefts = np.zeros((classes, len(start)))
            for i in np.flatnonzero(size[todo] > ALONE_ROWS):
                t, met[i] = todo[i], draw
                rows = slice(start[t], start[t] + size[t])
                for f in _alone(points, cells[:, rows], held and [c[rows] for c in held[:2]], drawn[i], draw, classes):
                    if f[0] > best[i]:
                        best[i], picked[t], edge[t], cut[t], lefts[:, t] = f
            for r in range(width):
                ask = np.flatnonzero(met < draw)
                if not len(ask):
                    break
                here, f = todo[ask], drawn[ask, r]
                k = size[here]
                end = np.cumsum(k)
                first = end - k
                node = np.repeat(np.arange(len(ask)), k)
                place = np.arange(len(node))
                cell = flat[place + np.repeat(start[here] - first + f * n, k)]
                if classes:
                    cell = _sorted_cells(node, cell, cell_bits)
                    added = [np.cumsum(p[cell & name]) for p in packed]
                else:
                    rows = place + np.repeat(start[here] - first, k)
                    order, cell = _by_value(node, cell, cell_bits)
                    rows = rows[order]
                    added = [_running(c[rows], first, k, i > 0) for i, c in enumerate(held[:2])]
                code = cell >> bits
                higher = np.empty(len(code), bool)
                np.not_equal(code[1:], code[:-1], out=higher[:-1])
                higher[end - 1] = False
                at = np.flatnonzero(higher)
                node = node[at]
                if classes:
                    begun = [np.append(0, c[end[:-1] - 1]) for c in added]
                    whole = [c[end - 1] for c in added]
                    left = _unpacked([c[at] - b[node] for c, b in zip(added, begun)], classes)
                    right = _unpacked([c[node] - added[i][at] for i, c in enumerate(whole)], classes)
                else:
                    left = [c[at] for c in added]
                    right = [c[end - 1][node] - part for c, part in zip(added, left)]
                hit, score = best_splits(node, left, right)
                found = node[hit]
                met[ask[found]] += 1
                better = score > best[ask[found]]
                found, hit = found[better], hit[better]
                won, at = todo[ask[found]], at[hit]
                best[ask[found]], picked[won] = score[better], f[found]
                edge[won] = code[at]
                for i in range(classes):
                    lefts[i, won] = left[i][hit]
                for g in range(width):
                    mine = f[found] == g
                    a, b = values[g][code[at[mine]]], values[g][code[at[mine] + 1]]
                    middle = a / 2 + b / 2
                    cut[won[mine]] = np.where(middle >= b, a, middle)
        split = np.flatnonzero(picked >= 0)
        below = np.zeros(len(start), np.int64)
        below[split] = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        for out, part in zip((feature, threshold, child, value), (picked, cut, below, means)):
            out.append(part)
        if not len(split):
            break
        if classes:
            totals = np.stack([lefts[:, split], totals[:, split] - lefts[:, split]], axis=2).reshape(classes, -1)
        # the rows of a split node stay in their order on either side
        top = (edge[split] << bits) | name
        many, alone, masks = np.zeros(len(split), np.int64), np.zeros(len(split), bool), {}
        for i in np.flatnonzero(size[split] > ALONE_ROWS):
            t = split[i]
            masks[i] = cells[picked[t], start[t]:start[t] + size[t]] <= top[i]
            many[i], alone[i] = np.count_nonzero(masks[i]), True
        rest = np.flatnonzero(~alone)
        k = size[split[rest]]
        first = np.cumsum(k) - k
        spread = lambda c: np.repeat(c, k)
        place = np.arange(k.sum())
        old = place + spread(start[split[rest]] - first)
        left = cells.ravel()[old + spread(picked[split[rest]] * n)] <= spread(top[rest])
        upto = np.cumsum(left)
        if len(rest):
            many[rest] = np.add.reduceat(left, first, dtype=np.int64)
        below = np.stack((many, size[split] - many), axis=1).ravel()
        begin = np.cumsum(below) - below
        n = int(below.sum())
        new, kept_held = np.empty((width, n), cells.dtype), held and [np.empty(n) for _ in held]
        for i, mask in masks.items():
            rows = slice(start[split[i]], start[split[i]] + size[split[i]])
            for side, kept in ((2 * i, mask), (2 * i + 1, ~mask)):
                for c, out in [*zip(cells, new), *zip(held or (), kept_held or ())]:
                    np.compress(kept, c[rows], out=out[begin[side]:begin[side] + below[side]])
        # a row's new place: behind the lefts before it in its node, or behind the rights
        before = upto - left
        shift = before[first] if len(rest) else first
        to = np.where(left, before + spread(begin[2 * rest] - shift), place - before + spread(begin[2 * rest + 1] - first + shift))
        for c, out in [*zip(cells, new), *zip(held or (), kept_held or ())]:
            out[to] = c[old]
        cells, held, size, start = new, kept_held, below, begin
        trail = np.concatenate([np.repeat(trail[split], 2, axis=0), np.tile(np.frombuffer(b"01", np.uint8), len(split))[:, None]], axis=1)
        level += 1
    parts = zip((feature, threshold, child, value), ("<i4", "<f8", "<i4", "<f8"))
    return tuple(np.concatenate(p).astype(t) for p, t in parts), given


def _alone(points: Points, cells: np.ndarray, held: list[np.ndarray] | None, drawn: Sequence[int], draw: int, classes: int) -> Iterator[tuple]:
    """(score, feature, code, threshold, counts on the left) of the best split of one node by each of its drawn features."""
    met = 0
    for f in drawn:
        if met == draw:
            return
        if classes:
            cell = np.sort(cells[f])
            code = cell >> points.bits
        else:
            order, code = _by_value(np.zeros(cells.shape[1], np.int64), cells[f], len(points.values[f]).bit_length())
        at = np.flatnonzero(code[1:] != code[:-1])
        if not len(at):
            continue
        met += 1
        if classes:
            added = [np.cumsum(p[cell & ((1 << points.bits) - 1)]) for p in points.packed]
            left, right = (_unpacked(c, classes) for c in ([c[at] for c in added], [c[-1] - c[at] for c in added]))
        else:
            added = [np.cumsum(c[order]) for c in held]
            left, right = [c[at] for c in added], [c[-1] - c[at] for c in added]
        score = _scores(left, right)
        hit = int(score.argmax())
        a, b = points.values[f][code[at[hit]]], points.values[f][code[at[hit] + 1]]
        middle = a / 2 + b / 2
        yield score[hit], f, code[at[hit]], a if middle >= b else middle, [c[hit] for c in left[:classes]]


def _sorted_cells(node: np.ndarray, cell: np.ndarray, cell_bits: int) -> np.ndarray:
    """Cells in their order within every node."""
    if (int(node[-1]) if len(node) else 0).bit_length() + cell_bits > 63:
        return cell[np.lexsort((cell, node))]
    key = (node << cell_bits) | cell
    key.sort()
    key &= (1 << cell_bits) - 1
    return key


def _by_value(node: np.ndarray, code: np.ndarray, code_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by node, code and place, and the codes in that order."""
    bits = len(node).bit_length()
    if (int(node[-1]) if len(node) else 0).bit_length() + code_bits + bits > 63:
        order = np.lexsort((code, node))
        return order, code[order]
    key = (node << code_bits) | code
    key <<= bits
    key |= np.arange(len(node))
    key.sort()
    return key & ((1 << bits) - 1), (key >> bits) & ((1 << code_bits) - 1)


def _bounded(nodes: np.ndarray, width: int):
    """``nodes`` in runs whose matrix stays within MATRIX_CELLS."""
    step = MATRIX_CELLS // width if width <= WIDE_NODE else 1
    return (nodes[i:i + step] for i in range(0, len(nodes), step))


def _top_splits(rows: DataFrame, stats: DataFrame, width: int, seed: str | int, draw: int, classes: int) -> DataFrame:
    """(tree, path, feature, threshold) of the nodes of ``stats``, from all their rows."""
    node = ["tree", "path"]
    names = [f"c{k}" for k in range(classes or 1)] + ["cw"]
    drawn = F.array(*[F.when(F.col(f"lo{f}") < F.col(f"hi{f}"), F.struct(_rank_column(seed, f).alias("key"), F.lit(f).alias("f"))) for f in range(width)])
    drawn = F.slice(F.array_sort(F.filter(drawn, lambda s: s.isNotNull())), 1, draw)
    asked = stats.select(*node, F.posexplode(drawn).alias("rank", "s")).select(*node, "rank", "s.f")
    lists = asked.groupBy(*node).agg(F.collect_list(F.struct("rank", "f")).alias("fs"))
    cells = attach(rows, lists, node).withColumn("s", F.explode("fs")).withColumn("v", F.element_at("x", F.col("s.f") + 1))
    terms = [F.sum(F.when(F.col("y") == F.lit(float(k)), F.col("w")).otherwise(0)) for k in range(classes)] if classes else [F.sum(F.col("y") * F.col("w"))]
    counted = cells.groupBy(*node, "s.f", "s.rank", "v").agg(*[t.cast("double").alias(c) for t, c in zip([*terms, F.sum("w")], names)])
    counted = cut_lineage(counted)
    sums = running_total(counted, [*node, "f"], ["v"], names, exclusive=False)
    totals = counted.filter("rank = 0").groupBy(*node).agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    sums = attach(sums, totals, node)
    left = {c: F.col(f"before_{c}") for c in names}
    right = {c: F.col(f"all_{c}") - left[c] for c in names}
    squared = lambda side: sum((side[c] * side[c] for c in names[1:-1]), side[names[0]] * side[names[0]]) / side["cw"]
    open_ = sums.filter(right["cw"] > 0).withColumn("score", squared(left) + squared(right))
    best = cut_lineage(open_.groupBy(*node).agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "v", "f")).alias("b")).select(*node, "b.f", "b.v"))
    beyond = attach(counted.select(*node, "f", F.col("v").alias("u")), best, [*node, "f"]).filter("u > v")
    nearest = beyond.groupBy(*node, "f", "v").agg(F.min("u").alias("u"))
    middle = F.col("v") / F.lit(2.0) + F.col("u") / F.lit(2.0)
    return nearest.select(*node, F.col("f").alias("feature"), F.when(middle >= F.col("u"), F.col("v")).otherwise(middle).alias("threshold"))


def fit_forest(
    train: DataFrame, width: int, keys: Sequence[str], label: str = "label", features: str = "features", classes: int = 2,
    trees: int = TREES, seed: str | int = 42, draw: int | None = None, local_rows: int = LOCAL_ROWS,
) -> DeepForest:
    """Forest of ``trees`` uncapped trees; ``classes`` 0 is a regression.

    ``draw`` features with more than one value are tried per node: the square root of all
    for classes, all for a regression.  Labels are 0 to classes - 1.
    """
    draw = draw or (max(1, int(np.sqrt(width))) if classes else width)
    base = stage(train.select(*keys, F.col(label).cast("double").alias("y"), vector_to_array(F.col(features)).alias("x")))
    n = base.count()
    if n * DRAWN <= local_rows:
        parts = _whole_trees(base, n, width, keys, classes, trees, seed, draw)
        return DeepForest(base.sparkSession.createDataFrame([], "tree int, path string, feature int, threshold double"), stage(parts), trees, classes, 0)
    rows = bag(base, keys, trees, seed).select("tree", F.lit("").alias("path"), "w", "y", "x")
    node, finished, leaves, top, levels = ["tree", "path"], [], [], [], 0
    spans = [f(F.element_at("x", i + 1)).alias(f"{n}{i}") for i in range(width) for n, f in (("lo", F.min), ("hi", F.max))]
    constant = F.lit(True)
    for i in range(width):
        constant = constant & (F.col(f"lo{i}") == F.col(f"hi{i}"))
    while True:
        stats = cut_lineage(rows.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), *spans))
        large = stats.filter(F.col("n") > local_rows)
        if large.isEmpty():
            finished.append(rows)
            break
        # the rows of large nodes are read by several jobs from here on
        rows = rows if levels else stage(rows)
        ended = (F.col("low") == F.col("high")) | constant
        finished.append(attach(rows, stats.filter(F.col("n") <= local_rows).select(*node), node))
        leaves.append(attach(rows, large.filter(ended).select(*node), node))
        todo = large.filter(~ended)
        if todo.isEmpty():
            break
        splits = cut_lineage(_top_splits(rows, todo, width, seed, draw, classes))
        top.append(splits)
        side = F.when(F.element_at("x", F.col("feature") + 1) <= F.col("threshold"), "0").otherwise("1")
        rows = stage(attach(rows, splits, node).withColumn("path", F.concat("path", side)).select("tree", "path", "w", "y", "x"))
        levels += 1

    def grown(part: pa.Table) -> pa.Table:
        tree, path = part["tree"][0].as_py(), part["path"][0].as_py()
        # a fixed order, so that sums do not depend on how rows arrived
        x, y, w = matrix(part["x"]), part["y"].to_numpy(), part["w"].to_numpy().astype(float)
        order = np.lexsort((w, y, *x.T))
        return _packed(tree, path, grow_parts(x[order], y[order], w[order], tree, path, seed, draw, classes))

    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionByName(part)
    parts = [whole.groupBy(*node).applyInArrow(grown, PART)]
    terms = [F.sum(F.when(F.col("y") == F.lit(float(k)), F.col("w")).otherwise(0)) for k in range(classes)] if classes else [F.sum(F.col("y") * F.col("w"))]
    for rest in leaves:
        single = rest.groupBy(*node).agg(F.array(*[t / F.sum("w") for t in terms]).alias("value"))
        parts.append(single.mapInPandas(_leaf, PART))
    packed = parts[0]
    for part in parts[1:]:
        packed = packed.unionByName(part)
    splits = base.sparkSession.createDataFrame([], "tree int, path string, feature int, threshold double")
    for part in top:
        splits = splits.unionByName(part)
    return DeepForest(cut_lineage(splits), stage(packed), trees, classes, levels)


def _slots(spark, n: int) -> list[int]:
    """Keys that a repartition by key into ``n`` puts into a partition each."""
    found = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    kept = {r["p"]: r["id"] for r in found}
    return [kept.get(p, 64 * n + p) for p in range(n)]


def _blob(c: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes()], pa.binary())


def _whole_trees(base: DataFrame, n: int, width: int, keys: Sequence[str], classes: int, trees: int, seed: str | int, draw: int) -> DataFrame:
    """Parts of trees that fit into a task each.

    Rows are sorted once for all trees and move as packed columns of the rows that a tree draws.
    The draws are those of ``bag``.
    """
    slots, narrow = _slots(base.sparkSession, trees), "u1" if 0 < classes <= 256 else "<f8"
    drawn = F.array(*[F.expr(f"shiftrightunsigned(xxhash64(_seed, {t}, {', '.join(f'`{k}`' for k in keys)}), 11)") for t in range(trees)])
    order = [*[F.element_at("x", i + 1) for i in reversed(range(width))], F.col("y")]
    tasks = max(base.sparkSession.sparkContext.defaultParallelism, n // PACKED_ROWS)
    ordered = base.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for rows in batches:
            if not rows.num_rows:
                continue
            x, y = matrix(pa.chunked_array([rows["x"]])), rows["y"].to_numpy().astype(narrow)
            bits = np.ascontiguousarray(matrix(pa.chunked_array([rows["u"]])).T)
            for t, slot in enumerate(slots):
                u = bits[t] * 2.0**-53
                w = np.zeros(len(u), np.uint8)
                for p in POISSON:
                    w += u >= p
                kept = np.flatnonzero(w)
                if len(kept):
                    cells = [_blob(np.ascontiguousarray(x[kept].T)), _blob(y[kept]), _blob(w[kept])]
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([t], pa.int32()), pa.array([at], pa.int64()), *cells], ["slot", "tree", "at", "x", "y", "w"])
            at += 1

    def grown(part: pa.Table) -> pa.Table:
        tree = part["tree"][0].as_py()
        part = part.take(pc.sort_indices(part["at"]))
        x = np.concatenate([np.frombuffer(c.as_py(), "<f8").reshape(width, -1) for c in part["x"]], axis=1).T
        y, w = (np.concatenate([np.frombuffer(c.as_py(), t) for c in part[n]]).astype(float) for n, t in (("y", narrow), ("w", "u1")))
        if not classes:
            # rows of equal features and target in the order of their draws
            same = np.append(0, np.cumsum((x[1:] != x[:-1]).any(axis=1) | (y[1:] != y[:-1])))
            if same[-1] + 1 < len(same):
                w = w[np.lexsort((w, same))]
        return _packed(tree, "", grow_parts(x, y, w, tree, "", seed, draw, classes))

    blocks = ordered.withColumn("_seed", F.lit(str(seed))).select("x", "y", drawn.alias("u"))
    blocks = blocks.mapInArrow(packed, "slot long, tree int, at long, x binary, y binary, w binary")
    return blocks.repartition(trees, "slot").groupBy("slot").applyInArrow(grown, PART)


def fit_merged(
    points: DataFrame, width: int, classes: int, trees: int = TREES, seed: str | int = 42, draw: int | None = None, depth: int | None = None,
) -> DeepForest:
    """Forest over rows that were merged to (x, y, n): equal rows come as one point with their number.

    The Poisson draws of mean one of n equal rows add up to a Poisson draw of mean n, so a
    point is drawn once per tree.  Each task grows whole trees: the points must fit into it.
    """
    draw = draw or (max(1, int(np.sqrt(width))) if classes else width)

    def grown(part: pa.Table) -> pa.Table:
        tree, x, y = part["tree"][0].as_py(), matrix(part["x"]), part["y"].to_numpy()
        # a fixed order, so that draws and sums do not depend on how points arrived
        order = np.lexsort((y, *x.T))
        w = np.random.default_rng([*f"{seed}|{tree}".encode()]).poisson(part["n"].to_numpy()[order]).astype(float)
        x, y, w = x[order][w > 0], y[order][w > 0], w[w > 0]
        if not len(w):
            return _packed(tree, "", [])
        return _packed(tree, "", [("", grow(x, y, w, tree, "", seed, draw, classes, depth))])

    spark = points.sparkSession
    each = points.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "x", "y", "n")
    splits = spark.createDataFrame([], "tree int, path string, feature int, threshold double")
    return DeepForest(splits, stage(each.groupBy("tree").applyInArrow(grown, PART)), trees, classes, 0)


def _packed(tree: int, path: str, parts: Sequence[tuple[str, Sequence[np.ndarray]]]) -> pa.Table:
    """A finished node as one row for its top and one for every subtree."""
    cells = [pa.array([a[i].tobytes() for _, a in parts], pa.binary()) for i in range(len(PACKED))]
    row = [pa.array([tree] * len(parts), pa.int32()), pa.array([path] * len(parts), pa.string()), pa.array([sub for sub, _ in parts], pa.string()), *cells]
    return pa.table(row, names=[c.split()[0] for c in PART.split(", ")])


def _leaf(batches):
    """A part that is one leaf."""
    one = (np.array([-1], "<i4").tobytes(), np.zeros(1, "<f8").tobytes(), np.zeros(1, "<i4").tobytes())
    for pdf in batches:
        value = [np.asarray(v, "<f8").tobytes() for v in pdf["value"]]
        yield pd.DataFrame({"tree": pdf["tree"], "path": pdf["path"], "sub": "", "feature": one[0], "threshold": one[1], "child": one[2], "value": value})


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column of one length."""
    values = pc.list_flatten(column).to_numpy()
    return values.reshape(len(column), -1)


def walk(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Leaf of every row, all rows one level at a time."""
    at = np.zeros(len(x), np.int64)
    going = np.nonzero(feature[at] >= 0)[0]
    while len(going):
        here = at[going]
        at[going] = child[here] + (x[going, feature[here]] > threshold[here])
        going = going[feature[at[going]] >= 0]
    return at


def leaf_values(x: np.ndarray, part: pa.Table, outputs: int) -> np.ndarray:
    """What the leaves of a part hold, row by row; its rows are the part's top and subtrees."""
    part = part.take(pc.sort_indices(part["sub"]))
    cell = lambda i, c: np.frombuffer(part[c][i].as_py(), PACKED[c])
    feature, threshold, child = (cell(0, c) for c in ("feature", "threshold", "child"))
    at = walk(x, feature, threshold, child)
    out = cell(0, "value").reshape(-1, outputs)[at]
    # the rows of every subtree, one after the other
    below = np.flatnonzero(feature[at] == -2)
    sub = child[at[below]]
    below = below[np.argsort(sub, kind="stable")]
    ends = np.cumsum(np.bincount(sub, minlength=len(part) - 1))
    for i, (begin, end) in enumerate(zip(np.append(0, ends), ends)):
        if begin < end:
            rows = below[begin:end]
            found = walk(x[rows], *(cell(i + 1, c) for c in ("feature", "threshold", "child")))
            out[rows] = cell(i + 1, "value").reshape(-1, outputs)[found]
    return out


def score_forest(df: DataFrame, forest: DeepForest, features: str = "features", scored_rows: int = SCORED_ROWS) -> DataFrame:
    """Adds ``prediction`` and, for classes, ``prob``: the mean over all trees; the smallest class wins a tie."""
    named = stage(df.withColumn("_row", F.monotonically_increasing_id()))
    rows = named.select("_row", vector_to_array(F.col(features)).alias("x"))
    means = _routed_means(rows, forest, scored_rows) if forest.levels else _block_means(rows, forest, scored_rows)
    out = named.join(means, "_row").drop("_row")
    if not forest.classes:
        return out.withColumn("prediction", F.col("prob")[0]).drop("prob")
    return out.withColumn("prediction", (F.array_position("prob", F.array_max("prob")) - 1).cast("double"))


def _block_means(rows: DataFrame, forest: DeepForest, scored_rows: int) -> DataFrame:
    """(_row, prob) of trees that are one part each: blocks of rows meet whole trees, blocks of values add up."""
    trees, outputs = forest.trees, forest.classes or 1
    shares = max(1, -(-rows.count() // scored_rows))
    slots = _slots(rows.sparkSession, trees * shares)
    slot = lambda tree, share: F.element_at(F.array(*map(F.lit, slots)), (tree * F.lit(shares) + share + F.lit(1)).cast("int"))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for begin in range(0, part.num_rows, scored_rows):
                some = part.slice(begin, scored_rows)
                cells = [_blob(some["_row"].to_numpy()), _blob(matrix(pa.chunked_array([some["x"]])))]
                yield pa.RecordBatch.from_arrays([some["_row"].slice(0, 1), *cells], ["block", "rows", "x"])

    def meet(asked: pa.Table, part: pa.Table) -> pa.Table:
        if not len(asked) or not len(part):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())], names=["block", "tree", "rows", "found"])
        size = [len(r.as_py()) // 8 for r in asked["rows"]]
        x = np.concatenate([np.frombuffer(c.as_py(), "<f8") for c in asked["x"]]).reshape(sum(size), -1)
        found = np.split(leaf_values(x, part, outputs), np.cumsum(size)[:-1])
        found = pa.array([v.tobytes() for v in found], pa.binary())
        return pa.table([asked["block"], asked["tree"], asked["rows"], found], names=["block", "tree", "rows", "found"])

    def mean(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part["tree"]))
        total = sum(np.frombuffer(v.as_py(), "<f8") for v in part["found"]) / len(part)
        ends = pa.array(np.arange(0, len(total) + 1, outputs), pa.int32())
        return pa.table([pa.array(np.frombuffer(part["rows"][0].as_py(), "<i8")), pa.ListArray.from_arrays(ends, pa.array(total))], names=["_row", "prob"])

    blocks = stage(rows.mapInArrow(blocked, "block long, rows binary, x binary"))
    left = blocks.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    left = left.withColumn("slot", slot(F.col("tree"), F.pmod(F.hash("block"), F.lit(shares))))
    right = forest.parts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = right.select(slot(F.col("tree"), F.col("share")).alias("s"), "sub", *PACKED)
    sides = [side.repartition(len(slots), key).groupBy(key) for side, key in ((left, "slot"), (right, "s"))]
    met = sides[0].cogroup(sides[1]).applyInArrow(meet, "block long, tree int, rows binary, found binary")
    return met.groupBy("block").applyInArrow(mean, "_row long, prob array<double>")


def _routed_means(rows: DataFrame, forest: DeepForest, scored_rows: int) -> DataFrame:
    """(_row, prob) of trees with splits above their parts: every row is sent to the parts it falls into."""
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))))
    rows = rows.withColumn("path", F.lit(""))
    for _ in range(forest.levels):
        side = F.when(F.element_at("x", F.col("feature") + 1) <= F.col("threshold"), "0").when(F.col("feature").isNotNull(), "1").otherwise("")
        rows = stage(attach(rows, forest.top, ["tree", "path"], how="left").withColumn("path", F.concat("path", side)).drop("feature", "threshold"))
    counts = rows.groupBy("tree", "path").agg(F.ceil(F.count(F.lit(1)) / F.lit(scored_rows)).cast("int").alias("shares"))
    counts = cut_lineage(counts)
    left = attach(rows, counts, ["tree", "path"]).withColumn("share", F.pmod(F.xxhash64("_row"), F.col("shares")).cast("int"))
    right = forest.parts.join(counts, ["tree", "path"]).withColumn("share", F.explode(F.expr("sequence(0, shares - 1)")))
    right = right.select(F.col("tree").alias("t"), F.col("path").alias("p"), F.col("share").alias("s"), "sub", *PACKED)

    def meet(asked: pa.Table, part: pa.Table) -> pa.Table:
        rows, found = [], np.empty((0, outputs))
        if len(asked) and len(part):
            rows, found = asked["_row"].to_numpy(), leaf_values(matrix(asked["x"]), part, outputs)
        return pa.table([pa.array(rows, pa.int64()), *[pa.array(found[:, k], pa.float64()) for k in range(outputs)]], names=["_row", *names])

    outputs = forest.classes or 1
    names = [f"v{k}" for k in range(outputs)]
    fields = ", ".join(["_row long", *[f"{c} double" for c in names]])
    met = left.groupBy("tree", "path", "share").cogroup(right.groupBy("t", "p", "s")).applyInArrow(meet, fields)
    means = [F.avg(c) for c in names]
    return met.groupBy("_row").agg(F.array(*means).alias("prob"))
