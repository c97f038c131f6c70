"""Mondrian k-anonymity as level-synchronous Spark jobs, all k of a sweep at once.

The split axis and the cut of a node never depend on k; k only decides where a
branch stops.  So one tree is built for the smallest k and a row's class at a
larger k is the first node on its path that fails the size tests at that k.

A level runs two aggregates over the rows (cuts, then child statistics).  Only
the node table is kept between levels: it is small, is checkpointed, and is
broadcast when its counted size allows, so rows are never shuffled or rewritten
while the top of the tree is built.  A node with few rows is finished inside
one task; nothing larger than ``local_rows`` ever meets in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.scalars import col
from hushframe.operators import ranks
from hushframe.operators.joins import BROADCAST_ROWS, attach
from hushframe.session import cut_lineage, stage

# A node with at most this many rows is finished inside one task.
LOCAL_ROWS = 400_000
# Up to this many nodes of one level are held as a local relation between jobs.
DRIVER_NODES = 10_000
# Lookups chained in one stage before the rows are written again: keeps generated code small.
RESTAGE_LEVELS = 8


def class_column(k: int) -> str:
    return f"pid_{k}"


def finite(c: str) -> Column:
    """The value as double; NaN and infinities are missing values, on every path."""
    v = col(c).cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def _value(i: int) -> str:
    return f"_q{i}"


def _pick_axis(rule: str, seed: str | int, is_text: Sequence[bool], ranges: Sequence[float]) -> Column:
    """Index of the split column of a node from its statistics, null for a leaf."""
    d = len(is_text)
    if rule == "widest":
        spans = [
            F.coalesce((F.col(f"hi{i}") - F.col(f"lo{i}")) / F.lit(ranges[i]), F.lit(0.0)) if ranges[i] > 0 else F.lit(0.0)
            for i in range(d)
        ]
        # strict comparison: the first listed column wins a tie
        axis, best = F.lit(None).cast("int"), F.lit(0.0)
        for i in range(d):
            axis = F.when(spans[i] > best, F.lit(i)).otherwise(axis)
            best = F.greatest(best, spans[i])
        return axis
    drawn = []
    for i in range(d):
        varied = F.col(f"lo{i}") < F.col(f"hi{i}")
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("path"), F.lit(str(i))))
        drawn.append(F.when(varied, F.struct(digest.alias("h"), F.lit(i).alias("i"))))
    pick = F.array_min(F.array_compact(F.array(*drawn)))["i"]
    text = [i for i, t in enumerate(is_text) if t]
    return F.when(pick.isin(text), F.lit(None).cast("int")).otherwise(pick) if text else pick


def _stats(d: int) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n")]
    for i in range(d):
        out += [F.min(_value(i)).alias(f"lo{i}"), F.max(_value(i)).alias(f"hi{i}")]
    return out


def _half_stats(d: int, bit: int) -> list[Column]:
    """The same statistics of one side of a split."""
    side = "right" if bit else "left"
    on_side = F.col("bit") == bit
    out = [F.count_if(on_side).alias(f"{side}_n")]
    for i in range(d):
        v = F.when(on_side, F.col(_value(i)))
        out += [F.min(v).alias(f"{side}_lo{i}"), F.max(v).alias(f"{side}_hi{i}")]
    return out


def _child_columns(d: int, side: str, bit: str) -> list[Column]:
    return [
        F.concat("path", F.lit(bit)).alias("path"),
        F.col(f"{side}_n").alias("n"),
        *[F.col(f"{side}_{b}{i}").alias(f"{b}{i}") for i in range(d) for b in ("lo", "hi")],
    ]


def _keep(nodes: DataFrame, few: bool) -> tuple[DataFrame, pa.Table | None]:
    """Materialise a node table: a few nodes as a local relation, many on shared storage."""
    if not few:
        return cut_lineage(nodes), None
    cells = nodes.toArrow()
    return nodes.sparkSession.createDataFrame(cells, nodes.schema), cells


def _open_children(halves: pa.Table, kmin: int, local_rows: int) -> dict[str, int]:
    """Number and largest size of the children of passing nodes that are still to be split."""
    left, right = halves["left_n"].to_numpy(), halves["right_n"].to_numpy()
    passed = (left + right >= 2 * kmin) & (np.minimum(left, right) >= kmin)
    sizes = np.concatenate([left[passed], right[passed]])
    sizes = sizes[sizes > local_rows]
    return {"nodes": len(sizes), "largest": int(sizes.max(initial=0))}


def _axis_value(is_text: Sequence[bool]) -> Column:
    """The row's value on its node's split axis."""
    out = F.lit(None).cast("double")
    for i, text in enumerate(is_text):
        if not text:
            out = F.when(F.col("axis") == i, F.col(_value(i))).otherwise(out)
    return out


def _join_nodes(rows: DataFrame, nodes: DataFrame, how: str, small: bool) -> DataFrame:
    """Rows with their node's decision: broadcast when counted small, else shuffled."""
    if small:
        return rows.join(F.broadcast(nodes), "path", how)
    return rows.join(nodes, "path", how)


def _finish_locally(
    rows: DataFrame, ks: Sequence[int], is_text: Sequence[bool], ranges: Sequence[float], rule: str, seed: str | int
) -> DataFrame:
    """Complete the recursion for nodes that fit in one task."""
    d, kmin = len(is_text), min(ks)
    names = [class_column(k) for k in ks]

    def axis_of(path: str, vals: list[np.ndarray], idx: np.ndarray) -> int | None:
        varied: list[tuple[object, int]] = []
        best, axis = 0.0, None
        for i in range(d):
            v = vals[i][idx]
            v = v[~pd.isnull(v)]
            if len(v) == 0:
                continue
            lo, hi = v.min(), v.max()
            if rule == "widest":
                span = (hi - lo) / ranges[i] if ranges[i] > 0 else 0.0
                if span > best:
                    best, axis = span, i
            elif lo < hi:
                varied.append((hashlib.md5(f"{seed}|{path}|{i}".encode()).hexdigest(), i))
        if rule == "random" and varied:
            axis = min(varied)[1]
        return None if axis is None or is_text[axis] else axis

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        vals = [pdf[_value(i)].to_numpy() for i in range(d)]
        done = {c: pdf[c].to_numpy(dtype=object, copy=True) for c in names}
        todo = [(pdf["path"].iloc[0], np.arange(len(pdf)), tuple(k for k in ks if pd.isnull(done[class_column(k)][0])))]
        while todo:
            path, idx, open_ks = todo.pop()
            left = right = idx[:0]
            axis = axis_of(path, vals, idx) if len(idx) >= 2 * kmin else None
            if axis is not None:
                v = vals[axis][idx]
                goes_right = v > np.nanmedian(v)
                left, right = idx[~goes_right], idx[goes_right]
            side = min(len(left), len(right))
            passed = tuple(k for k in open_ks if len(idx) >= 2 * k and side >= k)
            for k in open_ks:
                if k not in passed:
                    done[class_column(k)][idx] = path
            if passed:
                todo += [(path + "0", left, passed), (path + "1", right, passed)]
        return pdf.assign(**done)

    return rows.groupBy("path").applyInPandas(finish, rows.schema)


def mondrian_sweep(
    df: DataFrame,
    qi: Sequence[str],
    ks: Sequence[int],
    categorical: Sequence[str] = (),
    rule: str = "widest",
    seed: str | int = 42,
    local_rows: int | None = None,
    exact_rows: int = ranks.EXACT_ROWS,
) -> DataFrame:
    """``df`` plus one class column ``pid_<k>`` per k: the root-to-leaf bit path.

    ``rule='widest'`` splits the column with the widest normalised span,
    ``rule='random'`` a seeded random one among those with more than one value
    (a categorical pick makes the node a leaf).  The cut is the interpolated
    median, ``<=`` goes left, and so do nulls: every row lands in a class and is
    generalized.  NaN and infinite values count as null.  A node of up to ``local_rows`` rows is finished by one task; by
    default LOCAL_ROWS, and never more than half the table.  Raises when the table has fewer rows than the largest k.
    """
    if rule not in ("widest", "random"):
        raise ValueError(f"Unknown split rule: {rule}")
    qi, ks = list(qi), sorted(set(ks))
    is_text = [c in set(categorical) for c in qi]
    if rule == "widest" and any(is_text):
        raise ValueError("the widest-span rule needs numeric quasi-identifiers")
    if not ks or ks[0] < 1:
        raise ValueError("k must be at least 1")
    kmin, d, names = ks[0], len(qi), [class_column(k) for k in ks]
    # the caller's columns travel under names of their own, whatever they are called
    given = df.columns
    df = df.toDF(*[f"_in{i}" for i in range(len(given))])
    source = {c: f"_in{i}" for i, c in enumerate(given)}
    values = [
        (col(source[c]).cast("string") if is_text[i] else finite(source[c])).alias(_value(i)) for i, c in enumerate(qi)
    ]
    # every row is numbered once; all that follows reads and moves only its number and the quasi-identifiers
    whole = stage(df.withColumn("_row", F.monotonically_increasing_id()))
    rows = whole.select("_row", *values, F.lit("").alias("path"))
    root = rows.agg(*_stats(d)).toArrow()
    top = root.to_pylist()[0]
    if top["n"] < ks[-1]:
        raise ValueError(f"{top['n']} rows cannot be made {ks[-1]}-anonymous")
    if local_rows is None:
        local_rows = min(LOCAL_ROWS, top["n"] // 2)
    ranges = [
        0.0 if is_text[i] or top[f"lo{i}"] is None else float(top[f"hi{i}"] - top[f"lo{i}"]) for i in range(d)
    ]
    # expressions are the same on every level, so they are built once
    axis = F.when(F.col("n") >= 2 * kmin, _pick_axis(rule, seed, is_text, ranges)).alias("axis")
    is_big = F.col("n") > local_rows
    passes = {k: (F.col("n") >= 2 * k) & (F.col("side") >= k) for k in ks}
    goes_right = F.coalesce(_axis_value(is_text) > F.col("cut"), F.lit(False)).cast("int")
    next_path = F.when(F.col("axis").isNotNull(), F.concat("path", goes_right.cast("string"))).otherwise(F.col("path"))
    moved = ["_row", *[F.col(_value(i)) for i in range(d)], next_path.alias("path")]
    # a node keeps the class of every k that stopped above it
    frozen = [F.coalesce(F.col(c), F.when(~passes[k], F.col("path"))).alias(c) for k, c in zip(ks, names)]
    all_here = [F.coalesce(c, "path").alias(c) for c in names]
    half_stats = [*_half_stats(d, 0), *_half_stats(d, 1)]
    one_side = {side: _child_columns(d, side, bit) for side, bit in (("left", "0"), ("right", "1"))}
    axis_value = _axis_value(is_text)
    cut = F.percentile("v", F.lit(0.5)).alias("cut")

    top_row = df.sparkSession.createDataFrame(root.append_column("path", pa.array([""]))).select(
        "*", *[F.lit(None).cast("string").alias(c) for c in names]
    )
    nodes = top_row.filter(is_big).select("path", "n", axis, *names)
    ended = [top_row.filter(~is_big).select("path", *names)]
    size = {"nodes": int(top["n"] > local_rows), "largest": top["n"]}
    total, level = 1, 0
    while size["nodes"] > 0:
        few, small = size["nodes"] <= DRIVER_NODES, size["nodes"] <= BROADCAST_ROWS
        to_split = nodes.filter(F.col("axis").isNotNull())
        on_axis = _join_nodes(rows, to_split, "inner", small).withColumn("v", axis_value)
        if size["largest"] <= exact_rows:
            cuts = on_axis.groupBy("path", "n", "axis", *names).agg(cut)
        else:
            medians = ranks.median_by(on_axis.select("path", "v"), ["path"], exact_rows=exact_rows)
            cuts = to_split.join(medians.withColumnRenamed("median", "cut"), "path")
        cuts, _ = _keep(cuts, few)
        # both children's statistics in one row: the size test here, the nodes of the next level
        split = _join_nodes(rows, cuts, "inner", small).withColumn("bit", goes_right)
        halves, cells = _keep(split.groupBy("path", "n", "axis", "cut", *names).agg(*half_stats), few)
        halves = halves.withColumn("side", F.least("left_n", "right_n"))
        passed = halves.filter(passes[kmin])
        rows = _join_nodes(rows, passed.select("path", "axis", "cut"), "left", small).select(*moved)
        level += 1
        if not small or level % RESTAGE_LEVELS == 0:
            rows = stage(rows)
        grown = passed.select(*[c for c in passed.columns if c not in names], *frozen)
        children = grown.select(*one_side["left"], *names).unionByName(grown.select(*one_side["right"], *names))
        ended += [
            nodes.filter(F.col("axis").isNull()).select("path", *all_here),
            halves.filter(~passes[kmin]).select("path", *all_here),
            children.filter(~is_big).select("path", *names),
        ]
        nodes = children.filter(is_big).select("path", "n", axis, *names)
        total += 2 * size["nodes"]
        if few:
            size = _open_children(cells, kmin, local_rows)
        else:
            size = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.max("n").alias("largest")).first()
    # the path reached so far decides the class of every k that has stopped
    reached = ended[0]
    for part in ended[1:]:
        reached = reached.unionByName(part)
    reached, _ = _keep(reached, total <= DRIVER_NODES)
    rows = _join_nodes(rows, reached, "inner", total <= BROADCAST_ROWS)
    open_rows = F.col(class_column(kmin)).isNull()
    finished = _finish_locally(rows.filter(open_rows), ks, is_text, ranges, rule, seed)
    classes = rows.filter(~open_rows).select("_row", *names).unionByName(finished.select("_row", *names))
    return attach(whole, classes, ["_row"]).select(*[col(source[c]).alias(c) for c in given], *names)


def mondrian(df: DataFrame, qi: Sequence[str], k: int, **options: object) -> DataFrame:
    """``df`` plus ``pid``, the class of each row at one k."""
    return mondrian_sweep(df, qi, [k], **options).withColumnRenamed(class_column(k), "pid")


def class_means(df: DataFrame, cols: Sequence[str], pid: str = "pid") -> DataFrame:
    return df.groupBy(pid).agg(
        *[F.avg(finite(c)).alias(f"_m{i}") for i, c in enumerate(cols)],
        F.count(F.lit(1)).alias("_n"),
    )


def generalize_mean(df: DataFrame, cols: Sequence[str], pid: str = "pid") -> DataFrame:
    """Replace numeric columns by their class mean (as double)."""
    cols = list(cols)
    out = attach(df, class_means(df, cols, pid), [pid], weight="_n")
    kept = [F.col(f"_m{cols.index(c)}").alias(c) if c in cols else col(c) for c in df.columns]
    return out.select(*kept)


def generalize_mode(df: DataFrame, cols: Sequence[str], pid: str = "pid") -> DataFrame:
    """Replace categorical columns by their class mode; ties go to the smallest value.

    Counts per (class, value) are merged before the winner is chosen, so neither
    a large class nor many distinct values gather in one task.
    """
    out = df
    for c in cols:
        counts = df.filter(col(c).isNotNull()).groupBy(pid, col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        modes = counts.groupBy(pid).agg(
            F.min(F.struct((-F.col("_c")).alias("c"), F.col("_v").alias("v"))).alias("_best"), F.sum("_c").alias("_n")
        )
        out = attach(out, modes, [pid], how="left", weight="_n")
        out = out.select(*[F.col("_best.v").alias(c) if x == c else col(x) for x in df.columns])
    return out


def partition_summary(df: DataFrame, pid: str = "pid") -> DataFrame:
    """Number of classes, smallest and mean class size."""
    sizes = df.groupBy(pid).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_partitions"), F.min("n").alias("min_size"), F.avg("n").alias("mean_size")
    )


def column_cardinality(df: DataFrame, cols: Sequence[str], pid: str = "pid") -> DataFrame:
    """Distinct non-null values per column and class, in long form.

    Duplicates collapse map-side on (class, column, value) before counting.
    """
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols])
    )
    seen = df.select(pid, cells.alias("c")).select(pid, "c.column", "c.value").distinct()
    return seen.groupBy(pid, "column").agg(F.count("value").alias("n_distinct"))
