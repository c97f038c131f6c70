"""Exact order statistics, running totals and smallest-m selection without a global sort.

None of these put a whole group into one task.  Groups that may hold a large
share of the table are cut by value brackets, by hash buckets or by range
partitions first; only a bounded remainder is ordered inside one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hushframe.operators.joins import attach
from hushframe.session import cut_lineage, stage

# Rows (or distinct values) of one group that a single task may order.
EXACT_ROWS = 1_000_000
# Quantile grid of one narrowing pass; each pass keeps about 3/GRID of a group.
GRID = 256
# Hash buckets of one round of smallest-m selection, and the rows that one task may rank.
BUCKETS = 1 << 12
EDGE_ROWS = 50_000


def _pick_in_bracket(values: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Value at ``rank`` for brackets whose inside is small enough to order."""
    keys = by + ["rank"]
    inside = (
        attach(values, brackets, by)
        .filter((F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))
        .groupBy(*keys, "below", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    upto = F.sum("c").over(W.partitionBy(*keys).orderBy("v"))
    return (
        inside.withColumn("upto", F.col("below") + upto)
        .filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        .select(*keys, "v")
    )


def _narrow(values: DataFrame, brackets: DataFrame, by: list[str], grid: int) -> DataFrame:
    """One narrowing pass: sketch a bracket around each rank, then count it exactly."""
    keys = by + ["rank"]
    inside = attach(values, brackets, by).filter(
        (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    )
    points = [i / grid for i in range(grid + 1)]
    sketch = inside.groupBy(*keys).agg(F.percentile_approx("v", points, 8 * grid).alias("q"))
    at = F.floor((F.col("rank") - F.col("below")) * F.lit(grid) / F.col("inside")).cast("int")
    cuts = cut_lineage(
        brackets.join(sketch, keys)
        .withColumn("l", F.element_at("q", F.greatest(at, F.lit(1))))
        .withColumn("h", F.element_at("q", F.least(at + 3, F.lit(grid + 1))))
        .drop("q")
    )
    v = F.col("v")
    counted = (
        attach(values, cuts, by)
        .filter((F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi"))))
        .groupBy(*keys)
        .agg(
            F.count_if(v < F.col("l")).alias("n_lt"),
            F.count_if(v == F.col("l")).alias("n_l"),
            F.count_if((v > F.col("l")) & (v < F.col("h"))).alias("n_mid"),
            F.count_if((v == F.col("h")) & (F.col("h") > F.col("l"))).alias("n_h"),
        )
    )
    r = F.col("rank") - F.col("below")
    to_l = F.col("n_lt") + F.col("n_l")
    to_mid = to_l + F.col("n_mid")
    to_h = to_mid + F.col("n_h")
    region = (
        F.when(r < F.col("n_lt"), F.lit("under"))
        .when(r < to_l, F.lit("l"))
        .when(r < to_mid, F.lit("mid"))
        .when(r < to_h, F.lit("h"))
        .otherwise(F.lit("over"))
    )
    s = F.col("region")
    return (
        cuts.join(counted, keys)
        .withColumn("region", region)
        .select(
            *keys,
            F.when(s == "l", F.col("l")).when(s == "h", F.col("h")).alias("v"),
            F.when(s == "under", F.col("lo")).when(s == "mid", F.col("l")).when(s == "over", F.col("h")).alias("lo"),
            F.when(s == "under", F.col("l")).when(s == "mid", F.col("h")).when(s == "over", F.col("hi")).alias("hi"),
            (
                F.col("below")
                + F.when(s == "mid", to_l).when(s == "over", to_h).otherwise(F.lit(0))
            ).alias("below"),
            F.when(s == "under", F.col("n_lt"))
            .when(s == "mid", F.col("n_mid"))
            .when(s == "over", F.col("inside") - to_h)
            .otherwise(F.lit(0))
            .alias("inside"),
        )
    )


def select_ranks(
    values: DataFrame,
    ranks: DataFrame,
    by: Sequence[str],
    exact_rows: int = EXACT_ROWS,
    grid: int = GRID,
) -> DataFrame:
    """Exact values at 0-based ranks per group.

    ``values`` has ``by`` and a non-null double ``v``; ``ranks`` has ``by``, ``rank``
    and the group size ``n``.  Returns ``by``, ``rank``, ``v``.  A group larger than
    ``exact_rows`` is narrowed by mergeable quantile sketches whose brackets are
    verified by exact counts, so ties and any value distribution are handled.
    """
    by = list(by)
    open_ = cut_lineage(
        ranks.select(
            *by,
            F.col("rank").cast("bigint").alias("rank"),
            F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"),
            F.lit(0).cast("bigint").alias("below"),
            F.col("n").cast("bigint").alias("inside"),
        ).distinct()
    )
    found: DataFrame | None = None

    def add(part: DataFrame) -> None:
        nonlocal found
        found = part if found is None else found.unionByName(part)

    while True:
        wide = open_.filter(F.col("inside") > exact_rows)
        if wide.isEmpty():
            add(_pick_in_bracket(values, open_, by))
            return found
        add(_pick_in_bracket(values, open_.filter(F.col("inside") <= exact_rows), by))
        step = cut_lineage(_narrow(values, wide, by, grid))
        add(step.filter(F.col("v").isNotNull()).select(*by, "rank", "v"))
        open_ = step.filter(F.col("v").isNull()).drop("v")
        if open_.isEmpty():
            return found


def median_by(
    values: DataFrame, by: Sequence[str], sizes: DataFrame | None = None, exact_rows: int = EXACT_ROWS
) -> DataFrame:
    """Interpolated median of ``v`` per group: ``by``, ``median``.  Nulls are ignored."""
    by = list(by)
    values = values.filter(F.col("v").isNotNull())
    if sizes is None:
        sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes.select(*by, "n").filter(F.col("n") > 0))
    if sizes.filter(F.col("n") > exact_rows).isEmpty():
        # Every group is bounded: one aggregate with map-side merging is enough.
        return values.groupBy(*by).agg(F.percentile("v", F.lit(0.5)).alias("median"))
    half = (F.col("n") - 1) / F.lit(2.0)
    ranks = sizes.select(*by, "n", F.explode(F.array(F.floor(half), F.ceil(half))).alias("rank"))
    picked = select_ranks(values, ranks, by, exact_rows)
    # min and max are the same value when the group size is odd
    return picked.groupBy(*by).agg(((F.min("v") + F.max("v")) / F.lit(2.0)).alias("median"))


def column_medians(df: DataFrame, cols: Sequence[str], exact_rows: int = EXACT_ROWS) -> dict[str, float | None]:
    """Median of each numeric column; the driver receives one number per column."""
    cols = list(cols)
    if not cols:
        return {}
    counts = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(cols)]).first()
    if max(counts) <= exact_rows:
        row = df.agg(*[F.percentile(f"`{c}`", F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return dict(zip(cols, row))
    cells = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(cols)])
    )
    long = df.select(cells.alias("c")).select("c.i", "c.v")
    got = {r["i"]: r["median"] for r in median_by(long, ["i"], exact_rows=exact_rows).collect()}
    return {c: got.get(i) for i, c in enumerate(cols)}


def smallest_per_group(
    df: DataFrame, by: Sequence[str], u: Column, keys: Sequence[str], quotas: DataFrame, buckets: int = BUCKETS, edge_rows: int = EDGE_ROWS
) -> DataFrame:
    """Rows with the ``quota`` smallest ``(u, keys)`` of each group, and the flag's complement.

    Returns ``df`` plus boolean ``_taken``.  The draws are written once beside their
    keys.  Equal-width buckets of ``u`` find the one in which the quota ends; that bucket
    is cut again until it holds no more than ``edge_rows`` rows, and ranking those gives
    the last row taken.  The rows themselves are read once more and compared with it.
    ``quotas`` has ``by`` and ``quota``; a group without a quota takes nothing.  ``keys``
    identify a row: rows that share them are taken or left together.
    """
    by, keys = list(by), list(keys)
    group = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    # null is a group like any other, so groups are met by a text that is never null
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in by] or [F.lit("all")]
    grouped = df.withColumns({**dict(zip(group, named)), "_u": u})
    narrow = stage(grouped.select(*group, "_u", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]))
    order = ["_u", *[f"_k{i}" for i in range(len(keys))]]
    wanted = quotas.withColumns(dict(zip(group, named))).select(*group, "quota")
    sizes = narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    state = cut_lineage(
        sizes.join(wanted, group).withColumns({"_low": F.lit(0.0), "_high": F.lit(1.0), "_got": F.lit(0).cast("bigint"), "_all": F.col("_n")})
    )
    inside = (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high"))
    while True:
        # draws have 52 bits: a range of one draw cannot be cut any further
        wide = (F.col("_n") > edge_rows) & (F.col("quota") > 0) & (F.col("quota") < F.col("_all")) & (F.col("_high") - F.col("_low") > F.lit(2.0**-51))
        todo = state.filter(wide)
        if todo.isEmpty():
            break
        todo = todo.withColumn("_width", (F.col("_high") - F.col("_low")) / F.lit(buckets))
        rows = attach(narrow.select(*group, "_u"), todo, group, weight="_all").filter(inside)
        rows = rows.withColumn("_b", F.least(F.floor((F.col("_u") - F.col("_low")) / F.col("_width")), F.lit(buckets - 1)).cast("int"))
        hist = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_u").alias("_first"), F.max("_u").alias("_last"))
        hist = hist.withColumn("_upto", F.sum("_c").over(W.partitionBy(*group).orderBy("_b")))
        # the bucket in which the quota ends; its own ends bound it, whatever rounding did to the borders
        met = hist.join(todo.select(*group, "quota", "_got"), group).filter(
            (F.col("_got") + F.col("_upto") >= F.col("quota")) & (F.col("_got") + F.col("_upto") - F.col("_c") < F.col("quota"))
        )
        met = met.select(
            *group, F.col("_first").alias("_low1"), (F.col("_last") + F.lit(2.0**-53)).alias("_high1"),
            (F.col("_got") + F.col("_upto") - F.col("_c")).alias("_got1"), F.col("_c").alias("_n1"),
        )
        new = lambda c: F.coalesce(F.col(f"{c}1"), F.col(c)).alias(c)
        state = cut_lineage(state.join(met, group, "left").select(*group, "quota", "_all", new("_n"), new("_low"), new("_high"), new("_got")))
    some = state.filter((F.col("quota") > 0) & (F.col("quota") < F.col("_all")))
    edge = attach(narrow, some, group, weight="_all").filter(inside)
    at = F.row_number().over(W.partitionBy(*group).orderBy(*order)) + F.col("_got")
    last = edge.withColumn("_at", at).filter(F.col("_at") == F.col("quota")).select(*group, F.struct(*order).alias("_cut"))
    plan = state.select(*group, "_all", (F.col("quota") >= F.col("_all")).alias("_whole")).join(last, group, "left")
    here = F.struct(F.col("_u"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    taken = F.coalesce(F.col("_whole") | (here <= F.col("_cut")), F.lit(False))
    return attach(grouped, plan, group, how="left", weight="_all").withColumn("_taken", taken).drop(*group, "_u", "_all", "_whole", "_cut")


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str], exclusive: bool = True
) -> DataFrame:
    """Prefix sums in ``order`` within ``by`` by range partitions and offsets.

    Rows are range-partitioned on (by, order); each range sums itself, the small
    table of range totals gives the offsets.  Adds ``before_<c>`` for each sum.
    ``order`` must be unique within ``by`` (pre-aggregate first).
    """
    by, order = list(by), list(order)
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in by + order]).withColumn("_p", F.spark_partition_id())
    )
    part = by + ["_p"]
    totals = ranged.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*part, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
    upper = -1 if exclusive else 0
    within = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, upper)
    out = attach(ranged, offsets, part)
    for c in sums:
        out = out.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_o_{c}"))
    return out.drop("_p", *[f"_o_{c}" for c in sums])
