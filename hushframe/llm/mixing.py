"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Every source gets a target number of words.  Complete epochs come first: each document
is taken floor(target / source size) times.  The rest of the budget goes to the
documents with the smallest exponential keys -ln(u) / weight, up to the prefix sum that
comes nearest.

A source is never sorted in one task: keys fall into buckets between the least and the
largest, bucket sums find the one bucket in which the budget ends, that bucket is cut
again until it is small, and only its documents are ranked.  ``u`` is a hash of seed, doc_id and text, so reruns agree.

Defined cases: a null text has no word and weight one; sources sort by code point, null
last, as one source; a source without words has target 0; repeated rows share a key and
are taken in any order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.noise import uniform
from hushframe.llm.common import SPACES, WORD, fresh, text_of, with_place, word_count
from hushframe.operators.joins import attach
from hushframe.session import cut_lineage, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 42
# Characters that are no prose, and what a share of them and of repeated lines takes from a weight.
MARKS = "#*$%&|<>"
SYMBOLS, REPEATED = 10.0, 2.0
# Documents that are ranked together, and the most buckets of one source and round.
BUCKET_ROWS = 2_000
MAX_BUCKETS = 65_536


def quality_weight(size: Column, chars: Column, symbols: Column, lines: Column, repeated: Column) -> Column:
    """1 for prose: words of 3 to 10 characters on average, no symbols, no repeated lines; less the more it differs."""
    mean = chars / size
    off = F.greatest(F.lit(3.0) - mean, mean - F.lit(10.0), F.lit(0.0))
    worse = off + F.lit(SYMBOLS) * symbols / size + F.lit(REPEATED) * repeated / F.greatest(lines, F.lit(1))
    return F.when(size > 0, F.lit(1.0) / (F.lit(1.0) + worse)).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size, rows), one row per source, with the target.

    Targets stop at ``most`` times a source's size and the excess is shared again by
    weight: the fixed point is min(most * size, level * weight) for one level, found
    over sources ordered by the level at which they stop.  Windows here run over
    sources, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_rank", F.row_number().over(order) - 1)
    s = s.withColumn("_weight", F.element_at(ws, (F.col("_rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy(F.lit(1))
    stop = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    free = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / free
    s = s.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_weight") <= F.col("_cap"))
    # the first source that does not stop sets the level for all after it
    s = s.withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_weight"), "_rank", "_level"))).over(whole)["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_weight"), F.col("_cap")))
    return s.select("source", "source_size", "rows", target.alias("target"))


def _draws(documents: DataFrame, seed: int) -> DataFrame:
    """Narrow rows: doc_id, source, size and exponential key."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    narrow = documents.select(
        F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
        F.length(F.translate(text, SPACES, "")).alias("chars"), (F.length(text) - F.length(F.translate(text, MARKS, ""))).alias("symbols"),
        lines.alias("lines"), uniform(seed, F.col("doc_id"), F.md5(text.cast("binary"))).alias("u"),
    )
    narrow = narrow.withColumns({"n_lines": F.size("lines"), "repeated": F.size("lines") - F.size(F.array_distinct("lines"))})
    key = -F.log(F.col("u")) / quality_weight(*map(F.col, ("size", "chars", "symbols", "n_lines", "repeated")))
    return narrow.select("doc_id", "source", "size", key.alias("key"))


def _edges(draws: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source _rows, the keys _low to _high between which the budget ends, and the words before them as _full."""
    state = plan.select(
        "_source", "_rows", "_left", F.col("_least").alias("_low"), F.col("_largest").alias("_high"),
        F.lit(0).cast("long").alias("_full"), F.col("_rows").alias("_n"),
    )
    # keys of all weights spread evenly over their logarithm, those of one bucket over the key itself
    linear = (F.col("key") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    wide = F.log("_high") > F.log("_low")
    at = F.when(wide, (F.log("key") - F.log("_low")) / (F.log("_high") - F.log("_low"))).otherwise(linear)
    while True:
        todo = state.filter((F.col("_n") > BUCKET_ROWS) & (F.col("_low") < F.col("_high")) & (F.col("_left") > 0))
        if todo.isEmpty():
            return state.select("_source", "_rows", "_low", "_high", "_full")
        todo = todo.withColumn("_buckets", F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("_n") / F.lit(BUCKET_ROWS)) * 8).cast("int"))
        rows = attach(draws.select("_source", "key", "size"), todo, ["_source"], weight="_rows").filter(F.col("key").between(F.col("_low"), F.col("_high")))
        # both ends are in different buckets, so every round leaves fewer documents
        rows = rows.withColumn("_bucket", F.least(F.col("_buckets") - 1, F.floor(at * F.col("_buckets"))))
        sums = rows.groupBy("_source", "_bucket").agg(
            F.sum("size").alias("_words"), F.first("_left").alias("_left"), F.first("_full").alias("_full"),
            F.min("key").alias("_low"), F.max("key").alias("_high"), F.count("*").alias("_n"),
        )
        before = F.col("_full") + F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_words")
        found = (
            sums.withColumn("_before", before)
            .filter((F.col("_before") + F.col("_words") >= F.col("_left")) & (F.col("_before") < F.col("_left")))
            .groupBy("_source")
            .agg(F.min(F.struct("_bucket", "_low", "_high", "_before", "_n")).alias("_e"))
        )
        found = todo.select("_source").join(found, "_source", "left").withColumn("_met", F.lit(True))
        # a budget beyond the last document takes all of them
        new = lambda c, to, none: F.when(F.col("_met"), F.coalesce(F.col(f"_e.{c}"), F.lit(none))).otherwise(F.col(to)).alias(to)
        inf = float("inf")
        state = cut_lineage(state.join(found, "_source", "left").select(
            "_source", "_rows", "_left", new("_low", "_low", inf), new("_high", "_high", inf), new("_before", "_full", 0), new("_n", "_n", 0),
        ))
        at = linear


def mix(draws: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds source_size, target and taken to staged draws (source, size, key, ...)."""
    draws = draws.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    sizes = cut_lineage(draws.groupBy("_source", "source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.min("key").alias("_least"), F.max("key").alias("_largest")
    ))
    targets = source_targets(sizes.select("source", "source_size", "rows"), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("_source"), "source_size", "target", F.col("rows").alias("_rows"),
        epochs.alias("_epochs"), (F.col("target") - epochs * F.col("source_size")).alias("_left"),
    )
    plan = cut_lineage(plan.join(sizes.select("_source", "_least", "_largest"), "_source"))
    edges = _edges(draws, plan).drop("_rows")
    rows = attach(draws, plan.drop("_least", "_largest").join(edges, "_source"), ["_source"], weight="_rows")
    inside = F.col("key").between(F.col("_low"), F.col("_high"))
    ranked = Window.partitionBy("_source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_full") + F.sum("size").over(ranked)
    edge = rows.filter(inside & (F.col("_left") > 0)).withColumn("_upto", upto)
    # the document on the edge is taken when that comes nearer to the budget
    near = edge.withColumn("_taken", (F.col("_upto") - F.col("size") / F.lit(2.0)) <= F.col("_left"))
    full = rows.filter(~(inside & (F.col("_left") > 0))).withColumn("_taken", (F.col("_left") > 0) & (F.col("key") < F.col("_low")))
    both = full.unionByName(near.drop("_upto"))
    return both.withColumn("taken", F.col("size") * (F.col("_epochs") + F.col("_taken").cast("long"))).withColumn(
        "epochs", F.col("_epochs") + F.col("_taken").cast("long")
    ).drop("_source", "_rows", "_epochs", "_left", "_low", "_high", "_full", "_taken")


def document_mix(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document with the words that the mix takes from it."""
    return mix(stage(_draws(documents, seed))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: whole documents, as often as they are taken; columns as they were."""
    row, times = fresh(documents, "_row_of_mix", "_times")
    scan = with_place(documents, row)
    draws = stage(with_place(_draws(documents, seed), row))
    counts = mix(draws).filter(F.col("epochs") > 0).select(row, F.col("epochs").alias(times))
    return (
        scan.join(counts, row)
        .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
        .drop(row, times)
    )
