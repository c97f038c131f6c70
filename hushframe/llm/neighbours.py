"""Embedding near-duplicates over a neighbour graph refined by NN-descent.

The graph starts from buckets of random hyperplanes, cut finer the more vectors a label
has.  A round brings every vector together with its neighbours and with those that have
it as neighbour, compares them with each other and keeps the nearest of each.  Lists
that are full of links are enlarged to the whole component that their links make,
compared in blocks of which only counts and stars leave.  A sample of vectors is then
compared with all of its label: while too few of its links were found, more hyperplanes
start another descent with longer lists.  The graph is built in single precision; what
counts as a link is decided in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite entries and
vectors without a label link with nothing, nor do vectors of different length; equal
vectors of a label are one node and count each other; repeated rows are equal vectors; a
row without vec_id is linked like any other and never names a component (one that only
such rows make has a null id); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import join_hot, with_row_id
from hushframe.llm.simhash import components
from hushframe.operators.joins import attach
from hushframe.session import stage

THRESHOLD = 0.93
# Single precision may be off by less than this.
SLACK = 1e-4
NEIGHBOURS = 8
TABLES = 8
# Vectors that a bucket is meant for, and the most that meet in one.
LEAF, MEET = 256, 512
# Members of a component that are compared as one block.
BLOCK = 1_024
ROUNDS = 6
# Part of the links that a round must add for another one.
GAIN = 0.001
# Vectors of the audit, the part of their links to be found, and the descents it may ask for.
AUDIT, RECALL, DESCENTS = 1_024, 0.995, 5
SEED = 42


def _links(label: str, vector: str) -> Column:
    """Whether a row's vector may link with others."""
    real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    c = F.col(vector).cast("array<double>")
    good = F.col(label).isNotNull() & c.isNotNull() & F.forall(c, real) & F.exists(c, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def units(embeddings: DataFrame) -> DataFrame:
    """(vec_id, scope, v): label and length as scope and the unit vector as bytes, for vectors that may link."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("c")
    )
    rows = rows.filter(_links("label", "c"))

    def scale(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for c in batch.column(2):
                c = c.values.to_numpy(zero_copy_only=False)
                # by the largest entry first, so that no square over- or underflows
                c = c / np.abs(c).max() + 0.0
                out.append((c / np.sqrt(c @ c)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "scope", "v"])

    scope = F.concat_ws(":", F.size("c").cast("string"), "label")
    return rows.select("vec_id", scope.alias("scope"), "c").mapInArrow(scale, "vec_id long, scope string, v binary")


def _matrix(parts: list[bytes], kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def _lists(nodes: np.ndarray, near: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[list, list, list]:
    """Per node its ``k`` nearest of a block with similarities ``near`` that lie above ``floor``."""
    near = near.copy()
    np.fill_diagonal(near, -2)
    k = min(k, len(nodes) - 1)
    order = np.argpartition(-near, k - 1, 1)[:, :k]
    value = np.take_along_axis(near, order, 1)
    good = value > (-1.5 if floor is None else floor[:, None])
    some = good.any(1).nonzero()[0]
    return nodes[some].tolist(), [nodes[order[i, good[i]]].tolist() for i in some], [value[i, good[i]].tolist() for i in some]


LISTS = "node long, others array<long>, near array<float>"


def _met(groups: DataFrame, k: int, floors: bool) -> DataFrame:
    """Lists of neighbours inside every group (ids, vs in single precision[, floors])."""

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for g in range(batch.num_rows):
                ids = np.array(batch.column(0)[g].as_py(), np.int64)
                v = _matrix(batch.column(1)[g].as_py(), np.float32)
                floor = np.array(batch.column(2)[g].as_py(), np.float32) if floors else None
                columns = _lists(ids, v @ v.T, k, floor)
                types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["node", "others", "near"])

    return groups.mapInArrow(meet, LISTS)


def _best(lists: DataFrame, k: int) -> DataFrame:
    """(node, list): the ``k`` nearest distinct of all lists of a node, nearest first."""
    pairs = F.arrays_zip("near", "others")
    merged = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(pairs))).alias("all"))
    # the same pair may come with similarities that differ in the last bit: the first of equal ids stays
    ordered = merged.select("node", F.sort_array("all", asc=False).alias("all"))
    first = F.expr("filter(all, (x, i) -> i = 0 or not exists(slice(all, 1, i), y -> y.others = x.others))")
    return ordered.select("node", F.slice(first, 1, k).alias("list"))


def start(nodes: DataFrame, scopes: DataFrame, first: int, tables: int, k: int) -> DataFrame:
    """Lists from ``tables`` tables of hyperplane buckets, the ``first``-th and following."""

    def codes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, scope, bits = batch.column(0), batch.column(1), batch.column(3).to_numpy()
            parts = batch.column(2).to_pylist()
            length = np.array([len(p) for p in parts])
            for size in np.unique(length).tolist():
                at = (length == size).nonzero()[0]
                v = _matrix([parts[i] for i in at]).astype(np.float32)
                for t in range(first, first + tables):
                    planes = np.random.Generator(np.random.PCG64([SEED, size, t])).standard_normal((size // 8, 48), np.float32)
                    code = ((v @ planes > 0) @ (1 << np.arange(48))) & ((1 << bits[at].astype(np.int64)) - 1)
                    k = len(at)
                    columns = (ids.take(pa.array(at)), scope.take(pa.array(at)), pa.array([t] * k, pa.int32()), pa.array(code), pa.array([r.tobytes() for r in v], pa.binary()))
                    yield pa.RecordBatch.from_arrays(list(columns), ["node", "scope", "t", "code", "u"])

    depth = F.least(F.lit(48), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(LEAF))))).cast("int")
    rows = attach(nodes.select("node", "scope", "v"), scopes.select("scope", "n", depth.alias("bits")), ["scope"], weight="n")
    leaves = rows.select("node", "scope", "v", "bits").mapInArrow(codes, "node long, scope string, t int, code long, u binary")
    # buckets that no plane cuts are dealt into parts, differently in every table
    large = leaves.groupBy("scope", "t", "code").count().filter(F.col("count") > MEET)
    dealt = attach(leaves, large, ["scope", "t", "code"], how="left")
    part = F.pmod(F.xxhash64("node", "t"), F.coalesce(F.ceil(F.col("count") / F.lit(MEET)), F.lit(1)))
    groups = dealt.withColumn("part", part).groupBy("scope", "t", "code", "part").agg(F.collect_list("node").alias("ids"), F.collect_list("u").alias("vs"))
    return _met(groups.filter(F.size("ids") > 1).select("ids", "vs"), k, False)


def descend(nodes: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Lists found by comparing the neighbours of every node, in either direction, with each other."""
    edges = graph.select("node", F.explode("list").alias("e")).select("node", F.col("e.others").alias("other"))
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    # a node that many have as neighbour is met in parts, each of its neighbours in one
    sizes = both.groupBy("node").count().filter(F.col("count") > MEET)
    parts = attach(both, sizes, ["node"], how="left")
    parts = parts.select("node", F.pmod(F.xxhash64("other"), F.coalesce(F.ceil(F.col("count") / F.lit(MEET)), F.lit(1))).alias("part"), "other")
    kth = graph.select(F.col("node").alias("other"), F.when(F.size("list") >= k, F.col("list")[k - 1]["near"]).otherwise(F.lit(-1.5)).cast("float").alias("floor"))
    known = nodes.select(F.col("node").alias("other"), "u").join(kth, "other", "left").select("other", "u", F.coalesce("floor", F.lit(-1.5).cast("float")).alias("floor"))
    groups = parts.join(known, "other").groupBy("node", "part").agg(
        F.collect_list("other").alias("ids"), F.collect_list("u").alias("vs"), F.collect_list("floor").alias("floors")
    )
    return _met(groups.filter(F.size("ids") > 1).select("ids", "vs", "floors"), k, True)


def _as_lists(graph: DataFrame) -> DataFrame:
    return graph.select("node", F.expr("transform(list, x -> x.others)").alias("others"), F.expr("transform(list, x -> x.near)").alias("near"))


def _near(graph: DataFrame) -> DataFrame:
    """Edges of the graph that may be links."""
    return graph.select("node", F.explode("list").alias("e")).select("node", F.col("e.others").alias("other"), F.col("e.near").alias("near")).filter(
        F.col("near") >= THRESHOLD - SLACK
    )


def neighbour_graph(nodes: DataFrame, scopes: DataFrame, graph: DataFrame | None, first: int, tables: int, k: int) -> DataFrame:
    """Staged (node, list) after a descent that ends when it adds hardly any link."""
    lists = start(nodes, scopes, first, tables, k)
    if graph is not None:
        lists = lists.unionByName(_as_lists(graph))
    graph = stage(_best(lists, k))
    links = _near(graph).count()
    for _ in range(ROUNDS):
        graph = stage(_best(descend(nodes, graph, k).unionByName(_as_lists(graph)), k))
        before, links = links, _near(graph).count()
        if links <= before * (1 + GAIN):
            break
    return graph


def linked(nodes: DataFrame, graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links inside the components of the graph: (node, links) counted by copies, and staged stars (fp, root).

    The lists of a component's members are enlarged to all of it: blocks of members are
    compared in double precision, a large component by pairs of blocks.
    """
    found = components(_near(graph).select(F.col("node").alias("fp"), F.col("other").alias("root")))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    members = attach(found, sizes, ["component"], weight="n").withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = members.join(nodes.select("node", "v", "copies"), "node").withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.groupBy("component", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b")).agg(
        F.collect_list("node").alias("ids"), F.collect_list("v").alias("vs"), F.collect_list("copies").alias("copies"), F.collect_list("block").alias("blocks")
    )

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for g in range(batch.num_rows):
                ids, copies, block = (np.array(batch.column(c)[g].as_py(), np.int64) for c in (0, 2, 3))
                v = _matrix(batch.column(1)[g].as_py())
                # a link is one of two nodes; links inside a block belong to the block's own pair
                link = v @ v.T >= THRESHOLD
                np.fill_diagonal(link, False)
                if block.min() != block.max():
                    link &= block[:, None] != block[None, :]
                label = np.arange(len(ids))
                while True:
                    least = np.where(link, label[None, :], len(ids)).min(1)
                    smaller = np.minimum(label, least)
                    # the label of the label halves the way
                    smaller = np.minimum(smaller, smaller[smaller])
                    if (smaller == label).all():
                        break
                    label = smaller
                some = link.any(1)
                columns = (ids[some], (link @ copies)[some], ids[label[some]])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "root"])

    part = stage(rows.select("ids", "vs", "copies", "blocks").mapInArrow(compare, "node long, links long, root long"))
    return part.groupBy("node").agg(F.sum("links").alias("links")), part.select(F.col("node").alias("fp"), "root")


def audit(nodes: DataFrame, counts: DataFrame, sample: int = AUDIT) -> float:
    """Part of the links of ``sample`` nodes, drawn by a hash, that ``counts`` holds."""
    drawn = nodes.select("node", "scope", "v", "copies").orderBy(F.xxhash64("node", F.lit("audit")), "node").limit(sample)
    # a bounded number of vectors goes to every task
    asked = [(r.node, r.scope, bytes(r.v)) for r in drawn.collect()]
    shared = nodes.sparkSession.sparkContext.broadcast(asked)

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        by: dict[str, list] = {}
        for node, scope, v in shared.value:
            by.setdefault(scope, []).append((node, v))
        sets = {s: (np.array([n for n, _ in found]), _matrix([v for _, v in found])) for s, found in by.items()}
        total: dict[int, int] = {}
        for batch in batches:
            ids, scopes, copies = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()), batch.column(3).to_numpy()
            parts = batch.column(2).to_pylist()
            for s in set(scopes.tolist()) & sets.keys():
                at = (scopes == s).nonzero()[0]
                asked_ids, v = sets[s]
                link = (v @ _matrix([parts[i] for i in at]).T >= THRESHOLD) & (asked_ids[:, None] != ids[at][None, :])
                for n, c in zip(asked_ids.tolist(), (link @ copies[at]).tolist()):
                    total[n] = total.get(n, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "true"])

    true = nodes.select("node", "scope", "v", "copies").mapInArrow(compare, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    row = true.join(counts, "node", "left").agg(F.sum("true").alias("all"), F.sum(F.coalesce("links", F.lit(0))).alias("found")).first()
    return 1.0 if not row["all"] else row["found"] / row["all"]


def links_of(nodes: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(node, links) and stars (fp, root) of staged nodes (node, scope, v, u, copies)."""
    scopes = nodes.groupBy("scope").agg(F.count("*").alias("n"))
    graph, first = None, 0
    for _ in range(DESCENTS):
        graph = neighbour_graph(nodes, scopes, graph, first, tables, k)
        counts, stars = linked(nodes, graph)
        if audit(nodes, counts) >= recall:
            break
        first, tables, k = first + tables, tables * 2, min(k * 2, MEET)
    return counts, stars


def vector_links(embeddings: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    linkable = stage(units(embeddings))
    same = linkable.groupBy("scope", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = stage(with_row_id(same, "node"))
    single = _single(nodes)
    counts, stars = links_of(stage(single))
    found = components(stars)
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stage(named.join(counts, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(named.join(least, "component").select("scope", "v", "links", "component_id", "copies"))
    total = named.agg(F.sum("copies")).first()[0] or 0
    rows = join_hot(linkable, named, ["scope", "v"], "copies", total).select("vec_id", F.col("links").alias("n_links"), "component_id")
    lone = embeddings.filter(~_links("label", "embedding")).select(F.col("vec_id").cast("long").alias("vec_id"))
    lone = lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(lone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _single(nodes: DataFrame) -> DataFrame:
    """Adds the vector in single precision as ``u``."""

    def cast(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            u = [np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(u, pa.binary())], ["node", "scope", "v", "copies", "u"])

    return nodes.select("node", "scope", "v", "copies").mapInArrow(cast, "node long, scope string, v binary, copies long, u binary")
