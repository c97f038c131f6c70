"""Links of embeddings against all pairs."""

import numpy as np
import pytest

from hushframe.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """vec_id -> (n_links, component_id, kept) for rows with distinct ids."""
    link = {v: set() for v, _, _ in rows}

    def unit(c):
        if not c or any(x is None or not np.isfinite(x) for x in c) or not any(c):
            return None
        c = np.array(c, np.float32).astype(float)
        return c / np.sqrt((c * c).sum())

    scopes = {}
    for v, c, label in rows:
        u = unit(c)
        if u is not None and label is not None:
            scopes.setdefault((label, len(u)), []).append((v, u))
    for found in scopes.values():
        s = np.array([u for _, u in found]) @ np.array([u for _, u in found]).T
        for i, j in zip(*np.nonzero(s >= 0.93)):
            if i != j:
                link[found[i][0]].add(found[j][0])
    root = {}
    for v in sorted(link):
        todo = [v]
        while todo:
            at = todo.pop()
            if at not in root:
                root[at] = v
                todo += link[at]
    return {v: (len(link[v]), root[v], root[v] == v) for v in link}


def table(spark, tmp_path, rows, schema=SCHEMA, name="vectors"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def vectors(seed, lone, groups, d=24, labels=3, noise=0.04):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(d) for _ in range(lone)]
    tags = rng.integers(0, labels, lone).tolist()
    for size in groups:
        base = rng.standard_normal(d)
        out += [base / np.linalg.norm(base) + rng.standard_normal(d) * noise for _ in range(size)]
        tags += [int(rng.integers(0, labels))] * size
    order = rng.permutation(len(out))
    return [(int(k) * 3 + 1, [float(x) for x in np.float32(out[i] * (1 + k % 5))], tags[i]) for k, i in enumerate(order)]


def got(df):
    rows = neighbours.vector_links(df).collect()
    assert len({r.vec_id for r in rows}) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}


@pytest.mark.parametrize("seed, lone, groups, noise", [(1, 300, [2, 3, 5, 40, 2, 2, 7], 0.04), (2, 100, [120, 60], 0.055), (3, 900, [2] * 60, 0.05)])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, seed, lone, groups, noise):
    # small blocks and buckets, so that lists saturate and components are cut
    for name, value in (("LEAF", 16), ("MEET", 24), ("BLOCK", 16), ("NEIGHBOURS", 4)):
        monkeypatch.setattr(neighbours, name, value)
    rows = vectors(seed, lone, groups, noise=noise)
    assert got(table(spark, tmp_path, rows)) == brute(rows)


def test_chain_of_links(spark, tmp_path):
    angle = np.arccos(0.93) * 0.99
    rows = [(100 - k, [float(np.cos(k * angle)), float(np.sin(k * angle)), 0.0], 1) for k in range(12)]
    result = got(table(spark, tmp_path, rows))
    assert result == brute(rows) and len({c for _, c, _ in result.values()}) == 1


def test_odd_vectors_and_columns(spark, tmp_path):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1),
        (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 1e-30], 1), (13, [3e38, 3e38], 1), (14, [-1.0, 0.0], 1),
    ]
    full = [(*r, 1, "x", 2.0) for r in rows]
    df = table(spark, tmp_path, full, SCHEMA + ", node long, scope string, links double")
    assert got(df) == brute(rows)


def test_copies_null_ids_and_empty(spark, tmp_path):
    rows = [(5, [1.0, 2.0], 1)] * 3 + [(None, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (None, [9.0, -2.0], 1), (None, None, 1)]
    result = sorted(map(tuple, neighbours.vector_links(table(spark, tmp_path, rows)).collect()), key=str)
    assert result == sorted([(5, 4, 5, True)] * 3 + [(None, 4, 5, False), (7, 4, 5, False), (None, 0, None, True), (None, 0, None, True)], key=str)
    assert neighbours.vector_links(table(spark, tmp_path, [], name="none")).count() == 0
