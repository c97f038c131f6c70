import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from hushframe.llm import simhash
from hushframe.llm.queries import QUERIES

from frames import EDGE, prose, write
from plain import ascii_lower, words


def plain_fingerprint(text):
    w = words(ascii_lower(text or ""))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Smallest index reachable for every fingerprint, by comparing all pairs."""
    v = np.array(fps, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    label = np.arange(len(v))
    while True:
        smaller = np.where(near, label[None, :], len(v)).min(1)
        if (smaller == label).all():
            return label
        label = smaller


def check(got, rows):
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(fps)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    key = lambda r: tuple(map(repr, r))
    want = sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, label)), key=key)
    none = lambda x: None if pd.isna(x) else int(x)
    assert sorted(((none(r.doc_id), r.fingerprint, none(r.component_id)) for r in got.itertuples()), key=key) == want


def test_edges(spark, tmp_path):
    rows = EDGE + [(100 + i, prose(400) + f" {i}") for i in range(12)] + [(50, prose(400))] * 3
    check(simhash.document_components(write(spark, tmp_path, rows)).toPandas(), rows)


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_lose_nothing(spark, bucket):
    r = random.Random(bucket)
    fps = set()
    for _ in range(25):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(r.choice([1, 4, 20])):
            flipped = base
            for _ in range(r.randint(1, 4)):
                flipped ^= 1 << r.randrange(64)
            fps.add(flipped)
    # a dense group that shares everything but a few neighbouring bits
    dense = r.getrandbits(64)
    fps |= {dense ^ k for k in range(64)} | {0, (1 << 64) - 1, 1 << 63}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket)
    # links join only fingerprints of one component, and enough of them
    found = {x.node: x.component for x in simhash.components(links).collect()}
    label = plain_components(fps)
    mine = [found.get(s, s) for s in signed]
    groups = lambda a: {frozenset(i for i, x in enumerate(a) if x == y) for y in set(a)}
    assert groups(mine) == groups(label.tolist())


def test_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    got = {x.node: x.component for x in simhash.components(spark.createDataFrame(chain, "fp long, root long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_empty(spark, tmp_path):
    assert simhash.document_components(write(spark, tmp_path, [])).count() == 0


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    check(QUERIES["op8_simhash_variants"](spark, sf).toPandas(), list(zip(docs.doc_id, docs.text)))
