import random

import numpy as np
import pytest

import corpus_pipeline
from hushframe.llm import near_dedup

from frames import EDGE, prose, write
from plain import ascii_lower, words


def plain_sets(texts):
    out = []
    for t in texts:
        w = words(ascii_lower(t or ""))
        out.append({tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    return out


def plain_labels(texts):
    """Smallest index reachable for every text, and the number of linked pairs, by comparing all pairs."""
    sets, label, links = plain_sets(texts), list(range(len(texts))), 0

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a == b) or 5 * len(a & b) >= 4 * len(a | b) > 0:
                links += 1
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(texts))], links


def edited(r, text, rate):
    return " ".join(f"edit{r.randrange(10**6)}" if r.random() < rate else w for w in text.split())


def check(kept, rows):
    label, links = plain_labels([t for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    assert len(kept) == len(set(label))
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least.values())
    return links


def test_the_stage_links_what_is_similar(spark, tmp_path):
    """Copies between 0.75 and 0.95, of 60 to 1,000 words, against all pairs."""
    r = random.Random(5)
    rows = list(EDGE)
    for k in range(60):
        text = " ".join(f"w{r.randrange(5_000)}" for _ in range(r.choice([60, 300, 1_000])))
        rows += [(1_000 + 10 * k, text)] + [(1_000 + 10 * k + j, edited(r, text, rate)) for j, rate in enumerate((0.005, 0.018, 0.022, 0.03), 1)]
    # one large group whose members do not all reach the smallest one
    text = " ".join(f"g{i}" for i in range(200))
    for i in range(60):
        rows.append((5_000 + i, text))
        text = edited(r, text, 0.01)
    docs = write(spark, tmp_path, rows)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert check(got.collect(), rows) > 150


def test_keys_meet_at_the_threshold():
    """Of 300 pairs near 0.8 none lacks a common key."""
    r = random.Random(8)
    for _ in range(300):
        n = r.randint(20, 500)
        pool = np.array([r.getrandbits(64) for _ in range(n + n // 4)], np.uint64)
        # the smaller set is 0.8 of the larger one
        assert set(near_dedup.bucket_keys(pool)) & set(near_dedup.bucket_keys(pool[:-(-len(pool) * 4 // 5)]))


@pytest.mark.parametrize("pivots", [0, 2])
def test_large_buckets_in_blocks(spark, tmp_path, monkeypatch, pivots):
    """One group far larger than a block, some of its members linked to few others."""
    for name, value in (("SMALL", 3), ("BLOCK", 8), ("PIVOTS", pivots)):
        monkeypatch.setattr(near_dedup, name, value)
    r = random.Random(3)
    text = " ".join(f"g{i}" for i in range(150))
    rows = [(k, edited(r, text, r.choice([0.002, 0.01, 0.02, 0.03, 0.05]))) for k in range(250)]
    passage = " ".join(f"common{i}" for i in range(120))
    rows += [(1_000 + k, passage + " " + " ".join(f"own{r.randrange(10**6)}" for _ in range(60))) for k in range(120)]
    docs = write(spark, tmp_path, rows)
    assert check(near_dedup.drop_near_copies(docs).collect(), rows) > 2_000


def test_sets_of_a_group_against_all_pairs(monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    r = random.Random(4)
    for _ in range(60):
        pool = [r.getrandbits(64) for _ in range(40)]
        sets = [np.array(sorted(r.sample(pool, r.randint(0, 40))), np.uint64) for _ in range(r.randint(2, 40))]
        label = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    common = len(np.intersect1d(a, b))
                    if common and 5 * common >= 4 * (len(a) + len(b) - common):
                        label[i] = label[j] = min(label[i], label[j])
        assert near_dedup.linked_sets(sets).tolist() == label


def test_empty(spark, tmp_path):
    assert near_dedup.drop_near_copies(write(spark, tmp_path, [])).count() == 0


def test_rows_and_columns_stay(spark, tmp_path):
    rows = EDGE + [(20, prose(80)), (21, prose(80)), (20, prose(80))]
    check(near_dedup.drop_near_copies(write(spark, tmp_path, rows)).collect(), rows)


def test_clashing_columns_stay(spark, tmp_path):
    rows = EDGE + [(20, prose(80)), (21, prose(80))]
    odd = write(spark, tmp_path, rows).selectExpr("*", "1 as _row", "2 as row", "'x' as node", "3 as size", "4 as keys", "5 as digest", "6 as bucket")
    odd.write.parquet(str(tmp_path / "odd"))
    got = near_dedup.drop_near_copies(spark.read.parquet(str(tmp_path / "odd")))
    assert got.columns == odd.columns
    check(got.collect(), rows)
    assert got.filter("_row = 1 and row = 2 and node = 'x' and bucket = 6").count() == got.count()


def test_fingerprints_bring_texts_together(spark):
    """Without a minhash key in common, texts within three bits of each other are still compared."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(5_000)}" for _ in range(400)) for _ in range(12)]
    texts += [t + " extra" for t in texts[:6]]
    sets = {i: near_dedup.shingle_set(t) for i, t in enumerate(texts)}
    fps = [near_dedup.fingerprint(t) for t in texts]
    fps[17] = fps[6]
    rows = [(i, len(sets[i]), [], int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, size long, keys array<long>, fp long")
    held = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "node long, hashes binary")
    found = near_dedup.near_components(nodes, lambda wanted: held.join(wanted, "node", "left_semi")).collect()
    near = {i for i in range(5) if (fps[i] ^ fps[12 + i]).bit_count() <= 3}
    # an equal fingerprint (6 and 17) without similar texts is no link
    assert near and {(r["node"], r["component"]) for r in found} == {(n, i) for i in near for n in (i, 12 + i)}
