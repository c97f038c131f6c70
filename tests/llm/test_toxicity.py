import zlib

import numpy as np
import pandas as pd

from hushframe.llm import toxicity
from hushframe.llm.queries import QUERIES

from frames import EDGE, prose, write

LABELS = "doc_id long, toxic int"


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def corpus():
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        docs.append((i, prose(60, i) + (" you vile rotter" if bad else "")))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_and_leaves_the_held_out_fold_alone(spark, tmp_path):
    docs, labels = corpus()
    frame = write(spark, tmp_path, docs + EDGE)
    # wrong labels in the held-out fold must not change a score
    wrong = [(i, 1 - y) if fold(i) else (i, y) for i, y in labels]
    got = toxicity.document_scores(frame, spark.createDataFrame(labels, LABELS)).toPandas()
    same = toxicity.document_scores(frame, spark.createDataFrame(wrong, LABELS)).toPandas()
    order = ["doc_id", "score"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(same[order].sort_values(order).reset_index(drop=True))
    assert len(got) == len(docs) + len(EDGE) and got.score.between(0, 1).all()
    assert [bool(h) for h in got.held_out] == [fold(None if pd.isna(i) else int(i)) for i in got.doc_id]
    assert (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(pd.DataFrame(labels, columns=["doc_id", "toxic"]), on="doc_id")
    assert len(held) > 30 and (held.predicted == held.toxic).mean() > 0.95


def test_scores_are_the_sum_over_distinct_features(spark, tmp_path):
    model = toxicity.Model(-1.0, np.unique(toxicity.features("bad words here"))[:3], np.array([0.5, 2.0, -0.25]))
    docs = write(spark, tmp_path, EDGE + [(70, "bad words here bad words here")])
    got = toxicity.score(docs, model).toPandas()
    for r in got.itertuples():
        weights = dict(zip(model.hashes.tolist(), model.weights.tolist()))
        total = -1.0 + sum(weights.get(f, 0.0) for f in set(toxicity.features(r.text).tolist()))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-12


def test_weights_match_a_plain_ftrl():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.uint32) for _ in range(120)]
    ys = np.array([int(3 in r) for r in rows])
    z, n = dict.fromkeys(range(-1, 40), 0.0), dict.fromkeys(range(-1, 40), 0.0)
    docs = {f: sum(f in r for r in rows) for f in range(40)}
    t = toxicity

    def weight(f):
        rate = (t.BETA + n[f] ** 0.5) / t.ALPHA
        if f < 0:
            return -z[f] / rate
        return 0.0 if abs(z[f]) <= t.L1 else -(z[f] - np.sign(z[f]) * t.L1) / (rate + t.L2)

    for _ in range(t.EPOCHS):
        for y, r in zip(ys, rows):
            fs = [-1, *[f for f in r.tolist() if docs[f] >= t.MIN_DOCS]]
            w = {f: weight(f) for f in fs}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (t.TOXIC_WEIGHT if y else 1.0)
            for f in fs:
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / t.ALPHA * w[f]
                n[f] += g * g
    bias, hashes, weights = t._learn(ys, rows)
    assert abs(bias - weight(-1)) < 1e-9
    plain = {f: weight(f) for f in range(40) if weight(f)}
    assert set(hashes.tolist()) == set(plain) and np.allclose(weights, [plain[f] for f in hashes.tolist()])


def test_no_labels_and_empty(spark, tmp_path):
    got = toxicity.document_scores(write(spark, tmp_path, EDGE), spark.createDataFrame([], LABELS)).toPandas()
    assert len(got) == len(EDGE) and not got.predicted.any()
    docs, labels = corpus()
    assert toxicity.document_scores(write(spark, tmp_path, [], "e"), spark.createDataFrame(labels, LABELS)).count() == 0


def test_drop_keeps_columns(spark, tmp_path):
    docs, labels = corpus()
    frame = write(spark, tmp_path, docs)
    kept = toxicity.drop_toxic(frame, spark.createDataFrame(labels, LABELS))
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i, y in labels if y == 0 and i in ids]) > 0.97 * 225 and len([i for i, y in labels if y and i in ids]) < 5


def test_text_ids_and_clashing_columns(spark, tmp_path):
    docs, labels = corpus()
    frame = write(spark, tmp_path, docs)
    plain = toxicity.document_scores(frame, spark.createDataFrame(labels, LABELS)).toPandas().sort_values("doc_id")
    odd = frame.selectExpr("cast(doc_id as string) as doc_id", "text", "1 as score", "'x' as _toxicity", "2 as _y", "3 as y", "4 as learner")
    named = spark.createDataFrame([(str(i), y, 9, "z") for i, y in labels], "doc_id string, toxic int, _y int, text string")
    got = toxicity.document_scores(odd, named).toPandas()
    got["doc_id"] = got.doc_id.astype(int)
    assert np.allclose(got.sort_values("doc_id").score, plain.score, atol=1e-9)
    kept = toxicity.drop_toxic(odd, named)
    assert kept.columns == odd.columns and 0 < kept.count() < len(docs)


def test_query_held_out(spark):
    got = QUERIES["op2_ftrl_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labelled = got[got.held_out].merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    toxic, clean = labelled[labelled.toxic == 1], labelled[labelled.toxic == 0]
    assert toxic.predicted.mean() > 0.75 and clean.predicted.mean() < 0.01
