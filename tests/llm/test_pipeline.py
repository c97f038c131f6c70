import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pandas as pd

import corpus_pipeline
from hushframe.llm import toxicity

from frames import prose, write
from plain import ascii_lower, words
from test_mixing import plain_targets
from test_near_dedup import plain_labels

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order_over_a_corpus(spark, tmp_path):
    rows = [(i, prose(40 + i % 30, i * 50) + (" you vile rotter" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(1000 + i, prose(60, 77)) for i in range(20)] + [(2000, prose(60, 77).upper()), (2001, None), (2002, "")]
    near = prose(2_000, 9)
    rows += [(3000, near), (3001, near + " extra")]
    sf = str(tmp_path)
    write(spark, tmp_path, rows, "documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, apply in corpus_pipeline.STAGES:
        before = docs.toPandas()
        out = apply(spark, docs, sf)
        assert name == "packing" or out.columns == columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = (before, docs.toPandas())

    before, after = kept["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), model).toPandas()
    assert set(after.doc_id) == set(scores[scores.score < 0.5].doc_id)
    gone = set(before.doc_id) - set(after.doc_id)
    assert len([i for i in gone if i < 200 and i % 4 == 0]) > 40 and not [i for i in gone if i % 4 or i >= 200]

    before, after = kept["exact_dedup"]
    best = {}
    for i, t in zip(before.doc_id, before.text):
        key = ascii_lower(t or "")
        best[key] = max(best.get(key, i), i)
    assert sorted(after.doc_id) == sorted(best.values()) and 2000 in set(after.doc_id) and 2002 in set(after.doc_id)

    before, after = kept["near_dedup"]
    label = np.array(plain_labels(list(before.text))[0])
    least = {c: min(before.doc_id[label == c]) for c in set(label)}
    assert sorted(after.doc_id) == sorted(least.values())

    before, after = kept["mixing"]
    size = {i: len(words(t)) for i, t in zip(before.doc_id, before.text)}
    key = lambda s: s if isinstance(s, str) else None
    sizes, taken, most = Counter(), Counter(), Counter()
    for i, s in zip(before.doc_id, before.source):
        sizes[key(s)] += size[i]
        most[key(s)] = max(most[key(s)], size[i])
    for i, s in zip(after.doc_id, after.source):
        taken[key(s)] += size[i]
    for s, goal in plain_targets(dict(sizes)).items():
        assert abs(taken[s] - goal) <= most[s] / 2 + 1e-6

    before, after = kept["packing"]
    assert after.groupby("doc_id").length.sum().sum() == sum(
        n for n in after.drop_duplicates(["doc_id"]).set_index("doc_id").doc_tokens.reindex(before.doc_id).to_numpy()
    )
    for _, g in after.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024


def test_run_over_the_test_table(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert 0 < got.select("doc_id").distinct().count() < len(docs)


def test_entry_works_without_the_subpackage(tmp_path):
    """The registry imports and lists the other queries when pipeline and subpackage are gone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in os.listdir(root):
        if name not in ("hushframe", "corpus_pipeline.py", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "hushframe").mkdir()
    for name in os.listdir(f"{root}/hushframe"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/hushframe/{name}", tmp_path / "hushframe" / name)
    (tmp_path / "entry.py").write_text(open(f"{root}/__spark_entry__.py").read())
    code = "import entry; q = entry.queries(); assert q and not [k for k in q if k.startswith('op') and k[2].isdigit()] and 'pipeline' not in q; entry.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
