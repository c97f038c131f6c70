import re
from collections import defaultdict

import pandas as pd
import pytest

from hushframe.llm import quality_rules
from hushframe.llm.queries import QUERIES

from frames import EDGE, prose, write
from plain import words


def plain(text):
    text, w = text or "", words(text)
    places = defaultdict(list)
    for k in range(len(w) - 2):
        places[tuple(w[k:k + 3])].append(k)
    covered = {k + d for ks in places.values() if len(ks) > 1 for k in ks for d in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed)


def check(got, rows):
    none = lambda x: None if pd.isna(x) else int(x)
    have = sorted(((none(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.itertuples()), key=repr)
    assert have == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert not (got.kept & got.base_failed).any()


def test_edges(spark, tmp_path):
    rows = EDGE + [(50, "a b c " * 40), (51, "line one\nline one\n\n \nline one\n" + prose(60)), (52, "x " * 5), (53, "| a # b * c\n" * 30)]
    check(quality_rules.document_verdicts(write(spark, tmp_path, rows)).toPandas(), rows)


def test_learned_thresholds_follow_the_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality_rules, "MIN_DOCS", 20)
    usual = [(i, prose(100, i)) for i in range(60)]
    code = [(1000 + i, prose(80, i) + " #" * 40) for i in range(60)]
    docs = write(spark, tmp_path, usual + [(99, prose(80, 5) + " #" * 40)], "a", source="prose", lang="en").unionByName(
        write(spark, tmp_path, code + [(1099, " ".join(f"#$%&{i}" for i in range(60)) + prose(60))], "b", source="code", lang="en")
    )
    docs.write.parquet(str(tmp_path / "both"))
    got = quality_rules.document_verdicts(spark.read.parquet(str(tmp_path / "both"))).toPandas().set_index("doc_id").kept
    assert got[[i for i, _ in usual]].all() and got[[i for i, _ in code]].all()
    assert not got[99] and not got[1099]


def test_outliers_below_usual_cutoffs_go(spark, tmp_path):
    """In 1,000 documents without a repeated line or symbol, 40 % repeated lines or 8 % symbols are outliers."""
    lines = lambda k, n: "\n".join(prose(5, 7 * k + 31 * j) + f" end{k}x{j}" for j in range(n))
    rows = [(k, lines(k, 20)) for k in range(1_000)]
    short, long = [f"few words{k}" for k in range(8)], [" ".join(_own(3_000 + k)) for k in range(4)]
    rows += [(5_000, "\n".join(short + long + short)), (5_001, lines(2_001, 20) + " #" * 9)]
    got = quality_rules.document_verdicts(write(spark, tmp_path, rows, source="s", lang="en")).toPandas().set_index("doc_id")
    assert got.n_dup_lines[5_000] == 8 and got.n_symbols[5_001] == 9 and not got.base_failed[[5_000, 5_001]].any()
    assert not got.kept[5_000] and not got.kept[5_001] and got.kept[list(range(1_000))].all()


def _own(k):
    return [f"{w}{chr(97 + i % 26)}" for i, w in enumerate(prose(90, 40 * k).split())]


def _with(measure, k):
    """A document with much of one measure and little of the others."""
    w = _own(k)
    if measure == "symbols":
        return " ".join(w) + " #" * 12
    if measure == "dup_lines":
        parts = [" ".join(w[i:i + 2]) for i in range(0, 60, 2)]
        return "\n".join([*parts, *parts[:12], *(" ".join(w[i:i + 6]) for i in range(60, 90, 6))])
    if measure == "repeats":
        return " ".join([*w, *w[:15], "between", *w[20:30]])
    return " ".join(x + "qwertz" for x in w)


@pytest.mark.parametrize("measure", list(quality_rules.MEASURES))
def test_every_measure_is_judged_by_its_source(spark, tmp_path, measure):
    """What is usual in one source is an outlier in another."""
    plain_rows = [(k, " ".join(_own(k))) for k in range(300)] + [(900, _with(measure, 900))]
    usual = [(1_000 + k, _with(measure, k)) for k in range(300)]
    write(spark, tmp_path, plain_rows, "a", source="plain", lang="en").unionByName(
        write(spark, tmp_path, usual, "b", source="usual", lang="en")
    ).write.parquet(str(tmp_path / "both"))
    got = quality_rules.document_verdicts(spark.read.parquet(str(tmp_path / "both"))).toPandas().set_index("doc_id")
    assert not got.base_failed.any() and not got.kept[900]
    assert got.kept[[1_000 + k for k in range(300)]].all() and got.kept[list(range(300))].mean() > 0.95


def test_small_groups_use_the_merged_sketch(spark, tmp_path):
    rows = [(i, prose(100, i)) for i in range(300)]
    got = quality_rules.document_verdicts(write(spark, tmp_path, rows + [(999, prose(90) + " $" * 90)])).toPandas().set_index("doc_id")
    assert not got.kept[999] and got.kept[[i for i, _ in rows]].all()


def test_sketches_merge_and_bound_the_error(spark):
    values = [1, 5, 127, 128, 255, 256, 1_000, 70_001, 10**6]
    cols = {f"_{k}": "id" for k in quality_rules.MEASURES}
    frame = spark.createDataFrame([(v,) for v in values * 3], "id long").selectExpr("'l' as _lang", "'s' as _source", *[f"{v} as {k}" for k, v in cols.items()])
    rows = [r for r in quality_rules.sketches(frame).collect() if r.measure == "symbols"]
    assert sum(r.n for r in rows) == 27
    for v in values:
        assert any(r.digits <= v <= r.digits * (1 + 1 / 128) for r in rows)


def test_empty(spark, tmp_path):
    assert quality_rules.document_verdicts(write(spark, tmp_path, [])).count() == 0


def test_query_keeps_good_labels(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = QUERIES["op4_adaptive_quality"](spark, sf).toPandas()
    check(got, list(zip(docs.doc_id, docs.text)))
    labelled = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert labelled[~labelled.base_failed & (labelled.quality == 1)].kept.mean() > 0.97
