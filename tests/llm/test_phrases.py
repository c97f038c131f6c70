"""Phrases against a plain count of all word sequences."""

import random
import re
from collections import Counter, defaultdict

import pytest

from hushframe.llm import phrases
from frames import EDGE, write
from plain import ascii_lower

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top):
    """``rows``: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        ranked = []
        for p, a in found.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            longer = [c for q, c in found.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if all(100 * c < 50 * a for c in longer):
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def sample(seed=5, docs=150):
    rng = random.Random(seed)
    words = ["New", "york", "city", "é€", "a", "b", "c", "d-e", "\x1cx", " y"]
    seps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(60))) for _ in range(docs)]
    return [(k, t + " New York City, " * (k % 4)) for k, t in enumerate(texts)]


def rows_of(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


# few bits make most fingerprints collide; a small block makes many rows for one phrase
@pytest.mark.parametrize("bits, block", [(64, phrases.BLOCK), (5, 400), (8, 50), (1, 3_000)])
def test_equals_plain_count(spark, tmp_path, bits, block):
    docs = write(spark, tmp_path, sample() + EDGE)
    plain = brute([(r.lang, r.text) for r in docs.collect()], 10, 40)
    got = phrases.collocations(docs, top=40, bits=bits, block=block)
    assert got.columns == COLUMNS
    assert rows_of(got) == plain and len(plain) > 40


def test_segments_join_to_the_whole_text():
    for _, text in sample() + EDGE:
        whole = list(phrases.segments(text))
        for size in (1, 7, 100):
            parts = list(phrases.segments(text, size))
            assert [t for p in parts for t in p] == [t for p in whole for t in p]
            assert all(p[-1] == phrases.CUT for p in parts[:-1])


def test_hot_language_and_long_text(spark, tmp_path):
    rows = [(k, t) for k, t in sample(7, 60)] + [(100, "one two three four. " * 20_000)]
    docs = write(spark, tmp_path, rows, lang="xx")
    assert rows_of(phrases.collocations(docs, block=5_000)) == brute([("xx", t) for _, t in rows], 10, 2_000)


def test_counts_beyond_64_bits(spark):
    big = 4_000_000_000
    counts = spark.createDataFrame([("x", 1, "a", big), ("x", 1, "b", big + 1), ("x", 2, "a b", big - 1)], "lang string, n int, phrase string, f long")
    assert phrases.scored(counts).first().score == 10**6 * (big - 1) ** 2 // (big * (big + 1))


def test_empty_and_extra_columns(spark, tmp_path):
    docs = write(spark, tmp_path, sample())
    same = rows_of(phrases.collocations(docs))
    for name in ("empty", "extra"):
        df = docs.limit(0) if name == "empty" else docs.selectExpr("*", "doc_id as row", "text as phrase", "lang as n", "'x' as _row", "1 as at", "2 as f")
        df.write.parquet(str(tmp_path / name))
        assert rows_of(phrases.collocations(spark.read.parquet(str(tmp_path / name)))) == (set() if name == "empty" else same)
