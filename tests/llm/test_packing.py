import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from hushframe.llm import packing, tokens
from hushframe.llm.queries import QUERIES

from frames import EDGE, write


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts(library):
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "foo", "é", "ß", "²", "½", "1", "23", "_", ".", "...", "'s", "'", "I'm", "ж", "́", "\xa0", "\x85",
            "\x1c", "​", " ", "　", "😀", "<|endoftext|>", "ª", "Ⅷ", "\x00", "Ab", "中"]
    encoder = tokens.encoder(tokens.default_tokenizer())
    r = random.Random(3)
    for _ in range(5_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library(text), repr(text)


def test_forgetting_chunks_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    encoder = tokens.ChunkEncoder(tokens.default_tokenizer())
    texts = [f"one two{i} three four{i % 3} one" for i in range(40)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [library(t) for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_patterns_place_every_length_once(seed):
    r = random.Random(seed)
    histogram = dict(Counter(r.choice([r.randint(1, 1024), r.randint(1, 50), 1024]) for _ in range(r.choice([1, 7, 2_000]))))
    placed = Counter()
    for pattern, count in packing.pack_patterns(histogram, 1024):
        assert count > 0 and sum(pattern) <= 1024
        placed.update({length: 0 for length in pattern})
        for length in pattern:
            placed[length] += count
    assert placed == histogram


def check(got, rows, library, size=1024):
    want = Counter()
    for i, t in rows:
        ids = np.array([*library(t), 0], "<u4")
        for start in range(0, len(ids), size):
            piece = ids[start:start + size]
            want[(i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    ids = [None if pd.isna(i) else int(i) for i in got.doc_id]
    assert Counter(zip(ids, got.start, got.length, got.ids_crc32, got.doc_tokens)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= size
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))


def test_edges(spark, tmp_path, library):
    check(packing.document_pieces(write(spark, tmp_path, EDGE)).toPandas(), EDGE, library)
    check(packing.document_pieces(write(spark, tmp_path, EDGE, "small"), size=16).toPandas(), EDGE, library, 16)


def test_empty(spark, tmp_path):
    assert packing.document_pieces(write(spark, tmp_path, [])).count() == 0


def test_sequences_round_trip(spark, tmp_path, library):
    pieces = packing.cut_pieces(write(spark, tmp_path, EDGE), 64)
    packed = packing.pack(pieces, 64).cache()
    rows = {r.sequence_id: r for r in packing.sequences(packed, 64).collect()}
    for p in packed.collect():
        row = rows[p.sequence_id]
        ids = np.frombuffer(row.ids, "<u4")
        assert len(ids) == (row.tokens if row.tokens & (row.tokens - 1) == 0 else 64)
        assert ids[p.offset:p.offset + p.length].tobytes() == bytes(p.ids)
        assert not ids[row.tokens:].any()
    packed.unpersist()


def test_query(spark, sf, library):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = QUERIES["op5_histogram_packing"](spark, sf).toPandas()
    check(got, list(zip(docs.doc_id, docs.text)), library)
    assert got.length.sum() > 0.97 * 1024 * got.sequence_id.nunique()
