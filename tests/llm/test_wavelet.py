import random
import zlib

import numpy as np
import pandas as pd
import pytest

from hushframe.llm import tokens, wavelet
from hushframe.llm.queries import QUERIES

from frames import EDGE, write


@pytest.mark.parametrize("n,top", [(0, 5), (1, 2), (7, 2), (512, 300), (1_500, 65_536), (4_097, 70_000)])
def test_matrix_against_the_list(n, top):
    r = random.Random(n)
    ids = [r.randrange(top) if r.random() < 0.7 else 1 for _ in range(n)]
    bits = max(top - 1, 1).bit_length()
    m = wavelet.WaveletMatrix.build(np.array(ids, np.uint32), bits)
    m = wavelet.WaveletMatrix(m.n, m.bits, m.zeros, m.planes.tobytes(), m.ranks.tobytes())
    assert m.decode().tolist() == ids
    for i in r.sample(range(n), min(n, 60)):
        assert m.access(i) == ids[i]
        assert m.count(ids[i], i) == ids[:i].count(ids[i])
        assert m.find(ids[i], ids[:i].count(ids[i])) == i
    for token in {*ids[:40], 0, top - 1, 1 << bits}:
        assert m.positions(token).tolist() == [i for i, v in enumerate(ids) if v == token]
    assert m.count(top - 1) == ids.count(top - 1)
    with pytest.raises(IndexError):
        m.find(1, ids.count(1))


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x in rows]


def check(got, rows):
    want = {}
    for i, ids in expected(rows):
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = got.sort_values("start")
    ids = [None if pd.isna(i) else int(i) for i in got.doc_id]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert list(got.start) == [0, *np.cumsum(got.n_tokens)[:-1]] if len(got) else True
    have = {}
    for i, n, c in zip(ids, got.n_tokens, got.ids_crc32):
        have.setdefault(i, []).append((n, c))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_edges(spark, tmp_path):
    check(wavelet.document_tokens(write(spark, tmp_path, EDGE)).toPandas(), EDGE)


def test_many_shards_and_lookup(spark, tmp_path):
    rows = [(i, f"word{i % 7} and more text {i}") for i in range(300)]
    path = str(tmp_path / "shards")
    wavelet.write_shards(write(spark, tmp_path, rows), path, shard_tokens=100)
    shards = wavelet.read_shards(spark, path)
    assert shards.count() > 10
    starts = {(r.part, r.shard): r.shard_start for r in wavelet.shard_starts(shards).collect()}
    found = sorted(starts[r.part, r.shard] + r.position for r in wavelet.token_positions(shards, 2).collect())
    ends = np.cumsum([len(ids) for _, ids in expected(rows)]) - 1
    assert found == ends.tolist()


def test_ids_and_their_checksum(spark, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(write(spark, tmp_path, EDGE), path, shard_tokens=3_000)
    rows = wavelet.read_documents(wavelet.read_shards(spark, path)).collect()
    assert len(rows) == len(EDGE) and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in rows)


def test_empty(spark, tmp_path):
    assert wavelet.document_tokens(write(spark, tmp_path, [])).count() == 0


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    check(QUERIES["op9_wavelet_tokens"](spark, sf).toPandas(), list(zip(docs.doc_id, docs.text)))
