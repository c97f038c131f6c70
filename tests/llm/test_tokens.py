"""Ids against a tokenizer as the file gives it, added tokens included."""

import json
import random
import zlib

import numpy as np
import pytest

from hushframe.llm import packing, tokens, wavelet

from frames import write

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "one<|endoftext|>\n\n two<|endoftext", None, "plain"]


def untouched(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def ids(encoder, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]


def test_added_tokens_are_single_ids():
    path = tokens.default_tokenizer()
    encoder, library = tokens.encoder(path, added=True), untouched(path)
    assert ids(encoder, TEXTS[:1]) == [[64, 220, 50256, 275]]
    r = random.Random(6)
    bits = [" ", "  ", "\n", "a", "foo", "é", "'s", "1", "<|", "|>", "endoftext", "<|endoftext|>", "<|endoftext|>", "\xa0"]
    texts = TEXTS + ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3_000)]
    assert ids(encoder, texts) == [library(t) for t in texts]


@pytest.mark.parametrize("more", [{"lstrip": True, "rstrip": True}, {"single_word": True}, {"special": False}])
def test_other_added_tokens(tmp_path, more):
    kind = json.load(open(tokens.default_tokenizer()))
    kind["added_tokens"] += [{**kind["added_tokens"][0], "id": 50257 + k, "content": c, **more} for k, c in enumerate(["<x>", "<x>y"])]
    path = str(tmp_path / "more.json")
    json.dump(kind, open(path, "w"))
    texts = ["a <x> b", "<x>y", "a<x>yb <x>", "a <|endoftext|> <x>"]
    assert ids(tokens.ChunkEncoder(path, added=True), texts) == [untouched(path)(t) for t in texts]


def test_queries_use_them(spark, tmp_path):
    docs, library = write(spark, tmp_path, list(enumerate(TEXTS))), untouched(tokens.default_tokenizer())
    want = {i: np.array(library(t), "<u4") for i, t in enumerate(TEXTS)}
    crc = lambda i, end: zlib.crc32(np.append(want[i], end).astype("<u4").tobytes())
    packed = packing.document_pieces(docs).collect()
    assert {(r.doc_id, r.doc_tokens, r.ids_crc32) for r in packed} == {(i, len(w) + 1, crc(i, packing.END)) for i, w in want.items()}
    waved = wavelet.document_tokens(docs).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in waved} == {(i, len(w) + 1, crc(i, 2)) for i, w in want.items()}
