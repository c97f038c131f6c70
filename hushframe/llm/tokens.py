"""Token ids of whole texts, by the tokenizers library over chunks that repeat.

The byte-level pre-tokenizer cuts a text before any merge is looked at, so a text cut
at those places and encoded chunk by chunk gives the ids of the whole text.  The
vocabulary's added tokens are found before that: with ``added`` a text is cut around
them first and each is its single id, as in an untouched tokenizer.  Chunks
repeat, hence each task keeps the ids of the chunks it has met (a bounded number).
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
from array import array
from collections.abc import Iterable
from functools import lru_cache

# The characters the pre-tokenizer treats as white space.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x24F)
# Chunks end only where the pre-tokenizer always cuts: after a run of Latin letters
# before an ASCII non-letter, after a run without space, and before the last of several
# spaces, which goes with what follows it.
_CHUNK = re.compile(
    rf" ?[{_LATIN}]++(?![^\x00-\x7f])|[ ]?[^{_SPACE}]+|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]+"
)
# Chunks remembered per task before the older half is forgotten.
REMEMBERED = 300_000


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet by its rule: visible bytes stand for themselves, the rest follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {**{b: b for b in visible}, **{b: 256 + k for k, b in enumerate(hidden)}}


class _Memory(dict):
    """Ids per chunk, found on first use."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.find(chunk)
        return ids


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not added
        kind = json.loads(self._tokenizer.to_str())
        # the cuts above hold for this pre-tokenizer; texts for any other are encoded whole
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self._cuts = not kind["normalizer"] and byte_level.items() <= (kind["pre_tokenizer"] or {}).items()
        found = kind["added_tokens"] if added else [t for t in kind["added_tokens"] if not t["special"]]
        self._added = {t["content"]: struct.pack("<I", t["id"]) for t in found}
        # the library takes the longest of the tokens that start first
        self._around = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")
        # tokens that look at what is beside them: texts that hold one are encoded whole
        self._plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found)
        self._model, self._letters = self._tokenizer.model, _byte_letters()
        self._space = chr(self._letters[ord(" ")])
        self.ids = self._tokenizer.get_vocab_size()
        self._older: dict[str, bytes] = {}
        self._recent = _Memory(self._find)

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _find(self, chunk: str) -> bytes:
        ids = self._older.get(chunk)
        if ids is not None:
            return ids
        if not chunk.removeprefix(" ").isalpha():
            return self._whole(chunk)
        # letters alone are one piece for the model, in its byte alphabet; ASCII letters are their own
        spelled = chunk.replace(" ", self._space) if chunk.isascii() else chunk.encode().decode("latin-1").translate(self._letters)
        ids = array("I", [t.id for t in self._model.tokenize(spelled)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        if not self._cuts:
            return [self._whole(text or "") for text in texts]
        out = []
        for text in texts:
            if len(self._recent) > REMEMBERED:
                self._older, self._recent = self._recent, _Memory(self._find)
            text = text or ""
            if not any(token in text for token in self._added):
                out.append(self._chunks(text))
            elif self._plain:
                parts = self._around.split(text)
                out.append(b"".join(self._added[p] if k % 2 else self._chunks(p) for k, p in enumerate(parts)))
            else:
                out.append(self._whole(text))
        return out

    def _chunks(self, text: str) -> bytes:
        return b"".join(map(self._recent.__getitem__, _CHUNK.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> ChunkEncoder:
    """One encoder per worker process."""
    return ChunkEncoder(path, added)
