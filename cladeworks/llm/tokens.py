"""Token ids of whole texts, equal to the tokenizers library's, with words that were seen before looked up.

A vocabulary that drops white space and never merges across it gives a text the ids of its chunks between ASCII white
space, one after the other. A chunk of printable ASCII and Latin-1 letters is its own NFC form and is cut by a plain
pattern; its pieces go straight to the model of the tokenizer. Any other chunk goes through the whole tokenizer, and
so does a whole text if the tokenizer's file has other rules than these.
"""

from __future__ import annotations

import array
import functools
import json
import re
import sys

import numpy as np

#: Appended to each document.
END_ID = 1
#: Entries that a worker keeps of each kind; beyond, words are encoded again.
KEPT_CHUNKS, KEPT_PIECES, KEPT_LENGTH = 300_000, 400_000, 48

_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The rules that a tokenizer's file must declare for the way by chunks.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class _Pieces(dict):
    def __init__(self, tokenizer):
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        word = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = _bytes([t.id for t in self.model.tokenize(word)])
        if len(self) < KEPT_PIECES and len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids


class _Chunks(dict):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        special = all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.by_chunks = special and all(rules[k] == v for k, v in _RULES.items())

    def whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not (text.isascii() and text.isprintable() or _PLAIN.fullmatch(text)) or "<|" in text:
            ids = self.whole(text)
        elif text.isalpha() and text.isascii():
            ids = self.pieces[text.lower()]
        else:
            ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        if len(self) < KEPT_CHUNKS and len(chunk) <= KEPT_LENGTH:
            self[chunk] = ids
        return ids


@functools.lru_cache(maxsize=2)
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encode(text: bytes, path: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers, the end id included."""
    chunks = _chunks(path)
    if not chunks.by_chunks:
        return chunks.whole(text.decode()) + END_ID.to_bytes(4, "little")
    if text.isascii() and b"<|" not in text:
        text = text.lower()  # as the tokenizer does, so that fewer different words are met
    return b"".join(map(chunks.__getitem__, text.split())) + END_ID.to_bytes(4, "little")
