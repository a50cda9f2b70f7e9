"""Ids of a public BPE tokenizer by way of a cache of white-space chunks.

The tokenizer drops white space and never merges over it, so a text's ids are
those of its chunks in turn. It lower-cases, and a mark after a letter is a token of its own, so texts are
lower-cased in ASCII and such marks parted from their words as a whole: fewer chunks differ.
Most chunks of a corpus repeat; each is encoded once
while it stays in a two-generation cache of bounded size.
"""

from __future__ import annotations

import os
from array import array
from unicodedata import normalize

import numpy as np

GENERATION = 150_000
_MARKS, _SPACES = (np.isin(np.arange(256), list(x)) for x in (b".,;:!?", b" \t\n\r\x0b\x0c"))
_ASCII_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
#: Second bytes of the Latin-1 letters, which all begin with 0xC3.
_LATIN_LETTER = np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])


def _letters(chunk: bytes) -> bool:
    """Whether the tokenizer sees nothing but letters in a chunk."""
    return chunk.isalpha() or not chunk.isascii() and normalize("NFC", chunk.decode("utf-8", "replace")).lower().isalpha()


def _chunks(texts: list[bytes]) -> list[list[bytes]]:
    """Each text's chunks, in lower case (ASCII) and without a mark between a letter and white space, which is a chunk of its own."""
    whole = b"\n".join(texts)
    if b"<|" in whole:  # special tokens are told by their own case
        return [t.split() if b"<|" in t else _chunks([t])[0] for t in texts]
    data = np.frombuffer(b"  " + whole.lower() + b"\n", np.uint8)
    at = np.flatnonzero(_MARKS[data])
    letter = _ASCII_LETTER[data[at - 1]] | (_LATIN_LETTER[data[at - 1]] & (data[at - 2] == 0xC3))
    at = at[letter & _SPACES[data[at + 1]]]
    first = 2 + np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = (first + np.searchsorted(at, first)).tolist()
    parted = np.insert(data, at, 32).tobytes()
    return [parted[a:b].split() for a, b in zip(first[:-1], first[1:], strict=True)]


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.is_end[i] = token.endswith("</w>")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode_words(self, words: list[bytes]) -> None:
        """Many words of letters in one text: each ends with the one token of its own that has the vocabulary's end mark."""
        for k in range(0, len(words), 4_000):
            some = words[k : k + 4_000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some):  # else they are encoded one by one
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                self.young.update(zip(some, (raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))

    def _learn(self, chunks: set[bytes]) -> None:
        young, old = self.young, self.old
        kept = chunks & old.keys()
        young.update(zip(kept, map(old.__getitem__, kept), strict=True))
        new = chunks - kept
        self._encode_words([x for x in new if _letters(x)])
        rest = [x for x in new if x not in young]
        for k in range(0, len(rest), 20_000):
            some = rest[k : k + 20_000]
            for c, e in zip(some, self._encode([x.decode() for x in some], add_special_tokens=False), strict=True):
                young[c] = array("I", e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = _chunks(texts)
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        missing = set().union(*split) - self.young.keys() if split else set()
        if missing:
            self._learn(missing)
        get = self.young.__getitem__
        return [b"".join(map(get, s)) for s in split]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
