"""Token ids of whole texts by a public tokenizer file, with distinct words encoded once per batch.

The tokenizer drops white space and never joins characters across it, so a text's ids are those of
its parts between blanks, in order. Parts are found with arrays, each distinct one is encoded once
per slice, and a two-generation cache keeps what a worker has met. Words of plain Latin letters go
straight to the BPE model after the lower-casing and byte mapping that the file prescribes; all
others go through the whole tokenizer. Tests compare the ids with the tokenizer's own.
"""

from __future__ import annotations

import os
import re

import numpy as np

from fleetvitals.llm import _text

CACHED_PARTS = 350_000
#: Bytes of encoded parts that outlive a task.
KEPT_BYTES = 48 << 20

#: Space and line feed part a text; other white space stays in a part and is left to the tokenizer.
_PART = np.ones(256, bool)
_PART[[10, 32]] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+")


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies name a printable byte by its own character, and the
    others, in order, by the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.names = _byte_names()
        self.young: dict[bytes, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Leaves one generation of parts of at most ``KEPT_BYTES`` to the worker's next task."""
        self.hash_a, self.hash_b = _text.Hasher(21), _text.Hasher(22)
        self.old: dict[bytes, bytes] = {}
        if sum(len(k) + len(v) + 180 for k, v in self.young.items()) > KEPT_BYTES:
            self.young = {}

    def _parts(self, t: _text.Texts) -> _text.Words:
        """Parts between blanks; a last comma or full stop after an ASCII letter is its own part."""
        w = _text.words(t, _PART)
        last = t.data[w.end - 1]
        cut = ((last == 44) | (last == 46)) & (w.end - w.start > 1)
        cut &= _LETTER[t.data[np.maximum(w.end - 2, 0)]]
        at = np.flatnonzero(cut)
        end = w.end.copy()
        end[at] -= 1
        start = np.insert(w.start, at + 1, w.end[at] - 1)
        return _text.Words(start, np.insert(end, at + 1, w.end[at]), np.searchsorted(start, t.offsets))

    def _new(self, parts: list[bytes]) -> None:
        if len(self.young) + len(parts) > CACHED_PARTS:
            self.old, self.young = self.young, {}
        other = []
        for part in parts:
            word = part.decode("utf-8", "replace")
            if _LATIN.fullmatch(word):
                word = word.lower()
                named = word if word.isascii() else word.encode().decode("latin-1").translate(self.names)
                self.young[part] = np.array([x.id for x in self.model.tokenize(named)], np.uint32).tobytes()
            else:
                other.append((part, word))
        for at in range(0, len(other), 5000):
            some = other[at : at + 5000]
            for (part, _), e in zip(some, self.tokenizer.encode_batch_fast([w for _, w in some], add_special_tokens=False)):
                self.young[part] = np.array(e.ids, np.uint32).tobytes()

    def encode(self, t: _text.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the n + 1 offsets of each text's."""
        w = self._parts(t)
        if not len(w):
            return np.empty(0, np.uint32), np.zeros(len(t.offsets), np.int64)
        a, b = (h.of(t.data, w.start, w.end) for h in (self.hash_a, self.hash_b))
        _, first, which = np.unique(a, return_index=True, return_inverse=True)
        if not np.array_equal(b[first][which], b):  # two parts share a hash
            pair = np.rec.fromarrays([a, b])
            _, first, which = np.unique(pair, return_index=True, return_inverse=True)
        parts = [t.data[s:e].tobytes() for s, e in zip(w.start[first].tolist(), w.end[first].tolist())]
        found: list[bytes | None] = []
        for part in parts:
            ids = self.young.get(part)
            if ids is None and (ids := self.old.get(part)) is not None:
                self.young[part] = ids
            found.append(ids)
        missing = [p for p, ids in zip(parts, found) if ids is None]
        if missing:
            self._new(missing)
            young = self.young
            found = [young[p] if ids is None else ids for p, ids in zip(parts, found)]
        size = np.fromiter((len(x) >> 2 for x in found), np.int64, len(found))
        flat = np.frombuffer(b"".join(found), np.uint32)
        begin = np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[which] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[w.first]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
