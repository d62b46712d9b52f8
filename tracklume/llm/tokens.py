"""Token ids of whole texts with a public tokenizer, by distinct pieces.

A byte-level BPE first cuts a text with a fixed pattern and then merges inside each cut.  Texts are cut here at a
subset of those places (where a run of white space begins, and between a letter and the punctuation after it), each
distinct piece goes through the tokenizer once per worker, and ids are put together by position.  The cuts are places
where the pattern always cuts, so the ids are those of the whole text.  Texts with white space outside ASCII's four usual
characters, or with the text of a special token, are encoded as they are.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tracklume.llm.text import ALL_VALUES, flat, return_memory, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

_UNUSUAL = rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_ONE_CUT = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[.,;:!?]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        gc.collect()  # an earlier task's encoder may still be around
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def finished() -> None:
    """At the end of a task: the encoder stays for the next one, freed memory goes back."""
    gc.collect()
    return_memory()


def _byte_letters() -> dict[int, str]:
    """How a byte-level BPE writes bytes as printable characters: by rule, printable Latin-1 stays."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``begin[i]`` to ``begin[i] + length[i]``, one after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(begin - before, length)


class Encoder:
    """Keeps the ids of distinct pieces, and their bytes; forgets them all when there are more than ``most``."""

    def __init__(self, path: str, most: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most = most
        specials = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = re.compile(b"|".join([_UNUSUAL, *specials]))
        self.letters = _byte_letters()
        self._forget()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)  # of the key's ids among all kept ids
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int32)  # of the key's bytes among all kept bytes
        self.size = np.zeros(0, np.int32)
        self.bytes = np.zeros(0, np.uint8)

    @property
    def narrow(self) -> bool:
        """Ids fit in 16 bits."""
        return self.tokenizer.get_vocab_size() <= 1 << 16

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and the number of ids of each."""
        single = np.fromiter((_ONE_CUT.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        found: list = [None] * len(pieces)
        # nothing to cut: straight to the merges, written in the tokenizer's own letters
        at = np.flatnonzero(single).tolist()
        merge = self.model.tokenize
        written = b"\n".join([pieces[i] for i in at]).decode("latin-1").split("\n")
        for i, piece in zip(at, [w.translate(self.letters) for w in written], strict=len(at) > 0):
            found[i] = [t.id for t in merge(piece)]
        others = np.flatnonzero(~single).tolist()
        for i, encoding in zip(others, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in others], add_special_tokens=False), strict=True):
            found[i] = encoding.ids
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), length

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.keys) + len(keys) > self.most:
            self._forget()
        ids, length = self._encoded(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = len(self.ids) + np.cumsum(length) - length
        start = len(self.bytes) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.place, self.length = np.insert(self.place, at, place), np.insert(self.length, at, length)
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(data)
        space = _SPACE[data]
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = np.zeros(n, bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (_POINT[data[1:]] & letter[:-1])
        alone = (data == 10) & cut  # a line break as the first white space of its run, with a letter after it
        cut[1:] |= alone[:-1] & _LETTER[data[1:]]
        begins = offsets[:-1][np.diff(offsets) > 0]
        cut[begins] = True
        return np.flatnonzero(cut)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after the other, and the number of ids of each; null is empty."""
        data, offsets = flat(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        raw = data.tobytes()
        odd = sorted({int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in self.unusual.finditer(raw)})
        starts = self._cuts(data, offsets)
        hashes = span_hashes(data, starts, ALL_VALUES)
        keys, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(data))
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self._learn(keys[new], [raw[starts[i] : ends[i]] for i in first[new]])
            if not np.array_equal(self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)], keys):
                self._learn_all(keys, [raw[starts[i] : ends[i]] for i in first])
            at = np.searchsorted(self.keys, keys)
        at = at[of]
        length = self.length[at].astype(np.int64)
        # equal hashes are not taken for equal pieces: every piece is compared with the bytes kept under its hash
        size = ends - starts
        unlike = self.size[at] != size
        if not unlike.any():
            wrong = np.flatnonzero(self.bytes[_ranges(self.start[at].astype(np.int64), size)] != data[starts[0] :])
            unlike[np.searchsorted(starts, wrong + starts[0], side="right") - 1] = True
        if unlike.any():
            odd = sorted({*odd, *(np.searchsorted(offsets, starts[unlike], side="right") - 1).tolist()})
        ids = self.ids[_ranges(self.place[at].astype(np.int64), length)]
        before = np.concatenate([[0], np.cumsum(length)])
        counts = np.diff(before[np.searchsorted(starts, offsets)])
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                text = raw[offsets[i] : offsets[i + 1]].decode()
                parts[i] = np.asarray(self._plain(text), np.uint32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts).astype(np.uint32)
        return ids, counts

    def _learn_all(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        self._forget()
        most, self.most = self.most, max(self.most, len(keys))
        self._learn(keys, pieces)
        self.most = most
