"""Token ids of whole texts by the tokenizers library, with a bounded cache of the chunks between white space.

The tokenizer's pre-tokenizer never joins characters across ASCII white space and its normalizer
leaves white space alone, so a text's ids are those of its chunks one after another. `exact_chunks`
holds that for a tokenizer before the cache is used; others are given whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT

#: Chunks of the young cache; when it is full it becomes the elder one, whose entries go unless used again. About 190 bytes each.
CACHE_CHUNKS = 400_000
#: Longer chunks are encoded each time they come.
CACHE_CHARS = 64
#: Characters of text split at a time; a longer text is a slice of its own.
SLICE_CHARS = 2_000_000
_PROBE = "Don't  stop\tat 12,345 cafés; Élèves ́ ΙΣ x<|endoftext|>y ​ \n à 'S ẞ--()"

#: Words of Latin letters that normalisation only lower-cases, and ASCII marks after them.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,40})([!-/:-@\\[-`{-~]{0,4})").fullmatch
_BYTES = {c: "".join(chr(b if 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF else 323 if b == 0xAD else 256 + b - 94) for b in chr(c).encode()) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
_WORDS = ["The", "onventional", "q", "Zürich", "éàçñöüßÿ", "ÀÉÎÕÜÞØÿ", *map(chr, _BYTES)]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        whole = self.tokenizer.encode(_PROBE, add_special_tokens=False).ids
        parts = [i for x in _PROBE.encode().split() for i in self.tokenizer.encode(x.decode(), add_special_tokens=False).ids]
        self.exact_chunks = whole == parts
        self.model = self.tokenizer.model
        self.marks: dict[str, bytes] = {}
        one = self._one
        self.plain = all(one(w + m) == self._word(w.lower()) + (self._mark(m) if m else b"") for w in _WORDS for m in ("", ".", ",", "!!", "***", "'", "7"))

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; null is the empty text."""
        if not self.exact_chunks:
            got = self.tokenizer.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)
            return [np.array(x.ids, np.uint32) for x in got]
        return self._joined(texts)

    def _joined(self, texts: list[str | None]) -> list[np.ndarray]:
        """Chunks are numbered by Arrow; Python sees each distinct chunk of the batch once."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size == 0 or size + len(texts[stop] or "") <= SLICE_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            out += self._slice(texts[at:stop])
            at = stop
        return out

    def _slice(self, texts: list[str | None]) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array([x or "" for x in texts], pa.large_string()))
        coded = split.values.dictionary_encode()
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())  # many times faster than to_pylist()
        n = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        chunk = coded.indices.to_numpy(zero_copy_only=False)
        each = n[chunk]
        ends = np.cumsum(each, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total < 1 << 31 and len(flat) < 1 << 31 else np.int64
        move = (np.cumsum(n, dtype=np.int64) - n)[chunk] - (ends - each)
        got = flat[np.repeat(move.astype(kind), each) + np.arange(total, dtype=kind)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [got[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks: from the young cache, the elder one, or the library."""
        if len(self.young) > CACHE_CHUNKS:
            self.elder, self.young = self.young, {}
        young, elder = self.young, self.elder
        got = list(map(young.get, chunks))
        todo = []
        for i in [i for i, x in enumerate(got) if x is None]:
            c = chunks[i]
            x = elder.get(c)
            if x is not None:
                got[i] = young[c] = x
                continue
            # a word and marks behind it are pre-tokens of their own; the word is kept in lower case
            if not self.plain or len(c) > CACHE_CHARS:
                todo.append(i)
                continue
            if c.isascii() and c.isalpha():
                w, mark = c.lower(), ""
            elif c.isascii() and c[:-1].isalpha():
                w, mark = c[:-1].lower(), c[-1]
            elif m := _PLAIN(c):
                w, mark = m.groups()
                w = w.lower()
            else:
                todo.append(i)
                continue
            x = young.get(w)
            if x is None:
                x = young[w] = elder.get(w) or self._word(w)
            got[i] = x + self._mark(mark) if mark else x
        for k in range(0, len(todo), 10_000):
            part = todo[k : k + 10_000]
            new = self.tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)
            for i, x in zip(part, new, strict=True):
                got[i] = array("I", x.ids).tobytes()
                if len(chunks[i]) <= CACHE_CHARS:
                    young[chunks[i]] = got[i]
        return got

    def _mark(self, mark: str) -> bytes:
        got = self.marks.get(mark)
        if got is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            got = self.marks[mark] = self._one(mark)
        return got

    def _one(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, w: str) -> bytes:
        """Ids of a lower-case word by the library's model, which sees bytes as the byte-level step writes them."""
        return array("I", [t.id for t in self.model.tokenize(w if w.isascii() else w.translate(_BYTES))]).tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The worker's encoder; its vocabulary and chunks (up to 200 MB) stay for tasks that slice with keep="encoder" and go with the first other one."""
    KEPT["encoder"] = _encoder.cache_clear
    return _encoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
