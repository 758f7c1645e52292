"""Word splitting and hashing over Arrow batches, vectorised with numpy.

Texts are handled as UTF-8 bytes.  Both word rules of the package cut only at
ASCII bytes, so a byte-wise table is exact for any UTF-8 text:

* ``ALNUM``: words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z
  (ASCII letters and digits, and everything outside ASCII);
* ``SPACED``: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit over the output."""
    x = x + _A
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * _C
    return x ^ (x >> U(31))


def _word_table(is_word) -> np.ndarray:
    """Byte -> lower-cased byte, or a space where the byte ends a word."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[c for c in range(256) if not is_word(c)]] = 32
    return t


_UPPER = range(65, 91)
ALNUM = _word_table(lambda c: c >= 0x80 or c in _UPPER or 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39)
SPACED = _word_table(lambda c: c != 0x20 and not 9 <= c <= 13)

_BYTE = mix(np.arange(256, dtype=np.uint64) * U(0x1000193) + U(7)) | U(1)
_STEP = 0x5851F42D4C957F2D
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int):
    """Powers of the rolling base and of its inverse modulo 2**64, up to n."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        _POW, _INV = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b % 2**64, np.uint64)]))
                      for b in (_STEP, pow(_STEP, -1, 2**64)))
    return _POW[:n], _INV[:n]


class Words:
    """The words of a run of documents.

    ``data``: the normalised bytes of all documents, a space after each;
    ``start``/``end``: byte bounds of each word; ``first``: index of each
    document's first word, one more entry closes the last; ``hash``: 64 bits
    per word, a polynomial of its bytes.  Texts can be built whose words meet in it;
    where no words are compared afterwards, ``spelled`` with a key is used instead.
    """

    def __init__(self, docs: list[bytes], table: np.ndarray):
        raw = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
        self._index(table[raw], np.concatenate([[0], np.cumsum(np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs)))]))

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray) -> Words:
        """The words of normalised bytes (a space between any two words) and the documents' bounds in them."""
        out = cls.__new__(cls)
        out._index(data, bounds)
        return out

    def _index(self, norm: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds = norm, bounds
        # normalised spaces are exactly the separators: a word never holds one
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (norm != 32).view(np.int8), [0]])))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, bounds)
        power, inverse = _powers(len(norm) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[norm] * power[:len(norm)], dtype=np.uint64)])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode()

    def spelled(self, key: int) -> np.ndarray:
        """64 keyed bits per word: its pieces of 8 bytes, each mixed in turn; BLAKE2b for words of over 64 bytes."""
        length = self.end - self.start
        out = mix(length.astype(np.uint64) ^ U(key))
        data = np.concatenate([self.data, np.zeros(8, np.uint8)])
        now = np.flatnonzero(length <= 64)
        for at in range(0, 64, 8):
            now = now[length[now] > at]
            piece = data[(self.start[now] + at)[:, None] + np.arange(8)].view("<u8").ravel()
            unused = U(8) * (8 - np.minimum(length[now] - at, 8)).astype(np.uint64)
            out[now] = mix(out[now] ^ (piece << unused))
        for i in np.flatnonzero(length > 64).tolist():
            digest = blake2b(self.data[self.start[i]:self.end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def grams(self, k: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """Hash of the k words from each word on (those that cross the end of
        a document are present, and meaningless)."""
        hashes = self.hash if hashes is None else hashes
        n = max(0, len(hashes) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * U(0xD1342543DE82EF95) + hashes[j:j + n]
        return mix(out ^ U(k))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [b or b"" for b in column.to_pylist()]


#: Tables that a Python worker keeps from task to task for one kind of work.
HELD: list[dict] = []

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library, which has no such call
    _trim = None


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = 1 << 20, hold: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts batches into row runs of about ``budget`` text bytes (one long text
    is a run of its own), so that numpy work per run stays bounded.

    Workers go on to other stages; without ``hold`` the tables that an earlier
    kind of work left in the worker are given back first."""
    if not hold:
        for held in HELD:
            held.clear()
    give_back()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = done = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, done + budget, side="right")))
            yield batch.slice(lo, hi - lo), byte_texts(texts.slice(lo, hi - lo))
            lo, done = hi, int(ends[hi - 1])
        pa.default_memory_pool().release_unused()  # the next batch may be smaller
    give_back()
