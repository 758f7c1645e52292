"""Operator 10: harmonic packing of documents into token sequences.

Harmonic packing sorts items into classes by reciprocal capacity and fills the
bins of class k with exactly k items: a document of class k has more than
capacity / (k + 1) and at most capacity / k ids, so k of them always fit.  Of a
longer document whole sequences are cut first, its rest is an item.  What k
documents leave of a bin is filled by cutting documents that are set aside for
that, one sequence's worth at least, so every bin is full and holds at most one
document that goes on in the next.

Each task packs the rows of its own partition and nothing is shuffled.  It holds
less than one bin for each class (about 90 classes have members at a capacity of 2048).
At its end what is left is joined and cut into full sequences, and the last rest
by its binary digits: sequences of a power of two are not padded.

Rows: a null text is empty and holds the end id only; a null or repeated
doc_id, repeated rows and ties are packed like any others, one document a row;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.text import slices
from marketlens.llm.tokens import part_ids, vocabulary_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece(NamedTuple):
    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])


class Bins:
    """The open bins of one task; ``add`` and ``rest`` give the sequences that
    become full, each a list of pieces in their order."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[Piece]] = {}
        self.aside: deque[Piece] = deque()
        self.spare = 0  # ids set aside

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        whole = len(ids) - len(ids) % self.capacity
        for at in range(0, whole, self.capacity):
            yield [Piece(doc, at, ids[at:at + self.capacity], len(ids))]
        if whole == len(ids):
            return
        item = Piece(doc, whole, ids[whole:].copy(), len(ids))  # no view that keeps a long document
        if self.spare < self.capacity:
            self._set_aside([item])
            return
        k = self.capacity // len(item.ids)
        waiting = self.open.setdefault(k, [])
        waiting.append(item)
        if len(waiting) == k:
            del self.open[k]
            # less than one sequence is missing, and one at least is set aside
            yield waiting + self._take(self.capacity - sum(len(p.ids) for p in waiting))

    def _set_aside(self, pieces: list[Piece]) -> None:
        self.aside.extend(pieces)
        self.spare += sum(len(p.ids) for p in pieces)

    def _take(self, n: int) -> list[Piece]:
        """The first n ids that are set aside."""
        out = []
        self.spare -= n
        while n:
            piece = self.aside.popleft()
            if len(piece.ids) > n:
                piece, after = piece.split(n)
                self.aside.appendleft(after)
            out.append(piece)
            n -= len(piece.ids)
        return out

    def rest(self) -> Iterator[list[Piece]]:
        for k in sorted(self.open):
            self._set_aside(self.open.pop(k))
        while self.spare >= self.capacity:
            yield self._take(self.capacity)
        for bit in reversed(range(self.spare.bit_length())):
            if self.spare >> bit & 1:
                yield self._take(1 << bit)


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in sequences.

    Columns as in ``PIECES``; ``with_ids`` adds ``ids``, the piece's token ids.
    ``sequence_id`` is the task's partition number * 2**40 + a count, ``offset``
    the piece's place in the sequence; a sequence that is not full has a power of two
    of ids, so nothing is padded.  The partitions are those of ``docs``:
    scan partitions hold the same rows in the same order when a task runs again.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    path = vocabulary or vocabulary_path()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields + [("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        known, bins, made = part_ids(path), Bins(capacity), 0

        def rows(sequences: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal made
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    row = (p.doc, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens)
                    yield (*row, *([p.ids.astype("i4")] if with_ids else []), first + made, offset)
                    offset += len(p.ids)
                made += 1

        def batch(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for run, texts in slices(batches, budget=4 << 20, hold=True):
            ids, bounds = known.texts(texts)
            out = []
            for doc, lo, hi in zip(run.column(run.schema.get_field_index("doc_id")).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out += rows(bins.add(doc, np.append(ids[lo:hi], end_id).astype("<u4")))
                if len(out) >= 50_000:
                    yield batch(out)
                    out = []
            yield batch(out)
        yield batch(list(rows(bins.rest())))

    columns = PIECES.replace("sequence_id", "ids array<int>, sequence_id") if with_ids else PIECES
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, columns)
