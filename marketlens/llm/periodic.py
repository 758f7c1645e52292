"""Operator 11: periodic runs of words by online dyadic square catching.

Words are appended to a text in portions.  For every power of two B the text
is cut into blocks of B words, and each completed block has a *catcher*: it
waits for the block's words to come again 2B to 4B - 1 words later (the
smallest blocks, of ``FIRST`` words, for all smaller lags), which is where the
second half of a square of that period has its copy of the block.  A stretch in
which each word equals the word q further on is a chain of squares of period q;
if it is long enough for a reported run, it holds ``CHAIN`` whole blocks in a row, so
only catches that continue over that many blocks are followed.  A
caught chain is then carried on to both sides by suffix comparisons of B/2,
B/4, ..., 1 words, which gives the first and the last word of its run: all
squares of one chain merge into that run.

Blocks are compared by 64-bit names made from exact word numbers; each run is
confirmed word by word, and a lag whose names had met by chance is read again without
names.  Every comparison is done for all blocks and lags of a portion at once.
For a text of n words this makes some 2n comparisons for each power of two up
to n / 6; memory is 8 n bytes for each of them.

A run is a stretch with smallest period q and length >= max(24, 3 q) that no
neighbouring word extends.

Rows: a null or empty text has no words and no runs; null or repeated doc_ids
and repeated rows are read like any others, one row out for one row in; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.text import SPACED, U, mix, slices

LEAST, TIMES = 24, 3  # a run has that many words, and that many periods
FIRST = 4             # words of the smallest blocks
CHAIN = 3             # whole blocks in a row within any stretch of a run
PORTION = 1 << 17     # words appended at a time

#: As the package's word rule, but letters stay as they are.
CASED = np.where(SPACED == 32, 32, np.arange(256)).astype(np.uint8)


class Text:
    """The words of a run of documents: exact numbers and byte bounds.

    ``data``: their bytes, one space or more between any two words and after the
    last; ``start``/``end``: bounds of each word; ``first``: index of
    each document's first word, one more entry closes the last."""

    def __init__(self, docs: list[bytes]):
        self.data = CASED[np.frombuffer(b" ".join(docs) + b" ", np.uint8)]
        filled = self.data != 32
        edge = np.flatnonzero(np.diff(np.concatenate([[0], filled.view(np.int8), [0]])))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])]))
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(self.data[filled])])
        self.ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)

    def joined(self, order: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of these words, a space after each, and where each begins."""
        size = self.end[order] + 1 - self.start[order]
        at = np.concatenate([[0], np.cumsum(size)])
        return memoryview(self.data[np.repeat(self.start[order] - at[:-1], size) + np.arange(at[-1])]), at


class Catchers:
    """The catchers of a growing sequence of word numbers.

    ``append`` takes the next words and moves all catchers on; ``runs`` ends
    the sequence.  ``longest``: no run is longer than that many words."""

    def __init__(self, longest: int):
        self.n = 0
        self.levels = [FIRST]
        while 6 * 2 * self.levels[-1] <= longest:
            self.levels.append(2 * self.levels[-1])
        self.ids = np.zeros(0, np.int64)
        # names[m][i]: of the 2**m words from word i on
        self.names = [np.zeros(0, np.uint64) for _ in range(self.levels[-1].bit_length())]
        self.named = [0] * len(self.names)
        self.read = dict.fromkeys(self.levels, 0)   # blocks whose catchers are done
        self.tail: dict[int, np.ndarray] = {}       # catches of the last CHAIN - 1 of them
        self.caught: dict[int, list] = {b: [] for b in self.levels}

    @staticmethod
    def lags(block: int) -> tuple[int, int]:
        return (1, 4 * block) if block == FIRST else (2 * block, 4 * block)

    def append(self, ids: np.ndarray) -> None:
        if self.n + len(ids) > len(self.ids):
            room = max(self.n + len(ids), 2 * len(self.ids))
            grow = lambda x: np.concatenate([x, np.zeros(room - len(x), x.dtype)])
            self.ids, self.names = grow(self.ids), [grow(x) for x in self.names]
        self.ids[self.n:self.n + len(ids)] = ids
        self.n += len(ids)
        for m, own in enumerate(self.names):
            lo, hi = self.named[m], max(0, self.n - (1 << m) + 1)
            if hi > lo:
                if m:
                    half, below = 1 << (m - 1), self.names[m - 1]
                    own[lo:hi] = mix(below[lo:hi] * U(0xD1342543DE82EF95) + below[lo + half:hi + half])
                else:
                    own[lo:hi] = mix(self.ids[lo:hi].view(np.uint64))
                self.named[m] = hi
        for block in self.levels:
            # catchers that have seen all words they wait for
            self._advance(block, max(0, (self.n - self.lags(block)[1] - block + 1) // block))

    def _advance(self, block: int, upto: int, end: bool = False) -> None:
        lo, hi = self.lags(block)
        k = self.read[block]
        if upto <= k:
            return
        m = block.bit_length() - 1
        names = self.names[m][k * block:self.named[m]]
        if end:
            names = np.concatenate([names, np.zeros(hi + block, np.uint64)])
        rows = upto - k
        later = np.lib.stride_tricks.as_strided(names[lo:], (rows, hi - lo), (8 * block, 8))
        hit = names[:(rows - 1) * block + 1:block, None] == later
        if k:
            hit = np.concatenate([self.tail[block], hit])
        chain = hit[CHAIN - 1:].copy()
        for j in range(CHAIN - 1):
            chain &= hit[j:j + len(chain)]
        at, lag = np.nonzero(chain)
        self.caught[block].append((at + (k - CHAIN + 1 if k else 0), lag + lo))
        self.tail[block] = hit[len(hit) - CHAIN + 1:] if len(hit) >= CHAIN else np.concatenate([np.zeros((CHAIN - 1 - len(hit), hi - lo), bool), hit])
        self.read[block] = upto

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, period) of all runs, sorted."""
        found = []
        for block in self.levels:
            self._advance(block, max(0, (self.n - self.lags(block)[0] - block) // block + 1), end=True)
            at, lag = (np.concatenate(x) for x in zip(*self.caught[block], strict=True)) if self.caught[block] else (np.zeros(0, np.int64),) * 2
            if not len(at):
                continue
            order = np.lexsort((at, lag))
            at, lag = at[order], lag[order]
            new = np.concatenate([[True], (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)])
            last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
            lo, hi, lag = at[new] * block, (last + CHAIN) * block, lag[new]
            for m in range(block.bit_length() - 2, -1, -1):
                step, names, most = 1 << m, self.names[m], self.named[m]
                ok = hi + lag < most
                ok[ok] = names[hi[ok]] == names[hi[ok] + lag[ok]]
                hi = hi + step * ok
                ok = lo >= step
                ok[ok] = names[lo[ok] - step] == names[lo[ok] - step + lag[ok]]
                lo = lo - step * ok
            end = hi + lag
            long = end - lo >= np.maximum(LEAST, TIMES * lag)
            found.append((lo[long], end[long], lag[long]))
        if not found:
            return []
        lo, end, lag = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((lag, end, lo))
        lo, end, lag = lo[order], end[order], lag[order]
        # equal bounds: the larger periods are multiples of the smallest one
        new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (end[1:] != end[:-1])]) if len(lo) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        out, again = set(), set()
        for i in np.flatnonzero(new).tolist():
            run = int(lo[i]), int(end[i]), int(lag[i])
            if self._holds(*run):
                out.add(run)
            else:
                again.update(lag[group == group[i]].tolist())
        if again:
            for q in sorted(again):
                out.update(self._plain(q))
            least: dict[tuple[int, int], int] = {}
            for a, b, q in out:
                least[a, b] = min(q, least.get((a, b), q))
            out = {(a, b, q) for (a, b), q in least.items()}
        return sorted(out)

    def _holds(self, a: int, b: int, q: int) -> bool:
        x, n = self.ids, self.n
        return bool((x[a:b - q] == x[a + q:b]).all()) and (a == 0 or x[a - 1] != x[a - 1 + q]) and (b == n or x[b] != x[b - q])

    def _plain(self, q: int) -> Iterator[tuple[int, int, int]]:
        """The runs of one lag, word by word."""
        same = self.ids[:self.n - q] == self.ids[q:self.n]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        for a, b in zip(edge[0::2].tolist(), (edge[1::2] + q).tolist(), strict=True):
            if b - a >= max(LEAST, TIMES * q):
                yield a, b, q


def catch_runs(documents: list[np.ndarray]) -> dict[int, list[tuple[int, int, int]]]:
    """Index of a document -> its runs as (start, length, period), by start, then period.

    Documents of about the same length share one sequence, each closed
    by a number of its own, which no stretch can cross."""
    classes: dict[int, list[int]] = {}
    for i, ids in enumerate(documents):
        if len(ids) >= LEAST:
            classes.setdefault(len(ids).bit_length(), []).append(i)
    found: dict[int, list] = {}
    for own in classes.values():
        joined = np.concatenate([x for i in own for x in (documents[i], [-1 - i])])
        first = np.concatenate([[0], np.cumsum([len(documents[i]) + 1 for i in own])])
        catchers = Catchers(max(len(documents[i]) for i in own))
        for at in range(0, len(joined), PORTION):
            catchers.append(joined[at:at + PORTION])
        for a, b, q in catchers.runs():
            k = int(np.searchsorted(first, a, side="right")) - 1
            found.setdefault(own[k], []).append((a - int(first[k]), b - a, q))
    return found


def find_runs(docs: DataFrame, plant: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period; by start, then period)
    and ``collapsed``: the words outside the repeated parts of all runs (a
    run's first period stays), joined by single spaces.

    ``plant``: from doc_id and the number of words (a, p) or None; each word from
    a on is replaced by word a + (i - a) % p first (for tests of recall on real texts).
    """
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            text = Text(texts)
            first = text.first
            order = np.arange(len(text.ids))
            if plant:
                for i, doc_id in enumerate(rows.column(0).to_pylist()):
                    lo, hi = int(first[i]), int(first[i + 1])
                    if (where := plant(doc_id, hi - lo)) is not None:
                        a, p = where
                        order[lo + a:hi] = lo + a + np.arange(hi - lo - a) % p
            ids = text.ids[order]
            found = catch_runs([ids[first[i]:first[i + 1]] for i in range(len(texts))])
            kept = np.ones(len(order), bool)
            for i, own in found.items():
                for start, length, period in own:
                    kept[first[i] + start + period:first[i] + start + length] = False
            bytes_, at = text.joined(order[kept])
            bounds = at[np.concatenate([[0], np.cumsum(kept)])[first]].tolist()
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(np.diff(first), pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, ())] for i in range(len(texts))], run),
                pa.array([str(bytes_[lo:max(lo, hi - 1)], "utf-8") for lo, hi in zip(bounds, bounds[1:], strict=False)], pa.string()),
            ], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """One row per row of ``find_runs``: number of runs, the run of greatest
    length / period (ties: smallest start, then period), digests of all runs and of
    the collapsed text."""
    # the array is sorted, so a later run must be greater to replace an earlier one
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
