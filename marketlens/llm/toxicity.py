"""Operator 5: toxicity by a subsequence string-kernel machine.

The kernel of two strings sums, over all subsequences of ``ORDER`` letters that
span at most ``SPAN`` letters in each, the product of DECAY**span on both sides;
it is normalised.  Letters between those of a subsequence only weaken it, so
an insult with inserted letters still resembles itself; marks and digits inside
a word are left out before, so ``i-d.i0t`` keeps its letters, and runs of
single letters count as one more string.  The strings are the words of labelled
sentences.

Fit: a sentence of a harmless document labels all its words harmless; of a
toxic document at least one word is to blame, taken to be those most tied to
toxic documents, beyond what chance explains (witnesses).  ``LANDMARKS`` of these strings span a Nyström
feature space, in which a linear support vector machine with squared hinge loss
is solved by Newton steps.  Its normal vector folds back into one weight per
subsequence, so scoring needs no kernel evaluations: a string's value is the sum
of its subsequences' weights over its norm, a document's the largest of its strings', and a logistic curve
fitted on the training documents turns it into a score.

The fit sees at most ``SAMPLE`` labelled rows of each label, those of smallest
hashed doc_id, none of which has crc32(doc_id as text) mod 5 = 0; of their
words at most ``STRINGS`` of each label reach the driver, and in each further
round a quarter as many harmless ones, those of the largest values so far.  Scoring reads every
document whole, in one pass without a shuffle.

Rows: a null or empty text has no strings and gets the lowest score; labels
without a toxic value are ignored; a doc_id that several texts or label
rows share trains with one text (the least) for each label; documents that are repeated, unlabelled or without a doc_id are scored like any others; without
labels of both kinds every document gets the share of toxic ones (0 without labels) as
its score; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import cut
from marketlens.llm.text import slices

ORDER, SPAN, DECAY = 4, 6, 0.75
SAMPLE, STRINGS, LANDMARKS = 4000, 12_000, 512
ROUNDS = 3  # of the fit, each with the worst harmless strings under the last one
LONGEST = 64  # letters of one string; a longer word is scored in overlapping pieces

#: ASCII letter -> code 1 to 26, 0 for what is left out; code 31 stands before the
#: first letter of each string.  A character outside ASCII gets one of the codes 1 to 30
#: by its number, so neighbours in an alphabet differ.
_CODE = np.zeros(256, np.uint8)
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[10] = 31
_PLACES = [(0, *c) for c in combinations(range(1, SPAN), ORDER - 1)]
_MASS = [DECAY ** (c[-1] + 1) for c in _PLACES]
LOWEST = -9.0


def letters(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all strings in a row, and each string's bounds."""
    raw = np.frombuffer(b"".join(b"\n" + x for x in strings), np.uint8)  # no string holds a line end
    code = _CODE[raw]
    after = np.flatnonzero((raw[:-1] & 0xC0 == 0x80) & (raw[1:] & 0xC0 != 0x80))  # the last byte of each such character
    if raw[-1:].size and raw[-1] & 0xC0 == 0x80:
        after = np.append(after, len(raw) - 1)
    code[after] = 1 + (raw[after - 1].astype(np.int64) * 64 + (raw[after] & 63)) % 30
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)) + 1)])
    return code[code > 0], np.concatenate([[0], np.cumsum(code > 0)])[at]


def subsequences(code: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(string, subsequence number, mass) of all subsequences, one pattern of places at a time."""
    string = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    code = code.astype(np.int32)
    for places, mass in zip(_PLACES, _MASS, strict=True):
        n = len(code) - places[-1]
        if n <= 0:
            continue
        inside = np.flatnonzero(string[:n] == string[places[-1]:places[-1] + n])
        number = code[inside]
        for p in places[1:]:
            number = (number << 5) | code[inside + p]
        yield string[inside], number, mass


def values(strings: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Sum of the subsequences' weights over the norm, for each string."""
    code, bounds = letters(strings)
    total, norm = np.zeros(len(strings)), np.zeros(len(strings))
    for string, number, mass in subsequences(code, bounds):
        total += np.bincount(string, weights[number], len(strings)) * mass
        norm += np.bincount(string, minlength=len(strings)) * mass * mass
    return total / np.sqrt(np.maximum(norm, 1e-12))


def kernel_rows(strings: list[bytes], known: np.ndarray) -> np.ndarray:
    """Normalised feature vectors over the subsequences in ``known`` (sorted)."""
    code, bounds = letters(strings)
    out, norm = np.zeros((len(strings), len(known)), np.float32), np.zeros(len(strings))
    for string, number, mass in subsequences(code, bounds):
        norm += np.bincount(string, minlength=len(strings)) * mass * mass
        at = np.searchsorted(known, number)
        at[at == len(known)] = 0
        hit = known[at] == number
        np.add.at(out, (string[hit], at[hit]), mass)
    return out / np.sqrt(np.maximum(norm, 1e-12))[:, None]


def fit(strings: list[bytes], label: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, rounds: int = 25) -> np.ndarray:
    """Weights of all subsequences, the offset in the last place."""
    out = np.zeros((1 << (5 * ORDER)) + 1, np.float32)
    toxic, fine = np.flatnonzero(label > 0), np.flatnonzero(label < 0)
    # landmarks: the most frequent witnesses, and as many harmless strings (the worst first)
    chosen = np.concatenate([toxic[np.argsort(-weight[toxic], kind="stable")][:LANDMARKS // 2], fine[:LANDMARKS // 2]])
    marks = [strings[i] for i in chosen]
    known = np.unique(np.concatenate([n for _, n, _ in subsequences(*letters(marks))] or [np.zeros(0, np.int32)]))
    if not len(known):
        out[-1] = LOWEST
        return out
    phi = kernel_rows(marks, known)
    value, vector = np.linalg.eigh(phi @ phi.T + 1e-6 * np.eye(len(marks)))
    root = vector @ np.diag(np.maximum(value, 1e-6) ** -0.5) @ vector.T
    to = phi.T @ root  # feature vector -> Nyström coordinates
    z = np.concatenate([kernel_rows(strings[i:i + 2000], known) @ to for i in range(0, len(strings), 2000)])
    z = np.column_stack([z, np.ones(len(z))])
    balance = np.where(label > 0, weight / weight[toxic].sum(), weight / weight[fine].sum())
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 0
    for _ in range(rounds):  # Newton steps on the squared hinge loss
        bad = label * (z @ w) < 1
        zb = z[bad] * balance[bad][:, None]
        w = np.linalg.solve(penalty + zb.T @ z[bad] + 1e-9 * np.eye(len(w)), zb.T @ label[bad])
    out[known] = to @ w[:-1]
    out[-1] = w[-1]
    return out


@dataclass
class Model:
    """Subsequence weights (offset last) and the logistic curve on a document's largest value."""

    weights: np.ndarray
    slope: float
    shift: float

    def score(self, largest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * largest + self.shift, -40, 40)))


def _runs(sizes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Runs of three or more single-letter parts of one document."""
    single = np.concatenate([[0], (sizes == 1).view(np.int8), [0]])
    edge = np.flatnonzero(np.diff(single))
    out = []
    for lo, hi in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        cut_at = [lo, *(lo + 1 + np.flatnonzero(doc[lo + 1:hi] != doc[lo:hi - 1])).tolist(), hi]
        out += [(a, b) for a, b in zip(cut_at[:-1], cut_at[1:], strict=True) if b - a >= 3]
    return out


def _pieces(word: bytes) -> list[bytes]:
    return [word[i:i + LONGEST] for i in range(0, max(1, len(word) - SPAN), LONGEST - SPAN)]


def document_strings(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different strings of some texts, and (string, document) of every one found."""
    split = pc.ascii_split_whitespace(pa.array([t.lower() if t.isascii() else t.decode().lower().encode() for t in texts], pa.large_binary()).cast(pa.large_string()))
    flat = split.flatten()
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    coded = flat.dictionary_encode()
    strings = list(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False))
    which = coded.indices.to_numpy().astype(np.int64)
    extra, owner = [], []
    for lo, hi in _runs(np.fromiter(map(len, strings), np.int64, len(strings))[which] if len(which) else np.zeros(0, np.int64), doc):
        joined = b"".join(strings[i] for i in which[lo:hi])
        for piece in _pieces(joined):
            extra.append(piece)
            owner.append(doc[lo])
    long = [i for i, x in enumerate(strings) if len(x) > LONGEST]
    for i in long:
        pieces = _pieces(strings[i])
        strings[i] = pieces[0]
        for d in np.unique(doc[which == i]).tolist():
            extra += pieces[1:]
            owner += [d] * (len(pieces) - 1)
    which = np.concatenate([which, np.arange(len(strings), len(strings) + len(extra))])
    return strings + extra, which, np.concatenate([doc, np.array(owner, np.int64)])


def largest_values(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The largest value of any string of each text, ``LOWEST`` without strings."""
    strings, which, doc = document_strings(texts)
    out = np.full(len(texts), LOWEST)
    if len(which):
        np.maximum.at(out, doc, (values(strings, weights) + weights[-1])[which])
    return np.maximum(out, LOWEST)


def held_out(doc_id="doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where(~held_out())
    part = lambda t: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = part(0).unionByName(part(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen.distinct(), "doc_id")
    # one text of each doc_id, so that the sample stays one; copies of one text are one witness
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("own", F.xxhash64("text"))
    rows = cut(rows.groupBy("own", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "labelled")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        share = float(bool(n.get(1)))
        blank = np.zeros((1 << (5 * ORDER)) + 1, np.float32)
        return Model(blank, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))

    def strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            strings, which, doc = document_strings(texts)
            # shorter strings have no subsequence, so they can't be told apart
            sized = (np.diff(letters(strings)[1]) > ORDER)[which] if len(which) else np.zeros(0, bool)
            which, doc = which[sized], doc[sized]
            pairs = np.unique(doc * len(strings) + which) if len(which) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()).take(pa.array(pairs % max(1, len(strings)))), run.column(0).take(pa.array(pairs // max(1, len(strings))))], ["string", "toxic"])

    # how many toxic and harmless documents hold each string
    seen = cut(rows.mapInArrow(strings_of, "string binary, toxic int").groupBy("string").agg(F.sum("toxic").cast("long").alias("bad"), F.sum(1 - F.col("toxic")).cast("long").alias("good")), "strings")
    # How unlikely a string's share of toxic documents is by chance (half the
    # G statistic): above ``surely``, chance alone would give hardly one string.
    share = n[1] / (n[0] + n[1])
    part_of = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("bad") + F.col("good")) * p))).otherwise(0.0)
    tied = seen.withColumn("tie", F.when(F.col("bad") > (F.col("bad") + F.col("good")) * share, 1).otherwise(-1) * (part_of("bad", share) + part_of("good", 1 - share)))
    surely = float(np.log(max(1, seen.count()) / 0.05))
    blame = tied.where(F.col("tie") > surely).orderBy(F.desc("tie"), "string").limit(STRINGS).select("string", "tie").toArrow()
    harmless = tied.where("good > 0 and tie <= 0").select("string", "good")
    fine = harmless.orderBy(F.xxhash64("string"), "string").limit(STRINGS).toArrow()
    ties = dict(zip(blame["string"].to_pylist(), blame["tie"].to_pylist(), strict=True))

    def witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            strings, which, doc = document_strings(texts)
            strength = np.array([ties.get(x, -1.0) for x in strings])
            strongest = np.full(len(texts), 0.0)
            np.maximum.at(strongest, doc, strength[which])
            blamed = np.flatnonzero((strength[which] > 0) & (strength[which] >= 0.5 * strongest[doc])) if len(which) else []
            pairs = {(doc[i], which[i]) for i in blamed}
            yield pa.RecordBatch.from_arrays([pa.array([strings[w] for _, w in pairs], pa.binary())], ["string"])

    found = rows.where("toxic = 1").mapInArrow(witnesses, "string binary").groupBy("string").count().toArrow() if ties else None
    if not found or not fine.num_rows:
        blank = np.zeros((1 << (5 * ORDER)) + 1, np.float32)
        return Model(blank, 0.0, float(np.log(share / (1 - share))))
    for again in range(ROUNDS):
        strings = found["string"].to_pylist() + fine["string"].to_pylist()
        label = np.concatenate([np.ones(found.num_rows), -np.ones(fine.num_rows)])
        weights = fit(strings, label, np.sqrt(np.concatenate([found["count"].to_numpy(), fine["good"].to_numpy()])))
        if again < ROUNDS - 1:  # the harmless strings that look worst join the next fit
            def rate(batches: Iterator[pa.RecordBatch], now=weights) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values(batch.column(0).to_pylist(), now))], [*batch.schema.names, "value"])

            worst = harmless.mapInArrow(rate, "string binary, good long, value double").orderBy(F.desc("value"), "string").limit(STRINGS // 4).select("string", "good").toArrow()
            fine = pa.concat_tables([worst, fine])
            _, first = np.unique(np.array(fine["string"].to_pylist(), object), return_index=True)
            fine = fine.take(np.sort(first))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([run.column(0), pa.array(largest_values(texts, weights))], ["toxic", "value"])

    got = rows.mapInArrow(largest, "toxic int, value double").toArrow()
    return Model(weights, *logistic(got["value"].to_numpy(), got["toxic"].to_numpy().astype(float)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a ridge logistic curve, both labels of equal weight."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        w += np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-4 * w)
    return max(float(w[0]), 0.0), float(w[1])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches, budget=8 << 20):
            s = model.score(largest_values(texts, model.weights))
            yield pa.RecordBatch.from_arrays([run.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
