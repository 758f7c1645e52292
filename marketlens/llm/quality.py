"""Operator 8: ordinal quality classifier by cumulative-link regression.

A text is the mean of hashed features of its white-space parts: the word itself
(lower-cased), its shape (letters, digits and marks with runs folded) and
whether it repeats the part before.  One weight vector w is shared by all
grades; ordered thresholds t1 < t2 < ... turn the score into probabilities,
P(grade >= k) = sigmoid(w.x - t_k).  Their sum is the expected grade, and the
tail probability at a chosen grade selects documents.

Grades are read off ``labels``: 0 for low quality, 1 for good but toxic, 2 for good
and clean.  The model is fitted on the driver on at most ``SAMPLE`` labelled rows
of each grade, those of smallest hashed doc_id, and never on rows whose
crc32(doc_id as text) mod 5 is 0, which are held out.  Scoring reads every
document whole, in one pass without a shuffle.

Rows: a null or empty text has no features and gets the score of the thresholds
alone, and is rejected, as it holds nothing to train on; labels without a
quality are ignored and a null toxic counts as not toxic; a doc_id that several texts or label rows share
trains with one text (the least) for each grade; documents without a label, repeated or without a doc_id are scored like any others; without labels
of two grades every document gets the prior (expected grade of the labels, or the
highest without labels); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from marketlens.llm.text import SPACED, Words, slices

DIMENSIONS = 1 << 14
SAMPLE = 2500  # labelled rows of each grade that the fit may see
GRADES = 3
CUT = 0.25  # tail probability from which a document is kept: rather a poor one than to lose a good one

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("X")
_SHAPE[97:123] = ord("x")
_SHAPE[48:58] = ord("9")
_SHAPE[128:] = ord("x")
_SHAPE[[9, 10, 11, 12, 13]] = 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, dimension) of every feature occurrence, in document order for
    each kind, and the number of parts per document."""
    words = Words(texts, SPACED)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    shape = _SHAPE[raw]
    keep = np.concatenate([[True], shape[1:] != shape[:-1]])
    folded = Words.of(shape[keep], np.concatenate([[0], np.cumsum(keep)])[words.bounds])
    doc = words.doc_of_word()
    half = np.uint64(DIMENSIONS // 2 - 1)
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])) + 1 if len(doc) else np.zeros(0, np.int64)
    where = np.concatenate([doc, folded.doc_of_word(), doc[again]])
    dims = np.concatenate([(words.hash & half).astype(np.int64), DIMENSIONS // 2 + 1 + (folded.hash % (half - np.uint64(1))).astype(np.int64), np.full(len(again), DIMENSIONS // 2, np.int64)])
    return where, dims, words.counts()


@dataclass
class Model:
    """Weights per dimension and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, dims, n = features(texts)
        return np.bincount(doc, self.weights[dims], len(texts)) / np.maximum(1, n)


def fit(rows: list[tuple[int, list[int], list[float]]], grades: int = GRADES, ridge: float = 3e-4, steps: int = 400) -> Model:
    """Cumulative-link regression on (grade, dimensions, values) rows, each grade
    of equal total weight, by Adam on the negative log-likelihood."""
    grade = np.array([r[0] for r in rows], np.int64)
    counts = np.bincount(grade, minlength=grades)
    if (counts > 0).sum() < 2:
        # nothing to tell apart: thresholds that give the one grade there is
        only = int(grade[0]) if len(grade) else grades - 1
        return Model(np.zeros(DIMENSIONS), np.array([-6.0 if k <= only else 6.0 for k in range(1, grades)]))
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    dims = np.concatenate([np.asarray(r[1], np.int64) for r in rows])
    # square roots spread the frequent features' weight; the scale keeps steps alike
    value = np.concatenate([np.asarray(r[2], float) for r in rows])
    weight = (1 / counts[grade].clip(1))
    weight /= weight.sum()
    w, gaps = np.zeros(DIMENSIONS), np.zeros(grades - 1)  # t1, then log distances
    params = np.concatenate([w, gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    rates = np.concatenate([np.full(DIMENSIONS, 0.5), np.full(grades - 1, 0.05)])
    for step in range(1, steps + 1):
        w, gaps = params[:DIMENSIONS], params[DIMENSIONS:]
        t = gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])
        score = np.bincount(row, w[dims] * value, len(rows))
        edge = np.concatenate([[-1e3], t, [1e3]])
        up, low = (1 / (1 + np.exp(-np.clip(edge[grade + i] - score, -40, 40))) for i in (1, 0))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up), low * (1 - low)
        g_score = weight * (du - dl) / p
        g_w = np.bincount(dims, g_score[row] * value, DIMENSIONS) + ridge / len(rows) * w
        g_edge = np.zeros(grades + 1)
        np.add.at(g_edge, grade + 1, -weight * du / p)
        np.add.at(g_edge, grade, weight * dl / p)
        g_t = g_edge[1:grades]
        g_gaps = np.concatenate([[g_t.sum()], [g_t[i:].sum() * np.exp(gaps[i]) for i in range(1, grades - 1)]])
        g = np.concatenate([g_w, g_gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - rates * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    gaps = params[DIMENSIONS:]
    return Model(params[:DIMENSIONS], gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))]))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    graded = (labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"),
              F.when(F.col("quality") < 1, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2).alias("grade")).where(~held_out()))
    chosen = None
    for g in range(GRADES):
        part = graded.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.distinct()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches, budget=1 << 20):
            doc, dims, n = features(texts)
            key, count = np.unique(doc * DIMENSIONS + dims, return_counts=True)
            which = key // DIMENSIONS
            bounds = np.searchsorted(which, np.arange(len(texts) + 1))
            values = count / np.maximum(1, n)[which]
            yield pa.RecordBatch.from_arrays([run.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(key % DIMENSIONS, pa.int32())),
                                              pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.float32()))], ["grade", "dims", "values"])

    rows = (docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
            # one text of each doc_id, so that the sample stays one
            .groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
            .mapInArrow(extract, "grade int, dims array<int>, values array<float>"))
    got = rows.toArrow()  # at most GRADES * sample rows, each of at most DIMENSIONS features
    return fit([(g, d.values.to_numpy(), v.values.to_numpy()) for g, d, v in zip(got["grade"].to_pylist(), got["dims"], got["values"], strict=True) if len(d)])


def grade_documents(docs: DataFrame, model: Model, at: int = 1) -> DataFrame:
    """The rows and columns of ``docs`` with expected_grade, tail (the
    probability of grade ``at`` or more) and n_parts, appended last."""
    place = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            doc, dims, n = features(texts)
            tails = model.tails(np.bincount(doc, model.weights[dims], len(texts)) / np.maximum(1, n))
            yield pa.RecordBatch.from_arrays([*run.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, at - 1]), pa.array(n, pa.int64())], [str(i) for i in range(run.num_columns + 3)])

    names = [*docs.columns, "expected_grade", "tail", "n_parts"]
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumnRenamed(f"c{place}", "text")
    schema = StructType([*plain.schema.fields, StructField("expected_grade", DoubleType()), StructField("tail", DoubleType()), StructField("n_parts", LongType())])
    return plain.mapInArrow(score, schema).toDF(*names)


def accepted(cut: float = CUT) -> F.Column:
    """Whether a graded document is kept."""
    return (F.col("tail") >= cut) & (F.col("n_parts") > 0)


def accept_documents(docs: DataFrame, model: Model, at: int = 1, cut: float = CUT) -> DataFrame:
    """The rows and columns of ``docs`` that the model accepts."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            doc, dims, n = features(texts)
            tail = model.tails(np.bincount(doc, model.weights[dims], len(texts)) / np.maximum(1, n))[:, at - 1]
            yield run.filter(pa.array((tail >= cut) & (n > 0)))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(keep, docs.schema)
