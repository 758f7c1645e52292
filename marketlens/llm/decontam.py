"""Operator 1: benchmark decontamination by winnowing.

Every text is reduced to fingerprints: of each ``WINDOW - GRAM + 1``
consecutive ``GRAM``-word hashes the smallest is kept (the rightmost of equal
ones).  Two texts that share ``WINDOW`` words in a row share the fingerprint
chosen within them, so joining the fingerprints of documents with those of the
benchmark misses no shared window.  Each joined pair is then extended to both
sides over the words themselves, and counts only if it covers a whole window;
hash collisions therefore add nothing.  An item of fewer words than a window
is one window of its own length, fingerprinted whole.

A bitmap of the benchmark's fingerprint hashes, of a fixed size whatever the
benchmark's, goes to the document scan: fingerprints outside it cannot join
and are not shuffled.

Rows: null texts and texts without words have no words and are hit by
nothing; documents that repeat doc_id and text are one row, other texts under the same
(or a null) doc_id are rows of their own; items that repeat their words are all
listed, items without an id as none; an empty benchmark hits nothing; an empty
document table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marketlens.llm.shared import free_name
from marketlens.llm.text import ALNUM, Words, mix, slices

WINDOW, GRAM = 13, 5
SIDE = WINDOW - GRAM
BITS = 24  # of the bitmap: 2 MB

MARK = "struct<h:long,len:int,pos:int,off:int,words:array<string>>"


def _chosen(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the winnowed fingerprints of all documents of a run."""
    grams = words.grams(gram)
    span = window - gram + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        here = grams[j:j + n]
        less = here <= best
        best = np.where(less, here, best)
        at = np.where(less, np.arange(j, j + n), at)
    doc = words.doc_of_word()
    inside = doc[:n] == doc[window - 1:window - 1 + n]
    at = np.unique(at[inside])
    return at, grams[at]


def _marks(words: Words, bitmap: np.ndarray | None, lengths: list[int], whole: bool) -> dict[int, list[dict]]:
    """Document index -> its fingerprints with the words around them.

    ``lengths``: the lengths of short items; documents give every run of such a
    length, items (``whole``) themselves only."""
    counts = words.counts()
    doc_of = words.doc_of_word()
    found = []
    for length in [0, *lengths]:
        if length == 0:
            at, h = _chosen(words)
        else:
            h = words.grams(length)
            at = np.flatnonzero(doc_of[:len(h)] == doc_of[length - 1:length - 1 + len(h)])
            if whole:
                at = at[(counts[doc_of[at]] == length) & (at == words.first[doc_of[at]])]
            h = h[at]
        if bitmap is not None and len(h):
            bit = h & np.uint64((1 << BITS) - 1)
            keep = bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
            at, h = at[keep], h[keep]
        found.append((length, at, h))
    out: dict[int, list[dict]] = {}
    for length, at, h in found:
        size, side = (length, 0) if length else (GRAM, SIDE)
        for i, value in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
            d = int(doc_of[i])
            low, high = max(int(words.first[d]), i - side), min(int(words.first[d + 1]), i + size + side)
            out.setdefault(d, []).append({"h": value, "len": size + (100 if length else 0), "pos": i - int(words.first[d]), "off": i - low,
                                          "words": [words.word(j) for j in range(low, high)]})
    return out


def _scan(frame: DataFrame, key: str, bitmap: np.ndarray | None, lengths: list[int], whole: bool) -> DataFrame:
    """key, ``own`` (a hash of the text as it is), ``text_hash`` (equal for equal words), n_words and marks of each row."""
    mark = pa.struct([("h", pa.int64()), ("len", pa.int32()), ("pos", pa.int32()), ("off", pa.int32()), ("words", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            words = Words(texts, ALNUM)
            marks = _marks(words, bitmap, lengths, whole)
            # word hashes in order, folded to one number per text
            place = np.arange(len(words.hash), dtype=np.uint64) - np.repeat(words.first[:-1].astype(np.uint64), words.counts())
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hash ^ mix(place)), dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays([run.column(0), run.column(1), pa.array((sums[words.first[1:]] - sums[words.first[:-1]]).view(np.int64)), pa.array(words.counts(), pa.int64()),
                                              pa.array([marks.get(i, []) for i in range(len(texts))], pa.list_(mark))], ["key", "own", "text_hash", "n_words", "marks"])

    plain = F.col("text").cast("string")
    return frame.select(F.col(key).cast("long").alias("key"), F.xxhash64(plain).alias("own"), plain.alias("text")).mapInArrow(scan, f"key long, own long, text_hash long, n_words long, marks array<{MARK}>")


@F.pandas_udf(StructType([StructField("low", IntegerType()), StructField("high", IntegerType())]))
def _extent(length: pd.Series, pos: pd.Series, off: pd.Series, words: pd.Series, item_off: pd.Series, item_words: pd.Series) -> pd.DataFrame:
    """The equal words around a joined fingerprint, as bounds in the document;
    nulls where they are fewer than a window or the fingerprints differ."""
    out = []
    for n, p, o, w, io, iw in zip(length, pos, off, words, item_off, item_words, strict=True):
        if iw is None or w is None:
            out.append((None, None))
            continue
        n, o, io = int(n), int(o), int(io)
        size, need = (n - 100, n - 100) if n > 100 else (n, WINDOW)
        w, iw = list(w), list(iw)
        if w[o:o + size] != iw[io:io + size]:
            out.append((None, None))
            continue
        left = right = 0
        while left < min(o, io) and w[o - left - 1] == iw[io - left - 1]:
            left += 1
        while o + size + right < len(w) and io + size + right < len(iw) and w[o + size + right] == iw[io + size + right]:
            right += 1
        out.append((p - left, p + size + right) if left + size + right >= need else (None, None))
    return pd.DataFrame(out, columns=["low", "high"]).astype("Int32")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated
    (hit words are at least one in ``share``), and text_hash = xxhash64(text)."""
    spark = docs.sparkSession
    # Items that repeat their words are one class, whose members are listed at the end.
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sizes = _scan(items, "item_id", None, [], True).select("key", "n_words")
    lengths = sorted(r[0] for r in sizes.where((F.col("n_words") > 0) & (F.col("n_words") < WINDOW)).select("n_words").distinct().collect())  # 12 at most
    scanned = _scan(items, "item_id", None, lengths, True).where("n_words > 0 and key is not null")
    members = scanned.select(F.struct("text_hash", "n_words").alias("item"), F.col("key").alias("item_id")).distinct()
    marks = (scanned.select(F.struct("text_hash", "n_words").alias("item"), F.explode("marks").alias("m"))
             .select("item", F.col("m.h").alias("h"), F.col("m.len").alias("len"), F.col("m.pos").alias("item_pos"), F.col("m.off").alias("item_off"), F.col("m.words").alias("item_words"))
             .dropDuplicates(["item", "h", "len", "item_pos"]))
    bit = F.col("h").bitwiseAND((1 << BITS) - 1)
    # 512 rows of 4 kB at most, however many fingerprints there are
    pieces = marks.select(F.bitmap_bucket_number(bit + 1).alias("k"), F.bitmap_bit_position(bit + 1).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b")).collect()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for k, b in pieces:
        bitmap[(k - 1) * 4096:k * 4096] = np.frombuffer(b, np.uint8)

    # Documents without candidates go through the join under keys of their own,
    # dealt evenly, which no item has.
    rows = _scan(docs, "doc_id", bitmap, lengths, False).select("key", "own", "n_words", F.explode_outer("marks").alias("m")).select(
        "key", "own", "n_words", F.coalesce("m.h", F.xxhash64("key", "own")).alias("h"), F.coalesce("m.len", F.lit(0)).alias("len"), F.col("m.pos").alias("pos"), F.col("m.off").alias("off"), F.col("m.words").alias("words"))
    met = rows.join(marks, ["h", "len"], "left")
    none = F.lit(None).cast("struct<low:int,high:int>")
    met = met.withColumn("hit", F.when(F.col("item").isNotNull(), _extent("len", "pos", "off", "words", "item_off", "item_words")).otherwise(none))
    hit = F.col("hit.low").isNotNull()
    doc = ["key", "own", "n_words"]
    # a document's stretches and items: at most some per its own fingerprints
    per_doc = met.groupBy(*doc).agg(F.array_sort(F.collect_set(F.when(hit, F.col("hit")))).alias("hits"), F.collect_set(F.when(hit, F.col("item"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("hits", start, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], a["upto"]))).cast("long").alias("n"), F.greatest(a["upto"], x["high"]).alias("upto")), lambda a: a["n"])
    per_doc = per_doc.select(*doc, covered.alias("n_hit"), F.explode_outer("items").alias("item"))
    text = F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",")
    return (per_doc.withColumn("item", F.coalesce("item", F.struct(F.xxhash64(*doc).alias("text_hash"), F.lit(0).cast("long").alias("n_words")))).join(members, "item", "left")
            .groupBy(*doc, "n_hit").agg(F.count_distinct("item_id").alias("n_items"), F.sha2(text, 256).alias("items_sha256"))
            .select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.col("own").alias("text_hash")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` that are not contaminated."""
    i, t = free_name("_id", docs), free_name("_text", docs)
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(i), F.col("text_hash").alias(t))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t)), "leftanti")
