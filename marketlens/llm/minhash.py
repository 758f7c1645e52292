"""Operator 9: near-duplicates by b-bit MinHash.

A document is the set of its distinct word shingles.  ``HASHES`` minima per set
give ``BANDS`` band keys of ``ROWS`` minima each, and the lowest two bits of
every minimum, packed into six longs.  Documents that share a band key are
candidates.  The share m of equal two-bit values of a pair has the expectation
c + (1 - c) J with c = 1/4, so (m - c) / (1 - c) estimates its similarity J
from a few bit counts; pairs ``MARGIN`` below the threshold are dropped, the
rest is confirmed on the full sets.  A pair at the threshold of 0.8 is missed by all
38 bands with a probability of 3e-7, and by the estimate (0.18 is five
standard deviations) with the same.

Words count by two keyed hashes, of which the second decides: sets are equal
if their sizes, a check of the first hash and one of the second agree, and
links are confirmed on the shingles of the second, which had no part in finding them.

Equal sets are one class before anything is compared.  In a bucket each class
is compared with the bucket's smallest one; buckets whose classes are linked by that
are done, however large.  What is left, classes of different components
in one bucket, is compared in blocks inside the tasks, first by signatures and
then by the full sets of those that are alike.

Rows: null, empty and blank texts have an empty set and link with nothing;
fewer words than a shingle are one shingle; rows that repeat a doc_id are one
node, and keep their own n_shingles; rows without a doc_id link with
nothing, have no component and are not kept; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import bitmap_of, components, cut, free_name, in_bitmap, sorted_groups
from marketlens.llm.text import SPACED, Words, mix, slices

HASHES, ROWS, BANDS = 192, 5, 38
MARGIN = 0.18
BLOCK = 2048
KEYS = (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)  # any two numbers of 64 bits
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_XOR, _MULTIPLY = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32), (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ODD_BITS = 0x5555555555555555


def shingles(texts: list[bytes], k: int, key: int = KEYS[1]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of the texts in turn, and each text's bounds."""
    return _shingles(Words(texts, SPACED), k, key)


def _shingles(words: Words, k: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    counts = words.counts()
    hashes = words.spelled(key)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n)])
    grams = words.grams(k, hashes)
    doc = np.repeat(np.arange(len(counts)), n)
    at = words.first[doc] + np.arange(len(doc)) - bounds[doc]
    short = counts[doc] < k
    out = np.zeros(len(doc), np.uint64)
    out[~short] = grams[at[~short]]
    for i in np.flatnonzero(short).tolist():  # the whole sequence, told apart by its length
        own = hashes[at[i]:at[i] + counts[doc[i]]]
        h = np.uint64(len(own))
        for x in own:
            h = mix(np.array([h]) ^ x)[0]
        out[i] = h
    return out, bounds


def signatures(all_shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (one row per set, BANDS columns) and packed two-bit signatures (6 longs) of non-empty sets."""
    starts = bounds[:-1]
    x = (all_shingles ^ (all_shingles >> np.uint64(32))).astype(np.uint32)
    minima = np.empty((HASHES, len(starts)), np.uint32)
    for j in range(HASHES):
        minima[j] = np.minimum.reduceat((x ^ _XOR[j]) * _MULTIPLY[j], starts)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(starts), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h ^ minima[b * ROWS + r])
        keys[:, b] = h
    low = (minima & np.uint32(3)).astype(np.uint64).reshape(HASHES // 32, 32, len(starts))
    packed = (low << (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, :, None]).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.T.view(np.int64)


def _sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the set's two checks, bands and sig (both empty for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            words = Words(texts, SPACED)
            (h, bounds), (other, _) = (_shingles(words, k, key) for key in KEYS)
            n, one, two = (np.zeros(len(texts), np.int64) for _ in range(3))
            for i in range(len(texts)):
                own = np.unique(h[bounds[i]:bounds[i + 1]])
                n[i], one[i] = len(own), mix(own).sum(dtype=np.uint64).view(np.int64)
                two[i] = mix(np.unique(other[bounds[i]:bounds[i + 1]])).sum(dtype=np.uint64).view(np.int64)
            full = n > 0
            keys, packed = np.zeros((0, BANDS), np.int64), np.zeros((0, HASHES // 32), np.int64)
            if full.any():
                keys, packed = signatures(h, np.concatenate([bounds[:-1][full], bounds[-1:]]))
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]) * m.shape[1], pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([run.column(0), pa.array(n), pa.array(one), pa.array(two), lists(keys), lists(packed)], ["doc_id", "n_shingles", "one", "two", "bands", "sig"])

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, one long, two long, bands array<long>, sig array<long>")


def estimate(a, b) -> F.Column:
    """Collision-corrected similarity of two packed signatures."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, d: n + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_ODD_BITS))))
    return (1 - differ / HASHES - 0.25) / 0.75


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = bitmap_of(ids, "id")
    # only texts that some pair names are shuffled, few others pass the bitmap
    texts = in_bitmap(docs, "doc_id", wanted)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for run, texts_b in slices(batches, "text_b"):
            h, bounds = shingles(texts_b, k)
            ok = []
            for i, text in enumerate(run.column(2)):
                if (value := text.as_py()) != last:
                    last, kept = value, np.unique(shingles([value.encode()], k)[0])
                own = np.unique(h[bounds[i]:bounds[i + 1]])
                both = len(np.intersect1d(kept, own, assume_unique=True))
                ok.append(100 * both >= percent * (len(kept) + len(own) - both))
            yield pa.RecordBatch.from_arrays([run.column(0), run.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _alike(group: pa.Table, least: float) -> np.ndarray:
    """Which pairs of a group (rows key, i, j, block, doc_id, part, sig, bands)
    are to be confirmed here: of different components, by estimate at least
    ``least``, across the group's two blocks if it has two, and of no earlier
    band in common, so that a pair is confirmed in one bucket only."""
    block, part = group.column("block").to_numpy(), group.column("part").to_numpy()
    ok = np.triu(part[:, None] != part[None, :])
    if group.column("i")[0] != group.column("j")[0]:
        ok &= block[:, None] != block[None, :]
    if not ok.any():
        return ok
    matrix = lambda c, w: group.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, w)
    sig, bands = matrix("sig", HASHES // 32), matrix("bands", BANDS)
    own = int(np.flatnonzero(bands[0] == np.uint64(group.column("key")[0].as_py() % 2**64))[0])
    for lo in range(0, len(part), 256):  # in strips of rows, to bound the memory
        now = slice(lo, lo + 256)
        if not ok[now].any():
            continue
        differ = np.zeros(ok[now].shape, np.uint16)
        for w in sig.T:
            d = w[now, None] ^ w[None, :]
            differ += np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(_ODD_BITS))
        ok[now] &= (1 - differ / HASHES - 0.25) / 0.75 >= least
        if ok[now].any():
            for band in bands.T[:own]:
                ok[now] &= band[now, None] != band[None, :]
    return ok


def _links_across(members: DataFrame, sig: DataFrame, parts: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between documents of different components in one bucket.

    A bucket of more than ``BLOCK`` members is dealt to blocks, and each pair of
    blocks is a group of its own, so a group has at most about two blocks.  The
    first pass finds the documents that some group has to confirm; the second
    brings their texts there and compares the full sets.  Neither makes a row
    of a pair that is not a link."""
    least = percent / 100 - MARGIN
    now = members.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component_id", "doc_id").alias("part"))
    open_ = now.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low < high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = (now.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "part"))
    group = ["key", "i", "j"]
    together = lambda rows: rows.repartition(*group).sortWithinPartitions(*group, "doc_id")

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, len(group)):
            ok = _alike(rows, least)
            yield from rows.filter(pa.array(ok.any(axis=0) | ok.any(axis=1))).combine_chunks().to_batches()

    some = cut(together(dealt.join(sig, "doc_id").select("key", "i", "j", "block", "doc_id", "part", "sig", "bands")).mapInArrow(involved, "key long, i int, j int, block int, doc_id long, part long, sig array<long>, bands array<long>"), "across")
    texts = in_bitmap(docs, "doc_id", bitmap_of(some, "doc_id"))
    rows = some.join(texts, "doc_id").select("key", "i", "j", "block", "doc_id", "part", "sig", "bands", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, len(group)):
            ok = _alike(rows, least)
            ids = rows.column("doc_id").to_numpy()
            sets = []
            for batch in rows.select(["text"]).to_batches():
                for _, own in slices([batch]):
                    h, bounds = shingles(own, k)
                    sets += [np.unique(h[bounds[i]:bounds[i + 1]]) for i in range(len(own))]
            size = np.array([len(x) for x in sets])
            end = np.cumsum(size)
            _, word = np.unique(np.concatenate(sets), return_inverse=True)
            held = np.zeros(int(word.max()) + 1, bool)
            a, b = [], []
            for x in np.flatnonzero(ok.any(axis=1)).tolist():
                mine = word[end[x] - size[x]:end[x]]
                held[mine] = True
                for others in np.array_split(np.flatnonzero(ok[x]), -(-int(ok[x].sum()) // 256)):
                    stop = np.cumsum(size[others])
                    at = np.repeat(end[others] - stop, size[others]) + np.arange(stop[-1])
                    both = np.add.reduceat(held[word[at]].astype(np.int64), stop - size[others])
                    near = others[100 * both >= percent * (size[x] + size[others] - both)]
                    a += [min(ids[x], ids[y]) for y in near]
                    b += [max(ids[x], ids[y]) for y in near]
                held[mine] = False
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return together(rows).mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links) and kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut(_sketch(docs, k), "sketch")
    full = sets.where("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "one", "two"]
    leads = full.groupBy(*same).agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    copies = full.join(leads, same).where("doc_id > lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b"), *same)
    # one document of each class goes on; few are copies, and these are joined without the sketches
    classes = full.join(copies.select(F.col("b").alias("doc_id"), *same).distinct(), ["doc_id", *same], "leftanti")
    banded = classes.select(F.explode("bands").alias("key"), "doc_id")
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last")
    members = cut(banded.join(buckets, "key").select("key", "doc_id", "lead"), "buckets")
    sig = classes.select("doc_id", "sig", "bands")
    a, b = (sig.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    pairs = members.where("doc_id > lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = cut(pairs.join(b, "b").join(a, "a").where(estimate("sig_a", "sig_b") >= percent / 100 - MARGIN).select("a", "b"), "pairs")
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # a linked doc_id may be repeated without words
    parts = components(_confirm(likely, worded, k, percent).unionByName(copies.select("a", "b")))
    # what the buckets' smallest classes do not reach
    more = _links_across(members, sig, parts, worded, k, percent)
    parts = components(parts.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more))
    parts = parts.withColumnRenamed("id", "doc_id")
    return (sets.select("doc_id", "n_shingles").join(parts, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def deduplicate(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """The rows and columns of ``docs`` with one document of each component, that
    of the smallest doc_id; of rows that repeat a doc_id one stays (of the
    smallest text hash), rows without one all stay.  Only the ids of what
    goes are joined, so the texts that stay are not shuffled."""
    i = free_name("_id", docs)
    gone = cut(near_duplicates(docs, k, percent).where("doc_id is not null and not kept").select(F.col("doc_id").alias(i)).distinct(), "gone")
    own = F.col("doc_id").cast("long") == F.col(i)
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(i)).count().where("count > 1").select(i)
    left = docs.join(gone, own, "leftanti")
    first = left.join(again, own, "leftsemi").groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64("text")).alias("row")).select("row.*")
    return left.join(again, own, "leftanti").unionByName(first)
