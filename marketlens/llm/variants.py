"""Operator 12: spelling variants by a dictionary of trie-node pairs.

The words of the whole corpus are counted; those that are long and frequent
enough form the vocabulary.  Its words are put into a trie and, reversed, into a
second one, and the nodes of both are numbered: a prefix of a word is one number, a
suffix another.  A word then has an integer pair (prefix node, suffix node)
for each position at which a letter is skipped and for each position at which one
could be inserted.  Two words differ by one replaced letter exactly if they share
a skipped pair, and by one inserted or deleted letter exactly if a skipped pair
of the longer one is an insertion pair of the shorter one, so one
grouping by pairs finds all neighbours and no others.

Numbering: the words are range-partitioned and sorted; in that order a node
is new where a word leaves the one before it, so each task numbers its part with
one path in memory.  Nodes that reach beyond a task's part are the prefixes of
some part's last word; they are numbered by that part and their depth.
The driver sees one word of each part for this.

A pair holds at most one word for each letter of the alphabet (90) and one
shorter word, so groups are small whatever the corpus.  No pairs of words are
written: each word gets its number of neighbours and the best one from
the group's best two.  A replaced letter has one position, and a deletion within a
run of equal letters counts at the first one only, so each neighbour counts once.

Rows: null and empty texts have no words; repeated rows and doc_ids count each
time; a null doc_id is written as nothing where ids enter a hash; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import cut, drop
from marketlens.llm.text import slices

LETTERS, TIMES = 6, 5  # least code points of a word, least occurrences
RATIO = 5              # a form is that many times as frequent

_RUN = np.zeros(256, bool)
_RUN[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()
_LONG = 64  # bytes; longer runs get their checksum one by one


class Runs:
    """The letter runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a run of documents, lower-cased (A-Z only).

    The letters from U+00C0 to U+00FF are the two-byte characters that begin with byte C3."""

    def __init__(self, docs: list[bytes], least: int):
        self.data = _LOWER[np.frombuffer(b" ".join(docs) + b" ", np.uint8)]
        lead = self.data == 0xC3
        letter = _RUN[self.data] | lead
        letter[1:] |= lead[:-1]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
        start, end = edge[0::2], edge[1::2]
        leads = np.concatenate([[0], np.cumsum(lead)])
        self.size = end - start - (leads[end] - leads[start])
        long = self.size >= least
        self.start, self.end, self.size = start[long], end[long], self.size[long]
        self.doc = np.searchsorted(np.cumsum([len(d) + 1 for d in docs]), self.start, side="right")

    def crc32(self, begun: np.ndarray) -> np.ndarray:
        """crc32 of each run, carried on from a checksum for each document."""
        now = begun.astype(np.uint32)[self.doc] ^ np.uint32(0xFFFFFFFF)
        size = self.end - self.start
        live = np.flatnonzero(size <= _LONG)
        for j in range(_LONG):
            live = live[size[live] > j]
            if not len(live):
                break
            now[live] = _CRC[(now[live] ^ self.data[self.start[live] + j]) & 0xFF] ^ (now[live] >> np.uint32(8))
        now ^= np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(size > _LONG).tolist():
            now[i] = zlib.crc32(self.data[self.start[i]:self.end[i]], int(begun[self.doc[i]]))
        return now

    def words(self, chosen: np.ndarray) -> pa.Array:
        size = (self.end - self.start)[chosen]
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(self.start[chosen] - at[:-1], size) + np.arange(at[-1])]
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data)])


def count_words(docs: DataFrame, least: int = LETTERS, misspell: int = 0) -> DataFrame:
    """(word, n): how often each letter run of at least ``least`` code points occurs.

    ``misspell``: where it divides h = crc32("<doc_id>:<run>"), the run first loses its
    code point h % length (for tests of recall on real texts)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            runs = Runs(texts, least)
            whole, odd = np.ones(len(runs.start), bool), []
            if misspell:
                begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in rows.column(0).to_pylist()], np.uint32)
                h = runs.crc32(begun)
                whole = h % np.uint32(misspell) != 0
                for i in np.flatnonzero(~whole).tolist():
                    word, at = str(runs.data[runs.start[i]:runs.end[i]], "utf-8"), int(h[i]) % int(runs.size[i])
                    if runs.size[i] > least:
                        odd.append((word[:at] + word[at + 1:]).encode())
            words = pa.chunked_array([runs.words(np.flatnonzero(whole)), pa.array(odd, pa.large_binary())])
            counts = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["word", "n"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _sorted_parts(words: DataFrame, key: str) -> DataFrame:
    """The rows with ``part`` and ``place``: range parts, and a number that grows with the key over all parts."""
    return (words.repartitionByRange(key).sortWithinPartitions(key)
            .withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def number_nodes(parts: DataFrame, key: str, id: str) -> DataFrame:
    """(id, nodes): the numbers of the trie nodes on each key's path, the root
    first, from a table of ``_sorted_parts``."""
    # one word of each part: as many as the session has shuffle partitions at most
    lasts = sorted((r.part, r.key) for r in parts.groupBy("part").agg(F.max(key).alias("key")).collect())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, path, fresh, before = None, None, [0], 0, ""
        for batch in batches:
            paths = []
            for part, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    k = next(i for i, x in enumerate(lasts) if x[0] == part)
                    now, last, path, fresh, before = part, lasts[k][1], [0], part << 40, ""
                    # nodes of earlier parts' last words go on into this one; a deeper node has no earlier owner
                    for owner, end in reversed(lasts[:k]):
                        shared = _shared(end, word)
                        if not shared:
                            break
                        path[1:shared + 1] = [-1 - (owner << 40 | d) for d in range(1, shared + 1)]
                    before = word[:len(path) - 1]
                keep = _shared(before, word)
                del path[keep + 1:]
                edge = _shared(last, word)
                for depth in range(keep + 1, len(word) + 1):
                    if depth <= edge:
                        path.append(-1 - (now << 40 | depth))
                    else:
                        fresh += 1
                        path.append(fresh)
                paths.append(list(path))
                before = word
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(paths, pa.list_(pa.int64()))], ["id", "nodes"])

    # a part stays one sorted sequence, whichever task has it
    whole = parts.repartition("part").sortWithinPartitions("part", "place")
    return whole.select("part", key, F.col(id).alias("id")).mapInArrow(number, "id long, nodes array<long>")


def node_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, id, n, skip, counts): all pairs of each word of (id, word,
    n, prefixes, suffixes).  ``skip``: a letter stands between them; ``counts``: and
    it is the first of its run of equal letters."""
    size = F.char_length("word")
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.get("prefixes", i).alias("prefix"), F.get("suffixes", size - 1 - i).alias("suffix"), F.lit(True).alias("skip"),
        ((i == 0) | (F.get("letters", i) != F.get("letters", i - 1))).alias("counts")))
    inserts = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        F.get("prefixes", i).alias("prefix"), F.get("suffixes", size - i).alias("suffix"), F.lit(False).alias("skip"), F.lit(False).alias("counts")))
    return words.withColumn("letters", F.split("word", "")).select("id", "n", F.explode(F.concat(skips, inserts)).alias("p")).select("p.*", "id", "n")


def _better(*options: Column) -> Column:
    return F.array_max(F.filter(F.array(*options), lambda x: x.isNotNull()))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, near_n, near_id): how many neighbours each word has, and the one
    of largest n (ties: smallest id)."""
    # at most 91 members, see the module's text
    groups = (pairs.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("n", (-F.col("id")).alias("less"), "skip", "counts")).alias("all"))
              .where("size(all) > 1"))
    pick = lambda test: F.sort_array(F.filter("all", test), asc=False)
    groups = groups.select("all", pick(lambda m: m["skip"]).alias("skipped"), pick(lambda m: m["counts"]).alias("counted"), F.get(pick(lambda m: ~m["skip"]), F.lit(0)).alias("short"))
    member = groups.select("skipped", "counted", "short", F.explode("all").alias("m"))
    key = lambda c: F.when(c.isNotNull(), F.struct(c["n"].alias("n"), c["less"].alias("less")))
    first, second = F.get("skipped", F.lit(0)), F.get("skipped", F.lit(1))
    of_skipped = F.when(first["less"] == F.col("m.less"), key(second)).otherwise(key(first))
    near = (F.when(F.col("m.skip"), F.size("skipped") - 1 + (F.col("m.counts") & F.col("short").isNotNull()).cast("int")).otherwise(F.size("counted")))
    best = F.when(F.col("m.skip"), _better(of_skipped, F.when(F.col("m.counts"), key(F.col("short"))))).otherwise(key(F.get("counted", F.lit(0))))
    member = member.select((-F.col("m.less")).alias("id"), near.cast("long").alias("near"), best.alias("best")).where("near > 0")
    return member.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")).select("id", "n_near", F.col("best.n").alias("near_n"), (-F.col("best.less")).alias("near_id"))


def _roots(links: DataFrame) -> DataFrame:
    """(id, root): the ends of chains (id, root).  Each pass doubles the reach;
    a chain's counts grow ``RATIO``-fold a link, so a few passes do."""
    now = cut(links, "roots")
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        after = cut(now.join(on, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        drop(now)
        now = after.select("id", "root")
        now._scratch = after._scratch
        if after.where("moved").limit(1).count() == 0:
            return now


def group_variants(counts: DataFrame, least: int = LETTERS, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``count_words``
    with enough letters and occurrences.

    ``form``: the near word of largest n (ties: smallest in code-point order) if that is at
    least ``ratio`` times the word's own; ``root``: the end of the chain of forms."""
    words = cut(_sorted_parts(counts.where((F.char_length("word") >= least) & (F.col("n") >= times)), "word"), "vocabulary").withColumnRenamed("place", "id")
    backwards = cut(_sorted_parts(words.select("id", F.reverse("word").alias("key")), "key"), "reversed")
    prefixes = number_nodes(words.withColumn("place", F.col("id")), "word", "id").withColumnRenamed("nodes", "prefixes")
    suffixes = number_nodes(backwards, "key", "id").withColumnRenamed("nodes", "suffixes")
    near = cut(neighbours(node_pairs(words.select("id", "word", "n").join(prefixes, "id").join(suffixes, "id"))), "near")
    forms = words.join(near, "id", "left").withColumn("form_id", F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near_id")))
    links = forms.where("form_id is not null").select("id", F.col("form_id").alias("root"))
    roots = _roots(links)
    name = lambda c, out, *more: words.select(F.col("id").alias(c), F.col("word").alias(out), *more)
    return (forms.join(name("form_id", "form", F.col("n").alias("form_n")), "form_id", "left")
            .join(roots.withColumnRenamed("root", "root_id"), "id", "left").join(name("root_id", "root"), "root_id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))
