"""Spelling variants against a comparison of all words, and against DuckDB."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlens.llm import variants
from marketlens.llm.queries import ORACLES, QUERIES
from oracle_util import duck

SF001 = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, misspell=0):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    return counts


def brute(counts, least=6, times=5):
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= times}
    form, out = {}, {}
    for w, n in words.items():
        own = [v for v in words if near(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if own and words[best] >= 5 * n else None
        out[w] = len(own)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return rows


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,parts", [(1, 2), (2, 13), (3, 40)])
def test_random_words_over_many_parts(spark, seed, parts):
    # few letters and long shared prefixes, so parts begin and end inside one branch
    rng = random.Random(seed)
    words = {}
    while len(words) < 700:
        w = rng.choice(["", "aaaa", "abab", "ÿà"]) + "".join(rng.choice("abé") for _ in range(rng.randint(4, 7)))
        words[w] = rng.choice([1, 4, 5, 5, 7, 25, 40, 130, 700, 4000])
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(variants.group_variants(table(spark, words))) == brute(words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_every_letter_in_one_place(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    words = {f"abc{x}def": 5 + i for i, x in enumerate(letters)} | {"abcdef": 1000, "abcddef": 31}
    assert got(variants.group_variants(table(spark, words))) == brute(words)


def test_chains_ties_and_long_words(spark):
    chain = {"abcdefgh"[:4] + "x" * k: 5 * 6 ** k for k in range(2, 9)}
    long = "lorem" * 4000
    words = chain | {"tiewordb": 100, "tieworda": 100, "tieword": 20, long: 9, long[:-1]: 50, "doubleelse": 90, "doublelse": 5}
    assert got(variants.group_variants(table(spark, words))) == brute(words)


def test_rows_and_letters(spark):
    rows = [(1, "Straße École straße ×÷×÷×÷ naïveté 中abcdefgç don'ts"), (1, "Straße École"), (None, "WORDING wording ÉCOLE"), (2, None), (3, ""), (4, "wörter" * 500), (5, "ábcdefg cafésĀxyzxyz")] * 6
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    for misspell in (0, 1, 3):
        counts = variants.count_words(docs, misspell=misspell)
        assert {r.word: r.n for r in counts.collect()} == brute_words(rows, misspell)
    assert got(variants.group_variants(variants.count_words(docs, misspell=3))) == brute(brute_words(rows, 3))
    assert variants.group_variants(variants.count_words(docs.limit(0))).count() == 0


def test_query_equals_brute_force_and_sql(spark):
    q = QUERIES["op12_trie_pair_variants"](spark, SF001)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(brute_words(rows, 199))
    assert got(q) == want and len(want) > 100
    sql = duck(SF001).sql(ORACLES["op12_trie_pair_variants"]).fetchall()
    assert set(sql) == want and len(sql) == len(want)


def test_pairs_grow_with_the_words_only(spark):
    # 90 words that are all near each other: 90 * 7 skipped and 90 * 8 inserted pairs, no pairs of words
    words = variants._sorted_parts(table(spark, {f"abc{chr(0xC0 + i)}def": 9 for i in range(60)}), "word").withColumnRenamed("place", "id")
    nodes = F.array([F.lit(i).cast("long") for i in range(8)])
    pairs = variants.node_pairs(words.select("id", "word", "n", nodes.alias("prefixes"), nodes.alias("suffixes")))
    assert pairs.count() == 60 * 15
