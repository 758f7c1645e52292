"""Periodic runs against a brute-force search of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import periodic
from marketlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"


def brute(x):
    """(start, length, period) of all runs: every period, word by word."""
    n, out = len(x), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and x[i] == x[i + q]:
                i += 1
            if i + q - a >= max(24, 3 * q):
                out.setdefault((a, i + q - a), q)  # periods grow: the first is the smallest
    return sorted((a, n, q) for (a, n), q in out.items())


def expected(doc_id, text, plant=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{a},{s},{q}\n" for a, s, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def caught(*texts):
    found = periodic.catch_runs([np.array(x, np.int64) for x in texts])
    return [found.get(i, []) for i in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_equal_brute_force(data):
    rng = random.Random(data.draw(st.integers(0, 10**9)))
    texts = []
    for _ in range(rng.randint(1, 4)):
        x = []
        while len(x) < rng.randint(0, 400):
            p = rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 50])
            unit = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(p)]
            x += (unit * rng.randint(1, 9))[:rng.randint(1, 200)]
        texts.append(x)
    assert caught(*texts) == [brute(x) for x in texts]


@pytest.mark.parametrize("portion", [1, 7, 64])
def test_portions_do_not_matter(portion, monkeypatch):
    rng = random.Random(portion)
    x = [rng.randint(0, 3) for _ in range(90)] + [1, 2, 3, 4, 5] * 30 + [rng.randint(0, 3) for _ in range(50)] + list(range(80)) * 4 + [9] * 70
    monkeypatch.setattr(periodic, "PORTION", portion)
    assert caught(x) == [brute(x)]


def test_fibonacci_words_and_long_powers():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert caught(b, [7] * 2000, [1, 2] * 700) == [brute(b), [(0, 2000, 1)], [(0, 1400, 2)]]


def test_names_that_meet_by_chance_are_read_again(monkeypatch):
    # names of two bits: blocks meet all the time
    monkeypatch.setattr(periodic, "mix", lambda x: x % np.uint64(3) + np.uint64(1))
    rng = random.Random(5)
    x = [rng.randint(0, 9) for _ in range(120)] + [1, 2, 3, 4, 5, 6] * 9 + [rng.randint(0, 9) for _ in range(60)]
    (got,) = caught(x)
    assert set(brute(x)) <= set(got) | {(100, 0, 0)} and all(r in brute(x) for r in got)


def test_one_long_text_of_one_word(spark):
    text = "na " * 200_000
    (row,) = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_words == 200_000 and [tuple(r) for r in row.runs] == [(0, 200_000, 1)] and row.collapsed == "na"


def test_table_rules(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n", 5), (4, "a b " * 20, 5), (4, "a b " * 20, 5), (None, "x " * 30, 5), (5, "A a " * 13 + "  é", 5), (6, "w " * 23, 5), (7, "w " * 24, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(map(tuple, periodic.run_digests(periodic.find_runs(docs)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=str)
    assert periodic.run_digests(periodic.find_runs(docs.limit(0))).count() == 0


def test_query_equals_brute_force(spark):
    want = sorted(expected(r.doc_id, r.text, True) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 9000)
    ids = {w[0] for w in want}
    got = sorted(tuple(r) for r in QUERIES["op11_dyadic_runs"](spark, SF001).collect() if r.doc_id in ids)
    assert got == want and sum(w[1] for w in want) > 5
