import random
import re

import pytest

from marketlens.llm import minhash
from marketlens.llm.text import SPACED, Words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    near = {i: i for i, _ in docs if i is not None}

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                near[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(find(i) if i is not None else None), i is not None and find(i) == i) for i, s in sets)


def near_copy(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    out = [(i, near_copy(rng, base, rng.randint(0, 9))) for i in range(0, 160, 2)]  # a large group around the threshold
    for g in range(12):
        words = [f"g{g}x{rng.randint(0, 50)}" for _ in range(rng.randint(3, 60))]
        out += [(200 + 10 * g + k, near_copy(rng, words, k % 3)) for k in range(rng.randint(1, 6))]
    common = " ".join(f"c{i}" for i in range(60))
    out += [(400 + i, common + " " + " ".join(f"u{i}y{k}" for k in range(rng.randint(10, 60)))) for i in range(40)]  # one passage in all
    out += [(500, None), (501, ""), (502, " \n "), (503, "a b"), (504, "A  B"), (505, "a b c d"), (506, "a b c"), (507, None), (508, "z" * 60_000), (None, "a b"), (None, None), (600, "p q r s t"), (600, "p q r s t"), (600, "a B"), (601, "x " * 9000)]
    return out


def test_equals_brute_force(spark, docs):
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, one int, sig string").repartition(6)
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in minhash.near_duplicates(d).collect())
    assert got == brute(docs)


def test_blocks_do_not_change_the_result(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in minhash.near_duplicates(d).collect()) == brute(docs)


def test_deduplicate_keeps_one_of_each_group(spark, docs):
    d = spark.createDataFrame([(i, t, {"m": 1}) for i, t in docs], "doc_id long, text string, _id map<string,int>")
    out = minhash.deduplicate(d)
    assert out.columns == d.columns
    got = sorted(str(r[0]) for r in out.select("doc_id").collect())
    want = sorted({i for i, _, _, kept in brute(docs) if kept} | {"None"})
    assert sorted(set(got)) == want and len(got) == len(want) + 1  # both rows without an id stay


def test_linked_ids_repeated_without_words(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " end"), (1, None), (2, ""), (1, ""), (2, " \t"), (3, "other words stand here")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 7 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_words_built_to_share_a_polynomial_hash_stay_apart(spark):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))  # Thue-Morse
    two = one.translate(str.maketrans("ab", "ba"))
    words = Words([one.encode(), two.encode()], SPACED)
    assert words.hash[0] == words.hash[1] and len(set(words.spelled(minhash.KEYS[0]).tolist())) == 2
    texts = [" ".join([w] * 3 + [w[:n]]) for n in (500, 1000) for w in (one, two)] + [one, two]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.kept and r.n_shingles == 1 for r in got) and len(got) == 6


def test_keyed_hashes_tell_short_words_apart():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("ab\x00é日") for _ in range(rng.randint(1, 40))) for _ in range(20_000)})
    w = Words([" ".join(words).encode()], SPACED)
    for key in minhash.KEYS:
        assert len(set(w.spelled(key).tolist())) == len(words)
    again = Words([("x " + " ".join(reversed(words))).encode()], SPACED).spelled(minhash.KEYS[0])
    assert again[1:].tolist() == w.spelled(minhash.KEYS[0]).tolist()[::-1]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicate(none).count() == 0
