import hashlib
import random
import re

import pytest

from marketlens.llm.decontam import WINDOW, contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(WINDOW, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = set()
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i:i + k])):
                    hit |= set(range(i, i + k))
                    found |= got
        listed = sorted(str(x) for x in found if x is not None)
        if found and not listed:
            hit = set()
        out.add((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture()
def case():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab cd ef gh ij".split()) + str(rng.randint(0, 30)) for _ in range(n))
    items = [(i, text(rng.randint(13, 60))) for i in range(12)] + [(50, text(4)), (51, "one"), (52, None), (53, " ,. "), (54, "Q w e R t y u i o p a s")]
    items += [(60, items[0][1]), (61, items[0][1].upper()), (10**12, items[3][1])]
    docs = [(i, text(rng.randint(0, 200))) for i in range(30)]
    for i in range(30, 60):
        item = words(rng.choice(items[:12])[1])
        lo = rng.randint(0, len(item) - 5)
        docs.append((i, text(rng.randint(0, 40)) + ", " + " - ".join(item[lo:lo + rng.randint(5, 40)]) + "! " + text(rng.randint(0, 40))))
    docs += [(70, None), (71, ""), (72, "One"), (73, items[0][1]), (73, items[0][1]), (73, "other"), (74, "q W e r t Y u i o p a S d " * 40), (75, "é" * 50_000), (None, "one two"), (None, None)]
    return docs, items


def test_equals_brute_force_with_clashing_columns(spark, case):
    docs, items = case
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, key string, h int").repartition(5)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string").repartition(3)
    got = contamination(d, b).drop("text_hash").collect()
    assert len(got) == len(set(docs))  # repeated rows are one
    assert {tuple(r) for r in got} == brute(docs, items)


def test_empty_tables(spark, case):
    docs, _ = case
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, none).where("n_hit > 0 or contaminated").count() == 0
    assert contamination(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


@pytest.mark.parametrize("space", ["\u00a0", "\u0085", "\u2003", "\u2028", "\u202f", "\u3000"])
def test_wide_spaces_are_word_characters(spark, space):
    run = [f"w{i}" for i in range(13)]
    items = [(1, " ".join(run)), (2, " ".join(f"v{i}{space}u" for i in range(13))), (3, f"a{space}b c")]
    docs = [(1, f"x{space}y {space} z{space}{space}t " + " ".join(run) + f" q{space}r"),  # a run of just 13 words behind them
            (2, " ".join(f"v{i}{space}u" for i in range(7)) + " end"),  # 7 words that would be 14 pieces
            (3, "so " + items[1][1] + f" p{space}q"), (4, f"k a{space}b c d"), (5, "a b c")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = contamination(d, spark.createDataFrame(items, "item_id long, text string")).drop("text_hash").collect()
    assert {tuple(r) for r in got} == brute(docs, items)


def test_drop_keeps_rows_and_columns(spark, case):
    docs, items = case
    d = spark.createDataFrame([(i, t, "z", 3) for i, t in docs], "doc_id long, text string, _id string, _text int")
    out = drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == d.columns
    bad = {(r[0], r[1]) for r in brute(docs, items) if r[5]}
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(str(r) for r in d.select("doc_id", "text").collect() if (r[0], len(words(r[1]))) not in bad)
