"""The pipeline's stages on a small corpus, each against its own input."""

import random

import pytest

import corpus_pipeline as P
from marketlens.llm.decontam import contamination
from marketlens.llm.minhash import near_duplicates

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, tail string"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(11)
    plain = [a + b for a in "ba ce di fo gu ha".split() for b in "lan ter mos rin".split()]
    text = lambda n: " ".join(rng.choice(plain) + str(rng.randint(0, 9)) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        bad = i % 5 == 1
        rows.append((i, " ".join(f"{w.upper()}!!" for w in text(40).split()) if bad else text(rng.randint(20, 120))))
        labels.append((i, 0 if bad else 1, 0))
    item = text(40)
    rows += [(300, text(20) + " " + item + " " + text(20)), (301, rows[0][1]), (302, rows[0][1] + " end"), (303, text(30) + " token=abcdef0123456789 " + text(30)),
             (304, None), (305, ""), (306, rows[2][1]), (306, rows[2][1]), (None, text(50)), (307, text(30_000))]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], COLUMNS).repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path


def ids(df):
    return sorted(r[0] for r in df.where("doc_id is not null").select("doc_id").collect())


def test_stages_take_effect_and_keep_the_rest(spark, sf):
    docs = spark.read.parquet(sf + "/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "pack"]
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == columns
        seen[name] = (before, docs)
    kept = ids(seen["quality"][1])
    assert set(kept) >= {i for i in range(200) if i % 5 != 1} and not {1, 6, 11, 304, 305} & set(kept)
    before, after = seen["near_dedup"]
    want = {r.doc_id for r in near_duplicates(before, k=5).collect() if r.kept}
    assert ids(after) == sorted(want) and {0, 2} <= want and not {301, 302, 306} & want
    before, after = seen["decontaminate"]
    bad = {r.doc_id for r in contamination(before, spark.read.parquet(sf + "/benchmark.parquet")).where("contaminated").collect()}
    assert bad == {300} and set(ids(after)) == set(ids(before)) - bad
    before, after = seen["secrets"]
    old, new = ({r.doc_id: r for r in d.collect()} for d in (before, after))
    assert set(old) == set(new) and all(old[i] == new[i] for i in old if i != 303)
    assert "abcdef0123456789" not in new[303].text and "[secret]" in new[303].text and new[303].n_chars == len(new[303].text)
    pieces = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == set(new) and sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    whole = P.run(spark, sf).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in whole) == sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in pieces)


def test_an_empty_table_passes_all_stages(spark, sf):
    docs = spark.read.parquet(sf + "/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
