"""License scans, quality and toxicity: brute force and held-out accuracy."""

import random
import textwrap
import zlib

import numpy as np
import pytest

from marketlens.llm import licenses, quality, toxicity
from marketlens.llm.queries import QUERIES
from marketlens.llm.text import ALNUM, Words


def words(text):
    w = Words([(text or "").encode()], ALNUM)
    return [w.word(i) for i in range(len(w.start))]


def test_license_blocks_equal_brute_force(spark):
    rng = random.Random(7)
    notices = [words(t) for _, t in licenses.TEMPLATES]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 4)):
            own = [w for w in rng.choice(notices) if rng.random() < rng.choice([1, 0.9, 0.8, 0.5])]
            rng.shuffle(own)
            lines.append(" ".join(own + [f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 9))]))
        docs.append((i, "\n".join(lines)))
    docs += [(200, None), (201, ""), (202, "Under the\nMIT  License. CC-BY-NC; apache license version 2"), (203, "under the mit\tlicense " * 5000), (None, "cc by nc"), (0, docs[0][1])]
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, labels string").repartition(4)
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan_licenses(d).collect())
    want = []
    for i, t in docs:
        w = words(t)
        places = [(p, label) for phrase, label in licenses.PHRASES for p in range(len(w)) if w[p:p + len(phrase.split())] == phrase.split()]
        found = {}
        for label, notice in licenses.TEMPLATES:
            size = len(words(notice))
            for start in range(0, len(w), size):  # windows of two template lengths
                c = len(set(words(notice)) & set(w[start:start + 2 * size])) / len(set(words(notice)))
                if c >= licenses.CONTAIN - 1e-9:
                    found[label] = max(c, found.get(label, 0))
        base = sorted({x for _, x in places})
        where = [p for p, _ in places]
        want.append((str(i), len(w), len(places), min(where, default=None), max(where, default=None), ",".join(base), ",".join(sorted({*base, *found})), round(1.0 if base else max(found.values(), default=0.0), 9)))
    assert got == sorted(want, key=lambda r: tuple(map(str, r))) or sorted(map(str, got)) == sorted(map(str, want))


def test_wrapped_notices_are_found_and_strewn_words_are_not(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(f"x{rng.randint(0, 9999)}" for _ in range(n))
    docs, want = [], {}
    for i, (label, notice) in enumerate(licenses.TEMPLATES):
        wrapped = "\n# ".join(textwrap.wrap(notice, 75))
        docs += [(4 * i, filler(rng.randint(0, 300)) + "\n# " + wrapped + "\n" + filler(50)), (4 * i + 1, f"{filler(501)} {notice} {filler(3000)}"), (4 * i + 2, " ".join(f"{w} {filler(3)}" for w in notice.split()))]
        want |= {4 * i: label, 4 * i + 1: label}
    rows = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in rows:
        if r.doc_id in want:
            assert want[r.doc_id] in r.labels.split(",") and r.score == 1.0
            m = max((m for m in r.matches if m.label == want[r.doc_id]), key=lambda m: m.containment)
            assert m.containment == 1.0 and 0 <= m.first <= m.last < r.n_words
        else:
            assert r.labels == "" and not r.matches


def test_each_filter_drops_windows_and_none_that_hold_the_template():
    rng = np.random.default_rng(4)
    total, need = 60, 8
    template = licenses.Template("t", 10, np.sort(rng.choice(40, 10, replace=False)), need)
    window = np.repeat(np.arange(4000), 14)  # some ranks twice, so the windows' sizes differ
    rank = np.minimum(rng.integers(0, total, len(window)), rng.integers(5, total, len(window)))
    rank[rng.random(len(rank)) < 0.3] = 0
    rank[:14 * 200] = np.concatenate([np.concatenate([rng.choice(template.ranks, 9, replace=False), rng.integers(0, total, 5)]) for _ in range(200)])
    found, both, (prefix, length, positional) = licenses.containing(window, rank, template, total)
    held = [len(set(rank[window == w]) & set(template.ranks)) for w in range(4000)]
    assert found.tolist() == [w for w in range(4000) if held[w] >= need] and both.tolist() == [held[w] for w in found]
    assert 4000 > prefix > length > positional > len(found)


@pytest.mark.parametrize("size", [1, 3, 10])
def test_windows_hold_every_stretch(size):
    for n in range(0, 45):
        bounds = licenses.windows(np.array([n]), size)
        of = lambda i: set(licenses.members(np.array([i]), np.array([0]), np.array([0]), bounds, size)[0].tolist())
        assert all(of(i) & of(min(i + size - 1, n - 1)) for i in range(n)) and bounds[1] == len(set().union(*map(of, range(n))))


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    one, two = (" ".join(f"{c}{i}" for i in range(9)) for c in "pq")
    monkeypatch.setattr(Words, "hash", property(lambda self: np.zeros(len(self.start), np.uint64), lambda self, value: None), raising=False)
    vocabulary = licenses._Vocabulary(one.split())
    assert vocabulary.codes(Words([two.encode(), one.encode()], ALNUM)).tolist() == [-1] * 9 + list(range(9))


def test_licenses_without_templates_or_documents(spark):
    d = spark.createDataFrame([(1, "under the mit license")], "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(d, []).collect()] == ["mit"]
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_ordinal_quality"](spark, sf).join(spark.read.parquet(sf + "/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 50 and all(r.held_out == held(r.doc_id) for r in rows)
    assert all(r.accepted for r in out if r.quality == 1)  # clean documents stay
    assert np.mean([not r.accepted for r in out if r.quality == 0]) >= 0.9
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        g = int(rng.integers(0, 4))
        rows.append((g, [g * 7 + int(k) for k in rng.integers(0, 7, 5)] + [50], [0.2] * 5 + [0.1]))
    model = quality.fit(rows, grades=4)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([sum(model.weights[d] * v for d, v in zip(dims, vals, strict=True)) for _, dims, vals in rows])
    expected = model.tails(score).sum(axis=1)
    assert np.corrcoef(expected, [g for g, _, _ in rows])[0, 1] > 0.95
    assert quality.fit([], 3).tails(np.zeros(1)).sum() > 1.9 and quality.fit([(0, [1], [1.0])], 3).tails(np.zeros(1)).sum() < 0.1


ODD = [(900, None, "t"), (901, "", "t"), (902, "w" * 40_000, "t"), (None, "a b", "t")]


def test_odd_rows_are_graded_and_kept_in_shape(spark):
    d = spark.createDataFrame([(i, "good plain words here", "t") for i in range(30)] + [(i + 30, "BAD!! BAD!! BAD!!", "t") for i in range(30)] + ODD, "doc_id long, text string, tail string")
    labels = spark.createDataFrame([(i, int(i < 30), None) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    kept = quality.accept_documents(d, model)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {*range(30)} <= set(ids) and not {*range(30, 60), 900, 901} & set(ids)
    assert quality.grade_documents(d.drop("tail"), model).count() == 64
    assert quality.grade_documents(d.drop("tail").limit(0), quality.train(d, labels.limit(0))).count() == 0


def toxic_case():
    rng = random.Random(1)
    bad = ["blockhead", "nitwit", "dunce", "numskull"]
    plain = [a + b for a in "ba ce di fo gu ha".split() for b in "lan ter mos rin".split()]
    text = lambda k: [rng.choice(plain) for _ in range(k)]
    rows, labels = [], []
    for i in range(400):
        t, toxic = text(rng.randint(5, 40)), i % 4 == 0
        if toxic:
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels, bad, text


def test_toxicity_tolerates_gaps_and_inserted_characters(spark):
    rows, labels, bad, text = toxic_case()
    odd = {5000: None, 5001: "", 5002: " ".join(text(9000)), 5003: "zz " * 3}
    made = {}
    for k, w in enumerate(bad):
        made[6000 + k] = " ".join([*text(6), "-".join(w), *text(6)])
        made[6100 + k] = " ".join([*text(6), *w, *text(6)])
        made[6200 + k] = " ".join([*text(6), w[:3] + "x" + w[3:], *text(6)])
        made[6300 + k] = " ".join([*text(6), w.upper() + "!!", *text(6)])
        made[6400 + k] = " ".join(text(6)) + " " + "7".join([w[:4], w[4:]])
    more = [*odd.items(), *made.items(), (None, bad[0])]
    d = spark.createDataFrame([(i, t, 0.5) for i, t in rows + more], "doc_id long, text string, score double").repartition(4)
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_documents(d, model).collect()}
    assert len(got) == len(rows) + len(more)
    assert all(got[i].predicted == t for i, _, t in labels if held(i)) and all(got[i].held_out == held(i) for i, _, _ in labels)
    assert [i for i in made if not got[i].predicted] == []
    assert got[None].predicted == 1 and not any(got[i].predicted for i in odd)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.score_documents(d, toxicity.train(d, none)).collect()] == [0, 0]
    assert toxicity.score_documents(d.limit(0), toxicity.train(d.limit(0), none)).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(d, toxicity.train(d, one)).count() == 2


def test_toxicity_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op5_string_kernel_toxicity"](spark, sf).join(spark.read.parquet(sf + "/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.94


def test_toxicity_in_other_alphabets(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for bad, syllables in ((["придурок", "болван"], "на ко ли ста вер пом дру год".split()), (["μαλακας", "ηλιθιος"], "κα λο τρι μεν σπι θαλ νερ".split())):
        plain = [a + b for a in syllables for b in syllables]
        for _ in range(300):
            t, toxic, i = [rng.choice(plain) for _ in range(rng.randint(5, 30))], len(rows) % 4 == 0, len(rows)
            if toxic:
                t.insert(rng.randrange(len(t)), rng.choice(bad))
            rows.append((i, " ".join(t)))
            labels.append((i, 1, int(toxic)))
    made = {9000: "на ко ПРИДУРОК лина", 9001: "коли прижду.рок стана", 9002: "κατρι μα-λακας λοκα"}
    d = spark.createDataFrame([*rows, *made.items()], "doc_id long, text string").repartition(3)
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(d, model).collect()}
    out = [(i, t) for i, _, t in labels if held(i)]
    assert len(out) > 80 and all(got[i] == t for i, t in out) and all(got[i] for i in made)


def test_the_sample_bounds_what_reaches_the_driver(spark, monkeypatch):
    """One doc_id with very many texts is one text to the fit."""
    many = spark.range(30_000).selectExpr("1L as doc_id", "concat('copy number ', id, ' of one document') as text")
    docs = many.unionByName(spark.createDataFrame([(i, f"plain words {i} here") for i in range(2, 60)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1)] + [(i, i % 2, i % 2) for i in range(2, 60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, *a: seen.append(len(rows)) or (lambda: None))
    quality.train(docs, labels, sample=10)
    assert seen[0] <= quality.GRADES * 10
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: seen.append(len(x)) or (1.0, 0.0))
    toxicity.train(docs, labels)
    assert len(seen) < 2 or seen[1] <= 40


def test_kernel_equals_an_explicit_count():
    """Values and feature vectors against all subsequences of a string, written out."""
    from itertools import combinations

    def explicit(word):
        code = [31, *(ord(c) - 96 for c in word)]
        out = {}
        for at in combinations(range(len(code)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                number = 0
                for i in at:
                    number = number << 5 | code[i]
                # a subsequence in several places counts in each of them
                out.setdefault(number, []).append(toxicity.DECAY ** (at[-1] - at[0] + 1))
        return out

    rng = np.random.default_rng(3)
    weights = rng.normal(size=(1 << 20) + 1)
    words = ["blockhead", "abc", "banana", "nitwit", "zzzzzzz", "a"]
    want, norms = [], []
    for w in words:
        own = explicit(w)
        norms.append(np.sqrt(sum(m * m for masses in own.values() for m in masses)))
        want.append(sum(weights[n] * sum(masses) for n, masses in own.items()) / max(norms[-1], 1e-6))
    assert np.allclose(toxicity.values([w.encode() for w in words], weights), want, rtol=1e-5)
    known = np.unique([n for w in words for n in explicit(w)])
    rows = toxicity.kernel_rows([w.encode() for w in words], known)
    for w, row, norm in zip(words, rows, norms, strict=True):
        assert np.allclose(row, [sum(explicit(w).get(n, [])) / max(norm, 1e-6) for n in known.tolist()], atol=1e-5)
