"""Personal data: base kinds against plain patterns, disclosure against direct counting."""

import hashlib
import math
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import sanitise
from marketlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
]


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def plain(text):
    return [(k, m.start(), m.end()) for k, p, ok in PLAIN for m in re.finditer(p, text or "") if ok(m[0])]


PIECES = ["a", "Z.9", "@", "@b", ".", ".c", "-", "+", "+1", "1", "12", "255", "256", "007", "10.0.0.1", " ", "  ", "(", ")", "\n", "é", "中", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123 456-78",
          "x@y.de", "a@b@c.d.e", "..", "1.2.3.4.5.6.7.8", "5500005555555559", "%", "_"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=4))
def test_base_spans_equal_plain_patterns(texts):
    scan = sanitise._Scan([t.encode() for t in texts])
    got = [[] for _ in texts]
    for k, a, b in scan.spans:
        doc = scan.doc(a)
        got[doc].append((sanitise.KINDS[k], scan.place(doc, a), scan.place(doc, b)))
    assert got == [plain(t) for t in texts]


def test_long_texts_take_linear_time():
    n = 300_000
    for text in ("a" * n, "1" * n, "+1" + "(" * n, "a" * n + "@" + "b" * n, "@" * n, "1." * n, "+" * n, "1 " * n):
        sanitise.base_spans(text.encode())


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, len(t or ""), "z") for i, t in texts], "doc_id long, text string, n_chars int, spans string").repartition(4)


def corpus(seed=3, filler=400):
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [some(rng.randint(0, 40)) for _ in range(filler)]
    for i in range(12):  # the nickname stands with one address in different texts
        texts.append(f"{some(9)} Quillfoot wrote from quill@mail.example.org that {some(6)}")
    texts += [f"{some(5)} as QUILLFOOT said {some(5)}"] * 3             # without the address
    texts += ["copies only: Oddling odd@mail.example.org"] * 9          # one text, many copies
    texts += [f"{some(3)} support@firm.example.com hotline {i}" for i in range(200)]  # stands everywhere
    texts += [f"rareword{i} {some(4)} user{i}@mail.example.org {some(4)}" for i in range(40)]
    texts += [f"{some(4)} lonely@only.example.net Hermit {some(i)}" for i in range(4)]
    texts += [None, "", "\n"]
    return list(enumerate(texts))


def brute(texts, window=8, least=3, bits=1.0, gain=4.0):
    """Disclosing terms by counting, and the spans of each text."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joint, copies, of_entity, of_general, of_term = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    general = {}
    for i, text in texts:
        text = (text or "").translate(low)
        base = plain(text)
        words = [m for m in word.finditer(text) if not any(m.start() < b and m.end() > a for _, a, b in base)]
        for m in words:
            of_term[m[0]].add(i)
        for k, a, b in base:
            name, general_of = sanitise.entity(sanitise.KINDS.index(k), text[a:b].encode())
            general[name] = general_of
            of_entity[name].add(i)
            of_general[general_of].add(i)
            before, after = [m for m in words if m.end() <= a], [m for m in words if m.start() >= b]
            for m in before[-window:] + after[:window]:
                joint[name, m[0]].add(i)
                copies[name, m[0]].add(text)
    terms = set()
    for (name, term), own in joint.items():
        leaves = math.log2(len(of_term[term]) / len(own))
        tells = math.log2(len(texts) / len(of_entity[name])) - leaves
        open_ = math.log2(len(of_general[general[name]]) / len(of_entity[name]))
        if len(copies[name, term]) >= least and tells >= gain and leaves <= bits and leaves <= open_:
            terms.add((term, name))
    spans = {}
    for i, text in texts:
        base = plain(text)
        more = [("term", m.start(), m.end()) for m in word.finditer((text or "").translate(low)) if m[0] in {t for t, _ in terms} and not any(m.start() < b and m.end() > a for _, a, b in base)]
        spans[i] = base + more
    return terms, spans


def test_disclosure_equals_direct_counting(spark):
    texts = corpus()
    terms, spans = brute(texts)
    got, _ = sanitise.disclosing_terms(rows_of(spark, texts))
    assert {(r.term, r.entity) for r in got.collect()} == terms
    assert ("quillfoot", "email:quill@mail.example.org") in terms
    assert not {t for t, _ in terms} & {"oddling", "hotline", "copies"} and not any(t.startswith(("word", "rareword")) for t, _ in terms)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in sanitise.find_private(rows_of(spark, texts)).collect()}
    assert found == spans and sum(k == "term" for s in spans.values() for k, _, _ in s) >= 15


def test_sanitised_texts(spark):
    texts = corpus()
    out = sanitise.sanitise(rows_of(spark, texts))
    assert out.columns == ["doc_id", "text", "n_chars", "spans"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts)
    joined = "\n".join(r.text or "" for r in rows.values())
    assert "@" not in joined and "quillfoot" not in joined.lower()
    assert "[email mail.example.org]" in joined          # many share the domain
    assert "[email only.example.net]" not in joined      # the domain itself gives the address away
    for i, text in texts:
        assert rows[i].n_chars == len(rows[i].text or "") and rows[i].spans == "z"
        if text is None or not plain(text) and "quillfoot" not in text.lower():
            assert rows[i].text == text


def test_terms_that_meet_in_the_bitmap_are_told_apart(spark, monkeypatch):
    texts = corpus(5, 60)
    want = brute(texts, gain=2.0)[1]
    monkeypatch.setattr(sanitise, "_maybe", lambda words, at, bitmap: at)  # everything passes
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in sanitise.find_private(rows_of(spark, texts), gain=2.0).collect()}
    assert found == want


def digest(text):
    base = plain(text)
    return (*(sum(k == kind for k, _, _ in base) for kind in sanitise.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())


def test_table_rules(spark):
    rows = [(1, None), (2, ""), (3, "mail a@b.cd now"), (3, "mail a@b.cd now"), (None, "+49 30 1234567 é 10.0.0.1"), (4, "é 4111 1111 1111 1111")]
    docs = rows_of(spark, rows)
    got = sanitise.private_digests(sanitise.find_private(docs)).collect()
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=str) == sorted(((i, *digest(t)) for i, t in rows), key=str)
    assert sanitise.find_private(docs.limit(0)).count() == 0 and sanitise.sanitise(docs.limit(0)).count() == 0


def test_query_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_disclosure_sanitisation"](spark, SF001).collect()}
    assert got.keys() == texts.keys()
    _, spans = brute(list(texts.items()))
    for i, r in got.items():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == digest(texts[i])
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans[i])
    assert any(r.n_email for r in got.values()) and any(r.n_phone for r in got.values())
