"""Word rules, automaton and token tables against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from marketlens.llm.automaton import compile_rules
from marketlens.llm.secrets import RULES, automaton, find_spans
from marketlens.llm.text import ALNUM, SPACED, Words, slices
from marketlens.llm.tokens import part_ids, vocabulary_path

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = ["", " ", "A b,c\x00D É", "ÉÉ x-Y_z 9", "a" * 5000 + " b", "\x0b\x0ca\x1cb", "tab\tnew\nline"]


def test_words_follow_their_rule():
    for table, rule in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SPACED, r"[^\x20\x09-\x0D]+")):
        words = Words([t.encode() for t in TEXTS], table)
        want = [re.findall(rule, t.translate(LOWER)) for t in TEXTS]
        assert words.counts().tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert [words.word(i) for i in range(len(flat))] == flat
        assert len(set(words.hash.tolist())) == len(set(flat))


def test_slices_cover_all_rows_of_sliced_batches():
    batch = pa.record_batch({"text": pa.array(["aaaaa", None, "", "é" * 9, "x" * 30, "y", "z"])})
    for part in (batch, batch.slice(2), batch.slice(1, 4)):
        got = [t for run, texts in slices([part], budget=8) for t in texts if run.num_rows == len(texts)]
        assert got == [(x or "").encode() for x in part.column(0).to_pylist()]


def test_automaton_agrees_with_regular_expressions():
    rules = [(r"ab+c{2,3}", False), (r"(x|yz?)[0-9]{2}", True), (r"[^a-z\n]{4}q", False), (r"k\x20*=", True)]
    machine = compile_rules(rules)
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("abcxyzXYZ019qkK= .\n") for _ in range(rng.randint(0, 60)))
        data = np.frombuffer(text.encode() + b"\n", np.uint8)
        found = 0
        for start, end, hit in zip(*machine.scan(data), strict=True):
            for i, (rule, fold) in enumerate(rules):
                here = re.search(rule, text[start:end], re.I if fold else 0)
                assert bool(here) == bool(hit >> i & 1)
                found += bool(here)
        assert bool(found) == any(re.search(r, text, re.I if f else 0) for r, f in rules)


def test_few_and_many_stretches_scan_alike():
    machine = automaton()
    text = ("x" * 3000 + " token = " + "A1" * 10 + "\n" + "y" * 70 + "\n") * 3
    data = np.frombuffer(text.encode(), np.uint8)
    assert [x.tolist() for x in machine.scan(data, few=0)] == [x.tolist() for x in machine.scan(data, few=10**9)]


def test_secret_spans_equal_plain_matching():
    rng = random.Random(1)
    bits = ["token", "secret=", "passwd", " ", "'", '"', ":", "=", "abcdef0123", "AKIA", "ABCDEF12", "é", "\n", "-", "ghp_", "eyJ", ".", "xyz", "ſecret", "API_KEY", "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", "token=" + "a" * 200_000]
    found = find_spans([t.encode() for t in texts], automaton())
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (_, p, fold, g, n) in enumerate(RULES) for m in re.finditer(p, t, re.A | (re.I if fold else 0)) if m.end(g) - m.start(g) >= n)
        assert found.get(i, []) == want


def test_token_ids_equal_whole_text_encoding():
    known = part_ids(vocabulary_path())
    texts = ["Don't we'll I'D 's x'st it's. a's", "", "  a ", "ΟΔΟΣ, ΣΑΣ. Σ ΟΔΟΣ", "a\x1cb\x85c d e", "<|endoftext|>a <|ENDOFTEXT|> b<|startoftext|> a<|endoftext|>.",
             "é ́x ...,, 12,3. a.b, K ſ İ ǅ Éé éÉ. ñ*** 'abc' \"abc\" a' İ. µ ª º क़. \\a[] ^_`{|}~", "日本語。 текст, Straße. ﬁ"] * 2
    ids, bounds = known.texts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == known.tokenizer.encode(t, add_special_tokens=False).ids
