"""WARC archives, token files and packing: exact round trips."""

import base64
import glob
import gzip
import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from marketlens.llm import packing, tokenfile, warc
from marketlens.llm.queries import QUERIES
from marketlens.llm.tokens import vocabulary_path

TEXTS = ["The quick brown fox!", "", None, "é" * 300, "a b c " * 3000, "x", "The quick brown fox!", " \n"]


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@lru_cache(None)
def encode(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture()
def docs(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(0, 900)))) for i in range(60)] + [(3, "again"), (None, "no id")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, start int, ids string").repartition(5)


def test_packing_covers_each_id_once_without_gaps(docs):
    rows, d = docs
    got = packing.pack_documents(d, with_ids=True).collect()
    pieces, bins = {}, {}
    for r in got:
        assert len(r.ids) == r.length and crc(r.ids) == r.ids_crc32
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = sorted((str(i), encode(t) + [1]) for i, t in rows)
    have = []
    for (doc, n), own in pieces.items():
        copies = sum(1 for i, t in rows if i == doc and len(encode(t)) + 1 == n)
        own.sort()
        flat = [x for start, ids in own for x in ids]
        assert len(flat) == n * copies
        have += [(str(doc), flat)] if copies == 1 else []
    assert sorted(have) == [w for w in want if want.count(w) == 1]
    for content in bins.values():
        content.sort()
        at = 0
        for offset, length in content:
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0  # nothing is padded
    assert len(got) < 1.5 * len(rows)  # most documents are whole


@pytest.mark.parametrize("capacity", [1, 2, 100, 2048])
def test_a_bin_of_class_k_holds_k_documents(capacity):
    rng = random.Random(capacity)
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 1 + capacity // 20), rng.randint(1, 5 * capacity), capacity]) for _ in range(3000)]
    bins, full, held = packing.Bins(capacity), [], 0
    for doc, n in enumerate(lengths):
        full += bins.add(doc, np.arange(n) + 7 * doc)
        held = max(held, bins.spare - 2 * capacity, *(sum(len(p.ids) for p in w) - capacity for w in bins.open.values()), 0)
    left = list(bins.rest())
    assert held == 0 and not bins.open and not bins.aside and bins.spare == 0
    assert all(sum(len(p.ids) for p in s) == capacity for s in full)
    ends = [sum(len(p.ids) for p in s) for s in left]
    assert all(n == capacity or n & (n - 1) == 0 for n in ends) and sorted(ends, reverse=True) == ends
    seen = {}
    for s in full + left:
        for p in s:
            assert len(p.ids) and p.doc_tokens == lengths[p.doc] and p.ids.tolist() == list(range(7 * p.doc + p.start, 7 * p.doc + p.start + len(p.ids)))
            seen.setdefault(p.doc, []).append((p.start, len(p.ids)))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == n
    for s in full:
        k = capacity // len(s[0].ids)
        assert all(capacity // len(p.ids) == k for p in s[:k])
    # one cut a sequence at most, besides the whole sequences of long documents
    assert sum(map(len, seen.values())) <= len(lengths) + len(full) + len(left)


def test_token_files_round_trip(spark, docs, scratch):
    rows, d = docs
    path = scratch + "/tokens"
    tokenfile.write_token_files(d, path, length=64, file_ids=2000)
    got = sorted(tokenfile.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(encode(t)) + 1, crc(encode(t) + [2])) for i, t in rows)
    files = glob.glob(path + "/part-*")
    assert len(files) > 3
    for f in files:
        facts, batches = tokenfile.open_stream(f)
        total = sum(b.num_rows for b in batches)
        flat = []
        for i in range(total):
            ids, mask = tokenfile.sequence(batches, i)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata  # a view of the mapped file
            flat += ids[mask.to_numpy(zero_copy_only=False)].tolist()
        assert len(flat) == sum(facts["sizes"])
        assert pa.types.is_fixed_size_list(batches[0].schema.field("ids").type)


def test_empty_documents_give_no_rows(spark, scratch):
    none = spark.createDataFrame([], "doc_id long, text string")
    tokenfile.write_token_files(none, scratch + "/none")
    assert tokenfile.read_token_files(spark, scratch + "/none").count() == 0
    assert packing.pack_documents(none).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 5, "m") for i, u, h in rows], "page_id long, url string, html string, sha int, record_type string")


PAGES = [(5, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>one</p>"), (9, None, "<p>one</p>"), (7, "u", None), (8, "u", ""), (1, "http://é", "WARC/1.1\r\n\r\nbody\r\n\r\n" * 3),
         (3, "v", "z" * 3_000_000), (5, "http://a/", "<p>one</p>"), (4, "w", "é\x00\x1f"), (4, "w", "<p>one</p>"), (None, "n", "<p>one</p>"), (11, "q", "lone")]


def test_captures_round_trip(spark, scratch):
    warc.write_archives(pages(spark, PAGES).repartition(3), scratch + "/warc", file_bytes=4000)
    records = warc.read_records(spark, scratch + "/warc", with_payload=True)
    got = warc.assemble(records).collect()
    want = {}
    for i, _, h in PAGES:
        body = (h or "").encode()
        smaller = [j for j, _, g in PAGES if j is not None and (g or "").encode() == body]
        want[(str(i), body)] = ("revisit", min(smaller)) if i is not None and min(smaller) < i else ("response", None)
    assert len(got) == len(want)
    for r in got:
        assert r.request and r.metadata and r.request.concurrent_to == r.metadata.concurrent_to == r.response.record_id
        page = r.metadata.fields.get("page-id", "None")
        body = next(b for i, b in want if i == page and base64.b32encode(hashlib.sha1(b).digest()).decode() == r.response.payload_digest)
        kind, first = want[(page, body)]
        assert r.response.record_type == kind and r.metadata.fields["payload-bytes"] == str(len(body))
        assert r.metadata.fields.get("refers-to-page") == (None if first is None else str(first))
        assert r.response.payload == (body if kind == "response" else b"")
    # any gzip reader can read a whole archive
    assert all(gzip.open(f).read().startswith(b"WARC/1.1") for f in glob.glob(scratch + "/warc/part-*"))


def test_small_payloads_are_all_responses(spark, scratch):
    warc.write_archives(pages(spark, PAGES), scratch + "/least", least_bytes=100)
    assert warc.read_records(spark, scratch + "/least").where("record_type = 'revisit'").count() == 0


def test_a_missing_partner_leaves_null(spark, scratch):
    warc.write_archives(pages(spark, PAGES[:1]), scratch + "/one")
    r = warc.assemble(warc.read_records(spark, scratch + "/one").where("record_type != 'request'")).first()
    assert r.request is None and r.response is not None and r.metadata is not None


def test_no_pages(spark, scratch):
    warc.write_archives(pages(spark, PAGES).limit(0), scratch + "/none")
    assert warc.assemble(warc.read_records(spark, scratch + "/none")).count() == 0


def test_queries_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    at = 0
    for r in QUERIES["op6_token_stream_files"](spark, sf).orderBy("doc_id").collect():
        ids = encode(texts[r.doc_id]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    for r in QUERIES["op10_harmonic_packing"](spark, sf).collect():
        ids = encode(texts[r.doc_id]) + [1]
        assert r.doc_tokens == len(ids) and crc(ids[r.start:r.start + r.length]) == r.ids_crc32
