"""Operator 13: personal data, by information-theoretic sanitisation.

The base kinds (mail and network addresses, card and phone numbers) are found
by their patterns; each distinct value is a protected *entity*.  A text can
give an entity away without naming it, through the terms that go with it.  How strongly, the corpus
tells: with P(e) the share of documents that hold entity e and P(e|t) the share
of the documents with term t that hold e within ``window`` words of t, the term
tells PMI(e; t) = log2 P(e|t) / P(e) bits of it and leaves IC(e|t) = -log2 P(e|t) bits open.  A
term *discloses* e if

* it tells at least ``gain`` bits (an address that stands everywhere is no secret),
* it leaves at most ``bits`` open, and no more than e's generalisation g(e) (the mail
  domain, the network, the issuer, the area) leaves, IC(e|g) = -log2 P(e|g),
* ``least`` different texts show both together (copies are no evidence).

Disclosing terms are spans of the kind ``term`` in all documents.  ``sanitise``
removes them, and generalises entities: an entity whose g(e) leaves at least
``bits`` open is replaced by g(e), any other by its kind alone.

Three passes over the texts: entities and the terms around them; document
counts of those terms alone; places of the disclosing terms.  Between them go a
table of aggregated counts and a bitmap of fixed size; what passes the bitmap by chance
is removed by a join on the terms themselves.

Rows: null and empty texts have no spans; null or repeated doc_ids and repeated
rows are read like any others, one row out for one row in; an empty table
gives no rows; further columns are ignored by ``find_private`` and kept by ``sanitise``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import cut, free_name
from marketlens.llm.text import ALNUM, Words, slices

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SPANS = "array<struct<kind:string,start:long,end:long,key:string>>"

# The patterns of the base kinds.  They find what the plain patterns with
# backtracking find: no class holds the byte that ends it, so giving back never helps.
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def _emails(data: bytes) -> Iterator[tuple[int, int]]:
    """Every match holds one @: what stands before it, as far back as the last match lets it."""
    done, at = 0, data.find(b"@")
    while at >= 0:
        domain = _DOMAIN.match(data, at + 1)
        if domain:
            start = at
            while start > done and data[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = data.find(b"@", max(at + 1, done))


def _digits(value: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", value)


def _luhn(digits: bytes) -> bool:
    own = [d - 48 for d in reversed(digits)]
    return (sum(own[0::2]) + sum(_DOUBLED[d] for d in own[1::2])) % 10 == 0


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base matches, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(data)]
    for m in _IP.finditer(data):
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (x.lstrip(b"0") for x in m[0].split(b"."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(data):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(data):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def entity(kind: int, value: bytes) -> tuple[str, str]:
    """A match's entity and its generalisation."""
    if kind == 0:
        value = value.lower()
        general = value[value.rindex(b"@") + 1:]
    elif kind == 1:
        value = b".".join(p.lstrip(b"0") or b"0" for p in value.split(b"."))
        general = b".".join(value.split(b".")[:2])
    else:
        value = _digits(value)
        general = value[:6] if kind == 2 else value[:-7]
    return f"{KINDS[kind]}:{value.decode()}", f"{KINDS[kind]} {general.decode()}"


class _Scan:
    """A run of documents with its base spans and, if asked for, its words."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.raw = b"\n".join(texts) + b"\n"  # no match holds a line end
        self.bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.spans = base_spans(self.raw)
        self._before = None

    def doc(self, at: int) -> int:
        return int(np.searchsorted(self.bounds, at, side="right")) - 1

    def words(self) -> Words:
        """Words; ``free``: the indices of those outside all base spans."""
        words = Words(self.texts, ALNUM)
        inside = np.zeros(len(words.start), bool)
        for _, a, b in self.spans:
            inside[np.searchsorted(words.end, a, side="right"):np.searchsorted(words.start, b)] = True
        self.free = np.flatnonzero(~inside)
        return words

    def place(self, doc: int, at: int) -> int:
        """A byte of the run as a code point of its document."""
        if self._before is None:
            self._before = np.concatenate([[0], np.cumsum((np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80)])
        return int(self._before[at] - self._before[self.bounds[doc]])


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def contexts(docs: DataFrame, window: int) -> DataFrame:
    """(entity, general, term, h, texts, n): in how many documents, and in how many
    different texts, an entity (term null), a generalisation (entity null), or an entity with a
    term within ``window`` words of it stands.  ``h``: a hash of the term."""
    row = "entity string, general string, term string, h long, copy long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            scan = _Scan(texts)
            if not scan.spans:
                continue
            own = sorted({scan.doc(a) for _, a, _ in scan.spans})
            copies = rows.column(1).to_numpy()[own]
            few = _Scan([texts[i] for i in own])
            words = few.words()
            seen: set[tuple] = set()
            for kind, a, b in few.spans:
                doc = few.doc(a)
                name, general = entity(kind, few.raw[a:b])
                seen |= {(doc, name, general, -1), (doc, None, general, -1)}
                lo, hi = np.searchsorted(few.free, [np.searchsorted(words.end, a, side="right"), np.searchsorted(words.start, b)])
                for i in few.free[max(0, lo - window):hi + window].tolist():
                    if words.first[doc] <= i < words.first[doc + 1]:
                        seen.add((doc, name, general, i))
            # a term near an entity twice counts once
            out = {(doc, name, general, words.word(i) if i >= 0 else None, int(_signed(words.hash[i:i + 1])[0]) if i >= 0 else None) for doc, name, general, i in seen}
            doc, name, general, term, h = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(general, pa.string()), pa.array(term, pa.string()), pa.array(h, pa.int64()), pa.array(copies[list(doc)], pa.int64())],
                                             ["entity", "general", "term", "h", "copy"])

    keys = ["entity", "general", "term", "h"]
    found = _given(docs).withColumn("copy", F.xxhash64("text")).mapInArrow(read, row)
    return (found.groupBy(*keys, "copy").agg(F.count("*").alias("n"))
            .groupBy(*keys).agg(F.count("*").alias("texts"), F.sum("n").alias("n")))


BITS = 24  # of the bitmap of term hashes: 2 MB


def _bitmap(terms: DataFrame) -> np.ndarray:
    """The terms' hashes as a bitmap of fixed size; all of its pieces together have 2 MB."""
    bit = F.col("h").bitwiseAND((1 << BITS) - 1)
    pieces = terms.select(F.bitmap_bucket_number(bit + 1).alias("k"), F.bitmap_bit_position(bit + 1).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b")).collect()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for k, b in pieces:
        bitmap[(k - 1) * 4096:k * 4096] = np.frombuffer(b, np.uint8)
    return bitmap


def _maybe(words: Words, at: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = _signed(words.hash)[at] & ((1 << BITS) - 1)
    return at[(bitmap[bit >> 3] >> (bit & 7)) & 1 == 1]


def document_counts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(term, n_term): in how many documents each term in the bitmap stands outside base spans."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            scan = _Scan(texts)
            words = scan.words()
            at = _maybe(words, scan.free, bitmap)
            doc = np.searchsorted(words.first, at, side="right") - 1
            pairs = {(d, words.word(i)) for d, i in zip(doc.tolist(), at.tolist(), strict=True)}
            counts = pc.value_counts(pa.array([w for _, w in pairs], pa.string()))
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["term", "n_term"])

    return _given(docs).mapInArrow(read, "term string, n_term long").groupBy("term").agg(F.sum("n_term").alias("n_term"))


def disclosing_terms(docs: DataFrame, window: int = 8, least: int = 3, bits: float = 1.0, gain: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Two tables: disclosing pairs (term, h, entity, general, n, n_term, tells,
    leaves) in bits, and entities (entity, general, n_entity, general_leaves)."""
    counts = cut(contexts(docs, window), "contexts")
    total = docs.count()
    of_general = counts.where("entity is null").select("general", F.col("n").alias("n_general"))
    entities = (counts.where("term is null and entity is not null").select("entity", "general", F.col("n").alias("n_entity"))
                .join(of_general, "general").select("entity", "general", "n_entity", F.log2(F.col("n_general") / F.col("n_entity")).alias("general_leaves")))
    pairs = counts.where((F.col("term").isNotNull()) & (F.col("texts") >= least)).select("entity", "term", "h", "n")
    known = document_counts(docs, _bitmap(pairs))
    leaves = F.log2(F.col("n_term") / F.col("n"))
    terms = (pairs.join(known, "term").join(entities, "entity")
             .select("term", "h", "entity", "general", "n", "n_term", (F.log2(F.lit(float(total)) / F.col("n_entity")) - leaves).alias("tells"), leaves.alias("leaves"), "general_leaves")
             .where((F.col("tells") >= gain) & (F.col("leaves") <= bits) & (F.col("leaves") <= F.col("general_leaves"))).drop("general_leaves"))
    return cut(terms, "terms"), entities


def _located(docs: DataFrame, text: str, bitmap: np.ndarray) -> DataFrame:
    """The rows with ``_base`` spans, and ``_maybe`` spans of words in the bitmap."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.string())]))
        search = bool(bitmap.any())
        for rows, texts in slices(batches, text):
            scan = _Scan(texts)
            base: list[list] = [[] for _ in texts]
            for k, a, b in scan.spans:
                doc = scan.doc(a)
                base[doc].append({"kind": KINDS[k], "start": scan.place(doc, a), "end": scan.place(doc, b), "key": entity(k, scan.raw[a:b])[0]})
            maybe: list[list] = [[] for _ in texts]
            if search:
                words = scan.words()
                for i in _maybe(words, scan.free, bitmap).tolist():
                    doc = scan.doc(words.start[i])
                    maybe[doc].append({"kind": TERM, "start": scan.place(doc, words.start[i]), "end": scan.place(doc, words.end[i]), "key": f"{TERM}:{words.word(i)}"})
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(base, kind), pa.array(maybe, kind)], [*rows.schema.names, "_base", "_maybe"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(read, f"{names}, _base {SPANS}, _maybe {SPANS}")


def _with_spans(docs: DataFrame, text: str, terms: DataFrame, *unused: str) -> DataFrame:
    """The rows, without some columns, with ``_base`` and ``_terms`` spans: places of exactly the disclosing terms."""
    rows = cut(_located(docs, text, _bitmap(terms)).drop(*unused).withColumn("_row", F.monotonically_increasing_id()), "private")
    keys = terms.select(F.concat(F.lit(f"{TERM}:"), "term").alias("key")).distinct()
    sure = (rows.select("_row", F.explode("_maybe").alias("s")).select("_row", "s.*").join(keys, "key", "left_semi")
            .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "key"))).alias("t")))
    terms_of = F.coalesce(F.transform("t", lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["key"].alias("key"))), F.array().cast(SPANS))
    none = rows.where("size(_maybe) = 0").withColumn("_terms", F.array().cast(SPANS))
    some = rows.where("size(_maybe) > 0").join(sure, "_row", "left").withColumn("_terms", terms_of).drop("t")
    return none.unionByName(some).drop("_maybe", "_row")


def find_private(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end; base kinds as listed, then
    disclosing terms; each by start).  Offsets count code points, ends are exclusive."""
    terms, _ = disclosing_terms(docs, **thresholds)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _with_spans(own, "text", terms, "text")
    return found.select("doc_id", F.transform(F.concat("_base", "_terms"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def sanitise(docs: DataFrame, bits: float = 1.0, **thresholds) -> DataFrame:
    """The same rows and columns: entities generalised or removed, disclosing
    terms removed; ``n_chars`` follows the text."""
    terms, entities = disclosing_terms(docs, bits=bits, **thresholds)
    text = next(c for c in docs.columns if c.lower() == "text")
    row = free_name("row", docs)
    own = cut(_with_spans(docs.withColumn(text, F.col(text).cast("string")), text, terms).withColumn(row, F.monotonically_increasing_id()), "sanitise")
    kind = F.split_part("key", F.lit(":"), F.lit(1))
    # what e's generalisation leaves open decides whether it may stay
    marks = entities.select(F.col("entity").alias("key"), F.concat(F.lit("["), F.when(F.col("general_leaves") >= bits, F.col("general")).otherwise(F.split_part("general", F.lit(" "), F.lit(1))), F.lit("]")).alias("mark"))
    spans = own.select(row, F.explode(F.concat("_base", "_terms")).alias("s")).select(row, "s.*")
    marked = (spans.join(marks, "key", "left").withColumn("mark", F.coalesce("mark", F.concat(F.lit("["), kind, F.lit("]"))))
              .groupBy(row).agg(F.sort_array(F.collect_list(F.struct("start", "end", "mark"))).alias("_marks")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            values = batch.column(at).to_pylist()
            for i, marks in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if marks:
                    old, out, done = values[i], [], 0
                    for m in marks:
                        if m["start"] >= done:
                            out += [old[done:m["start"]], m["mark"]]
                        done = max(done, m["end"])
                    values[i] = "".join(out) + old[done:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(values, pa.string())).select(range(batch.num_columns - 1))

    rewritten = own.drop("_base", "_terms").join(marked, row, "left").drop(row)
    out = rewritten.mapInArrow(write, docs.withColumn(text, F.col(text).cast("string")).schema)
    for c in docs.columns:
        if c.lower() == "n_chars":
            out = out.withColumn(c, F.when(F.col(text).isNull(), F.col(c)).otherwise(F.char_length(text)).cast(docs.schema[c].dataType))
    return out


def private_digests(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_private``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != TERM)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
