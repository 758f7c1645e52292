"""Operator 7: secret scans by one combined automaton.

All rules are compiled into one minimal deterministic automaton
(``automaton``); each text is read once, byte by byte, for all rules together.
The automaton says which stretches of a text hold a match of which rules; only
there the exact bounds are taken, leftmost first and without overlap per kind.
No match can cross a stretch's ends, so texts of any length are scanned whole.

Rows: a null or empty text has no spans; null or repeated doc_ids and repeated
rows are scanned like any others, one row out for one row in; an empty table
gives no rows; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.automaton import Automaton, compile_rules
from marketlens.llm.text import slices

# Kind, pattern, letters in either case, group that must have a
# least length (0: the whole match), that length.
BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 18),
    ("hex", r"[0-9a-f]+", False, 0, 16),
]
MORE = [
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 0, 39),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]+", False, 0, 24),
    ("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 40),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 0),
]
RULES = BASE + MORE


def scan_form(pattern: str, group: int, least: int) -> str:
    """The pattern as the automaton looks for it: where the part of a least
    length is one class at the end, its least count is built in."""
    if group or re.fullmatch(r"\[[^\]]*\]\+", pattern):
        return re.sub(r"\+(\)?)$", rf"{{{least},}}\1", pattern)
    return pattern


@lru_cache(1)
def automaton() -> Automaton:
    # the further rules start with rare letters, and need no counts to be rare
    return compile_rules([(scan_form(p, g, n) if i < len(BASE) else p, fold) for i, (_, p, fold, g, n) in enumerate(RULES)])


@lru_cache(1)
def _exact():
    # over bytes, so either case means ASCII letters only
    return [(kind, re.compile(p.encode(), re.I if fold else 0), g, n) for kind, p, fold, g, n in RULES]


def find_spans(texts: list[bytes], machine: Automaton) -> dict[int, list[tuple[int, int, int]]]:
    """Document index -> its spans (start, rule number, end) in code points, sorted."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # no rule's match holds a line end
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    found: dict[int, list] = {}
    for start, end, rules in zip(*(x.tolist() for x in machine.scan(data)), strict=True):
        stretch = data[start:end].tobytes()
        for k, (_, exact, group, least) in enumerate(_exact()):
            if rules >> k & 1:
                for m in exact.finditer(stretch):
                    if m.end(group) - m.start(group) >= least:
                        doc = int(np.searchsorted(bounds, start, side="right")) - 1
                        found.setdefault(doc, []).append((start + m.start() - bounds[doc], k, start + m.end() - bounds[doc]))
    for doc, spans in found.items():
        # byte offsets -> code points: bytes that continue a code point do not count
        before = np.concatenate([[0], np.cumsum((data[bounds[doc]:bounds[doc + 1]] & 0xC0) != 0x80)])
        found[doc] = sorted((int(before[s]), k, int(before[e])) for s, k, e in spans)
    return found


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end) sorted by start, then by the rules' order."""
    machine = automaton()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            found = find_spans(texts, machine)
            spans = [[{"kind": RULES[k][0], "start": s, "end": e} for s, k, e in found.get(i, ())] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([run.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns; each secret in ``text`` is replaced by
    ``mark`` (overlapping secrets by one), and ``n_chars`` follows the text."""
    machine = automaton()
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            column = run.column(at)
            if found := find_spans(texts, machine):
                values = column.to_pylist()
                for i, spans in found.items():
                    text, out, done = values[i], [], 0
                    for s, _, e in spans:
                        if s >= done:
                            out += [text[done:s], mark]
                        done = max(done, e)
                    values[i] = "".join(out) + text[done:]
                column = pa.array(values, column.type)
            yield run.set_column(at, run.schema.field(at), column)

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(clean, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def digests(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan_documents``."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r[0] for r in BASE]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *(count(r[0]) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
