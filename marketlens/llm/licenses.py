"""Operator 4: license scans as an exact set-similarity join.

Templates (license notices) and text blocks are sets of words; a block holds a
template if it has at least ``CONTAIN`` of the template's words.  A template of
n words is compared with windows of 2 n consecutive words, one every n words,
across line ends: any n words that stand together lie whole in some window, and
words strewn over more than a window do not count together.

The words of all templates are ordered by how often the whole corpus holds
them, rarest first.  A window that reaches the threshold must hold one of the
first |T| - need + 1 words of the template T (prefix filter), must have ``need``
of the templates' words at all (length filter), and must have ``need`` of
them from its first prefix word of T on, as it lacks all of T before
that (positional filter); what passes is verified on the words themselves.
The filters drop only windows that cannot reach the threshold, so every
window that does is found.

The templates are a parameter of the driver, limited to ``MOST_WORDS`` words;
they go to the tasks with the code.  The word counts are sums of one row per
template word and task.

Rows: a null or empty text has no words, no places and score 0; null or
repeated doc_ids and repeated rows are scanned like any others, one row out
for one row in; equally rare words are ordered by spelling; a text shorter than
two templates is one window; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.text import ALNUM, Words, slices

CONTAIN = 0.8
MOST_WORDS = 100_000

# Phrases of the contract and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Notices as their publishers word them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]


def _words(text: str) -> list[str]:
    w = Words([text.encode()], ALNUM)
    return [w.word(i) for i in range(len(w.start))]


class Template(NamedTuple):
    label: str
    size: int  # words, repeated ones too
    ranks: np.ndarray  # of its distinct words, ascending
    need: int


def template_words(templates: list[tuple[str, str]]) -> list[tuple[str, int, list[str]]]:
    """(label, number of words, distinct words) of each template that has words."""
    sets = [(label, len(w), sorted(set(w))) for label, w in ((label, _words(text)) for label, text in templates)]
    if sum(len(words) for _, _, words in sets) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    return [x for x in sets if x[1]]


class _Vocabulary:
    """Known words, found in a run's words by hash and then by spelling."""

    def __init__(self, words: list[str]):
        self.words = words
        # a word holds no separator, so the words of a joined text are these
        own = Words([" ".join(words).encode()], ALNUM)
        self.order = np.argsort(own.hash)
        self.sorted = own.hash[self.order]
        self.letters, self.start, self.length = own.data, own.start, own.end - own.start
        self.alike = int(np.unique(self.sorted, return_counts=True)[1].max()) if words else 0

    def codes(self, words: Words) -> np.ndarray:
        """Index in ``words`` of each word of a run, -1 for all others."""
        out = np.full(len(words.hash), -1, np.int64)
        length = words.end - words.start
        first = np.searchsorted(self.sorted, words.hash)
        for at in (first + shift for shift in range(self.alike)):
            hit = np.flatnonzero(at < len(self.sorted))
            hit = hit[self.sorted[at[hit]] == words.hash[hit]]
            known = self.order[at[hit]]
            same = length[hit] == self.length[known]
            hit, known = hit[same], known[same]
            same = np.ones(len(hit), bool)
            for j in range(int(self.length[known].max(initial=0))):
                long = np.flatnonzero(self.length[known] > j)
                same[long] &= words.data[words.start[hit[long]] + j] == self.letters[self.start[known[long]] + j]
            out[hit[same]] = known[same]
        return out


def word_order(docs: DataFrame, words: list[str]) -> list[str]:
    """The words by their number in all documents, rarest first."""
    vocabulary = _Vocabulary(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)
        for _, texts in slices(batches):
            total += np.bincount(vocabulary.codes(Words(texts, ALNUM)) + 1, minlength=len(words) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total[1:])], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r[0]: r[1] for r in rows}  # one row per template word
    return sorted(words, key=lambda w: (n.get(w, 0), w))


def windows(counts: np.ndarray, size: int) -> np.ndarray:
    """Bounds of the documents' windows, one window of 2 * size words every ``size`` words."""
    return np.concatenate([[0], np.cumsum(np.maximum(-(-counts // size) - 1, np.minimum(counts, 1)))])


def members(place: np.ndarray, doc: np.ndarray, rank: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, rank) of words at a place of a document: each lies in one window or two."""
    slot = place // size
    here, before = slot < (bounds[1:] - bounds[:-1])[doc], slot > 0
    at = bounds[doc] + slot
    return np.concatenate([at[here], at[before] - 1]), np.concatenate([rank[here], rank[before]])


def containing(window: np.ndarray, rank: np.ndarray, template: Template, total: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """The windows that hold a template, how many of its words they hold, and how
    many windows the prefix, the length and the positional filter left."""
    least = len(template.ranks) - template.need + 1
    prefix, whole = np.zeros(total, bool), np.zeros(total, bool)
    prefix[template.ranks[:least]] = whole[template.ranks] = True
    wanted = np.unique(window[prefix[rank]])
    if not len(wanted):
        return wanted, wanted, (0, 0, 0)
    place = np.searchsorted(wanted, window)
    place[place == len(wanted)] = 0
    own = wanted[place] == window
    pairs = np.unique(place[own] * total + rank[own])
    place, rank = pairs // total, pairs % total
    first = np.searchsorted(place, np.arange(len(wanted) + 1))
    begin, end = first[:-1], first[1:]
    # ranks ascend in a window, so its first prefix word is the rarest
    hits = np.flatnonzero(prefix[rank])
    lead = hits[np.searchsorted(hits, begin)]
    long = end - begin >= template.need
    left = long & (end - lead >= template.need)
    held = np.concatenate([[0], np.cumsum(whole[rank])])
    both = held[end] - held[begin]
    found = np.flatnonzero(left)
    found = found[both[found] >= template.need]
    return wanted[found], both[found], (len(wanted), int(long.sum()), int(left.sum()))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, contain: float = CONTAIN) -> DataFrame:
    """Per document: doc_id, n_words, the places of the phrases (n_base,
    first_word, last_word, base_labels), ``matches`` (first and last word of
    each window that holds a template, label, containment), labels and score."""
    sets = template_words(TEMPLATES if templates is None else templates)
    order = word_order(docs, sorted({w for _, _, s in sets for w in s}))
    rank = {w: i for i, w in enumerate(order)}
    by_size: dict[int, list[Template]] = {}
    for label, size, s in sets:
        need = next(n for n in range(1, len(s) + 1) if n >= contain * len(s) - 1e-9)
        by_size.setdefault(size, []).append(Template(label, size, np.array(sorted(rank[w] for w in s)), need))
    # the phrases' own words have codes after all ranks
    split = [(p.split(), label) for p, label in PHRASES]
    every = order + sorted({w for p, _ in split for w in p} - set(order))
    vocabulary, code = _Vocabulary(every), {w: i for i, w in enumerate(every)}
    phrases = [([code[w] for w in p], label) for p, label in split]
    match = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            words = Words(texts, ALNUM)
            codes, counts, doc_of = vocabulary.codes(words), words.counts(), words.doc_of_word()
            n = len(texts)
            places: dict[int, list] = {}
            for phrase, label in phrases:
                k = len(phrase)
                at = np.flatnonzero(codes[:max(0, len(codes) - k + 1)] == phrase[0])
                for j in range(1, k):
                    at = at[codes[at + j] == phrase[j]]
                at = at[doc_of[at] == doc_of[at + k - 1]] if len(at) else at
                for i in at.tolist():
                    places.setdefault(int(doc_of[i]), []).append((i - int(words.first[doc_of[i]]), label))
            known = np.flatnonzero((codes >= 0) & (codes < len(order)))
            doc, place = doc_of[known], known - words.first[doc_of[known]]
            matches: dict[int, list] = {}
            for size, group in by_size.items():
                bounds = windows(counts, size)
                window, ranks = members(place, doc, codes[known], bounds, size)
                for template in group:
                    found, both, _ = containing(window, ranks, template, len(order))
                    for w, c in zip(found.tolist(), both.tolist(), strict=True):
                        d = int(np.searchsorted(bounds, w, side="right")) - 1
                        start = (w - int(bounds[d])) * size
                        matches.setdefault(d, []).append({"first": start, "last": min(start + 2 * size, int(counts[d])) - 1, "label": template.label, "containment": c / len(template.ranks)})
            base = [sorted(places.get(i, ())) for i in range(n)]
            base_labels = [sorted({x for _, x in p}) for p in base]
            labels = [sorted({*base_labels[i], *(m["label"] for m in matches.get(i, ()))}) for i in range(n)]
            score = [1.0 if base[i] else max((m["containment"] for m in matches.get(i, ())), default=0.0) for i in range(n)]
            yield pa.RecordBatch.from_arrays([
                run.column(0), pa.array(counts, pa.int64()), pa.array([len(p) for p in base], pa.int64()), pa.array([p[0][0] if p else None for p in base], pa.int64()), pa.array([p[-1][0] if p else None for p in base], pa.int64()),
                pa.array([",".join(x) for x in base_labels]), pa.array([",".join(x) for x in labels]), pa.array(score, pa.float64()), pa.array([matches.get(i, []) for i in range(n)], pa.list_(match)),
            ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<first:long,last:long,label:string,containment:double>>")


def containment_sql(words: str, contain: float = CONTAIN) -> str:
    """The operator's columns in DuckDB SQL; ``words`` cuts a column ``text`` into words."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    templates = ", ".join(f"({i}, '{label}', {size}, {quoted(w)})" for i, (label, size, w) in enumerate(template_words(TEMPLATES)))
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES)
    return f"""
WITH t(id, label, size, words) AS (VALUES {templates}), p(label, words) AS (VALUES {phrases}),
d AS (SELECT doc_id, {words} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM d),
h AS (SELECT doc_id, id, label, len(words) AS m, e.word, i // size AS j, greatest(1, (n + size - 1) // size - 1) AS windows FROM e JOIN (SELECT *, unnest(words) AS word FROM t) t ON e.word = t.word),
m AS (SELECT doc_id, label, count(DISTINCT word) / m AS c FROM (SELECT * FROM h WHERE j < windows UNION ALL SELECT * REPLACE (j - 1 AS j) FROM h WHERE j > 0)
  GROUP BY doc_id, id, label, m, j HAVING count(DISTINCT word) >= {contain} * m - 1e-9),
b AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN p ON w[i] = words[1] AND w[i:i + len(words) - 1] = words),
pb AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c FROM (SELECT doc_id, label, c FROM m UNION ALL SELECT doc_id, label, 1.0 FROM b) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(pb.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, coalesce(c, 0)::DOUBLE AS score
FROM d LEFT JOIN pb USING (doc_id) LEFT JOIN al USING (doc_id)
"""
