"""Operator 6: token ids in Arrow stream files of equal-length sequences.

The ids of all documents, each closed by an end id, form one long row in
ascending doc_id order.  It is cut into files; a file is an Arrow stream whose
batches hold ``ids`` and ``mask`` as fixed-size lists: sequence i of a batch
starts at i * length in the batch's one value buffer, so a memory-mapped file
gives any sequence and its mask without a copy.  The last sequence of a file
is filled up with zeros under a mask of false.  The stream's schema metadata
holds the file's place in the order and its documents' ids and lengths.

Documents are ranged by doc_id, so each file is made by one task from one
range, and no task holds more than its range's share.  Places in the whole row
follow from the files' own counts when they are read.

Rows: a null text is empty and holds the end id only; repeated doc_ids (and
null ones, which come first) are separate documents, ordered by a hash of their text;
an empty table gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import read_files, scratch, write_files
from marketlens.llm.text import slices
from marketlens.llm.tokens import part_ids, vocabulary_path


def stream_file(ids: np.ndarray, length: int, facts: dict, batch_sequences: int = 256) -> bytes:
    """One Arrow stream of the ids as sequences of ``length``, and their masks."""
    n = -(-len(ids) // length)
    padded = np.zeros(n * length, ids.dtype)
    padded[:len(ids)] = ids
    mask = np.zeros(n * length, bool)
    mask[:len(ids)] = True
    schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(ids.dtype), length)), ("mask", pa.list_(pa.bool_(), length))], {"facts": json.dumps(facts)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        for i in range(0, n, batch_sequences):
            part = slice(i * length, min(n, i + batch_sequences) * length)
            out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x[part]), length) for x in (padded, mask)], schema=schema))
    return sink.getvalue().to_pybytes()


def open_stream(source) -> tuple[dict, list[pa.RecordBatch]]:
    """(facts, batches) of a stream file: a path (memory-mapped, without a copy) or its bytes."""
    with pa.ipc.open_stream(pa.memory_map(source) if isinstance(source, str) else pa.py_buffer(source)) as stream:
        return json.loads(stream.schema.metadata[b"facts"]), list(stream)


def sequence(batches: list[pa.RecordBatch], i: int) -> tuple[np.ndarray, pa.Array]:
    """Ids (a view, not a copy) and mask of sequence i of a file."""
    for b in batches:
        if i < b.num_rows:
            length = b.schema.field("ids").type.list_size
            return b.column(0).flatten().slice(i * length, length).to_numpy(), b.column(1).flatten().slice(i * length, length)
        i -= b.num_rows
    raise IndexError(i)


def write_token_files(docs: DataFrame, path: str, length: int = 2048, end_id: int = 2, vocabulary: str | None = None, file_ids: int = 1 << 21) -> None:
    """Writes the stream files of all documents below ``path``.

    A file closes at the first document end beyond ``file_ids`` ids, so a task
    holds about that many and one document at a time."""
    words = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, known = TaskContext.get().partitionId(), part_ids(words)
        part, parts, doc_ids, sizes, held = 0, [], [], [], 0

        def close():
            nonlocal part, parts, doc_ids, sizes, held
            blob = stream_file(np.concatenate(parts), length, {"shard": shard, "part": part, "doc_ids": doc_ids, "sizes": sizes})
            part, parts, doc_ids, sizes, held = part + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

        for run, texts in slices(batches, budget=4 << 20, hold=True):
            ids, bounds = known.texts(texts)
            for doc, lo, hi in zip(run.column(run.schema.get_field_index("doc_id")).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                parts.append(np.append(ids[lo:hi], end_id).astype("<u2"))
                doc_ids.append(doc)
                sizes.append(hi - lo + 1)
                held += hi - lo + 1
                if held >= file_ids:
                    yield close()
        if parts:
            yield close()

    ranged = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text"))
    write_files(ranged.mapInArrow(encode, "blob binary"), path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files below ``path``: doc_id, start (ids of all
    documents before it), n_tokens (with the end id), ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers)."""
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file_tokens", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                facts, stream = open_stream(content.as_buffer())
                # the mask, not the list of sizes, says which ids are real
                flat = np.concatenate([b.column(0).flatten().to_numpy()[b.column(1).flatten().to_numpy(zero_copy_only=False)] for b in stream])
                sizes = np.array(facts["sizes"], np.int64)
                end = np.cumsum(sizes)
                if int(end[-1]) != len(flat):
                    raise ValueError("a token file does not hold what its facts say")
                crc = [zlib.crc32(flat[e - s:e].astype("<u4")) for s, e in zip(sizes.tolist(), end.tolist(), strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(n, facts["shard"]), np.full(n, facts["part"]), facts["doc_ids"], end - sizes, sizes, crc, np.full(n, len(flat)))], schema=schema)

    rows = read_files(spark, path).select("content").mapInArrow(digest, "shard long, part long, doc_id long, within long, n_tokens long, ids_crc32 long, file_tokens long")
    # One row a file, a file per some millions of ids: a short list even for a large corpus.
    files = rows.where("within = 0").select("shard", "part", "file_tokens")
    before = files.select("shard", "part", (F.sum("file_tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    return rows.join(before, ["shard", "part"]).select("doc_id", (F.coalesce("before", F.lit(0)) + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, **options)
    return read_token_files(docs.sparkSession, path)
