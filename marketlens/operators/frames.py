"""Skew-safe ordered row frames.

Row frames ``Window.partitionBy(symbol).orderBy(ts)`` put a whole symbol in
one task; with a hot symbol holding a third of all trades that task is a
third of the job.  ``with_row_blocks`` splits every key into blocks of
consecutive rows and copies the ``halo`` rows that precede each block into
it, so that any frame reaching at most ``halo`` rows back is exact inside a
``(key, block)`` partition.  It is built from plain DataFrame operations:

1. ``_chunk`` = event time truncated to a unit (minute by default), cut again by
   id ranges where times are tied (day-grained or missing); rank rows inside
   ``(key, chunk)``  -> shuffle #1, bounded groups.  (Steps 1 and 2 read the
   ranked rows twice: once as rows, once as counts.)
2. rows per ``(key, chunk)`` (aggregate on the same partitioning: no extra
   shuffle) -> running offset per key over the *chunk table*, whose size per
   key is bounded by time span / unit, not by trade volume; joined back on
   ``(key, chunk)`` – AQE broadcasts it when its measured size is small,
   otherwise only this small side moves (the big side keeps its
   partitioning).
3. ``_pos`` = offset + rank, 1-based position of the row in its key.
   ``_blk`` = (_pos-1) div block_rows; the last ``halo`` rows of each block are
   emitted twice (``explode``), the copy flagged ``_halo`` in the next block.
4. The caller's window functions run on ``partitionBy(key, _blk)`` ordered by
   ``_pos`` (shuffle #2, blocks of ``block_rows``) and drop ``_halo`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 1_000_000
DEFAULT_HALO = 64
CHUNK_IDS = 65_536      # range of ids ranked together where times are tied


def _surrogates(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    """Null-safe grouping columns for ``keys``: the value with NULL replaced
    by the type's zero plus an ``is null`` flag.  Partitioning and joining on
    these keeps NULL keys as their own group *and* lets a join reuse the
    partitioning of a window on the same columns (a ``<=>`` join hashes on
    different expressions and would re-shuffle the large side)."""
    cols, names = [], []
    for i, k in enumerate(keys):
        typ = df.schema[k].dataType.simpleString()
        if typ == "string":
            zero = F.lit("")
        elif typ.startswith("timestamp") or typ == "date":
            zero = F.lit("1970-01-01 00:00:00").cast(typ)
        elif typ == "boolean":
            zero = F.lit(False)
        else:
            zero = F.lit(0).cast(typ)
        cols += [F.coalesce(F.col(k), zero).alias(f"_sk{i}"), F.col(k).isNull().alias(f"_sn{i}")]
        names += [f"_sk{i}", f"_sn{i}"]
    return df.select("*", *cols), names


def _chunk_columns(df: DataFrame, order, chunk: str):
    """``_chunk`` and ``_sub``, which follow ``order`` and bound the rows ranked together.

    ``_chunk`` is the time truncated to ``chunk``.  Rows without a time, or
    exactly at the start of a chunk (as all day-grained times are), are all
    ordered by the second order column alone; ``_sub`` cuts those by ranges
    of it.  The rest of the chunk follows them."""
    ts_type = df.schema[order[0]].dataType
    floor = F.lit("0001-01-01 00:00:00").cast(ts_type)
    start = F.date_trunc(chunk, F.col(order[0]))
    whole = len(order) > 1 and df.schema[order[1]].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    tied = F.col(order[0]).isNull() | (F.col(order[0]) == start)
    last = F.lit(2 ** 63 - 1)
    sub = (F.when(tied, F.coalesce(F.floor(F.col(order[1]) / CHUNK_IDS).cast("bigint"), F.lit(-2 ** 63)))
           .otherwise(last)) if whole else F.lit(0).cast("bigint")
    return df.withColumns({"_chunk": F.coalesce(start, floor), "_sub": sub})


def with_row_blocks(t: DataFrame, keys=("symbol",), order=("ts", "event_id"),
                    halo: int = DEFAULT_HALO, block_rows: int | None = DEFAULT_BLOCK_ROWS,
                    chunk: str = "minute") -> DataFrame:
    """Add ``_pos`` (1-based row position per key), ``_blk`` and ``_halo``.

    ``block_rows`` never changes a value.  ``None`` gives one block per key (a
    plain per-key window: one shuffle), for inputs whose keys are known to be
    short, such as the last rows of each key.
    """
    keys = list(keys)
    order = list(order)
    if block_rows is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return (t.withColumn("_pos", F.row_number().over(w).cast("bigint"))
                 .withColumn("_blk", F.lit(0).cast("bigint"))
                 .withColumn("_halo", F.lit(False)))
    if block_rows < halo:
        raise ValueError("block_rows must be >= halo")
    t1, sk = _surrogates(t, keys)
    t1 = _chunk_columns(t1, order, chunk)
    w_in = Window.partitionBy(*sk, "_chunk", "_sub").orderBy(*order)
    t1 = t1.withColumn("_rn", F.row_number().over(w_in))
    counts = t1.groupBy(*sk, "_chunk", "_sub").agg(F.count("*").alias("_n"))
    w_off = (Window.partitionBy(*sk).orderBy("_chunk", "_sub")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumns({
        "_off": F.coalesce(F.sum("_n").over(w_off), F.lit(0)),
        "_tot": F.sum("_n").over(Window.partitionBy(*sk))}).drop("_n")
    # plain equi-join on (surrogates, chunk): the large side is already
    # partitioned on exactly these columns, so only the small side moves
    t2 = t1.join(offsets, [*sk, "_chunk", "_sub"], "inner").drop(*sk)
    pos = (F.col("_off") + F.col("_rn")).cast("bigint")
    t2 = t2.withColumn("_pos", pos).drop("_off", "_rn", "_chunk", "_sub")
    blk = F.floor((F.col("_pos") - 1) / F.lit(block_rows)).cast("bigint")
    # copy the block's last rows forward only when a next block exists
    in_tail = ((F.pmod(F.col("_pos") - 1, F.lit(block_rows)) >= F.lit(block_rows - halo)) &
               ((blk + 1) * F.lit(block_rows) < F.col("_tot")))
    copies = F.when(in_tail, F.array(F.struct(blk.alias("b"), F.lit(False).alias("h")),
                                     F.struct((blk + 1).alias("b"), F.lit(True).alias("h")))) \
              .otherwise(F.array(F.struct(blk.alias("b"), F.lit(False).alias("h"))))
    return (t2.withColumn("_c", F.explode(copies))
              .withColumns({"_blk": F.col("_c.b"), "_halo": F.col("_c.h")})
              .drop("_c", "_tot"))


def block_window(keys=("symbol",)) -> Window:
    """Window spec over the blocks made by ``with_row_blocks``."""
    return Window.partitionBy(*list(keys), "_blk").orderBy("_pos")


def drop_blocks(df: DataFrame) -> DataFrame:
    """Remove halo copies and the helper columns."""
    return df.filter(~F.col("_halo")).drop("_blk", "_halo", "_pos")


def running_total(df: DataFrame, keys, order=("ts", "event_id"), value: str = "delta",
                  out: str = "total", chunk: str = "minute") -> DataFrame:
    """Running sum of ``value`` per key in ``order``, all rows of one instant
    (equal ``order``) applied together, without putting a whole key in one
    task: rows are first summed per instant, then

    1. per ``(key, chunk)`` running sums (``chunk`` = time unit of the first
       order column; groups bounded by one chunk of one key),
    2. chunk totals -> exclusive prefix per key on the small chunk table,
    3. joined back on ``(key, chunk)`` (AQE broadcasts it when small).

    The per-instant sums feed two branches (running sums and chunk totals),
    which share the exchange below them.  Returns one row per (key, instant)
    with ``out``.
    """
    keys, order = list(keys), list(order)
    inst = df.groupBy(*keys, *order).agg(F.sum(value).alias("_v"))
    inst = _chunk_columns(inst, order, chunk)
    inst, sk = _surrogates(inst, keys)
    w_in = (Window.partitionBy(*sk, "_chunk", "_sub").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inst = inst.withColumn("_run", F.sum("_v").over(w_in))
    tot = inst.groupBy(*sk, "_chunk", "_sub").agg(F.sum("_v").alias("_t"))
    w_off = (Window.partitionBy(*sk).orderBy("_chunk", "_sub")
             .rowsBetween(Window.unboundedPreceding, -1))
    off = tot.select(*sk, "_chunk", "_sub", F.coalesce(F.sum("_t").over(w_off), F.lit(0)).alias("_off"))
    j = inst.join(off, [*sk, "_chunk", "_sub"], "inner")
    return j.select(*keys, *order, (F.col("_off") + F.col("_run")).alias(out))
