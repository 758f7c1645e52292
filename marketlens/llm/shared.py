"""Helpers shared by the operators: scratch tables, byte files, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read anew on each call."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marketlens-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts the
    lineage, and later branches read the table instead of computing it again."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a table made by ``cut`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


BITS = 24  # a bitmap has 2 MB, however many ids it holds


def bitmap_of(df: DataFrame, column: str):
    """A fixed-size bitmap of the hashed values of a column, as a numpy array."""
    import numpy as np

    bit = F.xxhash64(column).bitwiseAND((1 << BITS) - 1)
    pieces = (df.where(F.col(column).isNotNull()).select(F.bitmap_bucket_number(bit + 1).alias("k"), F.bitmap_bit_position(bit + 1).alias("b"))
              .groupBy("k").agg(F.bitmap_construct_agg("b")).collect())  # 512 rows of 4 kB at most
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for k, b in pieces:
        bitmap[(k - 1) * 4096:k * 4096] = np.frombuffer(b, np.uint8)
    return bitmap


def in_bitmap(df: DataFrame, column: str, bitmap) -> DataFrame:
    """Rows whose value may be in the bitmap: all that are, few others."""
    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            bit = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array((bitmap[bit >> 3] >> (bit & 7)) & 1 == 1)).select(list(range(batch.num_columns - 1)))

    return df.withColumn("_bit", F.xxhash64(column).bitwiseAND((1 << BITS) - 1)).mapInArrow(keep, df.schema)


def sorted_groups(batches, keys: int):
    """The groups of rows that are sorted by their first ``keys`` columns, as Arrow tables."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        marks = np.column_stack([held.column(c).to_numpy() for c in range(keys)])
        ends = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
            yield held.slice(lo, hi - lo)
        if len(ends):
            held = held.slice(int(ends[-1]))
    if held is not None and held.num_rows:
        yield held


def write_files(blobs: DataFrame, path: str) -> None:
    """Writes each row of the one binary column as a file of its own.

    The text writer passes bytes through unchanged and closes a row with the
    line separator; here that is one NUL, which readers of gzip members (zero
    padding) and of Arrow streams (bytes after the end marker) skip.  Spark's
    commit protocol keeps files of failed tasks out of the folder.
    """
    blobs.select(F.col(blobs.columns[0]).cast("string").alias("value")).write.option("lineSep", "\u0000").option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, content) of the files below a folder, one file a row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): for every id in ``edges`` the smallest id reachable.

    Alternates large-star and small-star steps (each node links its larger,
    then its smaller neighbours to the smallest one) until every node has one
    link, to a node without one.  Each pass is written as a table in the
    shared folder, so a lost executor repeats one pass at most.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, cut(small.select("e.u", "e.v").where("u > v").distinct(), "edges")
        drop(last)
    lone = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(lone)


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link down, and only nodes without any are linked to."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("down")))).alias("e"))
    sums = ends.groupBy("e.id").agg(F.sum("e.down").alias("down"), F.count("*").alias("n"))
    return sums.where("down > 1 or (down = 1 and n > 1)").limit(1).count() == 0
