"""Shared plumbing: durable intermediates, fixed-size bitmaps, table loading."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the bits in a fixed-size membership bitmap (8 MB whatever the input).
BITMAP_LOG2 = 26
#: Most keys that are told to all tasks, as a bitmap of 16 bits a key (16 MB).
MOST_KEYS = 1 << 23
#: Bytes of an Arrow batch that a Python task gets at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor and the driver can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    session on one machine makes a private folder, and one on a cluster uses its
    warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        path = tempfile.mkdtemp(prefix="spark-shared-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage at a table that outlives executors, so loops and repeated
    uses recompute nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for df in tables:
        spark, path = df.sparkSession, df._written_to
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases.

    Its cleaner removes the files of shuffles that nothing refers to, but learns
    of them only when the driver's JVM collects garbage.
    """
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python tasks get Arrow batches of at most ``BATCH_BYTES``: the default bound of 10,000 rows says nothing about wide rows."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key, "67108864b").rstrip("b")) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under those names, whatever else the table has."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Membership bits of a column of 64-bit hashes, as a uint64 array of fixed size.

    The bits are combined on the executors; the driver gets at most
    2**(BITMAP_LOG2 - 6) words however many hashes there are.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - BITMAP_LOG2)
    rows = (
        df.select(slot.alias("_s"))
        .groupBy((F.shiftright("_s", 6)).alias("_w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_b"))
        .toArrow()
    )
    out = np.zeros(1 << (BITMAP_LOG2 - 6), dtype=np.uint64)
    if rows.num_rows:
        out[rows["_w"].to_numpy()] = rows["_b"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - BITMAP_LOG2)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _told(keys: DataFrame, column: str):
    """(bits of a bitmap, its broadcast) of a column of 64-bit keys; None if there are over ``MOST_KEYS``."""
    count = keys.count()
    if count > MOST_KEYS:
        return None
    log2 = max(16, min(BITMAP_LOG2 + 1, (16 * count).bit_length()))
    rows = (
        keys.select(F.shiftrightunsigned(F.xxhash64(column), 64 - log2).alias("_s"))
        .groupBy(F.shiftright("_s", 6).alias("_w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_b"))
        .toArrow()
    )
    bits = np.zeros(1 << (log2 - 6), dtype=np.uint64)
    if rows.num_rows:
        bits[rows["_w"].to_numpy()] = rows["_b"].to_numpy().view(np.uint64)
    return log2, keys.sparkSession.sparkContext.broadcast(bits)


def _hit(log2: int, bits):
    """A function from a batch with the hashed column ``_h`` to whether each row may be among the told keys."""

    def hit(batch: pa.RecordBatch) -> np.ndarray:
        slot = batch["_h"].to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - log2)
        return (bits.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

    return hit


def _sieved(df: DataFrame, column: str, log2: int, bits, wanted: bool) -> DataFrame:
    names, hit = df.columns, _hit(log2, bits)

    def keep(it):
        for batch in it:
            yield batch.filter(pa.array(hit(batch) == wanted)).select(names)

    return df.withColumn("_h", F.xxhash64(column)).mapInArrow(keep, df.schema)


def sieve(df: DataFrame, keys: DataFrame, column: str):
    """(rows, filter of their batches) for an Arrow pass over the rows whose 64-bit ``column`` is among ``keys``; a few more may stay.

    Up to ``MOST_KEYS`` keys are told to the tasks as a bitmap of 16 bits a key,
    and the pass itself drops the other rows: a pass of its own for that would
    hold a second Python worker on each core.  More keys are joined.
    """
    keys = keys.select(column).distinct()
    told = _told(keys, column)
    if told is None:
        return df.join(keys, column, "left_semi").select(df.columns), lambda batch: batch
    hit = _hit(*told)
    return df.withColumn("_h", F.xxhash64(column)), lambda batch: batch.filter(pa.array(hit(batch)))


def split(df: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows that are surely not among ``keys`` or None, all others): only the second need a join."""
    told = _told(keys.select(column).distinct(), column)
    if told is None:
        return None, df
    return _sieved(df, column, *told, False), _sieved(df, column, *told, True)


def anti(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``keys``; only rows that may be are shuffled."""
    clear, doubtful = split(df, keys, column)
    left = doubtful.join(keys.select(column).distinct(), column, "left_anti").select(df.columns)
    return left if clear is None else clear.unionByName(left)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_mod(column: str, n: int):
    """Remainder of crc32(id as text), the fold of the labelled rows; null ids have none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def sha256(column) -> F.col:
    return F.sha2(column, 256)
