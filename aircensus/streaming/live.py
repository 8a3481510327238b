"""Structured Streaming forms: registry state, first alerts, snapshots, counts and sessions.

Late rows are dropped by watermark and state expires by event time where a
period or window says so; both are policy of this library.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import merge as M
from ..operators import registry as R


def _per(events: DataFrame, keys: list[str], period: str | None, delay: str):
    marked = events.withWatermark("wall_time", delay)
    return marked.groupBy(*keys, F.window("wall_time", period).alias("period")) if period else marked.groupBy(*keys)


def stream_cells(events: DataFrame, period: str | None = "1 day", delay: str = "10 minutes") -> DataFrame:
    """K1: changed cells of each session as events arrive, by the rules of the batch registry.

    State is one row per (session_id, rat, freq, phy), combined before the
    shuffle; ``seq`` decides, so the order of arrival does not matter.  With a
    ``period`` a cell has a row for each of them and those behind the watermark
    are forgotten; without, all is kept as long as the query runs.
    """
    own = R.with_at(events).filter("kind <> 'neighbour'")
    kind = lambda k: F.col("kind") == k
    levels, radio = M.present(M.SIGNAL, own.columns), M.present(M.RADIO, own.columns)
    cells = _per(own, R.KEY, period, delay).agg(F.count("*").alias("seen"), *M.identity_fields(kind("passport")), *M.last_fields(levels, kind("signal"), own.columns), *M.last_fields(radio, kind("radio"), own.columns))
    return cells.select(*R.KEY, *(["period"] if period else []), *(c.alias(n) for n, c in M.identity().items()), *M.fields(levels), *M.fields(radio), "seen")


def stream_serving(events: DataFrame, period: str | None = "1 day", delay: str = "10 minutes") -> DataFrame:
    """K1: the serving cell of each session and technology, as it changes; one small row of state for each."""
    serving = events.filter("kind = 'serving'")
    last = _per(serving, ["session_id", "rat"], period, delay).agg(F.max_by(F.struct("freq", "phy"), "seq").alias("at"))
    return last.select("session_id", "rat", *(["period"] if period else []), "at")


def with_serving(cells: DataFrame, serving: DataFrame) -> DataFrame:
    """K1: the latest rows of both streams as a registry: adds is_serving."""
    on = [c for c in ("session_id", "rat", "period") if c in cells.columns and c in serving.columns]
    here = F.coalesce((F.col("at.freq") == F.col("freq")) & (F.col("at.phy") == F.col("phy")), F.lit(False))
    return cells.join(serving, on, "left").withColumn("is_serving", here).drop("at")


def stream_identified(cells: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """K2: each LTE cell id once per session, when it is first fully known."""
    known = cells.filter(P.is_full_lte()).select("session_id", F.col("cid").alias("eci"), "mcc", "mnc", "tac", "wall_time")
    return known.withWatermark("wall_time", delay).dropDuplicatesWithinWatermark(["session_id", "eci"])


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _rename(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Rename inside one file system, which a reader sees as a whole or not at all."""
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    how = fs.Options.Rename
    options = spark._sc._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if overwrite else how.NONE
    files.rename(_path(spark, source), _path(spark, target), options)


def publish_batch(batch: DataFrame, batch_id: int, path: str) -> bool:
    """K4: publishes a snapshot; False if it was there already.

    The rows go to a staging folder, which is renamed when it is whole; then a
    pointer file is replaced.  A batch that is repeated after a failure is written
    and renamed once; readers see snapshots as they are, never half of one.
    """
    spark = batch.sparkSession
    target = f"{path}/batch={batch_id}"
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    new = not fs.exists(_path(spark, target))
    if new:
        staging = f"{path}/_staging/{batch_id}-{uuid.uuid4().hex}"
        batch.write.parquet(staging)
        _rename(spark, staging, target)
    if new or latest_snapshot_id(spark, path) != batch_id:
        pointer = f"{path}/_latest-{uuid.uuid4().hex}"
        out = fs.create(_path(spark, pointer))
        out.writeBytes(str(batch_id))
        out.close()
        _rename(spark, pointer, f"{path}/_latest", overwrite=True)
    return new


def latest_snapshot_id(spark: SparkSession, path: str) -> int | None:
    """Number of the snapshot that the pointer names."""
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(_path(spark, f"{path}/_latest")):
        return None
    found = fs.open(_path(spark, f"{path}/_latest"))
    try:
        return int(found.readLine())
    finally:
        found.close()


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """K4: the snapshot that was published last."""
    return spark.read.parquet(f"{path}/batch={latest_snapshot_id(spark, path)}")


def publish_snapshots(stream: DataFrame, path: str, checkpoint: str, interval: str | None = "500 milliseconds"):
    """K4: starts a query that publishes each batch as a snapshot, no more often than ``interval``."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: publish_batch(batch, batch_id, path)).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stream_code_counts(packets: DataFrame, kind: str = "tumbling", size: str = "1 hour", slide: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """K5: packets per log code in tumbling, sliding or session windows."""
    when = {"tumbling": F.window("wall_time", size), "sliding": F.window("wall_time", size, slide), "session": F.session_window("wall_time", size)}[kind]
    return packets.withWatermark("wall_time", delay).groupBy(when.alias("w"), "log_code").agg(F.count("*").alias("packets")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "log_code", "packets")


def stream_cell_sessions(events: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """K7: spans of activity of each cell: first to last event with no gap longer than ``gap``."""
    key = ["session_id", "rat", "freq", "phy"]
    grouped = events.withWatermark("wall_time", delay).groupBy(F.session_window("wall_time", gap).alias("w"), *key)
    return grouped.agg(F.count("*").alias("events"), F.min("wall_time").alias("first_seen"), F.max("wall_time").alias("last_seen")).drop("w")


