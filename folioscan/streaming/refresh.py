"""Periodic updates of an index, and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators.index import Index, change_of, latest_changes, upsert


def start_refresh(index: Index, roots: list[str], minutes: float, checkpoint: str) -> StreamingQuery:
    """Update ``index`` every so many minutes until the query is stopped.

    A rate source is the clock. An update that is due while another one runs waits,
    and a failed one is tried again at the next tick, since updates compare the index
    with the disk.
    """
    if minutes <= 0:
        raise ValueError("periodic updates are off")
    clock = index.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, number: index.update(roots)).trigger(processingTime=f"{round(minutes * 60)} seconds").option("checkpointLocation", checkpoint).start()


def apply_changes(spark: SparkSession, folder: str, schema: str, checkpoint: str, target: str) -> StreamingQuery:
    """Read the change files in ``folder`` that are new and keep the last change of
    each key in the Parquet folders ``target``/<batch>; a batch that runs again
    overwrites its own folder, so replays are harmless."""

    def batch(events: DataFrame, number: int) -> None:
        changed = latest_changes(events).withColumnRenamed("user_id", "file_path").withColumnRenamed("event_id", "last_modified_ticks")
        before = spark.read.parquet(f"{target}/{number - 1}") if number else spark.createDataFrame([], changed.schema)
        upsert(before, changed.unionByName(before.join(changed.select("file_path"), "file_path", "left_semi"))).write.mode("overwrite").parquet(f"{target}/{number}")

    feed = spark.readStream.schema(schema).parquet(folder)
    return feed.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def keep_latest(spark: SparkSession, folder: str, schema: str, checkpoint: str, target: str, files: int = 1000, key: str = "user_id") -> StreamingQuery:
    """Read the change files in ``folder`` that are new, so many at a time, and write to
    ``target``/batch=<n> what the last change of each key is now, for keys whose last one
    a batch changed.

    What is known of a key stays in Spark's state store, so a batch reads and writes its own
    keys, however many there are. Events may come late, in any order and more than once: the
    last is the one with the largest (ts, event_id). A batch that runs again overwrites its
    own folder. ``latest_kept`` reads the answer.
    """
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")

    def batch(changed: DataFrame, number: int) -> None:
        changed.select(key, "e.event_id", change_of(F.col("e.event_type")).alias("op"), "e.value").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return feed.groupBy(key).agg(last).writeStream.outputMode("update").foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def latest_kept(spark: SparkSession, target: str, key: str = "user_id") -> DataFrame:
    """The last change of each key that ``keep_latest`` has written: its row of the last
    batch that has one."""
    rows = spark.read.parquet(target)
    return rows.groupBy(key).agg(F.max_by(F.struct("event_id", "op", "value"), "batch").alias("e")).select(key, "e.*")
