"""Incremental forms: re-runnable loads of a file stream, and activity sessions."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import dedupe_first, skip_existing, upsert_by_key


def _current(spark: SparkSession, table: str) -> DataFrame | None:
    """The table as it is now: a session that has read it before may hold an old list of its files."""
    if not spark.catalog.tableExists(table):
        return None
    spark.catalog.refreshTable(table)
    return spark.table(table)


def _recover(spark: SparkSession, table: str) -> None:
    """After a crash between the renames of an upsert: put the new state, which is complete, in the table's place."""
    if spark.catalog.tableExists(f"{table}_old"):
        if not spark.catalog.tableExists(table):
            done = spark.catalog.tableExists(f"{table}_next")
            spark.sql(f"ALTER TABLE {table}_{'next' if done else 'old'} RENAME TO {table}")
        spark.sql(f"DROP TABLE IF EXISTS {table}_old")
    spark.sql(f"DROP TABLE IF EXISTS {table}_next")


def incremental_ingest(stream: DataFrame, table: str, keys: list[str], order: list, checkpoint: str, mode: str = "append"):
    """Run what a file stream has now into a catalogue table and return the query.

    Each micro-batch is made single by key (first by `order`); "append" then adds absent keys, "upsert" merges. Rows with a null in a key can't be
    told apart from a replay's, so they're left out. A batch that is replayed changes nothing, whatever was read in between. An upsert writes the new state beside the old
    one and swaps them by rename; the old one goes last, so after a crash at any point the next run finds a whole state and goes on from it.
    """

    def load(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        _recover(spark, table)
        new = dedupe_first(batch.dropna(subset=keys), keys, order)
        base = _current(spark, table)
        if base is None:
            new.write.saveAsTable(table)
        elif mode == "append":
            skip_existing(new, base, keys).select(*base.columns).write.mode("append").saveAsTable(table)
        else:
            upsert_by_key(base, new, keys).select(*base.columns).write.mode("overwrite").saveAsTable(f"{table}_next")
            spark.sql(f"ALTER TABLE {table} RENAME TO {table}_old")
            spark.sql(f"ALTER TABLE {table}_next RENAME TO {table}")
            spark.sql(f"DROP TABLE {table}_old")

    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", os.path.join(checkpoint, table)).trigger(availableNow=True).start()
    query.awaitTermination()
    _current(stream.sparkSession, table)
    return query


@dataclass
class LoadCounts:
    """Rows of an event-time load: all that were read, those too late for the watermark, repeats of a key within it, and those added."""

    read: int = 0
    late: int = 0
    repeated: int = 0
    added: int = 0


def event_time_ingest(stream: DataFrame, table: str, keys: list[str], event_time: str, delay: str, checkpoint: str) -> LoadCounts:
    """Run what a stream has now into a catalogue table, each key once, by event time: no look at the table for repeats.

    Keys are remembered as state until the watermark (`delay` behind the latest event) has passed them, so state stays as small as the delay is short. A repeat within it is dropped; a row that comes later than the
    watermark is dropped and counted as late. State and watermark live in the checkpoint, so the next run goes on where this one ended. A batch that is run again after a crash finds its rows by the number it
    was written under and replaces them.
    """
    added: dict[int, int] = {}

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # One folder for each batch number: writing it again after a crash replaces it.
        rows = batch.withColumn("batch_no", F.lit(number).cast("long"))
        if spark.catalog.tableExists(table):
            with_mode(spark, lambda: rows.select(*_current(spark, table).columns).write.mode("overwrite").insertInto(table))
        else:
            rows.write.partitionBy("batch_no").saveAsTable(table)
        added[number] = _current(spark, table).where(F.col("batch_no") == number).count()

    once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    query = once.writeStream.foreachBatch(load).option("checkpointLocation", os.path.join(checkpoint, table)).trigger(availableNow=True).start()
    query.awaitTermination()
    _current(stream.sparkSession, table)
    out = LoadCounts(added=sum(added.values()))
    for p in query.recentProgress:
        out.read += p.numInputRows
        for op in p.stateOperators:
            out.late += op.numRowsDroppedByWatermark
            out.repeated += op.customMetrics.get("numDroppedDuplicateRows", 0)
    return out


def with_mode(spark: SparkSession, write) -> None:
    """Run a write that replaces only the partitions it has rows for."""
    name = "spark.sql.sources.partitionOverwriteMode"
    old = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        write()
    finally:
        spark.conf.set(name, old)


def activity_sessions(events: DataFrame, user: str, ts: str, gap: str = "3 minutes", watermark: str | None = None) -> DataFrame:
    """(user, session_start, session_end, n_events): a session ends when `gap` passes without an event.

    An event exactly at the gap joins the session. The same code serves a batch and, with a watermark, a stream. session_end is the last event's time.
    """
    e = events.withWatermark(ts, watermark) if watermark else events
    # A session window is half-open; one microsecond more lets an event at the gap join.
    w = F.session_window(ts, f"{gap} 1 microsecond")
    out = e.groupBy(w, user).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n_events"))
    return out.drop("session_window")
