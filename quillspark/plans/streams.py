"""Queries of the incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming import incremental
from .registry import query


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n_events FROM s GROUP BY user_id, s
""")
def activity_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.activity_sessions(e, "user_id", "ts", "3 hours")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", text("session_start"), text("session_end"), "n_events")


@query("SELECT event_id, user_id, event_type FROM events")
def incremental_load(spark, sf_dir):
    """A file stream of events, loaded into a table twice; the second load adds nothing."""
    name = f"loaded_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/streams"
    schema = table(spark, sf_dir, "events").schema
    for run in ("first", "again"):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
        incremental.incremental_ingest(stream, name, ["event_id"], ["ts"], f"{folder}/{run}")
    return spark.table(name).select("event_id", "user_id", "event_type")
