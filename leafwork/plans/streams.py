"""Queries that drain a stream and return what it has left."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.plans.glyphs import COARSE_MERGED, coarse
from leafwork.streaming import streams


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one; a temporary one in local mode, where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='spark-leafwork-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def merged_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch query glyph_merged, by a stream of glyph files taken two at a time."""
    base = scratch(spark)
    rows = coarse(spark, sf_dir).select("source", "unicode", "n", F.array_join("bitmap", ",").alias("bitmap"))
    rows.repartition(5, "source").write.parquet(f"{base}/in")
    streams.merge_glyphs(streams.read_stream(spark, f"{base}/in", rows.schema, files=2), f"{base}/out", f"{base}/state").awaitTermination()
    return streams.merged(spark, f"{base}/out")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts by hour and type, of all windows that the stream has opened."""
    base = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type")
    events.repartition(4).write.parquet(f"{base}/in")
    counted = streams.event_counts(streams.read_stream(spark, f"{base}/in", events.schema), "ts", "1 hour", "3650 days", "event_type")
    keep = lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")  # noqa: E731  each batch has all windows, so the last one stands
    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users and types of events that a stream lets through once each."""
    base = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type")
    events.repartition(4).write.parquet(f"{base}/in")
    seen = streams.first_seen(streams.read_stream(spark, f"{base}/in", events.schema, files=2), ["user_id", "event_type"], "ts", "3650 days")
    keep = streams.retried(lambda df, i: df.select("user_id", "event_type").write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
    seen.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type")


QUERIES = {"stream_first_seen": first_seen, "stream_merged_glyphs": merged_glyphs, "stream_hourly_events": hourly_events}
ORACLE_SQL = {
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_merged_glyphs": f"SELECT * FROM {COARSE_MERGED}",
    "stream_hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::bigint AS n FROM events GROUP BY ALL",
}
