"""Structured Streaming: merging glyph files as they come, and windows over events."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: Files of a micro-batch.
FILES = 100


def read_stream(spark: SparkSession, path: str, schema, files: int = FILES) -> DataFrame:
    """Parquet files of a folder as they come, some at a time; those already seen are kept by the checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def merge_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch reduced to the greatest count of (source, unicode, bitmap), in a folder named by the batch.

    A batch that runs again overwrites its folder, so a crash between writing and recording counts nothing twice.
    """
    reduced = batch.groupBy("source", "unicode", "bitmap").agg(F.max("n").alias("n"))
    reduced.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def retried(handle: Callable[[DataFrame, int], None], attempts: int = 5, pause: float = 3.0, skip: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """handle for foreachBatch, tried again after a pause; a batch that fails each time goes to skip, or stops the stream without one."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for left in reversed(range(attempts)):
            try:
                return handle(batch, batch_id)
            except Exception:
                if not left:
                    if skip is None:
                        raise
                    return skip(batch, batch_id)
                time.sleep(pause)

    return run


def merge_glyphs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merges all that is there, and ends; a later start goes on where this one ended."""
    return stream.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """(unicode, bitmap, n) of all batches so far: greatest within a source, then summed."""
    rows = spark.read.parquet(path).groupBy("source", "unicode", "bitmap").agg(F.max("n").alias("n"))
    return rows.groupBy("unicode", "bitmap").agg(F.sum("n").alias("n"))


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten `late` after their time."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark(keys)


def event_counts(stream: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    """Counts by tumbling window; a window is final when the watermark passes it."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))


class FontCursor(StatefulProcessor):
    """What a scan of a document's pages knows: the last page that it has seen, and its fonts, until they expire."""

    def __init__(self, expiry: int | None) -> None:
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "page long", self.expiry)
        self.seen = handle.getMapState("seen", "font string", "page long", self.expiry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}
        last = self.cursor.get()[0] if self.cursor.exists() else -1
        for pdf in rows:
            last = max(last, int(pdf["page"].max()))
            for font, page in pdf.groupby("font")["page"].min().items():
                first[font] = min(int(page), first.get(font, int(page)))
        new = {f: p for f, p in first.items() if not self.seen.containsKey((f,))}
        for font, page in new.items():
            self.seen.updateValue((font,), (page,))
        self.cursor.update((last,))
        yield pd.DataFrame({"doc": [key[0]] * len(new), "font": list(new), "page": list(new.values()), "cursor": [last] * len(new)}).astype({"font": object})

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Inside, streams keep their state in the store that maps and expiry need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def font_cursor(stream: DataFrame, expiry: int | None = None) -> DataFrame:
    """(doc, font, page, cursor) from a stream (doc, page, font): each font once for each document, with its first page.

    cursor is the last page seen by then. A stream that goes on from a checkpoint tells only fonts that are new; pages may
    come again. expiry: milliseconds after which a font that wasn't told since is forgotten, never if None. Null fonts and
    pages are skipped. Start it inside keyed_state().
    """
    rows = stream.where("font is not null and page is not null and doc is not null").select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("long").alias("page"), "font")
    return rows.groupBy("doc").transformWithStateInPandas(statefulProcessor=FontCursor(expiry), outputStructType="doc long, font string, page long, cursor long", outputMode="Append", timeMode="None" if expiry is None else "ProcessingTime")
