"""Structured Streaming forms: stateless colour, a running histogram, newest-run-wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import IMG, PIXEL_SCHEMA


def read_pixel_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(PIXEL_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_colour(stream: DataFrame, op: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Any per-pixel operator on arriving files; exactly-once file sink, stops when the input is drained."""
    return stream.transform(op).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_histogram(stream: DataFrame, out: str, checkpoint: str):
    """Keep channel counts current: changed counters are appended per micro-batch (update mode).

    A replayed batch writes the same rows into its own folder again, so recovery cannot double a
    count; ``latest_counts`` reads the newest value of every counter.
    """
    t = stream.filter("a <> 0").select(*IMG, F.expr("stack(3, 'r', r, 'g', g, 'b', b) as (channel, bin)"))
    t = t.groupBy(*IMG, "channel", "bin").agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return t.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(
        availableNow=True).start()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    t = spark.read.parquet(out)
    key = [*IMG, "channel", "bin"]
    return t.groupBy(*key).agg(F.max(F.struct("batch", "n")).alias("m")).select(*key, "m.n")


BINS = 256
#: State stores that hold timers and are read key by key.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _part_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pixels of a batch as one row per image: how many came, and their 3 x 256 channel counts."""
    import numpy as np

    for pdf in batches:
        rows = []
        for (image, frame), g in pdf.groupby(["image_id", "frame"], sort=False):
            shown = g[g["a"] != 0]
            counts = np.concatenate([np.bincount(shown[ch], minlength=BINS) for ch in "rgb"])
            rows.append((image, frame, int(g["w"].iloc[0]) * int(g["h"].iloc[0]), len(g), counts.tolist()))
        yield pd.DataFrame(rows, columns=["image_id", "frame", "size", "pixels", "counts"])


class CloseImages(StatefulProcessor):
    """Adds up the counts of an image and hands them out once all its pixels have come, or ``wait_ms`` (if given) after its last ones.

    An image that is handed out leaves no state behind.
    """

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "pixels long, counts array<bigint>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import numpy as np

        pixels, counts, size = 0, np.zeros(3 * BINS, dtype=np.int64), 0
        if self.sums.exists():
            pixels, counts = self.sums.get()[0], np.array(self.sums.get()[1], dtype=np.int64)
        for pdf in rows:
            pixels += int(pdf["pixels"].sum())
            size = int(pdf["size"].iloc[0])
            counts = counts + np.stack(pdf["counts"].to_list()).sum(axis=0)
        if self.wait_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        if pixels >= size:
            self.sums.clear()
            yield self._rows(key, counts, True)
        else:
            self.sums.update((pixels, counts.tolist()))
            if self.wait_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.sums.exists():
            counts = self.sums.get()[1]
            self.sums.clear()
            yield self._rows(key, counts, False)

    def _rows(self, key, counts, complete: bool) -> pd.DataFrame:
        held = [(key[0], key[1], "rgb"[k // BINS], k % BINS, int(n), complete) for k, n in enumerate(counts) if n]
        return pd.DataFrame(held, columns=["image_id", "frame", "channel", "bin", "n", "complete"])


def stream_closed_histograms(stream: DataFrame, out: str, checkpoint: str, wait_ms: int | None = None):
    """Each image's channel counts once, when its pixels are complete: (image_id, frame, channel, bin, n, complete).

    Batches are counted where they are read, so an image costs a row a batch in the shuffle and 768 numbers of state while it is open.
    Output is written exactly once and never again, so neither state nor files grow with the time that the stream runs.

    With ``wait_ms``, images that stay incomplete are handed out as they are (``complete`` false) by a timer that long after their
    last pixels, and the stream runs until it is stopped; without, it ends when its input is drained, and open images stay
    in its checkpoint for the next run.
    """
    spark = stream.sparkSession
    parts = stream.select(*IMG, "w", "h", *"rgba").mapInPandas(_part_counts, "image_id long, frame int, size long, pixels long, counts array<bigint>")
    closed = parts.groupBy(*IMG).transformWithStateInPandas(
        CloseImages(wait_ms), "image_id long, frame int, channel string, bin int, n long, complete boolean", "Append", "None" if wait_ms is None else "ProcessingTime")
    sink = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # a query keeps the settings that it starts with
    try:
        return (sink.trigger(availableNow=True) if wait_ms is None else sink).start()
    finally:
        spark.conf.set(name, before)


def latest_run_wins(results: DataFrame, versions: DataFrame) -> DataFrame:
    """(node_id, epoch, run_id, value): the newest run per node, kept only if its inputs are still the newest.

    results(node_id, epoch, run_id, value) started at input version ``epoch``; versions(node_id,
    epoch) lists every invalidation.  Both sides are group maxima before they meet.
    """
    current = versions.groupBy("node_id").agg(F.max("epoch").alias("_now"))
    newest = results.groupBy("node_id").agg(F.max(F.struct("run_id", "epoch", "value")).alias("m"))
    t = newest.select("node_id", "m.epoch", "m.run_id", "m.value").join(current, "node_id", "left")
    return t.filter(F.col("epoch") == F.coalesce("_now", F.lit(0))).drop("_now")


def stream_latest_runs(results: DataFrame, versions: DataFrame, out: str, checkpoint: str):
    """Streaming twin: each micro-batch folds into per-batch newest rows; ``settled_runs`` reads the state."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("node_id").agg(F.max(F.struct("run_id", "epoch", "value")).alias("m"))
        newest.select("node_id", "m.epoch", "m.run_id", "m.value").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()


def settled_runs(spark: SparkSession, out: str, versions: DataFrame) -> DataFrame:
    return latest_run_wins(spark.read.parquet(out).drop("batch"), versions)
