"""Files that keep arriving: ingestion, tumbling pyramids, exactly-once captures, late data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.quant import quantize
from ..operators.files import PSD_NAME
from ..operators.pyramid import plain, pooled, psd_level, runs, sorted_batch, vector_max
from ..operators.store import accepted, rejects
from ..sources.exports import parse_exports
from ..sources.places import children, exists


def file_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything there is, once; a later call with the same checkpoint goes on from there."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, target: str, checkpoint: str, width: int) -> None:
    """Append captures ``(file, t, values, ..)`` by micro-batch; a file with a bad row contributes nothing.

    A batch writes its own partition and replaces it if it is run again, so a retry adds nothing twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good = accepted(batch, rejects(batch, width))
        good.write.mode("overwrite").parquet(f"{target}/batch={number}")
        batch.unpersist()

    run_available(stream, checkpoint, each)


def ingest_exports(spark: SparkSession, path: str, target: str, checkpoint: str, width: int, qmin: float, qmax: float) -> None:
    """Arriving export files ``<day>_<sensor>_<stat>.csv`` become quantized captures, a partition a batch.

    sensor, stat, t, spec. A file is read whole by Spark's own reader, as it is accepted or
    refused whole; files of other names are left alone.
    """
    schema = spark.read.format("binaryFile").load(path).schema
    listed = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", 1000).load(path)
    files = listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("content")).filter(F.col("file").rlike(PSD_NAME))

    def each(batch: DataFrame, number: int) -> None:
        rows = parse_exports(batch).persist()
        part = lambda i: F.regexp_extract("file", PSD_NAME, i)
        good = accepted(rows, rejects(rows, width))
        good.select(part(2).alias("sensor"), part(3).alias("stat"), "t", quantize(F.col("values"), qmin, qmax).alias("spec")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows.unpersist()

    run_available(files, checkpoint, each)


def _day_folder(day) -> str:
    return "day=__HIVE_DEFAULT_PARTITION__" if day is None else f"day={day.isoformat()}"


def stored_days(spark: SparkSession, target: str, days: list) -> DataFrame | None:
    """What a table in partitions of ``day`` holds for these days, none if nothing: no other folder is listed or read."""
    paths = [f"{target}/{_day_folder(d)}" for d in days]
    paths = [p for p in paths if exists(spark, p)]
    return spark.read.option("basePath", target).parquet(*paths) if paths else None


def days_of(batch: DataFrame) -> list:
    """The days of a batch's instants: as many as its calendar has."""
    return sorted((r[0] for r in batch.select(F.to_date("ts")).distinct().collect()), key=lambda d: (d is not None, d))


def _write_days(rows: DataFrame, target: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(target)


def once(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> None:
    """Each capture once, however late it comes again; the key's captures have one event time ``ts``.

    A batch is held against what was written for its own days, whose folders alone are read, so
    neither a watermark drops rows nor does a batch's work or any state grow with the stream.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        new = batch.dropDuplicates(keys).withColumn("day", F.to_date("ts"))
        seen = stored_days(batch.sparkSession, target, days_of(batch))
        if seen is not None:
            earlier = seen.filter(F.col("batch") < number).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("day").alias("_day"))
            same = F.col("day").eqNullSafe(F.col("_day"))
            for k in keys:
                same = same & (F.col(k) == F.col(f"_{k}"))
            new = new.join(earlier, same, "left_anti")
        _write_days(new.withColumn("batch", F.lit(number).cast("long")), target)
        batch.unpersist()

    run_available(stream, checkpoint, each)


def split_late(stream: DataFrame, target: str, late: str, checkpoint: str, lateness: int) -> None:
    """Rows under the day of their instant in ``target``; those more than ``lateness`` seconds behind
    the newest instant seen before their batch go to the side table ``late``: none is lost.

    Each batch leaves the newest instant so far in a file of its own, and reads that of the batch before.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        newest = newest_seen(spark, target, number - 1)
        behind = F.lit(False) if newest is None else F.coalesce(F.unix_micros("ts") < newest - lateness * 1_000_000, F.lit(False))
        dated = batch.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(number).cast("long"))
        for rows, place in ((dated.filter(~behind), target), (dated.filter(behind), late)):
            _write_days(rows, place)
        own = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
        mark = max((x for x in (newest, own) if x is not None), default=None)
        spark.createDataFrame([(mark,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{target}.newest/batch={number}")
        batch.unpersist()

    run_available(stream, checkpoint, each)


def newest_seen(spark: SparkSession, target: str, number: int) -> int | None:
    """The newest instant, in microseconds, that ``split_late`` had seen after a batch; none before the first."""
    place = f"{target}.newest/batch={number}"
    return spark.read.schema("newest long").parquet(place).first()[0] if exists(spark, place) else None


def last_batch(spark: SparkSession, target: str) -> int:
    return max((int(n.removeprefix("batch=")) for n in children(spark, f"{target}.newest") if n.startswith("batch=")), default=-1)


def pyramid(stream: DataFrame, bucket: int, lateness: str) -> DataFrame:
    """Tumbling maxima and counts of a stream of summaries with an event time ``ts``; ``total`` is the sum of medians."""
    w = stream.withWatermark("ts", lateness).groupBy(F.window("ts", f"{bucket} seconds").alias("w"), "sensor", "freq")
    rows = w.agg(F.max("mx").alias("mx"), F.sum("md").alias("total"), F.count("*").alias("c"))
    return rows.select("sensor", "freq", F.unix_timestamp("w.start").alias("t"), "mx", "total", "c")


def upsert(level: DataFrame, place: str, checkpoint: str) -> None:
    """What each batch changed of a level in update mode, a folder a batch; the last word on a key is its latest."""
    run_available(level, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/batch={n}"), "update")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that ``upsert`` left, each key's of the latest batch."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


# --- levels of vectors ------------------------------------------------------------------------

#: The state store that keyed state with timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def wider(best: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Element-wise maximum, as long as the longer; what is NaN on one side counts for nothing."""
    n = max(len(best), len(more))
    pad = lambda x: np.append(x, np.full(n - len(x), np.nan))
    return np.fmax(pad(best), pad(more))


class OpenBucket(StatefulProcessor):
    """One maximum for each open bucket; it goes out, and out of the state, when the watermark passes the bucket's end."""

    def __init__(self, bucket: int):
        self.bucket = bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "spec array<double>")

    def handleInputRows(self, key, rows, timerValues):
        found = self.best.get()
        best = np.array([np.nan if x is None else x for x in found[0]], float) if found is not None else np.empty(0)
        for batch in rows:
            for spec in batch["spec"]:
                best = wider(best, np.array([np.nan if x is None else x for x in spec], float))
        self.best.update(([None if np.isnan(x) else float(x) for x in best],))
        if found is None:
            self.handle.registerTimer((int(key[-1]) + self.bucket) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        best = self.best.get()[0]
        self.best.clear()
        spec = [None if x is None or np.isnan(x) else int(x) for x in best]
        yield pd.DataFrame({"sensor": [key[0]], "stat": [key[1]], "t": [int(key[2])], "smax": [spec]})

    def close(self) -> None:
        pass


def _partial(batches):
    """Maxima within a batch, and the newest instant of each: what moves is a row a bucket and task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = sorted_batch(plain(batch, "spec"), ["sensor", "stat", "t"])
        best = pooled(rows.select(["sensor", "stat", "t", "spec"]), ["sensor", "stat", "t"], "spec")
        edges = runs(rows, ["sensor", "stat", "t"])
        newest = np.maximum.reduceat(rows.column("us").to_numpy(), edges[:-1])
        yield pa.RecordBatch.from_arrays([*best.columns, pa.array(newest)], ["sensor", "stat", "t", "spec", "us"])


def vector_levels(stream: DataFrame, bucket: int, lateness: int) -> DataFrame:
    """``sensor, stat, t, smax`` of a stream ``(sensor, stat, ts, spec)``, in append mode: each bucket once, when it is closed.

    The session's state store must be ROCKS. State is one vector for each open bucket.
    """
    start = (F.floor(F.unix_micros("ts") / (bucket * 1_000_000)) * bucket).cast("long")
    rows = stream.select("sensor", "stat", start.alias("t"), F.col("spec").cast("array<double>").alias("spec"), F.unix_micros("ts").alias("us"))
    some = rows.mapInArrow(_partial, "sensor string, stat string, t long, spec array<double>, us long")
    timed = some.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", f"{lateness} seconds")
    return timed.groupBy("sensor", "stat", "t").transformWithStateInPandas(OpenBucket(bucket), "sensor string, stat string, t long, smax array<smallint>", "Append", "eventTime")


def stream_level(spark: SparkSession, source: DataFrame, place: str, bucket: int, lateness: int) -> None:
    """A level of arriving captures ``(sensor, stat, ts, spec)`` below ``place``, as far as there are any.

    First rows are told apart by lateness (``kept`` and ``late``), then the kept ones go into
    buckets; a row that was kept is not late there, as that watermark follows a bucket behind.
    """
    split_late(source, f"{place}/kept", f"{place}/late", f"{place}/check-split", lateness)
    kept = spark.readStream.schema(spark.read.parquet(f"{place}/kept").schema).option("maxFilesPerTrigger", 1000).parquet(f"{place}/kept")
    levels = vector_levels(kept, bucket, lateness + bucket)
    run_available(levels, f"{place}/check-level", lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/closed/batch={n}"))


def level_so_far(spark: SparkSession, place: str, bucket: int, lateness: int) -> DataFrame:
    """All of ``stream_level`` at this moment: closed buckets, those still open, and what came late: sensor, stat, t, smax.

    Of the kept rows only the days that can be open are read.
    """
    keys = ["sensor", "stat", "t"]
    shape = "sensor string, stat string, t long, smax array<smallint>"
    closed = spark.read.schema(shape).option("recursiveFileLookup", True).parquet(f"{place}/closed") if exists(spark, f"{place}/closed") else spark.createDataFrame([], shape)
    newest = newest_seen(spark, f"{place}/kept", last_batch(spark, f"{place}/kept"))
    bucketed = lambda df: psd_level(df.withColumn("t", F.unix_micros("ts") / F.lit(1e6)), bucket, ("sensor", "stat"))
    out = closed
    if newest is not None:
        since = newest / 1e6 - lateness - 2 * bucket
        recent = spark.read.parquet(f"{place}/kept").filter(F.col("day") >= F.to_date(F.timestamp_seconds(F.lit(since))))
        start = (F.floor(F.unix_micros("ts") / (bucket * 1_000_000)) * bucket).cast("long")
        out = out.unionByName(bucketed(recent.withColumn("b", start).join(closed.select("sensor", "stat", F.col("t").alias("b")), ["sensor", "stat", "b"], "left_anti")))
    if children(spark, f"{place}/late") and any(n.startswith("day=") for n in children(spark, f"{place}/late")):
        out = out.unionByName(bucketed(spark.read.parquet(f"{place}/late")))
    return vector_max(out, keys, "smax")


def deduplicated(stream: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """Each capture once, however often it arrives within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def days(stream: DataFrame) -> DataFrame:
    """Captures go to the day of their instant; those of another day than their file's never complete that day."""
    day = F.to_date("ts")
    return stream.withColumn("day", day).withColumn("straddles", day != F.col("file_day"))
