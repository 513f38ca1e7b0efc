"""Readers of measurement exports: channel summaries, wide spectra and frames, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quant import epoch_seconds

SUMMARY_SCHEMA = "sensor_name string, channel_frequency_mhz string, timestamp string, max string, median string, mean string"


def parse_summaries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text columns and ``file`` to measurements, and the files of which a row does not parse.

    A malformed file is skipped as a whole and reported; the others load.
    """
    number = lambda c: F.col(c).try_cast("double")
    typed = rows.select(
        "file", F.col("sensor_name").alias("sensor"), number("channel_frequency_mhz").alias("freq"), epoch_seconds(F.col("timestamp")).alias("t"),
        number("max").alias("mx"), number("median").alias("md"), number("mean").alias("mn"),
    )
    bad = F.col("sensor").isNull()
    for c in ("freq", "t", "mx", "md", "mn"):
        bad = bad | F.col(c).isNull()
    report = typed.groupBy("file").agg(F.count("*").alias("rows"), F.sum(bad.cast("int")).alias("bad"))
    return typed.join(report.filter("bad > 0").select("file"), "file", "left_anti"), report.filter("bad > 0")


def read_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(SUMMARY_SCHEMA).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    return parse_summaries(rows.withColumn("file", F.col("_metadata.file_path")))


def usable(measurements: DataFrame, refused: DataFrame) -> DataFrame:
    """``measurements``, unless every file was refused or there is none: that is an error, not an empty layer."""
    if measurements.isEmpty():
        names = [r["file"] for r in refused.orderBy("file").limit(5).collect()]
        raise ValueError(f"no usable summaries; refused: {', '.join(names) or 'no file'}")
    return measurements


def parse_exports(contents: DataFrame, lead: tuple[str, ...] = ()) -> DataFrame:
    """``contents(file, content)`` to captures ``file, line, t, ..lead, values``.

    A file is some ten megabytes and the unit of validation, so each is one row and its wide
    lines are split into arrays instead of into thousands of columns. The first line is the
    header. Blank and malformed cells become null, for the checks to find.
    """
    lines = contents.select("file", F.posexplode(F.split("content", "\r?\n")).alias("line", "text")).filter("line > 0 and trim(text) <> ''")
    cells = lines.select("file", "line", F.split("text", ",").alias("c"))
    leads = [F.get("c", i + 1).try_cast("double").alias(name) for i, name in enumerate(lead)]
    rest = F.slice("c", len(lead) + 2, F.greatest(F.lit(0), F.size("c") - len(lead) - 1))
    return cells.select("file", "line", epoch_seconds(F.get("c", 0)).alias("t"), *leads, F.transform(rest, lambda x: F.trim(x).try_cast("double")).alias("values"))


def read_exports(spark: SparkSession, path: str, lead: tuple[str, ...] = ()) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path, wholetext=True)
    return parse_exports(rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content")), lead)
