"""Stores found by what is in them: columns and row counts from Parquet footers, read in tasks."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.ranges import in_tasks, opened
from .store import REQUIRED

#: Kinds of which one store can be folded into another, unit by unit.
MERGEABLE = ("iq", "psd", "pfp")
#: What a store must have to be taken for one, the narrower kind first.
COLUMNS = {"iq": {"id", "level", "col", "bins"}, **REQUIRED}


def candidates(spark: SparkSession, path: str, ending: str = ".parquet") -> DataFrame:
    """``path, store, parts``: files below a folder, the folder that is their store, and the columns its sub-folders stand for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(path).select("path")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    parts = F.transform(F.filter(F.split(folder, "/"), lambda p: p.rlike("^[^=]+=")), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    return rows.select("path", F.regexp_replace(folder, "(/[^/=]+=[^/]*)+$", "").alias("store"), parts.alias("parts"))


def footers(files: DataFrame) -> DataFrame:
    """``files(path, store, parts)`` with ``columns``, ``rows`` and ``fault``; only the ends of the files are read."""

    def footer(path: str):
        import pyarrow.parquet as pq

        try:
            with opened(path) as file:
                found = pq.ParquetFile(pa.PythonFile(file, "r") if not isinstance(file, pa.NativeFile) else file)
                return list(found.schema_arrow.names), found.metadata.num_rows, None
        except (OSError, KeyError, ValueError) as e:  # Arrow's own errors are of these kinds
            return None, None, f"not readable: {type(e).__name__}"

    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = list(zip(*map(footer, paths), strict=True)) or [[]] * 3
            types = (pa.list_(pa.string()), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], ["path", "columns", "rows", "fault"])

    read = in_tasks(files.select("path"), 32).mapInArrow(run, "path string, columns array<string>, rows long, fault string")
    return files.join(read, "path")


def kind_of(columns: Column) -> Column:
    """The kind whose columns are all there; null if there is none."""
    out = F.lit(None).cast("string")
    for kind, needed in reversed(COLUMNS.items()):
        out = F.when(F.size(F.array_except(F.array(*map(F.lit, sorted(needed))), columns)) == 0, kind).otherwise(out)
    return out


def stores(spark: SparkSession, path: str) -> DataFrame:
    """``store, kind, rows, fault`` of the stores below a folder, from footers alone.

    A store has the columns that all of its files have, and those of its sub-folders. One with a
    file that cannot be read, or of no known kind, has a ``fault`` in place of a kind.
    """
    read = footers(candidates(spark, path)).withColumn("all", F.array_union("parts", F.coalesce("columns", F.array().cast("array<string>"))))
    each = read.groupBy("store").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.max("fault").alias("fault"))
    common = read.select("store", "path", F.explode("all").alias("c")).distinct().groupBy("store", "c").agg(F.count("*").alias("n"))
    every = common.join(each.select("store", "files"), "store").filter(F.col("n") == F.col("files")).groupBy("store").agg(F.sort_array(F.collect_list("c")).alias("columns"))
    found = each.join(every, "store", "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))
    kind = F.when(F.col("fault").isNull(), kind_of(F.col("columns")))
    holds = F.concat(F.lit("no known kind, holds "), F.array_join("columns", ", "))
    return found.select("store", kind.alias("kind"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("fault", F.when(kind.isNull(), holds)).alias("fault"))


def plan(found: DataFrame, installed: DataFrame, mergeable: Sequence[str] = MERGEABLE) -> DataFrame:
    """What to do with each store ``found(store, kind, rows, fault)`` where ``installed(kind, place, rows)`` says what is there.

    ``install``: the largest of a kind of which nothing is there; ``merge``: any other, where the
    kind can be and the store holds rows; ``skip`` where not; ``already``: what stands in a place
    itself, of which a kind may have several; ``reject``: what is no store. store, kind, rows, action, fault
    """
    live = installed.groupBy("kind").agg(F.sum("rows").alias("live"))
    places = installed.select("kind", F.col("place").alias("store"), F.lit(True).alias("stands")).distinct()
    both = found.join(F.broadcast(live), "kind", "left").join(places, ["kind", "store"], "left")  # live: a row a kind
    both = both.withColumn("already", F.coalesce("stands", F.lit(False)))
    order = F.row_number().over(W.partitionBy("kind", "already").orderBy(F.desc("rows"), "store"))
    later = (F.coalesce("live", F.lit(0)) > 0) | (F.col("i") > 1)
    action = (
        F.when(F.col("kind").isNull(), "reject").when(F.col("already"), "already").when(~later, "install")
        .when(F.col("kind").isin(*mergeable) & (F.col("rows") > 0), "merge").otherwise("skip")
    )
    return both.withColumn("i", order).select("store", "kind", "rows", action.alias("action"), "fault")
