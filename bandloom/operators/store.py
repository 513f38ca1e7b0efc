"""Validation of exports and upkeep of stored layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.quant import Geometry, pack_db
from .files import PSD_NAME
from .pyramid import numbered

DAY = 86_400


def rejects(captures: DataFrame, n: int, files: DataFrame | None = None) -> DataFrame:
    """One row for each refused file and reason, from ``captures(file, t, values)``.

    A file is the unit: one bad cell refuses it. ``files(file)`` adds those without captures.
    """
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    per = captures.groupBy("file").agg(
        F.sum((F.size("values") != n).cast("int")).alias("geometry"), F.sum(bad.cast("int")).alias("nonfinite"), F.sum(F.col("t").isNull().cast("int")).alias("blank_ts"), F.count("*").alias("rows")
    )
    if files is not None:
        per = files.select("file").distinct().join(per, "file", "left").fillna(0)
    reasons = F.array(*[F.when(F.col(k) > 0, F.struct(F.lit(k).alias("reason"), F.col(k).alias("n"))) for k in ("geometry", "nonfinite", "blank_ts")],
                      F.when(F.col("rows") == 0, F.struct(F.lit("empty").alias("reason"), F.lit(0).cast("bigint").alias("n"))))
    return per.select("file", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("r")).select("file", "r.reason", "r.n")


def accepted(captures: DataFrame, refused: DataFrame) -> DataFrame:
    return captures.join(refused.select("file").distinct(), "file", "left_anti")


def clip_report(captures: DataFrame, g: Geometry, by: Sequence[str]) -> DataFrame:
    """How many cells lie outside the quantization range, and their share in percent."""
    out = F.size(F.filter("values", lambda x: (x < g.qmin) | (x > g.qmax)))
    total = captures.groupBy(*by).agg(F.sum(out).alias("clipped"), F.sum(F.size("values")).alias("cells"))
    return total.withColumn("percent", F.col("clipped") / F.col("cells") * 100)


def captures_per_day(captures: DataFrame, by: Sequence[str] = ("sensor",)) -> DataFrame:
    return captures.groupBy(*by, F.floor(F.col("t") / DAY).cast("long").alias("day")).agg(F.count("*").alias("n"))


def resume_plan(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Which day files ``(sensor, day, first_t)`` are already in ``stored(sensor, t)``.

    None stored: to do. More than four: done. One to four may be the tail of the day before:
    done only if the file's own first capture, in whole milliseconds, is among them, or cannot
    be read.
    """
    counts = captures_per_day(stored)
    ms = lambda c: F.rint(c * 1000).cast("long")
    first = stored.select("sensor", ms(F.col("t")).alias("ms")).distinct().withColumn("has", F.lit(True))
    joined = files.withColumn("ms", ms(F.col("first_t"))).join(counts, ["sensor", "day"], "left").join(first, ["sensor", "ms"], "left")
    n = F.coalesce("n", F.lit(0))
    done = F.when(n == 0, False).when(n > 4, True).otherwise(F.col("first_t").isNull() | F.coalesce("has", F.lit(False)))
    return joined.select("sensor", "day", n.cast("long").alias("stored"), done.alias("ingested"))


def layer_meta(captures: DataFrame, by: Sequence[str]) -> DataFrame:
    return captures.groupBy(*by).agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count("*").alias("n"))


def merge_units(source: DataFrame, target: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``target`` with the whole units it lacks, and a report of what was added and skipped."""
    if set(source.columns) != set(target.columns):
        raise ValueError(f"schemas differ: {sorted(set(source.columns) ^ set(target.columns))}")
    have = target.select(key).distinct()
    new = source.join(have, key, "left_anti")
    report = source.groupBy(key).agg(F.count("*").alias("n")).join(have.withColumn("_h", F.lit(True)), key, "left")
    return target.unionByName(new), report.select(key, "n", F.when(F.col("_h"), "skipped").otherwise("added").alias("action"))


def pack(captures: DataFrame, by: Sequence[str], size: int, vector: str) -> DataFrame:
    """Chunks of ``size`` consecutive captures: by, chunk, t0, t1, n, caps."""
    placed = numbered(captures, by)
    chunk = F.floor(F.col("k") / size).cast("long")
    caps = F.sort_array(F.collect_list(F.struct("t", vector)))
    return placed.groupBy(*by, chunk.alias("chunk")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), caps.alias("caps"))


def unpack(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    return chunks.select(*by, F.inline("caps"))


def pack_guard(source: DataFrame, chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    a = source.groupBy(*by).agg(F.count("*").alias("source_n"))
    b = chunks.groupBy(*by).agg(F.sum("n").alias("packed_n"))
    both = a.join(b, list(by), "full_outer").fillna(0, ["source_n", "packed_n"])
    return both.withColumn("ok", F.col("source_n") == F.col("packed_n"))


def publish_check(staged: DataFrame, source: DataFrame, live: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whether the staged rows of each unit may replace the live ones: never empty for non-empty,
    and only if the source still has the count and last instant that was staged."""
    stamp = lambda df, p: df.groupBy(*by).agg(F.count("*").alias(f"{p}_n"), F.max("t").alias(f"{p}_t"))
    joined = stamp(live, "live").join(stamp(staged, "staged"), list(by), "full_outer").join(stamp(source, "source"), list(by), "full_outer").fillna(0, ["live_n", "staged_n", "source_n"])
    verdict = F.when((F.col("live_n") > 0) & (F.col("staged_n") == 0), "refuse: empty").when(
        (F.col("staged_n") != F.col("source_n")) | ~F.col("staged_t").eqNullSafe(F.col("source_t")), "refuse: stale"
    ).otherwise("publish")
    return joined.select(*by, "live_n", "staged_n", "source_n", verdict.alias("verdict"))


def drop_orphans(meta: DataFrame, data: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    have = data.select(key).distinct()
    return meta.join(have, key, "left_semi"), meta.join(have, key, "left_anti")


def coverage(*metas: DataFrame) -> DataFrame:
    """Sensors of any layer: widest range and summed counts; ranges that are null are not advertised."""
    union = metas[0]
    for m in metas[1:]:
        union = union.unionByName(m)
    return union.filter("t_min is not null and t_max is not null").groupBy("sensor").agg(F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"), F.sum("n").alias("n"))


def union_shapes(rows: DataFrame, chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Captures of both shapes; one stored in both counts once."""
    both = unpack(chunks, by).withColumn("_p", F.lit(0)).unionByName(rows.withColumn("_p", F.lit(1)))
    first = F.row_number().over(W.partitionBy(*by, "t").orderBy("_p"))
    return both.withColumn("_k", first).filter("_k = 1").drop("_k", "_p")


def choose_statistic(files: DataFrame, by: str) -> DataFrame:
    """One statistic a directory: max_peak if there is one, else the first by name."""
    preferred = F.struct((F.col("stat") != "max_peak").alias("a"), F.col("stat").alias("b"))
    return files.groupBy(by).agg(F.min(preferred)["b"].alias("chosen"), F.sort_array(F.collect_set("stat")).alias("stats"))


def is_day_file(name: Column) -> Column:
    return name.rlike(PSD_NAME)


#: What a layer must have to be taken for one, the narrower kind first.
REQUIRED = {"pfp": {"sensor", "freq", "t", "spec"}, "psd": {"sensor", "t", "spec"}, "summaries": {"sensor", "freq", "t", "mx", "md", "mn"}}


def identify(columns: Sequence[str]) -> str | None:
    """The kind of a layer by its columns; none if it lacks some of every kind."""
    return next((kind for kind, needed in REQUIRED.items() if needed <= set(columns)), None)


def in_both_shapes(rows: DataFrame, chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Units stored as rows and as chunks at once: publishing them again has to be refused."""
    return rows.select(*by).distinct().join(chunks.select(*by).distinct(), list(by))


def write_sorted(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """``rows`` in files that are ranges of ``by``, each in order."""
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)


def pack_summaries(level: DataFrame) -> DataFrame:
    """Decibels of a summary layer in tenths, whole seconds, and the scale that says so.

    A layer that has a scale is packed already, and refused.
    """
    if "scale" in level.columns:
        raise ValueError("the layer has a scale: it is packed already")
    packed = [pack_db(F.col(c)).alias(c) for c in level.columns if c in ("mx", "md", "mn")]
    others = [c for c in level.columns if c not in ("t", "mx", "md", "mn")]
    return level.select(*others, F.rint("t").cast("long").alias("t"), *packed, F.lit(10).alias("scale"))
