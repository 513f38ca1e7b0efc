"""The driver's tables as measurements, and the same views in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import share

SENSORS = ["click", "error", "purchase", "signup", "view"]
T0 = 1_704_067_200.0
STATS = ["max", "median", "mean", "std"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, freq (MHz), t (s), mx, md, mn (dBm)"""
    mx = F.lit(-100.0) + F.col("value") / 10
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sensor"), (F.lit(3535) + 10 * (F.col("user_id") % 18)).cast("double").alias("freq"),
        epoch(F.col("ts")).alias("t"), mx.alias("mx"), (mx - 12).alias("md"), (mx - 6).alias("mn"),
    )


def _sensor(label: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SENSORS)), (label % 5 + 1).cast("int"))


def psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, t, spec_db (64 values), stat"""
    return table(spark, sf_dir, "embeddings").select(
        _sensor(F.col("label")).alias("sensor"), (F.lit(T0) + 90 * F.col("vec_id")).cast("double").alias("t"),
        F.transform("embedding", lambda x: F.lit(-135.0) + 80 * x.cast("double")).alias("spec_db"), F.lit("max").alias("stat"),
    )


def psd_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectra in three statistics."""
    shifts = F.array(*[F.struct(F.lit(s).alias("stat"), F.lit(d).alias("shift")) for s, d in (("max", 0.0), ("median", -12.0), ("mean", -6.0))])
    wide = psd(spark, sf_dir).drop("stat").withColumn("s", F.explode(shifts))
    return wide.select("sensor", "t", F.transform("spec_db", lambda x: x + F.col("s.shift")).alias("spec_db"), "s.stat")


def pfp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, freq (Hz), t, frame_db (64 values), stat"""
    return table(spark, sf_dir, "embeddings").select(
        _sensor(F.col("label")).alias("sensor"), ((F.lit(3555) + 10 * (F.col("vec_id") % 4)) * F.lit(1e6)).cast("double").alias("freq"),
        (F.lit(T0) + 90 * F.col("vec_id")).cast("double").alias("t"), F.transform("embedding", lambda x: F.lit(-135.0) + 80 * x.cast("double")).alias("frame_db"), F.lit("max_peak").alias("stat"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, size, n_cols (of the header), header"""
    e = table(spark, sf_dir, "events")
    e = e.repartition(share(e.count(), EVENTS))  # making names is work, and a small file is one task
    day = F.date_format("ts", "yyyy-MM-dd")
    stat = F.element_at(F.array(*map(F.lit, STATS)), (F.col("user_id") % 4 + 1).cast("int"))
    sensor = F.when(F.col("event_id") % 11 == 0, F.concat("event_type", F.lit("_b"))).otherwise(F.col("event_type"))
    kind = F.col("event_id") % 8
    name = (
        F.when(kind == 0, F.concat(F.lit("PFP_"), day, F.lit("_"), sensor, F.lit("_"), stat, F.lit(".csv")))
        .when(kind == 1, F.concat(F.lit("cap"), F.col("event_id"), F.lit(".sigmf-meta"))).when(kind == 2, F.concat(F.lit("cap"), F.col("event_id"), F.lit(".npy")))
        .when(kind == 3, F.concat(F.lit("store"), F.col("user_id") % 5, F.lit(".duckdb"))).when(kind == 4, F.concat(F.lit("table"), F.col("event_id"), F.lit(".csv")))
        .when((kind == 5) & (F.col("event_id") % 3 == 0), F.concat(F.lit("note"), F.col("event_id"), F.lit(".txt")))
        .otherwise(F.concat(day, F.lit("_"), sensor, F.lit("_"), stat, F.lit(".csv")))
    )
    header = F.when(F.col("event_id") % 24 == 4, F.lit("sensor_name,channel_frequency_mhz,timestamp,max,median,mean")).otherwise(F.lit("a,b,c"))
    return e.select(
        F.concat(F.lit("root/d"), F.col("user_id") % 3, F.lit("/"), name).alias("path"), name.alias("name"), (F.col("event_id") * 13 % 100_000).alias("size"),
        F.when(F.col("event_id") % 19 == 0, 2249).otherwise(2251).alias("n_cols"), header.alias("header"),
    )


def iq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex samples: id, sample, i, q; a capture for each supplier."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("id"), F.floor(F.col("l_orderkey") / 10_000).alias("part"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("i"), (F.col("l_discount") * 100).alias("q"),
    )
    # a sample's number is the count of the orders' ranges before and its place in its own: no capture is sorted in one task
    before = F.sum("n").over(W.partitionBy("id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = rows.groupBy("id", "part").agg(F.count("*").alias("n")).select("id", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(W.partitionBy("id", "part").orderBy("l_orderkey", "l_linenumber", "i", "q")) - 1
    rows = rows.repartition(iq_tasks(spark, sf_dir), "id", "part")
    return rows.withColumn("own", own).join(counts, ["id", "part"]).select("id", (F.col("offset") + F.col("own")).alias("sample"), "i", "q")


#: Samples that a task sorts, and events that it makes files or manifests of.
SAMPLES, EVENTS = 250_000, 50_000


def iq_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the samples, by the count in the table's footers."""
    return share(table(spark, sf_dir, "lineitem").count(), SAMPLES)


#: The views as common table expressions.
SQL = {
    "v_summary": "SELECT event_type AS sensor, CAST(3535 + 10 * (user_id % 18) AS DOUBLE) AS freq, epoch(ts) AS t, -100 + value / 10 AS mx, -100 + value / 10 - 12 AS md, -100 + value / 10 - 6 AS mn FROM events",
    "v_psd": "SELECT ['click','error','purchase','signup','view'][label % 5 + 1] AS sensor, CAST(1704067200 + 90 * vec_id AS DOUBLE) AS t, [-135 + 80 * CAST(x AS DOUBLE) FOR x IN embedding] AS spec_db, 'max' AS stat FROM embeddings",
    "v_psd_stat": "SELECT sensor, t, [x + s.shift FOR x IN spec_db] AS spec_db, s.name AS stat FROM v_psd, (VALUES ('max', 0.0::DOUBLE), ('median', -12.0::DOUBLE), ('mean', -6.0::DOUBLE)) AS s(name, shift)",
    "v_pfp": "SELECT ['click','error','purchase','signup','view'][label % 5 + 1] AS sensor, CAST((3555 + 10 * (vec_id % 4)) * 1e6 AS DOUBLE) AS freq, CAST(1704067200 + 90 * vec_id AS DOUBLE) AS t, [-135 + 80 * CAST(x AS DOUBLE) FOR x IN embedding] AS frame_db, 'max_peak' AS stat FROM embeddings",
    "v_files": """SELECT 'root/d' || (user_id % 3) || '/' || name AS path, name, size, n_cols, header FROM (SELECT *, CASE
  WHEN event_id % 8 = 0 THEN 'PFP_' || day || '_' || sensor || '_' || stat || '.csv' WHEN event_id % 8 = 1 THEN 'cap' || event_id || '.sigmf-meta'
  WHEN event_id % 8 = 2 THEN 'cap' || event_id || '.npy' WHEN event_id % 8 = 3 THEN 'store' || (user_id % 5) || '.duckdb' WHEN event_id % 8 = 4 THEN 'table' || event_id || '.csv'
  WHEN event_id % 8 = 5 AND event_id % 3 = 0 THEN 'note' || event_id || '.txt' ELSE day || '_' || sensor || '_' || stat || '.csv' END AS name
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, ['max','median','mean','std'][user_id % 4 + 1] AS stat, CASE WHEN event_id % 11 = 0 THEN event_type || '_b' ELSE event_type END AS sensor,
  event_id * 13 % 100000 AS size, CASE WHEN event_id % 19 = 0 THEN 2249 ELSE 2251 END AS n_cols,
  CASE WHEN event_id % 24 = 4 THEN 'sensor_name,channel_frequency_mhz,timestamp,max,median,mean' ELSE 'a,b,c' END AS header FROM events))""",
    "v_iq": "SELECT CAST(l_suppkey AS INTEGER) AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_discount * 100) - 1 AS sample, l_quantity AS i, l_discount * 100 AS q FROM lineitem",
}


def sql(body: str, *views: str) -> str:
    """``body`` after the views it needs; those that others build on come along."""
    needed = [v for v in SQL if v in views or (v == "v_psd" and "v_psd_stat" in views)]
    head = ",\n".join(f"{v} AS ({SQL[v]})" for v in needed)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body
