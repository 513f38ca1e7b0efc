"""Queries: streams over the events, run to the end of what is there."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions.quant import NARROW
from ..operators import discovery, publish
from ..sources import views as V
from ..sources.views import sql
from ..sources.places import shared_place
from ..streaming import streams as S
from .pyramids import CODES, codes
from .registry import query
from .stores import exports


@contextmanager
def rocks(spark):
    """The state store for keyed state with timers, for as long as a stream of these runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, S.ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _place(spark) -> str:
    """A new folder that all executors share."""
    return shared_place(spark, "stream")


def _events(spark, sf_dir):
    """The events as a stream of summaries, from a folder of files written in the order of arrival."""
    place = _place(spark)
    mx = F.lit(-100.0) + F.col("value") / 10
    rows = V.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("sensor"), (F.lit(3535) + 10 * (F.col("user_id") % 18)).cast("double").alias("freq"), F.col("ts").cast("timestamp").alias("ts"), mx.alias("mx"), (mx - 12).alias("md")
    )
    twice = rows.unionByName(rows.filter("event_id % 4 = 0"))  # every fourth arrives twice
    twice.write.parquet(f"{place}/in")
    return S.file_stream(spark, f"{place}/in", spark.read.parquet(f"{place}/in").schema, per_trigger=4), place


@query("SELECT event_type AS sensor, count(*) AS n, round(sum(-100 + value / 10), 4) AS total FROM events GROUP BY 1")
def stream_dedup(spark, sf_dir):
    """Each capture once, however late: the totals are those of the table."""
    stream, place = _events(spark, sf_dir)
    S.once(stream, f"{place}/out", f"{place}/check", ["event_id"])
    return spark.read.parquet(f"{place}/out").groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.sum("mx"), 4).alias("total"))


@query(sql("SELECT sensor, freq, CAST(floor(t / 3600) * 3600 AS BIGINT) AS t, round(max(mx), 6) AS mx, round(avg(md), 6) AS md, count(*) AS c FROM (SELECT * FROM (SELECT event_type AS sensor, CAST(3535 + 10 * (user_id % 18) AS DOUBLE) AS freq, epoch(ts) AS t, -100 + value / 10 AS mx, -112 + value / 10 AS md FROM events) UNION ALL SELECT event_type, CAST(3535 + 10 * (user_id % 18) AS DOUBLE), epoch(ts), -100 + value / 10, -112 + value / 10 FROM events WHERE event_id % 4 = 0) GROUP BY ALL"))
def stream_pyramid(spark, sf_dir):
    """Hourly levels of the stream equal those of the rows that arrived: update mode over what is in time, and the late rows' table."""
    stream, place = _events(spark, sf_dir)
    S.split_late(stream, f"{place}/kept", f"{place}/late", f"{place}/check-split", 86_400)
    schema = spark.read.parquet(f"{place}/kept").schema
    S.upsert(S.pyramid(spark.readStream.schema(schema).option("maxFilesPerTrigger", 50).parquet(f"{place}/kept"), 3600, "90000 seconds"), f"{place}/level", f"{place}/check-level")
    keys = ["sensor", "freq", "t"]
    level = S.latest(spark.read.parquet(f"{place}/level"), keys)
    late = spark.read.schema(schema).parquet(f"{place}/late")  # there may be none
    hours = late.groupBy("sensor", "freq", (F.floor(F.unix_timestamp("ts") / 3600) * 3600).cast("long").alias("t")).agg(F.max("mx").alias("mx"), F.sum("md").alias("total"), F.count("*").alias("c"))
    both = level.unionByName(hours).groupBy(*keys).agg(F.max("mx").alias("mx"), F.sum("total").alias("total"), F.sum("c").alias("c"))
    return both.select(*keys, F.round("mx", 6).alias("mx"), F.round(F.col("total") / F.col("c"), 6).alias("md"), "c")


@query(sql(f"SELECT sensor, 'max' AS stat, t, pos, max(v) AS v FROM (SELECT sensor, CAST(floor(t / 3600) * 3600 AS BIGINT) AS t, unnest(range(0, 64)) AS pos, unnest(spec) AS v FROM ({CODES})) GROUP BY ALL", "v_psd"))
def stream_psd_level(spark, sf_dir):
    """Hourly spectra of captures that arrive out of order: keyed state for the open buckets, closed ones appended."""
    place = _place(spark)
    c = codes(spark, sf_dir).select("sensor", F.lit("max").alias("stat"), F.timestamp_seconds("t").alias("ts"), "spec")
    c.repartition(12, F.xxhash64("ts")).write.parquet(f"{place}/in")
    with rocks(spark):
        S.stream_level(spark, S.file_stream(spark, f"{place}/in", c.schema, per_trigger=4), place, 3600, 7200)
    return S.level_so_far(spark, place, 3600, 7200).select("sensor", "stat", "t", F.posexplode("smax").alias("pos", "v"))


@query("WITH f AS (SELECT strftime(ts, '%Y-%m-%d') || event_type AS file, value FROM events), bad AS (SELECT DISTINCT file FROM f WHERE value < 0.5) SELECT file, count(*) AS n FROM f WHERE file NOT IN (SELECT file FROM bad) GROUP BY file")
def stream_ingest(spark, sf_dir):
    """Continuous ingestion: files with a bad row contribute nothing, a second run adds nothing."""
    place = _place(spark)
    e = V.table(spark, sf_dir, "events")
    value = F.when(F.col("value") >= 0.5, F.col("value"))
    rows = e.select(F.concat(F.date_format("ts", "yyyy-MM-dd"), "event_type").alias("file"), V.epoch(F.col("ts")).alias("t"), F.array(value).alias("values"))
    rows.repartition("file").write.parquet(f"{place}/in")  # a file's rows arrive together
    schema = spark.read.parquet(f"{place}/in").schema
    for _ in range(2):
        S.ingest(S.file_stream(spark, f"{place}/in", schema), f"{place}/out", f"{place}/check", 1)
    return spark.read.parquet(f"{place}/out").groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_id % 9 = 0 AS straddles, count(*) AS n FROM (SELECT event_id, ts FROM events UNION ALL SELECT event_id, ts FROM events WHERE event_id % 4 = 0) GROUP BY ALL")
def stream_late(spark, sf_dir):
    """Captures under the day of their instant; some come in the file of the day before, some days late, in a table of their own."""
    stream, place = _events(spark, sf_dir)
    filed = S.days(stream.withColumn("file_day", F.date_sub(F.to_date("ts"), F.when(F.col("event_id") % 9 == 0, 1).otherwise(0))))
    S.split_late(filed, f"{place}/out", f"{place}/late", f"{place}/check", 86_400)
    kept = spark.read.parquet(f"{place}/out")
    both = kept.unionByName(spark.read.schema(kept.schema).parquet(f"{place}/late"))  # there may be none
    return both.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "straddles").agg(F.count("*").alias("n"))


@query(sql("SELECT CAST(CAST(floor((t - 1704067200) / 7200) AS BIGINT) AS VARCHAR) || '_' || sensor AS file, count(*) AS n, min(t) AS t_min, max(t) AS t_max FROM v_psd GROUP BY 1 HAVING count(*) FILTER (WHERE CAST(round((t - 1704067200) / 90) AS BIGINT) % 97 = 3 OR CAST(round((t - 1704067200) / 90) AS BIGINT) % 89 = 5 OR CAST(round((t - 1704067200) / 90) AS BIGINT) % 83 = 6 OR CAST(round((t - 1704067200) / 90) AS BIGINT) % 79 = 4) = 0", "v_psd"))
def append_day(spark, sf_dir):
    """Day-atomic append: valid files only, captures and list in one commit, written twice without effect."""
    place = _place(spark)
    for _ in range(2):
        publish.append_captures(exports(spark, sf_dir), NARROW.n, place)
    now = publish.live(spark, place)
    done = now.read(spark, "files").filter("reason is null")
    return done.join(now.read(spark, "captures").select("file").distinct(), "file").select("file", "n", "t_min", "t_max")


@query(sql("SELECT 'one' AS store, 'psd' AS kind, count(*) AS rows, false AS faulty FROM v_psd UNION ALL SELECT 'two', 'pfp', count(*), false FROM v_pfp UNION ALL SELECT 'three', 'summaries', count(*), false FROM v_summary UNION ALL SELECT 'four', NULL, count(*), true FROM nation", "v_psd", "v_pfp", "v_summary"))
def identify_store(spark, sf_dir):
    """Stores told by their footers: kind and rows without a scan."""
    place = _place(spark)
    V.psd(spark, sf_dir).withColumnRenamed("spec_db", "spec").write.partitionBy("sensor").parquet(f"{place}/one")
    V.pfp(spark, sf_dir).withColumnRenamed("frame_db", "spec").repartition(3).write.parquet(f"{place}/two")
    V.summary(spark, sf_dir).write.parquet(f"{place}/three")
    V.table(spark, sf_dir, "nation").write.parquet(f"{place}/four")
    found = discovery.stores(spark, place)
    return found.select(F.element_at(F.split("store", "/"), -1).alias("store"), "kind", "rows", F.col("fault").isNotNull().alias("faulty"))


ACTIONS = """f AS (SELECT 'psd' AS kind, 'p' || (vec_id % 3) AS store, count(*) AS rows FROM embeddings GROUP BY ALL UNION ALL SELECT 'summaries', 's' || (user_id % 2), count(*) FROM events GROUP BY ALL
 UNION ALL SELECT 'pfp', 'there', count(*) FROM embeddings UNION ALL SELECT 'pfp', 'f0', count(*) FROM embeddings UNION ALL SELECT NULL, 'odd', count(*) FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, store = 'there' ORDER BY rows DESC, store) AS i FROM f)"""


@query(f"WITH {ACTIONS} SELECT store, kind, rows, CASE WHEN kind IS NULL THEN 'reject' WHEN store = 'there' THEN 'already' WHEN kind = 'pfp' THEN 'merge' WHEN i = 1 THEN 'install' WHEN kind = 'psd' THEN 'merge' ELSE 'skip' END AS action FROM r")
def store_discovery(spark, sf_dir):
    """What to do with written stores, from what is found in them: none of three of a kind is there, of another one is."""
    place = _place(spark)
    rows = V.table(spark, sf_dir, "embeddings").select("vec_id", F.lit("s").alias("sensor"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("spec"))
    summaries = V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sensor"), F.lit(1.0).alias("freq"), V.epoch(F.col("ts")).alias("t"), *[F.col("value").alias(c) for c in ("mx", "md", "mn")], (F.col("user_id") % 2).alias("k"))
    for k in range(3):
        rows.filter(F.col("vec_id") % 3 == k).drop("vec_id").write.parquet(f"{place}/p{k}")
    for k in range(2):
        summaries.filter(F.col("k") == k).drop("k").write.parquet(f"{place}/s{k}")
    for name in ("there", "f0"):
        rows.withColumn("freq", F.lit(1.0)).drop("vec_id").write.parquet(f"{place}/{name}")
    V.table(spark, sf_dir, "nation").write.parquet(f"{place}/odd")
    found = discovery.stores(spark, place)
    installed = found.filter(F.endswith("store", F.lit("/there"))).select("kind", F.col("store").alias("place"), "rows")
    plan = discovery.plan(found, installed)
    return plan.select(F.element_at(F.split("store", "/"), -1).alias("store"), "kind", "rows", "action")
