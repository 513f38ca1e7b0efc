"""Queries: predicates, validation, quantization, and upkeep of stores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import quant as QF
from ..functions.quant import NARROW
from ..operators import store as S
from ..operators.discovery import plan
from ..operators.files import PSD_NAME
from ..operators.quantiles import percentiles
from ..sources import views as V
from ..sources.views import sql
from .pyramids import CODES, CODES_STAT, WINDOW, codes
from .registry import query


@query(sql(f"SELECT sensor, freq, round(t, 6) AS t, round(mx, 6) AS mx FROM v_summary WHERE sensor = 'view' AND freq = 3555 AND t >= {WINDOW[0]} AND t < {WINDOW[1]}", "v_summary"))
def window_filter(spark, sf_dir):
    s = V.summary(spark, sf_dir).filter((F.col("sensor") == "view") & (F.col("freq") == 3555) & (F.col("t") >= WINDOW[0]) & (F.col("t") < WINDOW[1]))
    return s.select("sensor", "freq", F.round("t", 6).alias("t"), F.round("mx", 6).alias("mx"))


def exports(spark, sf_dir):
    """Day files made from the spectra, some of them broken: file, t, values."""
    rows = V.psd(spark, sf_dir)
    vec = F.round((F.col("t") - V.T0) / 90).cast("long")
    file = F.concat_ws("_", F.floor((F.col("t") - V.T0) / 7200).cast("string"), "sensor")
    values = (
        F.when(vec % 97 == 3, F.slice("spec_db", 1, 63)).when(vec % 89 == 5, F.transform("spec_db", lambda x, i: F.when(i == 7, F.lit(None)).otherwise(x)))
        .when(vec % 83 == 6, F.transform("spec_db", lambda x, i: F.when(i == 9, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("spec_db"))
    )
    return rows.select(file.alias("file"), "sensor", F.when(vec % 79 != 4, F.col("t")).alias("t"), values.alias("values"))


EXPORTS = """x AS (SELECT CAST(CAST(floor((t - 1704067200) / 7200) AS BIGINT) AS VARCHAR) || '_' || sensor AS file, sensor, CAST(round((t - 1704067200) / 90) AS BIGINT) AS vec, t, spec_db FROM v_psd)"""
BAD = {
    "geometry": "vec % 97 = 3", "nonfinite": "vec % 97 <> 3 AND (vec % 89 = 5 OR vec % 83 = 6)", "blank_ts": "vec % 79 = 4",
}


def _reject_sql(reason: str) -> str:
    return sql(f"WITH {EXPORTS} SELECT file, '{reason}' AS reason, count(*) AS n FROM x WHERE {BAD[reason]} GROUP BY file", "v_psd")


@query(_reject_sql("geometry"))
def reject_geometry(spark, sf_dir):
    return S.rejects(exports(spark, sf_dir), NARROW.n).filter("reason = 'geometry'")


@query(_reject_sql("nonfinite"))
def reject_nonfinite(spark, sf_dir):
    return S.rejects(exports(spark, sf_dir), NARROW.n).filter("reason = 'nonfinite'")


@query(_reject_sql("blank_ts"))
def reject_blank_ts(spark, sf_dir):
    return S.rejects(exports(spark, sf_dir), NARROW.n).filter("reason = 'blank_ts'")


@query("WITH l AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '_' || event_type AS file FROM events), h AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '_' || event_type AS file FROM events WHERE value >= 20) SELECT file, 'empty' AS reason, 0::BIGINT AS n FROM l WHERE file NOT IN (SELECT file FROM h)")
def reject_empty(spark, sf_dir):
    """Files of which a header alone is left."""
    e = V.table(spark, sf_dir, "events").select(F.concat_ws("_", F.date_format("ts", "yyyy-MM-dd"), "event_type").alias("file"), V.epoch(F.col("ts")).alias("t"), F.array("value").alias("values"))
    return S.rejects(e.filter(F.col("values")[0] >= 20), 1, e).filter("reason = 'empty'")


@query("""SELECT event_id, round(CASE event_id % 6 WHEN 0 THEN epoch(ts) WHEN 1 THEN epoch(ts) WHEN 2 THEN epoch(ts) - 19800 WHEN 3 THEN epoch(ts) + 28800 WHEN 4 THEN floor(epoch(ts)) ELSE NULL END, 6) AS t FROM events""")
def ts_normalise(spark, sf_dir):
    """The stamp forms of exports: blank or T between, Z, an offset with or without minutes, none; and no stamp at all."""
    full, whole = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, F.concat(full, F.lit("+00"))).when(k == 1, F.concat(F.replace(full, F.lit(" "), F.lit("T")), F.lit("Z"))).when(k == 2, F.concat(full, F.lit("+05:30")))
        .when(k == 3, F.concat(full, F.lit("-08"))).when(k == 4, whole).otherwise(F.lit("not a time"))
    )
    return V.table(spark, sf_dir, "events").select("event_id", F.round(QF.epoch_seconds(text), 6).alias("t"))


@query(sql(f"SELECT sensor, stat, q, count(*) AS n FROM (SELECT sensor, stat, unnest(spec) AS q FROM ({CODES_STAT})) GROUP BY ALL", "v_psd_stat"))
def quantize(spark, sf_dir):
    """How often each code occurs, by sensor and statistic."""
    return codes(spark, sf_dir, stat=True).select("sensor", "stat", F.explode("spec").alias("q")).groupBy("sensor", "stat", "q").agg(F.count("*").alias("n"))


@query(sql(f"SELECT sensor, t, pos, round(-180 + q / 255.0::DOUBLE * 90 + 70, 6) AS dbm FROM (SELECT sensor, t, unnest(range(0, 64)) AS pos, unnest(spec) AS q FROM ({CODES}))", "v_psd"))
def dequantize(spark, sf_dir):
    d = QF.dequantize(F.col("spec"), NARROW.qmin, NARROW.qmax, QF.CHANNEL_OFFSET)
    return codes(spark, sf_dir).select("sensor", "t", F.posexplode(d).alias("pos", "dbm")).withColumn("dbm", F.round("dbm", 6))


@query(sql("SELECT sensor, count(*) FILTER (WHERE x < -180 OR x > -90) AS clipped, count(*) AS cells, round(100.0::DOUBLE * count(*) FILTER (WHERE x < -180 OR x > -90) / count(*), 6) AS percent FROM (SELECT sensor, unnest(spec_db) * 1.3 + 40 AS x FROM v_psd) GROUP BY sensor", "v_psd"))
def clip_report(spark, sf_dir):
    wide = V.psd(spark, sf_dir).select("sensor", F.transform("spec_db", lambda x: x * F.lit(1.3) + 40).alias("values"))
    return S.clip_report(wide, NARROW, ["sensor"]).withColumn("percent", F.round("percent", 6))


@query(sql("SELECT sensor, freq, CAST(round_even(t, 0) AS BIGINT) AS t, CAST(round(mx * 10) AS SMALLINT) AS mx, CAST(round(md * 10) AS SMALLINT) AS md, 10 AS scale FROM v_summary", "v_summary"))
def db_pack(spark, sf_dir):
    """Tenths of a decibel with an explicit scale, so that nothing is packed twice."""
    s = V.summary(spark, sf_dir)
    return S.pack_summaries(s.select("sensor", "freq", "t", "mx", "md"))


@query(sql("SELECT sensor, freq, count(*) AS n, count(mx) AS known, round(max(mx), 6) AS mx FROM (SELECT sensor, freq, CASE WHEN CAST(floor(t) AS BIGINT) % 5 = 0 THEN NULL ELSE round(mx * 10) / 10 END AS mx FROM v_summary) GROUP BY ALL", "v_summary"))
def db_unpack(spark, sf_dir):
    """Packed and plain rows read alike by their scale; nulls stay null."""
    packed = F.when(F.floor("t") % 5 != 0, QF.pack_db(F.col("mx")))
    rows = V.summary(spark, sf_dir).select("sensor", "freq", QF.unpack_db(packed, F.lit(10)).alias("mx"))
    return rows.groupBy("sensor", "freq").agg(F.count("*").alias("n"), F.count("mx").alias("known"), F.round(F.max("mx"), 6).alias("mx"))


LOW, HIGH = 3_530_900_000.0, 3_533_100_000.0


@query(sql(f"SELECT sensor, t, {round((LOW - NARROW.f0) / NARROW.df)} + i AS bin, v FROM (SELECT sensor, t, unnest(range(0, {round((HIGH - NARROW.f0) / NARROW.df) - round((LOW - NARROW.f0) / NARROW.df) + 1})) AS i, unnest(spec[{round((LOW - NARROW.f0) / NARROW.df) + 1}:{round((HIGH - NARROW.f0) / NARROW.df) + 1}]) AS v FROM ({CODES}))", "v_psd"))
def band_slice(spark, sf_dir):
    low, high = QF.band(LOW, HIGH, NARROW)
    part = F.slice("spec", low + 1, high - low + 1)
    return codes(spark, sf_dir).select("sensor", "t", F.posexplode(part).alias("i", "v")).select("sensor", "t", (F.col("i") + low).cast("long").alias("bin"), "v")


@query(sql("WITH s AS (SELECT sensor, quantile_cont(mx, 0.02) AS a, quantile_cont(mx, 0.98) AS b FROM v_summary GROUP BY sensor) SELECT sensor, idx, count(*) AS n FROM (SELECT sensor, CAST(floor(greatest(0, least(255, (mx - a) / greatest(b - a, 1e-6) * 255))) AS SMALLINT) AS idx FROM v_summary JOIN s USING (sensor)) GROUP BY ALL", "v_summary"))
def colour_index(spark, sf_dir):
    s = V.summary(spark, sf_dir)
    p = percentiles(s, ["sensor"], "mx", [0.02, 0.98]).select("sensor", "p")
    idx = QF.colour_index(F.col("mx"), F.col("p")[0], F.col("p")[1])
    return s.join(p, "sensor").select("sensor", idx.alias("idx")).groupBy("sensor", "idx").agg(F.count("*").alias("n"))


NAME = f"'{PSD_NAME}'"


@query(sql(f"SELECT stat, count(*) AS n, stat IN ('max', 'median', 'mean') AS kept FROM (SELECT regexp_extract(name, {NAME}, 3) AS stat FROM v_files WHERE regexp_matches(name, {NAME})) GROUP BY ALL", "v_files"))
def stat_filter(spark, sf_dir):
    """Statistics that a layer of spectra keeps, and the others, which are reported."""
    f = V.files(spark, sf_dir).filter(S.is_day_file(F.col("name")))
    stat = F.regexp_extract("name", PSD_NAME, 3)
    return f.groupBy(stat.alias("stat")).agg(F.count("*").alias("n")).withColumn("kept", F.col("stat").isin("max", "median", "mean"))


@query(sql("WITH p AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS dir, CASE WHEN size % 5 = 0 AND path LIKE 'root/d1%' THEN 'max_peak' ELSE regexp_extract(name, '_([^_]+)\\.csv$', 1) END AS stat FROM v_files WHERE name LIKE 'PFP!_%' ESCAPE '!') SELECT dir, CASE WHEN bool_or(stat = 'max_peak') THEN 'max_peak' ELSE min(stat) END AS chosen, string_agg(stat, ',' ORDER BY stat) AS stats FROM p GROUP BY dir", "v_files"))
def pfp_stat_choice(spark, sf_dir):
    f = V.files(spark, sf_dir).filter(F.col("name").startswith("PFP_"))
    dir_ = F.regexp_extract("path", "^(.*)/", 1)
    stat = F.when((F.col("size") % 5 == 0) & F.col("path").startswith("root/d1"), "max_peak").otherwise(F.regexp_extract("name", r"_([^_]+)\.csv$", 1))
    return S.choose_statistic(f.select(dir_.alias("dir"), stat.alias("stat")), "dir").withColumn("stats", F.array_join("stats", ","))


@query(sql("SELECT sensor, t_min, t_max FROM (SELECT sensor, CASE WHEN sensor = 'error' THEN NULL ELSE min(t) END AS t_min, max(t) AS t_max FROM v_psd GROUP BY sensor) WHERE t_min IS NOT NULL AND t_max IS NOT NULL", "v_psd"))
def advertised_layers(spark, sf_dir):
    meta = S.layer_meta(V.psd(spark, sf_dir), ["sensor"]).withColumn("t_min", F.when(F.col("sensor") != "error", F.col("t_min")))
    return meta.filter("t_min is not null and t_max is not null").select("sensor", "t_min", "t_max")


@query(sql("SELECT sensor, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS n FROM v_summary GROUP BY ALL", "v_summary"))
def captures_per_day(spark, sf_dir):
    return S.captures_per_day(V.summary(spark, sf_dir))


def day_files(spark, sf_dir):
    """One file for each sensor and day with its first capture, in some unreadable."""
    s = V.summary(spark, sf_dir)
    day = F.floor(F.col("t") / S.DAY).cast("long").alias("day")
    first = s.groupBy("sensor", day).agg(F.min("t").alias("first_t"))
    return first.withColumn("first_t", F.when(F.col("day") % 7 != 3, F.col("first_t")))


FILES = "f AS (SELECT sensor, day, CASE WHEN day % 7 <> 3 THEN first_t END AS first_t FROM (SELECT sensor, CAST(floor(t / 86400) AS BIGINT) AS day, min(t) AS first_t FROM v_summary GROUP BY ALL))"
STORED = "s AS (SELECT sensor, t FROM v_summary WHERE CAST(floor(t / 86400) AS BIGINT) % 3 = 0 OR (CAST(floor(t / 86400) AS BIGINT) % 3 = 1 AND t - floor(t / 86400) * 86400 < 3600))"


def stored(spark, sf_dir):
    day = F.floor(F.col("t") / S.DAY)
    return V.summary(spark, sf_dir).filter((day % 3 == 0) | ((day % 3 == 1) & (F.col("t") - day * S.DAY < 3600))).select("sensor", "t")


RESUME = f"""WITH {FILES}, {STORED}, c AS (SELECT sensor, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT DISTINCT sensor, CAST(round_even(t * 1000, 0) AS BIGINT) AS ms FROM s)
SELECT f.sensor, f.day, coalesce(n, 0) AS stored, CASE WHEN coalesce(n, 0) = 0 THEN false WHEN n > 4 THEN true ELSE first_t IS NULL OR m.ms IS NOT NULL END AS ingested
FROM f LEFT JOIN c USING (sensor, day) LEFT JOIN m ON m.sensor = f.sensor AND m.ms = CAST(round_even(first_t * 1000, 0) AS BIGINT)"""


@query(sql(RESUME, "v_summary"))
def resume_plan(spark, sf_dir):
    return S.resume_plan(day_files(spark, sf_dir), stored(spark, sf_dir))


@query(sql(f"SELECT sensor, day FROM (SELECT sensor, day, row_number() OVER (PARTITION BY sensor ORDER BY day) AS k FROM ({{}}) WHERE NOT ingested) WHERE k <= 3".replace("{}", sql(RESUME, "v_summary"))))
def resume_limit(spark, sf_dir):
    """The first three days still to do: the limit comes after the resume filter."""
    todo = S.resume_plan(day_files(spark, sf_dir), stored(spark, sf_dir)).filter("not ingested")
    return todo.withColumn("k", F.row_number().over(W.partitionBy("sensor").orderBy("day"))).filter("k <= 3").select("sensor", "day")


@query("SELECT event_type || '_' || strftime(ts, '%Y-%m-%d') AS file, round(arg_min(epoch(ts), event_id), 6) AS t FROM events GROUP BY 1")
def first_capture(spark, sf_dir):
    """Of each file the capture of its first line."""
    e = V.table(spark, sf_dir, "events")
    return e.groupBy(F.concat_ws("_", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("file")).agg(F.round(F.min_by(V.epoch(F.col("ts")), "event_id"), 6).alias("t"))


@query(sql("SELECT DISTINCT sensor, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM v_psd", "v_psd"))
def stored_days(spark, sf_dir):
    return V.psd(spark, sf_dir).select("sensor", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd").alias("day")).distinct()


@query(sql("SELECT sensor, stat, min(t) AS t_min, max(t) AS t_max, count(*) AS n FROM v_psd_stat GROUP BY ALL", "v_psd_stat"))
def layer_meta(spark, sf_dir):
    return S.layer_meta(V.psd_stat(spark, sf_dir), ["sensor", "stat"])


PART = "SELECT * FROM v_psd WHERE sensor IN ('click', 'view', 'error')"
TARGET = "SELECT * FROM v_psd WHERE sensor IN ('view', 'signup') AND t < 1704067200 + 20000"


@query(sql(f"WITH a AS ({PART}), b AS ({TARGET}), m AS (SELECT sensor, t FROM b UNION ALL SELECT sensor, t FROM a WHERE sensor NOT IN (SELECT sensor FROM b)) SELECT sensor, count(*) AS n, min(t) AS t_min, max(t) AS t_max FROM m GROUP BY sensor", "v_psd"))
def merge_units(spark, sf_dir):
    p = V.psd(spark, sf_dir)
    merged, _ = S.merge_units(p.filter(F.col("sensor").isin("click", "view", "error")), p.filter(F.col("sensor").isin("view", "signup") & (F.col("t") < V.T0 + 20_000)), "sensor")
    return S.layer_meta(merged, ["sensor"])


@query(sql(f"WITH a AS ({PART}), b AS ({TARGET}) SELECT sensor, count(*) AS n, CASE WHEN sensor IN (SELECT sensor FROM b) THEN 'skipped' ELSE 'added' END AS action FROM a GROUP BY sensor", "v_psd"))
def merge_report(spark, sf_dir):
    p = V.psd(spark, sf_dir)
    return S.merge_units(p.filter(F.col("sensor").isin("click", "view", "error")), p.filter(F.col("sensor").isin("view", "signup") & (F.col("t") < V.T0 + 20_000)), "sensor")[1]


@query("WITH f AS (SELECT event_type AS kind, user_id % 4 AS store, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, store) AS k FROM f) SELECT kind, store, n, CASE WHEN kind = 'error' THEN 'already' WHEN k = 1 THEN 'install' WHEN n > 0 AND kind <> 'view' THEN 'merge' ELSE 'skip' END AS action FROM r")
def store_plan(spark, sf_dir):
    """Prebuilt stores by kind, largest first: the first is installed, others are merged where that is possible; one kind's stand in their places."""
    f = V.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("store")).agg(F.count("*").alias("rows"))
    there = f.filter("kind = 'error'").select("kind", F.col("store").alias("place"), "rows")
    found = plan(f.withColumn("fault", F.lit(None).cast("string")), there, [s for s in V.SENSORS if s != "view"])
    return found.select("kind", "store", F.col("rows").alias("n"), "action")


@query(sql("SELECT sensor, n, sensor IN (SELECT sensor FROM v_psd WHERE t < 1704067200 + 300) AS kept FROM (SELECT sensor, count(*) AS n FROM v_summary GROUP BY sensor)", "v_summary", "v_psd"))
def orphan_meta(spark, sf_dir):
    meta = V.summary(spark, sf_dir).groupBy("sensor").agg(F.count("*").alias("n"))
    kept, gone = S.drop_orphans(meta, V.psd(spark, sf_dir).filter(F.col("t") < V.T0 + 300), "sensor")
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@query(sql("WITH m AS (SELECT sensor, min(t) AS a, max(t) AS b, count(*) AS n FROM v_summary GROUP BY sensor UNION ALL SELECT sensor, min(t), max(t), count(*) FROM v_psd GROUP BY sensor UNION ALL SELECT sensor, min(t), max(t), count(*) FROM v_pfp GROUP BY sensor) SELECT sensor, round(min(a), 6) AS t_min, round(max(b), 6) AS t_max, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY sensor", "v_summary", "v_psd", "v_pfp"))
def coverage_union(spark, sf_dir):
    c = S.coverage(*[S.layer_meta(v(spark, sf_dir), ["sensor"]) for v in (V.summary, V.psd, V.pfp)])
    return c.select("sensor", F.round("t_min", 6).alias("t_min"), F.round("t_max", 6).alias("t_max"), "n")


@query(sql("SELECT sensor, 'max,median,mean' AS stats FROM v_psd_stat GROUP BY sensor", "v_psd_stat"))
def stats_available(spark, sf_dir):
    """A sensor's statistics, in a fixed order."""
    order = {"max": 0, "median": 1, "mean": 2}
    place = F.struct(F.coalesce(*[F.when(F.col("stat") == s, k) for s, k in order.items()]).alias("k"), "stat")
    return V.psd_stat(spark, sf_dir).groupBy("sensor").agg(F.array_join(F.transform(F.sort_array(F.collect_set(place)), lambda x: x["stat"]), ",").alias("stats"))


CHUNKS = f"k AS (SELECT sensor, t, spec, CAST(floor((row_number() OVER (PARTITION BY sensor ORDER BY t) - 1) / 16) AS BIGINT) AS chunk FROM ({CODES}))"


@query(sql(f"WITH {CHUNKS} SELECT sensor, chunk, min(t) AS t0, max(t) AS t1, count(*) AS n, CAST(sum(list_sum(spec)) AS BIGINT) AS total FROM k GROUP BY ALL", "v_psd"))
def chunk_pack(spark, sf_dir):
    chunks = S.pack(codes(spark, sf_dir).select("sensor", "t", "spec"), ["sensor"], 16, "spec")
    total = F.aggregate("caps", F.lit(0).cast("long"), lambda a, c: a + F.aggregate(c["spec"], F.lit(0).cast("long"), lambda x, y: x + y))
    return chunks.select("sensor", "chunk", "t0", "t1", "n", total.alias("total"))


@query(sql(f"SELECT sensor, t, CAST(list_sum(spec) AS BIGINT) AS total FROM ({CODES})", "v_psd"))
def chunk_unpack(spark, sf_dir):
    chunks = S.pack(codes(spark, sf_dir).select("sensor", "t", "spec"), ["sensor"], 16, "spec")
    return S.unpack(chunks, ["sensor"]).select("sensor", "t", F.aggregate("spec", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))


@query(sql("SELECT sensor, count(*) AS source_n, count(*) AS packed_n, true AS ok FROM v_psd GROUP BY sensor", "v_psd"))
def pack_guard(spark, sf_dir):
    c = codes(spark, sf_dir).select("sensor", "t", "spec")
    return S.pack_guard(c, S.pack(c, ["sensor"], 16, "spec"), ["sensor"])


@query(sql("""WITH a AS (SELECT sensor, count(*) AS live_n FROM v_psd GROUP BY sensor), b AS (SELECT sensor, count(*) AS staged_n, max(t) AS st FROM v_psd WHERE sensor <> 'view' AND (sensor <> 'click' OR t < 1704067200 + 9000) GROUP BY sensor),
c AS (SELECT sensor, count(*) AS source_n, max(t) AS ct FROM v_psd GROUP BY sensor) SELECT c.sensor, coalesce(live_n, 0) AS live_n, coalesce(staged_n, 0) AS staged_n, source_n,
CASE WHEN coalesce(live_n, 0) > 0 AND coalesce(staged_n, 0) = 0 THEN 'refuse: empty' WHEN coalesce(staged_n, 0) <> source_n OR st IS DISTINCT FROM ct THEN 'refuse: stale' ELSE 'publish' END AS verdict
FROM c LEFT JOIN a USING (sensor) LEFT JOIN b USING (sensor)""", "v_psd"))
def publish_guard(spark, sf_dir):
    p = V.psd(spark, sf_dir).select("sensor", "t")
    staged = p.filter((F.col("sensor") != "view") & ((F.col("sensor") != "click") | (F.col("t") < V.T0 + 9000)))
    return S.publish_check(staged, p, p, ["sensor"])


@query(sql("SELECT sensor, count(*) AS n, min(t) AS t_min, max(t) AS t_max FROM v_psd GROUP BY sensor", "v_psd"))
def shape_union(spark, sf_dir):
    """Rows and chunks that overlap in time give each capture once."""
    c = codes(spark, sf_dir).select("sensor", "t", "spec")
    early, late = c.filter(F.col("t") < V.T0 + 30_000), c.filter(F.col("t") >= V.T0 + 20_000)
    return S.layer_meta(S.union_shapes(late, S.pack(early, ["sensor"], 16, "spec"), ["sensor"]), ["sensor"]).select("sensor", "n", "t_min", "t_max")


@query(sql(f"WITH {CHUNKS}, c AS (SELECT sensor, chunk, min(t) AS t0, max(t) AS t1, count(*) AS n FROM k GROUP BY ALL) SELECT * FROM c WHERE t1 >= {WINDOW[0]} AND t0 < {WINDOW[1]}", "v_psd"))
def chunk_overlap(spark, sf_dir):
    chunks = S.pack(codes(spark, sf_dir).select("sensor", "t", "spec"), ["sensor"], 16, "spec").drop("caps")
    return chunks.filter((F.col("t1") >= WINDOW[0]) & (F.col("t0") < WINDOW[1]))
