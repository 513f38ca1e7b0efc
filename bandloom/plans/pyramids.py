"""Queries: pyramids, grids, percentiles, gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.quant import NARROW, code, decode, quantize
from ..operators import pyramid as P
from ..operators.quantiles import percentiles
from ..sources import views as V
from ..sources.places import shared_place
from ..sources.views import sql
from .registry import query

Q = "[CAST(greatest(0, least(255, round_even((x + 180) / 90.0 * 255.0, 0))) AS SMALLINT) FOR x IN spec_db]"
CODES = f"SELECT sensor, t, stat, {Q} AS spec FROM v_psd"
CODES_STAT = CODES.replace("v_psd", "v_psd_stat")
LONG = "SELECT stat, sensor, t, unnest(range(0, 64)) AS pos, unnest(spec) AS v FROM"


def codes(spark: SparkSession, sf_dir: str, stat: bool = False) -> DataFrame:
    rows = V.psd_stat(spark, sf_dir) if stat else V.psd(spark, sf_dir)
    return rows.select("sensor", "t", "stat", quantize(F.col("spec_db"), NARROW.qmin, NARROW.qmax).alias("spec"))


def long_form(level: DataFrame, *by: str) -> DataFrame:
    return level.select(*by, F.posexplode("smax").alias("pos", "v"))


def rounded(level: DataFrame) -> DataFrame:
    return level.select("sensor", "freq", "t", F.round("mx", 6).alias("mx"), F.round("md", 6).alias("md"), F.round("mn", 6).alias("mn"), "c")


def _summary_sql(bucket: int) -> str:
    return sql(f"SELECT sensor, freq, CAST(floor(t / {bucket}) * {bucket} AS BIGINT) AS t, round(max(mx), 6) AS mx, round(avg(md), 6) AS md, round(avg(mn), 6) AS mn, count(*) AS c FROM v_summary GROUP BY ALL", "v_summary")


@query(_summary_sql(600))
def summary_pyramid_m10(spark, sf_dir):
    return rounded(P.summary_level(V.summary(spark, sf_dir), 600))


@query(_summary_sql(3600))
def summary_pyramid_h1(spark, sf_dir):
    return rounded(P.summary_level(V.summary(spark, sf_dir), 3600))


@query(_summary_sql(21600))
def summary_pyramid_h6(spark, sf_dir):
    return rounded(P.summary_level(V.summary(spark, sf_dir), 21_600))


@query(_summary_sql(86400))
def summary_pyramid_d1(spark, sf_dir):
    return rounded(P.summary_level(V.summary(spark, sf_dir), 86_400))


@query(" UNION ALL ".join(f"SELECT {b} AS bucket, * FROM ({_summary_sql(b)})" for b in P.BUCKETS))
def summary_pyramid_all(spark, sf_dir):
    """All levels in one pass."""
    df = P.summary_pyramid(V.summary(spark, sf_dir))
    return df.select("bucket", "sensor", "freq", "t", F.round("mx", 6).alias("mx"), F.round("md", 6).alias("md"), F.round("mn", 6).alias("mn"), "c")


def _level_sql(bucket: int, source: str = CODES, *views: str) -> str:
    return sql(f"WITH c AS ({source}) SELECT stat, sensor, CAST(floor(t / {bucket}) * {bucket} AS BIGINT) AS t, pos, max(v) AS v FROM ({LONG} c) GROUP BY ALL", *(views or ("v_psd",)))


@query(_level_sql(600))
def psd_level_base(spark, sf_dir):
    return long_form(P.psd_level(codes(spark, sf_dir), 600), "stat", "sensor", "t")


@query(_level_sql(21600))
def psd_level_rollup(spark, sf_dir):
    """The third level from the second from the first."""
    base = P.psd_level(codes(spark, sf_dir), 600)
    return long_form(P.roll_up(P.roll_up(base, 3600), 21_600), "stat", "sensor", "t")


@query(_level_sql(3600, CODES_STAT, "v_psd_stat"))
def psd_level_stat(spark, sf_dir):
    """Median and mean layers: maxima of medians and of means, by the same operator."""
    return long_form(P.psd_level(codes(spark, sf_dir, stat=True), 3600), "stat", "sensor", "t")


@query(_level_sql(3600))
def psd_level_topup(spark, sf_dir):
    """The level of the captures so far, topped up from a late start, is that of all captures."""
    every = codes(spark, sf_dir)
    old = P.psd_level(every.filter(F.col("t") < V.T0 + 90 * 200), 3600)
    return long_form(P.top_up(old, every, int(V.T0) + 90 * 200, 3600), "stat", "sensor", "t")


WINDOW = (V.T0 + 1000, V.T0 + 41_000)


def windows(spark: SparkSession, sf_dir: str, t0: float = WINDOW[0], t1: float = WINDOW[1]) -> DataFrame:
    """One window for each sensor in the tables; sensors are a fixed list of five."""
    sensors = F.explode(F.array(*map(F.lit, V.SENSORS))).alias("sensor")
    return spark.range(1).select(sensors, F.lit(t0).alias("t0"), F.lit(t1).alias("t1")).withColumn("window_id", F.col("sensor"))


WIN = f"w AS (SELECT unnest(['click','error','purchase','signup','view']) AS sensor, {WINDOW[0]}::DOUBLE AS t0, {WINDOW[1]}::DOUBLE AS t1)"
GRID = f"g AS (SELECT sensor, least(39, greatest(0, CAST(trunc((t - t0) / (t1 - t0) * 40) AS INTEGER))) AS col, t, spec FROM c JOIN w USING (sensor) WHERE t >= t0 AND t < t1)"
POOLED = "p AS (SELECT sensor, col, pos, max(v) AS v FROM (SELECT sensor, col, unnest(range(0, 64)) AS pos, unnest(spec) AS v FROM g) GROUP BY ALL)"


@query(sql(f"WITH c AS ({CODES}), {WIN}, {GRID}, {POOLED} SELECT p.sensor AS window_id, p.col, pos, v, n FROM p JOIN (SELECT sensor, col, count(*) AS n FROM g GROUP BY ALL) USING (sensor, col)", "v_psd"))
def grid_max_pool(spark, sf_dir):
    return long_form(P.to_grid(codes(spark, sf_dir), windows(spark, sf_dir), 40, ["sensor"], "spec"), "window_id", "col", "n")


@query(sql(f"WITH c AS ({CODES}), {WIN}, {GRID}, {POOLED} SELECT sensor AS window_id, col, CAST(pos // 7 AS INTEGER) AS r, max(v) AS v FROM p GROUP BY ALL", "v_psd"))
def freq_pool(spark, sf_dir):
    grid = P.to_grid(codes(spark, sf_dir), windows(spark, sf_dir), 40, ["sensor"], "spec")
    return grid.select("window_id", "col", F.posexplode(P.pool_rows(F.col("smax"), 64, 10)).alias("r", "v"))


@query(sql(f"""WITH c AS ({CODES}), {WIN}, lv AS (SELECT sensor, CAST(floor(t / 3600) * 3600 AS BIGINT) AS t, pos, max(v) AS v FROM ({LONG} c) GROUP BY ALL),
o AS (SELECT sensor, pos, v, greatest(0, floor((t - t0) / ((t1 - t0) / 40))) AS lo, least(39, floor((t + 3600 - 1e-9 - t0) / ((t1 - t0) / 40))) AS hi FROM lv JOIN w USING (sensor) WHERE t + 3600 > t0 AND t < t1)
SELECT sensor AS window_id, CAST(col AS INTEGER) AS col, pos, max(v) AS v FROM (SELECT sensor, pos, v, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) AS col FROM o) GROUP BY ALL""", "v_psd"))
def level_overlap_pool(spark, sf_dir):
    level = P.psd_level(codes(spark, sf_dir), 3600)
    return long_form(P.levels_to_grid(level, windows(spark, sf_dir), 40, 3600, ["sensor"]), "window_id", "col")


@query(sql(f"""WITH c AS ({CODES}), {WIN}, {GRID}, m AS (SELECT sensor, col, max(list_max(spec)) AS v FROM g GROUP BY ALL),
e AS (SELECT sensor, unnest(range(0, 40)) AS col FROM w), j AS (SELECT e.sensor, CAST(e.col AS INTEGER) AS col, m.v FROM e LEFT JOIN m ON m.sensor = e.sensor AND m.col = e.col)
SELECT sensor AS window_id, col, v IS NOT NULL AS filled, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(v IGNORE NULLS) OVER (PARTITION BY sensor ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM j""", "v_psd"))
def sample_hold(spark, sf_dir):
    w = windows(spark, sf_dir)
    grid = P.to_grid(codes(spark, sf_dir), w, 40, ["sensor"], "spec").select("window_id", "col", F.array_max("smax").alias("v"))
    return P.hold(grid, w, 40, "v")


AHEAD = (V.T0 - 500, V.T0 + 700)


@query(sql(f"""WITH c AS ({CODES}), w AS (SELECT unnest(['click','error','purchase','signup','view']) AS sensor, {AHEAD[1]}::DOUBLE AS t1), j AS (SELECT * FROM c JOIN w USING (sensor)),
k AS (SELECT sensor, coalesce(max(t) FILTER (WHERE t < t1), min(t)) AS t FROM j GROUP BY sensor)
SELECT sensor AS window_id, t, pos, v FROM (SELECT k.sensor, k.t, unnest(range(0, 64)) AS pos, unnest(spec) AS v FROM k JOIN c ON c.sensor = k.sensor AND c.t = k.t)""", "v_psd"))
def asof_hold(spark, sf_dir):
    found = P.as_of(codes(spark, sf_dir), windows(spark, sf_dir, *AHEAD), ["sensor"], "spec")
    return found.select("window_id", "t", F.posexplode("spec").alias("pos", "v"))


@query(sql("SELECT sensor, round(quantile_cont(x, 0.02), 6) AS p2, round(quantile_cont(x, 0.98), 6) AS p98 FROM (SELECT sensor, -180 + unnest(spec) / 255.0::DOUBLE * 90 AS x FROM (" + CODES + ")) GROUP BY sensor", "v_psd"))
def display_scale(spark, sf_dir):
    values = codes(spark, sf_dir).select("sensor", F.explode("spec").alias("q")).select("sensor", decode(F.col("q"), NARROW.qmin, NARROW.qmax).alias("x"))
    p = percentiles(values, ["sensor"], "x", [0.02, 0.98])
    return p.select("sensor", F.round(F.col("p")[0], 6).alias("p2"), F.round(F.col("p")[1], 6).alias("p98"))


@query(sql("SELECT DISTINCT sensor, freq FROM v_summary", "v_summary"))
def distinct_channels(spark, sf_dir):
    return V.summary(spark, sf_dir).select("sensor", "freq").distinct().orderBy("sensor", "freq")


@query(sql(f"SELECT sensor, count(*) AS n FROM v_psd WHERE t >= {WINDOW[0]} AND t < {WINDOW[1]} GROUP BY sensor", "v_psd"))
def window_count(spark, sf_dir):
    return V.psd(spark, sf_dir).filter((F.col("t") >= WINDOW[0]) & (F.col("t") < WINDOW[1])).groupBy("sensor").agg(F.count("*").alias("n"))


@query(sql("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY t, freq, mx) - 1 AS k, count(*) OVER (PARTITION BY sensor) AS n FROM v_summary),
s AS (SELECT *, CASE WHEN n > 400 THEN CAST(ceil(n / 400.0) AS BIGINT) ELSE 1 END AS stride FROM n) SELECT sensor, stride, round(t, 6) AS t, freq, round(mx, 6) AS mx FROM s WHERE k % stride = 0""", "v_summary"))
def stride_thin(spark, sf_dir):
    """Every Nth row in time order, so that at most 400 a sensor are left: an explicit opt-in."""
    rows = V.summary(spark, sf_dir)
    sizes = rows.groupBy("sensor").agg(F.count("*").alias("n"))
    stride = F.when(F.col("n") > 400, F.ceil(F.col("n") / 400)).otherwise(1).cast("long")
    rows = P.numbered(rows, ["sensor"], "freq", "mx").join(sizes, "sensor").withColumn("stride", stride)
    return rows.filter(F.col("k") % F.col("stride") == 0).select("sensor", "stride", F.round("t", 6).alias("t"), "freq", F.round("mx", 6).alias("mx"))


@query(sql("""WITH r AS (SELECT sensor, min(t) AS a, greatest((max(t) - min(t)) / 16, 1) AS step FROM v_psd GROUP BY sensor),
s AS (SELECT v.sensor, t, least(15, CAST(floor((t - a) / step) AS INTEGER)) AS slot FROM v_psd v JOIN r USING (sensor)),
f AS (SELECT *, row_number() OVER (PARTITION BY sensor, slot ORDER BY t) AS k FROM s), p AS (SELECT sensor, slot, t, row_number() OVER (PARTITION BY sensor ORDER BY t) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY sensor) // 100) AS stride FROM f WHERE k <= 16)
SELECT sensor, slot, t, CAST(i // stride AS INTEGER) AS k FROM p WHERE i % stride = 0""", "v_psd"))
def spread_probe(spark, sf_dir):
    """The first 16 captures of each of 16 equal slots of a sensor's range, thinned evenly to about a hundred."""
    return P.spread_sample(V.psd(spark, sf_dir).select("sensor", "t"), ["sensor"], most=100)


@query(sql(f"SELECT sensor, 'max' AS stat, CAST(floor(t / 3600) * 3600 AS BIGINT) AS t, pos, max(v) AS v FROM (SELECT sensor, t, unnest(range(0, 64)) AS pos, unnest(spec) AS v FROM ({CODES})) GROUP BY ALL", "v_psd"))
def level_top_up(spark, sf_dir):
    """A stored level built of the captures up to some instant and brought up to all of them: whole days are replaced."""
    place = shared_place(spark, "level")
    c = codes(spark, sf_dir)
    since = (V.T0 + c.agg(F.max("t")).first()[0]) / 2
    P.write_level(P.psd_level(c.filter(F.col("t") < since), 3600), place)
    P.top_up_stored(place, c, since, 3600)
    return long_form(spark.read.parquet(place), "sensor", "stat", "t")


@query(sql("SELECT sensor, count(*) AS n, count(*) FILTER (WHERE p IS NOT NULL AND t <= p) AS out_of_order FROM (SELECT sensor, t, lag(t) OVER (PARTITION BY sensor ORDER BY id) AS p FROM (SELECT event_type AS sensor, epoch(ts) AS t, event_id AS id FROM events)) GROUP BY sensor"))
def order_check(spark, sf_dir):
    """Captures that do not follow their predecessor in the file's order."""
    e = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("sensor"), V.epoch(F.col("ts")).alias("t"), "event_id")
    return P.previous(e, ["sensor"], "event_id", "t", 100_000).groupBy("sensor").agg(F.count("*").alias("n"), F.count(F.when(F.col("t") <= F.col("p"), 1)).alias("out_of_order"))


@query(sql(f"SELECT {code.__name__!r} AS kind, sensor, t, unnest(range(0, 64)) AS pos, unnest(spec) AS q FROM ({CODES})", "v_psd"))
def quantize_codes(spark, sf_dir):
    return codes(spark, sf_dir).select(F.lit("code").alias("kind"), "sensor", "t", F.posexplode("spec").alias("pos", "q"))
