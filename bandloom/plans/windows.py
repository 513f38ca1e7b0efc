"""Queries: joins and lookups, quantile matching, and windows as grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quant import FRAMES, NARROW, decode, quantize
from ..operators import pyramid as P
from ..operators import windows as WN
from ..sources import views as V
from ..sources.views import sql
from .pyramids import CODES, GRID, WIN, codes, windows
from .registry import ORACLES, query

REQ = "r AS (SELECT event_id AS id, event_type AS sensor, user_id * value * 500 AS span, 200 + event_id % 2000 AS width, (event_id % 60) * 1e6 AS hz FROM events)"


def requests(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("sensor"), (F.col("user_id") * F.col("value") * 500).alias("span"), (200 + F.col("event_id") % 2000).alias("width"), ((F.col("event_id") % 60) * F.lit(1e6)).alias("hz"))


@query(sql(f"WITH {REQ} SELECT id, CASE WHEN span <= 21600 THEN 0 WHEN span / 600 <= width THEN 600 WHEN span / 3600 <= width THEN 3600 WHEN span / 21600 <= width THEN 21600 ELSE 86400 END AS level FROM r"))
def pick_summary_level(spark, sf_dir):
    return requests(spark, sf_dir).select("id", WN.summary_level_of(F.col("span"), F.col("width")).alias("level"))


@query(sql(f"WITH {REQ} SELECT id, CASE WHEN id * 17 <= width * 10 THEN NULL WHEN 21600 <= span / width THEN 21600 WHEN 3600 <= span / width THEN 3600 WHEN 600 <= span / width THEN 600 END AS level FROM r"))
def pick_psd_level(spark, sf_dir):
    return requests(spark, sf_dir).select("id", WN.psd_level_of(F.col("span"), F.col("width"), F.col("id") * 17, [600, 3600, 21_600]).alias("level"))


@query(sql(f"WITH {REQ} SELECT id, CASE WHEN hz > 0 AND hz <= 12e6 AND span <= 21600 THEN 'pfp' WHEN span <= 259200 OR (hz > 0 AND hz <= 40e6) THEN 'psd' ELSE 'summary' END AS layer FROM r"))
def layer_route(spark, sf_dir):
    return requests(spark, sf_dir).select("id", WN.route_layer(F.col("span"), F.col("hz")).alias("layer"))


@query(sql(f"WITH {WIN}, l AS (SELECT sensor, floor(min(t) / 3600) * 3600 AS a, floor(max(t) / 3600) * 3600 + 3600 AS b FROM v_psd GROUP BY sensor) SELECT w.sensor AS window_id, coalesce(a <= t0 AND b >= t1, false) AS covers FROM w LEFT JOIN l USING (sensor)", "v_psd"))
def level_coverage(spark, sf_dir):
    return WN.level_coverage(P.psd_level(codes(spark, sf_dir), 3600), windows(spark, sf_dir), 3600, ["sensor"])


@query(sql("""WITH r AS (SELECT event_id AS id, event_type AS sensor, 3535e6 + (event_id % 83) * 1e6 AS want FROM events), c AS (SELECT DISTINCT sensor, freq FROM v_pfp),
j AS (SELECT r.id, r.sensor, want, freq, row_number() OVER (PARTITION BY id ORDER BY abs(freq - want), freq) AS k FROM r LEFT JOIN c USING (sensor))
SELECT id, sensor, CASE WHEN abs(freq - want) <= 1e7 THEN freq END AS freq FROM j WHERE k = 1""", "v_pfp"))
def channel_snap(spark, sf_dir):
    r = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("sensor"), (F.lit(3535e6) + (F.col("event_id") % 83) * F.lit(1e6)).alias("want"))
    return WN.snap_channel(r, V.pfp(spark, sf_dir).select("sensor", "freq"), 1e7).select("id", "sensor", "freq")


@query(sql("SELECT id, r.sensor, captures FROM (SELECT event_id AS id, event_type AS sensor FROM events) r LEFT JOIN (SELECT sensor, count(*) AS captures FROM v_psd GROUP BY sensor) m USING (sensor)", "v_psd"))
def meta_lookup(spark, sf_dir):
    meta = V.psd(spark, sf_dir).groupBy("sensor").agg(F.count("*").alias("captures"))
    return V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("sensor")).join(meta, "sensor", "left").select("id", "sensor", "captures")


def match(spark, sf_dir, stat="max"):
    """The match of one statistic's spectra with the summaries' column of the same statistic."""
    psd = codes(spark, sf_dir, stat=True).filter(F.col("stat") == stat).select("sensor", F.explode("spec").alias("q")).select("sensor", decode(F.col("q"), NARROW.qmin, NARROW.qmax, 70.0).alias("x"))
    level = P.summary_level(V.summary(spark, sf_dir), 3600).select("sensor", F.col(WN.SHOWN_AS[stat]).alias("x"))
    return WN.match_table(psd, level)


KNOT_SQL = f"""a AS (SELECT sensor, -180 + unnest(spec) / 255.0::DOUBLE * 90 + 70 AS x FROM ({CODES})), b AS (SELECT sensor, max(mx) AS x FROM v_summary GROUP BY sensor, freq, floor(t / 3600)),
p AS (SELECT unnest(range(0, 65)) AS k), qa AS (SELECT sensor, quantile_cont(x, [{", ".join(repr(k / 64) for k in range(65))}]) AS v FROM a GROUP BY sensor HAVING count(*) >= 100), qb AS (SELECT sensor, quantile_cont(x, [{", ".join(repr(k / 64) for k in range(65))}]) AS v FROM b GROUP BY sensor HAVING count(*) >= 100),
knots AS (SELECT qa.sensor, k, qa.v[k + 1] + k * 1e-4 AS x, qb.v[k + 1] AS y FROM qa JOIN qb USING (sensor), p)"""


@query(sql(f"WITH {KNOT_SQL} SELECT sensor, CAST(k AS INTEGER) AS k, round(x + 1e-7, 4) AS x, round(y + 1e-7, 4) AS y FROM knots", "v_psd", "v_summary"))
def quantile_match(spark, sf_dir):
    both = F.arrays_zip("xs", "ys")
    return match(spark, sf_dir).select("sensor", F.posexplode(both).alias("k", "z")).select("sensor", "k", F.round(F.col("z.xs") + F.lit(1e-7), 4).alias("x"), F.round(F.col("z.ys") + F.lit(1e-7), 4).alias("y"))


@query(sql("""WITH a AS (SELECT sensor, unnest(spec_db) AS x FROM v_psd_stat WHERE stat = 'median'), b AS (SELECT sensor, avg(md) AS x FROM v_summary GROUP BY sensor, freq, floor(t / 3600)),
k AS (SELECT sensor FROM a GROUP BY sensor HAVING count(*) >= 100) SELECT sensor, round(quantile_cont(x, 0.02), 4) AS lo, round(quantile_cont(x, 0.98), 4) AS hi FROM b JOIN k USING (sensor) GROUP BY sensor HAVING count(*) >= 100""", "v_psd_stat", "v_summary"))
def match_range(spark, sf_dir):
    """The display range that goes with the match of the median layer."""
    return match(spark, sf_dir, "median").select("sensor", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query(sql(f"""WITH {KNOT_SQL}, c AS (SELECT unnest(range(0, 256)) AS q), l AS (SELECT *, lead(x) OVER (PARTITION BY sensor ORDER BY k) AS x2, lead(y) OVER (PARTITION BY sensor ORDER BY k) AS y2 FROM knots),
v AS (SELECT s.sensor, q, -180 + q / 255.0::DOUBLE * 90 + 70 AS v, lo, hi, ylo, yhi FROM c, (SELECT sensor, min(x) AS lo, max(x) AS hi, arg_min(y, k) AS ylo, arg_max(y, k) AS yhi FROM knots GROUP BY sensor) s)
SELECT v.sensor, CAST(q AS SMALLINT) AS q, round(CASE WHEN v < lo THEN ylo WHEN v >= hi THEN yhi ELSE y + (v - x) / (x2 - x) * (y2 - y) END, 5) AS dbm FROM v LEFT JOIN l ON l.sensor = v.sensor AND v.v >= x AND v.v < x2""", "v_psd", "v_summary"))
def match_remap(spark, sf_dir):
    return WN.code_table(match(spark, sf_dir), NARROW).withColumn("dbm", F.round("dbm", 5))


@query("SELECT event_type AS sensor, CASE WHEN bool_or(event_id % 3 = 0) AND event_type = 'view' THEN -90.0::DOUBLE WHEN event_type <> 'click' THEN round(min(value), 6) ELSE round(min(value) - 1, 6) END AS vmin, CASE WHEN event_type = 'view' THEN -40.0::DOUBLE WHEN event_type <> 'click' THEN round(max(value), 6) ELSE round(max(value) + 1, 6) END AS vmax FROM events GROUP BY event_type")
def scale_choice(spark, sf_dir):
    """view is locked, click has no matched scale."""
    e = V.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sensor")).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    lock = lambda v: F.when(F.col("sensor") == "view", F.lit(v))
    s = WN.pick_scale(lock(-90.0), lock(-40.0), F.when(F.col("sensor") != "click", F.array("a", "b")), F.array(F.col("a") - 1, F.col("b") + 1))
    return e.withColumn("s", s).select("sensor", F.round(F.col("s")[0], 6).alias("vmin"), F.round(F.col("s")[1], 6).alias("vmax"))


@query(sql(f"SELECT sensor, freq, CAST(floor(t / 600) * 600 AS BIGINT) AS t, round(max(mx), 6) AS mx, round(avg(md), 6) AS md, round(avg(mn), 6) AS mn FROM v_summary WHERE sensor = 'view' AND floor(t / 600) * 600 >= {V.T0 + 86_400} AND floor(t / 600) * 600 < {V.T0 + 4 * 86_400} GROUP BY ALL", "v_summary"))
def summary_window(spark, sf_dir):
    """Three days of one sensor at 1,000 columns: the ten-minute level answers."""
    t0, t1 = V.T0 + 86_400, V.T0 + 4 * 86_400
    bucket = WN.pick_summary_level(t1 - t0, 1000)
    rows = P.summary_level(V.summary(spark, sf_dir).filter(F.col("sensor") == "view"), bucket).filter((F.col("t") >= t0) & (F.col("t") < t1))
    return rows.select("sensor", "freq", "t", *[F.round(c, 6).alias(c) for c in ("mx", "md", "mn")]).orderBy("t", "freq")


HELD = """e AS (SELECT sensor, unnest(range(0, 40)) AS col FROM w), f AS (SELECT DISTINCT sensor, col FROM g), z AS (SELECT e.sensor, e.col, f.col IS NOT NULL AS filled,
 coalesce(last_value(f.col IGNORE NULLS) OVER (PARTITION BY e.sensor ORDER BY e.col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(f.col IGNORE NULLS) OVER (PARTITION BY e.sensor ORDER BY e.col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS src
 FROM e LEFT JOIN f ON f.sensor = e.sensor AND f.col = e.col)"""
ROWS = "p AS (SELECT sensor, col, CAST(pos // 7 AS INTEGER) AS r, max(v) AS q FROM (SELECT sensor, col, unnest(range(0, 64)) AS pos, unnest(spec) AS v FROM g) GROUP BY ALL)"
SCALED = "s AS (SELECT sensor, quantile_cont(-180 + x / 255.0::DOUBLE * 90 + 70, 0.02) AS vmin, quantile_cont(-180 + x / 255.0::DOUBLE * 90 + 70, 0.98) AS vmax FROM (SELECT sensor, unnest(spec) AS x FROM c) GROUP BY sensor)"


@query(sql(f"""WITH c AS ({CODES}), {WIN}, {GRID}, {HELD}, {ROWS}, {SCALED} SELECT z.sensor AS window_id, CAST(z.col AS INTEGER) AS col, p.r, p.q, z.filled, round(-180 + q / 255.0::DOUBLE * 90 + 70, 6) AS dbm,
CAST(floor(greatest(0, least(255, (round(-180 + q / 255.0::DOUBLE * 90 + 70, 6) - round(vmin, 6)) / greatest(round(vmax, 6) - round(vmin, 6), 1e-6) * 255)) + 1e-7) AS SMALLINT) AS idx FROM z JOIN p ON p.sensor = z.sensor AND p.col = z.src JOIN s ON s.sensor = z.sensor""", "v_psd"))
def psd_window(spark, sf_dir):
    """The flagship: a window of every sensor as a held, pooled, decoded and coloured grid."""
    c = codes(spark, sf_dir)
    grid = WN.spectrum_window(c, windows(spark, sf_dir), 40, 10, NARROW).withColumn("dbm", F.round("dbm", 6))
    values = c.select("sensor", F.explode("spec").alias("q")).select(F.col("sensor").alias("window_id"), decode(F.col("q"), NARROW.qmin, NARROW.qmax, 70.0).alias("x"))
    p = values.groupBy("window_id").agg(F.percentile("x", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    scale = p.select("window_id", F.round(F.col("p")[0], 6).alias("vmin"), F.round(F.col("p")[1], 6).alias("vmax"))
    idx = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("dbm") - F.col("vmin")) / F.greatest(F.col("vmax") - F.col("vmin"), F.lit(1e-6)) * 255)) + F.lit(1e-7))
    return grid.join(scale, "window_id").select("window_id", "col", "r", "q", "filled", "dbm", idx.cast("smallint").alias("idx"))


HALF = V.T0 + 24_000


def covered(spark, sf_dir):
    """Two windows of each sensor: one that the level below spans, one that it does not."""
    ends = F.explode(F.array(F.struct(F.lit("a").alias("k"), F.lit(V.T0 + 22_000).alias("t1")), F.struct(F.lit("b").alias("k"), F.lit(V.T0 + 41_000).alias("t1")))).alias("e")
    w = windows(spark, sf_dir).select("sensor", "t0", ends)
    return w.select(F.concat_ws("/", "sensor", "e.k").alias("window_id"), "sensor", "t0", F.col("e.t1").cast("double").alias("t1"))


@query(sql(f"""WITH c AS ({CODES}), w AS (SELECT sensor || '/' || k AS window_id, sensor, {V.T0 + 1000}::DOUBLE AS t0, t1::DOUBLE AS t1 FROM (SELECT unnest(['click','error','purchase','signup','view']) AS sensor), (VALUES ('a', {V.T0 + 22_000}), ('b', {V.T0 + 41_000})) AS e(k, t1)),
x AS (SELECT sensor, t, unnest(range(0, 64)) AS pos, unnest(spec) AS v FROM c), lv AS (SELECT sensor, floor(t / 3600) * 3600 AS t, pos, max(v) AS v FROM x WHERE t < {HALF} GROUP BY ALL), cov AS (SELECT sensor, min(t) AS a, max(t) + 3600 AS b FROM lv GROUP BY sensor),
n AS (SELECT window_id, count(*) AS n FROM c JOIN w USING (sensor) WHERE t >= t0 AND t < t1 GROUP BY window_id),
ch AS (SELECT w.*, coalesce(n, 0) > 40 AND coalesce(a <= t0 AND b >= t1, false) AS level FROM w LEFT JOIN n USING (window_id) LEFT JOIN cov USING (sensor)),
l AS (SELECT *, greatest(0, floor((t - t0) / ((t1 - t0) / 4))) AS lo, least(3, floor((t + 3600 - 1e-9 - t0) / ((t1 - t0) / 4))) AS hi FROM ch JOIN lv USING (sensor) WHERE level AND t + 3600 > t0 AND t < t1),
g AS (SELECT window_id, least(3, greatest(0, CAST(trunc((t - t0) / (t1 - t0) * 4) AS INTEGER))) AS col, pos, v FROM ch JOIN x USING (sensor) WHERE NOT level AND t >= t0 AND t < t1
 UNION ALL SELECT window_id, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) AS col, pos, v FROM l),
m AS (SELECT window_id, col, CAST(pos // 7 AS INTEGER) AS r, max(v) AS q FROM g GROUP BY ALL), f AS (SELECT DISTINCT window_id, col FROM g), e AS (SELECT window_id, unnest(range(0, 4)) AS col FROM w),
z AS (SELECT e.window_id, e.col, f.col IS NOT NULL AS filled, coalesce(last_value(f.col IGNORE NULLS) OVER (PARTITION BY e.window_id ORDER BY e.col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(f.col IGNORE NULLS) OVER (PARTITION BY e.window_id ORDER BY e.col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS src FROM e LEFT JOIN f ON f.window_id = e.window_id AND f.col = e.col)
SELECT z.window_id, CAST(z.col AS INTEGER) AS col, m.r, m.q, filled FROM z JOIN m ON m.window_id = z.window_id AND m.col = z.src""", "v_psd"))
def psd_window_levels(spark, sf_dir):
    """A stored level that stops half way answers the windows that it spans, the captures the others."""
    c = codes(spark, sf_dir)
    level = P.psd_level(c.filter(F.col("t") < HALF), 3600, by=("sensor",))
    return WN.spectrum_window(c, covered(spark, sf_dir), 4, 10, NARROW, levels={3600: level}).select("window_id", "col", "r", "q", "filled")


@query(f"SELECT p.window_id, p.col, p.r, p.q, p.filled, coalesce(m.dbm, round(-110 + p.q / 255.0::DOUBLE * 90, 5)) AS dbm FROM ({ORACLES['psd_window']}) p LEFT JOIN ({ORACLES['match_remap']}) m ON m.sensor = p.window_id AND m.q = p.q")
def psd_window_matched(spark, sf_dir):
    """The window in the colours of the summaries: codes shown at the quantiles that match."""
    shown = WN.code_table(match(spark, sf_dir), NARROW)
    grid = WN.spectrum_window(codes(spark, sf_dir), windows(spark, sf_dir), 40, 10, NARROW, shown=shown)
    return grid.select("window_id", "col", "r", "q", "filled", F.round("dbm", 5).alias("dbm"))


@query("SELECT event_id AS id, CAST(greatest(1, least(4096, 2 * (event_id * 7 % 4000))) AS INTEGER) AS cols FROM events")
def grid_size(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), WN.grid_columns(F.col("event_id") * 7 % 4000).alias("cols"))


def _asked(level: int, k: int) -> str:
    first, span = ((86_400, 7_200), (86_400, 3 * 86_400), (0, 30 * 86_400))[k]
    head = f"SELECT sensor || '/{k}' AS window_id, {level} AS level, freq"
    tail = f"FROM v_summary GROUP BY sensor, freq, floor(t / {level}) HAVING floor(t / {level}) * {level} >= {V.T0 + first} AND floor(t / {level}) * {level} < {V.T0 + first + span}"
    if not level:
        return f"{head}, round(t, 6) AS t, round(mx, 6) AS mx, round(md, 6) AS md, round(mn, 6) AS mn FROM v_summary WHERE t >= {V.T0 + first} AND t < {V.T0 + first + span}"
    return f"{head}, floor(t / {level}) * {level} AS t, round(max(mx), 6) AS mx, round(avg(md), 6) AS md, round(avg(mn), 6) AS mn {tail}"


@query(sql(f"WITH {', '.join(f'q{k} AS ({_asked(b, k)})' for k, b in enumerate((0, 600, 21_600)))} SELECT * FROM q0 UNION ALL SELECT * FROM q1 UNION ALL SELECT * FROM q2", "v_summary"))
def summary_window_raw(spark, sf_dir):
    """Three windows of each sensor in one job: raw rows, ten minutes and six hours answer, as span and width call for."""
    raw = V.summary(spark, sf_dir)
    levels = {b: P.summary_level(raw, b) for b in (0, *P.BUCKETS)}
    rows = [(0, V.T0 + 86_400, V.T0 + 86_400 + 7_200, 1000), (1, V.T0 + 86_400, V.T0 + 4 * 86_400, 1000), (2, V.T0, V.T0 + 30 * 86_400, 150)]
    asked = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("k", "t0", "t1", "width"), r, strict=True)]) for r in rows])).alias("a")
    w = windows(spark, sf_dir).select("sensor", asked).select(F.concat_ws("/", "sensor", F.col("a.k").cast("string")).alias("window_id"), "sensor", "a.t0", "a.t1", "a.width")
    found = WN.summary_window(levels, w)
    return found.select("window_id", "level", "freq", *[F.round(c, 6).alias(c) for c in ("t", "mx", "md", "mn")])


BATCH = f"w AS (SELECT sensor || '/' || k AS window_id, sensor, {V.T0}::DOUBLE + k * 1800 AS t0, {V.T0}::DOUBLE + k * 1800 + 4500 AS t1 FROM (SELECT unnest(['click','error','purchase','signup','view']) AS sensor), (SELECT unnest(range(0, 24)) AS k))"


def batch(spark, sf_dir):
    w = spark.range(24).select(F.col("id").alias("k"), F.explode(F.array(*map(F.lit, V.SENSORS))).alias("sensor"))
    t0 = F.lit(V.T0) + F.col("k") * 1800
    return w.select(F.concat_ws("/", "sensor", F.col("k").cast("string")).alias("window_id"), "sensor", t0.alias("t0"), (t0 + 4500).alias("t1"))


@query(sql(f"""WITH c AS ({CODES}), {BATCH}, g AS (SELECT window_id, least(19, greatest(0, CAST(trunc((t - t0) / (t1 - t0) * 20) AS INTEGER))) AS col, spec FROM c JOIN w USING (sensor) WHERE t >= t0 AND t < t1),
e0 AS (SELECT * FROM w WHERE window_id NOT IN (SELECT window_id FROM g)), a AS (SELECT window_id, sensor, coalesce(max(t) FILTER (WHERE t < t1), min(t)) AS t FROM e0 JOIN c USING (sensor) GROUP BY ALL),
g2 AS (SELECT * FROM g UNION ALL SELECT window_id, 0, spec FROM a JOIN c USING (sensor, t)),
m AS (SELECT window_id, col, pos // 16 AS r, max(v) AS v FROM (SELECT window_id, col, unnest(range(0, 64)) AS pos, unnest(spec) AS v FROM g2) GROUP BY ALL), f AS (SELECT DISTINCT window_id, col FROM g2), e AS (SELECT window_id, unnest(range(0, 20)) AS col FROM (SELECT DISTINCT window_id FROM g2)),
z AS (SELECT e.window_id, e.col, coalesce(last_value(f.col IGNORE NULLS) OVER (PARTITION BY e.window_id ORDER BY e.col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(f.col IGNORE NULLS) OVER (PARTITION BY e.window_id ORDER BY e.col ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS src FROM e LEFT JOIN f ON f.window_id = e.window_id AND f.col = e.col)
SELECT z.window_id, CAST(z.col AS INTEGER) AS col, CAST(m.r AS INTEGER) AS r, m.v AS q FROM z JOIN m ON m.window_id = z.window_id AND m.col = z.src""", "v_psd"))
def tile_batch(spark, sf_dir):
    """Many windows in one job; an empty one shows the capture before it."""
    c = codes(spark, sf_dir)
    return WN.spectrum_window(c, batch(spark, sf_dir), 20, 4, NARROW).select("window_id", "col", "r", "q")


#: The grid's captures; a window without any takes the last one before its end, else the first.
AS_OF = f"""{GRID.replace("g AS (", "g0 AS (", 1)}, a AS (SELECT sensor, coalesce(max(t) FILTER (WHERE t < t1), min(t)) AS t FROM c JOIN w USING (sensor) WHERE sensor NOT IN (SELECT sensor FROM g0) GROUP BY sensor),
g AS (SELECT * FROM g0 UNION ALL SELECT sensor, 0, t, spec FROM a JOIN c USING (sensor, t))"""
FRAME = "[CAST(greatest(0, least(255, round_even((x + 130) / 120.0 * 255.0, 0))) AS SMALLINT) FOR x IN frame_db]"


@query(sql(f"""WITH c AS (SELECT sensor, freq, t, {FRAME} AS spec FROM v_pfp WHERE freq = 3565e6), {WIN}, {AS_OF}, {ROWS}, {HELD},
d AS (SELECT z.sensor, z.col, p.r, -130 + q / 255.0::DOUBLE * 120 AS dbm FROM z JOIN p ON p.sensor = z.sensor AND p.col = z.src)
SELECT sensor AS window_id, count(*) AS cells, round(quantile_cont(dbm, 0.02) FILTER (WHERE (col * 10 + r) % 8 = 0), 6) AS vmin, round(quantile_cont(dbm, 0.98) FILTER (WHERE (col * 10 + r) % 8 = 0), 6) AS vmax, round(sum(dbm), 3) AS total FROM d GROUP BY sensor""", "v_pfp"))
def pfp_window(spark, sf_dir):
    """Frames of the channel next to 3,563 MHz, and their colour scale from every eighth cell."""
    frames = V.pfp(spark, sf_dir)
    want = windows(spark, sf_dir).withColumn("want", F.lit(3563e6))
    w = WN.snap_channel(want, frames.select("sensor", "freq"), 1e7).filter("freq is not null").drop("want")
    c = frames.select("sensor", "freq", "t", quantize(F.col("frame_db"), FRAMES.qmin, FRAMES.qmax).alias("spec"))
    g = WN.spectrum_window(c, w, 40, 10, FRAMES, ("sensor", "freq"), offset=0.0)
    eighth = F.when((F.col("col") * 10 + F.col("r")) % 8 == 0, F.col("dbm"))
    p = g.groupBy("window_id").agg(F.count("*").alias("cells"), F.percentile(eighth, F.array(F.lit(0.02), F.lit(0.98))).alias("p"), F.round(F.sum("dbm"), 3).alias("total"))
    return p.select("window_id", "cells", F.round(F.col("p")[0], 6).alias("vmin"), F.round(F.col("p")[1], 6).alias("vmax"), "total")


@query(sql("""WITH a AS (SELECT 'psd' AS layer, sensor, min(t) AS t_min, max(t) AS t_max, 'max,median,mean' AS stats FROM v_psd_stat GROUP BY sensor UNION ALL SELECT 'pfp', sensor, min(t), max(t), 'max_peak' FROM v_pfp GROUP BY sensor UNION ALL SELECT 'summary', sensor, min(t), max(t), 'max,median,mean' FROM v_summary GROUP BY sensor),
f AS (SELECT sensor, min(freq) AS fmin, max(freq) AS fmax FROM v_pfp GROUP BY sensor) SELECT layer, sensor, round(t_min, 6) AS t_min, round(t_max, 6) AS t_max, stats, CASE WHEN layer = 'pfp' THEN fmin END AS fmin, CASE WHEN layer = 'pfp' THEN fmax END AS fmax FROM a LEFT JOIN f USING (sensor)""", "v_psd", "v_psd_stat", "v_pfp", "v_summary"))
def layer_catalogue(spark, sf_dir):
    span = [F.min("t").alias("t_min"), F.max("t").alias("t_max")]
    none = [F.lit(None).cast("double").alias("fmin"), F.lit(None).cast("double").alias("fmax")]
    psd = V.psd_stat(spark, sf_dir).groupBy("sensor").agg(*span).select(F.lit("psd").alias("layer"), "*", F.lit("max,median,mean").alias("stats"), *none)
    pfp = V.pfp(spark, sf_dir).groupBy("sensor").agg(*span, F.min("freq").alias("fmin"), F.max("freq").alias("fmax")).select(F.lit("pfp").alias("layer"), "sensor", "t_min", "t_max", F.lit("max_peak").alias("stats"), "fmin", "fmax")
    summary = V.summary(spark, sf_dir).groupBy("sensor").agg(*span).select(F.lit("summary").alias("layer"), "*", F.lit("max,median,mean").alias("stats"), *none)
    every = psd.unionByName(pfp).unionByName(summary)
    return every.withColumn("t_min", F.round("t_min", 6)).withColumn("t_max", F.round("t_max", 6))


