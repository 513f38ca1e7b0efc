"""Queries: complex captures, and reconciliation of a damaged store."""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.sql import functions as F

from ..functions.quant import NARROW, quantize
from ..operators import iq as IQ
from ..operators import pyramid as P
from ..operators import recon as R
from ..operators.pyramid import runs
from ..sources import views as V
from ..sources.places import shared_place
from ..sources.ranges import share, write_pieces
from ..sources.views import sql
from .pyramids import Q, codes
from .registry import ORACLES, query

NFFT = 16
FRAMES = f"f AS (SELECT id, CAST(floor(sample / {NFFT}) AS BIGINT) AS frame, sample % {NFFT} AS n, i, q FROM v_iq), ok AS (SELECT id, frame FROM f GROUP BY ALL HAVING count(*) = {NFFT})"
DFT = f"""{FRAMES}, w AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / {NFFT - 1}) AS w FROM (SELECT unnest(range(0, {NFFT})) AS n)), ws AS (SELECT sum(w * w) * {NFFT} AS s FROM w), k AS (SELECT unnest(range(0, {NFFT})) AS k),
x AS (SELECT f.id, f.frame, k, sum(w * (i * cos(2 * pi() * k * f.n / {NFFT}) + q * sin(2 * pi() * k * f.n / {NFFT}))) AS re, sum(w * (q * cos(2 * pi() * k * f.n / {NFFT}) - i * sin(2 * pi() * k * f.n / {NFFT}))) AS im
  FROM f JOIN ok USING (id, frame) JOIN w ON w.n = f.n CROSS JOIN k GROUP BY ALL),
d AS (SELECT id, frame, CAST((k + {NFFT // 2}) % {NFFT} AS INTEGER) AS bin, 10 * log10(greatest((re * re + im * im) / s / 50 * 1000, 1e-30)) AS dbm FROM x, ws)"""


def spectra(spark, sf_dir):
    return IQ.spectra(V.iq(spark, sf_dir), NFFT, V.iq_tasks(spark, sf_dir))


def stored(rows, name):
    """Written once where several steps read it."""
    place = shared_place(rows.sparkSession, name)
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def ranged_spectra(spark, sf_dir):
    """Spectra, stored, the captures' ranges, and the tasks for so many frames."""
    s = stored(spectra(spark, sf_dir), "spectra")
    tasks = share(s.count(), IQ.SHARE)
    return s, IQ.quantization_range(s, tasks), tasks


@query(sql(f"WITH {FRAMES} SELECT id, frame, CAST(n AS INTEGER) AS n, i, q FROM f JOIN ok USING (id, frame)", "v_iq"))
def iq_frames(spark, sf_dir):
    both = F.arrays_zip("i", "q")
    return IQ.frames(V.iq(spark, sf_dir), NFFT, V.iq_tasks(spark, sf_dir)).select("id", "frame", F.posexplode(both).alias("n", "z")).select("id", "frame", "n", "z.i", "z.q")


@query(sql(f"WITH {DFT} SELECT id, frame, bin, round(dbm, 2) AS dbm FROM d", "v_iq"))
def stft(spark, sf_dir):
    return spectra(spark, sf_dir).select("id", "frame", F.posexplode("dbm").alias("bin", "dbm")).withColumn("dbm", F.round("dbm", 2))


RANGE = f"""{DFT}, st AS (SELECT id, greatest(1, (max(frame) + 1) // 64) AS step FROM d GROUP BY id),
tm AS (SELECT id, dbm, CAST(frame // step - CAST(ceil(greatest(0, frame - 31) / step::DOUBLE) AS BIGINT) + 1 AS BIGINT) AS times FROM d JOIN st USING (id)),
rp AS (SELECT id, dbm FROM (SELECT id, dbm, unnest(range(0, times)) AS k FROM tm WHERE times > 0)),
qr AS (SELECT id, quantile_cont(dbm, 0.001) - 6 AS qmin, quantile_cont(dbm, 0.999) + 6 AS qmax FROM rp GROUP BY id)"""


@query(sql(f"WITH {RANGE} SELECT id, round(qmin, 4) AS qmin, round(qmax, 4) AS qmax FROM qr", "v_iq"))
def iq_qrange(spark, sf_dir):
    return ranged_spectra(spark, sf_dir)[1].select("id", F.round("qmin", 4).alias("qmin"), F.round("qmax", 4).alias("qmax"))


#: Columns of the coarsest level of the captures in the tables.
COARSEST = 8
#: Codes, and by level the maxima of 2 ** level columns, while a capture has more than COARSEST. Both
#: sides see decibels to a tenth, so that a last bit in a transform cannot move a code.
LEVELS = f"""{RANGE}, c0 AS (SELECT id, frame AS col, bin, CAST(greatest(0, least(255, round_even((round(dbm, 1) - round(qmin, 1)) / (round(qmax, 1) - round(qmin, 1)) * 255, 0))) AS SMALLINT) AS q FROM d JOIN qr USING (id)),
nc AS (SELECT id, max(col) + 1 AS n FROM c0 GROUP BY id), lk AS (SELECT id, n, k FROM nc, (SELECT unnest(range(0, 30)) AS k) WHERE k = 0 OR n // CAST(2 ** (k - 1) AS BIGINT) > {COARSEST}),
lv AS (SELECT CAST(k AS INTEGER) AS level, id, col // CAST(2 ** k AS BIGINT) AS col, bin, max(q) AS q FROM c0 JOIN lk USING (id) WHERE col // CAST(2 ** k AS BIGINT) < n // CAST(2 ** k AS BIGINT) GROUP BY ALL),
sc AS (SELECT id, round(a, 1) AS vmin, round(CASE WHEN b - a < 6 THEN a + 6 ELSE b END, 1) AS vmax FROM (SELECT id, quantile_cont(x, 0.02) AS a, quantile_cont(x, 0.98) AS b FROM
 (SELECT lv.id, round(qmin, 1) + q / 255.0::DOUBLE * (round(qmax, 1) - round(qmin, 1)) AS x FROM lv JOIN (SELECT id, max(level) AS level FROM lv GROUP BY id) USING (id, level) JOIN qr USING (id)) GROUP BY id))"""


def iq_tenths(spark, sf_dir):
    """Spectra and ranges of decibels to a tenth, and the tasks for them."""
    s, ranges, tasks = ranged_spectra(spark, sf_dir)
    ranges = stored(ranges.select("id", F.round("qmin", 1).alias("qmin"), F.round("qmax", 1).alias("qmax")), "ranges")
    return s.withColumn("dbm", F.transform("dbm", lambda x: F.round(x, 1))), ranges, tasks


def iq_levels(spark, sf_dir):
    """Pyramid, stored, ranges, and the tasks for them."""
    s, ranges, tasks = iq_tenths(spark, sf_dir)
    return stored(IQ.levels(s, ranges, COARSEST, tasks), "levels"), ranges, tasks


@query(sql(f"WITH {LEVELS} SELECT id, col, bin, q FROM lv WHERE level = 0", "v_iq"))
def iq_columns(spark, sf_dir):
    s, ranges, _ = iq_tenths(spark, sf_dir)
    return IQ.columns(s, ranges).select("id", "col", F.posexplode("bins").alias("bin", "q"))


@query(sql(f"WITH {LEVELS} SELECT level, id, col, count(*) AS n, CAST(sum(q) AS BIGINT) AS total FROM lv GROUP BY ALL", "v_iq"))
def iq_pyramid(spark, sf_dir):
    """Each capture's levels, as many as it needs by itself; an odd last column goes."""
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")
    s, ranges, tasks = iq_tenths(spark, sf_dir)
    return IQ.levels(s, ranges, COARSEST, tasks).select("level", "id", "col", F.size("bins").cast("long").alias("n"), total)


@query(sql(f"WITH {LEVELS} SELECT * FROM sc", "v_iq"))
def iq_display_scale(spark, sf_dir):
    """From each capture's coarsest level, made of all its columns; no other level is built."""
    s, ranges, tasks = iq_tenths(spark, sf_dir)
    return IQ.display_scale(stored(IQ.last_levels(s, ranges, COARSEST, tasks), "coarsest"), ranges, tasks=tasks)


META = "m AS (SELECT id, 1e6 * (1 + id % 3) AS fc, 1600.0::DOUBLE * (1 + id % 2) AS fs, count(*) AS samples FROM v_iq GROUP BY id)"


def iq_captures(spark, sf_dir):
    fc, fs = 1e6 * (1 + F.col("id") % 3), F.lit(1600.0) * (1 + F.col("id") % 2)
    name = F.concat(F.lit("cap"), F.col("id").cast("string"))
    rows = V.iq(spark, sf_dir).groupBy("id").agg(F.count("*").alias("samples"))
    return rows.select("id", F.lit("lineitem").alias("dataset"), name.alias("name"), F.concat(F.lit("/d/"), name).alias("path"), fc.alias("center"), fs.alias("sample_rate"), "samples")


def iq_metadata(spark, sf_dir):
    pyramid, ranges, tasks = iq_levels(spark, sf_dir)
    return pyramid, IQ.metadata(iq_captures(spark, sf_dir), pyramid, ranges, IQ.display_scale(pyramid, ranges, tasks=tasks), NFFT)


VIEWS = f"""{LEVELS}, {META}, mm AS (SELECT m.*, samples / fs AS duration, fc - fs / 2 AS low, fs / {NFFT} AS df, n_levels FROM m JOIN (SELECT id, max(level) + 1 AS n_levels FROM lv GROUP BY id) USING (id)),
rq AS (SELECT *, (least(duration, t1) - greatest(0, t0)) * fs / {NFFT} AS span FROM (SELECT mm.*, k, CASE WHEN k = 0 THEN -1.0::DOUBLE WHEN k = 1 THEN duration / 3 ELSE duration + 1 END AS t0, CASE WHEN k = 0 THEN duration + 1 WHEN k = 1 THEN duration / 2 ELSE duration + 2 END AS t1,
 CASE WHEN k = 0 THEN low - 5 ELSE fc - 2.5 * df END AS f0, CASE WHEN k = 0 THEN fc + fs ELSE fc + 4.25 * df END AS f1, CASE WHEN k = 0 THEN 3 ELSE 40 END AS w, CASE WHEN k = 0 THEN 5 ELSE 100 END AS h FROM mm, (SELECT unnest(range(0, 3)) AS k))),
cl AS (SELECT id, k, greatest(0, t0) AS t0, least(duration, t1) AS t1, greatest(low, f0) AS f0, least(low + fs, f1) AS f1, fs, low, df, h, coalesce((SELECT min(x) FROM unnest(range(0, 30)) AS u(x) WHERE x < n_levels AND span / 2.0 ** x <= 2 * w), n_levels - 1) AS level FROM rq),
bn AS (SELECT *, floor(t0 / ({NFFT} * 2.0 ** level / fs)) AS c0, ceil(t1 / ({NFFT} * 2.0 ** level / fs)) AS c1, CAST(floor((f0 - low) / df) AS INTEGER) AS b0, CAST(least({NFFT}, ceil((f1 - low) / df)) AS INTEGER) AS b1 FROM cl WHERE t1 > t0 AND f1 > f0),
gr AS (SELECT *, greatest(c0 + 1, c1) AS ce, greatest(b0 + 1, b1) AS be, greatest(1, CAST(ceil((greatest(b0 + 1, b1) - b0) / h::DOUBLE) AS INTEGER)) AS grp FROM bn)"""


@query(sql(f"WITH {VIEWS} SELECT lv.id || '/' || k AS window_id, CAST(lv.level AS INTEGER) AS level, col, CAST((bin - b0) // grp AS INTEGER) AS r, max(q) AS q FROM lv JOIN gr ON lv.id = gr.id AND lv.level = gr.level WHERE col >= c0 AND col < ce AND bin >= b0 AND bin < be GROUP BY ALL", "v_iq"))
def iq_window(spark, sf_dir):
    """Three requests to each capture: all of it at few pixels, a part, and one beyond its end."""
    pyramid, meta = iq_metadata(spark, sf_dir)
    k, d, df = F.col("k"), F.col("duration"), F.col("fs") / NFFT
    asked = meta.select("id", "fc", "fs", "duration", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    asked = asked.select(
        F.concat_ws("/", F.col("id").cast("string"), k.cast("string")).alias("window_id"), "id",
        F.when(k == 0, -1.0).when(k == 1, d / 3).otherwise(d + 1).alias("t0"), F.when(k == 0, d + 1).when(k == 1, d / 2).otherwise(d + 2).alias("t1"),
        F.when(k == 0, F.col("fc") - F.col("fs") / 2 - 5).otherwise(F.col("fc") - 2.5 * df).alias("f0"), F.when(k == 0, F.col("fc") + F.col("fs")).otherwise(F.col("fc") + 4.25 * df).alias("f1"),
        F.when(k == 0, 3).otherwise(40).alias("w"), F.when(k == 0, 5).otherwise(100).alias("h"),
    )
    return IQ.window(pyramid, meta, asked, NFFT).select("window_id", "level", "col", "r", "q")


@query(sql(f"SELECT id, CAST(count(*) // {NFFT} AS BIGINT) AS frames, count(*) % {NFFT} AS dropped, count(*) >= {NFFT} AS usable FROM v_iq GROUP BY id", "v_iq"))
def iq_min_length(spark, sf_dir):
    s = V.iq(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))
    return s.select("id", F.floor(F.col("n") / NFFT).cast("long").alias("frames"), (F.col("n") % NFFT).alias("dropped"), (F.col("n") >= NFFT).alias("usable"))


@query("SELECT DISTINCT event_type AS dataset, user_id AS id FROM events WHERE NOT (event_type = 'view' AND user_id % 3 = 0)")
def iq_resume(spark, sf_dir):
    """Captures still to ingest; a capture is known by dataset and name, so equal names do not collide."""
    every = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("id")).distinct()
    return every.join(every.filter("dataset = 'view' and id % 3 = 0"), ["dataset", "id"], "left_anti")


@query(sql(f"""WITH {LEVELS}, {META} SELECT m.id, 'lineitem' AS dataset, 'cap' || m.id AS name, '/d/cap' || m.id AS path, fc, fs, samples / fs AS duration, samples AS n_samples, {NFFT} AS nfft, {NFFT} AS hop, {NFFT} AS n_bins,
CAST(n_levels AS INTEGER) AS n_levels, round(qmin, 1) AS qmin, round(qmax, 1) AS qmax, vmin, vmax FROM m JOIN (SELECT id, max(level) + 1 AS n_levels FROM lv GROUP BY id) USING (id) JOIN qr USING (id) JOIN sc USING (id)""", "v_iq"))
def iq_meta(spark, sf_dir):
    return iq_metadata(spark, sf_dir)[1]


def written_captures(spark, sf_dir):
    """The captures as files: SigMF in either byte order, and arrays."""
    place = shared_place(spark, "captures")
    tasks = V.iq_tasks(spark, sf_dir)
    rows = V.iq(spark, sf_dir)
    total = rows.groupBy("id").agg(F.count("*").alias("n"))
    part = F.floor(F.col("sample") / 65_536)
    dealt = rows.withColumn("part", part).join(total, "id").repartition(tasks, "id", "part").sortWithinPartitions("id", "sample")

    def pieces(batch):
        """Each stretch of a capture's samples at its place; with the first comes what describes them."""
        edges = runs(batch, ["id", "part"])
        ids, samples, counts = (batch.column(c).to_numpy() for c in ("id", "sample", "n"))
        z = batch.column("i").to_numpy() + 1j * batch.column("q").to_numpy()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            id_, n = int(ids[a]), int(counts[a])
            head = io.BytesIO()
            if id_ % 3 == 2:
                np.lib.format.write_array_header_1_0(head, {"descr": "<c16", "fortran_order": False, "shape": (n,)})
            name, start = f"{place}/s{id_ % 5}/cap{id_}", head.tell()
            path = name + (IQ.ARRAY if id_ % 3 == 2 else IQ.SIGMF_DATA)
            yield path, start + 16 * int(samples[a]), z[a:b].astype(">c16" if id_ % 3 == 1 else "<c16").tobytes()
            if samples[a] == 0 and start:
                yield path, 0, head.getvalue()
            elif samples[a] == 0:
                text = {"global": {"core:datatype": "cf64_be" if id_ % 3 else "cf64_le", "core:sample_rate": 1600.0 * (1 + id_ % 2)}, "captures": [{"core:frequency": 1e6 * (1 + id_ % 3)}]}
                yield name + IQ.SIGMF_META, 0, json.dumps(text).encode()

    write_pieces(dealt, pieces)
    return place


@query(sql(f"""WITH {RANGE}, n AS (SELECT id, count(*) AS n_samples FROM v_iq GROUP BY id), nc AS (SELECT id, max(frame) + 1 AS n FROM d GROUP BY id),
lk AS (SELECT id, n, k FROM nc, (SELECT unnest(range(0, 30)) AS k) WHERE k = 0 OR n // CAST(2 ** (k - 1) AS BIGINT) > {COARSEST}), lv AS (SELECT id, CAST(max(k) + 1 AS INTEGER) AS n_levels, CAST(sum(n // CAST(2 ** k AS BIGINT)) AS BIGINT) AS columns FROM lk GROUP BY id)
SELECT 'cap' || id AS name, n_samples, CASE WHEN id % 3 = 2 THEN 0 ELSE 1e6 * (1 + id % 3) END AS fc, n_samples / (CASE WHEN id % 3 = 2 THEN 1600.0::DOUBLE ELSE 1600.0::DOUBLE * (1 + id % 2) END) AS duration, n_levels, round(qmin, 4) AS qmin, round(qmax, 4) AS qmax, columns FROM n JOIN qr USING (id) JOIN lv USING (id)""", "v_iq"))
def iq_ingest(spark, sf_dir):
    """From files of three kinds to stored pyramids, twice: the second run adds nothing."""
    place, target = written_captures(spark, sf_dir), shared_place(spark, "ingested")
    for _ in range(2):
        IQ.ingest(spark, place, target, "lineitem", NFFT, array_rate=1600.0, coarsest=COARSEST, size=1 << 16)
    columns = IQ.stored_levels(spark, target).groupBy("id").agg(F.count("*").alias("columns"))
    meta = IQ.stored_metadata(spark, target).join(columns, "id")
    return meta.select("name", "n_samples", "fc", "duration", "n_levels", F.round("qmin", 4).alias("qmin"), F.round("qmax", 4).alias("qmax"), "columns")


# --- reconciliation: a store with damage that the checks must find ------------------------------

SRC = "src AS (SELECT sensor, stat, t, CAST(round((t - 1704067200) / 90) AS BIGINT) AS vec, spec_db AS vals FROM v_psd_stat)"
CELL = f"WITH {SRC}, s2 AS (SELECT sensor, stat, t, vec, unnest(range(0, 64)) AS pos, unnest(vals) AS v FROM src WHERE vec % 59 <> 1), c AS (SELECT sensor, stat, t, vec, pos, v, CAST(greatest(0, least(255, round_even((v + 180) / 90.0 * 255.0, 0))) AS SMALLINT) AS q0 FROM s2), b AS (SELECT *, CASE WHEN vec % 53 = 0 AND pos = 5 THEN CAST(least(255, q0 + 2) AS SMALLINT) ELSE q0 END AS q FROM c)"
STEP = "(90.0::DOUBLE / 255)"


def source(spark, sf_dir):
    return V.psd_stat(spark, sf_dir).withColumnRenamed("spec_db", "values")


def damaged(spark, sf_dir):
    """The store: every 53rd capture has a wrong cell, every 59th is missing."""
    vec = F.round((F.col("t") - V.T0) / 90).cast("long")
    good = quantize(F.col("values"), NARROW.qmin, NARROW.qmax)
    rows = source(spark, sf_dir).filter(vec % 59 != 1).withColumn("g", good)
    spoiled = F.transform("g", lambda q, i: F.when((vec % 53 == 0) & (i == 5), F.least(F.lit(255), q + 2).cast("smallint")).otherwise(q))
    return rows.select("sensor", "stat", "t", spoiled.alias("spec"))


def both(spark, sf_dir):
    return R.cells(source(spark, sf_dir), damaged(spark, sf_dir))


@query(sql(f"{CELL} SELECT sensor, stat, count(*) FILTER (WHERE v BETWEEN -180 AND -90) AS n_checked, count(*) FILTER (WHERE v BETWEEN -180 AND -90 AND abs(-180 + q / 255.0::DOUBLE * 90 - v) > {STEP} / 2 + 1e-9) AS n_bad FROM b GROUP BY ALL", "v_psd_stat"))
def recon_values(spark, sf_dir):
    return R.values(both(spark, sf_dir), NARROW)


@query(sql(f"{CELL} SELECT sensor, stat, count(*) FILTER (WHERE v < -180 OR v > -90) AS n_checked, count(*) FILTER (WHERE (v < -180 AND q <> 0) OR (v > -90 AND q <> 255)) AS n_bad FROM b GROUP BY ALL", "v_psd_stat"))
def recon_clip(spark, sf_dir):
    return R.clipped(both(spark, sf_dir), NARROW)


@query(sql(f"{CELL} SELECT sensor, stat, round(avg(-180 + q / 255.0::DOUBLE * 90 - v) FILTER (WHERE v BETWEEN -180 AND -90), 6) AS bias, abs(avg(-180 + q / 255.0::DOUBLE * 90 - v) FILTER (WHERE v BETWEEN -180 AND -90)) < {STEP} / 4 AS ok FROM b GROUP BY ALL", "v_psd_stat"))
def recon_bias(spark, sf_dir):
    return R.bias(both(spark, sf_dir), NARROW).withColumn("bias", F.round("bias", 6))


@query(sql(f"{CELL} SELECT sensor, stat, count(*) AS n_checked, count(*) FILTER (WHERE q <> q0) AS n_bad FROM b GROUP BY ALL", "v_psd_stat"))
def recon_bytes(spark, sf_dir):
    return R.bytes_equal(both(spark, sf_dir), NARROW)


@query(sql("SELECT sensor, stat, count(*) AS n_checked, count(*) FILTER (WHERE q % 2 <> 0) AS n_bad FROM (SELECT sensor, stat, v, CAST(round_even((v + 180) / 90.0 * 255.0, 0) AS INTEGER) AS q FROM (SELECT sensor, stat, -180 + 3 * (1 + 2 * (CAST(floor(t / 90) AS BIGINT) % 14)) AS v FROM v_psd_stat)) GROUP BY ALL", "v_psd_stat"))
def recon_ties(spark, sf_dir):
    """Values of -180 + 3k, k odd, lie halfway between codes; all must be even."""
    v = (F.lit(-180) + 3 * (1 + 2 * (F.floor(F.col("t") / 90) % 14))).cast("double")
    rows = V.psd_stat(spark, sf_dir).select("sensor", "stat", "t", F.array(v).alias("values"))
    stored = rows.select("sensor", "stat", "t", quantize(F.col("values"), NARROW.qmin, NARROW.qmax).alias("spec"))
    return R.ties(R.cells(rows, stored), NARROW)


@query(sql(f"{CELL} SELECT sensor, stat, count(*) AS n_checked, count(*) FILTER (WHERE abs((CAST(v AS DECIMAL(18,9)) + 180) * 255 / 90 - q) > 0.500001) AS n_bad FROM b WHERE v BETWEEN -180 AND -90 AND (CAST(floor(t) AS BIGINT) * 31 + pos * 17) % 7 = 0 GROUP BY ALL", "v_psd_stat"))
def recon_exact(spark, sf_dir):
    """Decimal arithmetic on a fixed seventh of the cells: the sample is the feature."""
    return R.exact(both(spark, sf_dir), NARROW)


@query(sql(f"{CELL} SELECT a.stat AS source_stat, b.stat AS stored_stat, round(max(abs(-180 + b.q / 255.0::DOUBLE * 90 - a.v)), 6) AS gap, CASE WHEN a.stat = b.stat THEN max(abs(-180 + b.q / 255.0::DOUBLE * 90 - a.v)) <= {STEP} / 2 + 1e-9 ELSE max(abs(-180 + b.q / 255.0::DOUBLE * 90 - a.v)) > 1 END AS ok FROM b a JOIN b ON a.sensor = b.sensor AND a.t = b.t AND a.pos = b.pos WHERE a.v BETWEEN -180 AND -90 GROUP BY a.stat, b.stat", "v_psd_stat"))
def recon_routing(spark, sf_dir):
    return R.routing(source(spark, sf_dir), damaged(spark, sf_dir), NARROW).withColumn("gap", F.round("gap", 6))


@query(sql(f"""WITH {SRC} SELECT sensor, stat, count(*) AS source_n, count(*) FILTER (WHERE vec % 59 <> 1) AS stored_n, count(*) FILTER (WHERE vec % 59 = 1) AS missing, 0::BIGINT AS extra, 0::BIGINT AS twice FROM src GROUP BY ALL
UNION ALL SELECT sensor, 'std', 0, count(*), 0, count(*), 0 FROM src WHERE stat = 'max' AND sensor = 'view' AND vec % 59 <> 1 GROUP BY sensor""", "v_psd_stat"))
def recon_presence(spark, sf_dir):
    """A store that lacks captures, and holds a statistic of one sensor that no source has."""
    store = damaged(spark, sf_dir)
    foreign = store.filter("stat = 'max' and sensor = 'view'").withColumn("stat", F.lit("std"))
    return R.presence(source(spark, sf_dir), store.unionByName(foreign))


@query(sql(f"""{CELL}, k AS (SELECT sensor, stat, count(*) FILTER (WHERE v BETWEEN -180 AND -90) AS a, count(*) FILTER (WHERE v BETWEEN -180 AND -90 AND abs(-180 + q / 255.0::DOUBLE * 90 - v) > {STEP} / 2 + 1e-9) AS a_bad, count(*) AS b, count(*) FILTER (WHERE q <> q0) AS b_bad,
 count(*) FILTER (WHERE v < -180 OR v > -90) AS c, count(*) FILTER (WHERE (v < -180 AND q <> 0) OR (v > -90 AND q <> 255)) AS c_bad FROM b GROUP BY ALL), p AS (SELECT sensor, stat, count(*) AS d, count(*) FILTER (WHERE vec % 59 = 1) AS d_bad FROM src GROUP BY ALL),
r AS (SELECT sensor, stat, 'values' AS "check", a AS n_checked, a_bad AS n_bad FROM k UNION ALL SELECT sensor, stat, 'codes', b, b_bad FROM k UNION ALL SELECT sensor, stat, 'clipped', c, c_bad FROM k UNION ALL SELECT sensor, stat, 'presence', d, d_bad FROM p)
SELECT *, n_bad = 0 AND (n_checked > 0 OR "check" = 'clipped') AS ok FROM r""", "v_psd_stat"))
def recon_report(spark, sf_dir):
    """Values, codes, clipping and presence in one table, over one join of the captures."""
    return R.report(source(spark, sf_dir), damaged(spark, sf_dir), NARROW)


@query(sql("SELECT sensor AS file, 64 AS n_checked, CASE WHEN sensor = 'view' THEN 1 ELSE 0 END AS n_bad FROM v_psd GROUP BY sensor", "v_psd"))
def recon_axis(spark, sf_dir):
    return R.axis(headers(spark, sf_dir), NARROW)


def headers(spark, sf_dir):
    """Headers made from the geometry; one has a bin 5 Hz off."""
    freqs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(NARROW.f0) + i * NARROW.df + F.when((F.col("sensor") == "view") & (i == 9), 5.0).otherwise(0.4))
    return V.psd(spark, sf_dir).select("sensor").distinct().select(F.col("sensor").alias("file"), freqs.alias("freqs"))


@query(sql("SELECT sensor, 6 AS n_checked, CASE WHEN sensor = 'click' THEN 1 ELSE 0 END AS n_bad FROM v_psd GROUP BY sensor", "v_psd"))
def recon_meta(spark, sf_dir):
    """Declared metadata; one sensor's count is wrong."""
    c = codes(spark, sf_dir)
    own = c.groupBy("sensor").agg(F.lit(64).alias("nf"), F.lit(-180.0).alias("qmin"), F.lit(-90.0).alias("qmax"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count("*").alias("captures"))
    return R.meta(own.withColumn("captures", F.col("captures") + F.when(F.col("sensor") == "click", 1).otherwise(0)), c, NARROW)


@query(sql(f"WITH c AS (SELECT sensor, t, {Q} AS spec FROM v_psd), l AS (SELECT sensor, CAST(floor(t / 3600) * 3600 AS BIGINT) AS t FROM c GROUP BY ALL) SELECT sensor, CASE WHEN (t // 3600) % 5 = 0 THEN 'missing' WHEN (t // 3600) % 7 = 0 THEN 'differs' ELSE 'ok' END AS state, count(*) AS n FROM l GROUP BY ALL", "v_psd"))
def recon_pyramid(spark, sf_dir):
    """A level with missing and spoiled rows against one rebuilt from the captures."""
    level = P.psd_level(codes(spark, sf_dir), 3600)
    hour = F.floor(F.col("t") / 3600)
    spoiled = F.when(hour % 7 == 0, F.transform("smax", lambda q, i: F.when(i == 0, q + 1).otherwise(q).cast("smallint"))).otherwise(F.col("smax"))
    return R.pyramid(level.filter(hour % 5 != 0).withColumn("smax", spoiled), level, ["stat", "sensor", "t"])


@query(sql("SELECT s.sensor, k.stat, coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS ok FROM (SELECT unnest(['click','error','purchase','signup','view']) AS sensor) s CROSS JOIN (SELECT unnest(['max','median','mean','std']) AS stat) k LEFT JOIN (SELECT sensor, stat, count(*) AS n FROM v_psd_stat GROUP BY ALL) c ON c.sensor = s.sensor AND c.stat = k.stat", "v_psd_stat"))
def recon_totals(spark, sf_dir):
    expected = spark.range(1).select(F.explode(F.array(*map(F.lit, V.SENSORS))).alias("sensor")).withColumn("stat", F.explode(F.array(*[F.lit(s) for s in V.STATS])))
    return R.totals(V.psd_stat(spark, sf_dir), expected)


ONE = 'SELECT {who}, {stat} AS stat, \'{name}\' AS "check", CAST({n} AS BIGINT) AS n_checked, CAST({bad} AS BIGINT) AS n_bad FROM ({body})'


def _parts():
    take = lambda name, query_, n="n_checked", bad="n_bad", who="sensor", stat="stat": ONE.format(who=who, stat=stat, name=name, n=n, bad=bad, body=ORACLES[query_])
    tie = "(CAST(round((v + 180) * 1000000) AS BIGINT) * 510) % 90000000 = 0 AND ((CAST(round((v + 180) * 1000000) AS BIGINT) * 510) // 90000000) % 2 = 1 AND abs((v + 180) * 1000000 - round((v + 180) * 1000000)) < 0.5 AND v BETWEEN -180 AND -90"
    ties = sql(f"{CELL} SELECT sensor, stat, count(*) FILTER (WHERE {tie}) AS n_checked, count(*) FILTER (WHERE {tie} AND q % 2 <> 0) AS n_bad FROM b GROUP BY ALL", "v_psd_stat")
    level = sql(f"WITH k AS (SELECT sensor, CAST(floor(t / 3600) * 3600 AS BIGINT) AS h FROM v_psd WHERE CAST(round((t - 1704067200) / 90) AS BIGINT) % 59 <> 1 GROUP BY ALL) SELECT sensor, count(*) AS n_checked, count(*) FILTER (WHERE (h // 3600) % 5 = 0) AS n_bad FROM k GROUP BY sensor", "v_psd")
    declared = sql("SELECT sensor, 6 AS n_checked, CASE WHEN sensor = 'click' THEN 1 ELSE 0 END AS n_bad FROM v_psd WHERE CAST(round((t - 1704067200) / 90) AS BIGINT) % 59 <> 1 GROUP BY sensor", "v_psd")
    wrong = "CASE WHEN ok THEN 0 ELSE 1 END"
    return [
        take("values", "recon_values"), take("codes", "recon_bytes"), take("clipped", "recon_clip"), take("exact", "recon_exact"),
        ONE.format(who="sensor", stat="stat", name="ties", n="n_checked", bad="n_bad", body=ties),
        f"SELECT b.sensor, b.stat, 'bias', v.n_checked, CASE WHEN ok THEN 0 ELSE 1 END FROM ({ORACLES['recon_bias']}) b JOIN ({ORACLES['recon_values']}) v ON v.sensor = b.sensor AND v.stat = b.stat",
        ONE.format(who="sensor", stat="stat", name="presence", n="n_checked", bad="n_bad", body=sql(f"WITH {SRC} SELECT sensor, stat, count(*) AS n_checked, count(*) FILTER (WHERE vec % 59 = 1) AS n_bad FROM src GROUP BY ALL", "v_psd_stat")),
        take("routing", "recon_routing", "1", wrong, "NULL AS sensor", "source_stat || ' as ' || stored_stat"), take("axis", "recon_axis", who="file AS sensor", stat="NULL"),
        ONE.format(who="sensor", stat="'max'", name="metadata", n="n_checked", bad="n_bad", body=declared), ONE.format(who="sensor", stat="'max'", name="pyramid 3600", n="n_checked", bad="n_bad", body=level),
        take("totals", "recon_totals", "1", wrong),
    ]


@query("SELECT *, n_bad = 0 AND (n_checked > 0 OR \"check\" IN ('clipped', 'ties')) AS ok FROM (" + " UNION ALL ".join(_parts()) + ")")
def recon_whole(spark, sf_dir):
    """All twelve checks of the damaged store in one table, with its headers, metadata, a level that lacks rows, and the combinations wanted."""
    store = damaged(spark, sf_dir)
    own = store.filter("stat = 'max'")
    level = P.psd_level(own, 3600, ("sensor",)).filter(F.floor(F.col("t") / 3600) % 5 != 0)
    declared = own.groupBy("sensor").agg(F.lit(64).alias("nf"), F.lit(-180.0).alias("qmin"), F.lit(-90.0).alias("qmax"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count("*").alias("captures"))
    declared = declared.withColumn("captures", F.col("captures") + F.when(F.col("sensor") == "click", 1).otherwise(0))
    expected = spark.range(1).select(F.explode(F.array(*map(F.lit, V.SENSORS))).alias("sensor")).withColumn("stat", F.explode(F.array(*[F.lit(s) for s in V.STATS])))
    return R.reconcile(source(spark, sf_dir), store, NARROW, headers(spark, sf_dir), declared, {3600: level}, expected)
