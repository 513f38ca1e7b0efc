"""Byte ranges of files, stores by their footers, units, percentiles, stored levels."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import sigmf_capture

from bandloom.operators import discovery, files, iq, pyramid, quantiles
from bandloom.plans import catalogue, signals
from bandloom.plans import sources as plans
from bandloom.sources import listing, ranges, views


def frames_of(df):
    rows = sorted((r.id, r.frame, list(r.i), list(r.q)) for r in df.collect())
    return rows


def test_slices_equal_the_whole_on_every_format(spark, tmp_path):
    """Ranges of five frames, of captures of all formats, headers of several kinds, and a rest that is no frame."""
    n, rng = 16 * 23 + 7, np.random.default_rng(3)
    for datatype, (kind, numbers, _) in iq.FORMATS.items():
        raw = (rng.integers(0, 100, n * numbers)).astype(kind).tobytes()
        sigmf_capture(tmp_path, f"c {datatype}", datatype, raw, declared=n)
    x = rng.normal(size=n) + 1j * rng.normal(size=n)
    made = {"a8": x.astype("<c8"), "a16": x.astype(">c16"), "two": x[: 16 * 20].reshape(4, 80), "folded": np.asfortranarray(x[: 16 * 20].reshape(4, 80)), "real": x.real, "short": x[:15], "none": x[:0]}
    for name, a in made.items():
        np.save(tmp_path / f"{name}.npy", a)
    (tmp_path / "broken.npy").write_bytes(b"no array")
    faults = {r.name: r.fault for r in iq.arrays(spark, str(tmp_path)).collect()}
    assert faults == {"a8": None, "a16": None, "two": None, "folded": "folded", "real": "datatype", "short": None, "none": "no data", "broken": "header: ValueError"}
    found = {}
    for r in iq.read_captures(spark, str(tmp_path), 16, size=16 * 5 * 8).collect():
        found.setdefault(r.id, {})[r.frame] = np.array(r.i) + 1j * np.array(r.q)
    ids = {r.name: r.id for r in iq.arrays(spark, str(tmp_path)).collect()} | {r.name: r.id for r in iq.catalogue(spark, str(tmp_path)).collect()}
    for name in ("a8", "a16", "two", "folded"):
        want = made[name].reshape(-1)
        got = found[ids[name]]
        assert sorted(got) == list(range(len(want) // 16)) and np.allclose(np.concatenate([got[k] for k in sorted(got)]), want[: len(want) // 16 * 16])
    for datatype in iq.FORMATS:
        want = iq.decode_samples((tmp_path / f"c {datatype}.sigmf-data").read_bytes(), datatype)
        got = found[ids[f"c {datatype}"]]
        assert sorted(got) == list(range(23)) and np.allclose(np.concatenate([got[k] for k in range(23)]), want[: 16 * 23])
    assert len(found) == len(iq.FORMATS) + 4


def test_a_capture_beyond_two_gigabytes(spark, tmp_path):
    """Three gigabytes, of which only the end is no gap: a task for each range, and the last range is read alone."""
    n = 3 * (1 << 30) // 8
    sigmf_capture(tmp_path, "long", "cf32_le", b"", declared=n)
    path = tmp_path / "long.sigmf-data"
    os.truncate(path, 8 * n)
    with open(path, "r+b") as f:
        f.seek(8 * (n - 16))
        f.write(np.arange(16, dtype="<c8").tobytes())
    sound = iq.sound_captures(spark, str(tmp_path))
    parts = iq.slices(sound, 16, 64 << 20)
    assert parts.count() == 48 and parts.agg(F.sum("frames")).first()[0] == n // 16
    assert iq.read_slices(sound, 16).rdd.getNumPartitions() == 48
    last = parts.filter(F.col("frame") == n // 16 - parts.agg(F.min("frames")).first()[0])
    rows = last.withColumn("at", F.col("at") + (F.col("frames") - 1) * 128).withColumn("frame", F.col("frame") + F.col("frames") - 1).withColumn("frames", F.lit(1).cast("long"))
    found = rows.mapInArrow(iq._read_slices(16), iq.FRAME_ROWS).collect()
    assert [(r.frame, list(r.i)) for r in found] == [(n // 16 - 1, [float(k) for k in range(16)])]


def test_ingest_takes_each_capture_once(spark, tmp_path):
    rng, target = np.random.default_rng(1), str(tmp_path / "out")
    src = tmp_path / "in"
    src.mkdir()
    raw = rng.normal(size=2 * 16 * 40).astype("<f4").tobytes()
    sigmf_capture(src, "one", "cf32_le", raw)
    sigmf_capture(src, "short", "cf32_le", raw[: 8 * 15])
    sigmf_capture(src, "cut", "cf32_le", raw, declared=10_000)
    np.save(src / "array.npy", rng.normal(size=64) + 0j)
    state = lambda df: {r.name: r.state for r in df.collect()}
    first = {"one": "ingested", "short": "short", "cut": "truncated", "array": "no rate"}
    assert state(iq.ingest(spark, str(src), target, "d", 16, coarsest=4)) == first
    assert state(iq.ingest(spark, str(src), target, "d", 16, array_rate=100.0, coarsest=4)) == first | {"one": "already", "array": "ingested"}
    # a run that died before its metadata
    iq.stored_levels(spark, target).limit(1).withColumn("level", F.lit(77)).drop("run").write.parquet(f"{target}/levels/run=dead")
    levels, meta = iq.stored_levels(spark, target), {r.name: r for r in iq.stored_metadata(spark, target).collect()}
    assert sorted(meta) == ["array", "one"] and meta["one"].n_levels == 5 and meta["array"].duration == 0.64
    sizes = {(r.id, r.level): r["count"] for r in levels.groupBy("id", "level").count().collect()}
    assert [sizes[meta["one"].id, k] for k in range(5)] == [40, 20, 10, 5, 2] and len(sizes) == 6
    spectra = iq.stft(iq.read_captures(spark, str(src), 16), 16).filter(F.col("id") == meta["one"].id)
    want = iq.levels(spectra, iq.quantization_range(spectra), 4)
    key = lambda df: sorted((r.level, r.col, list(r.bins)) for r in df.filter(F.col("id") == meta["one"].id).collect())
    assert key(levels) == key(want)


def test_headers_are_read_of_undecided_files_alone(spark, tmp_path):
    """Of five files two are opened, and of these a few bytes read; a header longer than a step is read to its end."""
    big = "1,2,3\n" * 200_000
    (tmp_path / "2024-03-04_A_B_max.csv").write_text("datetime," + ",".join(f"b{k}" for k in range(50)) + "\n" + big)
    (tmp_path / "PFP_2024-03-04_A_max_peak.csv").write_text("datetime,frequency,p0\n" + big)
    (tmp_path / "table.csv").write_text("sensor_name,channel_frequency_mhz," + "x" * 5_000 + "\r\n" + big)
    (tmp_path / "notes.csv").write_text("a,b")
    (tmp_path / "readme.txt").write_text(big)
    listed = files.list_files(spark, str(tmp_path)).select("path", "name")
    found = {r.name: (r.kind, r.n_read) for r in files.survey(listed).collect()}
    assert {n: k for n, (k, _) in found.items()} == {"2024-03-04_A_B_max.csv": "psd", "PFP_2024-03-04_A_max_peak.csv": "pfp", "table.csv": "summaries", "notes.csv": "none", "readme.txt": "none"}
    assert [found[n][1] for n in ("2024-03-04_A_B_max.csv", "PFP_2024-03-04_A_max_peak.csv", "readme.txt")] == [None] * 3
    assert found["table.csv"][1] == 8_192 and found["notes.csv"][1] == 3
    small = {r.header[-5:]: r.n_read for r in ranges.first_lines(listed.filter("name = 'table.csv'"), step=100).collect()}
    assert small == {"xxxxx": 5_100}
    named = files.classify(listed.withColumn("header", F.lit(None).cast("string"))).filter("kind in ('psd', 'pfp')").drop("header")
    assert {(r.kind, r.n_cols, r.ok) for r in files.preflight(named, 51).collect()} == {("psd", 51, True), ("pfp", 3, False)}
    gone = spark.createDataFrame([(str(tmp_path / "gone.csv"),), ("viewfs://store/x.csv",)], "path string")
    assert {r.header for r in ranges.first_lines(gone).collect()} == {None}


def test_units_are_taken_whole(spark):
    rows = [("a/x.sigmf-meta", 1), ("a/x.SIGMF-DATA", 900), ("a/y.sigmf-meta", 1), ("a/y.sigmf-data", None), ("t.csv", 3), ("readme.md", 1), ("b/z.iq/f.float32", 50), ("b/z.iq/f.xml", 2)]
    df = spark.createDataFrame(rows, "path string, size long")
    found = [(r.unit, r.path) for r in files.smallest_units(df, 4).orderBy("place", "path").collect()]
    assert found == [("b/z.iq", "b/z.iq/f.float32"), ("b/z.iq", "b/z.iq/f.xml"), ("a/x", "a/x.SIGMF-DATA"), ("a/x", "a/x.sigmf-meta"), ("a/y", "a/y.sigmf-data"), ("a/y", "a/y.sigmf-meta"), ("t.csv", "t.csv")]
    assert files.smallest_units(df, 99).count() == 8 and files.smallest_units(df.limit(0), 3).count() == 0


def test_manifest_sizes_of_every_kind(spark):
    sizes = {"12": 12, '"12"': 12, '" 12 "': 12, "12.9": 12, '"12.9"': None, '"x"': None, "null": None, "true": None, "[1]": None, "1e3": 1000, "-5": -5}
    parts = ", ".join(f'{{"filepath": "f{k}", "downloadURL": "http://h/{k}", "size": {s}}}' for k, s in enumerate(sizes))
    odd = ', {"filepath": 5, "downloadURL": {"a": 1}}, 7, null, {"downloadURL": "http://h/b%20c"}, {"filepath": "g", "downloadURL": "http://h/g", "@type": "one"}'
    rows = [(1, f'{{"components": [{parts}{odd}]}}'), (2, "no json"), (3, None), (4, '{"ResultData": [{"components": null}, {}, {"components": [{"filepath": "w", "downloadURL": "http://h/w"}]}]}')]
    found = {(r.id, r.path): r.size for r in files.manifest(spark.createDataFrame(rows, "id int, json string")).collect()}
    assert found == {(1, f"f{k}"): n for k, n in enumerate(sizes.values())} | {(1, "b c"): None, (1, "g"): None, (4, "w"): None}


def test_stores_by_their_footers(spark, tmp_path):
    """Partition columns count, files of one store must agree, an unreadable one is a fault; nothing is scanned."""
    at = lambda name: str(tmp_path / name)
    rows = spark.range(10).select(F.lit("s").alias("sensor"), F.col("id").cast("double").alias("t"), F.array("id").alias("spec"))
    rows.repartition(3).write.partitionBy("sensor").parquet(at("psd"))
    rows.limit(4).withColumn("freq", F.lit(1.0)).write.parquet(at("pfp"))
    rows.drop("spec").write.parquet(at("odd"))
    rows.write.parquet(at("mixed"))
    rows.drop("spec").write.mode("append").parquet(at("mixed"))
    rows.write.parquet(at("bad"))
    (tmp_path / "bad" / "x.parquet").write_bytes(b"PAR1 no PAR1")
    found = {r.store.rsplit("/", 1)[1]: r for r in discovery.stores(spark, str(tmp_path)).collect()}
    assert {n: (r.kind, r.rows) for n, r in found.items() if n != "bad"} == {"psd": ("psd", 10), "pfp": ("pfp", 4), "odd": (None, 10), "mixed": (None, 20)}
    assert found["bad"].kind is None and found["bad"].fault.startswith("not readable") and "sensor, t" in found["odd"].fault


def test_plans_for_stores(spark):
    rows = [("/p1", "psd", 5), ("/p2", "psd", 9), ("/live", "psd", 3), ("/s1", "summaries", 4), ("/s2", "summaries", 4), ("/q1", "pfp", 1), ("/q2", "pfp", 2), ("/odd", None, 7)]
    found = spark.createDataFrame([(*r, None) for r in rows], "store string, kind string, rows long, fault string")
    there = spark.createDataFrame([("psd", "/live", 3), ("summaries", "/other", 2)], "kind string, place string, rows long")
    assert {r.store: r.action for r in discovery.plan(found, there).collect()} == {"/p1": "merge", "/p2": "merge", "/live": "already", "/s1": "skip", "/s2": "skip", "/q2": "install", "/q1": "merge", "/odd": "reject"}
    assert {r.store: r.action for r in discovery.plan(found, there.limit(0)).collect()}["/s1"] == "install"


def test_percentiles_of_a_hot_sensor(spark):
    """Continuous values of all signs and sizes, most on one sensor, with nulls, NaN, zeros of both signs, and weights."""
    rng = random.Random(4)
    value = lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 10 ** rng.randrange(-300, 300), 0.0, -0.0, float(rng.randrange(5)), None])
    rows = [("hot" if k % 3 else f"s{k % 7}", value(), rng.choice([1, 2, 5, 0])) for k in range(4_000)] + [("one", 5.0, 1), ("none", None, 1), ("nan", float("nan"), 1), ("nan", 1.0, 1), (None, 3.0, 1), (None, 4.0, 1)]
    df = spark.createDataFrame(rows, "sensor string, x double, c int")
    shares = [0.0, 0.02, 0.25, 1 / 3, 0.5, 0.98, 1.0]
    array = F.array(*map(F.lit, shares))
    for weight in (None, "c"):
        some = df.filter("x is not null and c > 0") if weight else df.filter("x is not null")
        want = some.groupBy("sensor").agg((F.percentile("x", array, F.col("c")) if weight else F.percentile("x", array)).alias("p"), (F.sum("c") if weight else F.count("x")).alias("n"))
        want, found = ({r.sensor: (r.n, np.array(r.p)) for r in f.collect()} for f in (want, quantiles.percentiles(df, ["sensor"], "x", shares, weight)))
        assert want.keys() == found.keys()
        for k, (n, p) in want.items():
            assert found[k][0] == n
            np.testing.assert_allclose(found[k][1], p, rtol=1e-12)
    assert quantiles.percentiles(df.limit(0), ["sensor"], "x", shares).collect() == []
    whole = quantiles.percentiles(df.filter("sensor = 'hot'"), [], "x", [0.5]).first()
    assert whole.p[0] == pytest.approx(df.filter("sensor = 'hot'").agg(F.percentile("x", 0.5)).first()[0])


def test_order_of_keys():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    keys = quantiles.ordered(x)
    assert (np.diff(keys) > 0).all() and quantiles.ordered(np.array([-0.0]))[0] == keys[4]
    np.testing.assert_array_equal(quantiles.restored(keys), x)


def test_top_up_writes_new_days_only(spark, tmp_path):
    path, day = str(tmp_path / "level"), 86_400
    rng = np.random.default_rng(6)
    rows = [("max", "s", float(t), [int(v) for v in rng.integers(0, 255, 3)]) for t in range(0, 6 * day, 1_800)]
    c = spark.createDataFrame(rows, "stat string, sensor string, t double, spec array<smallint>")
    since = 3.4 * day
    pyramid.write_level(pyramid.psd_level(c.filter(F.col("t") < since), 3600), path)
    files_ = lambda: {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, ns in os.walk(path) for n in ns if n.endswith(".parquet")}
    before = files_()
    pyramid.top_up_stored(path, c, since, 3600)
    after = files_()
    assert all(after[f] == m for f, m in before.items() if "day=3" not in f) and not any(f in after for f in before if "day=3" in f)
    assert {f.split("day=")[1][0] for f in set(after) - set(before)} == {"3", "4", "5"}
    key = lambda df: sorted((r.t, list(r.smax)) for r in df.collect())
    assert key(spark.read.parquet(path)) == key(pyramid.psd_level(c, 3600))
    with pytest.raises(ValueError, match="one day"):
        pyramid.top_up_stored(path, c, since, 2 * day)


def test_spread_sample_of_slots_of_unequal_size(spark):
    rng = random.Random(9)
    times = sorted(rng.sample(range(100_000), 900)) + list(range(900_000, 900_010)) + [1_600_000]
    rows = spark.createDataFrame([("s", float(t)) for t in times] + [("one", 7.0)], "sensor string, t double")
    step, want = 1_600_000 / 16 - times[0] / 16, []
    for k in range(16):
        inside = [t for t in times if min(15, int((t - times[0]) / step)) == k]
        want += inside[:16]
    for most in (400, 10):
        found = pyramid.spread_sample(rows, ["sensor"], most=most).collect()
        assert sorted(r.t for r in found if r.sensor == "s") == want[:: max(1, len(want) // most)]
        assert [(r.t, r.slot, r.k) for r in found if r.sensor == "one"] == [(7.0, 0, 0)]


def test_a_centre_of_zero_is_told_from_none(spark):
    """A stated frequency of 0 stays 0 where nothing stated is null: the capture's, a global key's, neither."""
    rows = [("a", '{"global": {}, "captures": [{"core:frequency": 0.0}]}'), ("b", '{"global": {"x:center_frequency": 0}, "captures": []}'), ("c", '{"global": {}, "captures": []}'), ("d", '{"global": {}, "captures": [{"core:frequency": "?"}]}'), ("e", '{"captures": [{"core:frequency": 5}]}')]
    found = {r.stem: (r.center, r.tuned) for r in iq.described(spark.createDataFrame(rows, "stem string, json string")).collect()}
    assert found == {"a": (0.0, True), "b": (0.0, True), "c": (0.0, False), "d": (0.0, False), "e": (5.0, True)}


def test_iq_sidecar_with_values_of_zero(spark, tmp_path):
    rows = [(k, 7, v) for k, v in enumerate([0.0, 0.0, 0.0, 1.5, None, 2.5])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = con.execute(catalogue.ORACLES["iq_sidecar"]).fetchall()
    found = [tuple(r) for r in catalogue.QUERIES["iq_sidecar"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(want) and [r[2] for r in sorted(found)] == [0.0, 0.0, None, 1.5e6, None, None]


def test_plans_with_several_places_and_empty_stores(spark):
    """Each of a kind's places is already there; a store without rows is not merged; the kinds that merge are given."""
    rows = [("a", "k", 5), ("b", "k", 9), ("c", "k", 0), ("p", "live", 3), ("q", "live", 8), ("r", "live", 2), ("y", "only", 4), ("z", "only", 6)]
    found = spark.createDataFrame([(*r, None) for r in rows], "store string, kind string, rows long, fault string")
    there = spark.createDataFrame([("live", "p", 3), ("live", "q", 8)], "kind string, place string, rows long")
    want = {"a": "merge", "b": "install", "c": "skip", "p": "already", "q": "already", "r": "merge", "y": "skip", "z": "install"}
    assert {r.store: r.action for r in discovery.plan(found, there, ["k", "live"]).collect()} == want


def test_pieces_are_made_one_by_one(spark, tmp_path):
    """Pieces come from rows in the task that writes them, and the captures' files are the samples in order."""
    rows = spark.createDataFrame([(f"{tmp_path}/a/{k % 3}", 4 * (k // 3), k) for k in range(9)], "path string, at long, k int")
    made = lambda batch: ((r["path"], r["at"], bytes([r["k"]]) * 4) for r in batch.to_pylist())
    assert ranges.write_pieces(rows, made) == 9
    assert [(tmp_path / "a" / str(n)).read_bytes() for n in range(3)] == [bytes(b for k in (n, n + 3, n + 6) for b in [k] * 4) for n in range(3)]
    assert ranges.write_pieces(rows.limit(0), made) == 0


def test_small_ranges_share_tasks(spark):
    """Ranges of 64 KB are dealt to tasks by their volume, listings to no more tasks than are worth it."""
    sound = spark.range(4_000).select("id", F.lit("x").alias("path"), F.lit("cf64_le").alias("datatype"), F.lit(1.0).alias("scale"), F.lit(0).cast("long").alias("start"), F.lit(600).cast("long").alias("samples"))
    assert iq.read_slices(sound, 16, size=1 << 16).rdd.getNumPartitions() == 4
    assert ranges.in_tasks(spark.range(100_000), 64).rdd.getNumPartitions() == 128


def test_samples_are_dealt_by_their_number(spark, monkeypatch):
    """More samples, more tasks: what one sorts does not grow."""
    monkeypatch.setattr(views, "SAMPLES", 500)
    where = "/root/testdata/sf0.001"
    assert views.iq_tasks(spark, where) == 12
    assert signals.spectra(spark, where).rdd.getNumPartitions() == 12
    s, ranges_, tasks = signals.ranged_spectra(spark, where)
    assert tasks == 1 and iq.quantization_range(s, 7).rdd.getNumPartitions() == 7 and iq.levels(s, ranges_, 8, 7).rdd.getNumPartitions() == 7


def test_frames_of_odd_sizes(spark):
    """Frames that lack samples or have too many are none, over many batches; nulls stay where they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [("a", k, float(k), -float(k)) for k in range(45)] + [("b", 0, 1.0, 1.0)] * 90 + [("b", k, None if k == 17 else 2.0, 3.0) for k in range(16, 32)] + [(None, k, 1.0, 1.0) for k in range(16)]
        found = {(r.id, r.frame): (list(r.i), list(r.q)) for r in iq.frames(spark.createDataFrame(rows, "id string, sample long, i double, q double"), 16, 3).collect()}
        assert sorted(found, key=str) == [(None, 0), ("a", 0), ("a", 1), ("b", 1)] or set(found) == {(None, 0), ("a", 0), ("a", 1), ("b", 1)}
        assert found["a", 1] == ([float(k) for k in range(16, 32)], [-float(k) for k in range(16, 32)]) and found["b", 1][0] == [2.0, None] + [2.0] * 14
        spectra = spark.createDataFrame([(k % 5, k // 5, [float((7 * k + j) % 23) for j in range(4)]) for k in range(5 * 300)], "id int, frame long, dbm array<double>")
        for r in iq.quantization_range(spectra, 2).collect():
            times = [max(0, f // 4 - -(-max(0, f - 31) // 4) + 1) for f in range(300)]
            x = [float((7 * (5 * f + r.id) + j) % 23) for f in range(300) for j in range(4) for _ in range(times[f])]
            assert (r.qmin, r.qmax) == pytest.approx((np.percentile(x, 0.1) - 6, np.percentile(x, 99.9) + 6))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_preflight_writes_day_files(spark):
    """What has no geometry is not written; every listed day file is."""
    where = "/root/testdata/sf0.001"
    day = F.col("name").rlike(files.PSD_NAME) | F.col("name").rlike(files.PFP_NAME)
    _, place = plans.header_files(spark, where, day)
    want = {r.path for r in views.files(spark, where).filter(day).select("path").distinct().collect()}
    assert {os.path.relpath(os.path.join(d, n), place) for d, _, names in os.walk(place) for n in names} == want


def test_manifests_are_parsed_once_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(views, "EVENTS", 100)
    found = catalogue.QUERIES["manifest_explode"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == 10 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    part = lambda path, url: f'{{"filepath": "{path}", "downloadURL": "{url}"}}'
    rows = [(1, f'{{"components": [{part("a", "u")}, {part("a.sha256", "s2")}]}}'), (1, f'{{"components": [{part("a.sha256", "s1")}]}}'), (None, f'{{"components": [{part("a", "u")}, {part("a.sha256", "s")}]}}')]
    assert sorted((r.id or 0, r.path, r.checksum) for r in files.manifest(spark.createDataFrame(rows, "id int, json string")).collect()) == [(0, "a", None), (1, "a", "s1")]


def test_spectra_in_one_pass(spark, monkeypatch):
    """Frames and transforms share one Python step, dealt by stretches of frames: as many tasks as asked, the same spectra."""
    rng = np.random.default_rng(5)
    rows = [(i, k, float(a), float(b)) for i in range(3) for k, (a, b) in enumerate(rng.normal(size=(16 * 90 + 5, 2)))]
    samples = spark.createDataFrame(rows, "id int, sample long, i double, q double")
    once = iq.spectra(samples, 16, 5)
    assert once._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and once.rdd.getNumPartitions() == 5
    want = {(r.id, r.frame): list(r.dbm) for r in iq.stft(iq.frames(samples, 16, 5), 16).collect()}
    assert {(r.id, r.frame): list(r.dbm) for r in once.collect()} == want and len(want) == 270
    # what a task of the query holds is bounded by SAMPLES, not by the table
    monkeypatch.setattr(views, "SAMPLES", 1_000)
    plan = signals.spectra(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def columns_by_hand(n, width, coarsest, seed):
    rng = random.Random(seed)
    levels = [[[rng.randrange(256) for _ in range(width)] for _ in range(n)]]
    while len(levels[-1]) > coarsest:
        last = levels[-1]
        levels.append([[max(p) for p in zip(last[2 * k], last[2 * k + 1], strict=True)] for k in range(len(last) // 2)])
    return levels


def test_levels_come_from_the_level_below(spark):
    """Every level against one built by hand, over batches of 13 rows; columns are not copied for each level."""
    made = {i: columns_by_hand(n, 3, 8, n) for i, n in enumerate((1, 2, 7, 8, 9, 16, 17, 18, 35, 100, 257))}
    rows = [(i, c, b) for i, levels in made.items() for c, b in enumerate(levels[0])]
    random.Random(1).shuffle(rows)
    columns = spark.createDataFrame(rows, "id int, col long, bins array<smallint>")
    want = {(k, i, c): b for i, levels in made.items() for k, level in enumerate(levels) for c, b in enumerate(level)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        every = pyramid.column_levels(columns, 8, 3)
        assert {(r.level, r.id, r.col): list(r.bins) for r in every.collect()} == want
        assert "Generate explode" not in every._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_display_scale_builds_the_coarsest_level_alone(spark, monkeypatch):
    """The coarsest level, straight from the columns, is that of the pyramid; the query's scale sees no other, dealt to tasks."""
    made = {i: columns_by_hand(n, 3, 8, n) for i, n in enumerate((1, 8, 9, 35, 100, 257))}
    columns = spark.createDataFrame([(i, c, b) for i, levels in made.items() for c, b in enumerate(levels[0])], "id int, col long, bins array<smallint>")
    want = {(len(levels) - 1, i, c): b for i, levels in made.items() for c, b in enumerate(levels[-1])}
    last = pyramid.coarsest_level(columns, 8, 3)
    assert {(r.level, r.id, r.col): list(r.bins) for r in last.collect()} == want
    ranges_ = spark.createDataFrame([(i, -100.0 - i, -20.0 + i) for i in made], "id int, qmin double, qmax double")
    scale = iq.display_scale(last, ranges_, tasks=7)
    assert "RepartitionByExpression [id" in scale._jdf.queryExecution().optimizedPlan().toString()
    for r in scale.collect():
        x = [-100.0 - r.id + q / 255 * (80 + 2 * r.id) for b in made[r.id][-1] for q in b]
        low, high = np.percentile(x, 2), np.percentile(x, 98)
        assert (r.vmin, r.vmax) == pytest.approx((low, max(high, low + 6)), abs=0.051)
    seen = []
    own = iq.display_scale
    monkeypatch.setattr(iq, "display_scale", lambda p, *a, **k: seen.append(p) or own(p, *a, **k))
    signals.iq_display_scale(spark, "/root/testdata/sf0.001")
    assert seen[0].select("id", "level").distinct().groupBy("id").count().agg(F.max("count")).first()[0] == 1


def test_listing_in_tasks_equals_sparks(spark, tmp_path, monkeypatch):
    """Names that Spark's readers pass over, odd ones, empty files, links, more names than a batch has; paths in every spelling."""
    monkeypatch.setattr(listing, "NAMES", 3)
    top = tmp_path / "all of it"
    for name in ("a.npy", "b c/d é.npy", "b c/e%20f.npy", "b c/.h/x.npy", "_s/x.npy", "_s=1/x.npy", "_metadata/x.npy", "x._COPYING_/x.npy", "deep/er/and/deeper/x.npy", "deep/_x.npy", "deep/.x.npy", "deep/_k=2.npy", "deep/y._COPYING_", "deep/z.txt"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(name.encode())
    (top / "deep/empty.npy").touch()
    (top / "bare").mkdir()
    (top / "link").symlink_to(top / "b c")
    (top / "broken").symlink_to(top / "gone")
    for k, path in enumerate((str(top), f"{top}/", f"file://{top}", f"file:{tmp_path}//all of it/deep/..", str(top / "bare"))):
        own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")
        found = listing.files_below(spark, path, str(tmp_path / f"listed{k}"))
        assert sorted(map(tuple, found.collect())) == sorted((r.path, r.length) for r in own.collect())
        texts = listing.contents(spark, path, found, ".npy")
        assert sorted((r.path, bytes(r.content)) for r in texts.collect()) == sorted((r.path, bytes(r.content)) for r in own.collect() if r.path.endswith(".npy"))
    assert len(os.listdir(tmp_path / "listed0")) == 5
    for path in (f"{top}/d*", str(top / "a.npy")):  # by Spark
        found = listing.files_below(spark, path, str(tmp_path / "none"))
        assert {r.path for r in found.collect()} and {r.path for r in listing.contents(spark, path, found, ".npy").collect()}
    assert not (tmp_path / "none").exists()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        listing.files_below(spark, str(top / "gone"), str(tmp_path / "none"))


def test_captures_are_not_listed_by_the_driver(spark, tmp_path):
    """No relation of the catalogue holds the captures' files; ingest removes its listing."""
    src, target = tmp_path / "in", str(tmp_path / "out")
    for k in range(20):
        (src / f"d{k % 3}").mkdir(parents=True, exist_ok=True)
        sigmf_capture(src / f"d{k % 3}", f"c{k}", "cf32_le", np.arange(64, dtype="<c8").tobytes())
        np.save(src / f"d{k % 3}" / f"a{k}.npy", np.arange(64) + 0j)
    for rows, n in ((iq.catalogue(spark, str(src)), 20), (iq.arrays(spark, str(src)), 20), (iq.sound_captures(spark, str(src)), 40)):
        assert rows.count() == n and not [f for f in rows.inputFiles() if f.endswith((".npy", ".sigmf-data", ".sigmf-meta"))]
    states = iq.ingest(spark, str(src), target, "d", 16, array_rate=1.0).collect()
    assert [r.state for r in states] == ["ingested"] * 40 and not os.listdir(f"{target}/listed")
