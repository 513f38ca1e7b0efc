"""Golden cases of the measurement operators, and files written by the tests."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import quant
from bandloom.operators import files, iq, pyramid, recon, store, windows
from bandloom.sources import exports


def test_stored_level_is_the_widest_within_a_column():
    """Against the rule itself, on both sides of each of its bounds and at random."""
    def rule(span, cols, captures, levels):
        fit = [b for b in levels if b * cols <= span]
        return max(fit) if fit and captures > 10 * cols else None

    rng = np.random.default_rng(12)
    for cols in (1, 7, 500):
        for bucket in pyramid.BUCKETS:
            for off in (-1, 0, 1):
                for captures in (10 * cols, 10 * cols + 1):
                    case = bucket * cols + off, cols, captures, list(pyramid.BUCKETS)
                    assert windows.pick_psd_level(*case) == rule(*case)
    for _ in range(200):
        some = [b for b in pyramid.BUCKETS if rng.random() < 0.6]
        case = float(rng.integers(1, 10**7)), int(rng.integers(1, 3000)), int(rng.integers(0, 40_000)), some
        assert windows.pick_psd_level(*case) == rule(*case)


def test_summary_level_leaves_raw_after_six_hours():
    for width in (1, 36, 37, 1000):
        for hours in (1, 6):
            assert windows.pick_summary_level(hours * 3600, width) == 0
        for span in (6 * 3600 + 1, 600 * width, 600 * width + 1, 86_400 * width, 86_400 * width + 1):
            if span > 6 * 3600:
                fit = [b for b in pyramid.BUCKETS if -(-span // b) <= width]
                assert windows.pick_summary_level(span, width) == min(fit, default=86_400)


def test_levels_to_grid_equals_a_plain_loop(spark):
    """Each bucket is seen in every column that it touches, and in no other."""
    rng = np.random.default_rng(8)
    level = [(int(600 * k), rng.integers(0, 99, 3).tolist()) for k in rng.choice(60, 30, replace=False)]
    asked = [(f"w{k}", float(rng.integers(0, 20_000)), float(rng.integers(20_001, 40_000)), int(c)) for k, c in enumerate((1, 3, 10, 77))]
    df = spark.createDataFrame([("s", t, v) for t, v in level], "sensor string, t long, smax array<smallint>")
    for name, t0, t1, cols in asked:
        w = spark.createDataFrame([(name, "s", t0, t1)], "window_id string, sensor string, t0 double, t1 double")
        want = {}
        for t, v in level:
            for c in range(cols):
                if t < t0 + (c + 1) * (t1 - t0) / cols - 1e-6 and t + 600 > t0 + c * (t1 - t0) / cols + 1e-6:
                    want[c] = [max(a, b) for a, b in zip(v, want.get(c, v), strict=True)]
        found = {r["col"]: r["smax"] for r in pyramid.levels_to_grid(df, w, cols, 600, ["sensor"]).collect()}
        assert found == want


def test_vector_max_of_ragged_vectors_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4), [rng.choice([None, rng.uniform(-9, 9)]) for _ in range(rng.randint(0, 5))]) for _ in range(400)]
    want = {}
    for k, n, v in rows:
        best = want.setdefault((k, n), [])
        best += [None] * (len(v) - len(best))
        for i, x in enumerate(v):
            if x is not None and (best[i] is None or x > best[i]):
                best[i] = x
    df = spark.createDataFrame(rows, "k string, n int, v array<double>").repartition(5)
    assert {(r["k"], r["n"]): r["smax"] for r in pyramid.vector_max(df, ["k", "n"], "v").collect()} == want
    assert pyramid.vector_max(df.limit(0), ["k", "n"], "v").collect() == []


def test_vector_max_over_several_batches_of_keys_that_are_not_null(spark):
    """A partition of 25,000 rows reaches Python in three batches; generated keys cannot be null."""
    rows = spark.range(0, 25_000, 1, 1).select(
        F.lit("s").alias("sensor"), F.lit(1).alias("k"), F.floor(F.col("id") / 9_000).alias("t"), F.array(F.col("id"), -F.col("id")).cast("array<int>").alias("v"))
    assert not rows.schema["sensor"].nullable and rows.rdd.getNumPartitions() == 1
    found = {r.t: list(r.smax) for r in pyramid.vector_max(rows, ["sensor", "k", "t"], "v").collect()}
    assert found == {0: [8_999, 0], 1: [17_999, -9_000], 2: [24_999, -18_000]}
    one = {tuple(r.smax) for r in pyramid.psd_level(rows.withColumn("stat", F.lit("max")).withColumn("spec", F.col("v")).withColumn("t", F.lit(5.0)), 600).collect()}
    assert one == {(24_999, 0)}


def test_column_levels_over_several_batches(spark):
    n = 30_001
    columns = spark.range(0, n, 1, 1).select(F.lit(7).alias("id"), F.col("id").alias("col"), F.array(F.col("id") % 1000).cast("array<smallint>").alias("bins"))
    found = pyramid.column_levels(columns, 10_000)
    sizes = {r.level: r.n for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: n, 1: n // 2, 2: n // 4}
    pairs = {r.col: r.bins[0] for r in found.filter("level = 1").collect()}
    assert all(pairs[c] == max(2 * c % 1000, (2 * c + 1) % 1000) for c in pairs)


def test_column_levels_by_capture(spark):
    """A small capture beside a large one keeps its single level."""
    sizes, columns = {1: 5, 2: 64, 3: 33, 4: 8, 5: 17}, []
    for i, n in sizes.items():
        columns += [(i, c, [(c * 37 + i * 5) % 101, c % 7]) for c in range(n)]
    want = set()
    for i in sizes:
        level, k = {c: v for j, c, v in columns if j == i}, 0
        want |= {(0, i, c, tuple(v)) for c, v in level.items()}
        while len(level) > 8:
            k += 1
            level = {c: [max(a, b) for a, b in zip(level[2 * c], level[2 * c + 1], strict=True)] for c in range(len(level) // 2)}
            want |= {(k, i, c, tuple(v)) for c, v in level.items()}
    df = spark.createDataFrame(columns, "id int, col long, bins array<smallint>")
    assert {(r["level"], r["id"], r["col"], tuple(r["bins"])) for r in pyramid.column_levels(df, 8).collect()} == want
    assert pyramid.column_levels(df.limit(0), 8).collect() == []


def test_as_of_equals_a_plain_search(spark):
    rng = random.Random(7)
    times = {s: sorted(rng.sample(range(0, 6 * 86_400), 25)) for s in ("x", "y")}
    rows = [(s, float(t), [t % 997]) for s, ts in times.items() for t in ts]
    asked = [(f"{s}{k}", s, float(rng.randrange(-5, 7 * 86_400))) for k in range(60) for s in ("x", "y", "z")]
    c = spark.createDataFrame(rows, "sensor string, t double, spec array<smallint>")
    w = spark.createDataFrame([(i, s, t - 5, t) for i, s, t in asked], "window_id string, sensor string, t0 double, t1 double")
    want = {i: max([t for t in times[s] if t < t1], default=times[s][0]) for i, s, t1 in asked if s in times}
    found = {r["window_id"]: (r["t"], r["spec"]) for r in pyramid.as_of(c, w, ["sensor"], "spec").collect()}
    assert found == {i: (float(t), [t % 997]) for i, t in want.items()}


def test_a_level_answers_only_what_it_spans(spark):
    rng = np.random.default_rng(1)
    rows = [("s", "max", float(60 * i), rng.integers(0, 255, 8).tolist()) for i in range(2000)]
    c = spark.createDataFrame(rows, "sensor string, stat string, t double, spec array<smallint>")
    w = spark.createDataFrame([("w", "s", 0.0, 120_000.0)], "window_id string, sensor string, t0 double, t1 double")
    half = {600: pyramid.psd_level(c.filter("t < 60000"), 600, by=("sensor",))}
    key = lambda df: sorted(tuple(r) for r in df.collect())
    g = quant.Geometry(n=8)
    assert key(windows.spectrum_window(c, w, 50, 4, g, levels=half)) == key(windows.spectrum_window(c, w, 50, 4, g))


def test_unsafe_paths_and_names(spark):
    paths = ["a/b.bin", "/a", "a//b", "./a", "a/..", "a/../b", "c:/x", "a\\b", "", "a.b..c/d", None]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string").withColumn("ok", files.safe_path(F.col("p"))).collect()
    assert [r["p"] for r in rows if r["ok"]] == ["a/b.bin", "a.b..c/d"]
    names = ["2024-01-02_A_B_max.csv", "2024-01-02_A_max.bak.csv", "PFP_2024-01-02_A_max_peak.csv", "x.complex1ch.float32", "2024-01-02_A_.csv", "plain.csv"]
    found = files.classify(spark.createDataFrame([(n, n, None) for n in names], "path string, name string, header string")).collect()
    assert [(r["kind"], r["sensor"], r["stat"]) for r in found] == [("psd", "A_B", "max"), ("none", None, None), ("pfp", "A", "max_peak"), ("iq", None, None), ("none", None, None), ("none", None, None)]


def test_heads_of_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.csv").write_text("sensor_name,channel_frequency_mhz,x\n1,2,3\n4,5,6\n")
    (tmp_path / "d" / "b.csv").write_text("p,q\n")
    (tmp_path / "c.txt").write_text("z\n")
    found = {r["path"].rsplit("/", 1)[-1]: (r["header"], r["n_cols"]) for r in files.heads(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": ("sensor_name,channel_frequency_mhz,x", 3), "b.csv": ("p,q", 2)}
    listed = files.classify(files.list_files(spark, str(tmp_path)).withColumn("header", F.lit(None).cast("string")))
    assert {r["name"] for r in files.undecided(listed).collect()} == {"a.csv", "b.csv"}
    decided = files.classify(files.undecided(listed).select("path", "name").join(files.heads(spark, str(tmp_path)), "path"))
    assert {r["name"]: r["kind"] for r in decided.collect()} == {"a.csv": "summaries", "b.csv": "none"}


def test_level_path_is_never_below_the_capture_path(spark):
    rng = np.random.default_rng(0)
    rows = [("s", "max", float(60 * i), rng.integers(0, 255, 8).tolist()) for i in range(2000)]
    c = spark.createDataFrame(rows, "sensor string, stat string, t double, spec array<smallint>")
    w = spark.createDataFrame([("w", "s", 0.0, 120_000.0)], "window_id string, sensor string, t0 double, t1 double")
    g = quant.Geometry(n=8)
    levels = {600: pyramid.psd_level(c, 600, by=("sensor",))}
    fine = {(r["col"], r["r"]): r["q"] for r in windows.spectrum_window(c, w, 100, 4, g).collect()}
    coarse = {(r["col"], r["r"]): r["q"] for r in windows.spectrum_window(c, w, 100, 4, g, levels=levels).collect()}
    assert fine.keys() == coarse.keys() and all(coarse[k] >= v for k, v in fine.items())
    assert fine == coarse  # 1,200 s columns are whole buckets


def test_empty_window_takes_the_capture_before(spark):
    c = spark.createDataFrame([("s", "max", 10.0, [1, 2]), ("s", "max", 20.0, [3, 4]), ("z", "max", 500.0, [5, 6])], "sensor string, stat string, t double, spec array<smallint>")
    w = spark.createDataFrame([("a", "s", 30.0, 40.0), ("b", "s", 0.0, 5.0), ("c", "none", 0.0, 5.0)], "window_id string, sensor string, t0 double, t1 double")
    found = {(r["window_id"], r["r"]): (r["q"], r["gap"]) for r in windows.spectrum_window(c, w, 3, 2, quant.Geometry(n=2)).filter("col = 2").collect()}
    assert found == {("a", 0): (3, True), ("a", 1): (4, True), ("b", 0): (1, True), ("b", 1): (2, True)}


def test_ties_go_to_even(spark):
    rows = spark.createDataFrame([([float(-180 + 3 * k) for k in range(1, 30, 2)],)], "v array<double>")
    q = rows.select(quant.quantize(F.col("v"), -180, -90)).first()[0]
    assert q == [int(np.rint((3 * k) / 90 * 255)) for k in range(1, 30, 2)] and all(x % 2 == 0 for x in q)


def test_band():
    g = quant.Geometry()
    assert quant.band(0, 0, g) == (0, 2249) and quant.band(3_531e6, 3_530.5e6, g) == (0, 2249)
    assert quant.band(3_530_840_000, 3_531_640_000, g) == (10, 20)


def test_straddling_day(spark):
    day = 86_400
    stored = spark.createDataFrame([("s", d * day + x) for d in range(1, 4) for x in (100.0, 200.0, 300.0, 400.0, day + 22.0)], "sensor string, t double")
    todo = spark.createDataFrame([("s", 1, day + 100.0), ("s", 4, 4 * day + 50.0), ("s", 4, 4 * day + 22.0), ("s", 9, None)], "sensor string, day long, first_t double")
    found = sorted((r["day"], r["stored"], r["ingested"]) for r in store.resume_plan(todo, stored).collect())
    assert found == [(1, 4, True), (4, 1, False), (4, 1, True), (9, 0, False)]


def test_top_up_equals_a_full_build(spark):
    c = spark.range(3000).select(F.lit("s").alias("sensor"), F.lit("max").alias("stat"), (F.col("id") * 97).cast("double").alias("t"), F.array(F.col("id") % 251, F.col("id") % 17).cast("array<smallint>").alias("spec"))
    old = pyramid.psd_level(c.filter("t < 150000"), 3600)
    key = lambda df: sorted((r["t"], tuple(r["smax"])) for r in df.collect())
    assert key(pyramid.top_up(old, c, 150_000, 3600)) == key(pyramid.psd_level(c, 3600))


def test_chunks(spark):
    c = spark.range(1000).select(F.lit("s").alias("sensor"), (F.col("id") * 900).cast("double").alias("t"), F.array("id").alias("v"))
    rows = sorted(store.pack(c, ["sensor"], 256, "v").collect(), key=lambda r: r["chunk"])
    assert [r["n"] for r in rows] == [256, 256, 256, 232] and [x["t"] for x in rows[1]["caps"]] == [900.0 * i for i in range(256, 512)]


def test_merge_refuses_other_schemas(spark):
    a, b = spark.createDataFrame([(1, 2)], "sensor int, t int"), spark.createDataFrame([(1, 2)], "sensor int, x int")
    with pytest.raises(ValueError):
        store.merge_units(a, b, "sensor")


def test_summary_and_export_files(spark, tmp_path):
    (tmp_path / "y1").mkdir()
    head = "sensor_name,channel_frequency_mhz,timestamp,max,median,mean\n"
    (tmp_path / "y1" / "a.csv").write_text(head + "S1,3555.0,2024-03-04 00:05:00+00,-70.0,-75.0,-80.0\n")
    (tmp_path / "b.csv").write_text(head + "S1,3555.0,2025-03-04T00:05:00+05:30,-60.0,-65.0,-70.0\n")
    (tmp_path / "bad.csv").write_text(head + "S1,3555.0,2025-03-04 00:05:00+00,oops,-65.0,-70.0\n")
    ok, bad = exports.read_summaries(spark, str(tmp_path))
    assert sorted(r["t"] for r in ok.collect()) == [1709510700.0, 1741026900.0]
    assert [r["file"].endswith("bad.csv") for r in bad.collect()] == [True]
    (tmp_path / "psd").mkdir()
    (tmp_path / "psd" / "2024-03-04_A_B_max.csv").write_text("datetime,b0,b1\n2024-03-04T00:00:00Z,-100.5,-99\n2024-03-04 00:01:30,,-99\n")
    (tmp_path / "psd" / "2024-03-05_A_B_max.csv").write_text("datetime,b0,b1\n")
    (tmp_path / "psd" / "2024-03-06_A_B_max.csv").write_text("datetime,b0,b1\n2024-03-06,-100\nx,-1,-2\n")
    rows = exports.read_exports(spark, str(tmp_path / "psd"))
    listed = files.list_files(spark, str(tmp_path / "psd")).select(F.col("name").alias("file"))
    found = sorted((r["file"][:10], r["reason"], r["n"]) for r in store.rejects(rows, 2, listed).collect())
    assert found == [("2024-03-04", "nonfinite", 1), ("2024-03-05", "empty", 0), ("2024-03-06", "blank_ts", 1), ("2024-03-06", "geometry", 1)]
    kinds = files.classify(files.list_files(spark, str(tmp_path / "psd")).withColumn("header", F.lit("")))
    assert {(r["kind"], r["sensor"], r["stat"]) for r in kinds.collect()} == {("psd", "A_B", "max")}


def sigmf_capture(folder, name, datatype, raw, rate=2e6, declared=None, key="core:frequency"):
    meta = {"global": {"core:datatype": datatype, "core:sample_rate": rate}, "captures": [{"core:sample_start": 0}], "annotations": []}
    (meta["captures"][0] if key == "core:frequency" else meta["global"])[key] = 2.4e9
    if declared is not None:
        meta["annotations"] = [{"core:sample_start": 5, "core:sample_count": declared - 5, "core:label": "x"}]
    (folder / f"{name}.sigmf-meta").write_text(json.dumps(meta))
    if raw is not None:
        (folder / f"{name}.sigmf-data").write_bytes(raw)


@pytest.mark.parametrize("datatype", list(iq.FORMATS))
def test_captures_on_disk(spark, tmp_path, datatype):
    kind, numbers, _ = iq.FORMATS[datatype]
    raw = (np.arange((16 * 300 + 5) * numbers) % 100).astype(kind).tobytes()
    sigmf_capture(tmp_path, "one", datatype, raw, declared=16 * 300)
    found = iq.catalogue(spark, str(tmp_path)).collect()
    assert [(r["name"], r["samples"], r["fault"], r["center"], r["sample_rate"]) for r in found] == [("one", 16 * 300 + 5, None, 2.4e9, 2e6)]
    rows = {r["frame"]: (r["i"], r["q"]) for r in iq.read_captures(spark, str(tmp_path), 16).collect()}
    want = iq.decode_samples(raw, datatype)[: 16 * 300]
    assert sorted(rows) == list(range(300))
    assert np.allclose(np.concatenate([rows[k][0] for k in range(300)]), want.real) and np.allclose(np.concatenate([rows[k][1] for k in range(300)]), want.imag)


def test_captures_with_faults_are_refused(spark, tmp_path):
    raw = np.arange(64, dtype="<c8").tobytes()
    sigmf_capture(tmp_path, "short", "cf32_le", raw, declared=65)
    sigmf_capture(tmp_path, "ragged", "cf32_le", raw + b"abc")
    sigmf_capture(tmp_path, "kind", "rf32_le", raw)
    sigmf_capture(tmp_path, "rate", "cf32_le", raw, rate=0)
    sigmf_capture(tmp_path, "lost", "cf32_le", None)
    sigmf_capture(tmp_path, "none", "cf32_le", b"")
    sigmf_capture(tmp_path, "good", "cf32_le", raw, declared=64, key="x:center_frequency")
    xml = "<RS><Name>d</Name><Samples>{n}</Samples><Clock unit='Hz'>6e8</Clock><Format>complex</Format><DataType>float32</DataType><ScalingFactor unit='V'>2</ScalingFactor><NumberOfChannels>{c}</NumberOfChannels><CenterFrequency unit='Hz'>9e8</CenterFrequency></RS>"
    for name, n, c in (("tar", 64, 1), ("tar_short", 65, 1), ("tar_two", 64, 2)):
        (tmp_path / f"{name}.iq").mkdir()
        (tmp_path / f"{name}.iq" / "File_1.complex1ch.float32").write_bytes(raw)
        (tmp_path / f"{name}.iq" / "File_1.complex1ch.float32.xml").write_text(xml.format(n=n, c=c))
    np.save(tmp_path / "array.npy", np.arange(40) * 1j)
    np.save(tmp_path / "real.npy", np.arange(40))
    rows = {r["name"]: r for r in iq.catalogue(spark, str(tmp_path)).collect()}
    assert {n: r["fault"] for n, r in rows.items()} == {"short": "truncated", "ragged": "ragged", "kind": "datatype", "rate": "sample rate", "lost": "no data", "none": "no data", "good": None, "tar.iq": None, "tar_short.iq": "truncated", "tar_two.iq": "datatype"}
    assert rows["good"]["center"] == 2.4e9 and (rows["tar.iq"]["center"], rows["tar.iq"]["sample_rate"]) == (9e8, 6e8)
    frames = {}
    for r in iq.read_captures(spark, str(tmp_path), 16).collect():
        frames.setdefault(r["id"], []).append((r["frame"], sum(r["i"]), sum(r["q"])))
    assert sorted(frames[rows["good"]["id"]])[:2] == [(0, 120.0, 0.0), (1, 376.0, 0.0)] and sorted(frames[rows["tar.iq"]["id"]])[0] == (0, 240.0, 0.0)
    assert len(frames) == 3 and sorted(len(v) for v in frames.values()) == [2, 4, 4]
    # the whole way: pyramid, scale, metadata
    spectra = iq.stft(iq.read_captures(spark, str(tmp_path), 16), 16)
    ranges = iq.quantization_range(spectra)
    levels = iq.levels(spectra, ranges, 2)
    captures = iq.catalogue(spark, str(tmp_path)).withColumn("dataset", F.lit("d"))
    meta = {r["name"]: r for r in iq.metadata(captures, levels, ranges, iq.display_scale(levels, ranges), 16).collect()}
    assert len(meta["good"]) == 16 and meta["good"]["n_levels"] == 2 and meta["tar.iq"]["duration"] == 64 / 6e8


def test_sparse_pass_counts_overlapping_stretches(spark):
    rng = np.random.default_rng(2)
    for n in (3, 70, 200, 64 * 40):
        db = rng.normal(size=n)
        step, taken = max(1, n // 64), []
        for at in range(0, n, step):
            taken.extend(db[at : min(n, at + 32)])
        rows = spark.createDataFrame([(1, k, [float(v)]) for k, v in enumerate(db)], "id int, frame long, dbm array<double>")
        r = iq.quantization_range(rows).first()
        assert np.allclose([r["qmin"], r["qmax"]], np.percentile(taken, [0.1, 99.9]) + [-6, 6])


def test_a_tone_lands_in_its_bin(spark):
    t = np.arange(64 * 4)
    x = np.exp(2j * np.pi * t * 10 / 64)
    s = spark.createDataFrame([(1, int(k), float(v.real), float(v.imag)) for k, v in zip(t, x, strict=True)], "id int, sample long, i double, q double")
    for r in iq.stft(iq.frames(s, 64), 64).collect():
        assert int(np.argmax(r["dbm"])) == 32 + 10


def test_reconciliation_finds_each_damage(spark):
    g = quant.Geometry(n=2)
    source = spark.createDataFrame([("s", "max", float(t), [-120.0 + t, -200.0]) for t in range(20)], "sensor string, stat string, t double, values array<double>")
    good = source.select("sensor", "stat", "t", quant.quantize(F.col("values"), g.qmin, g.qmax).alias("spec"))
    both = recon.cells(source, good)
    assert recon.values(both, g).first()["n_bad"] == 0 and recon.clipped(both, g).first()["n_bad"] == 0 and recon.bias(both, g).first()["ok"]
    spoiled = good.withColumn("spec", F.when(F.col("t") == 7, F.array(F.col("spec")[0] + 3, F.lit(9)).cast("array<smallint>")).otherwise(F.col("spec")))
    both = recon.cells(source, spoiled)
    assert recon.values(both, g).first()["n_bad"] == 1 and recon.clipped(both, g).first()["n_bad"] == 1 and recon.bytes_equal(both, g).first()["n_bad"] == 2
    lost = good.filter("t <> 3").unionByName(good.filter("t = 4")).unionByName(good.filter("t = 5").withColumn("t", F.lit(99.0)))
    r = recon.presence(source, lost).first()
    assert (r["missing"], r["extra"], r["twice"]) == (1, 1, 1)
    foreign = good.withColumn("stat", F.lit("other"))
    seen = {r["stat"]: r for r in recon.presence(source, good.unionByName(foreign)).collect()}
    assert (seen["other"]["source_n"], seen["other"]["extra"], seen["max"]["extra"]) == (0, 20, 0)
    checks = {(r["stat"], r["check"]): r["ok"] for r in recon.report(source, good.unionByName(foreign), g).collect()}
    assert all(checks["max", c] for c in ("values", "codes", "clipped", "presence"))
    assert not any(checks["other", c] for c in ("values", "codes", "presence"))  # nothing was compared
    level = pyramid.psd_level(good, 600)
    assert {r["state"] for r in recon.pyramid(level.limit(0), level, ["stat", "sensor", "t"]).collect()} == {"missing"}


def test_a_packed_layer_is_not_packed_again(spark):
    layer = spark.createDataFrame([("s", 1.0, 10.4, -70.25, -75.0, -80.04)], "sensor string, freq double, t double, mx double, md double, mn double")
    packed = store.pack_summaries(layer)
    assert tuple(packed.select("sensor", "freq", "t", "mx", "md", "mn", "scale").first()) == ("s", 1.0, 10, -703, -750, -800, 10)
    with pytest.raises(ValueError, match="already"):
        store.pack_summaries(packed)


def test_nothing_usable_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("sensor_name,channel_frequency_mhz,timestamp,max,median,mean\nS1,x,2025-03-04 00:05:00+00,1,2,3\n")
    ok, bad = exports.read_summaries(spark, str(tmp_path))
    with pytest.raises(ValueError, match="bad.csv"):
        exports.usable(ok, bad)
    (tmp_path / "good.csv").write_text("sensor_name,channel_frequency_mhz,timestamp,max,median,mean\nS1,3555,2025-03-04 00:05:00+00,1,2,3\n")
    assert exports.usable(*exports.read_summaries(spark, str(tmp_path))).count() == 1
