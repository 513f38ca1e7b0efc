"""Streams by hand: lateness beyond any watermark, retries, exports that keep arriving."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bandloom.operators import publish, pyramid, store
from bandloom.plans.streams import rocks
from bandloom.streaming import streams

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1, 6)


def arrive(spark, place, number, rows):
    spark.createDataFrame(rows, "id long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{place}/in")
    return streams.file_stream(spark, f"{place}/in", "id long, ts timestamp, v double", per_trigger=1)


def test_each_capture_once_over_a_year(spark, tmp_path):
    place = str(tmp_path)
    batches = [[(i, START + DAY * (i * 37 % 365), float(i)) for i in range(k, 300, 3)] for k in range(3)]
    batches.append([row for b in batches for row in b[::4]] + [(0, START, 0.0)] * 3)  # all over the year again
    for k, rows in enumerate(batches):
        streams.once(arrive(spark, place, k, rows), f"{place}/out", f"{place}/check", ["id"])
    found = spark.read.parquet(f"{place}/out").select("id", "v").collect()
    assert sorted((r["id"], r["v"]) for r in found) == [(i, float(i)) for i in range(300)]


def test_late_rows_have_a_table_of_their_own(spark, tmp_path):
    place = str(tmp_path)
    batches = [[(1, START, 0.0), (2, START + 9 * DAY, 0.0)], [(3, START + 8.5 * DAY, 0.0), (4, START + 2 * DAY, 0.0), (5, START + 20 * DAY, 0.0)], [(6, START + 18 * DAY, 0.0), (7, START + 19.5 * DAY, 0.0)]]
    for k, rows in enumerate(batches):
        streams.split_late(arrive(spark, place, k, rows), f"{place}/out", f"{place}/late", f"{place}/check", 86_400)
    ids = lambda name: sorted(r["id"] for r in spark.read.parquet(f"{place}/{name}").collect())
    assert ids("out") == [1, 2, 3, 5, 7] and ids("late") == [4, 6]


def test_exports_that_arrive(spark, tmp_path):
    src, place = tmp_path / "src", str(tmp_path)
    src.mkdir()
    write = lambda name, *lines: (src / name).write_text("datetime,b0,b1\n" + "".join(f"{x}\n" for x in lines))
    write("2024-03-04_A_B_max.csv", "2024-03-04T00:00:00Z,-180,-90", "2024-03-04T00:01:30Z,-135,-200")
    write("2024-03-04_A_B_mean.csv", "2024-03-04T00:00:00Z,-180,-90", "2024-03-04T00:01:30Z,-135")
    write("notes.csv", "x,1,2")
    for _ in range(2):
        streams.ingest_exports(spark, str(src), f"{place}/layer", f"{place}/check", 2, -180.0, -90.0)
    write("2024-03-05_A_B_max.csv", "2024-03-05T00:00:00Z,-90,-180")
    streams.ingest_exports(spark, str(src), f"{place}/layer", f"{place}/check", 2, -180.0, -90.0)
    found = sorted((r["sensor"], r["stat"], r["t"], r["spec"]) for r in spark.read.parquet(f"{place}/layer").collect())
    assert found == [("A_B", "max", 1709510400.0, [0, 255]), ("A_B", "max", 1709510490.0, [128, 0]), ("A_B", "max", 1709596800.0, [255, 0])]


def test_append_is_by_whole_files_and_repeatable(spark, tmp_path):
    rows = [("a", 1.0, [1.0, 2.0]), ("a", 2.0, [1.0, 2.0]), ("b", 1.0, [1.0]), ("c", None, [1.0, None])]
    captures, place = spark.createDataFrame(rows, "file string, t double, values array<double>"), str(tmp_path / "t")
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    for _ in range(2):
        report = publish.append_captures(captures, 2, place, listed)
        assert sorted((r["file"], r["n"], r["t_max"], r["reason"]) for r in report.collect()) == [("a", 2, 2.0, None), ("b", 0, None, "geometry"), ("c", 0, None, "blank_ts,nonfinite"), ("d", 0, None, "empty")]
    more = captures.filter("file = 'a'").withColumn("file", F.lit("e"))
    assert [r["file"] for r in publish.append_captures(more, 2, place).collect()] == ["e"]
    now = publish.live(spark, place)
    assert {(r["file"], r["count"]) for r in now.read(spark, "captures").groupBy("file").count().collect()} == {("a", 2), ("e", 2)}
    assert now.number == 3 and publish.sweep(spark, place) == []  # the second run's list of refused files counts as well
    assert publish.live(spark, place).read(spark, "captures").count() == 4


def test_what_is_not_committed_is_not_there(spark, tmp_path, monkeypatch):
    captures, place = spark.createDataFrame([("a", 1.0, [1.0])], "file string, t double, values array<double>"), str(tmp_path / "t")
    publish.append_captures(captures, 1, place)
    killed = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    with monkeypatch.context() as m:
        m.setattr(publish, "commit", killed)
        with pytest.raises(RuntimeError, match="killed"):
            publish.append_captures(captures.withColumn("file", F.lit("b")), 1, place)
    now = publish.live(spark, place)
    assert now.number == 1 and [r.file for r in now.read(spark, "captures").collect()] == ["a"] == [r.file for r in now.read(spark, "files").collect()]
    publish.append_captures(captures.withColumn("file", F.lit("b")), 1, place)
    assert publish.live(spark, place).read(spark, "captures").count() == 2


def test_of_two_writers_one_is_refused(spark, tmp_path):
    place = str(tmp_path / "t")
    base = publish.live(spark, place)
    one, two = (publish.stage(spark.range(n), place) for n in (1, 2))
    assert publish.commit(spark, base, {"rows": [one]}).number == 1
    with pytest.raises(publish.Refused, match="meanwhile"):
        publish.commit(spark, base, {"rows": [two]})
    assert publish.live(spark, place).read(spark, "rows").count() == 1


def test_what_must_not_be_published(spark, tmp_path):
    place, by = str(tmp_path / "t"), ["sensor"]
    rows = lambda *r: spark.createDataFrame(list(r), "sensor string, t double")
    full = rows(("x", 1.0), ("x", 2.0), ("y", 1.0))
    now = publish.publish(spark, publish.live(spark, place), publish.stage(full, place), "rows", full, by)
    for staged, source, why in ((rows(("x", 1.0), ("x", 2.0)), full, "y refuse: empty"), (full, full.union(rows(("y", 3.0))), "y refuse: stale")):
        with pytest.raises(publish.Refused, match=why):
            publish.publish(spark, now, publish.stage(staged, place), "rows", source, by)
    both = publish.commit(spark, now, now.parts | {"chunks": [publish.stage(rows(("y", 9.0)), place)]})
    with pytest.raises(publish.Refused, match="both shapes"):
        publish.publish(spark, both, publish.stage(full, place), "rows", full, by, other="chunks")
    assert publish.live(spark, place).number == 2
    assert publish.publish(spark, now := publish.live(spark, place), publish.stage(full, place), "rows", full, by).number == now.number + 1


def test_a_batch_reads_its_own_days_only(spark, tmp_path, monkeypatch):
    """Over 50 batches, each of two days that half of the earlier ones did not have: what is read does not grow."""
    place, read = str(tmp_path), []
    found = streams.stored_days
    monkeypatch.setattr(streams, "stored_days", lambda s, t, d: (read.append(0 if (x := found(s, t, d)) is None else len(x.inputFiles())), x)[1])
    batches = [[(k * 10 + i, START + DAY * (k + i % 2), 0.0) for i in range(6)] + ([(k * 10 - 10, START + DAY * (k - 1), 0.0)] if k else []) for k in range(50)]
    for k, rows in enumerate(batches):
        arrive(spark, place, k, rows)
    streams.once(streams.file_stream(spark, f"{place}/in", "id long, ts timestamp, v double", per_trigger=1), f"{place}/out", f"{place}/check", ["id"])
    assert len(read) == 50 and max(read[40:]) <= max(read[2:10]) and max(read) <= 6
    assert spark.read.parquet(f"{place}/out").count() == 300


@pytest.mark.parametrize("order", [1, 2])
def test_vector_levels_in_any_order_of_files(spark, tmp_path, order):
    """Captures two buckets late go to the side table, null and missing places count for nothing, state holds open buckets only."""
    rng, place = random.Random(order), str(tmp_path)
    rows = [("s" if k % 3 else "r", "max", START + dt.timedelta(seconds=97 * k), [rng.randrange(256) if rng.random() > 0.1 else None for _ in range(rng.choice([3, 4]))]) for k in range(400)]
    shape = "sensor string, stat string, ts timestamp, spec array<smallint>"
    parts = [rows[k : k + 20] for k in range(0, 400, 20)]
    rng.shuffle(parts)
    for part in parts:
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{place}/in")
    with rocks(spark):
        for _ in range(2):  # the second finds nothing new
            streams.stream_level(spark, streams.file_stream(spark, f"{place}/in", shape, per_trigger=1), place, 600, 1200)
    key = lambda df: sorted(tuple(r) for r in df.select("sensor", "stat", "t", "smax").collect())
    whole = spark.createDataFrame(rows, shape).withColumn("t", F.unix_micros("ts") / 1e6)
    assert key(streams.level_so_far(spark, place, 600, 1200)) == key(pyramid.psd_level(whole, 600, ("sensor", "stat")))
    late = spark.read.schema(shape).parquet(f"{place}/late").count()
    closed = spark.read.option("recursiveFileLookup", True).parquet(f"{place}/closed")
    assert late > 0 and closed.count() == closed.select("sensor", "stat", "t").distinct().count() > 0


def test_kinds_and_shapes(spark):
    assert [store.identify(c) for c in (["sensor", "t", "spec", "x"], ["sensor", "freq", "t", "spec"], ["sensor", "freq", "t", "mx", "md", "mn"], ["t"])] == ["psd", "pfp", "summaries", None]
    rows, chunks = (spark.createDataFrame([(s, 1) for s in names], "sensor string, n int") for names in ("ab", "bc"))
    assert [r["sensor"] for r in store.in_both_shapes(rows, chunks, ["sensor"]).collect()] == ["b"]
