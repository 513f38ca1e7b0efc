"""Complex captures: frames, short-time spectra, their quantized pyramid."""

from __future__ import annotations

import io
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.listing import contents, files_below
from ..sources.places import exists, remove_tree, shared_place
from ..sources.ranges import in_tasks, opened, reachable, read_fully, share
from .pyramid import coarsest_level, column_levels, plain, runs


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    return rows.repartition(tasks, *by) if tasks else rows.repartition(*by)


#: Neighbouring frames that one task takes, so that what is pooled later lies together.
STRETCH = 64


def frames(samples: DataFrame, nfft: int, tasks: int | None = None) -> DataFrame:
    """``samples(id, sample, i, q)`` in whole frames ``id, frame, i, q``; a short last one is dropped.

    Samples are sorted in their tasks, of which there are ``tasks`` (as many as Spark chooses, without),
    and cut where the frame changes.
    """
    kind = samples.schema["id"].dataType.simpleString()
    return _sorted_samples(samples, nfft, tasks).mapInArrow(_framed(nfft), f"id {kind}, frame long, i array<double>, q array<double>")


def stft(frame_rows: DataFrame, nfft: int) -> DataFrame:
    """``id, frame, dbm``: shifted power spectra under a symmetric Hann window, in dBm at 50 ohms."""
    kind = frame_rows.schema["id"].dataType.simpleString()
    return frame_rows.select("id", "frame", "i", "q").mapInArrow(_transformed(nfft), f"id {kind}, frame long, dbm array<double>")


def spectra(samples: DataFrame, nfft: int, tasks: int | None = None) -> DataFrame:
    """``stft`` of ``frames`` in one pass: frames do not leave the task's Python in between."""
    framed, transformed = _framed(nfft), _transformed(nfft)
    kind = samples.schema["id"].dataType.simpleString()
    return _sorted_samples(samples, nfft, tasks).mapInArrow(lambda batches: transformed(framed(batches)), f"id {kind}, frame long, dbm array<double>")


def _sorted_samples(samples: DataFrame, nfft: int, tasks: int | None) -> DataFrame:
    frame = F.floor(F.col("sample") / nfft).cast("long")
    rows = samples.select("id", frame.alias("frame"), "sample", F.col("i").cast("double").alias("i"), F.col("q").cast("double").alias("q"))
    moved = dealt(rows.withColumn("stretch", F.floor(F.col("frame") / STRETCH)), tasks, "id", "stretch")
    return moved.sortWithinPartitions("id", "frame", "sample", "i", "q").select("id", "frame", "i", "q")


def _framed(nfft: int):
    def whole(batch, edges):
        sizes = np.diff(edges)
        full = np.repeat(sizes == nfft, sizes)
        kept = batch.filter(pa.array(full))
        first = pa.array(edges[:-1][sizes == nfft])
        offsets = pa.array(np.arange(0, kept.num_rows + 1, nfft), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, kept.column(c)) for c in ("i", "q")]
        return pa.RecordBatch.from_arrays([batch.column("id").take(first), batch.column("frame").take(first), *lists], ["id", "frame", "i", "q"])

    def run(batches):
        """The last frame of a batch waits for the next; of one with too many samples no more than tell it."""
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = plain(batch, "")
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            edges = runs(batch, ["id", "frame"])
            waiting = batch.slice(edges[-2], min(nfft + 1, edges[-1] - edges[-2]))
            if len(edges) > 2:
                yield whole(batch.slice(0, edges[-2]), edges[:-1])
        if waiting is not None:
            yield whole(waiting, np.array([0, waiting.num_rows]))

    return run


def _transformed(nfft: int):
    def run(batches):
        window = np.hanning(nfft)
        scale = (window**2).sum() * nfft
        for batch in batches:
            i, q = (np.asarray(batch.column(k).flatten()).reshape(-1, nfft) for k in (2, 3))
            power = np.abs(np.fft.fftshift(np.fft.fft((i + 1j * q) * window, axis=1), axes=1)) ** 2 / scale
            dbm = 10 * np.log10(np.maximum(power / 50 * 1000, 1e-30))
            offsets = pa.array(np.arange(0, dbm.size + 1, nfft), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(dbm.ravel()))], ["id", "frame", "dbm"])

    return run


def weighted_percentiles(values: np.ndarray, times: np.ndarray, shares) -> list[float]:
    """Those of ``values``, of which each counts ``times`` times; between two by the distance of the rank."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(times[order])
    at = (upto[-1] - 1) * np.asarray(shares)
    low, high = (values[order[np.searchsorted(upto, end(at), "right")]] for end in (np.floor, np.ceil))
    rest = at - np.floor(at)
    return [float(a) if r == 0 else float((1 - r) * a + r * b) for a, b, r in zip(low, high, rest, strict=True)]


def quantization_range(spectra: DataFrame, tasks: int | None = None) -> DataFrame:
    """By capture: percentiles 0.1 and 99.9 of a sparse pass over its frames, 6 dB wider: id, qmin, qmax.

    The pass takes stretches of up to 32 frames that begin a sixty-fourth of the capture apart;
    where stretches overlap, a frame counts once for each. So a capture has some 4,000 frames in it at
    most, which one of the ``tasks`` holds at a time.
    """
    total = spectra.groupBy("id").agg((F.max("frame") + 1).alias("n"))  # a row for each capture
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 64))
    times = F.floor(F.col("frame") / step) - F.ceil(F.greatest(F.lit(0), F.col("frame") - 31) / step) + 1
    some = spectra.join(total, "id").withColumn("times", times.cast("long")).filter("times > 0").select("id", "times", "dbm")

    def one(id_, parts):
        x = np.concatenate([np.asarray(p.column("dbm").flatten()) for p in parts])
        c = np.concatenate([np.repeat(np.asarray(p.column("times")), np.diff(np.asarray(p.column("dbm").offsets))) for p in parts])
        low, high = weighted_percentiles(x, c, (0.001, 0.999))
        return id_, low - 6, high + 6

    def run(batches):
        """Rows come in order of the capture; the last of a batch waits for the next."""
        waiting, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            edges = runs(batch, ["id"])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                id_ = batch.column("id")[a].as_py()
                if waiting and id_ != key:
                    out.append(one(key, waiting))
                    waiting = []
                # a copy of the rows alone, so that their batch can go
                waiting.append(batch.slice(a, b - a).take(pa.array(np.arange(b - a))))
                key = id_
            yield rows_of(out)
        if waiting:
            yield rows_of([one(key, waiting)])

    field = pa.string() if spectra.schema["id"].dataType.simpleString() == "string" else pa.int64()

    def rows_of(out):
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (field, pa.float64(), pa.float64()), strict=True)], ["id", "qmin", "qmax"])

    kind = spectra.schema["id"].dataType
    found = dealt(some, tasks, "id").sortWithinPartitions("id").mapInArrow(run, f"id {'string' if field == pa.string() else 'long'}, qmin double, qmax double")
    return found.withColumn("id", F.col("id").cast(kind))


def columns(spectra: DataFrame, ranges: DataFrame) -> DataFrame:
    """Quantized columns of the finest level: id, col, bins."""
    joined = spectra.join(ranges, "id")
    share = lambda x: (x - F.col("qmin")) / (F.col("qmax") - F.col("qmin"))
    scaled = F.transform("dbm", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(share(x) * 255))).cast("smallint"))
    return joined.select("id", F.col("frame").alias("col"), scaled.alias("bins"))


#: Columns of the coarsest level, at most.
COARSEST = 2048


def levels(spectra: DataFrame, ranges: DataFrame, coarsest: int = COARSEST, tasks: int | None = None) -> DataFrame:
    """The whole pyramid of every capture: level, id, col, bins."""
    return column_levels(columns(spectra, ranges), coarsest, tasks)


def last_levels(spectra: DataFrame, ranges: DataFrame, coarsest: int = COARSEST, tasks: int | None = None) -> DataFrame:
    """Of ``levels`` each capture's coarsest alone, which is what ``display_scale`` reads."""
    return coarsest_level(columns(spectra, ranges), coarsest, tasks)


def display_scale(pyramid: DataFrame, ranges: DataFrame, least: float = 6.0, tasks: int | None = None) -> DataFrame:
    """Percentiles 2 and 98 of each capture's coarsest level, at least ``least`` dB apart, to a tenth: id, vmin, vmax.

    Captures are dealt to ``tasks`` tasks (as many as Spark chooses, without), where codes are counted.
    """
    last = pyramid.groupBy("id").agg(F.max("level").alias("level"))
    codes = dealt(pyramid.join(last, ["id", "level"]).select("id", "bins"), tasks, "id").select("id", F.explode("bins").alias("q"))
    counted = codes.groupBy("id", "q").agg(F.count("q").alias("c"))  # at most 256 codes a capture
    own = W.partitionBy("id")
    ranked = counted.withColumn("upto", F.sum("c").over(own.orderBy("q").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(own))
    at = lambda share: (F.col("n") - 1) * F.lit(share)
    code = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("q")))
    ends = [code(end(at(share))).alias(f"{end.__name__}{k}") for k, share in enumerate((0.02, 0.98)) for end in (F.floor, F.ceil)]
    found = ranked.groupBy("id").agg(F.first("n").alias("n"), *ends).join(ranges, "id")
    x = lambda q: F.col("qmin") + F.col(q) / F.lit(255.0) * (F.col("qmax") - F.col("qmin"))

    def between(k: int, share: float) -> Column:
        rest = at(share) - F.floor(at(share))
        return F.when(rest == 0, x(f"floor{k}")).otherwise((1 - rest) * x(f"floor{k}") + rest * x(f"ceil{k}"))

    p = found.select("id", between(0, 0.02).alias("low"), between(1, 0.98).alias("high"))
    low, high = F.col("low"), F.col("high")
    return p.select("id", F.round(low, 1).alias("vmin"), F.round(F.when(high - low < least, low + least).otherwise(high), 1).alias("vmax"))


def metadata(captures: DataFrame, pyramid: DataFrame, ranges: DataFrame, scale: DataFrame, nfft: int) -> DataFrame:
    """One row a capture ``(id, dataset, name, path, center, sample_rate, samples)``: what it is, its pyramid and its scales."""
    n = pyramid.groupBy("id").agg((F.max("level") + 1).cast("int").alias("n_levels"))
    size = lambda name: F.lit(nfft).alias(name)
    return captures.join(n, "id").join(ranges, "id").join(scale, "id").select(
        "id", "dataset", "name", "path", F.col("center").alias("fc"), F.col("sample_rate").alias("fs"),
        (F.col("samples") / F.col("sample_rate")).alias("duration"), F.col("samples").alias("n_samples"),
        size("nfft"), size("hop"), size("n_bins"), "n_levels", "qmin", "qmax", "vmin", "vmax",
    )


def window(pyramid: DataFrame, meta: DataFrame, requests: DataFrame, nfft: int) -> DataFrame:
    """Cells of each request ``(window_id, id, t0, t1, f0, f1, w, h)``: window_id, level, col, r, q, dbm.

    Requests are clipped to the capture; an empty rest gives no rows. The finest level with at
    most ``2 * w`` columns answers, else the coarsest; bins are pooled to at most ``h`` rows.
    """
    m = meta.select("id", "fc", "fs", "duration", "n_levels", "qmin", "qmax")
    low = F.col("fc") - F.col("fs") / 2
    asked = requests.join(m, "id").withColumn("low", low)
    asked = asked.withColumn("t0", F.greatest(F.lit(0.0), "t0")).withColumn("t1", F.least("duration", "t1"))
    asked = asked.withColumn("f0", F.greatest("low", "f0")).withColumn("f1", F.least(F.col("low") + F.col("fs"), F.col("f1"))).filter("t1 > t0 and f1 > f0")
    span = (F.col("t1") - F.col("t0")) * F.col("fs") / nfft
    fits = F.array_min(F.filter(F.sequence(F.lit(0), F.col("n_levels") - 1), lambda k: span / F.pow(F.lit(2.0), k) <= 2 * F.col("w")))
    asked = asked.withColumn("level", F.coalesce(fits, F.col("n_levels") - 1))
    width = nfft * F.pow(F.lit(2.0), F.col("level")) / F.col("fs")
    df = F.col("fs") / nfft
    asked = asked.withColumn("c0", F.floor(F.col("t0") / width)).withColumn("c1", F.greatest(F.col("c0") + 1, F.ceil(F.col("t1") / width)))
    asked = asked.withColumn("b0", F.floor((F.col("f0") - F.col("low")) / df).cast("int"))
    asked = asked.withColumn("b1", F.least(F.lit(nfft), F.greatest(F.col("b0") + 1, F.ceil((F.col("f1") - F.col("low")) / df))).cast("int"))
    inside = pyramid.join(asked, ["id", "level"]).filter("col >= c0 and col < c1")
    n = F.col("b1") - F.col("b0")
    group = F.greatest(F.lit(1), F.ceil(n / F.col("h"))).cast("int")
    band = F.slice("bins", F.col("b0") + 1, n)
    rows = F.transform(F.sequence(F.lit(0), F.ceil(n / F.col("group")).cast("int") - 1), lambda r: F.array_max(F.slice(F.col("band"), r * F.col("group") + 1, F.col("group"))))
    cut = inside.withColumn("group", group).withColumn("band", band).select("window_id", "level", "col", "qmin", "qmax", F.posexplode(rows).alias("r", "q"))
    return cut.select("window_id", "level", "col", "r", "q", (F.col("qmin") + F.col("q") / F.lit(255.0) * (F.col("qmax") - F.col("qmin"))).alias("dbm"))


# --- captures on disk -------------------------------------------------------------------------

#: Sample formats, as (numpy type, numbers a sample, scale).
FORMATS = {
    "cf64_le": ("<c16", 1, 1.0), "cf64_be": (">c16", 1, 1.0), "cf32_le": ("<c8", 1, 1.0), "cf32_be": (">c8", 1, 1.0),
    "ci32_le": ("<i4", 2, 1 / 2147483648), "ci32_be": (">i4", 2, 1 / 2147483648), "ci16_le": ("<i2", 2, 1 / 32768), "ci16_be": (">i2", 2, 1 / 32768),
    "ci8": ("i1", 2, 1 / 128), "cu8": ("u1", 2, 1 / 128),
}
#: The endings of data files, of the sidecars that describe them, and of arrays that describe themselves.
SIGMF_META, SIGMF_DATA, IQTAR_DATA, ARRAY = ".sigmf-meta", ".sigmf-data", ".complex1ch.float32", ".npy"
#: Frames that a task decodes at once, and bytes of a capture that are a task's share.
FRAMES, SLICE = 256, 64 << 20
#: Bytes below which ranges share a task, and frames that a task of what follows sorts.
LEAST, SHARE = 16 << 20, 50_000


def sample_size(datatype: str) -> int:
    kind, numbers, _ = FORMATS.get(datatype, (datatype, 1, 1.0))  # or the name of a complex numpy type
    return np.dtype(kind).itemsize * numbers


def decode_samples(raw: bytes, datatype: str) -> np.ndarray:
    kind, numbers, scale = FORMATS.get(datatype, (datatype, 1, 1.0))
    x = np.frombuffer(raw, kind)
    return x.astype(np.complex128) if numbers == 1 else (x[0::2].astype(float) + 1j * x[1::2].astype(float)) * scale


def _stem(path: Column, ending: str) -> Column:
    return F.regexp_replace(path, re.escape(ending) + "$", "")


def _listed(spark, path: str, files: DataFrame | None) -> DataFrame:
    """``files(path, length)`` below a folder, listed once; those given are the listing itself."""
    return files_below(spark, path, shared_place(spark, "listed")) if files is None else files


def _ended(files: DataFrame, ending: str) -> DataFrame:
    return files.filter(F.endswith("path", F.lit(ending)))


def _texts(spark, path: str, files: DataFrame, ending: str, name: str) -> DataFrame:
    """``stem`` and text of the sidecars with an ending."""
    return contents(spark, path, files, ending).select(_stem(F.col("path"), ending).alias("stem"), F.decode("content", "UTF-8").alias(name))


def sigmf(spark, path: str, files: DataFrame | None = None) -> DataFrame:
    """Captures below a folder as their JSON sidecars describe them."""
    return described(_texts(spark, path, _listed(spark, path, files), SIGMF_META, "json"))


def described(text: DataFrame) -> DataFrame:
    """Sidecars ``(stem, json)`` as stem, name, datatype, sample_rate, center, tuned, declared, scale.

    The centre frequency is the first capture's, else that of any global key of that name, else 0;
    ``tuned`` says whether there is one, which may be 0 itself.
    """
    shape = "struct<global:map<string,string>,captures:array<map<string,string>>,annotations:array<map<string,string>>>"
    j = text.withColumn("j", F.from_json("json", shape)).select("stem", "j.*")
    key = lambda name: F.col("global")[f"core:{name}"]
    other = F.map_values(F.map_filter("global", lambda k, v: k.rlike(":(center_)?frequency$")))
    center = F.coalesce(F.get("captures", F.lit(0))["core:frequency"], F.get(other, F.lit(0))).try_cast("double")
    ends = F.transform("annotations", lambda a: a["core:sample_start"].try_cast("long") + a["core:sample_count"].try_cast("long"))
    return j.select(
        "stem", F.element_at(F.split("stem", "/"), -1).alias("name"), key("datatype").alias("datatype"), key("sample_rate").try_cast("double").alias("sample_rate"),
        F.coalesce(center, F.lit(0.0)).alias("center"), center.isNotNull().alias("tuned"), F.coalesce(F.array_max(ends), F.lit(0)).alias("declared"), F.lit(1.0).alias("scale"),
    )


def iq_tar(spark, path: str, files: DataFrame | None = None) -> DataFrame:
    """The same from the XML beside unpacked iq-tar samples; a folder names the capture."""
    text = _texts(spark, path, _listed(spark, path, files), f"{IQTAR_DATA}.xml", "xml")
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("xml", rf"<{name}(?:\s[^>]*)?>([^<]*)</{name}>", 1)), F.lit(""))
    known = (F.lower(tag("Format")) == "complex") & (F.lower(tag("DataType")) == "float32") & (F.coalesce(tag("NumberOfChannels"), F.lit("1")) == "1")
    return text.select(
        "stem", F.element_at(F.split("stem", "/"), -2).alias("name"), F.when(known, "cf32_le").otherwise(F.concat_ws("/", tag("Format"), tag("DataType"))).alias("datatype"),
        tag("Clock").try_cast("double").alias("sample_rate"), F.coalesce(tag("CenterFrequency").try_cast("double"), F.lit(0.0)).alias("center"),
        F.coalesce(tag("Samples").try_cast("double"), F.lit(0.0)).cast("long").alias("declared"), F.coalesce(tag("ScalingFactor").try_cast("double"), F.lit(1.0)).alias("scale"),
    )


def audited(described: DataFrame, data: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """``described(stem, datatype, sample_rate, declared, ..)`` joined to its data ``(stem, path, length)``,
    with ``samples`` and ``fault``: null where the capture may be read. Empty data count as none."""
    sizes = sizes or {d: sample_size(d) for d in FORMATS}
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("datatype")]
    rows = described.join(data, "stem", "left").withColumn("samples", F.floor(F.col("length") / size).cast("long"))
    fault = (
        F.when(size.isNull(), "datatype").when(F.col("path").isNull(), "no data").when(~F.coalesce(F.col("sample_rate") > 0, F.lit(False)), "sample rate")
        .when(F.col("length") % size != 0, "ragged").when(F.col("samples") < F.col("declared"), "truncated").when(F.col("samples") == 0, "no data")
    )
    return rows.withColumn("fault", fault)


def catalogue(spark, path: str, files: DataFrame | None = None) -> DataFrame:
    """Every capture below a folder, SigMF and iq-tar, with its samples or its fault; contents are not read.

    ``files`` is the folder's listing where it was made before, here and below.
    id, name, path, datatype, sample_rate, center, scale, declared, samples, fault
    """
    files = _listed(spark, path, files)
    data = lambda ending: _ended(files, ending).select(_stem(F.col("path"), ending).alias("stem"), "path", "length")
    both = audited(sigmf(spark, path, files).drop("tuned"), data(SIGMF_DATA)).unionByName(audited(iq_tar(spark, path, files), data(IQTAR_DATA)))
    return both.select(F.xxhash64("stem").alias("id"), "name", "path", "datatype", "sample_rate", "center", "scale", "declared", "samples", "fault")


def arrays(spark, path: str, files: DataFrame | None = None) -> DataFrame:
    """Arrays (.npy) below a folder from their headers alone: id, name, path, datatype, start (of the
    samples in the file), samples, fault. What is not complex is none; arrays of several
    dimensions in column order have no samples in a row and are ``folded``."""
    files = _ended(_listed(spark, path, files), ARRAY)

    def header(name: str, length: int):
        try:
            with opened(name) as file:
                version = np.lib.format.read_magic(file)
                read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version]
                shape, columns_first, kind = read(file)
                start = file.tell()
        except (OSError, ValueError, KeyError) as e:
            return None, 0, 0, f"header: {type(e).__name__}"
        n = int(np.prod(shape, dtype=np.int64))
        if kind.kind != "c":
            return kind.str, start, n, "datatype"
        if columns_first and sum(k > 1 for k in shape) > 1:
            return kind.str, start, n, "folded"
        return kind.str, start, n, "truncated" if length < start + n * kind.itemsize else None if n else "no data"

    def run(batches):
        for batch in batches:
            paths, lengths = (c.to_pylist() for c in batch.columns)
            found = list(zip(*map(header, paths, lengths), strict=True)) or [[]] * 4
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], ["path", "datatype", "start", "samples", "fault"])

    known = in_tasks(files.filter(reachable(F.col("path"))), 64).mapInArrow(run, "path string, datatype string, start long, samples long, fault string")
    stem = _stem(F.col("path"), ARRAY)
    return known.select(F.xxhash64(stem).alias("id"), F.element_at(F.split(stem, "/"), -1).alias("name"), "path", "datatype", "start", "samples", "fault")


def slices(captures: DataFrame, nfft: int, size: int) -> DataFrame:
    """Ranges of whole frames of ``captures(id, path, datatype, scale, start, samples)``, of about ``size``
    bytes each: id, path, datatype, scale, frame (the first), frames, at (its byte)."""
    sizes = {d: sample_size(d) for d in (*FORMATS, *(f"{end}c{n}" for end in "<>" for n in (8, 16)))}
    each = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("datatype")] * nfft
    frames = F.floor(F.col("samples") / nfft).cast("long")
    per = F.greatest(F.lit(1), F.floor(size / each)).cast("long")
    cut = captures.withColumn("each", each).withColumn("n", frames).withColumn("per", per).filter("n > 0")
    cut = cut.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("per"))))
    return cut.select("id", "path", "datatype", "scale", "frame", F.least("per", F.col("n") - F.col("frame")).alias("frames"), (F.col("start") + F.col("frame") * F.col("each")).alias("at"))


def _frame_batch(id_: int, first: int, x: np.ndarray, nfft: int) -> pa.RecordBatch:
    count = len(x) // nfft
    offsets = pa.array(np.arange(0, len(x) + 1, nfft), pa.int32())
    parts = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(v, np.float64))) for v in (x.real, x.imag)]
    return pa.RecordBatch.from_arrays([pa.array([id_] * count, pa.int64()), pa.array(range(first, first + count), pa.int64()), *parts], ["id", "frame", "i", "q"])


def _read_slices(nfft: int):
    def run(batches):
        for batch in batches:
            for id_, path, datatype, scale, frame, frames, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = sample_size(datatype) * nfft
                with opened(path) as file:
                    file.seek(at)
                    for first in range(frame, frame + frames, FRAMES):
                        count = min(FRAMES, frame + frames - first)
                        raw = read_fully(file, count * size)
                        if len(raw) < count * size:
                            raise OSError(f"{path} ends within frame {first + len(raw) // size}")
                        yield _frame_batch(id_, first, decode_samples(raw, datatype) * scale, nfft)

    return run


def _read_whole(nfft: int):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                id_, datatype, scale = (batch.column(c)[at].as_py() for c in range(3))
                raw = batch.column(3)[at].as_buffer()
                samples = np.load(io.BytesIO(raw), allow_pickle=False).reshape(-1) if datatype == ARRAY else None
                if samples is not None and not np.iscomplexobj(samples):
                    continue
                size = sample_size(datatype) * nfft if samples is None else 0
                for first in range(0, len(raw) // size if samples is None else len(samples) // nfft, FRAMES):
                    x = decode_samples(raw[first * size : (first + FRAMES) * size], datatype) * scale if samples is None else samples[first * nfft : (first + FRAMES) * nfft]
                    yield _frame_batch(id_, first, x[: len(x) // nfft * nfft], nfft)

    return run


FRAME_ROWS = "id long, frame long, i array<double>, q array<double>"


def sound_captures(spark, path: str, files: DataFrame | None = None) -> DataFrame:
    """All captures below a folder that may be read: id, path, datatype, scale, start, samples."""
    files = _listed(spark, path, files)
    described_ = catalogue(spark, path, files).filter("fault is null").select("id", "path", "datatype", "scale", F.lit(0).cast("long").alias("start"), "samples")
    found = arrays(spark, path, files).filter("fault is null").select("id", "path", "datatype", F.lit(1.0).alias("scale"), "start", "samples")
    return described_.unionByName(found)


def read_captures(spark, path: str, nfft: int, size: int = SLICE) -> DataFrame:
    """Whole frames ``id, frame, i, q`` of all captures below a folder that have no fault; arrays (.npy) as well.

    A capture is read in ranges of about ``size`` bytes, each by a task of its own that holds
    FRAMES frames at a time; its length is no limit. Only captures in stores that Spark alone
    opens, and folded arrays, are fetched by Spark's reader, which hands over a file at a time,
    of 2 GB at most. An array's id is that of its path, without the ending.
    """
    files = _listed(spark, path, None)
    sound = sound_captures(spark, path, files).withColumn("reachable", reachable(F.col("path")))
    return read_slices(sound.filter("reachable"), nfft, size).unionByName(_others(spark, path, files, sound.filter("not reachable"), nfft))


def read_slices(sound: DataFrame, nfft: int, size: int = SLICE) -> DataFrame:
    """Frames of ``sound(id, path, datatype, scale, start, samples)``, a task for each ``size`` bytes."""
    parts = slices(sound, nfft, size)
    n = parts.count()  # a row a range; small captures share tasks
    most = sound.sparkSession.sparkContext.defaultParallelism
    volume = parts.agg(F.sum(F.col("frames"))).first()[0] or 0
    tasks = max(1, min(n, max(most, share(volume * nfft * 8, max(size, LEAST)))))
    return parts.repartition(tasks).mapInArrow(_read_slices(nfft), FRAME_ROWS)


def _others(spark, path: str, files: DataFrame, unreachable: DataFrame, nfft: int) -> DataFrame:
    """Frames of captures that have to be fetched whole."""
    far = unreachable.select("id", "path", "datatype", "scale").collect()  # a row a capture, as Spark's own listing
    names = {r["path"]: (r["id"], r["datatype"], r["scale"]) for r in far}
    stem = lambda p: p.removesuffix(ARRAY)
    folded = [r["path"] for r in arrays(spark, path, files).filter("fault = 'folded'").select("path").collect()]
    remote = [r["path"] for r in _ended(files, ARRAY).filter(~reachable(F.col("path"))).select("path").collect()]
    ids = {r["path"]: r["id"] for r in spark.createDataFrame([(p, stem(p)) for p in {*folded, *remote}], "path string, stem string").select("path", F.xxhash64("stem").alias("id")).collect()} if folded or remote else {}
    names |= {p: (i, ARRAY, 1.0) for p, i in ids.items()}
    if not names:
        return spark.createDataFrame([], FRAME_ROWS)
    table = spark.createDataFrame([(p, *v) for p, v in names.items()], "path string, id long, datatype string, scale double")
    content = spark.read.format("binaryFile").load(sorted(names)).select("path", "content")
    return content.join(F.broadcast(table), "path").select("id", "datatype", "scale", "content").mapInArrow(_read_whole(nfft), FRAME_ROWS)


def ingest(spark, path: str, target: str, dataset: str, nfft: int, array_rate: float | None = None, coarsest: int = COARSEST, size: int = SLICE) -> DataFrame:
    """From the captures below ``path`` to stored pyramids and metadata below ``target``: dataset, name, state.

    A capture is known by dataset and name and taken once: ``already`` says that it was stored
    before. ``short`` ones hold no frame, ``no rate`` are arrays while ``array_rate`` is unknown;
    other states are the faults of the files. A run writes its levels to a folder of its own and
    then its metadata, which is what counts: a run that dies leaves nothing that is read.
    """
    run = uuid.uuid4().hex
    files = files_below(spark, path, f"{target}/listed/{run}")
    described_ = catalogue(spark, path, files).withColumn("start", F.lit(0).cast("long")).drop("declared")
    rate = F.lit(array_rate).cast("double")
    found = arrays(spark, path, files).select("id", "name", "path", "datatype", rate.alias("sample_rate"), F.lit(0.0).alias("center"), F.lit(1.0).alias("scale"), "samples", "start",
                                       F.coalesce("fault", F.when(rate.isNull(), "no rate")).alias("fault"))
    every = described_.unionByName(found).withColumn("dataset", F.lit(dataset))
    every = every.withColumn("fault", F.coalesce("fault", F.when(F.col("samples") < nfft, "short")))
    # of equal names in one dataset the first path is the capture
    every = every.withColumn("again", F.row_number().over(W.partitionBy("name").orderBy(F.col("fault").isNotNull(), "path")) > 1)
    known = stored_metadata(spark, target)
    done = known.select("dataset", "name").distinct().withColumn("known", F.lit(True)) if known is not None else spark.createDataFrame([], "dataset string, name string, known boolean")
    every = every.join(done, ["dataset", "name"], "left")
    state = F.coalesce("fault", F.when(F.col("known"), "already"), F.when(F.col("again"), "name taken"), F.lit("ingested"))
    every.withColumn("state", state).write.parquet(f"{target}/runs/{run}")
    remove_tree(spark, f"{target}/listed/{run}")
    every = spark.read.parquet(f"{target}/runs/{run}")
    todo = every.filter("state = 'ingested'")
    if not todo.isEmpty():
        place = f"{target}/levels/run={run}"
        stft(read_slices(todo, nfft, size), nfft).write.parquet(f"{target}/spectra/{run}")
        spectra = spark.read.parquet(f"{target}/spectra/{run}")
        tasks = share(spectra.count(), SHARE)
        quantization_range(spectra, tasks).write.parquet(f"{target}/ranges/{run}")
        ranges = spark.read.parquet(f"{target}/ranges/{run}")
        levels(spectra, ranges, coarsest, tasks).repartitionByRange(tasks, "level", "id", "col").sortWithinPartitions("level", "id", "col").write.parquet(place)
        stored = spark.read.parquet(place)
        rows = metadata(todo, stored, ranges, display_scale(stored, ranges, tasks=tasks), nfft)
        rows.write.parquet(f"{target}/meta/run={run}")
        remove_tree(spark, f"{target}/spectra/{run}")
        remove_tree(spark, f"{target}/ranges/{run}")
    return every.select("dataset", "name", "state")


def stored_metadata(spark, target: str) -> DataFrame | None:
    """Metadata of what ``ingest`` has stored, with its ``run``; none if there is none yet."""
    if not exists(spark, f"{target}/meta"):
        return None
    return spark.read.parquet(f"{target}/meta")


def stored_levels(spark, target: str) -> DataFrame:
    """The stored pyramids: level, id, col, bins, run. Runs without metadata did not end, and do not count."""
    ended = stored_metadata(spark, target).select("run").distinct()
    return spark.read.parquet(f"{target}/levels").join(F.broadcast(ended), "run", "left_semi")  # a row a run
