"""Listings of measurement files: names, kinds, inventories, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.ranges import first_lines

# The exports' name patterns. A sensor may hold underscores, a frame statistic one.
PSD_NAME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})_(.+?)_([A-Za-z0-9]+)\.csv$"
PFP_NAME = r"^PFP_([0-9]{4}-[0-9]{2}-[0-9]{2})_(.+?)_([A-Za-z0-9]+(?:_[A-Za-z0-9]+)?)\.csv$"
SUMMARY_COLUMNS = ("sensor_name", "channel_frequency_mhz")
IQ_ENDINGS = (".sigmf-meta", ".npy", ".complex1ch.float32")
STORE_ENDINGS = (".duckdb", ".db")


def _ends(name: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | F.endswith(F.lower(name), F.lit(e))
    return out


def classify(files: DataFrame) -> DataFrame:
    """``files(path, name, header)`` with ``kind, day, sensor, stat``; a header counts only where the name does not decide."""
    name, header = F.col("name"), F.lower(F.col("header"))
    is_pfp, is_psd = name.rlike(PFP_NAME), name.rlike(PSD_NAME)
    summary = F.endswith(F.lower(name), F.lit(".csv"))
    for c in SUMMARY_COLUMNS:
        summary = summary & F.coalesce(F.contains(header, F.lit(c)), F.lit(False))
    kind = F.when(_ends(name, IQ_ENDINGS), "iq").when(_ends(name, STORE_ENDINGS), "store").when(is_pfp, "pfp").when(is_psd, "psd").when(summary, "summaries").otherwise("none")
    part = lambda i: F.when(is_pfp, F.regexp_extract(name, PFP_NAME, i)).when(is_psd, F.regexp_extract(name, PSD_NAME, i))
    return files.withColumn("kind", kind).withColumn("day", part(1)).withColumn("sensor", part(2)).withColumn("stat", part(3))


def list_files(spark, path: str) -> DataFrame:
    """Paths, names and sizes below a folder, without their contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def inventory(files: DataFrame) -> DataFrame:
    return files.groupBy("kind", "sensor").agg(
        F.countDistinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.array_join(F.sort_array(F.collect_set("stat")), ",").alias("stats")
    )


def resolve_collisions(files: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of several files for one key the first path wins; the others are reported."""
    paths = files.select(*key, "path").distinct()
    ranked = paths.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("path")))
    return ranked.filter("k = 1").drop("k"), ranked.filter("k > 1").drop("k")


def width_of(header: Column) -> Column:
    return F.size(F.split(header, ","))


def preflight(files: DataFrame, width: int, sample: int = 2) -> DataFrame:
    """Column counts of the first files ``(kind, sensor, stat, path)`` of each sensor and statistic.

    Files without an ``n_cols`` of their own have their first lines read, those of the sample
    alone; one whose line cannot be read is not ok.
    """
    first = F.row_number().over(W.partitionBy("kind", "sensor", "stat").orderBy("path"))
    given = F.min("n_cols") if "n_cols" in files.columns else F.lit(None)
    paths = files.groupBy("kind", "sensor", "stat", "path").agg(given.cast("int").alias("n_cols"))
    some = paths.withColumn("k", first).filter(F.col("k") <= sample).drop("k")
    if "n_cols" not in files.columns:
        some = some.drop("n_cols").join(first_lines(some).select("path", width_of(F.col("header")).alias("n_cols")), "path", "left").select(*paths.columns)
    return some.withColumn("ok", F.coalesce(F.col("n_cols") == width, F.lit(False)))


#: What endings say of a file, the best first; all others are papers and sidecars.
BULK = (".sigmf-data", ".sigmf-meta", ".tdms", ".npy", ".duckdb", ".h5", ".hdf5", ".mat", ".float32", ".zip", ".sdat", ".dat", ".bin")
TABULAR = (".csv", ".parquet")


def unit_of(path: Column) -> Column:
    """What a file is taken or left with: the two halves of a SigMF capture, the folder of an iq-tar one, else itself."""
    parent = F.regexp_replace(path, r"/?[^/]*$", "")
    half = F.lower(path).rlike(r"\.sigmf-(meta|data)$")
    return F.when(half, F.regexp_replace(path, r"(?i)\.sigmf-(meta|data)$", "")).when(F.endswith(F.lower(parent), F.lit(".iq")), parent).otherwise(path)


def tier_of(path: Column) -> Column:
    """0 for signals, 1 for tables, 2 for the rest."""
    return F.when(_ends(path, BULK), 0).when(_ends(path, TABULAR), 1).otherwise(2)


def smallest_units(files: DataFrame, n: int) -> DataFrame:
    """The files ``(path, size)`` of the ``n`` smallest whole units: path, size, unit, tier, total, and the unit's ``place``.

    Units of signals go before tables, and those before the rest; within a tier those of unknown
    size come last. Files that come with a ``unit`` keep it.
    """
    known = files if "unit" in files.columns else files.withColumn("unit", unit_of(F.col("path")))
    units = known.groupBy("unit").agg(F.min(tier_of(F.col("path"))).alias("tier"), F.max(F.col("size").isNull()).alias("unknown"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count("*").alias("files"))
    best = units.orderBy("tier", "unknown", "total", "unit").limit(n)
    place = F.row_number().over(W.orderBy("tier", "unknown", "total", "unit"))  # n rows
    return known.join(F.broadcast(best.withColumn("place", place)), "unit")


def folder_tree(files: DataFrame) -> DataFrame:
    """Files below every folder, at any depth, and directly in it."""
    parts = F.split("path", "/")
    depth = F.size(parts)
    each = files.select("size", depth.alias("d"), parts.alias("p")).filter("d > 1").select("size", "d", "p", F.explode(F.sequence(F.lit(1), F.col("d") - 1)).alias("k"))
    folder = F.array_join(F.slice("p", F.lit(1), F.col("k")), "/")
    return each.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum((F.col("k") == F.col("d") - 1).cast("int")).alias("direct"))


def checksum_audit(contents: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``contents(path, content)`` against ``sidecars(path, sha256)``: ok, differs or no sidecar."""
    own = contents.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("actual"))
    state = F.when(F.col("sha256").isNull(), "missing").when(F.lower("sha256") == F.col("actual"), "ok").otherwise("differs")
    return own.join(sidecars, "path", "left").select("path", "actual", state.alias("state"))


def safe_path(path: Column) -> Column:
    """Whether a listed path stays below the folder that it is joined to, on any system."""
    parts = F.split(path, "/")
    odd = F.exists(parts, lambda p: p.isin("", ".", "..") | F.contains(p, F.lit("\\")) | F.contains(p, F.lit(":")))
    return F.coalesce(~odd, F.lit(False))


def _text(v: Column, key: str) -> Column:
    """A field that is text; null if it is anything else."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def size_of(component: Column) -> Column:
    """The size of a component as a whole number, whether it was written as one, as a fraction or in quotes; else null."""
    quoted = F.trim(_text(component, "size"))
    kind = F.schema_of_variant(F.try_variant_get(component, "$.size", "variant"))
    number = F.try_variant_get(component, "$.size", "double")
    whole = F.coalesce(F.try_variant_get(component, "$.size", "bigint"), number.try_cast("bigint"))
    return F.when(kind == "STRING", F.when(quoted.rlike("^[0-9]+$"), quoted.try_cast("bigint"))).when(kind == "BOOLEAN", F.lit(None)).otherwise(whole)


def manifest(rows: DataFrame) -> DataFrame:
    """Components of JSON manifests ``rows(id, json)``, plain or wrapped in ResultData: id, path, url, size, checksum.

    Components are read one by one as variants: what one of them has in place of a size or a
    type is no matter of the others. Text that is no JSON has no components. Entries without a
    URL are no files; one without a path goes by the URL's last part; unsafe paths are dropped.
    Checksum sidecars are not listed but go with the file that they are for, as their URL.
    """
    record = F.try_parse_json("json")
    listed = lambda v, key: F.try_variant_get(v, f"$.{key}", "array<variant>")
    wrapped = lambda v: F.flatten(F.filter(F.transform(listed(v, "ResultData"), lambda r: listed(r, "components")), lambda c: c.isNotNull()))

    def fields(c: Column) -> Column:
        url = _text(c, "downloadURL")
        last = F.try_url_decode(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*)?/([^/?#]+)", 1))
        path = F.coalesce(F.nullif(_text(c, "filepath"), F.lit("")), last)
        return F.struct(path.alias("path"), url.alias("url"), size_of(c).alias("size"), F.try_variant_get(c, "$.@type", "array<string>").alias("types"))

    # a text is parsed once and a field read once: what comes out of inline is no expression that a filter repeats
    each = F.flatten(F.transform(F.array(record), lambda v: F.transform(F.coalesce(listed(v, "components"), wrapped(v)), fields)))
    found = rows.select("id", F.inline(each)).filter("url <> ''").filter(safe_path(F.col("path")))
    sidecar = F.endswith("path", F.lit(".sha256")) | F.coalesce(F.array_contains("types", "nrdp:ChecksumFile"), F.lit(False))
    found = found.withColumn("sidecar", sidecar).withColumn("of", F.when(sidecar, F.regexp_replace("path", r"\.sha256$", "")).otherwise(F.col("path")))
    checksum = F.when(F.col("id").isNotNull(), F.min(F.when(F.col("sidecar"), F.col("url"))).over(W.partitionBy("id", "of")))
    return found.withColumn("checksum", checksum).filter("not sidecar").select("id", "path", "url", "size", "checksum")


def heads(spark, path: str, pattern: str = "*.csv") -> DataFrame:
    """``path, header, n_cols`` of the files below a folder, from the first line of each.

    For stores that Spark alone opens: its text reader scans the files that the pattern names,
    whole, and of each one line is kept. Elsewhere ``first_lines`` reads lines only.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    rows = lines.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("k"))
    first = rows.filter("at = 0").groupBy("path").agg(F.min_by("value", "k").alias("header"))
    return first.withColumn("n_cols", width_of(F.col("header")))


def undecided(files: DataFrame) -> DataFrame:
    """Of classified files those whose names do not decide: only their headers need to be read."""
    return files.filter(_open(F.col("kind"), F.col("name")))


def _open(kind: Column, name: Column) -> Column:
    return (kind == "none") & F.coalesce(F.endswith(F.lower(name), F.lit(".csv")), F.lit(False))


def survey(files: DataFrame) -> DataFrame:
    """``files(path, name)`` classified; headers are fetched of the undecided ones only: path, name, kind,
    day, sensor, stat, and n_read, the bytes that were read for it (null where the name decides)."""
    named = classify(files.select("path", "name").withColumn("header", F.lit(None).cast("string")))
    open_ = undecided(named).select("path", "name")
    read = open_.join(first_lines(open_), "path")
    decided = named.filter(~_open(F.col("kind"), F.col("name")) | F.col("path").isNull())
    both = decided.withColumn("n_read", F.lit(None).cast("long")).unionByName(classify(read), allowMissingColumns=True)
    return both.select("path", "name", "kind", "day", "sensor", "stat", "n_read")
