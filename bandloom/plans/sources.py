"""Queries: scans of exports, listings, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W


from ..operators import files as FO
from ..operators import iq as IQ
from ..operators.store import write_sorted
from ..sources import exports as X
from ..sources import views as V
from ..sources.places import shared_place
from ..sources.ranges import in_tasks, share, write_pieces
from ..sources.views import sql
from .registry import query


def text_rows(spark, sf_dir):
    """The summaries as the text of day files; in every fifth day's some rows are broken."""
    e = V.table(spark, sf_dir, "events")
    mx = F.lit(-100.0) + F.col("value") / 10
    broken = (F.dayofmonth("ts") % 5 == 0) & (F.col("event_id") % 7 == 0)
    return e.select(
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv")).alias("file"), F.col("event_type").alias("sensor_name"), (F.lit(3535) + 10 * (F.col("user_id") % 18)).cast("string").alias("channel_frequency_mhz"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00")).alias("timestamp"), F.when(broken, "n/a").otherwise(mx.cast("string")).alias("max"),
        (mx - 12).cast("string").alias("median"), (mx - 6).cast("string").alias("mean"),
    )




@query(sql("SELECT event_type AS sensor, CAST(3535 + 10 * (user_id % 18) AS DOUBLE) AS freq, round(epoch(ts), 6) AS t, round(-100 + value / 10, 6) AS mx, round(-100 + value / 10 - 12, 6) AS md, round(-100 + value / 10 - 6, 6) AS mn FROM events"))
def summary_scan(spark, sf_dir):
    """Text rows of whole summaries, typed."""
    rows = text_rows(spark, sf_dir).withColumn("max", (F.col("mean").cast("double") + 6).cast("string"))
    ok, _ = X.parse_summaries(rows)
    return ok.select("sensor", "freq", *[F.round(c, 6).alias(c) for c in ("t", "mx", "md", "mn")])


@query("SELECT strftime(ts, '%Y-%m-%d') || '.csv' AS file, count(*) AS rows, count(*) FILTER (WHERE event_id % 7 = 0) AS bad FROM events WHERE day(ts) % 5 = 0 GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 7 = 0) > 0")
def summary_rejects(spark, sf_dir):
    """Files with a broken row, reported."""
    _, bad = X.parse_summaries(text_rows(spark, sf_dir))
    return bad


def _contents(spark, sf_dir, lead: bool):
    """Wide export files as text, one row a file."""
    rows = V.pfp(spark, sf_dir).withColumnRenamed("frame_db", "v") if lead else V.psd(spark, sf_dir).withColumnRenamed("spec_db", "v")
    stamp = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cells = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    line = F.concat_ws(",", stamp, *([F.col("freq").cast("string")] if lead else []), cells)
    lines = rows.select(F.concat_ws("_", F.floor((F.col("t") - V.T0) / 7200).cast("string"), "sensor").alias("file"), "t", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("file").agg(F.concat(F.lit("datetime,rest\n"), body, F.lit("\n")).alias("content"))


@query(sql("SELECT CAST(CAST(floor((t - 1704067200) / 7200) AS BIGINT) AS VARCHAR) || '_' || sensor AS file, t, unnest(range(0, 64)) AS pos, round(unnest(spec_db), 6) AS v FROM v_psd", "v_psd"))
def psd_scan(spark, sf_dir):
    found = X.parse_exports(_contents(spark, sf_dir, False))
    return found.select("file", "t", F.posexplode("values").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query(sql("SELECT CAST(CAST(floor((t - 1704067200) / 7200) AS BIGINT) AS VARCHAR) || '_' || sensor AS file, freq, t, unnest(range(0, 64)) AS pos, round(unnest(frame_db), 6) AS v FROM v_pfp", "v_pfp"))
def pfp_scan(spark, sf_dir):
    found = X.parse_exports(_contents(spark, sf_dir, True), lead=("freq",))
    return found.select("file", "freq", "t", F.posexplode("values").alias("pos", "v")).withColumn("v", F.round("v", 6))


PSD_RE, PFP_RE = (f"'{p}'" for p in (FO.PSD_NAME, FO.PFP_NAME))
KIND = f"""k AS (SELECT *, CASE WHEN ends_with(name, '.sigmf-meta') OR ends_with(name, '.npy') OR ends_with(name, '.complex1ch.float32') THEN 'iq' WHEN ends_with(name, '.duckdb') THEN 'store' WHEN regexp_matches(name, {PFP_RE}) THEN 'pfp' WHEN regexp_matches(name, {PSD_RE}) THEN 'psd'
  WHEN ends_with(name, '.csv') AND contains(header, 'sensor_name') AND contains(header, 'channel_frequency_mhz') THEN 'summaries' ELSE 'none' END AS kind FROM v_files),
p AS (SELECT *, CASE WHEN kind = 'pfp' THEN regexp_extract(name, {PFP_RE}, 1) WHEN kind = 'psd' THEN regexp_extract(name, {PSD_RE}, 1) END AS day,
  CASE WHEN kind = 'pfp' THEN regexp_extract(name, {PFP_RE}, 2) WHEN kind = 'psd' THEN regexp_extract(name, {PSD_RE}, 2) END AS sensor,
  CASE WHEN kind = 'pfp' THEN regexp_extract(name, {PFP_RE}, 3) WHEN kind = 'psd' THEN regexp_extract(name, {PSD_RE}, 3) END AS stat FROM k)"""


@query(sql(f"WITH {KIND} SELECT path, kind, day, sensor, stat FROM p", "v_files"))
def filename_parse(spark, sf_dir):
    return FO.classify(V.files(spark, sf_dir)).select("path", "kind", "day", "sensor", "stat")


@query(sql(f"WITH {KIND} SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM p GROUP BY kind", "v_files"))
def file_census(spark, sf_dir):
    return FO.classify(V.files(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(sql(f"WITH {KIND} SELECT kind, sensor, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day, string_agg(DISTINCT stat, ',' ORDER BY stat) AS stats FROM p WHERE kind IN ('psd', 'pfp') GROUP BY ALL", "v_files"))
def export_inventory(spark, sf_dir):
    return FO.inventory(FO.classify(V.files(spark, sf_dir)).filter("kind in ('psd', 'pfp')"))


COLLIDE = f"WITH {KIND}, u AS (SELECT DISTINCT kind, sensor, day, stat, path FROM p WHERE kind IN ('psd', 'pfp')), r AS (SELECT *, row_number() OVER (PARTITION BY kind, sensor, day, stat ORDER BY path) AS k FROM u)"


@query(sql(f"{COLLIDE} SELECT kind, sensor, day, stat, path FROM r WHERE k = 1", "v_files"))
def collision_resolve(spark, sf_dir):
    return FO.resolve_collisions(FO.classify(V.files(spark, sf_dir)).filter("kind in ('psd', 'pfp')"), ["kind", "sensor", "day", "stat"])[0]


@query(sql(f"{COLLIDE} SELECT kind, sensor, day, stat, path FROM r WHERE k > 1", "v_files"))
def collision_report(spark, sf_dir):
    return FO.resolve_collisions(FO.classify(V.files(spark, sf_dir)).filter("kind in ('psd', 'pfp')"), ["kind", "sensor", "day", "stat"])[1]


@query(sql(f"WITH {KIND} SELECT kind, count(*) AS files, count(DISTINCT sensor) AS sensors, count(DISTINCT day) AS days FROM p GROUP BY kind", "v_files"))
def root_survey(spark, sf_dir):
    f = FO.classify(V.files(spark, sf_dir))
    return f.groupBy("kind").agg(F.count("*").alias("files"), F.countDistinct("sensor").alias("sensors"), F.countDistinct("day").alias("days"))


@query(sql(f"WITH {KIND} SELECT ending, n FROM (SELECT regexp_extract(name, '(\\.[^.]+)$', 1) AS ending, count(*) AS n FROM p WHERE kind = 'none' GROUP BY 1) ORDER BY n DESC, ending LIMIT 6", "v_files"))
def unknown_endings(spark, sf_dir):
    """The six most frequent endings of files of no known kind: a report."""
    f = FO.classify(V.files(spark, sf_dir)).filter("kind = 'none'")
    return f.groupBy(F.regexp_extract("name", r"(\.[^.]+)$", 1).alias("ending")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ending").limit(6)


@query(sql(f"""WITH {KIND}, u AS (SELECT kind, sensor, stat, path, min(n_cols) AS n_cols FROM p WHERE kind IN ('psd', 'pfp') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind, sensor, stat ORDER BY path) AS k FROM u)
SELECT kind, sensor, stat, path, n_cols, n_cols = 2251 AS ok FROM r WHERE k <= 2""", "v_files"))
def preflight_geometry(spark, sf_dir):
    return FO.preflight(FO.classify(V.files(spark, sf_dir)).filter("kind in ('psd', 'pfp')"), 2251)


@query("SELECT capture, declared, bytes // 8 AS actual, CASE WHEN bytes % 8 <> 0 THEN 'ragged' ELSE 'truncated' END AS fault FROM (SELECT event_id AS capture, user_id * 100 AS declared, user_id * 800 + CASE WHEN event_id % 13 = 0 THEN -16 WHEN event_id % 17 = 0 THEN 3 ELSE 0 END AS bytes FROM events) WHERE bytes % 8 <> 0 OR declared > bytes // 8")
def iq_truncation_check(spark, sf_dir):
    """Captures whose size is no whole number of samples, or less than declared."""
    e = V.table(spark, sf_dir, "events")
    size = F.col("user_id") * 800 + F.when(F.col("event_id") % 13 == 0, -16).when(F.col("event_id") % 17 == 0, 3).otherwise(0)
    described = e.select(F.col("event_id").alias("stem"), F.lit("cf32_le").alias("datatype"), F.lit(1.0).alias("sample_rate"), (F.col("user_id") * 100).alias("declared"))
    data = e.select(F.col("event_id").alias("stem"), F.lit("").alias("path"), size.alias("length"))
    return IQ.audited(described, data).filter("fault in ('ragged', 'truncated')").select(F.col("stem").alias("capture"), "declared", F.col("samples").alias("actual"), "fault")


@query("SELECT event_id AS capture, CAST(user_id * 1000 AS DOUBLE) AS sample_rate, CASE WHEN event_id % 3 = 0 THEN value * 1e6 WHEN event_id % 3 = 1 THEN value * 2e6 END AS center FROM events")
def iq_sidecar(spark, sf_dir):
    """Sample rate and centre frequency from JSON sidecars; the latter from the capture, else from any such global key."""
    e = V.table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    capture = F.when(k == 0, F.array(F.create_map(F.lit("core:frequency"), F.col("value") * 1e6))).otherwise(F.array().cast("array<map<string,double>>"))
    keys = F.when(k == 1, F.create_map(F.lit("core:sample_rate"), (F.col("user_id") * 1000).cast("double"), F.lit("x:center_frequency"), F.col("value") * 2e6)).otherwise(F.create_map(F.lit("core:sample_rate"), (F.col("user_id") * 1000).cast("double")))
    text = e.select("event_id", F.to_json(F.struct(keys.alias("global"), capture.alias("captures"))).alias("json"))
    found = IQ.described(text.select(F.col("event_id").cast("string").alias("stem"), "json"))
    return found.select(F.col("stem").cast("long").alias("capture"), "sample_rate", F.when(F.col("tuned"), F.col("center")).alias("center"))


@query(sql("SELECT sensor, count(*) AS n, round(min(t), 6) AS t_min, round(max(t), 6) AS t_max, 0 AS out_of_order FROM v_summary GROUP BY sensor", "v_summary"))
def sorted_sink(spark, sf_dir):
    """A table written in ranges of sensor and time, sorted inside files, and read again."""
    path = shared_place(spark, "sorted")
    write_sorted(V.summary(spark, sf_dir), path, ["sensor", "t"])
    back = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name")).withColumn("k", F.monotonically_increasing_id())
    before = F.lag("t").over(W.partitionBy("file", "sensor").orderBy("k"))
    return back.withColumn("p", before).groupBy("sensor").agg(
        F.count("*").alias("n"), F.round(F.min("t"), 6).alias("t_min"), F.round(F.max("t"), 6).alias("t_max"), F.sum((F.coalesce(F.col("t") < F.col("p"), F.lit(False))).cast("int")).cast("int").alias("out_of_order")
    )


UNITS = """f AS (SELECT event_id, 'r' || (user_id % 50) || '/' || CASE event_id % 5 WHEN 0 THEN 'c' || (event_id // 10) || '.sigmf-meta' WHEN 1 THEN 'c' || (event_id // 10) || '.SIGMF-data' WHEN 2 THEN 'cap' || (event_id // 10) || '.iq/f' || event_id || '.xml'
 WHEN 3 THEN 't' || event_id || '.csv' ELSE 'readme' || event_id || '.txt' END AS path, CASE WHEN event_id % 31 <> 0 THEN event_id * 37 % 1009 END AS size FROM events),
u AS (SELECT *, CASE WHEN regexp_matches(lower(path), '\\.sigmf-(meta|data)$') THEN path[1:-12] WHEN regexp_matches(path, '\\.iq/') THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS unit,
 CASE WHEN regexp_matches(lower(path), '\\.sigmf-(meta|data)$') THEN 0 WHEN path LIKE '%.csv' THEN 1 ELSE 2 END AS tier FROM f),
g AS (SELECT unit, min(tier) AS tier, bool_or(size IS NULL) AS unknown, coalesce(sum(size), 0) AS total FROM u GROUP BY unit ORDER BY tier, unknown, total, unit LIMIT 25)"""


@query(f"WITH {UNITS} SELECT g.unit, u.path, u.size, g.tier FROM g JOIN u USING (unit)")
def smallest_units(spark, sf_dir):
    """The files of the 25 smallest whole units: the limit is the feature."""
    e, k = V.table(spark, sf_dir, "events"), F.col("event_id")
    ten = F.floor(k / 10).cast("string")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("c"), ten, F.lit(".sigmf-meta"))).when(k % 5 == 1, F.concat(F.lit("c"), ten, F.lit(".SIGMF-data")))
        .when(k % 5 == 2, F.concat(F.lit("cap"), ten, F.lit(".iq/f"), k.cast("string"), F.lit(".xml"))).when(k % 5 == 3, F.concat(F.lit("t"), k.cast("string"), F.lit(".csv")))
        .otherwise(F.concat(F.lit("readme"), k.cast("string"), F.lit(".txt")))
    )
    path = F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string"), F.lit("/"), name)
    return FO.smallest_units(e.select(path.alias("path"), F.when(k % 31 != 0, k * 37 % 1009).alias("size")), 25).select("unit", "path", "size", "tier")


def header_files(spark, sf_dir, wanted=None):
    """The listed files, or those ``wanted``, written: a header and two lines each."""
    place = shared_place(spark, "headers")
    tasks = share(V.table(spark, sf_dir, "events").count(), V.EVENTS)
    files = V.files(spark, sf_dir) if wanted is None else V.files(spark, sf_dir).filter(wanted)
    listed = files.repartition(tasks, "path", "name").groupBy("path", "name").agg(F.min("n_cols").alias("n_cols"), F.min("header").alias("header"))
    wide = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_cols") - 2200), lambda i: F.concat(F.lit("b"), i)), ",")
    day_file = F.col("name").rlike(FO.PSD_NAME) | F.col("name").rlike(FO.PFP_NAME)
    content = F.concat(F.when(day_file, wide).otherwise(F.col("header")), F.lit("\n1\n2\n")).cast("binary")
    pieces = listed.select(F.concat(F.lit(place + "/"), "path").alias("path"), "name", F.lit(0).cast("long").alias("at"), content.alias("content"))
    pieces.write.parquet(f"{place}-listed")
    pieces = spark.read.schema(pieces.schema).parquet(f"{place}-listed")
    write_pieces(in_tasks(pieces, 4_096))
    return pieces.select("path", "name"), place


def _below(place):
    return F.substring("path", len(place) + 2, 1_000)


@query(sql(f"WITH {KIND} SELECT path, min(kind) AS kind, bool_or(kind IN ('summaries', 'none') AND ends_with(name, '.csv')) AS opened FROM p GROUP BY path", "v_files"))
def header_survey(spark, sf_dir):
    """Kinds of written files; only those whose names do not decide are opened."""
    files, place = header_files(spark, sf_dir)
    return FO.survey(files).select(_below(place).alias("path"), "kind", F.col("n_read").isNotNull().alias("opened"))


@query(sql(f"""WITH {KIND}, u AS (SELECT kind, sensor, stat, path, min(n_cols) - 2200 AS n_cols FROM p WHERE kind IN ('psd', 'pfp') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind, sensor, stat ORDER BY path) AS k FROM u)
SELECT kind, sensor, stat, path, n_cols, n_cols = 51 AS ok FROM r WHERE k <= 2""", "v_files"))
def preflight_headers(spark, sf_dir):
    """The geometry of the first two written files of each sensor and statistic, from their first lines."""
    # other kinds have no geometry to check and are not opened, so only day files are written
    files, place = header_files(spark, sf_dir, F.col("name").rlike(FO.PSD_NAME) | F.col("name").rlike(FO.PFP_NAME))
    named = FO.classify(files.withColumn("header", F.lit(None).cast("string"))).filter("kind in ('psd', 'pfp')")
    return FO.preflight(named.drop("header", "day", "name"), 51).withColumn("path", _below(place))


def _sized(text, k):
    """Sizes as whole numbers, fractions, in quotes, and as what is no size."""
    forms = ("$1", "$1.75", '"$1"', '"about $1"', "null", "[$1]", "true")
    out = text
    for r, form in enumerate(forms):
        out = F.when(k % len(forms) == r, F.regexp_replace(text, '"size":([0-9]+)', f'"size":{form}')).otherwise(out)
    return out


@query("""SELECT event_id AS id, 'data/' || event_type || '/' || event_id || '.bin' AS path, 'http://host/' || event_id AS url, CASE WHEN event_id % 7 < 3 THEN user_id END AS size,
CASE WHEN event_id % 3 = 0 THEN 'http://host/' || event_id || '.sha256' END AS checksum FROM events WHERE event_id % 5 <> 0""")
def manifest_explode(spark, sf_dir):
    """Components of manifests in either wrapping, with their checksum sidecars; unsafe paths and entries without a URL go."""
    e = V.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    e = e.repartition(share(e.count(), V.EVENTS), "event_id")  # reading variants is work, and a small file is one task
    k = F.col("event_id")
    up = F.when(k % 10 == 0, F.concat(F.lit("../up/"), k)).otherwise(F.concat(F.lit("data//"), k, F.lit(":x")))
    path = F.when(k % 5 == 0, up).otherwise(F.concat(F.lit("data/"), "event_type", F.lit("/"), k, F.lit(".bin")))
    url = F.concat(F.lit("http://host/"), k)
    part = lambda path, url: F.struct(path.alias("filepath"), url.alias("downloadURL"), F.col("user_id").alias("size"))
    none = F.lit(None).cast("string")
    sidecar = F.when(k % 3 == 0, F.array(part(F.concat(path, F.lit(".sha256")), F.concat(url, F.lit(".sha256"))))).otherwise(F.array(part(F.lit("data"), none)))
    parts = F.concat(F.array(part(path, url)), sidecar)
    plain = F.to_json(F.struct(parts.alias("components")))
    size = lambda text: _sized(text, k)
    wrapped = F.to_json(F.struct(F.lit(1).alias("ResultCount"), F.array(F.struct(parts.alias("components"))).alias("ResultData")))
    return FO.manifest(e.select(k.alias("id"), size(F.when(k % 2 == 0, plain).otherwise(wrapped)).alias("json")))


@query(sql("WITH f AS (SELECT size, string_split(path, '/') AS p FROM v_files), e AS (SELECT size, p, unnest(range(1, len(p))) AS k FROM f) SELECT array_to_string(p[1:k], '/') AS folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE k = len(p) - 1) AS direct FROM e GROUP BY 1", "v_files"))
def folder_summary(spark, sf_dir):
    return FO.folder_tree(V.files(spark, sf_dir))


@query("SELECT doc_id AS path, sha256(coalesce(text, '')) AS actual, CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 4 = 1 THEN 'differs' ELSE 'ok' END AS state FROM documents")
def checksum_audit(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    side = d.filter("path % 4 <> 0").select("path", F.when(F.col("path") % 4 == 1, F.sha2(F.concat("content", F.lit("x")).cast("binary"), 256)).otherwise(F.upper(F.sha2(F.col("content").cast("binary"), 256))).alias("sha256"))
    return FO.checksum_audit(d, side)
