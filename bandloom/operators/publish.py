"""Tables of which a version is published as one commit.

A version is a manifest that names the folders of data files that are live, for each part of
the table (captures, the list of their files, ..). Folders are written once and never changed;
a version becomes the live one by giving its manifest the next number, in one rename that fails
if another writer took that number. Until then readers see the version before, whatever a
writer has left behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.places import children, exists, remove_tree
from .store import accepted, in_both_shapes, layer_meta, publish_check, rejects


class Refused(ValueError):
    """A version that must not be published, and why."""


@dataclass
class Version:
    """Number 0 is the empty table. ``parts``: by name, the folders that are live."""

    root: str
    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)

    def read(self, spark: SparkSession, part: str) -> DataFrame | None:
        names = self.parts.get(part)
        return _folders(spark, self.root, names) if names else None


def _folders(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    return spark.read.option("basePath", f"{root}/data").parquet(*(f"{root}/data/{n}" for n in names)).drop("staged")


def _manifest(root: str, number: int) -> str:
    return f"{root}/versions/{number:012d}.json"


def live(spark: SparkSession, root: str) -> Version:
    numbers = [int(n.removesuffix(".json")) for n in children(spark, f"{root}/versions") if n.endswith(".json") and not n.startswith(".")]
    if not numbers:
        return Version(root)
    text = spark.read.text(_manifest(root, max(numbers)), wholetext=True).first()[0]
    return Version(root, max(numbers), json.loads(text)["parts"])


def stage(df: DataFrame, root: str, by: Sequence[str] = ()) -> str:
    """Write a folder of data that no version names yet, and return its name."""
    name = f"staged={uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(f"{root}/data/{name}")
    return name


def commit(spark: SparkSession, base: Version, parts: dict[str, list[str]]) -> Version:
    """Make ``parts`` the version after ``base``; refused if another writer has made one since."""
    number = base.number + 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    text = json.dumps({"parts": parts})
    path = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    draft, final = path(f"{base.root}/versions/.{uuid.uuid4().hex}"), path(_manifest(base.root, number))
    store = draft.getFileSystem(conf)
    out = store.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        if store.exists(final):
            raise Refused(f"version {number} was published meanwhile")
        context.rename(draft, final, options)  # fails where the name is taken
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            raise Refused(f"version {number} was published meanwhile") from e
        raise
    finally:
        store.delete(draft, False)
    return Version(base.root, number, parts)


def publish(spark: SparkSession, base: Version, staged: str, part: str, source: DataFrame, by: Sequence[str], other: str | None = None) -> Version:
    """Put the staged folder in place of the live one of ``part``, or refuse.

    Refused are units ``by`` that would become empty, those whose ``source(..by, t)`` has moved on
    since it was staged, and units that the version holds in both shapes, here and in the part
    ``other``: what is built from one shape would lose the other.
    """
    new = _folders(spark, base.root, [staged])
    old = base.read(spark, part)
    none = new.limit(0)
    checked = publish_check(new, source, old if old is not None else none, by)
    bad = checked.filter("verdict <> 'publish'").select(*by, "verdict").limit(5).collect()
    chunks = base.read(spark, other) if other else None
    if chunks is not None and old is not None:
        bad += in_both_shapes(old, chunks, by).withColumn("verdict", F.lit("refuse: both shapes")).select(*by, "verdict").limit(5).collect()
    if bad:
        raise Refused("; ".join(" ".join(map(str, r)) for r in bad))
    return commit(spark, base, base.parts | {part: [staged]})


def append_captures(captures: DataFrame, width: int, root: str, listed: DataFrame | None = None) -> DataFrame:
    """Append whole files of ``captures(file, t, values)`` to the table at ``root``, captures and the list of
    files in one commit; a file with a fault adds nothing. Returned is this run's part of the list.

    file, n, t_min, t_max, and the reason if it was refused. A file that an earlier version took is
    left alone, and reported as it was then; one that was refused may come again. ``listed(file)``
    adds files without captures. Captures lie in folders by day.
    """
    spark = captures.sparkSession
    base = live(spark, root)
    known = base.read(spark, "files")
    done = known.filter("reason is null").select("file") if known is not None else None
    fresh = captures if done is None else captures.join(done, "file", "left_anti")
    fresh = fresh.persist()
    try:
        some = listed if listed is None or done is None else listed.join(done, "file", "left_anti")
        refused = rejects(fresh, width, some).persist()
        good = accepted(fresh, refused)
        added = layer_meta(good, ["file"]).select("file", "n", "t_min", "t_max", F.lit(None).cast("string").alias("reason"))
        none = F.lit(None).cast("double")
        failed = refused.groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reason"))
        rows = added.unionByName(failed.select("file", F.lit(0).cast("long").alias("n"), none.alias("t_min"), none.alias("t_max"), "reason"))
        files = stage(rows, root)
        report = _folders(spark, root, [files])
        again = [] if known is None else [known.join(captures.select("file").distinct(), "file", "left_semi").filter("reason is null")]
        if not report.isEmpty():
            parts = {k: list(v) for k, v in base.parts.items()}
            if not report.filter("reason is null").isEmpty():
                data = stage(good.withColumn("day", F.to_date(F.timestamp_seconds("t"))), root, ["day"])
                parts.setdefault("captures", []).append(data)
            parts.setdefault("files", []).append(files)
            commit(spark, base, parts)
        for rows_ in again:
            report = report.unionByName(rows_)
        return report
    finally:
        fresh.unpersist()


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Delete folders of data that the live version does not name, and older manifests; only while no one writes."""
    now = live(spark, root)
    named = {n for names in now.parts.values() for n in names}
    gone = [n for n in children(spark, f"{root}/data") if n not in named]
    for n in gone:
        remove_tree(spark, f"{root}/data/{n}")
    for n in children(spark, f"{root}/versions"):
        if n != f"{now.number:012d}.json":
            remove_tree(spark, f"{root}/versions/{n}")
    return gone


def is_table(spark: SparkSession, root: str) -> bool:
    return exists(spark, f"{root}/versions")
