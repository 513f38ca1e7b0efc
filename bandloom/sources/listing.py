"""Files below a folder, listed and read in tasks: the driver holds neither their names nor their contents.

What Spark's readers list is kept on the driver, a file some kilobyte, and once for each reader.
"""

from __future__ import annotations

import os
import re
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import qualified
from .ranges import REACHABLE, in_tasks, mounted, opened, stored_at

#: Folders that a task lists, names and bytes of contents that it hands on at once.
FOLDERS, NAMES, BYTES = 16, 8_192, 1 << 20
LISTED = "path string, length long, folder boolean"


def passed_over(name: str, folder: bool) -> bool:
    """Whether Spark's readers do not see a file or folder of this name."""
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
    if folder:
        return (hidden or name.endswith("._COPYING_")) and not name.startswith(("_metadata", "_common_metadata"))
    return hidden or name.endswith("._COPYING_")


def entries(folder: str):
    """``name, length, is a folder`` of all in a folder, one by one; what goes meanwhile is left out."""
    local = mounted(folder)
    if local is None:
        from pyarrow import fs

        store, place = stored_at(folder)
        for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            yield info.base_name, info.size or 0, info.type == fs.FileType.Directory
        return
    try:
        found = os.scandir(local)
    except FileNotFoundError:
        return
    with found:
        for e in found:
            try:
                inner = e.is_dir()
                # a name that is no text cannot be opened by its path, but is no reason to stop unless it is wanted
                yield os.fsencode(e.name).decode("utf-8", "replace"), 0 if inner else e.stat().st_size, inner
            except FileNotFoundError:
                continue


def _list(batches):
    def rows(found):
        paths, lengths, folders = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(folders, pa.bool_())], ["path", "length", "folder"])

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            found = []
            for name, length, inner in entries(folder):
                if not passed_over(name, inner):
                    found.append((f"{folder.rstrip('/')}/{name}", length, inner))
                if len(found) == NAMES:
                    yield rows(found)
                    found = []
            if found:
                yield rows(found)


def walked(spark: SparkSession, path: str) -> str | None:
    """``path`` in full if it is one folder that tasks can list; none for a pattern, a file, or a store that Spark alone opens."""
    if set(path) & set("*?[]{}\\"):
        return None
    root = qualified(spark, path)
    return root if root and re.match(REACHABLE, root) else None


def files_below(spark: SparkSession, path: str, place: str) -> DataFrame:
    """``path, length`` of the files below ``path`` that are not empty, as Spark's readers name them.

    Tasks list the folders, those of one depth after another, and write what they find to ``place``,
    from which it is read. What tasks cannot list (``walked``) Spark lists on the driver.
    """
    root = walked(spark, path)
    if root is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    folders = spark.createDataFrame([(root,)], "path string")
    for depth in count():
        in_tasks(folders, FOLDERS).mapInArrow(_list, LISTED).write.parquet(f"{place}/depth={depth}")
        folders = spark.read.schema(LISTED).parquet(f"{place}/depth={depth}").filter("folder").select("path")
        if folders.isEmpty():
            break
    return spark.read.schema(LISTED).parquet(place).filter("not folder and length > 0").select("path", "length")


def contents(spark: SparkSession, path: str, files: DataFrame, ending: str) -> DataFrame:
    """``path, content`` of those ``files``, which ``files_below`` found below ``path``, that have an ending; for small files."""
    if walked(spark, path) is None:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(path)
        return rows.select("path", "content")

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"])

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    found.append((name, file.read()))
                size += len(found[-1][1])
                if size > BYTES or len(found) == NAMES:
                    yield rows(found)
                    found, size = [], 0
        if found:
            yield rows(found)

    return in_tasks(files.filter(F.endswith("path", F.lit(ending))).select("path"), 64).mapInArrow(run, "path string, content binary")
