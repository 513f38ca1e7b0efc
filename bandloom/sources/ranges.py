"""Files read by byte range, in tasks: what is not asked for is not fetched.

Mounted folders are read at once, stores that Arrow knows through it. ``reachable`` says of a
path whether either holds; files of other stores are left to Spark's own readers.
"""

from __future__ import annotations

import os
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schemes that Arrow opens, as it spells them.
STORES = {"s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


def mounted(path: str) -> str | None:
    """``path`` as one of this machine's folders; none if it has the scheme of a store."""
    parts = urlsplit(path)
    if parts.scheme == "file":
        return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return path if path.startswith("/") else None


REACHABLE = "^(/|file:|(" + "|".join(STORES) + "):)"


def reachable(path: Column) -> Column:
    return path.rlike(REACHABLE)


def stored_at(path: str):
    """The store of a path, as Arrow opens it, and the path in it."""
    from pyarrow import fs

    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"{STORES[scheme]}:{rest}")


def opened(path: str):
    """A file to ``seek`` and ``read``, closed by ``with``."""
    local = mounted(path)
    if local is not None:
        return open(local, "rb", buffering=0)
    store, place = stored_at(path)
    return store.open_input_file(place)


def read_fully(file, n: int) -> bytes:
    """``n`` bytes from where the file stands, fewer only at its end."""
    parts = []
    while n > 0 and (part := file.read(n)):
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def in_tasks(rows: DataFrame, each: int) -> DataFrame:
    """``rows`` (a listing) dealt out to tasks of about ``each`` rows; opening files is waiting, so few go together."""
    n = rows.count()
    most = 32 * rows.sparkSession.sparkContext.defaultParallelism  # beyond these a task costs more than its share
    return rows.repartition(min(share(n, each), max(most, share(n, 16 * each))))


def share(n: int, each: int) -> int:
    """Tasks for ``n`` rows, of which each takes about ``each``: a task's memory does not grow with the rows."""
    return max(1, -(-n // each))


def first_lines(files: DataFrame, step: int = 8_192, each: int = 64) -> DataFrame:
    """``path, header, n_read`` of ``files(path)``: the first line of each and how many bytes were read for it.

    Only these files are opened, and each only until its first line ends. A file that cannot be
    opened, or is of a store that Spark alone reads, has a null header.
    """

    def header(path: str) -> tuple[str | None, int]:
        try:
            with opened(path) as file:
                raw = b""
                while b"\n" not in raw and (more := file.read(step)):
                    raw += more
        except (OSError, KeyError, ValueError):
            return None, 0
        return raw.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace"), len(raw)

    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = [header(p) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([h for h, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "header", "n_read"])

    return in_tasks(files.select("path").distinct(), each).mapInArrow(run, "path string, header string, n_read long")


def put(path: str, at: int, content, made: set[str]) -> None:
    """``content`` at its place in a mounted file; ``made`` are the folders that are known to be there."""
    place = mounted(path)
    if place is None:
        raise ValueError(f"not a mounted folder: {path}")
    folder = os.path.dirname(place)
    if folder not in made:
        os.makedirs(folder, exist_ok=True)
        made.add(folder)
    file = os.open(place, os.O_CREAT | os.O_WRONLY, 0o644)
    try:
        view = memoryview(content)
        while view:
            done = os.pwrite(file, view, at)
            view, at = view[done:], at + done
    finally:
        os.close(file)


def write_pieces(rows: DataFrame, pieces=None) -> int:
    """Put pieces at their places in mounted files, in tasks, and count them; doing it again changes nothing.

    ``rows`` are the pieces ``(path, at, content)`` themselves, or ``pieces`` makes them of each batch of rows,
    one by one, so that a task holds a batch of rows and one piece.
    """

    def own(batch):
        for path, at, content in zip(batch.column("path"), batch.column("at"), batch.column("content"), strict=True):
            yield path.as_py(), at.as_py(), content.as_buffer()

    make = pieces or own

    def run(batches):
        n, made = 0, set()
        for batch in batches:
            for path, at, content in make(batch):
                put(path, at, content, made)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
