"""Packing along a space-filling curve.

A document's token ids are hashed to buckets; the square roots of the counts, at unit length,
are projected to ``AXES`` numbers, each axis is cut into cells of like weight by the corpus'
own mean and deviation, and the cell's place on the Hilbert curve is the document's key.
Documents are range-sorted by key, so like ones are neighbours, and laid end to end along the
curve: a prefix sum over their lengths, taken in ranges, says where each begins, and sequences
are the stretches of ``capacity`` tokens. Only keys and lengths are sorted; the ids move once,
to meet their places. The last stretch is laid out in falling powers of two, which need no
padding, so nothing is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Cuts, shuffle_parts, sliced, written
from .encoders import word_level_ids

CAPACITY = 4096
END_ID = 2
#: Buckets of a document's vector, axes that it is projected to, and bits of a cell's number on each.
BUCKETS, AXES, BITS = 1_024, 6, 10
#: Documents of a range, about.
RANGE = 200_000
#: Bytes of pieces that a task holds before it hands them on.
PENDING = 8 << 20


def projection() -> np.ndarray:
    return np.random.default_rng(12).normal(size=(BUCKETS, AXES))


def bucket_of(ids: np.ndarray) -> np.ndarray:
    """The bucket of each id: the leading bits of a product."""
    return (ids.astype(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def vector(ids: np.ndarray) -> np.ndarray:
    """The hashed vector of a document: square roots of counts at unit length; without ids all zero."""
    counts = np.sqrt(np.bincount(bucket_of(ids), minlength=BUCKETS))
    return counts / max(1.0, np.sqrt(len(ids)))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of ``cells``, a row of whole numbers of ``bits`` bits for each."""
    x = [c.astype(np.int64) for c in cells.T]
    for b in range(bits - 1, 0, -1):  # turn and mirror the sub-cube of each level
        low = (1 << b) - 1
        for i in range(len(x)):
            on = (x[i] >> b) & 1 == 1
            swapped = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(on, low, swapped)
            x[i] = x[i] ^ swapped
    for i in range(1, len(x)):  # Gray code across the axes
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> b) & 1)
    return key


def _encoded(tokenizer: str):
    """``doc_id, n, at, ids``: lengths with the end, places before the axes are cut, ids in two bytes each where they fit."""

    def run(batches):
        encoder, onto = word_level_ids(tokenizer), projection()
        kind = id_type(encoder.library.get_vocab_size())
        for batch in sliced(batches, 512):
            lengths, places, packed = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encoder.ids(text), "<u4")
                lengths.append(len(ids) + 1)
                places.append(vector(ids))
                packed.append(np.append(ids, END_ID).astype(kind).tobytes())
            at = (np.array(places).reshape(-1, BUCKETS) @ onto).ravel()
            offsets = pa.array(np.arange(0, len(at) + 1, AXES), pa.int32())
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(at)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "at", "ids"])

    return run


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def keys(places: DataFrame) -> DataFrame:
    """``row, key, n`` from ``places(row, n, at)``: cells of like weight by the mean and deviation of each axis."""
    axis = [F.col("at")[k] for k in range(AXES)]
    stats = places.agg(*[F.avg(a) for a in axis], *[F.stddev_pop(a) for a in axis]).first()
    mean = np.array([x or 0.0 for x in stats[:AXES]])
    deviation = np.array([x or 1.0 for x in stats[AXES:]])

    def run(batches):
        for batch in batches:
            at = batch.column("at").flatten().to_numpy().reshape(-1, AXES)
            share = 1 / (1 + np.exp(-1.702 * (at - mean) / deviation))  # close to the normal distribution
            cells = np.clip((share * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(hilbert(cells, BITS)), batch.column("n")], ["row", "key", "n"])

    return places.select("row", "n", "at").mapInArrow(run, "row long, key long, n long")


def _running(batches):
    """Where each document of a sorted range begins in it."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = total + np.cumsum(n)
        if len(n):
            total = int(ends[-1])
        columns = [batch.column("row"), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n), batch.column("n")]
        yield pa.RecordBatch.from_arrays(columns, ["row", "part", "begin", "n"])


def along_curve(places: DataFrame, cut: Cuts) -> tuple[DataFrame, int]:
    """``row, begin`` of each of ``places(row, n, at)`` on the curve, and where the last one ends."""
    parts = max(shuffle_parts(places.sparkSession), -(-places.count() // RANGE))
    ordered = cut(keys(places)).repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    ranges = cut(ordered.mapInArrow(_running, "row long, part long, begin long, n long"))
    totals = ranges.groupBy("part").agg(F.sum("n").alias("total"))  # a row for each range
    before = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("before"))
    placed = ranges.join(offsets, "part").select("row", (F.col("begin") + F.col("before")).alias("begin"))
    return placed, totals.agg(F.sum("total")).first()[0] or 0


def tail(total: int, capacity: int) -> list[int]:
    """Where the sequences after the last whole one begin, and the end: falling powers of two."""
    at = total // capacity * capacity
    edges = [at]
    for b in range((total - at).bit_length() - 1, -1, -1):
        if (total - at) >> b & 1:
            edges.append(edges[-1] + (1 << b))
    return edges


def _pieces(capacity: int, total: int, vocabulary: int):
    rest, kind = tail(total, capacity), id_type(vocabulary)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64()] * 6 + [pa.binary()]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, types, strict=True)], names)

    def run(batches):
        out, pending = [], 0
        for rows in sliced(batches):
            for doc_id, ids, begin in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "ids", "begin")), strict=True):
                ids = np.frombuffer(ids, kind).astype("<u4")
                end, at, k = begin + len(ids), begin, 0
                while at < end:
                    if at < rest[0]:
                        sequence, first = divmod(at, capacity)
                        stop = at - first + capacity
                    else:
                        while rest[k + 1] <= at:
                            k += 1
                        sequence, first, stop = rest[0] // capacity + k, at - rest[k], rest[k + 1]
                    stop = min(stop, end)
                    part = ids[at - begin : stop - begin].tobytes()
                    out.append((doc_id, at - begin, stop - at, len(ids), sequence, first, part))
                    pending += len(part)
                    at = stop
                    if pending > PENDING:
                        yield batch(out)
                        out, pending = [], 0
        if out:
            yield batch(out)

    return run


def pieces(docs: DataFrame, tokenizer: str, cut: Cuts, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of ``capacity`` tokens, with their ids:
    doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, four bytes each).

    The tables behind the result are those of ``cut``, and go with it.

    A null or empty text is its end id alone. Repeated rows and null ids are packed like any
    others, one after the other where their texts are equal; a text of any length is cut at the
    ends of sequences only. Without rows there are no pieces. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = cut(rows.mapInArrow(_encoded(tokenizer), "doc_id long, n long, at array<double>, ids binary").withColumn("row", F.monotonically_increasing_id()))
    placed, total = along_curve(encoded.select("row", "n", "at"), cut)
    vocabulary = word_level_ids(tokenizer).library.get_vocab_size()
    met = encoded.select("row", "doc_id", "ids").join(placed.hint("shuffle_hash"), "row").select("doc_id", "ids", "begin")
    return met.mapInArrow(_pieces(capacity, total, vocabulary), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digests(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    with Cuts(docs.sparkSession) as cut:
        found = pieces(docs, tokenizer, cut, capacity)
        return written(found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))
