"""Best-fit packing of token sequences by the sum-of-squares rule.

A piece goes where the sum, over residual gaps, of the squared number of open bins with
that gap becomes smallest: into an open bin, which moves from gap ``g`` to ``g - size``, or
into a new one. Ties go to the tightest bin. Pieces are dealt by hash to groups of a
bounded size, each packed in one task, longest first; then the bins that groups left
unfilled are packed as items themselves, in further rounds of ever fewer groups, until a
round no longer saves bins. Only counts of pieces reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written
from .encoders import word_level_ids

CAPACITY = 4096
END_ID = 1
#: Pieces (later: bins) that one task packs at once.
GROUP = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with ``sequence_id`` and ``offset``.

    A null or empty text is its end id alone. Repeated rows and null ids are packed like
    any others; an empty table has no pieces. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = written(rows.mapInArrow(_cut(tokenizer, capacity), PIECES).withColumn("row", F.monotonically_increasing_id()))
    return pack(pieces, capacity, group).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _cut(tokenizer: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = word_level_ids(tokenizer)
        for batch in sliced(batches):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (a stored table with a unique ``row`` and a ``length`` of 1 to ``capacity``)
    with ``sequence_id`` (even for bins, odd for pieces that fill a sequence alone) and ``offset``."""
    loose = pieces.filter(F.col("length") < capacity)
    packed = written(
        _dealt(loose.select("row", "length"), loose.count(), group, "row")
        .applyInPandas(_packer(capacity, ["row"]), "row long, bin long, offset long, fill long")
    )
    bins, moves, before = packed.filter("offset = 0").select("bin", "fill"), None, None
    while True:
        unfilled = bins.filter(F.col("fill") < capacity).select("bin", F.col("fill").alias("length"))
        left = unfilled.count()
        if left <= 1 or left == before:
            break
        # the bin that starts a joint one gives it its number
        moved = written(_dealt(unfilled, left, group, "bin").applyInPandas(_packer(capacity, ["bin"], into="first"), "bin long, first long, offset long, fill long"))
        step = moved.select("bin", "first", F.col("offset").alias("shift"))
        moves = step if moves is None else _follow(moves, step)
        bins, before = moved.filter("offset = 0").select(F.col("first").alias("bin"), "fill"), left
    placed = packed.select("row", "bin", "offset")
    if moves is not None:
        placed = placed.join(moves, "bin", "left").select("row", F.coalesce("first", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    placed = placed.select("row", (F.col("bin") * 2).alias("sequence_id"), "offset")
    return (
        pieces.join(placed, "row", "left")
        .withColumn("sequence_id", F.coalesce("sequence_id", F.col("row") * 2 + 1)).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))
    )


def _dealt(items: DataFrame, n: int, group: int, *key: str):
    """Items by hash in groups of about ``group``."""
    return items.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(max(1, -(-n // group))))).groupBy("part")


def _follow(moves: DataFrame, step: DataFrame) -> DataFrame:
    """Two rounds of moves as one."""
    then = step.select(F.col("bin").alias("first"), F.col("first").alias("next"), F.col("shift").alias("more"))
    return moves.join(then, "first", "left").select("bin", F.coalesce("next", "first").alias("first"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each size (in the order given), and how full each bin is."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: dict[int, list[int]] = {}
    gaps: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        open_at = np.flatnonzero(count[size:]) + size
        best, change = capacity, 2 * count[capacity - size] + 1 if size < capacity else 0
        if len(open_at):
            moved = 2 * (count[open_at - size] - count[open_at]) + 2
            if open_at[0] == size:
                moved[0] = 1 - 2 * count[size]  # a closed bin no longer counts
            k = int(moved.argmin())
            if moved[k] <= change:
                best = int(open_at[k])
        if best == capacity:
            found = len(gaps)
            gaps.append(capacity)
        else:
            found = stacks[best].pop()
            count[best] -= 1
        bins[i], offsets[i] = found, capacity - gaps[found]
        gaps[found] -= size
        if gaps[found]:
            stacks.setdefault(gaps[found], []).append(found)
            count[gaps[found]] += 1
    return bins, offsets, [capacity - g for g in gaps]


def _packer(capacity: int, key: list[str], into: str = ""):
    """Packs one group. Bins are numbered within the group, or, with ``into``, by their first item."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *key], ascending=[False] + [True] * len(key)).reset_index(drop=True)
        bins, offsets, fill = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows = rows.assign(offset=offsets, fill=np.array(fill, np.int64)[bins])
        if into:
            starts = rows[key[0]].to_numpy()[offsets == 0]
            rows[into] = starts[np.argsort(bins[offsets == 0])][bins]
            return rows[[*key, into, "offset", "fill"]]
        return rows.assign(bin=rows["part"] * (1 << 20) + bins)[[*key, "bin", "offset", "fill"]]

    return run
