"""Token counts of whole texts, huge documents by overlap resynchronisation.

A document of at most ``chunk`` characters is counted in one piece. A longer one is cut
into chunks that overlap; the chunks become rows of their own and are dealt to all tasks.
Each chunk is encoded with offsets. Two neighbours are spliced at a boundary of
pre-token runs that both have and that is provably the full text's as well:

* the pre-tokenizer never looks back, so what follows a common boundary is cut alike in
  the right chunk and in the full text;
* it looks ahead no further than its next run, so a boundary before the left chunk's
  last run, and further from its end than any special token is long, is the full text's.

Where two neighbours share no such boundary the document goes into another round with
wider overlaps; an overlap as wide as the document is the plain encoding, so the rounds end.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, sliced, written
from .encoders import byte_level_counter

CHUNK = 32_768
OVERLAP = 512
WIDER = 8


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    Null texts count as empty (0 bytes, 0 tokens). Rows stay as they are: repeated rows
    and null ids give a row each. An empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    small = rows.filter(F.length("text") <= chunk)
    out = "doc_id long, n_bytes long, n_tokens long"
    counted = small.mapInArrow(_whole(tokenizer), out)
    huge = rows.filter(F.length("text") > chunk)
    counted = counted.unionByName(count_huge(huge, tokenizer, chunk, overlap))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _whole(tokenizer: str):
    def run(batches):
        counter = byte_level_counter(tokenizer)
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def chunked(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``huge(row, text)`` as rows ``row, k, last, start, text``: chunk ``k`` starts at
    ``k * chunk`` and reaches ``overlap`` characters into its successors."""
    step, reach = F.lit(chunk), F.lit(chunk + overlap)
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - F.lit(overlap)) / step)).cast("int")
    return huge.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "row", "k", (F.col("k") == n - 1).alias("last"), (F.col("k") * step).alias("start"),
        F.substring(F.col("text"), F.col("k") * step + 1, reach).alias("text"),
    )


def count_huge(huge: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """Counts of long documents: a few rows for each chunk are shuffled, never its tokens."""
    spark = huge.sparkSession
    pending = written(huge.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    out = None
    while not pending.isEmpty():
        pieces = chunked(pending.select("row", "text"), chunk, overlap).repartition(shuffle_parts(spark), "row", "k")
        ends = pieces.mapInArrow(_with_bounds(tokenizer, chunk, overlap), "row long, k int, last boolean, edge int, at long, before long")
        spliced = written(_splice(ends))
        sizes = pending.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
        done = sizes.join(spliced.filter("aligned"), "row").select("doc_id", "n_bytes", "n_tokens")
        out = done if out is None else out.unionByName(done)
        pending = pending.join(spliced.filter("not aligned").select("row"), "row", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, overlap)  # so that splices stay in order
    return out if out is not None else pending.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"))


def _with_bounds(tokenizer: str, chunk: int, overlap: int):
    """For each chunk: boundaries (absolute offset, tokens of the chunk before it) in the
    stretch shared with its left neighbour (edge 0) and with its right one (edge 1), and
    the whole count (edge 2)."""

    def run(batches):
        counter = byte_level_counter(tokenizer)
        guard = max([1, *map(len, counter.specials)])
        for batch in batches:
            rows = {name: [] for name in ("row", "k", "last", "edge", "at", "before")}
            for row, k, last, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, before = counter.bounds(text)
                at = at + start
                end = start + len(text)
                sets = [(2, at[-1:], before[-1:])]
                if k:
                    shared = (at >= start) & (at <= start + overlap)
                    sets.append((0, at[shared], before[shared]))
                if not last:
                    stable = (at[:-1] >= (k + 1) * chunk) & (at[:-1] < end - guard) & (at[:-1] < at[-2])
                    sets.append((1, at[:-1][stable], before[:-1][stable]))
                for edge, offsets, counts in sets:
                    m = len(offsets)
                    for name, value in (("row", [row] * m), ("k", [k] * m), ("last", [last] * m), ("edge", [edge] * m), ("at", offsets.tolist()), ("before", counts.tolist())):
                        rows[name] += value
            yield pa.RecordBatch.from_pydict(
                rows, schema=pa.schema([("row", pa.int64()), ("k", pa.int32()), ("last", pa.bool_()), ("edge", pa.int32()), ("at", pa.int64()), ("before", pa.int64())])
            )

    return run


def _splice(ends: DataFrame) -> DataFrame:
    """``row, aligned, n_tokens``: the sum of all chunks less what neighbours count twice."""
    seams = ends.filter("edge < 2").select("row", F.when(F.col("edge") == 1, F.col("k")).otherwise(F.col("k") - 1).alias("seam"), "edge", "at", "before")
    # the tokens left of the splice come from the left chunk: its `before`; those right of it
    # from the right chunk, so its own `before` there is taken off
    common = seams.groupBy("row", "seam", "at").agg(
        F.max(F.when(F.col("edge") == 1, F.col("before"))).alias("left"), F.max(F.when(F.col("edge") == 0, F.col("before"))).alias("right")
    ).filter("left is not null and right is not null")
    splices = common.groupBy("row", "seam").agg(F.min_by(F.struct("left", "right"), "at").alias("s"))
    per_row = splices.groupBy("row").agg(F.count("*").alias("seams"), F.sum(F.col("s.left") - F.col("s.right")).alias("shift"))
    # a chunk that has a right neighbour counts up to its splice only, so its own total is not used
    last = ends.filter("edge = 2 and last").select("row", F.col("before").alias("tail"), F.col("k").alias("wanted"))
    return last.join(per_row, "row", "left").select(
        "row", (F.coalesce("seams", F.lit(0)) == F.col("wanted")).alias("aligned"), (F.col("tail") + F.coalesce("shift", F.lit(0))).cast("long").alias("n_tokens")
    )
