"""Max pyramids over time, of numbers and of vectors, and pooling to a grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

BUCKETS = (600, 3600, 21_600, 86_400)


def bucket_start(t: Column, bucket: int) -> Column:
    return (F.floor(t / bucket) * bucket).cast("long")


def summary_level(raw: DataFrame, bucket: int) -> DataFrame:
    """One level straight from the raw rows: max of maxima, means of medians and of means.

    A bucket of 0 is the raw rows themselves.
    """
    if not bucket:
        return raw.select("sensor", "freq", "t", "mx", "md", "mn", F.lit(1).cast("long").alias("c"))
    return raw.groupBy("sensor", "freq", bucket_start(F.col("t"), bucket).alias("t")).agg(
        F.max("mx").alias("mx"), F.avg("md").alias("md"), F.avg("mn").alias("mn"), F.count("*").alias("c")
    )


def summary_pyramid(raw: DataFrame, buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """All levels in one pass over the raw rows: sums and counts of the finest, rolled up exactly."""
    finest = raw.groupBy("sensor", "freq", bucket_start(F.col("t"), buckets[0]).alias("t0")).agg(
        F.max("mx").alias("mx"), F.sum("md").alias("md"), F.sum("mn").alias("mn"), F.count("md").alias("n_md"), F.count("mn").alias("n_mn"), F.count("*").alias("c")
    )
    each = finest.withColumn("bucket", F.explode(F.array(*map(F.lit, buckets))))
    return each.groupBy("bucket", "sensor", "freq", (F.floor(F.col("t0") / F.col("bucket")) * F.col("bucket")).cast("long").alias("t")).agg(
        F.max("mx").alias("mx"), (F.sum("md") / F.sum("n_md")).alias("md"), (F.sum("mn") / F.sum("n_mn")).alias("mn"), F.sum("c").alias("c")
    )


def runs(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where rows begin that differ in ``keys`` from the row before, and the end."""
    new = np.zeros(batch.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:-1] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def pooled(batch: pa.RecordBatch, keys: Sequence[str], vector: str) -> pa.RecordBatch:
    """The batch, whose equal keys lie together, with one row a key: element-wise maxima, nulls apart."""
    edges = runs(batch, keys)
    column = batch.column(vector)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten()
    width = int(sizes.max(initial=0))
    firsts = batch.select(list(keys)).take(pa.array(edges[:-1]))
    if flat.null_count or (sizes != width).any():  # ragged: missing places count as null
        filled = np.zeros((batch.num_rows, width), bool)
        cells = np.zeros((batch.num_rows, width), pc.fill_null(flat, 0).to_numpy().dtype)
        there = np.arange(width) < sizes[:, None]
        filled[there] = flat.is_valid().to_numpy(zero_copy_only=False)
        cells[there] = pc.fill_null(flat, 0).to_numpy()
        low = -np.inf if cells.dtype.kind == "f" else np.iinfo(cells.dtype).min
        best = np.maximum.reduceat(np.where(filled, cells, low), edges[:-1], axis=0)
        seen = np.logical_or.reduceat(filled, edges[:-1], axis=0)
        lengths = np.maximum.reduceat(sizes, edges[:-1])
        kept = np.arange(width) < lengths[:, None]
        values, mask = best[kept], ~seen[kept]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    else:
        values = np.maximum.reduceat(flat.to_numpy().reshape(batch.num_rows, width), edges[:-1], axis=0).ravel()
        mask, offsets = None, np.arange(len(edges)) * width
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, flat.type, mask=mask))
    return pa.RecordBatch.from_arrays([*firsts.columns, lists], [*keys, vector])


def plain(batch: pa.RecordBatch, vector: str) -> pa.RecordBatch:
    """The batch in the one schema of all steps: every field may be null, lists name their cells alike."""
    columns = [c.cast(pa.list_(c.type.value_type)) if name == vector else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def sorted_batch(batch: pa.RecordBatch, keys: Sequence[str]) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(batch.select(list(keys)), [(k, "ascending") for k in keys]))


def vector_max(df: DataFrame, by: Sequence[str], vector: str, out: str = "smax", tasks: int | None = None) -> DataFrame:
    """Element-wise maximum of ``vector`` in each group, as long as the longest; null where all are.

    Whole vectors are pooled in the tasks that read them, batch by batch, and only these partial
    maxima move; a group of any size reaches its task as one vector for each batch that held it.
    """
    rows = df.select(*by, F.col(vector).alias(out))
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])  # any key may be null here, as in Arrow

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                yield pooled(sorted_batch(plain(batch, out), by), by, out)

    return _settled(rows.mapInArrow(partial, shape), by, out, tasks)


def _settled(partial: DataFrame, by: Sequence[str], out: str, tasks: int | None) -> DataFrame:
    """Partial maxima ``(..by, out)`` to one row a key."""

    def final(batches):
        """Rows come in order of their keys; the last key waits for the next batch."""
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = plain(batch, out)
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            best = pooled(batch, by, out)
            waiting = best.slice(best.num_rows - 1)
            if best.num_rows > 1:
                yield best.slice(0, best.num_rows - 1)
        if waiting is not None:
            yield waiting

    moved = (partial.repartition(tasks, *by) if tasks else partial.repartition(*by)).sortWithinPartitions(*by)
    return moved.mapInArrow(final, partial.schema)


def psd_level(captures: DataFrame, bucket: int, by: Sequence[str] = ("stat", "sensor"), vector: str = "spec") -> DataFrame:
    timed = captures.withColumn("t", bucket_start(F.col("t"), bucket))
    return vector_max(timed, [*by, "t"], vector)


def roll_up(level: DataFrame, bucket: int, by: Sequence[str] = ("stat", "sensor")) -> DataFrame:
    """The next coarser level from one whose buckets nest in it."""
    return vector_max(level.withColumn("t", bucket_start(F.col("t"), bucket)), [*by, "t"], "smax")


def top_up(level: DataFrame, captures: DataFrame, since: int, bucket: int) -> DataFrame:
    """Replace the buckets from ``since`` (aligned down) on by a rebuild from ``captures``."""
    start = since // BUCKETS[-1] * BUCKETS[-1]
    return level.filter(F.col("t") < start).unionByName(psd_level(captures.filter(F.col("t") >= start), bucket))


def day_of(t: Column) -> Column:
    return F.floor(t / BUCKETS[-1]).cast("long")


def write_level(level: DataFrame, path: str) -> None:
    """A level in a folder for each day; days that ``level`` has replace those stored, others stay as they are."""
    dated = level.withColumn("day", day_of(F.col("t")))
    dated.repartitionByRange("day", "sensor", "t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def top_up_stored(path: str, captures: DataFrame, since: float, bucket: int, by: Sequence[str] = ("stat", "sensor")) -> None:
    """Bring a level that ``write_level`` stored up to ``captures``, of which those from ``since`` on are new.

    Buckets are rebuilt from the day of ``since`` on, as the bucket in which it falls may have been
    stored half; earlier days are neither read nor written. A bucket of a day or less lies in one day.
    """
    if bucket > BUCKETS[-1]:
        raise ValueError(f"a bucket of {bucket} s does not lie in one day")
    start = since // BUCKETS[-1] * BUCKETS[-1]
    write_level(psd_level(captures.filter(F.col("t") >= start), bucket, by), path)


def spread_sample(rows: DataFrame, by: Sequence[str], slots: int = 16, each: int = 16, most: int = 400) -> DataFrame:
    """Some of ``rows(..by, t)`` from all over each key's range: the first ``each`` of ``slots`` equal
    stretches, of which then every so many-th stays, in order of time, so that about ``most`` are left.

    A range under a second a slot has slots of a second. With ``slot`` and ``k``, the place among those that stay.
    """
    by = list(by)
    span = rows.groupBy(*by).agg(F.min("t").alias("_a"), F.greatest((F.max("t") - F.min("t")) / slots, F.lit(1.0)).alias("_step"))
    placed = rows.join(span, by).withColumn("slot", F.least(F.lit(slots - 1), F.floor((F.col("t") - F.col("_a")) / F.col("_step"))).cast("int"))
    # a limit on a rank keeps so many rows a task before anything moves
    rank = F.row_number().over(W.partitionBy(*by, "slot").orderBy("t"))
    first = placed.withColumn("_r", rank).filter(F.col("_r") <= each)
    every = W.partitionBy(*by)  # slots * each rows at most
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(every) / most))
    thinned = first.withColumn("_stride", stride).withColumn("_i", F.row_number().over(every.orderBy("t")) - 1).filter(F.col("_i") % F.col("_stride") == 0)
    return thinned.withColumn("k", F.floor(F.col("_i") / F.col("_stride")).cast("int")).select(*rows.columns, "slot", "k")


def column_levels(columns: DataFrame, coarsest: int, tasks: int | None = None) -> DataFrame:
    """``level, id, col, bins`` from the columns ``(id, col, bins)`` of level 0.

    Each level's pairs of neighbouring columns become one column of the next, an odd last one
    goes, until a capture, by itself, has at most ``coarsest`` columns. A task makes of the columns it
    reads their share of every level, each from the one below, so that a column is not copied for each.
    """
    sized = _sized(columns, coarsest)
    keys = ["id", "n", "top", "col"]
    field = {f.name: f for f in sized.schema}
    shape = T.StructType([T.StructField("level", T.IntegerType()), *[T.StructField(k, field[k].dataType) for k in ("id", "col", "bins")]])

    def cascade(batches):
        for batch in batches:
            batch, level = sorted_batch(plain(batch, "bins"), ["id", "col"]), 0
            while batch.num_rows:
                batch = pooled(batch, keys, "bins")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, level, np.int32)), *(batch.column(k) for k in ("id", "col", "bins"))], shape.names)
                level += 1
                n, top, col = (batch.column(k).to_numpy() for k in keys[1:])
                batch = batch.set_column(keys.index("col"), "col", pa.array(col >> 1)).filter(pa.array((top >= level) & (col >> 1 < n >> level)))

    return _settled(sized.select(*keys, "bins").mapInArrow(cascade, shape), ["level", "id", "col"], "bins", tasks)


def coarsest_level(columns: DataFrame, coarsest: int, tasks: int | None = None) -> DataFrame:
    """Of ``column_levels`` each capture's last level alone, straight from the columns of level 0."""
    width = F.pow(F.lit(2.0), F.col("top"))
    whole = _sized(columns, coarsest).withColumn("col", F.floor(F.col("col") / width)).filter(F.col("col") < F.floor(F.col("n") / width))
    return vector_max(whole.withColumnRenamed("top", "level"), ["level", "id", "col"], "bins", "bins", tasks)


def _sized(columns: DataFrame, coarsest: int) -> DataFrame:
    """``columns(id, col, bins)`` with ``n``, the capture's columns, and ``top``, its last level."""
    sizes = columns.groupBy("id").agg((F.max("col") + 1).cast("long").alias("n"))
    more = F.filter(F.sequence(F.lit(0), F.lit(61)), lambda k: F.floor(F.col("n") / F.pow(F.lit(2.0), k)) > coarsest)
    return columns.withColumn("col", F.col("col").cast("long")).join(sizes.withColumn("top", F.size(more)), "id")


def column_of(t: Column, t0: Column, t1: Column, cols: int) -> Column:
    span = F.greatest(t1 - t0, F.lit(1e-9))
    return F.least(F.lit(cols - 1), F.greatest(F.lit(0), ((t - t0) / span * cols).cast("int")))


def within(rows: DataFrame, windows: DataFrame, by: Sequence[str], before: int = 0) -> DataFrame:
    """Rows ``(..by, t)`` with the windows ``(window_id, ..by, t0, t1)`` that hold them, or that begin up to ``before`` seconds later.

    Both sides meet by day, so that neither a key's rows nor its windows gather in one place.
    """
    days = F.sequence(F.floor((F.col("t0") - before) / BUCKETS[-1]), F.floor(F.greatest("t0", "t1") / BUCKETS[-1]))
    asked = windows.withColumn("_day", F.explode(days))
    dated = rows.withColumn("_day", F.floor(F.col("t") / BUCKETS[-1]))
    return dated.join(asked, [*by, "_day"]).filter((F.col("t") >= F.col("t0") - before) & (F.col("t") < F.col("t1"))).drop("_day")


def _placed(captures: DataFrame, windows: DataFrame, cols: int, by: Sequence[str]) -> DataFrame:
    return within(captures, windows, by).withColumn("col", column_of(F.col("t"), F.col("t0"), F.col("t1"), cols))


def pool_to_grid(captures: DataFrame, windows: DataFrame, cols: int, by: Sequence[str], vector: str) -> DataFrame:
    """Captures of each window ``(window_id, ..by, t0, t1)`` max-pooled to its columns: window_id, col, smax."""
    return vector_max(_placed(captures, windows, cols, by), ["window_id", "col"], vector)


def to_grid(captures: DataFrame, windows: DataFrame, cols: int, by: Sequence[str], vector: str) -> DataFrame:
    """The same with ``n``, the captures of each column; counting reads no vectors."""
    counts = _placed(captures.select(*by, "t"), windows, cols, by).groupBy("window_id", "col").agg(F.count("*").alias("n"))
    return pool_to_grid(captures, windows, cols, by, vector).join(counts, ["window_id", "col"])


def levels_to_grid(level: DataFrame, windows: DataFrame, cols: int, bucket: int, by: Sequence[str]) -> DataFrame:
    """Each bucket goes to every column that it overlaps: window_id, col, smax."""
    width = (F.col("t1") - F.col("t0")) / cols
    low = F.floor((F.col("t") - F.col("t0")) / width)
    high = F.floor((F.col("t") + F.lit(bucket - 1e-9) - F.col("t0")) / width)
    near = within(level, windows, by, before=bucket).filter(F.col("t") + bucket > F.col("t0"))
    columns = F.sequence(F.greatest(F.lit(0), low), F.greatest(F.lit(0), F.least(F.lit(cols - 1), high)))
    return vector_max(near.withColumn("col", F.explode(columns)).withColumn("col", F.col("col").cast("int")), ["window_id", "col"], "smax")


def pool_rows(vector: Column, n: int, h: int) -> Column:
    """Adjacent bins pooled to at most ``h`` rows; the last group may be short."""
    group = -(-n // h)
    rows = -(-n // group)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.array_max(F.slice(vector, r * group + 1, F.lit(group))))


def hold(grid: DataFrame, windows: DataFrame, cols: int, value: str) -> DataFrame:
    """Every column of every window: an empty one takes the last filled before it, leading ones the first filled."""
    every = windows.select("window_id", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    own = W.partitionBy("window_id").orderBy("col")  # a window has a bounded number of columns
    joined = every.join(grid, ["window_id", "col"], "left")
    last = F.last(value, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return joined.withColumn("filled", F.col(value).isNotNull()).withColumn(value, F.coalesce(last, first))


def as_of(captures: DataFrame, windows: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """For each window the last capture before its end, else the first ever: window_id, t, vector.

    The capture is of the end's own day, or the last of the latest earlier day. Days and times
    are settled without vectors; each window then fetches one.
    """
    by = list(by)
    dated = captures.withColumn("_day", F.floor(F.col("t") / BUCKETS[-1]))
    asked = windows.select("window_id", *by, "t1", F.floor(F.col("t1") / BUCKETS[-1]).alias("_end"))
    days = dated.groupBy(*by, "_day").agg(F.max("t").alias("_last"), F.min("t").alias("_first"))
    times = dated.select(*by, F.col("_day").alias("_end"), "t")
    same = times.join(asked, [*by, "_end"]).filter("t < t1").groupBy("window_id").agg(F.max("t").alias("_same"))
    # pairs of days of one key: as many as the calendar has, however many windows ask
    ends = asked.select(*by, "_end").distinct()
    older = ends.join(days, by).filter("_day < _end").groupBy(*by, "_end").agg(F.max("_last").alias("_older"))
    first = days.groupBy(*by).agg(F.min("_first").alias("_ever"))
    found = asked.join(first, by).join(older, [*by, "_end"], "left").join(same, "window_id", "left")
    chosen = found.select("window_id", *by, F.coalesce("_same", "_older", "_ever").alias("t"))
    fetched = chosen.withColumn("_day", F.floor(F.col("t") / BUCKETS[-1])).join(dated.select(*by, "_day", "t", vector), [*by, "_day", "t"])
    return fetched.groupBy("window_id").agg(F.first("t").alias("t"), F.first(vector).alias(vector))


def numbered(rows: DataFrame, by: Sequence[str], *ties: str) -> DataFrame:
    """``rows`` with ``k``, their place in the order of ``t`` within ``by``, from 0.

    A place is the count of the days before and the place within the day, so that no key is
    sorted in one task.
    """
    day = F.floor(F.col("t") / BUCKETS[-1])
    counts = rows.groupBy(*by, day.alias("_d")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_d").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("_o", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy(*by, "_d").orderBy("t", *ties)) - 1
    return rows.withColumn("_d", day).withColumn("_r", own).join(offsets, [*by, "_d"]).withColumn("k", F.col("_o") + F.col("_r")).drop("_d", "_r", "_o")


def previous(rows: DataFrame, by: Sequence[str], order: str, value: str, width: int) -> DataFrame:
    """``rows`` with ``p``, the ``value`` of the row before in ``order`` within ``by``.

    Rows are taken in stretches of ``width`` of the order; the first of a stretch gets the last of
    the stretch before.
    """
    cut = rows.withColumn("_s", F.floor(F.col(order) / width))
    last = cut.groupBy(*by, "_s").agg(F.max_by(value, order).alias("_v"))
    carried = last.withColumn("_c", F.lag("_v").over(W.partitionBy(*by).orderBy("_s"))).drop("_v")
    own = F.lag(value).over(W.partitionBy(*by, "_s").orderBy(order))
    return cut.withColumn("_p", own).join(carried, [*by, "_s"]).withColumn("p", F.coalesce("_p", "_c")).drop("_s", "_p", "_c")
