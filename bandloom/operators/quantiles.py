"""Exact percentiles of any number of values, without a buffer of them.

Values become whole numbers in the same order, and are counted by their leading bits; in the
class that holds a wanted rank by the bits that follow; and so on to the last. A round moves
one count for each class met, whatever stands on one key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.places import remove_tree, shared_place

#: Bits by which a round tells values apart.
BITS = 16
_LOW = np.int64(0x7FFF_FFFF_FFFF_FFFF)


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the numbers; NaN is the largest, both zeros are one."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _LOW, bits)


def restored(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ _LOW, keys).view(np.float64)


def _keyed(batches):
    for batch in batches:
        x = batch.column("x").to_numpy(zero_copy_only=False)
        rest = [n for n in batch.schema.names if n != "x"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(ordered(x))], [*rest, "key"])


def _valued(batches):
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "key"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(restored(batch.column("key").to_numpy()))], [*rest, "x"])


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], weight: str | None = None) -> DataFrame:
    """``..by, p, n``: the percentiles of ``value`` at ``shares`` in each group, as an array, and how many values it has.

    They are those of the function ``percentile``: between two values by the distance of the
    rank. ``weight`` says how often a row counts. Null values, and rows of weight 0 or null,
    count for nothing; a group without values has no row.
    """
    spark, by = rows.sparkSession, list(by)
    place, step = shared_place(spark, "quantiles"), iter(range(1_000))

    def cut(df: DataFrame) -> DataFrame:
        path = f"{place}/{next(step)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    times = F.lit(1) if weight is None else F.col(weight)
    # one struct stands for the group: as a join key it equals itself where fields are null
    names = ["g"]
    group = F.struct(F.lit(0).alias("z"), *[F.col(b).alias(f"b{k}") for k, b in enumerate(by)])
    plain = rows.select(group.alias("g"), times.cast("long").alias("c"), F.col(value).cast("double").alias("x")).filter("x is not null and c > 0")
    kinds = "".join(f"{n} {plain.schema[n].dataType.simpleString()}, " for n in names)
    keys = cut(plain.mapInArrow(_keyed, f"{kinds}c long, key long").groupBy(*names, "key").agg(F.sum("c").alias("c")))
    sizes = keys.groupBy(*names).agg(F.sum("c").alias("n"))
    share = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)]))
    wanted = sizes.select(*names, "n", share).withColumn("at", (F.col("n") - 1) * F.col("share"))
    ends = F.inline(F.array(F.struct(F.lit(0).alias("end"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil("at").alias("rank"))))
    wanted = cut(wanted.select(*names, "k", "at", ends))
    # each group's ranks once, with the leading bits known so far and the rank among what shares them
    state = wanted.select(*names, "rank").distinct().withColumn("lead", F.lit(0).cast("long")).withColumn("left", F.col("rank"))
    for low in range(64 - BITS, -1, -BITS):
        lead = F.shiftright("key", low + BITS) if low + BITS < 64 else F.lit(0).cast("long")
        digits = keys.select(*names, lead.alias("lead"), F.shiftright("key", low).alias("next"), "c")
        counts = digits.join(state.select(*names, "lead").distinct(), [*names, "lead"], "left_semi").groupBy(*names, "lead", "next").agg(F.sum("c").alias("c"))
        own = W.partitionBy(*names, "lead").orderBy("next").rowsBetween(W.unboundedPreceding, 0)  # 2 ** BITS classes at most
        upto = counts.withColumn("upto", F.sum("c").over(own))
        found = state.join(upto, [*names, "lead"]).filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c")))
        state = cut(found.select(*names, "rank", F.col("next").alias("lead"), (F.col("left") - F.col("upto") + F.col("c")).alias("left")))
    values = state.select(*names, "rank", F.col("lead").alias("key")).mapInArrow(_valued, f"{kinds}rank long, x double")
    end = lambda k: F.max(F.when(F.col("end") == k, F.col("x")))
    both = wanted.join(values, [*names, "rank"]).groupBy(*names, "k", "at").agg(end(0).alias("low"), end(1).alias("high"))
    rest = F.col("at") - F.floor("at")
    between = F.when(rest == 0, F.col("low")).otherwise((1 - rest) * F.col("low") + rest * F.col("high"))
    p = F.transform(F.array_sort(F.collect_list(F.struct("k", between.alias("v")))), lambda s: s["v"])  # one for each share
    result = both.groupBy(*names).agg(p.alias("p")).join(sizes, names).select(*[F.col(f"g.b{k}").alias(b) for k, b in enumerate(by)], "p", "n")
    result.write.parquet(f"{place}-out")
    remove_tree(spark, place)
    return spark.read.schema(result.schema).parquet(f"{place}-out")
