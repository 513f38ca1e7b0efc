"""Reconciliation of stored layers with their source, cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quant import Geometry, code, decode
from .pyramid import psd_level

KEY = ["sensor", "stat", "t"]


def _side_by_side(pairs: DataFrame, *by: str) -> DataFrame:
    """Captures with ``values`` and ``spec`` as one row for each position that both have."""
    n = F.least(F.size("values"), F.size("spec"))
    both = F.arrays_zip(F.slice("values", F.lit(1), n).alias("v"), F.slice("spec", F.lit(1), n).alias("q"))
    return pairs.select(*by, F.posexplode(both).alias("pos", "c")).select(*by, "pos", F.col("c.v").alias("v"), F.col("c.q").alias("q"))


def cells(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Source values and stored codes side by side: sensor, stat, t, pos, v, q.

    Captures are joined whole; cells come apart after that and are not shuffled.
    """
    return _side_by_side(source.select(*KEY, "values").join(stored.select(*KEY, "spec"), KEY), *KEY)


def _inside(g: Geometry) -> Column:
    return F.col("v").between(g.qmin, g.qmax)


def values(both: DataFrame, g: Geometry) -> DataFrame:
    """Cells in range that miss their source by more than half a step."""
    off = F.abs(decode(F.col("q"), g.qmin, g.qmax) - F.col("v")) > g.step / 2 + 1e-9
    return both.groupBy("sensor", "stat").agg(F.count(F.when(_inside(g), 1)).alias("n_checked"), F.count(F.when(_inside(g) & off, 1)).alias("n_bad"))


def clipped(both: DataFrame, g: Geometry) -> DataFrame:
    """Cells out of range, which must be stored as the end they passed."""
    low, high = F.col("v") < g.qmin, F.col("v") > g.qmax
    wrong = (low & (F.col("q") != 0)) | (high & (F.col("q") != 255))
    return both.groupBy("sensor", "stat").agg(F.count(F.when(low | high, 1)).alias("n_checked"), F.count(F.when(wrong, 1)).alias("n_bad"))


def bias(both: DataFrame, g: Geometry) -> DataFrame:
    error = F.avg(F.when(_inside(g), decode(F.col("q"), g.qmin, g.qmax) - F.col("v")))
    return both.groupBy("sensor", "stat").agg(error.alias("bias")).withColumn("ok", F.abs("bias") < g.step / 4)


def bytes_equal(both: DataFrame, g: Geometry) -> DataFrame:
    return both.groupBy("sensor", "stat").agg(F.count("*").alias("n_checked"), F.sum((F.col("q") != code(F.col("v"), g.qmin, g.qmax)).cast("int")).alias("n_bad"))


def _tie(g: Geometry) -> Column:
    twice = (F.col("v").cast("decimal(20,6)") - F.lit(g.qmin).cast("decimal(20,6)")) * 2 * 255 / F.lit(g.qmax - g.qmin).cast("decimal(20,6)")
    whole = twice.cast("decimal(20,0)")
    return (twice == whole) & (whole % 2 != 0)


def ties(both: DataFrame, g: Geometry) -> DataFrame:
    """Values halfway between two codes, exactly: they must go to the even one."""
    return both.filter(_inside(g) & _tie(g)).groupBy("sensor", "stat").agg(F.count("*").alias("n_checked"), F.sum((F.col("q") % 2 != 0).cast("int")).alias("n_bad"))


def _picked(one_in: int) -> Column:
    return (F.floor(F.col("t")) * 31 + F.col("pos") * 17) % one_in == 0


def _far(g: Geometry) -> Column:
    """More than half a step from the source, in decimal arithmetic."""
    scaled = (F.col("v").cast("decimal(18,9)") - F.lit(g.qmin).cast("decimal(18,9)")) * 255 / F.lit(g.qmax - g.qmin).cast("decimal(18,9)")
    return F.abs(scaled - F.col("q").cast("decimal(18,9)")) > F.lit("0.500001").cast("decimal(18,9)")


def exact(both: DataFrame, g: Geometry, one_in: int = 7) -> DataFrame:
    """Codes of a fixed share of the cells by decimal arithmetic, at most half a step from the source."""
    return both.filter(_picked(one_in) & _inside(g)).groupBy("sensor", "stat").agg(F.count("*").alias("n_checked"), F.sum(_far(g).cast("int")).alias("n_bad"))


def routing(source: DataFrame, stored: DataFrame, g: Geometry) -> DataFrame:
    """Each statistic's store against every statistic's source: its own must match, the others differ."""
    a = source.select("sensor", "t", F.col("stat").alias("source_stat"), "values")
    b = stored.select("sensor", "t", F.col("stat").alias("stored_stat"), "spec")
    gap = F.abs(decode(F.col("q"), g.qmin, g.qmax) - F.col("v"))
    both = _side_by_side(a.join(b, ["sensor", "t"]), "source_stat", "stored_stat").filter(_inside(g))
    own = F.col("source_stat") == F.col("stored_stat")
    ok = F.when(own, F.col("gap") <= g.step / 2 + 1e-9).otherwise(F.col("gap") > 1)
    return both.groupBy("source_stat", "stored_stat").agg(F.max(gap).alias("gap")).withColumn("ok", ok)


def presence(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Captures that are missing (within a microsecond), stored twice, or stored without a source.

    One row for every sensor and statistic that either side has.
    """
    us = F.rint(F.col("t") * 1_000_000).cast("long")
    key = ["sensor", "stat", "us"]
    a, b = (df.select("sensor", "stat", us.alias("us")) for df in (source, stored))
    near = lambda df: df.select("sensor", "stat", F.explode(F.array(F.col("us") - 1, F.col("us"), F.col("us") + 1)).alias("us")).distinct()
    twice = b.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    parts = {
        "source_n": a, "stored_n": b, "missing": a.join(near(b), key, "left_anti"),
        "extra": b.join(near(a), key, "left_anti"), "twice": twice,
    }
    every = None
    for name, rows in parts.items():
        some = rows.select("sensor", "stat", F.lit(name).alias("part"))
        every = some if every is None else every.unionByName(some)
    return every.groupBy("sensor", "stat").agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])


#: Checks that may find nothing to look at: no cell out of range, no value halfway between codes.
MAY_BE_IDLE = ("clipped", "ties")


def _by_cell(source: DataFrame, stored: DataFrame, g: Geometry, one_in: int) -> DataFrame:
    """Everything that is asked of single cells, in one pass: sensor, stat, and for each check its cells and its bad ones."""
    v, q, inside = F.col("v"), F.col("q"), _inside(g)
    error = decode(q, g.qmin, g.qmax) - v
    low, high = v < g.qmin, v > g.qmax
    sums = {
        "values": (inside, F.abs(error) > g.step / 2 + 1e-9), "codes": (F.lit(True), q != code(v, g.qmin, g.qmax)),
        "clipped": (low | high, (low & (q != 0)) | (high & (q != 255))), "ties": (inside & _tie(g), q % 2 != 0),
        "exact": (inside & _picked(one_in), _far(g)),
    }
    counts = [c for name, (seen, bad) in sums.items() for c in (F.count_if(seen).alias(f"{name}_n"), F.count_if(seen & bad).alias(f"{name}_bad"))]
    rows = cells(source, stored).groupBy("sensor", "stat").agg(*counts, F.avg(F.when(inside, error)).alias("bias"))
    wrong = F.coalesce(F.abs("bias") >= g.step / 4, F.lit(True))
    return rows.withColumn("bias_n", F.col("values_n")).withColumn("bias_bad", wrong.cast("long"))


def _checked(rows: DataFrame, names: list[str]) -> DataFrame:
    each = [F.struct(F.lit(n).alias("check"), F.col(f"{n}_n").cast("long").alias("n_checked"), F.col(f"{n}_bad").cast("long").alias("n_bad")) for n in names]
    return rows.select("sensor", "stat", F.inline(F.array(*each)))


def _judged(rows: DataFrame) -> DataFrame:
    """A check that had nothing to look at has failed, unless it is one that may be idle."""
    return rows.withColumn("ok", (F.col("n_bad") == 0) & ((F.col("n_checked") > 0) | F.col("check").isin(*MAY_BE_IDLE)))


def report(source: DataFrame, stored: DataFrame, g: Geometry) -> DataFrame:
    """``sensor, stat, check, n_checked, n_bad, ok`` of values, clipping, codes and presence in one table."""
    return reconcile(source, stored, g).filter(F.col("check").isin("values", "codes", "clipped", "presence"))


def reconcile(
    source: DataFrame, stored: DataFrame, g: Geometry, headers: DataFrame | None = None, declared: DataFrame | None = None,
    levels: dict[int, DataFrame] | None = None, expected: DataFrame | None = None, statistic: str = "max", one_in: int = 7,
) -> DataFrame:
    """Every check of a stored layer in one table: sensor, stat, check, n_checked, n_bad, ok.

    From ``source(sensor, stat, t, values)`` and ``stored(sensor, stat, t, spec)`` come values,
    codes, clipping, ties, the exact sample, bias, presence and routing, the cells in one pass
    over one join of captures; the others where what they look at is given: ``axis`` of
    ``headers(file, freqs)``, with the file in place of the sensor; ``metadata`` of ``declared``;
    ``pyramid`` of ``levels`` by bucket, against a rebuild from the stored captures of
    ``statistic``; ``totals`` of the combinations ``expected(sensor, stat)``. Routing names pairs of
    statistics and no sensor.
    """
    names = ["values", "codes", "clipped", "ties", "exact", "bias"]
    there = presence(source, stored)
    # a combination that only one side has reached no cell: its checks saw nothing
    every = there.join(_by_cell(source, stored, g, one_in), ["sensor", "stat"], "left").fillna(0)
    every = every.withColumn("presence_n", F.col("source_n")).withColumn("presence_bad", F.col("missing") + F.col("extra") + F.col("twice"))
    parts = [_checked(every, [*names, "presence"])]
    text = lambda name: F.lit(name).cast("string")
    bad = lambda ok: (~F.coalesce(ok, F.lit(False))).cast("long").alias("n_bad")
    one = F.lit(1).cast("long").alias("n_checked")
    paths = routing(source, stored, g)
    parts.append(paths.select(text(None).alias("sensor"), F.concat_ws(" as ", "source_stat", "stored_stat").alias("stat"), text("routing").alias("check"), one, bad(F.col("ok"))))
    counted = [F.col(c).cast("long").alias(c) for c in ("n_checked", "n_bad")]
    if headers is not None:
        parts.append(axis(headers, g).select(F.col("file").alias("sensor"), text(None).alias("stat"), text("axis").alias("check"), *counted))
    own = stored.filter(F.col("stat") == statistic)
    if declared is not None:
        parts.append(meta(declared, own, g).select("sensor", text(statistic).alias("stat"), text("metadata").alias("check"), *counted))
    for bucket, level in (levels or {}).items():
        found = pyramid(level, psd_level(own, bucket, ("sensor",)), ["sensor", "t"]).groupBy("sensor").agg(F.sum("n").alias("n_checked"), F.sum(F.when(F.col("state") != "ok", F.col("n")).otherwise(0)).alias("n_bad"))
        parts.append(found.select("sensor", text(statistic).alias("stat"), text(f"pyramid {bucket}").alias("check"), *counted))
    if expected is not None:
        parts.append(totals(stored, expected).select("sensor", "stat", text("totals").alias("check"), one, bad(F.col("ok"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _judged(out)


def axis(header: DataFrame, g: Geometry, within: float = 1.0) -> DataFrame:
    """``header(file, freqs)`` against the geometry's frequencies."""
    off = F.size(F.filter(F.transform("freqs", lambda f, i: F.abs(f - (F.lit(g.f0) + i * g.df))), lambda d: d > within))
    return header.select("file", F.size("freqs").alias("n_checked"), off.alias("n_bad"))


def meta(declared: DataFrame, stored: DataFrame, g: Geometry) -> DataFrame:
    """``declared(sensor, nf, qmin, qmax, t_min, t_max, captures)`` against the layer itself."""
    own = stored.groupBy("sensor").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.min(F.size("spec")).alias("w"))
    same = [F.col("nf") == F.col("w"), F.col("qmin") == g.qmin, F.col("qmax") == g.qmax, F.col("t_min").eqNullSafe(F.col("a")), F.col("t_max").eqNullSafe(F.col("b")), F.col("captures") == F.col("n")]
    bad = sum((~F.coalesce(x, F.lit(False))).cast("int") for x in same)
    return declared.join(own, "sensor", "left").select("sensor", F.lit(len(same)).alias("n_checked"), bad.alias("n_bad"))


def pyramid(stored_level: DataFrame, rebuilt: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a stored level that are missing, extra or not the maxima of the source."""
    joined = rebuilt.withColumnRenamed("smax", "want").join(stored_level, by, "full_outer")
    state = F.when(F.col("smax").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("smax") != F.col("want"), "differs").otherwise("ok")
    return joined.groupBy("sensor", state.alias("state")).agg(F.count("*").alias("n"))


def totals(captures: DataFrame, expected: DataFrame) -> DataFrame:
    """Captures by sensor and statistic against the combinations expected."""
    own = captures.groupBy("sensor", "stat").agg(F.count("*").alias("n"))
    return expected.join(own, ["sensor", "stat"], "full_outer").select("sensor", "stat", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"))
