"""Windows of time and frequency as bounded grids: levels, scales, matching, composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quant import CHANNEL_OFFSET, Geometry, colour_index, decode
from . import pyramid as P
from .quantiles import percentiles

KNOTS = 64
LEAST_VALUES = 100


def pick_summary_level(span: float, width: int) -> int:
    """0 (raw) up to six hours, else the finest bucket that gives at most ``width`` columns, else a day."""
    if span <= 6 * 3600:
        return 0
    return next((b for b in P.BUCKETS if span / b <= width), P.BUCKETS[-1])


def summary_level_of(span: Column, width: Column) -> Column:
    out = F.when(span <= 6 * 3600, 0)
    for b in P.BUCKETS:
        out = out.when(span / b <= width, b)
    return out.otherwise(P.BUCKETS[-1])


def pick_psd_level(span: float, cols: int, captures: int, levels: Sequence[int]) -> int | None:
    """The widest bucket within a column, if captures would have to be thinned; else none."""
    if captures <= cols * 10:
        return None
    fit = [b for b in levels if b <= span / cols]
    return max(fit, default=None)


def psd_level_of(span: Column, cols: Column, captures: Column, levels: Sequence[int]) -> Column:
    out = F.when(captures <= cols * 10, F.lit(None).cast("int"))
    for b in sorted(levels, reverse=True):
        out = out.when(F.lit(b) <= span / cols, b)
    return out


def route_layer(span: Column, width_hz: Column) -> Column:
    """The deepest layer that a window calls for; widths of 0 mean the whole band."""
    narrow = F.when(width_hz <= 0, F.lit(float("inf"))).otherwise(width_hz)
    return F.when((narrow <= 12e6) & (span <= 6 * 3600), "pfp").when((span <= 3 * 86_400) | (narrow <= 40e6), "psd").otherwise("summary")


def level_coverage(level: DataFrame, windows: DataFrame, bucket: int, by: Sequence[str]) -> DataFrame:
    """Whether a level spans a window entirely: only then may it answer."""
    span = level.groupBy(*by).agg(F.min("t").alias("first"), (F.max("t") + bucket).alias("last"))
    covers = (F.col("first") <= F.col("t0")) & (F.col("last") >= F.col("t1"))
    return windows.join(span, list(by), "left").select("window_id", F.coalesce(covers, F.lit(False)).alias("covers"))


def snap_channel(requests: DataFrame, channels: DataFrame, within: float) -> DataFrame:
    """The nearest channel of a sensor, the lower one in a tie, if it is near enough: null otherwise.

    A sensor has a few dozen channels, which go with it as an array.
    """
    lists = channels.groupBy("sensor").agg(F.sort_array(F.collect_set("freq")).alias("channels"))
    near = F.array_min(F.transform("channels", lambda c: F.struct(F.abs(c - F.col("want")).alias("d"), c.alias("c"))))
    return requests.join(lists, "sensor", "left").withColumn("_n", near).withColumn("freq", F.when(F.col("_n.d") <= within, F.col("_n.c"))).drop("_n", "channels")


#: The summaries' column that each statistic of the spectra is shown as.
SHOWN_AS = {"max": "mx", "median": "md", "mean": "mn"}


def match_table(psd_values: DataFrame, summary_values: DataFrame) -> DataFrame:
    """Quantiles of both layers by sensor: sensor, xs (strictly increasing), ys, and lo and hi, the
    summaries' percentiles 2 and 98. Sensors with few values have none.

    Percentiles are exact, of however many values, and no sensor's values are held in one place.
    """
    shares = [k / KNOTS for k in range(KNOTS + 1)]
    both = psd_values.select("sensor", "x", F.lit("xs").alias("side")).unionByName(summary_values.select("sensor", "x", F.lit("ys").alias("side")))
    found = percentiles(both, ["side", "sensor"], "x", [*shares, 0.02, 0.98]).filter(F.col("n") >= LEAST_VALUES)

    def side(name: str) -> DataFrame:
        return found.filter(F.col("side") == name).select("sensor", F.slice("p", 1, KNOTS + 1).alias(name), F.slice("p", KNOTS + 2, 2).alias(f"{name}_ends"))

    rising = F.transform("xs", lambda x, k: x + k * F.lit(1e-4))
    joined = side("xs").join(side("ys"), "sensor").withColumn("xs", rising)
    return joined.select("sensor", "xs", "ys", F.col("ys_ends")[0].alias("lo"), F.col("ys_ends")[1].alias("hi"))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through the knots, constant beyond them."""
    k = F.size(F.filter(xs, lambda v: v <= x))
    low, high = F.get(xs, k - 1), F.get(xs, k)
    inner = F.get(ys, k - 1) + (x - low) / (high - low) * (F.get(ys, k) - F.get(ys, k - 1))
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k >= F.size(xs), F.element_at(ys, -1)).otherwise(inner)


def code_table(match: DataFrame, g: Geometry, offset: float = CHANNEL_OFFSET) -> DataFrame:
    """What each of the 256 codes shows as: sensor, q, dbm."""
    codes = match.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(255)))).withColumn("q", F.col("q").cast("smallint"))
    return codes.select("sensor", "q", interpolate(decode(F.col("q"), g.qmin, g.qmax, offset), F.col("xs"), F.col("ys")).alias("dbm"))


def pick_scale(locked_min: Column, locked_max: Column, matched: Column, own: Column) -> Column:
    """A lock of both ends goes before the matched scale, and that before the layer's own."""
    locked = F.when(locked_min.isNotNull() & locked_max.isNotNull(), F.array(locked_min, locked_max))
    return F.coalesce(locked, matched, own)


def grid_columns(width: Column) -> Column:
    """Columns of a window drawn ``width`` pixels wide: two a pixel, 1 to 4,096."""
    return F.greatest(F.lit(1), F.least(F.lit(4096), width * 2)).cast("int")


def summary_window(levels: dict[int, DataFrame], requests: DataFrame) -> DataFrame:
    """``window_id, level, freq, t, mx, md, mn`` of each request ``(window_id, sensor, t0, t1, width)``.

    ``levels``: the stored levels by bucket, the raw rows under 0; each request reads the one that
    its span and width call for.
    """
    asked = requests.withColumn("level", summary_level_of(F.greatest(F.col("t1") - F.col("t0"), F.lit(1.0)), F.col("width")))
    out = None
    for bucket, level in levels.items():
        rows = level.select("sensor", "freq", F.col("t").cast("double").alias("t"), "mx", "md", "mn")
        part = P.within(rows, asked.filter(F.col("level") == bucket), ["sensor"]).select("window_id", "level", "freq", "t", "mx", "md", "mn")
        out = part if out is None else out.unionByName(part)
    return out


def choose_level(windows: DataFrame, levels: dict[int, DataFrame], cols: int, by: Sequence[str]) -> DataFrame:
    """``windows`` (with ``ncap``) with ``level``: the widest stored level that their columns allow if
    captures are too many and the level spans the window, else none: a level that ends early
    would show its last row as what came after."""
    chosen = windows.withColumn("level", psd_level_of(F.col("t1") - F.col("t0"), F.lit(cols), F.col("ncap"), sorted(levels)))
    if not levels:
        return chosen
    covered = None
    for bucket, level in levels.items():
        asked = chosen.filter(F.col("level") == bucket).select("window_id", *by, "t0", "t1")
        part = level_coverage(level, asked, bucket, by).filter("covers").select("window_id", F.lit(bucket).alias("covered"))
        covered = part if covered is None else covered.unionByName(part)
    return chosen.join(covered, "window_id", "left").withColumn("level", F.col("covered")).drop("covered")


def spectrum_window(
    captures: DataFrame, windows: DataFrame, cols: int, h: int, g: Geometry, by: Sequence[str] = ("sensor",),
    levels: dict[int, DataFrame] | None = None, offset: float = CHANNEL_OFFSET, shown: DataFrame | None = None,
) -> DataFrame:
    """Windows ``(window_id, ..by, t0, t1)`` as grids: window_id, col, r, q, dbm, filled, gap.

    Per window: the widest stored level that its columns allow and that spans it, if captures are
    too many, else the captures; pooled to columns; where a window is empty the capture before it;
    gaps held; bins pooled to at most ``h`` rows; decoded, or shown as ``shown(sensor, q, dbm)``
    says where that has the sensor. All windows are one job.
    """
    levels = levels or {}
    inside = P.within(captures.select(*by, "t"), windows, by).groupBy("window_id").agg(F.count("*").alias("ncap"))
    chosen = choose_level(windows.join(inside, "window_id", "left").fillna(0, "ncap"), levels, cols, by)
    plain = chosen.filter("level is null")
    # which ways any window takes, a row for each level at most: the others are not planned at all
    ways = {(r["level"], r["empty"]) for r in chosen.select("level", (F.col("ncap") == 0).alias("empty")).distinct().collect()} if levels else {(None, True), (None, False)}
    parts = []
    if (None, False) in ways:
        parts.append(P.pool_to_grid(captures, plain.filter("ncap > 0").drop("level", "ncap"), cols, by, "spec"))
    for bucket, level in levels.items():
        if (bucket, False) in ways:
            parts.append(P.levels_to_grid(level, chosen.filter(F.col("level") == bucket).drop("level", "ncap"), cols, bucket, by))
    empty = plain.filter("ncap = 0").drop("level", "ncap")
    if (None, True) not in ways:
        empty = empty.limit(0)
    before = P.as_of(captures, empty, by, "spec").select("window_id", F.lit(0).alias("col"), F.col("spec").alias("smax"))
    grid = before
    for part in parts:
        grid = grid.unionByName(part.select("window_id", "col", "smax"))
    gaps = before.select("window_id", F.lit(True).alias("gap"))
    rows = P.hold(grid, windows, cols, "smax").filter("smax is not null").join(gaps, "window_id", "left")
    pooled = F.posexplode(P.pool_rows(F.col("smax"), g.n, h)).alias("r", "q")
    long = rows.select("window_id", "col", "filled", F.coalesce("gap", F.lit(False)).alias("gap"), pooled)
    own = decode(F.col("q"), g.qmin, g.qmax, offset)
    if shown is None:
        return long.withColumn("dbm", own)
    of = windows.select("window_id", "sensor")
    matched = long.join(of, "window_id").join(shown, ["sensor", "q"], "left").withColumn("dbm", F.coalesce("dbm", own))
    return matched.select("window_id", "col", "filled", "gap", "r", "q", "dbm")


def coloured(grid: DataFrame, scale: DataFrame, value: str = "dbm") -> DataFrame:
    """``grid`` with its colour index under ``scale(window_id, vmin, vmax)``."""
    return grid.join(scale, "window_id").withColumn("idx", colour_index(F.col(value), F.col("vmin"), F.col("vmax"))).drop("vmin", "vmax")
