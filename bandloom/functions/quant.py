"""Column expressions: quantizing, decibels, time stamps, frequency bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Geometry:
    """Frequency axis and quantization range of a layer of spectra."""

    f0: float = 3_530_040_000.0
    df: float = 80_000.0
    n: int = 2250
    qmin: float = -180.0
    qmax: float = -90.0

    @property
    def step(self) -> float:
        return (self.qmax - self.qmin) / 255


#: The test tables' vectors, 64 wide.
NARROW = Geometry(n=64)
#: Power frames: dBm instead of dBm/Hz.
FRAMES = Geometry(n=64, qmin=-130.0, qmax=-10.0)
#: Power density to power in a channel of 10 MHz.
CHANNEL_OFFSET = 70.0


def code(value: Column, qmin: float, qmax: float) -> Column:
    """Eight-bit code of one value: half to even, clipped."""
    scaled = F.rint((value - F.lit(qmin)) / F.lit(qmax - qmin) * F.lit(255.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)).cast("smallint")


def decode(q: Column, qmin: float, qmax: float, offset: float = 0.0) -> Column:
    return F.lit(qmin) + q.cast("double") / F.lit(255.0) * F.lit(qmax - qmin) + F.lit(offset)


def quantize(values: Column, qmin: float, qmax: float) -> Column:
    return F.transform(values, lambda x: code(x, qmin, qmax))


def dequantize(codes: Column, qmin: float, qmax: float, offset: float = 0.0) -> Column:
    return F.transform(codes, lambda q: decode(q, qmin, qmax, offset))


def pack_db(value: Column) -> Column:
    """Tenths of a decibel; halves go away from zero."""
    return F.round(value * 10).cast("smallint")


def unpack_db(packed: Column, scale: Column) -> Column:
    return packed / scale


def colour_index(value: Column, vmin: Column, vmax: Column) -> Column:
    """0 to 255, cut off; null (background) where the value is not finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    raw = (value - vmin) / F.greatest(vmax - vmin, F.lit(1e-6)) * 255
    return F.when(finite, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), raw))).cast("smallint"))


def epoch_seconds(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO time (blank or T, Z or an offset; without one: UTC); null if it is none."""
    text = F.regexp_replace(F.trim(stamp), r"(:[0-9]{2}(?:\.[0-9]+)?)([+-][0-9]{2})$", "$1$2:00")
    return F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6)


def band(f0: float, f1: float, g: Geometry) -> tuple[int, int]:
    """First and last bin of a frequency window; an edge of 0 or less is the band's; inverted or empty is all."""
    low = round((f0 - g.f0) / g.df) if f0 > 0 else 0
    high = round((f1 - g.f0) / g.df) if f1 > 0 else g.n - 1
    low, high = max(0, min(g.n - 1, low)), max(0, min(g.n - 1, high))
    return (low, high) if high > low else (0, g.n - 1)
