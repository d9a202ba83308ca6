"""Colours of products as expressions: tone curve, saturation, ramps and a pseudocolour table. All work on doubles in 0..1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAIN, SATURATION, SHADOW, LEAST_TONES = 5.0, 1.4, 0.02, 30
LUMINANCE = (0.2126, 0.7152, 0.0722)

# Ends of ramps, as (from, to, colour at from, colour at to).
NDVI = (
    (-1.0, 0.0, (0.14, 0.15, 0.19), (0.48, 0.42, 0.36)),
    (0.0, 0.2, (0.76, 0.70, 0.52), (0.50, 0.76, 0.32)),
    (0.2, 0.5, (0.50, 0.76, 0.32), (0.18, 0.52, 0.16)),
    (0.5, 1.0, (0.18, 0.52, 0.16), (0.04, 0.28, 0.04)),
)
NDWI = (
    (-1.0, 0.0, (0.32, 0.26, 0.20), (0.58, 0.52, 0.42)),
    (0.0, 0.3, (0.62, 0.80, 0.94), (0.22, 0.52, 0.84)),
    (0.3, 1.0, (0.22, 0.52, 0.84), (0.06, 0.22, 0.52)),
)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def curve(reflectance: Column) -> Column:
    """Reinhard's curve after the gain, then sRGB."""
    x = reflectance * GAIN
    return srgb(x / (x + 1))


def tone(reflectance: Column, low: Column | float = 0.0) -> Column:
    """The curve with everything below `low` black and the rest stretched."""
    low = F.lit(low) if isinstance(low, float) else low
    room = F.lit(1.0) - low
    t = curve(reflectance)
    return F.when(room > 0.001, clamp((t - low) / room)).otherwise(t)


def true_colour(red: Column, green: Column, blue: Column, low: Column | float = 0.0) -> list[Column]:
    """Tones with more saturation: away from their luminance."""
    tones = [tone(c, low) for c in (red, green, blue)]
    lum = sum((t * w for t, w in zip(tones[1:], LUMINANCE[1:], strict=True)), tones[0] * LUMINANCE[0])
    return [clamp(lum * (1 - SATURATION) + t * SATURATION) for t in tones]


def ramp(v: Column, pieces: tuple) -> list[Column]:
    """Three channels of a piecewise linear ramp; the ends go on beyond it."""
    out = []
    for c in range(3):
        value = None
        for i, (a, b, low, high) in enumerate(pieces):
            at = (v - a) / (b - a) if 0 < i < len(pieces) - 1 else clamp((v - a) / (b - a))
            part = F.lit(low[c]) * (F.lit(1.0) - at) + F.lit(high[c]) * at
            if i == len(pieces) - 1:
                value = value.otherwise(part)
            else:
                value = F.when(v < b, part) if value is None else value.when(v < b, part)
        out.append(value)
    return out


def pseudocolour(v: Column, stops: list[tuple[float, float, float]]) -> list[Column]:
    """Three channels from a table of evenly spaced colours, linear between them."""
    p = clamp(v) * (len(stops) - 1)
    i = F.least(F.floor(p).cast("int"), F.lit(len(stops) - 2))
    f = p - i
    tables = [F.array(*[F.lit(float(s[c])) for s in stops]) for c in range(3)]
    return [t[i] * (F.lit(1.0) - f) + t[i + 1] * f for t in tables]


def stretch_low(pixels: DataFrame, keys: list[str], bands: tuple[str, str, str] = ("red", "green", "blue")) -> DataFrame:
    """keys, tones and low: the tone below which a fiftieth lies, 0 where there are fewer than 30 tones.

    All-zero pixels and tones that are not finite say nothing. Equal tones are counted first, so the ranked
    rows are distinct tones, of which a band of whole numbers has a bounded number.
    """
    r, g, b = bands
    lit_ = pixels.where(~((F.col(r) == 0) & (F.col(g) == 0) & (F.col(b) == 0)))
    tones = lit_.select(*keys, F.explode(F.array(*[curve(F.col(c).cast("double")) for c in bands])).alias("tone"))
    ok = tones.where(F.col("tone").isNotNull() & ~F.isnan("tone") & (F.abs("tone") < float("inf")))
    counted = ok.groupBy(*keys, "tone").agg(F.count("*").alias("n"))
    ordered = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tone", "n"))).alias("h"), F.sum("n").alias("tones"))
    rank = F.floor(F.col("tones") * SHADOW)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("at"))
    step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["at"].isNull() & (a["seen"] + x["n"] > rank), x["tone"]).otherwise(a["at"]).alias("at"))
    low = F.aggregate("h", start, step)["at"]
    return ordered.select(*keys, "tones", F.when(F.col("tones") < LEAST_TONES, 0.0).otherwise(low).alias("low"))
