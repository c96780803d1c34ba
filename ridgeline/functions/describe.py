"""Descriptions of features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.config import Config
from ridgeline.operators.features import polyline_length

#: Ranges (low included, high not) and their labels, by metric.
QUANTIFIERS = {
    "prominence": ((0, 20, "small"), (20, 50, "moderate"), (50, 100, "prominent"), (100, 9999, "major")),
    "slope": ((0, 10, "gentle"), (10, 25, "moderate"), (25, 40, "steep"), (40, 90, "very steep")),
    "area": ((0, 500, "small"), (500, 2000, "medium-sized"), (2000, 10000, "large"), (10000, 999999, "extensive")),
    "length": ((0, 100, "short"), (100, 300, "moderate-length"), (300, 800, "long"), (800, 9999, "extended")),
    "elevation": ((0, 100, "low"), (100, 300, "moderate"), (300, 800, "high"), (800, 9999, "very high")),
    "depth": ((0, 20, "shallow"), (20, 50, "moderate-depth"), (50, 100, "deep"), (100, 9999, "very deep")),
}


def quantify(metric: str, value: Column) -> Column:
    out = None
    for low, high, label in QUANTIFIERS[metric]:
        out = (F if out is None else out).when((value >= low) & (value < high), label)
    return out.otherwise("unknown")


def format_metres(value: Column) -> Column:
    """1.2km, 35m or 0.4m; whole metres round half to even."""
    return F.when(value >= 1000, F.concat(F.format_string("%.1f", value / 1000.0), F.lit("km"))).when(value >= 1, F.concat(F.format_string("%.0f", F.bround(value, 0)), F.lit("m"))).otherwise(F.concat(F.format_string("%.1f", value), F.lit("m")))


def ordinal(n: Column) -> Column:
    """st, nd, rd or th."""
    return F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")


def describe(cfg: Config = Config(), brief: bool = False, elevation: Column | None = None, peaks: Column | None = None, stream_order: Column | None = None) -> Column:
    """Text about a row of features; a value that is null counts as unknown, or is left out of a sentence as 0.

    elevation: of its centroid (elev_max unless given); peaks: how many it connects (0); stream_order: of a valley (1).
    """
    kind, slope = F.col("feature_type"), F.col("avg_slope")
    elevation = F.col("elev_max") if elevation is None else elevation
    peaks = F.lit(0) if peaks is None else peaks
    order = F.lit(1) if stream_order is None else stream_order
    length = F.coalesce(polyline_length(F.col("spine"), cfg.horizontal_scale), F.lit(0.0))
    area = F.col("area_pixels") * F.lit(cfg.horizontal_scale**2)
    heads = {
        "peak": F.concat(quantify("prominence", F.col("prominence")), F.lit(" peak")),
        "valley": F.concat(quantify("length", length), F.lit(" valley")),
        "ridge": F.concat(quantify("length", length), F.lit(" ridge")),
        "saddle": F.concat(quantify("elevation", elevation), F.lit(" saddle")),
        "flat_zone": F.concat(quantify("area", area), F.lit(" flat area")),
    }
    reference = F.when(elevation < cfg.sea_level_offset + 10.0, "sea level").otherwise("surrounding terrain")
    stream = F.when(order <= 0, "").when(order == 1, ", part of a drainage network").otherwise(F.concat(F.lit(", part of a "), order.cast("string"), ordinal(order), F.lit("-order stream")))
    ridge_peaks = F.when(peaks == 0, "").when(peaks == 2, " connecting two high points").otherwise(F.concat(F.lit(" connecting "), peaks.cast("string"), F.lit(" high points")))
    saddle_peaks = F.when(peaks == 0, " providing passage between surrounding areas").otherwise(F.concat(F.lit(" connecting "), peaks.cast("string"), F.lit(" surrounding high points")))
    slopes = quantify("slope", slope)
    tails = {
        "peak": F.concat(F.lit(" rising "), format_metres(F.coalesce("prominence", F.lit(0.0))), F.lit(" above "), reference, F.lit(" with "), slopes, F.lit(" slopes")),
        "valley": F.concat(F.lit(" with "), slopes, F.lit(" floor slopes"), stream),
        "ridge": F.concat(F.lit(" with "), slopes, F.lit(" slopes"), ridge_peaks),
        "saddle": F.concat(F.lit(" at "), format_metres(F.coalesce(elevation, F.lit(0.0))), F.lit(" elevation"), saddle_peaks),
        "flat_zone": F.concat(F.lit(" spanning "), format_metres(F.coalesce(area, F.lit(0.0))), F.lit(" with "), slopes, F.lit(" slopes")),
    }
    out = None
    for k, head in heads.items():
        out = (F if out is None else out).when(kind == k, head if brief else F.concat(head, tails[k]))
    return out.otherwise(F.concat(F.lit("[unknown feature type: "), kind, F.lit("]")))


def described(features: DataFrame, cfg: Config = Config(), brief: bool = False) -> Column:
    """describe for a table: by its columns elevation and connected_peaks, where it has them."""
    have = set(features.columns)
    elevation = F.coalesce("elevation", "elev_max") if "elevation" in have else None
    peaks = F.coalesce(F.size("connected_peaks"), F.lit(0)) if "connected_peaks" in have else None
    return describe(cfg, brief, elevation, F.greatest(peaks, F.lit(0)) if peaks is not None else None)
