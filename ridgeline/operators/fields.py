"""Fields over pixels: calibration, blur, gradients, slope, aspect, curvature and its classes.

What looks at neighbours is a chain of stencil steps over tiles (``stencils``), one shuffle for the whole
chain; all formulas of a pixel's own values are column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Config
from ridgeline.operators import stencils
from ridgeline.operators.quantiles import quantiles
from ridgeline.operators.stencils import kernel as kernel
from ridgeline.sources.scratch import Scratch


def along(axis: str):
    """The window of a pixel's row (axis x) or column (axis y)."""
    return Window.partitionBy("map_id", "y" if axis == "x" else "x").orderBy(axis)


def calibrate(pixels: DataFrame, cfg: Config = Config()) -> DataFrame:
    """z from gray, in the map's own scales if it has columns for them."""
    v = F.col("vertical_scale") if "vertical_scale" in pixels.columns else F.lit(cfg.vertical_scale)
    o = F.col("sea_level_offset") if "sea_level_offset" in pixels.columns else F.lit(cfg.sea_level_offset)
    return pixels.withColumn("z", F.col("gray") * v + o)


def blur(df: DataFrame, column: str, sigma: float, out: str | None = None) -> DataFrame:
    """Separable Gaussian, y first, edges mirrored (the edge pixel twice)."""
    out = out or column
    return df.withColumn(out, F.col(column)) if sigma <= 0 else stencils.apply(df, stencils.blur(column, sigma, out))


def gradient_step(cfg: Config, z: str = "z") -> stencils.Step:
    """dz_dx and dz_dy by central differences; by the 3x3 Sobel operator (whose dz_dx points west) if so configured."""
    return (stencils.sobel if cfg.gradient_method == "sobel" else stencils.differences)(z, "dz_dx", "dz_dy", cfg.horizontal_scale)


def gradient(df: DataFrame, cfg: Config = Config(), z: str = "z") -> DataFrame:
    return stencils.apply(df, gradient_step(cfg, z))


def second_steps(cfg: Config) -> tuple[stencils.Step, ...]:
    c = cfg.horizontal_scale
    return stencils.differences("dz_dx", "_xx", "_xy", c), stencils.differences("dz_dy", "_yx", "_yy", c)


def relief_steps(cfg: Config) -> tuple[stencils.Step, ...]:
    r = cfg.prominence_radius_px
    return (stencils.box("z", -r, r - 1, "min", "_low"),)


def derived(calibrated: DataFrame, cfg: Config = Config(), relief: bool = False, rough: bool = False) -> DataFrame:
    """Blurred z, gradients, slope, aspect and curvatures (and relief, variance) of calibrated pixels, in one pass over tiles."""
    smooth = (stencils.blur("z", cfg.noise_reduction_sigma),) if cfg.noise_reduction_sigma > 0 else ()
    more = (relief_steps(cfg) if relief else ()) + ((stencils.variance("z", "variance"),) if rough else ())
    df = curvatures(slope_aspect(stencils.apply(calibrated, *smooth, gradient_step(cfg), *second_steps(cfg), *more), cfg))
    return df.withColumn("relief", F.col("z") - F.col("_low")).drop("_low") if relief else df


def slope_aspect(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Slope in degrees, cut to 0..90; aspect, the azimuth of steepest ascent in radians, 0 where it is flat."""
    x, y = F.col("dz_dx"), F.col("dz_dy")
    df = df.withColumn("slope", F.greatest(F.lit(0.0), F.least(F.lit(90.0), F.degrees(F.atan(F.sqrt(x * x + y * y))))))
    turn = F.lit(2 * math.pi)
    return df.withColumn("aspect", F.when(F.col("slope") < cfg.flat_threshold_deg, F.lit(0.0)).otherwise(F.pmod(F.atan2(x, -y) + turn, turn)))


def curvature(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Mean curvature h_curv and Gaussian curvature k_curv from the gradients; NaN becomes 0 and infinities are cut to 1."""
    return curvatures(stencils.apply(df, *second_steps(cfg)))


def curvatures(df: DataFrame) -> DataFrame:
    """The curvatures from columns of first and second derivatives, which go."""
    p, q, r, t = (F.col(n) for n in ("dz_dx", "dz_dy", "_xx", "_yy"))
    s = (F.col("_xy") + F.col("_yx")) / 2.0
    g = 1.0 + p * p + q * q
    h = ((1.0 + q * q) * r - 2.0 * p * q * s + (1.0 + p * p) * t) / (2.0 * g * F.sqrt(g))
    k = (r * t - s * s) / (g * g)
    df = df.withColumn("h_curv", h).withColumn("k_curv", k)
    bad = F.isnan("h_curv") | F.isnan("k_curv")
    fix = lambda c: F.when(bad, 0.0).when(F.abs(c) == float("inf"), F.signum(c)).otherwise(F.col(c))
    return df.withColumns({"h_curv": fix("h_curv"), "k_curv": fix("k_curv")}).drop("_xx", "_xy", "_yx", "_yy")


def epsilons(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """map_id, eps_h, eps_k: adaptive thresholds by exact percentiles of each map.  df is read four times: write it first."""
    if not cfg.adaptive_epsilon:
        return df.select("map_id").distinct().withColumn("eps_h", F.lit(cfg.curvature_epsilon)).withColumn("eps_k", F.lit(cfg.curvature_epsilon))
    a = df.select("map_id", F.abs("h_curv").alias("h"), F.abs("k_curv").alias("k"))
    first = quantiles(a, m=(F.col("h"), 0.5), h_all=(F.col("h"), 0.75), k_all=(F.col("k"), 0.75))
    first = Scratch(df.sparkSession).keep(first)
    some = a.join(first.select("map_id", "m"), "map_id").filter("h > m")
    n = some.groupBy("map_id").agg(F.count("*").alias("n"))
    both = first.join(quantiles(some, h_some=(F.col("h"), 0.75), k_some=(F.col("k"), 0.75)), "map_id", "left").join(n, "map_id", "left")
    few = F.coalesce(F.col("n"), F.lit(0)) < 100
    cut = lambda v, low, high: F.greatest(F.lit(low), F.least(F.lit(high), v))
    h = cut(F.when(few, F.col("h_all")).otherwise(F.col("h_some")) * cfg.h_factor, cfg.h_min, cfg.h_max)
    k = cut(F.when(few, F.col("k_all")).otherwise(F.col("k_some")) * cfg.k_factor, cfg.k_min, cfg.k_max)
    return both.select("map_id", h.alias("eps_h"), k.alias("eps_k"))


def classify(df: DataFrame, eps: DataFrame) -> DataFrame:
    """curvature_type: SADDLE, CYLINDRICAL_CONVEX, CYLINDRICAL_CONCAVE, CONVEX, CONCAVE or FLAT."""
    h, k, eh, ek = (F.col(n) for n in ("h_curv", "k_curv", "eps_h", "eps_k"))
    kind = F.when(k < -ek, "SADDLE").when((h > eh) & (F.abs(k) < ek), "CYLINDRICAL_CONVEX").when((h < -eh) & (F.abs(k) < ek), "CYLINDRICAL_CONCAVE").when((h > eh) & (k > ek), "CONVEX").when((h < -eh) & (k > ek), "CONCAVE").otherwise("FLAT")
    return df.join(eps, "map_id").withColumn("curvature_type", kind)


def classified(curved: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Writes the table once and classifies it by thresholds taken from it; eps_h and eps_k stay as columns."""
    curved = Scratch(curved.sparkSession).keep(curved)
    return classify(curved, epsilons(curved, cfg))


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("map_id", "curvature_type").agg(F.count("*").alias("n"))


def surface_checks(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """map_id, bad (pixels that aren't finite), spread, wide (whether the spread is implausible)."""
    out = df.groupBy("map_id").agg(F.sum((F.isnan("z") | (F.abs("z") == float("inf"))).cast("long")).alias("bad"), (F.max("z") - F.min("z")).alias("spread"))
    return out.withColumn("wide", F.col("spread") > cfg.max_elevation_range)


def require_finite(df: DataFrame, *columns: str) -> DataFrame:
    """The table; ValueError if a value of the columns is null, NaN or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    n = df.agg(*(F.count(F.when(bad(c), 1)).alias(c) for c in columns)).first()
    wrong = {c: n[c] for c in columns if n[c]}
    if wrong:
        raise ValueError(f"values that aren't finite: {wrong}")
    return df


def world(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds easting and northing in metres."""
    return df.withColumn("easting", F.col("x") * F.lit(cfg.horizontal_scale)).withColumn("northing", F.col("y") * F.lit(cfg.horizontal_scale))


def elevation_at(df: DataFrame, points: DataFrame) -> DataFrame:
    """points (map_id, x, y, ...) with z; null outside the map."""
    return points.join(df.select("map_id", "x", "y", "z"), ["map_id", "x", "y"], "left")


def k_confidence(df: DataFrame) -> DataFrame:
    """Adds k_confidence: |k| over the 90th percentile of the map's non-zero |k|, cut to 0..1.  df is read three times."""
    top = quantiles(df.filter("k_curv <> 0").select("map_id", "k_curv"), _p90=(F.abs("k_curv"), 0.9))
    out = df.join(top, "map_id", "left")
    share = F.abs("k_curv") / F.greatest(F.coalesce(F.col("_p90"), F.lit(1.0)), F.lit(1e-8))
    return out.withColumn("k_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).drop("_p90")


def prominence(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds relief: z above the least z of the window from -r to r - 1 pixels."""
    return stencils.apply(df, *relief_steps(cfg)).withColumn("relief", F.col("z") - F.col("_low")).drop("_low")


def roughness(df: DataFrame) -> DataFrame:
    """Adds variance: of z over 3x3 pixels, edges mirrored, not below 0."""
    return stencils.apply(df, stencils.variance("z", "variance"))


def cost(df: DataFrame, cfg: Config = Config(), function: str | None = None, unit: str | None = None, custom=None) -> DataFrame:
    """Adds cost of a pixel by its slope, curvature and roughness.

    function: tobler, vehicle_quadratic or another; custom: a function of the slope column for the latter.
    """
    function, unit = function or cfg.traversability_cost_function, unit or cfg.traversability_unit
    s = F.radians("slope")
    climb = F.lit(math.radians(cfg.vehicle_climb_angle))
    if function == "tobler":
        c = 1.0 / F.greatest(6.0 * F.exp(-3.5 * F.abs(s + 0.05)) / 3.6, F.lit(0.01))
    elif function == "vehicle_quadratic":
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / climb))
        c = 1.0 + share * share
    else:
        c = custom(F.col("slope")) if custom else 1.0 + s / climb
    if "h_curv" in df.columns:
        c = c * (1.0 + cfg.cost_curvature_weight * F.greatest(F.col("h_curv"), F.lit(0.0)))
    if "variance" in df.columns:
        c = c * (1.0 + cfg.cost_roughness_weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("variance") / 10.0)))
    if unit == "energy":
        c = 70.0 * 9.81 * F.sin(s) + 2.0
    elif unit == "risk":
        c = F.greatest(F.lit(1.0), F.least(F.lit(10.0), c / 5.0))
    return df.withColumn("cost", F.greatest(c, F.lit(0.1)))


def hillshade(df: DataFrame, cfg: Config = Config(), azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 3.0) -> DataFrame:
    """Adds shade, 0 to 1 over each map: light from the azimuth at the altitude on the exaggerated surface, in pixels."""
    az, alt, e = math.radians(90 - azimuth), math.radians(altitude), exaggeration * cfg.horizontal_scale
    x, y = -e * F.col("dz_dx"), e * F.col("dz_dy")
    light = (x * (math.cos(az) * math.cos(alt)) + y * (math.sin(az) * math.cos(alt)) + math.sin(alt)) / F.sqrt(1.0 + x * x + y * y)
    df = Scratch(df.sparkSession).keep(df.withColumn("_l", light))  # read for the range and for the shades
    by = df.groupBy("map_id").agg(F.min("_l").alias("_a"), F.max("_l").alias("_b"))
    spread = F.col("_b") - F.col("_a")
    shade = F.when(spread > 1e-6, (F.col("_l") - F.col("_a")) / spread).otherwise(F.col("_l"))
    return df.join(by, "map_id").withColumn("shade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade))).drop("_l", "_a", "_b")


def traversability(slope: Column, cfg: Config = Config()) -> Column:
    return F.when(slope > cfg.cliff_threshold_degrees, "BLOCKED").when(slope > cfg.vehicle_climb_angle, "DIFFICULT").otherwise("FREE")


def surface(pixels: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All fields of a pixel table: z, gradients, slope, aspect, curvatures and their class, relief and variance."""
    return classified(derived(calibrate(pixels, cfg), cfg, relief=True, rough=True), cfg)
