"""Typed features from fields: peaks, ridges, valleys, saddles and flat zones, in one wide table.

Columns: map_id, seq, feature_id, feature_type, cx, cy, elev_min, elev_max, confidence, avg_slope, and those of
single types, null for the others.  seq numbers a map's features by type, then by place.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.config import Config
from ridgeline.operators import kernels, stencils
from ridgeline.operators.fields import k_confidence, relief_steps
from ridgeline.operators.flow import accumulation
from ridgeline.operators.graphs import LINE, at_least, components, numbered, pixel_id, radius_join, settle, suppress

TYPES = ("peak", "ridge", "valley", "saddle", "flat_zone")
EXTRA = {
    "prominence": "double", "defensive_rating": "double", "size": "long", "spine": "array<struct<x:int,y:int>>", "length": "int", "width_m": "double", "kind": "string",
    "drainage_area": "double", "saddle_elevation_m": "double", "k_curvature": "double", "area_pixels": "long", "area_m2": "double", "min_slope": "double", "max_slope": "double", "x_min": "int", "x_max": "int", "y_min": "int", "y_max": "int", "mean_z": "double",
}


def plateau_step(column: str, out: str) -> stencils.Step:
    """0 below a neighbour, 1 on top of all, 2 likewise but beside a pixel of the same height that has a higher neighbour."""

    def work(f: stencils.Fields) -> None:
        z = f[column]

        def top(a):
            wide = np.pad(np.where(np.isnan(a), -np.inf, a), 1, constant_values=-np.inf)
            return np.max([wide[1 + dy : 1 + dy + z.shape[0], 1 + dx : 1 + dx + z.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)

        under = top(z) > z
        f[out] = np.where(under, 0, 1 + (top(np.where(under, z, -np.inf)) == z))

    return stencils.Step(2, (column,), (out,), work, "int")


def regional_maxima(df: DataFrame, flat: str) -> DataFrame:
    """map_id, y, x, label of plateaus (8-connected) with no higher neighbour, by what plateau_step made.

    Neighbours that are both on top of all around them are of equal height.  So the 8-connected parts of such pixels are
    whole plateaus, unless one of their pixels is beside one of the same height that isn't on top.
    """
    px = settle(df.filter(F.col(flat) > 0).select("map_id", "y", "x", F.col(flat).alias("flat")))
    parts = settle(components(px, eight=True).join(px, ["map_id", "y", "x"]))
    bad = parts.filter("flat = 2").select("map_id", "label").distinct()
    return components(parts.join(bad, ["map_id", "label"], "left_anti").select("map_id", "y", "x"))


def away_from_border(df: DataFrame, margin: int) -> DataFrame:
    """Pixels at least ``margin`` from the map's edges; from the far ones, that many from the last pixel."""
    size = df.groupBy("map_id").agg(F.max("x").alias("_w"), F.max("y").alias("_h"))  # a row a map
    inside = F.col("x").between(F.lit(margin), F.col("_w") - margin) & F.col("y").between(F.lit(margin), F.col("_h") - margin)
    return df.join(size, "map_id").filter(inside).drop("_w", "_h")


def peaks(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Summits of the smoothed surface whose surroundings are convex enough and that rise enough; box maxima where a map has none."""
    steps = () if "relief" in df.columns else relief_steps(cfg)
    df = stencils.apply(df, *steps, stencils.blur("z", cfg.peak_smooth_sigma, "_s"), plateau_step("_s", "_flat"), stencils.box("z", -3, 3, "max", "_top"))
    df = df.withColumn("relief", F.col("z") - F.col("_low")) if steps else df
    df = settle(df.select("map_id", "y", "x", "z", "slope", "curvature_type", "relief", "_flat", "_top"))
    main = settle(summits(df, at_least(settle(regional_maxima(df, "_flat")), cfg.min_peak_size_px), cfg))
    cell = cfg.horizontal_scale
    inner, outer = max(2, int(cfg.annular_inner_m / cell)), max(10, int(cfg.annular_outer_m / cell))
    ring = [(i, j) for i in range(-outer, outer + 1) for j in range(-outer, outer + 1) if inner * inner <= i * i + j * j <= outer * outer]
    offsets = df.sparkSession.createDataFrame(ring, "dx int, dy int")
    spots = main.crossJoin(F.broadcast(offsets)).select("map_id", "label", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"))  # a fixed ring of offsets
    shares = spots.join(df.select("map_id", "y", "x", F.col("curvature_type").isin("CONVEX", "CYLINDRICAL_CONVEX").cast("double").alias("c")), ["map_id", "y", "x"]).groupBy("map_id", "label").agg(F.avg("c").alias("share"), F.count("*").alias("n"))
    good = main.join(shares, ["map_id", "label"]).filter((F.col("n") >= cfg.peak_min_shoulder_samples) & (F.col("share") >= cfg.peak_shoulder_convex_ratio) & (F.col("prominence") > cfg.peak_min_prominence_m))
    good = settle(good.drop("share", "n"))
    spare = settle(away_from_border(df, cfg.border_margin_px).filter("z = _top").join(good.select("map_id").distinct(), "map_id", "left_anti").select("map_id", "y", "x"))
    if spare.isEmpty():
        return good
    second = summits(df, at_least(settle(components(spare)), 2 * cfg.min_peak_size_px), cfg).filter(F.col("prominence") > cfg.peak_min_prominence_m)
    return good.unionByName(second)


def summits(df: DataFrame, label: DataFrame, cfg: Config) -> DataFrame:
    """A row for each labelled summit, with its attributes; relief as prominence."""
    by = label.join(df, ["map_id", "y", "x"]).groupBy("map_id", "label").agg(F.floor(F.avg("x")).cast("int").alias("cx"), F.floor(F.avg("y")).cast("int").alias("cy"), F.min("z").alias("elev_min"), F.avg("slope").alias("avg_slope"), F.count("*").alias("size"))
    at = df.select("map_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("elev_max"), F.col("relief").alias("prominence"))
    by = by.join(at, ["map_id", "cx", "cy"])
    defence = F.least(F.lit(1.0), F.col("prominence") / 15.0 * (1.0 - F.abs(F.col("avg_slope") - 15.0) / 30.0))
    return by.withColumn("defensive_rating", defence).withColumn("confidence", F.least(F.lit(1.0), F.col("prominence") / cfg.peak_confidence))


def lines(df: DataFrame, cfg: Config, kinds: tuple[str, ...], ridge: bool) -> DataFrame:
    """Ridges or valleys: thinned lines of a curvature mask, long enough, with ordered spines."""
    mask = settle(df.filter(F.col("curvature_type").isin(*kinds)).select("map_id", "y", "x"))
    solid = settle(at_least(components(mask), cfg.min_ridge_length_px))
    thinned = settle(at_least(components(settle(kernels.skeleton(solid))), cfg.min_ridge_length_px))
    path = settle(kernels.spines(thinned))
    w = Window.partitionBy("map_id", "label").orderBy("ord")
    half = cfg.smooth_spine_window // 2
    n = F.count("*").over(Window.partitionBy("map_id", "label"))
    px, py = F.col("x"), F.col("y")
    if ridge:
        frame = w.rowsBetween(-half, half)
        px = F.when(n >= cfg.smooth_spine_window, F.avg("x").over(frame).cast("int")).otherwise(F.col("x"))
        py = F.when(n >= cfg.smooth_spine_window, F.avg("y").over(frame).cast("int")).otherwise(F.col("y"))
    path = path.withColumn("px", px).withColumn("py", py)
    both = path.join(df.select("map_id", "y", "x", "z", "slope", "h_curv", "curvature_type"), ["map_id", "y", "x"])
    cell = cfg.horizontal_scale
    top = "CONVEX" if ridge else "CONCAVE"
    by = both.groupBy("map_id", "label").agg(
        F.floor(F.avg("x")).cast("int").alias("cx"), F.floor(F.avg("y")).cast("int").alias("cy"), F.min("z").alias("elev_min"), F.max("z").alias("elev_max"),
        F.count("*").cast("int").alias("length"), F.avg("slope").alias("_slope"), F.avg(F.abs("h_curv")).alias("_h"), F.max((F.col("curvature_type") == top).cast("int")).alias("_top"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "px", "py"))), lambda p: F.struct(p["px"].cast("int").alias("x"), p["py"].cast("int").alias("y"))).alias("spine"),
    )
    by = by.withColumn("width_m", F.when(F.col("_h") > 1e-6, 1.0 / (F.col("_h") * cell)).otherwise(F.lit(cell))).withColumn("confidence", F.least(F.lit(1.0), F.col("length") / 50.0))
    if ridge:
        return by.withColumn("kind", F.when(F.col("_top") == 1, "dome_crest").otherwise("linear_crest")).withColumn("avg_slope", F.lit(15.0)).drop("_slope", "_h", "_top")
    return by.withColumn("kind", F.when(F.col("_top") == 1, "bowl_bottom").otherwise("linear_valley")).withColumn("avg_slope", F.col("_slope")).withColumn("drainage_area", F.col("length") * cell * cell * 10.0).drop("_slope", "_h", "_top")


def saddles(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Saddle pixels away from the border and above the sea, thinned out by strength, then by strength and confidence."""
    px = away_from_border(k_confidence(df), cfg.border_margin_px).filter((F.col("curvature_type") == "SADDLE") & (F.col("z") > cfg.sea_level_offset + 1.0))
    px = settle(px.select("map_id", pixel_id().alias("id"), "x", "y", F.abs("k_curv").alias("strength"), "k_confidence", "z", "slope"))
    kept = px.join(suppress(px, cfg.nms_radius_px), ["map_id", "id"]).filter((F.col("strength") >= cfg.saddle_k_min_threshold) & (F.col("k_confidence") >= cfg.saddle_confidence_threshold))
    return kept.select("map_id", F.col("id").alias("label"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("elev_min"), F.col("z").alias("elev_max"), F.col("k_confidence").alias("confidence"), F.col("slope").alias("avg_slope"), F.col("z").alias("saddle_elevation_m"), F.col("strength").alias("k_curvature"))


def flat_zones(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    mask = settle(df.filter((F.col("slope") < cfg.flat_zone_slope_threshold_deg) & (F.col("z") >= cfg.sea_level_offset)).select("map_id", "y", "x", "z", "slope"))
    both = at_least(settle(components(mask)), cfg.min_flat_zone_size_px).join(mask, ["map_id", "y", "x"])
    by = both.groupBy("map_id", "label").agg(F.floor(F.avg("x")).cast("int").alias("cx"), F.floor(F.avg("y")).cast("int").alias("cy"), F.min("z").alias("elev_min"), F.max("z").alias("elev_max"), F.avg("slope").alias("avg_slope"), F.count("*").alias("area_pixels"), F.min("slope").alias("min_slope"), F.max("slope").alias("max_slope"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return by.withColumn("area_m2", F.col("area_pixels") * cfg.horizontal_scale**2).withColumn("confidence", F.lit(1.0))


def purge(features: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Without features below the reference level: peaks and ridges by their top, valleys and flats by their bottom, saddles by their mean."""
    if not cfg.exclude_below_reference:
        return features
    level = F.when(F.col("feature_type").isin("peak", "ridge"), F.col("elev_max")).when(F.col("feature_type").isin("valley", "flat_zone"), F.col("elev_min")).otherwise((F.col("elev_min") + F.col("elev_max")) / 2)
    return features.filter(level >= cfg.elevation_reference_m)


def assemble(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of features of all types, numbered and named."""
    out = None
    for k, kind in enumerate(TYPES):
        df = parts[kind]
        have = set(df.columns)
        rows = df.select("map_id", F.lit(k).alias("_t"), F.lit(kind).alias("feature_type"), "label", "cx", "cy", "elev_min", "elev_max", "confidence", "avg_slope", *(F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in EXTRA.items()))
        out = rows if out is None else out.unionByName(rows)
    out = numbered(settle(out.withColumn("_line", F.floor(F.col("label") / LINE))), "seq", ["_t", "_line"], "label").drop("_line")
    return out.withColumn("feature_id", F.sha2(F.concat_ws("|", "map_id", "feature_type", "cx", "cy", "seq"), 256)).drop("_t", "label")


def extract(fields: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All features of a surface, with the ids of those they are linked to, and z at their centroids as elevation."""
    fields = settle(fields)
    parts = {
        "peak": peaks(fields, cfg),
        "ridge": lines(fields, cfg, ("CONVEX", "CYLINDRICAL_CONVEX"), True),
        "valley": lines(fields, cfg, ("CONCAVE", "CYLINDRICAL_CONCAVE"), False),
        "saddle": saddles(fields, cfg),
        "flat_zone": flat_zones(fields, cfg),
    }
    found = settle(purge(assemble(parts), cfg))
    at = fields.select("map_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("elevation"))
    return settle(with_links(found, cfg).join(at, ["map_id", "cx", "cy"], "left"))


def with_links(features: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds connected_peaks (of ridges: peaks near an end), connecting_ridges and connecting_valleys (of saddles: near a spine point): sorted ids, null for other types."""

    def linked(edges: DataFrame, own: str, other: str, name: str, kind: str) -> DataFrame:
        ids = edges.groupBy("map_id", F.col(own).alias("feature_id")).agg(F.sort_array(F.collect_set(other)).alias(name))
        return out.join(ids, ["map_id", "feature_id"], "left").withColumn(name, F.when(F.col("feature_type") == kind, F.coalesce(name, F.array().cast("array<string>"))))

    out = features
    out = linked(spine_links(features, "peak", "ridge", cfg, ends_only=True), "dst", "src", "connected_peaks", "ridge")
    out = linked(spine_links(features, "saddle", "ridge", cfg), "src", "dst", "connecting_ridges", "saddle")
    return linked(spine_links(features, "saddle", "valley", cfg), "src", "dst", "connecting_valleys", "saddle")


def spine_links(features: DataFrame, left: str, right: str, cfg: Config = Config(), ends_only: bool = False) -> DataFrame:
    """map_id, src, dst: features of type left near a spine point (or an end of a spine) of features of type right."""
    spine = features.filter((F.col("feature_type") == right) & (F.size("spine") >= (2 if ends_only else 1)))
    points = F.array(F.element_at("spine", 1), F.element_at("spine", -1)) if ends_only else F.col("spine")
    spots = spine.select("map_id", F.col("feature_id").alias("dst"), F.explode(points).alias("p")).select("map_id", "dst", F.col("p.x").alias("x2"), F.col("p.y").alias("y2"))
    own = features.filter(F.col("feature_type") == left).select("map_id", F.col("feature_id").alias("src"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return radius_join(own, spots, cfg.feature_connection_tolerance_px).select("map_id", "src", "dst").distinct()


def polyline_length(spine, scale: float):
    """Length in metres of a spine column."""
    ahead = F.slice(spine, 2, F.greatest(F.size(spine) - 1, F.lit(0)))
    steps = F.zip_with(ahead, F.slice(spine, 1, F.size(ahead)), lambda b, a: F.sqrt(((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])).cast("double")))
    return F.when(F.size(spine) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) * scale)


def contains_point(spine, x: float, y: float, tolerance: float):
    return F.exists(spine, lambda p: F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)) < tolerance)


def smooth_points(points: DataFrame, window: int) -> DataFrame:
    """points (key, ord, x, y): moving average, cut at the ends, truncated; left alone below ``window`` points."""
    w = Window.partitionBy("key").orderBy("ord").rowsBetween(-(window // 2), window // 2)
    n = F.count("*").over(Window.partitionBy("key"))
    return points.select("key", "ord", *(F.when(n >= window, F.avg(c).over(w).cast("int")).otherwise(F.col(c).cast("int")).alias(c) for c in ("x", "y")))


def stream_lines(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Thinned stream pixels of a routed map (map_id, y, x, d8), without small pieces."""
    acc = accumulation(df).filter(F.col("acc") >= cfg.stream_accumulation_threshold_px)
    return at_least(components(settle(kernels.skeleton(acc))), cfg.stream_min_size_px).select("map_id", "y", "x")


