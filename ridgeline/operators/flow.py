"""Drainage: D8 directions, accumulation, outlets, watersheds, basins and the feature flow graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.config import Config
from ridgeline.operators import stencils
from ridgeline.operators.graphs import accumulate, nearest, numbered, pixel_id, roots
from ridgeline.sources.scratch import Scratch

#: Codes 1 to 8 clockwise from east, as (dx, dy) with y down.
D8 = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def encode(dx: Column, dy: Column) -> Column:
    """Direction code of a step; 0 for any other."""
    out = None
    for code, (a, b) in enumerate(D8, 1):
        out = (F if out is None else out).when((dx == a) & (dy == b), code)
    return out.otherwise(0)


def directions(df: DataFrame, z: str = "z") -> DataFrame:
    """Adds d8: the code of the steepest drop to a neighbour, the first of equals, 0 without a drop."""
    return stencils.apply(df, stencils.steepest(z, D8, "d8"))


def downstream(df: DataFrame) -> DataFrame:
    """map_id, id, x, y, next: the pixel that d8 points to; null if it points nowhere or off the map."""
    dx = F.element_at(F.array(*(F.lit(a) for a, _ in D8)), F.greatest(F.col("d8"), F.lit(1)))
    dy = F.element_at(F.array(*(F.lit(b) for _, b in D8)), F.greatest(F.col("d8"), F.lit(1)))
    size = df.groupBy("map_id").agg(F.max("x").alias("_w"), F.max("y").alias("_h"))  # a row a map
    df = df.join(size, "map_id").withColumn("_x", F.col("x") + dx).withColumn("_y", F.col("y") + dy)
    ok = (F.col("d8") > 0) & F.col("_x").between(F.lit(0), F.col("_w")) & F.col("_y").between(F.lit(0), F.col("_h"))
    return df.select("map_id", pixel_id().alias("id"), "x", "y", F.when(ok, pixel_id("_x", "_y")).alias("next"))


def accumulation(df: DataFrame) -> DataFrame:
    """map_id, x, y, acc."""
    net = downstream(df)
    return net.join(accumulate(net), ["map_id", "id"]).select("map_id", "x", "y", "acc")


def outlets(df: DataFrame) -> DataFrame:
    """map_id, x, y, label: pixels that flow nowhere, numbered in row-major order."""
    return named(downstream(df))


def named(net: DataFrame) -> DataFrame:
    return numbered(net.filter("next is null").select("map_id", "x", "y"), "label", ["y"], "x").select("map_id", "x", "y", "label")


def watersheds(df: DataFrame) -> DataFrame:
    """map_id, x, y, label of the outlet that the pixel drains to; where flow runs in a circle, that of the nearest labelled pixel.

    Of equally near ones the first in row-major order counts.  The search widens by rings of cells until all are labelled.
    """
    net = Scratch(df.sparkSession).keep(downstream(df))
    ends = named(net).select("map_id", pixel_id().alias("root"), "label")
    out = net.select("map_id", "id", "x", "y").join(roots(net), ["map_id", "id"]).join(ends, ["map_id", "root"], "left").select("map_id", "x", "y", "label")
    out = Scratch(df.sparkSession).keep(out)
    lost = out.filter("label is null")
    return out if lost.isEmpty() else out.filter("label is not null").unionByName(filled(lost, out.filter("label is not null")))


def filled(lost: DataFrame, known: DataFrame) -> DataFrame:
    """lost pixels with the label of the nearest known pixel of their map; null on maps without any."""
    scratch = Scratch(lost.sparkSession)
    left = scratch.keep(lost.select("map_id", "x", "y").join(known.select("map_id").distinct(), "map_id", "left_semi"))
    none = lost.join(known.select("map_id").distinct(), "map_id", "left_anti").select("map_id", "x", "y", F.lit(None).cast("long").alias("label"))
    right = known.select("map_id", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("label").cast("long").alias("label"), pixel_id().alias("place"))
    done, radius = none, 2.0
    while not left.isEmpty():
        found = scratch.keep(nearest(left, right, radius, ["map_id", "x", "y"], "place"))
        done = done.unionByName(found.select("map_id", "x", "y", "label"))
        left = scratch.keep(left.join(found.select("map_id", "x", "y"), ["map_id", "x", "y"], "left_anti"))
        radius *= 2
    return done


def basins(labels: DataFrame, cfg: Config = Config(), least_m2: float | None = None) -> DataFrame:
    """map_id, label, pixels, area_m2 of watersheds that are large enough."""
    cell = cfg.horizontal_scale**2
    by = labels.filter("label is not null").groupBy("map_id", "label").agg(F.count("*").alias("pixels")).withColumn("area_m2", F.col("pixels") * cell)
    return by.filter(F.col("area_m2") >= (cfg.watershed_min_area_m2 if least_m2 is None else least_m2))


def basin_members(features: DataFrame, labels: DataFrame, large: DataFrame) -> DataFrame:
    """map_id, basin_key, feature_id: features by the basin of their centroid; basins without features vanish."""
    at = features.select("map_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "feature_id").join(labels.select("map_id", "x", "y", "label"), ["map_id", "x", "y"])
    return at.join(large, ["map_id", "label"], "left_semi").select("map_id", F.concat(F.lit("basin_"), F.col("label").cast("string")).alias("basin_key"), "feature_id")


def stream_mask(acc: DataFrame, least: int) -> DataFrame:
    return acc.filter(F.col("acc") >= least).select("map_id", "x", "y")


def flow_edges(features: DataFrame, df: DataFrame, streams: DataFrame, cfg: Config = Config()) -> DataFrame:
    """map_id, src, dst: from a feature down its flow to the first stream pixel, and on to the nearest feature there (unless snap_method is none)."""
    net = downstream(df)
    marked = streams.select("map_id", pixel_id().alias("id"), F.lit(True).alias("wet"))
    cut = net.join(marked, ["map_id", "id"], "left").select("map_id", "id", "x", "y", F.when(F.col("wet").isNull(), F.col("next")).alias("next"), "wet")
    ends = roots(cut.select("map_id", "id", "next"))
    wet = cut.filter("wet").select("map_id", F.col("id").alias("root"), "x", "y")
    spots = features.select("map_id", "feature_id", pixel_id("cx", "cy").alias("id")).join(ends, ["map_id", "id"]).join(wet, ["map_id", "root"]).select("map_id", F.col("feature_id").alias("src"), "x", "y")
    others = features.select("map_id", F.col("feature_id").alias("dst"), F.col("cx").alias("x2"), F.col("cy").alias("y2"), "seq")
    if cfg.snap_method == "none":
        return spots.select("map_id", "src", F.lit(None).cast("string").alias("dst")).filter("false")
    found = nearest(spots, others, cfg.feature_snap_distance_px, ["map_id", "src"], "seq")
    return found.filter("src <> dst").select("map_id", "src", "dst")
