"""Data behind map panels: counts, tops, normalised costs, edge styles, quadrants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.quantiles import quantiles
from ridgeline.sources.scratch import Scratch


def counts_by_type(features: DataFrame) -> DataFrame:
    kind = F.when(F.col("feature_type").isin("peak", "ridge", "valley", "saddle", "flat_zone"), F.col("feature_type")).otherwise("OTHER")
    return features.groupBy("map_id", kind.alias("feature_type")).agg(F.count("*").alias("n"))


def top_peaks(features: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("map_id").orderBy(F.desc("prominence"), "seq")
    return features.filter("feature_type = 'peak'").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("map_id", "place", "feature_id", "prominence")


def top_basins(labels: DataFrame, n: int = 12, least: int = 100) -> DataFrame:
    by = labels.groupBy("map_id", "label").agg(F.count("*").alias("pixels")).filter(F.col("pixels") >= least)
    w = Window.partitionBy("map_id").orderBy(F.desc("pixels"), "label")
    return by.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def flat_radius(features: DataFrame) -> DataFrame:
    return features.filter("feature_type = 'flat_zone'").select("map_id", "feature_id", F.sqrt(F.col("area_pixels") / F.pi()).alias("radius_px"))


def clipped_curvature(df: DataFrame, most: float = 0.02) -> DataFrame:
    return df.withColumn("h_shown", F.greatest(F.lit(-most), F.least(F.lit(most), F.col("h_curv"))))


def cost_normalised(df: DataFrame) -> DataFrame:
    """Adds cost_norm: cost cut to the map's 5th to 95th percentile, from 0 to 1."""
    df = Scratch(df.sparkSession).keep(df)
    by = quantiles(df, _a=(F.col("cost"), 0.05), _b=(F.col("cost"), 0.95))
    cut = F.greatest(F.col("_a"), F.least(F.col("_b"), F.col("cost")))
    return df.join(by, "map_id").withColumn("cost_norm", F.when(F.col("_b") > F.col("_a"), (cut - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(F.lit(0.0))).drop("_a", "_b")


def peak_markers(features: DataFrame, cell: float, label_above: float = 30.0) -> DataFrame:
    """map_id, feature_id, wx, wy, marker_size (12 to 32, by prominence), labelled (whether prominence is over label_above)."""
    rise = F.coalesce("prominence", F.lit(10.0))
    size = F.greatest(F.lit(12.0), F.least(F.lit(32.0), 12.0 + rise / 20.0))
    return features.filter("feature_type = 'peak'").select("map_id", "feature_id", (F.col("cx") * cell).alias("wx"), (F.col("cy") * cell).alias("wy"), size.alias("marker_size"), (rise > label_above).alias("labelled"))


def outlet_markers(outlets: DataFrame, cell: float, n: int = 20) -> DataFrame:
    """map_id, label, wx, wy: the first n outlets of a map."""
    return outlets.filter(F.col("label") < n).select("map_id", F.col("label").cast("long").alias("label"), (F.col("x") * cell).alias("wx"), (F.col("y") * cell).alias("wy"))


def stream_points(streams: DataFrame, cell: float) -> DataFrame:
    """map_id, wx, wy of stream pixels (map_id, y, x) in metres."""
    return streams.select("map_id", (F.col("x") * cell).alias("wx"), (F.col("y") * cell).alias("wy"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, ends in order."""
    return edges.select("map_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _ends(edges: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    end = lambda p: features.select("map_id", F.col("feature_id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    return edges.join(end("src"), ["map_id", "src"]).join(end("dst"), ["map_id", "dst"])


def edge_drops(edges: DataFrame, features: DataFrame, n: int = 50) -> DataFrame:
    """The first n flow edges of a map, by the ends' seq, with their drop and intensity, 1 from 50 m on.  Heights are of the column elevation, or elev_max."""
    z = "elevation" if "elevation" in features.columns else "elev_max"
    both = _ends(edges, features, z, "seq").withColumn("drop_m", F.col(f"src_{z}") - F.col(f"dst_{z}"))
    w = Window.partitionBy("map_id").orderBy("src_seq", "dst_seq")
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("map_id", "src", "dst", "drop_m", F.least(F.lit(1.0), F.col("drop_m") / 50.0).alias("intensity"))


def connectivity_edges(edges: DataFrame, features: DataFrame, n: int = 100) -> DataFrame:
    """map_id, src, dst, style: the first n undirected edges of a map, from peaks by falling prominence, then from others by seq.

    style: solid between peaks, dashed from a ridge or valley, else dotted.
    """
    both = _ends(edges, features, "feature_type", "prominence", "seq")
    rank = lambda p: F.struct((F.col(f"{p}_feature_type") != "peak").alias("other"), F.when(F.col(f"{p}_feature_type") == "peak", -F.coalesce(f"{p}_prominence", F.lit(0.0))).otherwise(0.0).alias("rise"), F.col(f"{p}_seq").alias("seq"))
    # Of the two directions the one from the end that comes first counts.
    both = both.withColumn("mine", rank("src")).withColumn("theirs", rank("dst")).filter("mine < theirs")
    style = F.when((F.col("src_feature_type") == "peak") & (F.col("dst_feature_type") == "peak"), "solid").when(F.col("src_feature_type").isin("ridge", "valley"), "dashed").otherwise("dotted")
    w = Window.partitionBy("map_id").orderBy("mine", "dst_seq")
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("map_id", "src", "dst", style.alias("style"))


def peak_sights(edges: DataFrame, features: DataFrame, n: int = 30) -> DataFrame:
    """map_id, src, dst: sight lines between peaks, both ways, source by source in order of seq until n are drawn; the last source is drawn whole."""
    kind = features.filter("feature_type = 'peak'")
    both = _ends(edges, kind, "seq")
    per = both.groupBy("map_id", "src_seq").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("map_id").orderBy("src_seq")) - F.col("n")
    drawn = per.withColumn("before", before).filter(F.col("before") < n).select("map_id", "src_seq")
    return both.join(drawn, ["map_id", "src_seq"], "left_semi").select("map_id", "src", "dst")


def downsampled(df: DataFrame, column: str, rows: int = 512) -> DataFrame:
    """map_id, y, x, column: maps of more than ``rows`` lines resampled linearly to that many, others as they are.

    The new grid's corners are the old ones; a new pixel is the weighted mean of four old ones.
    """
    size = df.groupBy("map_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    share = F.lit(float(rows)) / F.col("h")
    size = size.withColumn("h2", F.when(F.col("h") > rows, F.lit(rows)).otherwise(F.col("h"))).withColumn("w2", F.when(F.col("h") > rows, F.greatest(F.lit(1), F.round(F.col("w") * share).cast("int"))).otherwise(F.col("w")))
    small = df.join(size.filter("h = h2").select("map_id"), "map_id", "left_semi").select("map_id", "y", "x", F.col(column).cast("double").alias(column))
    step = lambda a, b: F.when(F.col(b) > 1, (F.col(a) - 1) / (F.col(b) - 1)).otherwise(F.lit(0.0))
    grid = size.filter("h > h2").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h2") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w2") - 1)))
    grid = grid.withColumn("ay", F.col("y") * step("h", "h2")).withColumn("ax", F.col("x") * step("w", "w2"))
    corner = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1))))
    weight = lambda a, k: F.when(F.col(k) == 0, 1 - (F.col(a) - F.floor(a))).otherwise(F.col(a) - F.floor(a))
    spots = grid.withColumn("c", corner).withColumn("j", F.col("c.j")).withColumn("i", F.col("c.i"))
    spots = spots.select("map_id", "y", "x", (F.floor("ay") + F.col("j")).cast("int").alias("oy"), (F.floor("ax") + F.col("i")).cast("int").alias("ox"), (weight("ay", "j") * weight("ax", "i")).alias("share")).filter("share > 0")
    old = df.select("map_id", F.col("y").alias("oy"), F.col("x").alias("ox"), F.col(column).cast("double").alias("v"))
    big = spots.join(old, ["map_id", "oy", "ox"]).groupBy("map_id", "y", "x").agg((F.sum(F.col("v") * F.col("share")) / F.sum("share")).alias(column))
    return small.unionByName(big)


def quadrants(features: DataFrame, w: int, h: int) -> DataFrame:
    """map_id, quadrant, n: the least crowded corner for a legend; ties by LL, LR, UL, UR."""
    names = F.array(*(F.lit(x) for x in ("LL", "LR", "UL", "UR")))
    every = features.select("map_id").distinct().withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    q = F.when(F.col("cy") >= h / 2, 0).otherwise(2) + F.when(F.col("cx") >= w / 2, 1).otherwise(0)
    by = every.join(features.select("map_id", q.alias("q"), F.lit(1).alias("one")), ["map_id", "q"], "left").groupBy("map_id", "q").agg(F.count("one").alias("n"))
    best = by.groupBy("map_id").agg(F.min(F.struct("n", "q")).alias("m"))
    return best.select("map_id", F.element_at(names, F.col("m.q") + 1).alias("quadrant"), F.col("m.n").alias("n"))
