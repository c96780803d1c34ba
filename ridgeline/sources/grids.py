"""Pixel tables: images, grids derived from the star schema, validation and sinks.

A pixel table has map_id, y, x (y down) and gray; maps has map_id, h, w.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hills(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """A map a nation, a paraboloid a supplier: each one is exploded over its own footprint only."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("map_id"), ((F.col("s_suppkey") * 37) % size).alias("cx"), ((F.col("s_suppkey") * 53) % size).alias("cy"),
        (F.lit(40) + (F.col("s_suppkey") * 29) % 120).alias("h"), (F.lit(8) + (F.col("s_suppkey") * 7) % 9).alias("r"),
    )
    maps = s.select("map_id").distinct()
    grid = maps.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    clip = lambda c: F.sequence(F.greatest(F.lit(0).cast("long"), F.col(c) - F.col("r")), F.least(F.lit(size - 1).cast("long"), F.col(c) + F.col("r")))
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    lift = s.withColumn("y", F.explode(clip("cy"))).withColumn("x", F.explode(clip("cx"))).withColumn("d2", d2).filter("d2 <= r * r")
    lift = lift.groupBy("map_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.sum(F.expr("h * (r * r - d2) div (r * r)")).alias("up"))
    gray = F.least(F.lit(255), F.lit(4) + F.expr("x div 16") + F.coalesce(F.col("up"), F.lit(0))).cast("int")
    return grid.join(lift, ["map_id", "y", "x"], "left").select("map_id", "y", "x", gray.alias("gray"))


HILLS = """hills AS (
  SELECT g.map_id, g.y, g.x, least(255, 4 + g.x // 16 + coalesce(sum(CASE WHEN s.d2 <= s.r * s.r THEN s.h * (s.r * s.r - s.d2) // (s.r * s.r) END), 0))::INT AS gray
  FROM (SELECT map_id, y::INT AS y, x::INT AS x FROM (SELECT DISTINCT s_nationkey AS map_id FROM supplier), range(64) a(y), range(64) b(x)) g
  LEFT JOIN (
    SELECT map_id, y, x, h, r, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM (
      SELECT s_nationkey AS map_id, (s_suppkey * 37) % 64 AS cx, (s_suppkey * 53) % 64 AS cy, 40 + (s_suppkey * 29) % 120 AS h, 8 + (s_suppkey * 7) % 9 AS r FROM supplier) q,
      range(64) a(y), range(64) b(x)) s USING (map_id, y, x)
  GROUP BY g.map_id, g.y, g.x)"""


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square map of event values."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    w = F.floor(F.sqrt(F.lit(e.count()))).cast("long")
    out = e.withColumn("w", w).filter("event_id < w * w")
    return out.select(F.lit(0).alias("map_id"), F.expr("cast(event_id div w as int)").alias("y"), F.expr("cast(event_id % w as int)").alias("x"), F.least(F.lit(255), F.floor("value")).cast("int").alias("gray"))


NOISE = """noise AS (
  SELECT 0 AS map_id, (event_id // w)::INT AS y, (event_id % w)::INT AS x, least(255, floor(value))::INT AS gray
  FROM events, (SELECT floor(sqrt(count(*)))::BIGINT AS w FROM events) q WHERE event_id < w * w)"""


def image_ids(spark: SparkSession, path: str) -> DataFrame:
    """origin, map_id: the place (from 0) of each image file among the paths in order."""
    from pyspark.sql import Window

    files = spark.read.format("image").load(path).select("image.origin")
    return files.withColumn("map_id", (F.row_number().over(Window.orderBy("origin")) - 1).cast("int"))  # a row a file


def images(spark: SparkSession, path: str) -> DataFrame:
    """Pixel table of image files, numbered by path: 8-bit gray as it is, colours by the usual luma weights."""
    found = spark.read.format("image").load(path)
    paths = image_ids(spark, path)
    raw = found.select("image.*").join(paths, "origin")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for map_id, h, w, n, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int64)
                # Channels are blue, green, red: weights of 16 bits, rounded.
                gray = px[:, :, 0] if n == 1 else (px[:, :, 2] * 19595 + px[:, :, 1] * 38470 + px[:, :, 0] * 7471 + 32768) >> 16
                y, x = np.mgrid[0:h, 0:w]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, map_id), pa.int32()), pa.array(y.ravel(), pa.int32()), pa.array(x.ravel(), pa.int32()), pa.array(gray.ravel(), pa.int32())], ["map_id", "y", "x", "gray"])

    return raw.select("map_id", "height", "width", "nChannels", "data").mapInArrow(cut, "map_id int, y int, x int, gray int")


def maps_of(pixels: DataFrame) -> DataFrame:
    """map_id, h, w."""
    return pixels.groupBy("map_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def validate(pixels: DataFrame) -> DataFrame:
    """map_id, h, w, n, valid: whether a map is a whole rectangle of grays from 0 to 255."""
    by = pixels.groupBy("map_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count("*").alias("n"), F.min("gray").alias("low"), F.max("gray").alias("high"), F.count("gray").alias("given"))
    return by.select("map_id", "h", "w", "n", (F.expr("n = cast(h as bigint) * w and given = n and low >= 0 and high <= 255")).alias("valid"))


def with_scales(pixels: DataFrame, overrides: DataFrame | None, cfg) -> DataFrame:
    """Adds scales: those of overrides (map_id and any of three columns) win over the configuration."""
    names = ("horizontal_scale", "vertical_scale", "sea_level_offset")
    out = pixels if overrides is None else pixels.join(overrides, "map_id", "left")
    have = set() if overrides is None else set(overrides.columns)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(getattr(cfg, n))) if n in have else F.lit(getattr(cfg, n)) for n in names})


def content_hash(pixels: DataFrame) -> DataFrame:
    """map_id, content: 16 hex digits over a map's size and its rows' hashes, in order."""
    rows = pixels.groupBy("map_id", "y").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "gray"))), lambda p: p["gray"].cast("string")), ","), 256).alias("h"))
    return rows.groupBy("map_id").agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "h"))), lambda r: r["h"]), "|"), 256), 1, 16).alias("content"))


def cache_key(*parts: str) -> str:
    """16 hex digits over the parts, for a layer's folder."""
    import hashlib

    return hashlib.sha256("".join(parts).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, key: str, layer: str, make) -> DataFrame:
    """The layer's table from its Parquet folder; made and written first if it isn't there."""
    path = f"{folder}/cache_key={key}/layer={layer}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def layer_key(content: str, cfg, layer: str) -> str:
    """The key of a layer of a map of that content: all parameters of the layer and those before it, cell size included."""
    used = []
    for name, fields in LAYERS.items():
        used += [f"{f}={getattr(cfg, f)!r}" for f in fields]
        if name == layer:
            return cache_key(*(f"{len(p)}:{p}" for p in (content, layer, *used)))
    raise ValueError(f"unknown layer: {layer}")


#: Parameters by layer, in the order of layers.
LAYERS = {
    "calibration": ("horizontal_scale", "vertical_scale", "sea_level_offset", "noise_reduction_sigma"),
    "geometry": ("gradient_method", "flat_threshold_deg"),
    "curvature": ("adaptive_epsilon", "curvature_epsilon", "h_factor", "k_factor", "h_min", "k_min", "h_max", "k_max"),
}


def cached_layer(pixels: DataFrame, folder: str, cfg, layer: str, make) -> DataFrame:
    """The layer's table for these pixels; make() is asked only if no table is kept for this content and these parameters.

    Thresholds that a layer used are columns of its table (eps_h, eps_k), so they come back with it.
    """
    spark = pixels.sparkSession
    content = content_hash(pixels).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("map_id", "content"))), lambda r: F.concat_ws(":", r["map_id"], r["content"])), "|"), 256).alias("h")).first().h
    return cached(spark, folder, layer_key(content, cfg, layer), layer, make)


def save_tables(folder: str, **tables: DataFrame) -> None:
    """Keeps several tables under their names in one folder, compressed."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def to_gray(pixels: DataFrame, cfg) -> DataFrame:
    """Heights z back to grays: cut to 0..255 and truncated."""
    v = (F.col("z") - cfg.sea_level_offset) / cfg.vertical_scale
    return pixels.select("map_id", "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)).cast("int").alias("gray"))


def encode_png(gray) -> bytes:
    """An 8-bit gray PNG of a two-dimensional uint8 array."""
    import struct
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = gray.shape
    rows = b"".join(b"\0" + gray[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
