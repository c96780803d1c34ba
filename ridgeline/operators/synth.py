"""Synthetic terrain with known features, and the self test built on it.

Coordinates are metres from the map's centre, x to the east and y down.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.config import Config


@dataclass(frozen=True)
class Synthetic:
    """A recipe: shapes are added to a tilted plane one after the other, then heights are cut to the range of grays."""

    h: int = 128
    w: int = 128
    cfg: Config = Config()
    tilt: float = 0.5
    shapes: tuple = field(default=())

    def add(self, kind: str, **p) -> Synthetic:
        return replace(self, shapes=(*self.shapes, (kind, p)))

    def peak(self, x, y, height, radius, shape="gaussian"):
        return self.add("peak", x=x, y=y, height=height, radius=radius, shape=shape)

    def ridge(self, start, end, height, width):
        return self.add("ridge", start=start, end=end, height=height, width=width)

    def valley(self, start, end, depth, width):
        return self.add("valley", start=start, end=end, height=-depth, width=width)

    def saddle(self, x, y, a, b, height, radius):
        return self.add("saddle", x=x, y=y, a=a, b=b, height=height, radius=radius)

    def flat(self, x, y, width, length, height):
        return self.add("flat", x=x, y=y, width=width, length=length, height=height)

    def z(self) -> Column:
        """Height of a pixel (columns x, y) before the cut."""
        c = self.cfg
        wx, wy = (F.col("x") - self.w / 2) * c.horizontal_scale, (F.col("y") - self.h / 2) * c.horizontal_scale
        z = c.sea_level_offset + (F.col("x") / F.lit(max(1, self.w - 1)) * 2.0 - 1.0) * self.tilt
        for kind, p in self.shapes:
            if kind == "peak":
                d2 = (wx - p["x"]) * (wx - p["x"]) + (wy - p["y"]) * (wy - p["y"])
                r = float(p["radius"])
                z = z + (F.greatest(F.lit(0.0), p["height"] * (1.0 - d2 / (r * r))) if p["shape"] == "paraboloid" else p["height"] * F.exp(-d2 / (2.0 * (r / 2) ** 2)))
            elif kind in ("ridge", "valley"):
                (x0, y0), (x1, y1) = p["start"], p["end"]
                n = float((x1 - x0) ** 2 + (y1 - y0) ** 2)
                if n == 0:
                    continue
                t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((wx - x0) * (x1 - x0) + (wy - y0) * (y1 - y0)) / n))
                dx, dy = wx - (x0 + t * (x1 - x0)), wy - (y0 + t * (y1 - y0))
                z = z + p["height"] * F.exp(-(dx * dx + dy * dy) / (2.0 * p["width"] ** 2))
            elif kind == "saddle":
                dx, dy = wx - p["x"], wy - p["y"]
                far = F.sqrt(dx * dx + dy * dy)
                taper = F.greatest(F.lit(0.0), 1.0 - far / p["radius"])
                z = z + (p["a"] * dx * dx - p["b"] * dy * dy + p["height"]) * taper
            else:
                half_w, half_h = p["width"] / 2, p["length"] / 2
                px = lambda v, n: int(v / c.horizontal_scale + n / 2)
                inside = (F.col("x") >= px(p["x"] - half_w, self.w)) & (F.col("x") < px(p["x"] + half_w, self.w)) & (F.col("y") >= px(p["y"] - half_h, self.h)) & (F.col("y") < px(p["y"] + half_h, self.h))
                z = F.when(inside, F.lit(float(p["height"]))).otherwise(z)
        return F.greatest(F.lit(c.sea_level_offset), F.least(F.lit(255 * c.vertical_scale + c.sea_level_offset - 0.1), z))

    def build(self, spark: SparkSession, map_id: int = 0) -> DataFrame:
        """Pixels: map_id, y, x, z."""
        grid = spark.range(self.h * self.w).select(F.lit(map_id).alias("map_id"), F.expr(f"cast(id div {self.w} as int)").alias("y"), F.expr(f"cast(id % {self.w} as int)").alias("x"))
        return grid.select("map_id", "y", "x", self.z().alias("z"))

    def ground_truth(self, spark: SparkSession, map_id: int = 0) -> DataFrame:
        c, rows = self.cfg, []
        for kind, p in self.shapes:
            x, y = (p["x"], p["y"]) if "x" in p else ((p["start"][0] + p["end"][0]) / 2, (p["start"][1] + p["end"][1]) / 2)
            rows.append((map_id, kind, x / c.horizontal_scale + self.w / 2, y / c.horizontal_scale + self.h / 2, float(x), float(y), float(abs(p["height"])), float(p.get("radius", p.get("width", 0)))))
        return spark.createDataFrame(rows, "map_id int, type string, cx double, cy double, wx double, wy double, height_m double, radius_m double")


#: The profile and the scenarios of the self test, with the least counts expected.
PROFILE = {"exclude_below_reference": False, "saddle_confidence_threshold": 0.003, "peak_shoulder_convex_ratio": 0.0192}
SCENARIOS = {
    "peak": (Synthetic().peak(0, 0, 50, 12), {"peak": 1}),
    "ridge": (Synthetic().ridge((-118, 0), (118, 0), 40, 4), {"ridge": 1}),
    "valley": (Synthetic().valley((-118, 0), (118, 0), 30, 5), {"valley": 1}),
    "saddle": (Synthetic().peak(0, 0, 60, 10, "paraboloid").peak(-64, 0, 40, 8, "paraboloid").peak(64, 0, 40, 8, "paraboloid"), {"peak": 2, "saddle": 1}),
    "flat": (Synthetic(), {"flat_zone": 1}),
}


def self_test(spark: SparkSession) -> DataFrame:
    """scenario, feature_type, n, expected, passed: all scenarios as maps of one run."""
    from ridgeline.operators import features, fields

    cfg = replace(Config(), **PROFILE)
    names = list(SCENARIOS)
    px = None
    for k, name in enumerate(names):
        own = SCENARIOS[name][0].build(spark, k)
        px = own if px is None else px.unionByName(own)
    surface = fields.curvature(fields.slope_aspect(fields.gradient(px, cfg), cfg), cfg)
    found = features.extract(fields.classify(surface, fields.epsilons(surface, cfg)), cfg).groupBy("map_id", "feature_type").count()
    want = spark.createDataFrame([(k, name, t, n) for k, name in enumerate(names) for t, n in SCENARIOS[name][1].items()], "map_id int, scenario string, feature_type string, expected int")
    n = F.coalesce("count", F.lit(0))
    return want.join(found, ["map_id", "feature_type"], "left").select("scenario", "feature_type", n.alias("n"), "expected", (n >= F.col("expected")).alias("passed"))
