"""All queries of the terrain engine, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.config import Config
from ridgeline.functions import panels
from ridgeline.functions.describe import describe
from ridgeline.operators import features as feature_ops
from ridgeline.operators import fields, flow, kernels, relations, stencils, synth
from ridgeline.operators.graphs import at_least, components, radius_join, settle, suppress
from ridgeline.plans import oracle as o
from ridgeline.plans import shell
from ridgeline.plans.query import Query, by_prefix, ping, ping_from
from ridgeline.sources import grids

CFG = Config()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def rounded(column: str, digits: int = 6) -> Column:
    v = F.round(F.col(column), digits)
    return F.when(v == 0, F.lit(0.0)).otherwise(v).alias(column)


PX = ("map_id", "y", "x")


# Fields over the derived hills.


def heights(spark, sf_dir) -> DataFrame:
    return fields.blur(fields.calibrate(grids.hills(spark, sf_dir), CFG), "z", CFG.noise_reduction_sigma)


def curved(spark, sf_dir, **more) -> DataFrame:
    return fields.derived(fields.calibrate(grids.hills(spark, sf_dir), CFG), CFG, **more)


def classified(spark, sf_dir) -> DataFrame:
    return fields.classified(curved(spark, sf_dir), CFG)


def smoothed(spark, sf_dir, *steps, cfg: Config = CFG) -> DataFrame:
    """Blurred heights, with what further steps make of them."""
    return stencils.apply(fields.calibrate(grids.hills(spark, sf_dir), cfg), stencils.blur("z", cfg.noise_reduction_sigma), *steps)


@query("input_validation", f"WITH {grids.HILLS} SELECT map_id, max(y) + 1 AS h, max(x) + 1 AS w, count(*) AS n, count(*) = (max(y) + 1) * (max(x) + 1) AND min(gray) >= 0 AND max(gray) <= 255 AS valid FROM hills GROUP BY map_id")
def input_validation(spark, sf_dir):
    return grids.validate(grids.hills(spark, sf_dir))


@query("noise_pixels", f"WITH {grids.NOISE} SELECT * FROM noise")
def noise_pixels(spark, sf_dir):
    return grids.noise(spark, sf_dir)


@query("calibrate", o.chain(2, "", f"SELECT map_id, y, x, {o.r('z', 'z')} FROM z0"))
def calibrate(spark, sf_dir):
    return fields.calibrate(grids.hills(spark, sf_dir), CFG).select(*PX, rounded("z"))


@query("metadata_override", f"WITH {grids.HILLS} SELECT map_id, y, x, {o.r('gray * CASE WHEN map_id % 2 = 0 THEN 0.25::DOUBLE ELSE 0.492::DOUBLE END + 0.1::DOUBLE', 'z')} FROM hills")
def metadata_override(spark, sf_dir):
    px = grids.hills(spark, sf_dir)
    own = px.select("map_id").distinct().filter("map_id % 2 = 0").withColumn("vertical_scale", F.lit(0.25))
    return fields.calibrate(grids.with_scales(px, own, CFG), CFG).select(*PX, rounded("z"))


@query("gaussian_blur", o.chain(3, "", f"SELECT map_id, y, x, {o.r('z', 'z')} FROM zz"))
def gaussian_blur(spark, sf_dir):
    return heights(spark, sf_dir).select(*PX, rounded("z"))


@query("surface_validation", o.chain(3, "", f"SELECT map_id, 0::BIGINT AS bad, {o.r('max(z) - min(z)', 'spread')}, max(z) - min(z) > 10000 AS wide FROM zz GROUP BY map_id"))
def surface_validation(spark, sf_dir):
    return fields.surface_checks(heights(spark, sf_dir), CFG).select("map_id", "bad", rounded("spread"), "wide")


@query("pixel_to_world", f"WITH {grids.HILLS} SELECT map_id, y, x, x * 2.0::DOUBLE AS easting, y * 2.0::DOUBLE AS northing FROM hills")
def pixel_to_world(spark, sf_dir):
    return fields.world(grids.hills(spark, sf_dir), CFG).select(*PX, "easting", "northing")


@query("elevation_at", f"WITH {grids.HILLS}, p AS (SELECT s_suppkey AS id, s_nationkey AS map_id, ((s_suppkey * 11) % 80)::INT AS x, ((s_suppkey * 7) % 80)::INT AS y FROM supplier) SELECT id, map_id, x, y, {o.r('gray * 0.492::DOUBLE + 0.1::DOUBLE', 'z')} FROM p LEFT JOIN hills USING (map_id, x, y)")
def elevation_at(spark, sf_dir):
    p = grids.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS map_id", "cast((s_suppkey * 11) % 80 as int) AS x", "cast((s_suppkey * 7) % 80 as int) AS y")
    return fields.elevation_at(fields.calibrate(grids.hills(spark, sf_dir), CFG), p).select("id", "map_id", "x", "y", rounded("z"))


@query("gradient_central", o.chain(4, "", f"SELECT map_id, y, x, {o.r('dz_dx', 'dz_dx')}, {o.r('dz_dy', 'dz_dy')} FROM gr"))
def gradient_central(spark, sf_dir):
    return smoothed(spark, sf_dir, fields.gradient_step(CFG)).select(*PX, rounded("dz_dx"), rounded("dz_dy"))


@query("gradient_sobel", o.chain(3, o.SOBEL, f"SELECT map_id, y, x, {o.r('dz_dx', 'dz_dx')}, {o.r('dz_dy', 'dz_dy')} FROM sq"))
def gradient_sobel(spark, sf_dir):
    return smoothed(spark, sf_dir, fields.gradient_step(replace(CFG, gradient_method="sobel"))).select(*PX, rounded("dz_dx"), rounded("dz_dy"))


@query("slope_aspect", o.chain(5, "", f"SELECT map_id, y, x, {o.r('slope', 'slope')}, {o.r('aspect', 'aspect', 4)} FROM sa"))
def slope_aspect(spark, sf_dir):
    return fields.slope_aspect(smoothed(spark, sf_dir, fields.gradient_step(CFG)), CFG).select(*PX, rounded("slope"), rounded("aspect", 4))


@query("curvature_hk", o.chain(6, "", f"SELECT map_id, y, x, {o.r('h_curv', 'h_curv', 8)}, {o.r('k_curv', 'k_curv', 8)} FROM cu"))
def curvature_hk(spark, sf_dir):
    return curved(spark, sf_dir).select(*PX, rounded("h_curv", 8), rounded("k_curv", 8))


@query("curvature_epsilon", o.chain(7, "", f"SELECT map_id, {o.r('eps_h', 'eps_h', 9)}, {o.r('eps_k', 'eps_k', 9)} FROM ep"))
def curvature_epsilon(spark, sf_dir):
    return fields.epsilons(settle(curved(spark, sf_dir)), CFG).select("map_id", rounded("eps_h", 9), rounded("eps_k", 9))


@query("curvature_class_counts", o.chain(8, "", "SELECT map_id, curvature_type, count(*) AS n FROM cl GROUP BY map_id, curvature_type"))
def curvature_class_counts(spark, sf_dir):
    return fields.class_counts(classified(spark, sf_dir))


@query("curvature_mask", o.chain(8, "", "SELECT map_id, y, x FROM cl WHERE curvature_type = 'SADDLE'"))
def curvature_mask(spark, sf_dir):
    return classified(spark, sf_dir).filter("curvature_type = 'SADDLE'").select(*PX)


@query("k_confidence", o.chain(6, "p9 AS (SELECT map_id, quantile_cont(abs(k_curv), 0.9) AS p FROM cu WHERE k_curv <> 0 GROUP BY map_id)", f"SELECT map_id, y, x, {o.r('greatest(0.0, least(1.0, abs(k_curv) / greatest(coalesce(p, 1.0), 1e-8)))', 'k_confidence')} FROM cu LEFT JOIN p9 USING (map_id)"))
def k_confidence(spark, sf_dir):
    return fields.k_confidence(settle(curved(spark, sf_dir))).select(*PX, rounded("k_confidence"))


_R = CFG.prominence_radius_px


@query("prominence", o.chain(3, f"lo AS (SELECT *, min(z) OVER (PARTITION BY map_id, y ORDER BY x ROWS BETWEEN {_R} PRECEDING AND {_R - 1} FOLLOWING) AS a FROM zz), l2 AS (SELECT *, min(a) OVER (PARTITION BY map_id, x ORDER BY y ROWS BETWEEN {_R} PRECEDING AND {_R - 1} FOLLOWING) AS b FROM lo)", f"SELECT map_id, y, x, {o.r('z - b', 'relief')} FROM l2"))
def prominence(spark, sf_dir):
    df = smoothed(spark, sf_dir, *fields.relief_steps(CFG))
    return df.withColumn("relief", F.col("z") - F.col("_low")).select(*PX, rounded("relief"))


@query("strict_maxima", f"WITH {grids.HILLS} SELECT a.map_id, a.y, a.x FROM hills a JOIN hills b ON a.map_id = b.map_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.map_id, a.y, a.x HAVING count(CASE WHEN b.gray >= a.gray THEN 1 END) = 1")
def strict_maxima(spark, sf_dir):
    return stencils.apply(grids.hills(spark, sf_dir), stencils.strict_top("gray", "top")).filter("top = 1").select(*PX)


@query("roughness", o.chain(3, o.ROUGH.format(source="zz"), f"SELECT map_id, y, x, {o.r('variance', 'variance', 4)} FROM ro"))
def roughness(spark, sf_dir):
    return smoothed(spark, sf_dir, stencils.variance("z", "variance")).select(*PX, rounded("variance", 4))


def priced(spark, sf_dir, function: str, unit: str = "time") -> DataFrame:
    return fields.cost(curved(spark, sf_dir, rough=True), CFG, function, unit)


for _name, _function, _unit in (("tobler", "tobler", "time"), ("vehicle", "vehicle_quadratic", "time"), ("energy", "tobler", "energy"), ("risk", "tobler", "risk")):
    query(f"cost_surface_{_name}", o.costs(_name))(lambda spark, sf_dir, f=_function, u=_unit: priced(spark, sf_dir, f, u).select(*PX, rounded("cost")))


@query("cost_normalised", o.costs("tobler", ", pc AS (SELECT map_id, quantile_cont(cost, 0.05) AS a, quantile_cont(cost, 0.95) AS b FROM co GROUP BY map_id)", f"SELECT map_id, y, x, {o.r('CASE WHEN b > a THEN (greatest(a, least(b, cost)) - a) / (b - a) ELSE 0.0 END', 'cost_norm')} FROM co JOIN pc USING (map_id)"))
def cost_normalised(spark, sf_dir):
    return panels.cost_normalised(priced(spark, sf_dir, "tobler")).select(*PX, rounded("cost_norm"))


_LIGHT = "(-6.0::DOUBLE * dz_dx * (cos(radians(-225.0::DOUBLE)) * cos(radians(45.0::DOUBLE))) + 6.0::DOUBLE * dz_dy * (sin(radians(-225.0::DOUBLE)) * cos(radians(45.0::DOUBLE))) + sin(radians(45.0::DOUBLE))) / sqrt(1.0::DOUBLE + 36.0::DOUBLE * dz_dx * dz_dx + 36.0::DOUBLE * dz_dy * dz_dy)"


@query("hillshade", o.chain(4, f"li AS (SELECT map_id, y, x, {_LIGHT} AS l FROM gr), lr AS (SELECT map_id, min(l) AS a, max(l) AS b FROM li GROUP BY map_id)", f"SELECT map_id, y, x, {o.r('greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN b - a > 1e-6 THEN (l - a) / (b - a) ELSE l END))', 'shade')} FROM li JOIN lr USING (map_id)"))
def hillshade(spark, sf_dir):
    return fields.hillshade(smoothed(spark, sf_dir, fields.gradient_step(CFG)), CFG).select(*PX, rounded("shade"))


@query("curvature_panel", o.chain(6, "", f"SELECT map_id, y, x, {o.r('greatest(-0.02, least(0.02, h_curv))', 'h_shown')} FROM cu"))
def curvature_panel(spark, sf_dir):
    return panels.clipped_curvature(curved(spark, sf_dir)).select(*PX, rounded("h_shown"))


@query("traversability", o.chain(5, "", "SELECT map_id, CASE WHEN slope > 45 THEN 'BLOCKED' WHEN slope > 25 THEN 'DIFFICULT' ELSE 'FREE' END AS class, count(*) AS n FROM sa GROUP BY ALL"))
def traversability(spark, sf_dir):
    df = fields.slope_aspect(smoothed(spark, sf_dir, fields.gradient_step(CFG)), CFG)
    return df.groupBy("map_id", fields.traversability(F.col("slope"), CFG).alias("class")).agg(F.count("*").alias("n"))


@query("image_sink", f"WITH {grids.HILLS} SELECT map_id, y, x, greatest(0, least(255, trunc((gray * 0.492::DOUBLE + 0.35::DOUBLE - 0.1::DOUBLE) / 0.492::DOUBLE)))::INT AS gray FROM hills")
def image_sink(spark, sf_dir):
    return grids.to_gray(grids.hills(spark, sf_dir).withColumn("z", F.col("gray") * F.lit(0.492) + F.lit(0.35)), CFG)


@query("content_hash", f"""WITH {grids.HILLS}, rw AS (SELECT map_id, y, sha256(string_agg(gray::VARCHAR, ',' ORDER BY x)) AS h FROM hills GROUP BY map_id, y) SELECT map_id, substr(sha256(string_agg(h, '|' ORDER BY y)), 1, 16) AS content FROM rw GROUP BY map_id""")
def content_hash(spark, sf_dir):
    return grids.content_hash(grids.hills(spark, sf_dir))


# Drainage over the noise map.


def drained(spark, sf_dir) -> DataFrame:
    return flow.directions(grids.noise(spark, sf_dir), "gray")


@query("d8_direction", o.flow("", "SELECT map_id, y, x, d8 FROM di"))
def d8_direction(spark, sf_dir):
    return drained(spark, sf_dir).select(*PX, "d8")


@query("d8_accumulation", o.flow(o.ACC, "SELECT map_id, id // 4294967296 AS y, id % 4294967296 AS x, count(*) AS acc FROM ac GROUP BY map_id, id"))
def d8_accumulation(spark, sf_dir):
    return flow.accumulation(drained(spark, sf_dir)).select("map_id", F.col("y").cast("long"), F.col("x").cast("long"), "acc")


@query("watershed_outlets", o.flow("", "SELECT map_id, y, x, label FROM ol"))
def watershed_outlets(spark, sf_dir):
    return flow.outlets(drained(spark, sf_dir)).select(*PX, F.col("label").cast("long"))


@query("watershed_labels", o.flow(o.LABELS, "SELECT map_id, y, x, label FROM la"))
def watershed_labels(spark, sf_dir):
    return flow.watersheds(drained(spark, sf_dir)).select(*PX, F.col("label").cast("long"))


@query("basin_areas", o.flow(o.LABELS, "SELECT map_id, label, count(*) AS pixels, count(*) * 4.0::DOUBLE AS area_m2 FROM la GROUP BY map_id, label HAVING count(*) * 4 >= 40"))
def basin_areas(spark, sf_dir):
    return flow.basins(flow.watersheds(drained(spark, sf_dir)), CFG, 40.0).withColumn("label", F.col("label").cast("long"))


@query("top_basins", o.flow(o.LABELS, "SELECT map_id, label, n AS pixels, place FROM (SELECT map_id, label, n, row_number() OVER (PARTITION BY map_id ORDER BY n DESC, label) AS place FROM (SELECT map_id, label, count(*) AS n FROM la GROUP BY map_id, label HAVING count(*) >= 10)) WHERE place <= 12"))
def top_basins(spark, sf_dir):
    return panels.top_basins(flow.watersheds(drained(spark, sf_dir)), 12, 10).select("map_id", F.col("label").cast("long"), "pixels", F.col("place").cast("long"))


@query("stream_mask", o.flow(o.ACC, "SELECT map_id, id // 4294967296 AS y, id % 4294967296 AS x FROM ac GROUP BY map_id, id HAVING count(*) >= 10"))
def stream_mask(spark, sf_dir):
    return flow.stream_mask(flow.accumulation(drained(spark, sf_dir)), 10).select("map_id", F.col("y").cast("long"), F.col("x").cast("long"))


@query("assign_features_to_basins", o.flow(o.LABELS + ", " + o.TRUTH + ", big AS (SELECT map_id, label FROM la GROUP BY map_id, label HAVING count(*) * 4 >= 100)", "SELECT t.map_id, 'basin_' || la.label AS basin_key, t.feature_id FROM truth t JOIN la ON la.map_id = t.map_id AND la.x = t.cx AND la.y = t.cy JOIN big ON big.map_id = la.map_id AND big.label = la.label", grids.HILLS, "hills"))
def assign_features_to_basins(spark, sf_dir):
    labels = flow.watersheds(flow.directions(grids.hills(spark, sf_dir), "gray"))
    return flow.basin_members(truth(spark, sf_dir), labels, flow.basins(labels, CFG, 100.0))


# Queries over the table of known features.


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grids.table(spark, sf_dir, "supplier")
    df = s.select(F.sha2(F.col("s_suppkey").cast("string"), 256).alias("feature_id"), *(F.expr(e).alias(c) for c, e in o.TRUTH_COLUMNS.items()))
    points = F.transform(F.sequence(F.lit(0), (1 + F.col("seq") % 7).cast("int")), lambda i: F.struct((F.col("cx") + 2 * i).cast("int").alias("x"), (F.col("cy") + i).cast("int").alias("y")))
    return df.withColumn("spine", F.when(F.col("feature_type").isin("ridge", "valley"), points))


@dataclass(frozen=True)
class Known:
    """A terrain of known features, whose relations are made up from their numbers and places."""

    cfg: Config
    features: DataFrame
    visibility: DataFrame
    flow: DataFrame
    connectivity: DataFrame
    basins: DataFrame
    pixels: DataFrame

    def query(self) -> Query:
        return Query(self)


def known(spark, sf_dir) -> Known:
    t = truth(spark, sf_dir)
    own = t.select("map_id", F.col("feature_id").alias("src"), F.col("cx").alias("x"), F.col("cy").alias("y"), "seq")
    other = t.select("map_id", F.col("feature_id").alias("dst"), F.col("cx").alias("x2"), F.col("cy").alias("y2"), F.col("seq").alias("seq2"))
    near = radius_join(own, other, CFG.connection_radius_px, F.col("seq") != F.col("seq2")).select("map_id", "src", "dst")
    down = t.select(F.col("feature_id").alias("src"), F.when(F.col("seq") == 0, F.lit(3)).otherwise(F.expr("seq div 2")).alias("to")).join(t.select(F.col("feature_id").alias("dst"), F.col("seq").alias("to")), "to").select("src", "dst")
    basins = t.select("map_id", F.concat(F.lit("basin_"), (F.col("seq") % 3).cast("string")).alias("basin_key"), "feature_id")
    return Known(CFG, t, near, down, near, basins, fields.calibrate(grids.hills(spark, sf_dir), CFG))


def fid(k: int) -> str:
    import hashlib

    return hashlib.sha256(str(k).encode()).hexdigest()


def found(name: str, make, where: str, tail: str = "", more: tuple = ()):
    """A query by the builder: its ids; where and tail in SQL."""
    query(name, o.truth(f"SELECT feature_id, seq FROM truth WHERE {where} {tail}", *more))(lambda spark, sf_dir: make(known(spark, sf_dir).query()).to_df().select("feature_id", "seq"))


#: A feature of the fixture that is near two ridges.
KNOT = 72

found("query_select", lambda q: q.select("ridge"), "feature_type = 'ridge'")
found("query_where_eq", lambda q: q.select("peak").where(cx=50), "feature_type = 'peak' AND cx = 50")
found("query_where_neq", lambda q: q.select("peak").where(prominence__neq=30.0), "feature_type = 'peak' AND prominence <> 30")
found("query_where_gt", lambda q: q.select("peak").where(prominence__gt=50), "feature_type = 'peak' AND prominence > 50")
found("query_where_gte", lambda q: q.select("saddle").where(avg_slope__gte=26.0, cx__lt=40), "feature_type = 'saddle' AND avg_slope >= 26 AND cx < 40")
found("query_where_lt", lambda q: q.select("flat_zone").where(area_pixels__lt=2000), "feature_type = 'flat_zone' AND area_pixels < 2000")
found("query_where_lte", lambda q: q.select("valley").where(elev_min__lte=10.5), "feature_type = 'valley' AND elev_min <= 10.5")
found("query_where_in", lambda q: q.select("ridge").where(cx__in=[1, 9, 33, 37, "x"]), "feature_type = 'ridge' AND cx IN (1, 9, 33, 37)")
found("query_where_contains", lambda q: q.select("ridge").where(feature_id__contains="ab"), "feature_type = 'ridge' AND contains(feature_id, 'ab')")
found("query_unknown_field", lambda q: q.select("peak").where(slope__neq=3), "false")
found("query_in_watershed", lambda q: q.select("peak").in_watershed("basin_1"), "feature_type = 'peak' AND seq % 3 = 1")
found("query_order_nulls_asc", lambda q: q.select("peak").order_by("prominence").limit(12), "feature_type = 'peak'", "ORDER BY prominence ASC NULLS LAST, map_id, seq LIMIT 12")
found("query_order_nulls_desc", lambda q: q.select("peak").order_by("prominence", descending=True).limit(12), "feature_type = 'peak'", "ORDER BY prominence DESC NULLS FIRST, map_id, seq LIMIT 12")
found("query_limit_offset", lambda q: q.select("flat_zone").order_by("area_pixels").limit(5).offset(3), "feature_type = 'flat_zone'", "ORDER BY area_pixels NULLS LAST, map_id, seq LIMIT 5 OFFSET 3")
found("query_visible_to", lambda q: q.select("valley").visible_to(q.select("peak").where(cx__lt=32)), "feature_type = 'valley' AND feature_id IN (SELECT src FROM near WHERE dst IN (SELECT feature_id FROM truth WHERE feature_type = 'peak' AND cx < 32))", "", (o.NEAR,))
found("query_connected_to", lambda q: q.select("ridge").connected_to(fid(KNOT)), f"feature_type = 'ridge' AND feature_id IN (SELECT dst FROM near WHERE src = '{fid(KNOT)}')", "", (o.NEAR,))
found("flow_upstream", lambda q: q.select("valley").upstream_of(fid(2)), "feature_type = 'valley' AND feature_id IN (SELECT id FROM reach)", "", (o.FLOW, f"reach AS (SELECT '{fid(2)}' AS id UNION SELECT src FROM fl JOIN reach ON dst = id)"))
found("flow_downstream", lambda q: q.select("peak").downstream_of(fid(95)), "feature_type = 'peak' AND feature_id IN (SELECT id FROM reach)", "", (o.FLOW, f"reach AS (SELECT '{fid(95)}' AS id UNION SELECT dst FROM fl JOIN reach ON src = id)"))


@query("shell_select", o.truth("SELECT feature_id, seq FROM truth WHERE feature_type = 'peak' AND prominence > 20 ORDER BY prominence DESC, map_id, seq LIMIT 4 OFFSET 1"))
def shell_select(spark, sf_dir):
    return shell.run(known(spark, sf_dir), "select PEAK where prominence__gt=20 limit 4 offset 1 order by prominence desc").select("feature_id", "seq")


_D = "sqrt(((cx - 30) * (cx - 30) + (cy - 30) * (cy - 30))::DOUBLE) * 2.0::DOUBLE"


@query("ping_at", o.truth(f"SELECT feature_id, {o.r(_D, 'distance_m')} FROM truth WHERE {_D} <= 30"))
def ping_at(spark, sf_dir):
    return ping(truth(spark, sf_dir), 30, 30, 30.0, 2.0).select("feature_id", rounded("distance_m"))


_E = "sqrt(((t.cx - c.cx) * (t.cx - c.cx) + (t.cy - c.cy) * (t.cy - c.cy))::DOUBLE) * 2.0::DOUBLE"


@query("ping_from", o.truth(f"SELECT t.feature_id, {o.r(_E, 'distance_m')} FROM truth t, truth c WHERE c.seq = 7 AND t.seq <> 7 AND t.map_id = c.map_id AND {_E} <= 60"))
def ping_from_(spark, sf_dir):
    return ping_from(truth(spark, sf_dir), fid(7), 60.0, 2.0).select("feature_id", rounded("distance_m"))


@query("id_prefix", o.truth(f"SELECT feature_id, cx, cy FROM truth WHERE starts_with(feature_id, '{fid(5)[:12]}')"))
def id_prefix(spark, sf_dir):
    t = truth(spark, sf_dir)
    return t.filter(F.col("feature_id") == by_prefix(t, fid(5)[:12])).select("feature_id", "cx", "cy")


@query("describe_brief", o.described(True))
def describe_brief(spark, sf_dir):
    return truth(spark, sf_dir).select("feature_id", describe(CFG, True).alias("description"))


@query("describe_full", o.described(False))
def describe_full(spark, sf_dir):
    return truth(spark, sf_dir).select("feature_id", describe(CFG).alias("description"))


@query("stat", f"WITH RECURSIVE {grids.HILLS}, {o.TRUTH}, {o.NEAR}, {o.FLOW} SELECT (SELECT max(x) + 1 FROM hills) AS w, (SELECT max(y) + 1 FROM hills) AS h, {o.r('(SELECT min(gray) * 0.492::DOUBLE + 0.1::DOUBLE FROM hills)', 'low')}, {o.r('(SELECT max(gray) * 0.492::DOUBLE + 0.1::DOUBLE FROM hills)', 'high')}, count(*) FILTER (feature_type = 'peak') AS peaks, count(*) FILTER (feature_type = 'ridge') AS ridges, count(*) FILTER (feature_type = 'valley') AS valleys, count(*) FILTER (feature_type = 'saddle') AS saddles, count(*) FILTER (feature_type = 'flat_zone') AS flat_zones, (SELECT count(*) // 2 FROM near) AS visibility_pairs, (SELECT count(*) FROM fl) AS flow_edges, count(DISTINCT (map_id, seq % 3)) AS watersheds, (SELECT count(*) // 2 FROM near) AS connectivity_edges FROM truth")
def stat(spark, sf_dir):
    return shell.run(known(spark, sf_dir), "STAT").drop("relief").withColumns({"low": rounded("low"), "high": rounded("high")})


@query("sea_purge", o.truth("SELECT feature_id FROM truth WHERE CASE WHEN feature_type IN ('peak', 'ridge') THEN elev_max WHEN feature_type IN ('valley', 'flat_zone') THEN elev_min ELSE (elev_min + elev_max) / 2 END >= 1.5"))
def sea_purge(spark, sf_dir):
    return feature_ops.purge(truth(spark, sf_dir), CFG).select("feature_id")


@query("polyline_length", o.truth(f"SELECT feature_id, {o.r(o.LENGTH, 'length_m')} FROM truth WHERE feature_type IN ('ridge', 'valley')"))
def polyline_length(spark, sf_dir):
    return truth(spark, sf_dir).filter("spine is not null").withColumn("length_m", feature_ops.polyline_length(F.col("spine"), 2.0)).select("feature_id", rounded("length_m"))


@query("contains_point", o.truth("SELECT feature_id FROM truth WHERE feature_type IN ('ridge', 'valley') AND len(list_filter(range(2 + seq % 7), lambda i: sqrt(((cx + 2 * i - 30) * (cx + 2 * i - 30) + (cy + i - 30) * (cy + i - 30))::DOUBLE) < 12)) > 0"))
def contains_point(spark, sf_dir):
    return truth(spark, sf_dir).filter(feature_ops.contains_point(F.col("spine"), 30, 30, 12)).select("feature_id")


_SPOTS = "sp AS (SELECT map_id, feature_id, feature_type, cx + 2 * i AS x, cy + i AS y, i, 1 + seq % 7 AS last FROM (SELECT *, unnest(range(2 + seq % 7)) AS i FROM truth WHERE feature_type IN ('ridge', 'valley')))"


_LINKS = replace(CFG, feature_connection_tolerance_px=24.0)  # wide enough for the fixture to have some


def linked(a: str, b: str, ends: str) -> str:
    return o.truth(f"SELECT DISTINCT t.map_id, t.feature_id AS src, sp.feature_id AS dst FROM truth t JOIN sp ON sp.map_id = t.map_id WHERE t.feature_type = '{a}' AND sp.feature_type = '{b}' {ends} AND (t.cx - sp.x) * (t.cx - sp.x) + (t.cy - sp.y) * (t.cy - sp.y) <= {_LINKS.feature_connection_tolerance_px ** 2}", _SPOTS)


@query("ridge_peak_links", linked("peak", "ridge", "AND i IN (0, last)"))
def ridge_peak_links(spark, sf_dir):
    return feature_ops.spine_links(truth(spark, sf_dir), "peak", "ridge", _LINKS, ends_only=True)


@query("saddle_ridge_links", linked("saddle", "ridge", ""))
def saddle_ridge_links(spark, sf_dir):
    return feature_ops.spine_links(truth(spark, sf_dir), "saddle", "ridge", _LINKS)


@query("saddle_valley_links", linked("saddle", "valley", ""))
def saddle_valley_links(spark, sf_dir):
    return feature_ops.spine_links(truth(spark, sf_dir), "saddle", "valley", _LINKS)


@query("spine_smooth", "WITH p AS (SELECT o_orderkey // 12 AS key, (o_orderkey % 12)::INT AS ord, ((o_orderkey * 7919) % 101)::INT AS x, ((o_orderkey * 104729) % 97)::INT AS y FROM orders) SELECT key, ord, CASE WHEN n >= 5 THEN trunc(ax) ELSE x END::INT AS x, CASE WHEN n >= 5 THEN trunc(ay) ELSE y END::INT AS y FROM (SELECT *, avg(x) OVER w AS ax, avg(y) OVER w AS ay, count(*) OVER (PARTITION BY key) AS n FROM p WINDOW w AS (PARTITION BY key ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))")
def spine_smooth(spark, sf_dir):
    p = grids.table(spark, sf_dir, "orders").selectExpr("o_orderkey div 12 AS key", "cast(o_orderkey % 12 as int) AS ord", "cast((o_orderkey * 7919) % 101 as int) AS x", "cast((o_orderkey * 104729) % 97 as int) AS y")
    return feature_ops.smooth_points(p, 5)


@query("edge_dedupe", o.truth("SELECT DISTINCT map_id, least(src, dst) AS a, greatest(src, dst) AS b FROM near", o.NEAR))
def edge_dedupe(spark, sf_dir):
    return panels.undirected(known(spark, sf_dir).connectivity)


_BY_SEQ = "JOIN truth a ON a.feature_id = e.src AND a.map_id = e.map_id JOIN truth b ON b.feature_id = e.dst AND b.map_id = e.map_id"


@query("flow_edge_drops", o.truth(f"SELECT map_id, src, dst, {o.r('drop_m', 'drop_m')}, {o.r('least(1.0::DOUBLE, drop_m / 50.0::DOUBLE)', 'intensity')} FROM (SELECT e.map_id, src, dst, a.elev_max - b.elev_max AS drop_m, row_number() OVER (PARTITION BY e.map_id ORDER BY a.seq, b.seq) AS place FROM near e {_BY_SEQ}) WHERE place <= 5", o.NEAR))
def flow_edge_drops(spark, sf_dir):
    t = known(spark, sf_dir)
    return panels.edge_drops(t.connectivity, t.features, 5).select("map_id", "src", "dst", rounded("drop_m"), rounded("intensity"))


@query("connectivity_edges", o.truth(f"SELECT map_id, src, dst, style FROM (SELECT e.map_id, src, dst, CASE WHEN a.feature_type = 'peak' AND b.feature_type = 'peak' THEN 'solid' WHEN a.feature_type IN ('ridge', 'valley') THEN 'dashed' ELSE 'dotted' END AS style, row_number() OVER (PARTITION BY e.map_id ORDER BY a.k, b.seq) AS place FROM near e JOIN pri a ON a.feature_id = e.src AND a.map_id = e.map_id JOIN pri b ON b.feature_id = e.dst AND b.map_id = e.map_id WHERE a.k < b.k) WHERE place <= 3", o.NEAR, "pri AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY feature_type <> 'peak', CASE WHEN feature_type = 'peak' THEN -coalesce(prominence, 0) ELSE 0 END, seq) AS k FROM truth)"))
def connectivity_edges(spark, sf_dir):
    t = known(spark, sf_dir)
    return panels.connectivity_edges(t.connectivity, t.features, 3)


@query("peak_sights", o.truth(f"SELECT map_id, src, dst FROM (SELECT e.map_id, src, dst, count(*) OVER (PARTITION BY e.map_id ORDER BY a.seq RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY e.map_id, a.seq) AS before FROM near e {_BY_SEQ} WHERE a.feature_type = 'peak' AND b.feature_type = 'peak') WHERE before < 1", o.NEAR))
def peak_sights(spark, sf_dir):
    t = known(spark, sf_dir)
    return panels.peak_sights(t.visibility, t.features, 1)


@query("peak_markers", o.truth(f"SELECT map_id, feature_id, cx * 2.0::DOUBLE AS wx, cy * 2.0::DOUBLE AS wy, {o.r('greatest(12.0::DOUBLE, least(32.0::DOUBLE, 12.0::DOUBLE + coalesce(prominence, 10.0::DOUBLE) / 20.0::DOUBLE))', 'marker_size')}, coalesce(prominence, 10.0::DOUBLE) > 30 AS labelled FROM truth WHERE feature_type = 'peak'"))
def peak_markers(spark, sf_dir):
    return panels.peak_markers(truth(spark, sf_dir), CFG.horizontal_scale).select("map_id", "feature_id", "wx", "wy", rounded("marker_size"), "labelled")


@query("outlet_markers", o.flow("", "SELECT map_id, label, x * 2.0::DOUBLE AS wx, y * 2.0::DOUBLE AS wy FROM ol WHERE label < 20"))
def outlet_markers(spark, sf_dir):
    return panels.outlet_markers(flow.outlets(drained(spark, sf_dir)), CFG.horizontal_scale)


@query("stream_points", o.flow(o.ACC, "SELECT map_id, (id % 4294967296) * 2.0::DOUBLE AS wx, (id // 4294967296) * 2.0::DOUBLE AS wy FROM ac GROUP BY map_id, id HAVING count(*) >= 10"))
def stream_points(spark, sf_dir):
    return panels.stream_points(flow.stream_mask(flow.accumulation(drained(spark, sf_dir)), 10), CFG.horizontal_scale)


@query("downsampled", f"""WITH {grids.HILLS}, g AS (SELECT map_id, y::INT AS y, x::INT AS x, y * (63.0::DOUBLE / 20) AS ay, x * (63.0::DOUBLE / 20) AS ax FROM (SELECT DISTINCT map_id FROM hills), range(21) a(y), range(21) b(x)),
c AS (SELECT g.*, floor(ay)::INT + j AS oy, floor(ax)::INT + i AS ox, (CASE WHEN j = 0 THEN 1 - (ay - floor(ay)) ELSE ay - floor(ay) END) * (CASE WHEN i = 0 THEN 1 - (ax - floor(ax)) ELSE ax - floor(ax) END) AS s FROM g, range(2) a(j), range(2) b(i))
SELECT c.map_id, c.y, c.x, {o.r('sum(h.gray * s) / sum(s)', 'gray', 4)} FROM c JOIN hills h ON h.map_id = c.map_id AND h.y = c.oy AND h.x = c.ox WHERE s > 0 GROUP BY c.map_id, c.y, c.x""")
def downsampled(spark, sf_dir):
    return panels.downsampled(grids.hills(spark, sf_dir), "gray", 21).select("map_id", "y", "x", rounded("gray", 4))


@query("counts_by_type", o.truth("SELECT map_id, feature_type, count(*) AS n FROM truth GROUP BY ALL"))
def counts_by_type(spark, sf_dir):
    return panels.counts_by_type(truth(spark, sf_dir))


@query("top_peaks", o.truth("SELECT map_id, place, feature_id, prominence FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY prominence DESC NULLS LAST, seq) AS place FROM truth WHERE feature_type = 'peak') WHERE place <= 3"))
def top_peaks(spark, sf_dir):
    return panels.top_peaks(truth(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query("flat_radius", o.truth(f"SELECT map_id, feature_id, {o.r('sqrt(area_pixels / pi())', 'radius_px')} FROM truth WHERE feature_type = 'flat_zone'"))
def flat_radius(spark, sf_dir):
    return panels.flat_radius(truth(spark, sf_dir)).select("map_id", "feature_id", rounded("radius_px"))


@query("quadrant_counts", o.truth("SELECT map_id, ['LL', 'LR', 'UL', 'UR'][q + 1] AS quadrant, n FROM (SELECT map_id, q, count(feature_id) AS n, row_number() OVER (PARTITION BY map_id ORDER BY count(feature_id), q) AS k FROM (SELECT DISTINCT map_id, unnest(range(4)) AS q FROM truth) e LEFT JOIN (SELECT map_id, feature_id, CASE WHEN cy >= 32 THEN 0 ELSE 2 END + CASE WHEN cx >= 32 THEN 1 ELSE 0 END AS q FROM truth) USING (map_id, q) GROUP BY map_id, q) WHERE k = 1"))
def quadrant_counts(spark, sf_dir):
    return panels.quadrants(truth(spark, sf_dir), 64, 64)


@query("connected_components", f"WITH RECURSIVE {grids.HILLS}, mask AS (SELECT map_id, y, x FROM hills WHERE gray >= 40), {o.components('mask', 'cc')} SELECT map_id, y, x, label FROM cc")
def connected_components(spark, sf_dir):
    return components(grids.hills(spark, sf_dir).filter("gray >= 40").select(*PX))


@query("large_components", f"WITH RECURSIVE {grids.HILLS}, mask AS (SELECT map_id, y, x FROM hills WHERE gray >= 60), {o.components('mask', 'cc')} SELECT map_id, label, count(*) AS pixels FROM cc GROUP BY map_id, label HAVING count(*) >= 80")
def large_components(spark, sf_dir):
    return at_least(components(grids.hills(spark, sf_dir).filter("gray >= 60").select(*PX)), 80).groupBy("map_id", "label").agg(F.count("*").alias("pixels"))


@query("nms_saddles", o.truth("SELECT map_id, id FROM nms", "pts AS (SELECT map_id, seq AS id, cx AS x, cy AS y, avg_slope AS strength FROM truth)", o.suppressed("pts", "nms", 15)))
def nms_saddles(spark, sf_dir):
    t = truth(spark, sf_dir).select("map_id", F.col("seq").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("avg_slope").alias("strength"))
    return suppress(t, 15)


@query("skeleton")
def skeleton(spark, sf_dir):
    return kernels.skeleton(grids.hills(spark, sf_dir).filter("gray >= 60"))


@query("spine_order")
def spine_order(spark, sf_dir):
    return kernels.spines(components(kernels.skeleton(grids.hills(spark, sf_dir).filter("gray >= 60"))))


@query("priority_flood")
def priority_flood(spark, sf_dir):
    return kernels.priority_flood(flow.directions(heights(spark, sf_dir).select(*PX, "z"))).drop("z")


@query("visibility_graph", o.chain(3, o.TRUTH + ", " + o.SIGHT, "SELECT map_id, src, dst FROM sg UNION ALL SELECT map_id, dst, src FROM sg"))
def visibility_graph(spark, sf_dir):
    return relations.visibility(heights(spark, sf_dir), truth(spark, sf_dir), CFG)


@query("connectivity_graph", o.costs("tobler", ", " + o.PATHS, f"SELECT map_id, src, dst, {o.r('c', 'path_cost')} FROM got UNION ALL SELECT map_id, dst, src, {o.r('c', 'path_cost')} FROM got").replace("WITH ", "WITH RECURSIVE ", 1))
def connectivity_graph(spark, sf_dir):
    return relations.connectivity(priced(spark, sf_dir, "tobler"), truth(spark, sf_dir), CFG).withColumn("path_cost", F.round("path_cost", 6))


@query("flow_graph", o.flow(o.ACC + ", " + o.FLOWS, "SELECT map_id, src, dst FROM near1 WHERE src <> dst", grids.HILLS, "hills"))
def flow_graph(spark, sf_dir):
    d8 = flow.directions(grids.hills(spark, sf_dir), "gray")
    return flow.flow_edges(truth(spark, sf_dir), d8, flow.stream_mask(flow.accumulation(d8), 12), CFG)


_SHAPES = {
    "plane": (synth.Synthetic(), []),
    "peaks": (synth.Synthetic().peak(0, 0, 50, 12).peak(-64, 20, 40, 30, "paraboloid"), [o.cone(0, 0, 50, 12, "gaussian"), o.cone(-64, 20, 40, 30, "paraboloid")]),
    "ridge": (synth.Synthetic().ridge((-118, -20), (100, 30), 40, 4), [o.wall((-118, -20), (100, 30), 40, 4)]),
    "valley": (synth.Synthetic().peak(0, 0, 60, 90, "paraboloid").valley((-118, 0), (118, 0), 30, 5), [o.cone(0, 0, 60, 90, "paraboloid"), o.wall((-118, 0), (118, 0), -30, 5)]),
    "saddle": (synth.Synthetic().saddle(10, -5, 0.01, 0.02, 25, 60), [o.pass_(10, -5, 0.01, 0.02, 25, 60)]),
    "flat": (synth.Synthetic().peak(0, 0, 50, 40).flat(4, -6, 30, 20, 12), [o.cone(0, 0, 50, 40, "gaussian"), "CASE WHEN x >= 58 AND x < 73 AND y >= 56 AND y < 66 THEN 12.0::DOUBLE ELSE z END"]),
}
for _name, (_recipe, _terms) in _SHAPES.items():
    query(f"synthetic_{_name}", o.synthetic(_terms))(lambda spark, sf_dir, s=_recipe: s.build(spark).select(*PX, rounded("z")))


@query("line_of_sight", o.chain(3, o.TRUTH + ", " + o.SIGHT, "SELECT map_id, src, dst, n FROM (SELECT map_id, src, dst, greatest(dx, dy)::BIGINT AS n FROM pr) SEMI JOIN sg USING (map_id, src, dst)"))
def line_of_sight(spark, sf_dir):
    t, px = truth(spark, sf_dir), settle(heights(spark, sf_dir))
    seen = relations.visibility(px, t, CFG, symmetric=False)
    at = lambda p: t.select("map_id", F.col("feature_id").alias(p), F.col("cx").alias(f"{p}_x"), F.col("cy").alias(f"{p}_y"))
    both = seen.join(at("src"), ["map_id", "src"]).join(at("dst"), ["map_id", "dst"])
    return both.select("map_id", "src", "dst", F.greatest(F.abs(F.col("dst_x") - F.col("src_x")), F.abs(F.col("dst_y") - F.col("src_y"))).cast("long").alias("n"))


# Features of the derived hills.


@query("extract_flat_zones", o.recursive(5, o.FLATS, f"SELECT map_id, label, cx, cy, area_pixels, x_min, x_max, y_min, y_max, {o.r('elev_min', 'elev_min')}, {o.r('elev_max', 'elev_max')}, {o.r('avg_slope', 'avg_slope')} FROM fz"))
def extract_flat_zones(spark, sf_dir):
    out = feature_ops.flat_zones(classified(spark, sf_dir), CFG)
    return out.select("map_id", "label", "cx", "cy", "area_pixels", "x_min", "x_max", "y_min", "y_max", rounded("elev_min"), rounded("elev_max"), rounded("avg_slope"))


@query("extract_saddles", o.recursive(7, o.SADDLES, f"SELECT c.map_id, c.id AS label, c.x::INT AS cx, c.y::INT AS cy, {o.r('strength', 'k_curvature')}, {o.r('conf', 'confidence')}, {o.r('slope', 'avg_slope')}, {o.r('z', 'saddle_elevation_m')} FROM cand c JOIN nms USING (map_id, id) WHERE strength >= {o.d(CFG.saddle_k_min_threshold)} AND conf >= {o.d(CFG.saddle_confidence_threshold)}"))
def extract_saddles(spark, sf_dir):
    out = feature_ops.saddles(settle(classified(spark, sf_dir)), CFG)
    return out.select("map_id", "label", "cx", "cy", rounded("k_curvature"), rounded("confidence"), rounded("avg_slope"), rounded("saddle_elevation_m"))


@query("extract_peaks", o.recursive(7, o.PEAKS, f"SELECT map_id, label, cx, cy, size, {o.r('elev_min', 'elev_min')}, {o.r('elev_max', 'elev_max')}, {o.r('avg_slope', 'avg_slope')}, {o.r('prominence', 'prominence')}, {o.r('least(1.0::DOUBLE, prominence / 15.0::DOUBLE * (1.0::DOUBLE - abs(avg_slope - 15.0::DOUBLE) / 30.0::DOUBLE))', 'defensive_rating')}, {o.r('least(1.0::DOUBLE, prominence / 20.0::DOUBLE)', 'confidence')} FROM pf"))
def extract_peaks(spark, sf_dir):
    out = feature_ops.peaks(classified(spark, sf_dir), CFG)
    return out.select("map_id", "label", "cx", "cy", "size", rounded("elev_min"), rounded("elev_max"), rounded("avg_slope"), rounded("prominence"), rounded("defensive_rating"), rounded("confidence"))


# What SQL doesn't express in practice; tests compare these with plain versions.


@query("extract_features")
def extract_features(spark, sf_dir):
    return feature_ops.extract(classified(spark, sf_dir), CFG).select("map_id", "seq", "feature_type", "cx", "cy", F.size("connected_peaks").alias("peaks"), F.size("connecting_ridges").alias("ridges"), F.size("connecting_valleys").alias("valleys"))


# The whole analysis, asked by the builder, has SQL of its own; the self test has none.


def analyzed(spark, sf_dir) -> relations.Terrain:
    """The whole chain on all maps of the hills: every relation of every feature."""
    return relations.analyze(grids.hills(spark, sf_dir), CFG)


@query("analyze_and_ask", o.recursive(8, ",\n".join((o.PEAKS, o.SPARE, o.RIDGES, o.SUMMITS)), f"SELECT map_id, seq, feature_id, cx, cy, {o.r('prominence', 'prominence')}, {o.HEADS['peak']} AS brief, {o.HEADS['peak']} || {o.TAILS['peak']} AS description FROM asked ORDER BY asked.prominence DESC NULLS FIRST, map_id, seq"))
def analyze_and_ask(spark, sf_dir):
    t = analyzed(spark, sf_dir)
    asked = t.query().select("peak").visible_to(t.query().select("ridge")).order_by("prominence", descending=True).to_df()
    return shell.shown(asked, CFG).select("map_id", "seq", "feature_id", "cx", "cy", rounded("prominence"), "brief", "description")


@query("self_test")
def self_test(spark, sf_dir):
    return synth.self_test(spark)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest strict maxima of the smoothed hills by local relief."""
    df = smoothed(spark, sf_dir, *fields.relief_steps(CFG), stencils.box("z", -1, 1, "max", "top"))
    top = df.withColumn("relief", F.col("z") - F.col("_low")).filter("z = top")
    rows = top.select("map_id", F.col("y").cast("long").alias("seq"), F.lit("peak").alias("feature_type"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("relief").alias("prominence"))
    t = SimpleNamespace(features=rows.withColumn("feature_id", F.sha2(F.concat_ws("|", "map_id", "cx", "cy"), 256)))
    return Query(t).select("peak").where(prominence__gt=10).order_by("prominence", descending=True).limit(5).to_df()
