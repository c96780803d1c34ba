"""SQL of the queries in catalog, for DuckDB on the same tables: own formulations by lists and self-joins."""

from __future__ import annotations

import math

from ridgeline.config import Config
from ridgeline.operators.fields import kernel
from ridgeline.sources.grids import HILLS, NOISE

C = Config()


def r(expr: str, name: str, digits: int = 6) -> str:
    """A rounded column, without negative zeros."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END AS {name}"


def d(v: float) -> str:
    return f"{v!r}::DOUBLE"


def blurred(source: str, column: str, sigma: float, name: str, n: int = 64) -> str:
    """CTEs of a blur of ``column``, as column b of ``name``."""
    weights = kernel(sigma)
    half = len(weights) // 2

    def total(axis):
        terms = []
        for k, w in zip(range(-half, half + 1), weights):
            p = f"((({axis} + {k}) % {2 * n} + {2 * n}) % {2 * n})"
            terms.append(f"l[CASE WHEN {p} < {n} THEN {p} + 1 ELSE {2 * n} - {p} END] * {d(w)}")
        return " + ".join(terms)

    return f"""{name}_ly AS (SELECT map_id, x, list({column} ORDER BY y) AS l FROM {source} GROUP BY map_id, x),
{name}_y AS (SELECT s.*, {total("y")} AS by_ FROM {source} s JOIN {name}_ly USING (map_id, x)),
{name}_lx AS (SELECT map_id, y, list(by_ ORDER BY x) AS l FROM {name}_y GROUP BY map_id, y),
{name} AS (SELECT s.* EXCLUDE (by_), {total("x")} AS b FROM {name}_y s JOIN {name}_lx USING (map_id, y))"""


def diff(column: str, axis: str) -> str:
    w = f"(PARTITION BY map_id, {'y' if axis == 'x' else 'x'} ORDER BY {axis})"
    a, b, c = f"lag({column}) OVER {w}", f"lead({column}) OVER {w}", d(C.horizontal_scale)
    return f"CASE WHEN {a} IS NULL THEN ({b} - {column}) / {c} WHEN {b} IS NULL THEN ({column} - {a}) / {c} ELSE ({b} - {a}) / {d(2 * C.horizontal_scale)} END"


Z0 = f"z0 AS (SELECT *, gray * {d(C.vertical_scale)} + {d(C.sea_level_offset)} AS z FROM hills)"
BLUR = blurred("z0", "z", C.noise_reduction_sigma, "bl") + ", zz AS (SELECT map_id, y, x, gray, b AS z FROM bl)"
GRAD = f"gr AS (SELECT *, {diff('z', 'x')} AS dz_dx, {diff('z', 'y')} AS dz_dy FROM zz)"
SLOPE = f"""sl AS (SELECT *, greatest(0.0::DOUBLE, least(90.0::DOUBLE, degrees(atan(sqrt(dz_dx * dz_dx + dz_dy * dz_dy))))) AS slope FROM gr),
sa AS (SELECT *, CASE WHEN slope < {C.flat_threshold_deg} THEN 0.0::DOUBLE ELSE (atan2(dz_dx, -dz_dy) + {d(2 * math.pi)}) % {d(2 * math.pi)} END AS aspect FROM sl)"""
CURV = f"""se AS (SELECT *, {diff('dz_dx', 'x')} AS xx, {diff('dz_dx', 'y')} AS xy, {diff('dz_dy', 'x')} AS yx, {diff('dz_dy', 'y')} AS yy FROM sa),
sm AS (SELECT *, (xy + yx) / 2.0::DOUBLE AS s, 1.0::DOUBLE + dz_dx * dz_dx + dz_dy * dz_dy AS g FROM se),
cu AS (SELECT *, ((1.0::DOUBLE + dz_dy * dz_dy) * xx - 2.0::DOUBLE * dz_dx * dz_dy * s + (1.0::DOUBLE + dz_dx * dz_dx) * yy) / (2.0::DOUBLE * g * sqrt(g)) AS h_curv, (xx * yy - s * s) / (g * g) AS k_curv FROM sm)"""
EPS = f"""e1 AS (SELECT map_id, quantile_cont(abs(h_curv), 0.5) AS m, quantile_cont(abs(h_curv), 0.75) AS h_all, quantile_cont(abs(k_curv), 0.75) AS k_all FROM cu GROUP BY map_id),
e2 AS (SELECT map_id, count(*) AS n, quantile_cont(abs(h_curv), 0.75) AS h_some, quantile_cont(abs(k_curv), 0.75) AS k_some FROM cu JOIN e1 USING (map_id) WHERE abs(h_curv) > m GROUP BY map_id),
ep AS (SELECT map_id, greatest({d(C.h_min)}, least({d(C.h_max)}, CASE WHEN coalesce(n, 0) < 100 THEN h_all ELSE h_some END * {d(C.h_factor)})) AS eps_h,
  greatest({d(C.k_min)}, least({d(C.k_max)}, CASE WHEN coalesce(n, 0) < 100 THEN k_all ELSE k_some END * {d(C.k_factor)})) AS eps_k FROM e1 LEFT JOIN e2 USING (map_id))"""
CLASS = """cl AS (SELECT *, CASE WHEN k_curv < -eps_k THEN 'SADDLE' WHEN h_curv > eps_h AND abs(k_curv) < eps_k THEN 'CYLINDRICAL_CONVEX' WHEN h_curv < -eps_h AND abs(k_curv) < eps_k THEN 'CYLINDRICAL_CONCAVE'
  WHEN h_curv > eps_h AND k_curv > eps_k THEN 'CONVEX' WHEN h_curv < -eps_h AND k_curv > eps_k THEN 'CONCAVE' ELSE 'FLAT' END AS curvature_type FROM cu JOIN ep USING (map_id))"""
CHAIN = [HILLS, Z0, BLUR, GRAD, SLOPE, CURV, EPS, CLASS]


def chain(n: int, more: str, select: str) -> str:
    return "WITH " + ",\n".join(CHAIN[:n] + ([more] if more else [])) + "\n" + select


def edge(column: str, axis: str, k: int) -> str:
    w = f"(PARTITION BY map_id, {'y' if axis == 'x' else 'x'} ORDER BY {axis})"
    return f"coalesce({'lag' if k < 0 else 'lead'}({column}) OVER {w}, {column})"


SOBEL = f"""so AS (SELECT *, {edge('z', 'x', -1)} AS l, {edge('z', 'x', 1)} AS r FROM zz), sp AS (SELECT *, l - r AS df, l + 2 * z + r AS sm FROM so),
sq AS (SELECT map_id, y, x, ({edge('df', 'y', -1)} + 2 * df + {edge('df', 'y', 1)}) / {d(8 * C.horizontal_scale)} AS dz_dx, ({edge('sm', 'y', 1)} - {edge('sm', 'y', -1)}) / {d(8 * C.horizontal_scale)} AS dz_dy FROM sp)"""
ROUGH = f"""ra AS (SELECT *, {edge('z', 'x', -1)} AS l, {edge('z', 'x', 1)} AS r FROM {{source}}), rb AS (SELECT *, l + z + r AS a, l * l + z * z + r * r AS b FROM ra),
rc AS (SELECT *, ({edge('a', 'y', -1)} + a + {edge('a', 'y', 1)}) / 9.0::DOUBLE AS me, ({edge('b', 'y', -1)} + b + {edge('b', 'y', 1)}) / 9.0::DOUBLE AS sq FROM rb), ro AS (SELECT *, greatest(0.0::DOUBLE, sq - me * me) AS variance FROM rc)"""
RAD = "radians(slope)"
BASE = {
    "tobler": f"1.0::DOUBLE / greatest(6.0::DOUBLE * exp(-3.5::DOUBLE * abs({RAD} + 0.05::DOUBLE)) / 3.6::DOUBLE, 0.01::DOUBLE)",
    "vehicle": f"1.0::DOUBLE + pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {RAD} / {d(math.radians(C.vehicle_climb_angle))})), 2)",
}
FACTORS = f"(1.0::DOUBLE + {d(C.cost_curvature_weight)} * greatest(h_curv, 0.0::DOUBLE)) * (1.0::DOUBLE + {d(C.cost_roughness_weight)} * greatest(0.0::DOUBLE, least(1.0::DOUBLE, variance / 10.0::DOUBLE)))"
COST = {
    "tobler": f"greatest(({BASE['tobler']}) * {FACTORS}, 0.1::DOUBLE)",
    "vehicle": f"greatest(({BASE['vehicle']}) * {FACTORS}, 0.1::DOUBLE)",
    "energy": f"greatest(70.0::DOUBLE * 9.81::DOUBLE * sin({RAD}) + 2.0::DOUBLE, 0.1::DOUBLE)",
    "risk": f"greatest(greatest(1.0::DOUBLE, least(10.0::DOUBLE, ({BASE['tobler']}) * {FACTORS} / 5.0::DOUBLE)), 0.1::DOUBLE)",
}


def costs(kind: str, more: str = "", select: str = "") -> str:
    return chain(6, ROUGH.format(source="cu") + f", co AS (SELECT map_id, y, x, {COST[kind]} AS cost FROM ro)" + more, select or f"SELECT map_id, y, x, {r('cost', 'cost')} FROM co")


D8 = """step AS (SELECT * FROM (VALUES (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, -1, 1), (5, -1, 0), (6, -1, -1), (7, 0, -1), (8, 1, -1)) v(code, dx, dy)),
dr AS (SELECT a.map_id, a.y, a.x, s.code, (a.gray - b.gray) / CASE WHEN s.dx <> 0 AND s.dy <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END AS fall
  FROM {g} a, step s, {g} b WHERE b.map_id = a.map_id AND b.x = a.x + s.dx AND b.y = a.y + s.dy AND a.gray > b.gray),
di AS (SELECT a.map_id, a.y, a.x, coalesce(b.code, 0) AS d8 FROM {g} a LEFT JOIN (SELECT map_id, y, x, code FROM dr QUALIFY row_number() OVER (PARTITION BY map_id, y, x ORDER BY fall DESC, code) = 1) b USING (map_id, y, x)),
ne AS (SELECT di.map_id, di.y, di.x, d8, CASE WHEN d8 > 0 THEN (di.y + dy) * 4294967296 + di.x + dx END AS nxt, di.y * 4294967296 + di.x AS id FROM di LEFT JOIN step ON code = d8),
ol AS (SELECT map_id, id, y, x, row_number() OVER (PARTITION BY map_id ORDER BY y, x) - 1 AS label FROM ne WHERE nxt IS NULL)"""
LABELS = """la AS (SELECT map_id, id, y, x, label FROM ol UNION ALL SELECT n.map_id, n.id, n.y, n.x, la.label FROM la JOIN ne n ON n.map_id = la.map_id AND n.nxt = la.id)"""
ACC = """ac AS (SELECT map_id, id AS origin, id, nxt FROM ne UNION ALL SELECT ac.map_id, ac.origin, n.id, n.nxt FROM ac JOIN ne n ON n.map_id = ac.map_id AND n.id = ac.nxt)"""


def flow(more: str, select: str, source: str = NOISE, g: str = "noise") -> str:
    return f"WITH RECURSIVE {source},\n{D8.format(g=g)}{',' if more else ''}\n{more}\n{select}"


#: Columns of the fixture ``truth``, in SQL that both engines read; k is s_suppkey.
TRUTH_COLUMNS = {
    "map_id": "s_nationkey",
    "seq": "s_suppkey",
    "feature_type": "CASE s_suppkey % 5 WHEN 0 THEN 'peak' WHEN 1 THEN 'ridge' WHEN 2 THEN 'valley' WHEN 3 THEN 'saddle' ELSE 'flat_zone' END",
    "cx": "cast((s_suppkey * 37) % 64 as int)",
    "cy": "cast((s_suppkey * 53) % 64 as int)",
    "elev_min": "cast((s_suppkey * 29) % 120 as double) / 4",
    "elev_max": "cast((s_suppkey * 29) % 120 as double) * 3 + 1",
    "confidence": "cast(s_suppkey % 10 as double) / 10",
    "avg_slope": "cast((s_suppkey * 13) % 60 as double)",
    "prominence": "CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0 THEN cast((s_suppkey * 29) % 150 + 1 as double) END",
    "area_pixels": "CASE WHEN s_suppkey % 5 = 4 THEN (s_suppkey * 31) % 4000 + 1 END",
}
TRUTH = "truth AS (SELECT sha256(s_suppkey::VARCHAR) AS feature_id, " + ", ".join(f"{e} AS {c}" for c, e in TRUTH_COLUMNS.items()) + " FROM supplier)"
NEAR = "near AS (SELECT a.map_id, a.feature_id AS src, b.feature_id AS dst FROM truth a JOIN truth b ON a.map_id = b.map_id AND a.seq <> b.seq AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 400)"
FLOW = "fl AS (SELECT a.feature_id AS src, b.feature_id AS dst FROM truth a JOIN truth b ON b.seq = CASE WHEN a.seq = 0 THEN 3 ELSE a.seq // 2 END)"


def truth(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((TRUTH, *more)) + "\n" + select


def quantified(metric: str, value: str) -> str:
    from ridgeline.functions.describe import QUANTIFIERS

    return "CASE " + " ".join(f"WHEN {value} >= {a} AND {value} < {b} THEN '{label}'" for a, b, label in QUANTIFIERS[metric]) + " ELSE 'unknown' END"


def metres(v: str) -> str:
    return f"CASE WHEN {v} >= 1000 THEN format('{{:.1f}}km', {v} / 1000.0) WHEN {v} >= 1 THEN format('{{:.0f}}m', {v}) ELSE format('{{:.1f}}m', {v}) END"


LENGTH = "((1 + seq % 7) * sqrt(5.0::DOUBLE) * 2.0::DOUBLE)"
HEADS = {"peak": f"{quantified('prominence', 'prominence')} || ' peak'", "ridge": f"{quantified('length', LENGTH)} || ' ridge'", "valley": f"{quantified('length', LENGTH)} || ' valley'", "saddle": f"{quantified('elevation', 'elev_max')} || ' saddle'", "flat_zone": f"{quantified('area', '(area_pixels * 4)')} || ' flat area'"}
SLOPES = quantified("slope", "avg_slope")
TAILS = {
    "peak": f"' rising ' || {metres('coalesce(prominence, 0.0)')} || ' above ' || CASE WHEN elev_max < 10.1 THEN 'sea level' ELSE 'surrounding terrain' END || ' with ' || {SLOPES} || ' slopes'",
    "ridge": f"' with ' || {SLOPES} || ' slopes'",
    "valley": f"' with ' || {SLOPES} || ' floor slopes, part of a drainage network'",
    "saddle": f"' at ' || {metres('elev_max')} || ' elevation providing passage between surrounding areas'",
    "flat_zone": f"' spanning ' || {metres('(area_pixels * 4)::DOUBLE')} || ' with ' || {SLOPES} || ' slopes'",
}


def described(brief: bool) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {h}" + ("" if brief else f" || {TAILS[k]}") for k, h in HEADS.items())
    return truth(f"SELECT feature_id, CASE feature_type {cases} END AS description FROM truth")


def components(mask: str, out: str, eight: bool = False) -> str:
    """CTEs of the components of a table of pixels: (map_id, y, x, label), by reachability between runs of lines."""
    d = int(eight)
    return f"""{out}_px AS (SELECT map_id, y, x, x - row_number() OVER (PARTITION BY map_id, y ORDER BY x) AS g FROM {mask}),
{out}_run AS (SELECT map_id, y, g, min(x) AS a, max(x) AS b, y::BIGINT * 4294967296 + min(x) AS id FROM {out}_px GROUP BY map_id, y, g),
{out}_down AS (SELECT p.map_id, p.id AS u, q.id AS v FROM {out}_run p JOIN {out}_run q ON p.map_id = q.map_id AND q.y = p.y + 1 AND q.a <= p.b + {d} AND q.b >= p.a - {d}),
{out}_touch AS (SELECT map_id, u, v FROM {out}_down UNION ALL SELECT map_id, v, u FROM {out}_down),
{out}_reach AS (SELECT map_id, id AS u, id AS v FROM {out}_run UNION SELECT r.map_id, r.u, t.v FROM {out}_reach r JOIN {out}_touch t ON t.map_id = r.map_id AND t.u = r.v),
{out}_least AS (SELECT map_id, u AS id, min(v) AS label FROM {out}_reach GROUP BY map_id, u),
{out} AS (SELECT p.map_id, p.y, p.x, l.label FROM {out}_px p JOIN {out}_run r ON p.map_id = r.map_id AND p.y = r.y AND p.g = r.g JOIN {out}_least l ON l.map_id = r.map_id AND l.id = r.id)"""


def suppressed(points: str, out: str, radius: float) -> str:
    """CTEs of greedy suppression of points (map_id, id, x, y, strength), one after the other: (map_id, kept list)."""
    return f"""{out}_rank AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY strength DESC, id DESC) AS k FROM {points}),
{out}_walk AS (SELECT map_id, 0::BIGINT AS k, []::STRUCT(id BIGINT, x INT, y INT)[] AS kept FROM {out}_rank GROUP BY map_id
  UNION ALL SELECT w.map_id, w.k + 1, CASE WHEN len(list_filter(w.kept, lambda p: (p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y) <= {radius * radius})) = 0
    THEN list_append(w.kept, {{'id': r.id::BIGINT, 'x': r.x::INT, 'y': r.y::INT}}) ELSE w.kept END FROM {out}_walk w JOIN {out}_rank r ON r.map_id = w.map_id AND r.k = w.k + 1),
{out} AS (SELECT map_id, unnest(kept).id AS id FROM (SELECT map_id, arg_max(kept, k) AS kept FROM {out}_walk GROUP BY map_id))"""


def recursive(n: int, more: str, select: str) -> str:
    return chain(n, more, select).replace("WITH hills AS (", "WITH RECURSIVE hills AS MATERIALIZED (", 1)


SIGHT = f"""own AS (SELECT t.map_id, t.feature_id, t.seq, t.cx, t.cy, z.z, z.z + {d(C.observer_height_m)} * CASE WHEN t.feature_type = 'ridge' THEN {d(C.ridge_visibility_scale)} ELSE 1.0::DOUBLE END AS eye
  FROM truth t JOIN zz z ON z.map_id = t.map_id AND z.x = t.cx AND z.y = t.cy WHERE t.feature_type IN ('peak', 'ridge', 'saddle')),
pr AS (SELECT a.map_id, a.feature_id AS src, b.feature_id AS dst, a.cx AS x, a.cy AS y, b.cx AS x2, b.cy AS y2, a.eye, b.z + {d(C.target_height_m)} AS aim, abs(b.cx - a.cx) AS dx, abs(b.cy - a.cy) AS dy FROM own a JOIN own b ON a.map_id = b.map_id AND a.seq < b.seq
  AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= {(C.visibility_max_range_m / C.horizontal_scale) ** 2}),
st AS (SELECT *, greatest(dx, dy) AS n, least(dx, dy) AS m, unnest(range(1, greatest(dx, dy))) AS k FROM pr),
ce AS (SELECT *, x + sign(x2 - x)::INT * CASE WHEN dx >= dy THEN k ELSE (2 * k * m + n - 1) // (2 * n) END AS px, y + sign(y2 - y)::INT * CASE WHEN dx >= dy THEN (2 * k * m + n - 1) // (2 * n) ELSE k END AS py FROM st),
blocked AS (SELECT DISTINCT ce.map_id, ce.src, ce.dst FROM ce JOIN zz g ON g.map_id = ce.map_id AND g.x = ce.px AND g.y = ce.py
  WHERE g.z > ce.eye + (ce.aim - ce.eye) * sqrt(((px - ce.x) * (px - ce.x) + (py - ce.y) * (py - ce.y))::DOUBLE) / greatest(sqrt(((x2 - ce.x) * (x2 - ce.x) + (y2 - ce.y) * (y2 - ce.y))::DOUBLE), 1.0::DOUBLE) + {d(C.visibility_epsilon)}),
sg AS (SELECT map_id, src, dst FROM pr ANTI JOIN blocked USING (map_id, src, dst))"""

FLOWS = f"""{TRUTH},
wet AS (SELECT map_id, id FROM ac GROUP BY map_id, id HAVING count(*) >= 12),
go AS (SELECT n.map_id, n.id, n.nxt, w.id IS NOT NULL AS wet FROM ne n LEFT JOIN wet w ON w.map_id = n.map_id AND w.id = n.id),
tr AS (SELECT t.map_id, t.feature_id, g.id, g.nxt, g.wet FROM truth t JOIN go g ON g.map_id = t.map_id AND g.id = t.cy::BIGINT * 4294967296 + t.cx UNION ALL SELECT tr.map_id, tr.feature_id, g.id, g.nxt, g.wet FROM tr JOIN go g ON g.map_id = tr.map_id AND g.id = tr.nxt WHERE NOT tr.wet),
hit AS (SELECT tr.map_id, tr.feature_id AS src, t.feature_id AS dst, t.seq, (t.cx - tr.id % 4294967296) * (t.cx - tr.id % 4294967296) + (t.cy - tr.id // 4294967296) * (t.cy - tr.id // 4294967296) AS d2 FROM tr JOIN truth t ON t.map_id = tr.map_id WHERE tr.wet),
near1 AS (SELECT map_id, src, arg_min(dst, d2 * 1000000 + seq) AS dst FROM hit WHERE d2 <= {C.feature_snap_distance_px ** 2} GROUP BY map_id, src)"""

PATHS = f"""{TRUTH},
mid AS (SELECT map_id, quantile_cont(cost, 0.5) AS mid FROM co GROUP BY map_id),
want AS (SELECT a.map_id, a.feature_id AS src, b.feature_id AS dst, a.cx AS x, a.cy AS y, b.cx AS x2, b.cy AS y2 FROM truth a JOIN truth b ON a.map_id = b.map_id AND a.seq < b.seq JOIN mid m ON m.map_id = a.map_id
  WHERE (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= {C.connection_radius_px ** 2} AND sqrt(((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))::DOUBLE) * m.mid * {d(C.connectivity_heuristic_buffer)} <= {d(C.connectivity_max_cost)}),
mv AS (SELECT dx, dy, CASE WHEN dx <> 0 AND dy <> 0 THEN 1.414::DOUBLE ELSE 1.0::DOUBLE END AS w FROM (VALUES (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)) v(dx, dy)),
sp(map_id, src, y, x, c) USING KEY (map_id, src, y, x) AS (SELECT DISTINCT map_id, src, y, x, 0.0::DOUBLE FROM want
  UNION SELECT n.map_id, s.src, n.y, n.x, min(s.c + n.cost * mv.w) FROM sp s JOIN mv ON true JOIN co n ON n.map_id = s.map_id AND n.x = s.x + mv.dx AND n.y = s.y + mv.dy
  LEFT JOIN recurring.sp r ON r.map_id = n.map_id AND r.src = s.src AND r.y = n.y AND r.x = n.x WHERE s.c + n.cost * mv.w <= {d(C.connectivity_max_cost)} AND (r.c IS NULL OR s.c + n.cost * mv.w < r.c) GROUP BY n.map_id, s.src, n.y, n.x),
got AS (SELECT w.map_id, w.src, w.dst, sp.c FROM want w JOIN sp ON sp.map_id = w.map_id AND sp.src = w.src AND sp.x = w.x2 AND sp.y = w.y2)"""

FLATS = f"""flat AS (SELECT map_id, y, x, z, slope FROM sa WHERE slope < {d(C.flat_zone_slope_threshold_deg)} AND z >= {d(C.sea_level_offset)}),
{components('flat', 'cc')},
fz AS (SELECT cc.map_id, cc.label, floor(avg(x))::INT AS cx, floor(avg(y))::INT AS cy, count(*) AS area_pixels, min(x)::INT AS x_min, max(x)::INT AS x_max, min(y)::INT AS y_min, max(y)::INT AS y_max, min(z) AS elev_min, max(z) AS elev_max, avg(slope) AS avg_slope
  FROM cc JOIN flat USING (map_id, y, x) GROUP BY cc.map_id, cc.label HAVING count(*) >= {C.min_flat_zone_size_px})"""

_INSIDE = f"x BETWEEN {C.border_margin_px} AND {63 - C.border_margin_px} AND y BETWEEN {C.border_margin_px} AND {63 - C.border_margin_px}"
SADDLES = f"""p9 AS (SELECT map_id, quantile_cont(abs(k_curv), 0.9) AS p FROM cu WHERE k_curv <> 0 GROUP BY map_id),
cand AS (SELECT map_id, y::BIGINT * 4294967296 + x AS id, x, y, z, slope, abs(k_curv) AS strength, greatest(0.0::DOUBLE, least(1.0::DOUBLE, abs(k_curv) / greatest(coalesce(p, 1.0::DOUBLE), 1e-8::DOUBLE))) AS conf FROM cu JOIN ep USING (map_id) LEFT JOIN p9 USING (map_id)
  WHERE k_curv < -eps_k AND {_INSIDE} AND z > {d(C.sea_level_offset + 1.0)}),
{suppressed('cand', 'nms', C.nms_radius_px)}"""

_PR = C.prominence_radius_px
_INNER, _OUTER = max(2, int(C.annular_inner_m / C.horizontal_scale)), max(10, int(C.annular_outer_m / C.horizontal_scale))
PEAKS = f"""pz AS MATERIALIZED (SELECT map_id, y, x, z, slope, CASE WHEN h_curv > eps_h AND (abs(k_curv) < eps_k OR k_curv > eps_k) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cv FROM cu JOIN ep USING (map_id)),
lo1 AS (SELECT *, min(z) OVER (PARTITION BY map_id, y ORDER BY x ROWS BETWEEN {_PR} PRECEDING AND {_PR - 1} FOLLOWING) AS la FROM pz),
lo2 AS (SELECT *, z - min(la) OVER (PARTITION BY map_id, x ORDER BY y ROWS BETWEEN {_PR} PRECEDING AND {_PR - 1} FOLLOWING) AS relief FROM lo1),
{blurred('zz', 'z', C.peak_smooth_sigma, 'pb')},
n1 AS (SELECT map_id, y, x, b, max(b) OVER (PARTITION BY map_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rb FROM pb),
n2 AS (SELECT map_id, y, x, b, max(rb) OVER (PARTITION BY map_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM n1),
n3 AS (SELECT *, max(CASE WHEN top > b THEN b ELSE -1e300::DOUBLE END) OVER (PARTITION BY map_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ru FROM n2),
n4 AS (SELECT *, max(ru) OVER (PARTITION BY map_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS under FROM n3),
on_top AS MATERIALIZED (SELECT map_id, y, x, under = b AS beside FROM n4 WHERE top = b),
{components('on_top', 'pt', True)},
spoilt AS (SELECT DISTINCT pt.map_id, pt.label FROM pt JOIN on_top f USING (map_id, y, x) WHERE f.beside),
summit AS (SELECT map_id, y, x FROM pt ANTI JOIN spoilt USING (map_id, label)),
{components('summit', 'pk')},
pa AS (SELECT pk.map_id, pk.label, floor(avg(x))::INT AS cx, floor(avg(y))::INT AS cy, min(z) AS elev_min, avg(slope) AS avg_slope, count(*) AS size FROM pk JOIN lo2 USING (map_id, y, x) GROUP BY pk.map_id, pk.label HAVING count(*) >= {C.min_peak_size_px}),
pc AS (SELECT pa.*, c.z AS elev_max, c.relief AS prominence FROM pa JOIN lo2 c ON c.map_id = pa.map_id AND c.x = pa.cx AND c.y = pa.cy),
sh AS (SELECT pc.map_id, pc.label, avg(c.cv) AS share, count(*) AS n FROM pc JOIN pz c ON c.map_id = pc.map_id WHERE (c.x - pc.cx) * (c.x - pc.cx) + (c.y - pc.cy) * (c.y - pc.cy) BETWEEN {_INNER * _INNER} AND {_OUTER * _OUTER} GROUP BY pc.map_id, pc.label),
pf AS (SELECT pc.* FROM pc JOIN sh USING (map_id, label) WHERE n >= {C.peak_min_shoulder_samples} AND share >= {d(C.peak_shoulder_convex_ratio)} AND prominence > {d(C.peak_min_prominence_m)})"""


# Peaks of maps without a good one, by PEAKS: box maxima away from the border, in groups of two at least.
SPARE = f"""m1 AS (SELECT map_id, y, x, z, max(z) OVER (PARTITION BY map_id, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS rt FROM pz),
m2 AS (SELECT map_id, y, x, z, max(rt) OVER (PARTITION BY map_id, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM m1),
box_top AS MATERIALIZED (SELECT map_id, y, x FROM m2 ANTI JOIN pf USING (map_id) WHERE z = top AND {_INSIDE}),
{components('box_top', 'bt')},
ba AS (SELECT bt.map_id, bt.label, floor(avg(x))::INT AS cx, floor(avg(y))::INT AS cy, avg(slope) AS avg_slope FROM bt JOIN lo2 USING (map_id, y, x) GROUP BY bt.map_id, bt.label HAVING count(*) >= {2 * C.min_peak_size_px}),
tops AS MATERIALIZED (SELECT map_id, label, cx, cy, avg_slope, elev_max, prominence FROM pf
  UNION ALL SELECT ba.map_id, ba.label, ba.cx, ba.cy, ba.avg_slope, c.z, c.relief FROM ba JOIN lo2 c ON c.map_id = ba.map_id AND c.x = ba.cx AND c.y = ba.cy WHERE c.relief > {d(C.peak_min_prominence_m)})"""


def thinned(mask: str, out: str) -> str:
    """CTEs of Zhang-Suen thinning of a mask, all its maps in step: (map_id, y, x).

    A pixel sends a bit to each neighbour, 1 for the one south of it and so on clockwise, and 256 to itself.  Done after two
    passes, one of either kind, that take nothing off.
    """
    b, turned = "(code & 255)", "(((code & 255) >> 1) | ((code & 1) << 7))"
    return f"""{out}_to AS (SELECT * FROM (VALUES (1, 0, 1), (2, -1, 1), (4, -1, 0), (8, -1, -1), (16, 0, -1), (32, 1, -1), (64, 1, 0), (128, 1, 1), (256, 0, 0)) v(bit, dx, dy)),
{out}_pass AS (SELECT 0 AS k, 0 AS idle, map_id, y, x FROM {mask}
  UNION ALL SELECT k + 1, CASE WHEN busy THEN 0 ELSE idle + 1 END, map_id, y, x FROM (
    SELECT *, bool_or(gone) OVER () AS busy FROM (
      SELECT *, bit_count({b}) BETWEEN 2 AND 6 AND bit_count((255 - {b}) & {turned}) = 1 AND CASE WHEN k % 2 = 0 THEN code & 21 <> 21 AND code & 84 <> 84 ELSE code & 69 <> 69 AND code & 81 <> 81 END AS gone FROM (
        SELECT k, idle, map_id, p.y + t.dy AS y, p.x + t.dx AS x, sum(t.bit)::INT AS code FROM {out}_pass p, {out}_to t WHERE idle < 2 GROUP BY k, idle, map_id, p.y + t.dy, p.x + t.dx) WHERE code >= 256)) WHERE NOT gone),
{out} AS MATERIALIZED (SELECT map_id, y, x FROM {out}_pass WHERE k = (SELECT max(k) FROM {out}_pass))"""


RIDGES = f"""crest AS MATERIALIZED (SELECT map_id, y, x, z FROM cl WHERE curvature_type IN ('CONVEX', 'CYLINDRICAL_CONVEX')),
{components('crest', 'cr')},
solid AS MATERIALIZED (SELECT map_id, y, x FROM cr QUALIFY count(*) OVER (PARTITION BY map_id, label) >= {C.min_ridge_length_px}),
{thinned('solid', 'sk')},
{components('sk', 'sn')},
rf AS MATERIALIZED (SELECT sn.map_id, sn.label, floor(avg(x))::INT AS cx, floor(avg(y))::INT AS cy, max(z) AS elev_max FROM sn JOIN crest USING (map_id, y, x) GROUP BY sn.map_id, sn.label HAVING count(*) >= {C.min_ridge_length_px})"""

#: Peaks and ridges of the whole analysis, as a table of known features for SIGHT; peaks are numbered before ridges, and both before the low ones go.
SUMMITS = f"""np AS (SELECT map_id, count(*) AS n FROM tops GROUP BY map_id),
numbers AS (SELECT map_id, 'peak' AS feature_type, row_number() OVER (PARTITION BY map_id ORDER BY label) - 1 AS seq, cx, cy, elev_max, avg_slope, prominence FROM tops
  UNION ALL SELECT map_id, 'ridge', coalesce(n, 0) + row_number() OVER (PARTITION BY map_id ORDER BY label) - 1, cx, cy, elev_max, 15.0::DOUBLE, NULL FROM rf LEFT JOIN np USING (map_id)),
truth AS MATERIALIZED (SELECT *, sha256(concat_ws('|', map_id, feature_type, cx, cy, seq)) AS feature_id FROM numbers WHERE elev_max >= {d(C.elevation_reference_m)}),
{SIGHT},
asked AS (SELECT * FROM truth t WHERE feature_type = 'peak' AND EXISTS (SELECT 1 FROM sg JOIN truth o ON o.map_id = sg.map_id AND o.feature_id = sg.dst WHERE o.feature_type = 'ridge' AND sg.map_id = t.map_id AND sg.src = t.feature_id))"""


def synthetic(terms: list[str], h: int = 128, w: int = 128, tilt: float = 0.5) -> str:
    """Pixels of a synthetic map: the plane, and for each term a new height z in terms of z, wx and wy (metres from the centre)."""
    ctes = [f"s0 AS (SELECT y::INT AS y, x::INT AS x, (x - {w / 2}::DOUBLE) * {d(C.horizontal_scale)} AS wx, (y - {h / 2}::DOUBLE) * {d(C.horizontal_scale)} AS wy, {d(C.sea_level_offset)} + (x / {d(float(max(1, w - 1)))} * 2.0::DOUBLE - 1.0::DOUBLE) * {d(tilt)} AS z FROM range({h}) a(y), range({w}) b(x))"]
    for k, term in enumerate(terms):
        ctes.append(f"s{k + 1} AS (SELECT y, x, wx, wy, {term} AS z FROM s{k})")
    top = 255 * C.vertical_scale + C.sea_level_offset - 0.1
    return "WITH " + ",\n".join(ctes) + f"\nSELECT 0 AS map_id, y, x, {r(f'greatest({d(C.sea_level_offset)}, least({d(top)}, z))', 'z')} FROM s{len(terms)}"


def cone(x, y, height, radius, shape) -> str:
    d2 = f"((wx - {d(float(x))}) * (wx - {d(float(x))}) + (wy - {d(float(y))}) * (wy - {d(float(y))}))"
    return f"z + greatest(0.0::DOUBLE, {d(float(height))} * (1.0::DOUBLE - {d2} / {d(float(radius) ** 2)}))" if shape == "paraboloid" else f"z + {d(float(height))} * exp(-{d2} / {d(2.0 * (radius / 2) ** 2)})"


def wall(start, end, height, width) -> str:
    (x0, y0), (x1, y1) = start, end
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((wx - {d(float(x0))}) * {d(float(x1 - x0))} + (wy - {d(float(y0))}) * {d(float(y1 - y0))}) / {d(float((x1 - x0) ** 2 + (y1 - y0) ** 2))}))"
    return f"z + {d(float(height))} * exp(-(pow(wx - ({d(float(x0))} + {t} * {d(float(x1 - x0))}), 2) + pow(wy - ({d(float(y0))} + {t} * {d(float(y1 - y0))}), 2)) / {d(2.0 * width**2)})"


def pass_(x, y, a, b, height, radius) -> str:
    dx, dy = f"(wx - {d(float(x))})", f"(wy - {d(float(y))})"
    return f"z + ({d(float(a))} * {dx} * {dx} - {d(float(b))} * {dy} * {dy} + {d(float(height))}) * greatest(0.0::DOUBLE, 1.0::DOUBLE - sqrt({dx} * {dx} + {dy} * {dy}) / {d(float(radius))})"
