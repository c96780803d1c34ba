import heapq
import math

import numpy as np
import pytest

from ridgeline.config import Config
from ridgeline.functions.describe import describe
from ridgeline.operators import features, fields, flow, kernels, relations
from ridgeline.operators.graphs import closure, components, radius_join, roots, suppress
from ridgeline.plans import shell
from ridgeline.plans.query import by_prefix
from ridgeline.sources import grids

CFG = Config()


def frame(spark, grid, column="z", map_id=0):
    rows = [(map_id, y, x, grid[y, x].item()) for y in range(grid.shape[0]) for x in range(grid.shape[1])]
    return spark.createDataFrame(rows, f"map_id int, y int, x int, {column} {'int' if grid.dtype.kind == 'i' else 'double'}")


def grid_of(df, column):
    pdf = df.select("y", "x", column).toPandas()
    return kernels.to_grid(pdf, column)


@pytest.fixture(scope="module")
def ground():
    r = np.random.default_rng(3)
    y, x = np.mgrid[0:14, 0:17]
    return 10 + 5 * np.sin(x / 3) + 4 * np.cos(y / 2) + r.normal(size=(14, 17)) * 0.3


def test_blur_and_gradients(spark, ground):
    w = np.array(fields.kernel(1.0))
    pad = np.pad(ground, 4, mode="symmetric")
    want = sum(w[k] * pad[k : k + 14, :] for k in range(9))
    want = sum(w[k] * want[:, k : k + 17] for k in range(9))
    df = frame(spark, ground)
    assert np.allclose(grid_of(fields.blur(df, "z", 1.0), "z"), want, atol=1e-9)
    g = fields.gradient(df, CFG).cache()
    dy, dx = np.gradient(ground, 2.0)
    assert np.allclose(grid_of(g, "dz_dx"), dx) and np.allclose(grid_of(g, "dz_dy"), dy)
    s = fields.slope_aspect(g, CFG)
    slope = np.degrees(np.arctan(np.hypot(dx, dy)))
    assert np.allclose(grid_of(s, "slope"), slope)
    assert np.allclose(grid_of(s, "aspect"), np.where(slope < 0.5, 0, np.arctan2(dx, -dy) % (2 * math.pi)))
    yy, yx = np.gradient(dy, 2.0)
    xy, xx = np.gradient(dx, 2.0)
    m, q = (yx + xy) / 2, 1 + dx**2 + dy**2
    c = fields.curvature(s, CFG)
    assert np.allclose(grid_of(c, "h_curv"), ((1 + dy**2) * xx - 2 * dx * dy * m + (1 + dx**2) * yy) / (2 * np.sqrt(q) ** 3))
    assert np.allclose(grid_of(c, "k_curv"), (xx * yy - m**2) / q**2)


def test_ramps_point_uphill(spark):
    y, x = np.mgrid[0:4, 0:4].astype(float)
    for grid, angle in ((x, math.pi / 2), (y, math.pi)):
        a = grid_of(fields.slope_aspect(fields.gradient(frame(spark, grid), CFG), CFG), "aspect")
        assert np.allclose(a, angle)


def test_d8_and_drainage(spark):
    grid = np.full((5, 5), 9.0)
    grid[1, 2] = 1
    codes = grid_of(flow.directions(frame(spark, grid)), "d8")
    assert codes[0, 2] == 3 and codes[1, 2] == 0 and codes[2, 2] == 7 and codes[4, 4] == 0
    assert kernels.flood(grid, codes.astype(int))[1, 2] == 7
    r = np.random.default_rng(1)
    noise = r.integers(0, 60, (12, 12))
    df = flow.directions(frame(spark, noise, "gray"), "gray")
    acc, code = grid_of(flow.accumulation(df), "acc"), grid_of(df, "d8").astype(int)
    want = np.ones((12, 12))
    for i in np.argsort(-noise, axis=None, kind="stable"):
        y, x = divmod(int(i), 12)
        if code[y, x]:
            dx, dy = flow.D8[code[y, x] - 1]
            want[y + dy, x + dx] += want[y, x]
    assert (acc == want).all() and acc[code == 0].sum() == 144
    labels = grid_of(flow.watersheds(df), "label")
    assert len(np.unique(labels)) == (code == 0).sum()
    for y in range(12):
        for x in range(12):
            if code[y, x]:
                dx, dy = flow.D8[code[y, x] - 1]
                assert labels[y, x] == labels[y + dy, x + dx]


def test_flood_reaches_the_border():
    r = np.random.default_rng(2)
    z = r.integers(0, 30, (10, 10)).astype(float)
    out = kernels.flood(z, np.zeros((10, 10), int))
    assert ((out[1:-1, 1:-1] > 0).mean()) > 0.5
    assert heapq.nsmallest(1, z.ravel().tolist())


def test_line_cells_and_sight(spark):
    from pyspark.sql import functions as F

    cells = spark.range(1).select(relations.line_cells(F.lit(1), F.lit(2), F.lit(7), F.lit(4)).alias("c")).first().c
    assert [(c.x, c.y) for c in cells] == [(2, 2), (3, 3), (4, 3), (5, 3), (6, 4), (7, 4)]
    grid = np.zeros((3, 9))
    grid[1, 4] = 5.0
    pairs = spark.createDataFrame([(0, "a", "b", 0, 1, 8, 1, 1.7, 0.0), (0, "c", "d", 0, 0, 8, 0, 1.7, 0.0), (0, "e", "f", 3, 2, 3, 2, 1.7, 0.0)], "map_id int, src string, dst string, x int, y int, x2 int, y2 int, eye double, aim double")
    assert {(r.src, r.dst) for r in relations.sight(frame(spark, grid), pairs, CFG).collect()} == {("c", "d"), ("e", "f")}


def test_components_and_suppression(spark):
    r = np.random.default_rng(4)
    mask = r.random((16, 16)) < 0.55
    rows = [(0, int(y), int(x)) for y, x in np.argwhere(mask)]
    for eight, tile in ((False, 512), (True, 512), (False, 5), (True, 5)):
        got = {(p.y, p.x): p.label for p in components(spark.createDataFrame(rows, "map_id int, y int, x int"), eight, tile).collect()}
        label = {(y, x): y << 32 | x for _, y, x in rows}
        near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * eight
        while True:
            new = {p: min([v] + [label[p[0] + a, p[1] + b] for a, b in near if (p[0] + a, p[1] + b) in label]) for p, v in label.items()}
            if new == label:
                break
            label = new
        assert got == label
    pts = [(0, k, int(r.integers(60)), int(r.integers(60)), float(r.integers(20))) for k in range(120)]
    kept = []
    for _, k, x, y, s in sorted(pts, key=lambda p: (-p[4], -p[1])):
        if all((x - a) ** 2 + (y - b) ** 2 > 100 for a, b in kept):
            kept.append((x, y))
    got = suppress(spark.createDataFrame(pts, "map_id int, id long, x int, y int, strength double"), 10).collect()
    assert len(got) == len(kept) and {(p[2], p[3]) for p in pts if p[1] in {g.id for g in got}} == set(kept)


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("b",)], "id string")
    assert {r.id for r in closure(edges, start).collect()} == {"a", "b", "c", "d"}
    assert {r.id for r in closure(edges, spark.createDataFrame([("d",)], "id string"), True).collect()} == {"a", "b", "c", "d"}
    links = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, None), (0, 4, 5), (0, 5, 4)], "map_id int, id long, next long")
    assert {r.id: r.root for r in roots(links).collect()} == {1: 3, 2: 3, 3: 3, 4: None, 5: None}
    left = spark.createDataFrame([(0, 0, 0), (0, 30, 30)], "map_id int, x int, y int")
    right = spark.createDataFrame([(0, 3, 4), (0, 3, 5), (0, 30, 25), (1, 0, 0)], "map_id int, x2 int, y2 int")
    assert {(r.x, r.x2, r.y2, r.dist) for r in radius_join(left, right, 5).collect()} == {(0, 3, 4, 5.0), (30, 30, 25, 5.0)}


def test_path_kernels():
    cost = np.ones((9, 9))
    cost[4, 1:8] = 50
    found = kernels.dijkstra(cost, (4, 0), {(4, 8), (8, 8)}, 1000)
    assert found[4, 8] == pytest.approx(kernels.a_star(cost, (4, 0), (4, 8), visited_ratio=1.0))
    assert kernels.dijkstra(cost, (4, 0), {(4, 8)}, 3) == {}
    m = np.zeros((12, 20), bool)
    m[4:8, 2:18] = True
    line = kernels.thin(m)
    assert line.sum() > 8 and not (line & ~m).any() and not (line[:-1, :-1] & line[1:, :-1] & line[:-1, 1:] & line[1:, 1:]).any()
    pts = np.array([(0, 0), (3, 0), (1, 0), (2, 0), (4, 1)])
    assert kernels.order_points(pts).tolist() in ([0, 2, 3, 1, 4], [4, 1, 3, 2, 0])


def test_image_round_trip(spark, tmp_path):
    gray = (np.arange(48).reshape(6, 8) * 5 % 256).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(grids.encode_png(gray))
    px = grids.images(spark, str(tmp_path))
    assert (grid_of(px, "gray") == gray).all()
    v = grids.validate(px).first()
    assert (v.h, v.w, v.n, v.valid) == (6, 8, 48, True)
    assert len(grids.content_hash(px).first().content) == 16
    made = []
    for _ in range(2):
        grids.cached(spark, str(tmp_path / "cache"), grids.cache_key("x", "y"), "pixels", lambda: made.append(1) or px)
    assert made == [1]


def test_builder_and_shell(spark):
    from ridgeline import catalog

    rows = [(0, k, f"id{k}", "peak" if k % 2 else "valley", k, 2 * k, float(k), float(k), 0.5, 12.0, [None, 30.0, 2000.5][k % 3], None, [(0, 0), (3, 4)]) for k in range(1, 9)]
    kind = "map_id int, seq long, feature_id string, feature_type string, cx int, cy int, elev_min double, elev_max double, confidence double, avg_slope double, prominence double, area_pixels long, spine array<struct<x:int,y:int>>"
    t = spark.createDataFrame(rows, kind)
    edges = spark.createDataFrame([("id2", "id4"), ("id4", "id6")], "src string, dst string")
    both = spark.createDataFrame([(0, "id1", "id3"), (0, "id3", "id1")], "map_id int, src string, dst string")
    basins = spark.createDataFrame([(0, "basin_0", "id1")], "map_id int, basin_key string, feature_id string")
    terrain = catalog.Known(CFG, t, both, edges, both, basins, frame(spark, np.zeros((3, 3))))
    ids = lambda r: [x.feature_id for x in r.collect()]
    assert ids(shell.run(terrain, "SELECT peak WHERE cx__gte=3 cx__lt=8 ORDER BY cx DESC LIMIT 2")) == ["id7", "id5"]
    assert ids(shell.run(terrain, "select peak order by prominence desc")) == ["id3", "id5", "id1", "id7"]
    assert ids(shell.run(terrain, "DOWN id2")) == ["id2", "id4", "id6"] and ids(shell.run(terrain, "VIS id1")) == ["id3"]
    assert ids(terrain.query().select("peak").in_watershed("basin_0").to_df()) == ["id1"]
    assert shell.run(terrain, "SHOW id5") == "major peak rising 2.0km above sea level with moderate slopes"
    assert shell.run(terrain, "# note") is None and "SELECT" in shell.run(terrain, "HELP")
    stat = shell.run(terrain, "STAT").first()
    assert (stat.peaks, stat.valleys, stat.flow_edges, stat.visibility_pairs) == (4, 4, 2, 1)
    assert ids(terrain.query().select("peak").where(cx="3").to_df()) == [] and ids(terrain.query().select("peak").where(nothing__neq=1).to_df()) == []
    for bad in ("SELECT peak LIMIT 0", "SELECT peak ORDER cx", "SELECT hill", "SELECT peak WHERE cx__like=3", "FLY"):
        with pytest.raises(ValueError):
            shell.run(terrain, bad)
    with pytest.raises(TypeError):
        terrain.query().select("peak").where(cx__gt="a").to_df()
    with pytest.raises(KeyError):
        by_prefix(t, "id")
    out = []
    lines = iter(["SELECT hill", "STAT", "quit"])
    shell.repl(terrain, lambda _: next(lines), out.append)
    assert out[0].startswith("error") and "peaks" in out[1]
    brief = t.select(describe(CFG, True).alias("d")).collect()
    assert brief[1].d == "short valley"


def test_spine_helpers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [(0, 0), (3, 4), (3, 4)])], "k int, spine array<struct<x:int,y:int>>")
    row = df.select(features.polyline_length(F.col("spine"), 2.0).alias("n"), features.contains_point(F.col("spine"), 3, 5, 1.5).alias("a"), features.contains_point(F.col("spine"), 9, 9, 2.0).alias("b")).first()
    assert tuple(row) == (10.0, True, False)


def test_components_take_few_rounds(spark):
    n, turns = 2000, []
    rows = []
    for k in range(n):  # a serpentine: every second line is one run, the lines between join them at alternate ends
        rows += [(0, 2 * k, x) for x in range(3)] + [(0, 2 * k + 1, 2 * (k % 2))]
    got = components(spark.createDataFrame(rows, "map_id int, y int, x int"), tile=2, rounds=turns)
    assert got.select("label").distinct().count() == 1 and got.count() == len(rows)
    assert len(turns) < 20


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_are_exact(spark, accuracy, monkeypatch):
    from pyspark.sql import functions as F

    from ridgeline.operators import quantiles as q

    monkeypatch.setattr(q, "ACCURACY", accuracy)
    r = np.random.default_rng(6)
    groups = {0: r.normal(size=3001), 1: r.integers(0, 5, 800).astype(float), 2: np.array([7.0]), 3: np.concatenate([np.zeros(900), r.random(17) * 1e9])}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [(1, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "map_id int, v double").repartition(6)
    got = {x.map_id: x for x in q.quantiles(df, a=(F.col("v"), 0.05), b=(F.col("v"), 0.5), c=(F.abs("v"), 0.9)).collect()}
    for g, own in groups.items():
        assert np.allclose([got[g].a, got[g].b, got[g].c], [np.percentile(own, 5), np.percentile(own, 50), np.percentile(np.abs(own), 90)], rtol=1e-12)


def test_tiles_make_no_difference(spark, ground):
    from ridgeline.operators import stencils

    df = frame(spark, ground)
    steps = (stencils.blur("z", 1.0), stencils.differences("z", "a", "b", 2.0), stencils.differences("a", "aa", "ab", 2.0), stencils.box("z", -2, 1, "min", "low"), stencils.variance("z", "v"), stencils.strict_top("z", "top"))
    whole, cut = stencils.apply(df, *steps), stencils.apply(df, *steps, tile=sum(s.reach for s in steps))
    for c in ("z", "a", "b", "aa", "ab", "low", "v", "top"):
        assert np.array_equal(grid_of(whole, c), grid_of(cut, c))
    low = grid_of(whole, "low")
    z = grid_of(whole, "z")
    assert all(low[y, x] == z[max(0, y - 2) : y + 2, max(0, x - 2) : x + 2].min() for y in range(14) for x in range(17))
