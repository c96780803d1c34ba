"""Extraction, the whole analysis, layer tables and panels, against plain versions."""

import math

import numpy as np
import pytest
from test_terrain import frame, grid_of

from ridgeline.config import Config
from ridgeline.functions import panels
from ridgeline.operators import features, fields, flow, kernels, relations, synth
from ridgeline.plans import shell
from ridgeline.sources import grids

CFG = Config()


def test_self_test_passes(spark):
    rows = synth.self_test(spark).collect()
    assert len(rows) == 6 and all(r.passed for r in rows), rows


def plain_thin(mask):
    """Zhang and Suen's two passes, a pixel at a time."""
    m = {(y, x) for y, x in np.argwhere(mask).tolist()}
    while True:
        before = len(m)
        for first in (True, False):
            gone = set()
            for y, x in m:
                p = [(y - 1, x) in m, (y - 1, x + 1) in m, (y, x + 1) in m, (y + 1, x + 1) in m, (y + 1, x) in m, (y + 1, x - 1) in m, (y, x - 1) in m, (y - 1, x - 1) in m]
                turns = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                n, e, s, w = p[0], p[2], p[4], p[6]
                a, b = (n and e and s, e and s and w) if first else (n and e and w, n and s and w)
                if 2 <= sum(p) <= 6 and turns == 1 and not a and not b:
                    gone.add((y, x))
            m -= gone
        if len(m) == before:
            return m


def test_thinning_by_component(spark):
    r = np.random.default_rng(8)
    mask = np.kron(r.random((9, 11)) < 0.5, np.ones((3, 3))).astype(bool)
    mask[4, :] = False
    df = spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(mask)], "map_id int, y int, x int")
    assert {(p.y, p.x) for p in kernels.skeleton(df).collect()} == plain_thin(mask)


def plain_order(points):
    d = np.hypot(*(points[:, None, :] - points[None, :, :]).transpose(2, 0, 1))
    near = np.sort(d, axis=1)[:, :3]
    ends = (near <= 2.0).sum(axis=1)
    at = int(ends.argmin()) if ends.min() <= 2 else int(np.hypot(*(points - points.mean(axis=0)).T).argmax())
    out, left = [at], np.ones(len(points), bool)
    left[at] = False
    while left.any():
        rest = np.flatnonzero(left)
        at = int(rest[d[at, rest].argmin()])
        out.append(at)
        left[at] = False
    return out


def test_spine_order():
    r = np.random.default_rng(3)
    for n in (3, 5, 40, 150):
        for span in (8, 30, 400):
            pts = np.unique(r.integers(0, span, (n, 2)), axis=0).astype(float)
            assert kernels.order_points(pts).tolist() == (plain_order(pts) if len(pts) > 2 else list(range(len(pts))))


def test_large_maps_are_refused(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(kernels, "MAX_PIXELS", 10)
    with pytest.raises(kernels.TooLarge):
        kernels.to_grid(pd.DataFrame({"y": [4], "x": [4], "z": [1.0]}), "z")


def plain_maxima(z):
    """Plateaus without a higher neighbour, by flooding from each pixel."""
    h, w = z.shape
    out, seen = set(), set()
    for y in range(h):
        for x in range(w):
            if (y, x) in seen:
                continue
            plateau, todo, top = {(y, x)}, [(y, x)], True
            while todo:
                b, a = todo.pop()
                for j in range(max(0, b - 1), min(h, b + 2)):
                    for i in range(max(0, a - 1), min(w, a + 2)):
                        if z[j, i] > z[b, a]:
                            top = False
                        elif z[j, i] == z[b, a] and (j, i) not in plateau:
                            plateau.add((j, i))
                            todo.append((j, i))
            seen |= plateau
            out |= plateau if top else set()
    return out


def test_regional_maxima(spark):
    from ridgeline.operators import stencils

    z = np.random.default_rng(4).integers(0, 4, (15, 18)).astype(float)
    df = stencils.apply(frame(spark, z), features.plateau_step("z", "flat"), tile=7)
    assert {(p.y, p.x) for p in features.regional_maxima(df, "flat").collect()} == plain_maxima(z)


def two_hills():
    y, x = np.mgrid[0:64, 0:64]
    z = 20 + 60 * np.exp(-((x - 20) ** 2 + (y - 30) ** 2) / 60) + 45 * np.exp(-((x - 44) ** 2 + (y - 34) ** 2) / 50) + 6 * np.exp(-((y - 32) ** 2) / 30)
    return np.minimum(255, z / CFG.vertical_scale).astype(np.int32)


@pytest.fixture(scope="module")
def terrain(spark):
    return relations.analyze(frame(spark, two_hills(), "gray"), CFG)


def test_analysis_end_to_end(spark, terrain):
    rows = {r.feature_id: r for r in terrain.features.collect()}
    kinds = [r.feature_type for r in sorted(rows.values(), key=lambda r: r.seq)]
    assert kinds.count("peak") == 2 and kinds == sorted(kinds, key=features.TYPES.index)
    assert [r.seq for r in sorted(rows.values(), key=lambda r: r.seq)] == list(range(len(rows)))
    near = {(r.cx, r.cy) for r in rows.values() if r.feature_type == "peak"}
    assert all(any(abs(x - a) <= 2 and abs(y - b) <= 2 for a, b in near) for x, y in ((20, 30), (44, 34)))
    sights = {(e.src, e.dst) for e in terrain.visibility.collect()}
    assert sights == {(b, a) for a, b in sights}
    peaks = [i for i, r in rows.items() if r.feature_type == "peak"]
    assert (peaks[0], peaks[1]) in sights
    # Links hold for all pairs, and only those, that are near enough.
    far = CFG.feature_connection_tolerance_px
    for r in rows.values():
        if r.feature_type == "ridge":
            ends = [r.spine[0], r.spine[-1]] if len(r.spine) > 1 else []
            assert r.connected_peaks == sorted(i for i in peaks if any(math.hypot(rows[i].cx - e.x, rows[i].cy - e.y) <= far for e in ends))
        elif r.feature_type == "saddle":
            for name, kind in (("connecting_ridges", "ridge"), ("connecting_valleys", "valley")):
                assert r[name] == sorted(o.feature_id for o in rows.values() if o.feature_type == kind and any(math.hypot(r.cx - e.x, r.cy - e.y) <= far for e in o.spine))
        else:
            assert r.connected_peaks is None and r.connecting_ridges is None
    costs = {(e.src, e.dst): e.path_cost for e in terrain.connectivity.collect()}
    assert all(costs[b, a] == c and c <= CFG.connectivity_max_cost for (a, b), c in costs.items())
    assert all(e.src in rows and e.dst in rows and e.src != e.dst for e in terrain.flow.collect())
    homes = {m.feature_id: m.basin_key for m in terrain.basins.collect()}
    assert all(r.watershed_id == homes.get(i) for i, r in rows.items() if r.feature_type != "saddle")
    z = grid_of(terrain.pixels, "z")
    assert all(abs(r.elevation - z[r.cy, r.cx]) < 1e-9 for r in rows.values())


def test_questions_about_an_analysis(terrain):
    top = terrain.query().select("peak").order_by("prominence", descending=True).limit(1).to_df().first()
    assert (abs(top.cx - 20) <= 2) and top.prominence > 30
    shown = shell.run(terrain, "SELECT peak ORDER BY prominence DESC LIMIT 1").first()
    assert shown.feature_id == top.feature_id and shown.description.startswith(shown.brief) and "rising" in shown.description
    assert shell.run(terrain, f"SHOW {top.feature_id[:16]}") == shown.description
    assert shell.run(terrain, f"PING {top.cx} {top.cy} 1 peak").first().feature_id == top.feature_id
    stat = shell.run(terrain, "STAT").first()
    assert (stat.w, stat.h, stat.peaks) == (64, 64, 2)
    linked = [r for r in terrain.features.filter("feature_type = 'ridge' and size(connected_peaks) > 0").collect()]
    for r in linked[:2]:
        text = shell.run(terrain, f"SHOW {r.feature_id}")
        assert text.endswith("connecting two high points" if len(r.connected_peaks) == 2 else f"connecting {len(r.connected_peaks)} high points")


def test_the_query_that_asks_an_analysis(spark, terrain, monkeypatch):
    from ridgeline import catalog

    monkeypatch.setattr(catalog, "analyzed", lambda spark, sf_dir: terrain)
    out = catalog.QUERIES["analyze_and_ask"](spark, "")
    rows = {r.feature_id: r for r in terrain.features.collect()}
    seen = {e.src for e in terrain.visibility.collect() if rows[e.dst].feature_type == "ridge"}
    want = sorted((r for i, r in rows.items() if r.feature_type == "peak" and i in seen), key=lambda r: (-r.prominence, r.map_id, r.seq))
    assert want
    texts = {r.feature_id: (r.brief, r.description) for r in shell.run(terrain, "SELECT peak").collect()}
    assert [(r.feature_id, r.cx, r.cy, r.prominence, r.brief, r.description) for r in out.collect()] == [(r.feature_id, r.cx, r.cy, round(r.prominence, 6), *texts[r.feature_id]) for r in want]


def test_thinning_in_sql():
    import duckdb

    from ridgeline.plans import oracle

    r = np.random.default_rng(6)
    masks = [np.kron(r.random((9, 9)) < share, np.ones((3, 3))).astype(bool) for share in (0.2, 0.5, 0.8)] + [r.random((20, 20)) < 0.7]
    db = duckdb.connect()
    db.execute("CREATE TABLE mask (map_id INT, y INT, x INT)")
    db.executemany("INSERT INTO mask VALUES (?, ?, ?)", [(k, *p) for k, m in enumerate(masks) for p in np.argwhere(m).tolist()])
    got = db.execute(f"WITH RECURSIVE {oracle.thinned('mask', 'sk')} SELECT map_id, y, x FROM sk").fetchall()
    assert sorted(got) == sorted((k, *p) for k, m in enumerate(masks) for p in plain_thin(m))


def test_the_whole_analysis_against_its_sql(spark, tmp_path):
    import duckdb

    from ridgeline import catalog

    # 273's one peak is found by the second look alone, and it has no ridge; 2 has ridges and no peak.
    hills = {273: [606, 16182, 10410, 19626, 15012], 262: [11831, 12545, 4615, 538, 698, 8220, 18427, 15016], 37: [13821, 4772, 1826, 1073, 16174], 161: [13353, 14611], 162: [1683, 1233], 1: [5], 2: [40, 7000]}
    spark.createDataFrame([(k, m) for m, keys in hills.items() for k in keys], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["analyze_and_ask"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    want = db.execute(catalog.ORACLES["analyze_and_ask"]).fetchall()
    assert want and got == want


def test_values_that_are_not_finite(spark):
    z = np.ones((4, 5))
    z[1, 2] = np.nan
    df = frame(spark, z)
    assert fields.surface_checks(df).first().bad == 1
    with pytest.raises(ValueError, match="z"):
        fields.require_finite(df, "z")
    c = fields.curvature(fields.gradient(df, CFG))
    assert np.isfinite(grid_of(c, "h_curv")).all() and grid_of(c, "h_curv")[1, 2] == 0
    flat = frame(spark, np.full((3, 3), 7.0))
    assert fields.require_finite(flat, "z") is flat


def test_circles_drain_to_the_nearest_basin(spark):
    codes = np.zeros((4, 9), np.int32)
    codes[:, :] = 5  # west
    codes[:, 0] = 0
    codes[1, 7], codes[1, 8] = 1, 5  # a circle of two
    label = grid_of(flow.watersheds(frame(spark, codes, "d8")), "label")
    assert label[0].tolist() == [0] * 9 and label[2].tolist() == [2] * 9
    # Of three pixels at a distance of one, the first in row-major order is above.
    assert label[1, 6] == 1 and label[1, 7] == label[1, 8] == 0 and not np.isnan(label).any()


def test_layer_tables(spark, tmp_path):
    from dataclasses import replace

    px, made = frame(spark, two_hills()[:12, :12], "gray"), []
    make = lambda: made.append(1) or fields.surface(px, CFG)
    for _ in range(2):
        out = grids.cached_layer(px, str(tmp_path), CFG, "curvature", make)
    assert made == [1] and {"eps_h", "eps_k"} <= set(out.columns)
    grids.cached_layer(px, str(tmp_path), replace(CFG, horizontal_scale=3.0), "curvature", make)
    grids.cached_layer(px.withColumn("gray", px.gray + 1), str(tmp_path), CFG, "curvature", make)
    assert len(made) == 3
    grids.save_tables(str(tmp_path / "set"), a=px, b=out)
    got = grids.load_tables(spark, str(tmp_path / "set"), "a", "b")
    assert got["a"].count() == 144 and got["b"].columns == out.columns


def test_colour_images_have_ids_of_their_own(spark, tmp_path):
    import struct
    import zlib

    def png(rgb):
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        h, w, _ = rgb.shape
        rows = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    r = np.random.default_rng(1)
    pictures = [r.integers(0, 256, (4, 5, 3)).astype(np.uint8) for _ in range(3)]
    for k, p in enumerate(pictures):
        (tmp_path / f"{k}.png").write_bytes(png(p))
    px = grids.images(spark, str(tmp_path))
    for k, p in enumerate(pictures):
        want = (p[:, :, 0].astype(int) * 19595 + p[:, :, 1].astype(int) * 38470 + p[:, :, 2].astype(int) * 7471 + 32768) >> 16
        assert (grid_of(px.filter(f"map_id = {k}"), "gray") == want).all()


def test_downsampling(spark):
    y, x = np.mgrid[0:31, 0:16]
    plane = 2.0 * y + 3.0 * x
    out = grid_of(panels.downsampled(frame(spark, plane), "z", 11), "z")
    b, a = np.mgrid[0:11, 0 : out.shape[1]]
    assert out.shape[0] == 11 and np.allclose(out, 2.0 * b * 3.0 + 3.0 * a * 15 / (out.shape[1] - 1))
    assert (grid_of(panels.downsampled(frame(spark, plane), "z", 31), "z") == plane).all()


def test_snapping_can_be_off(spark):
    from dataclasses import replace

    t = spark.createDataFrame([(0, "a", 1, 1, 0)], "map_id int, feature_id string, cx int, cy int, seq long")
    d8 = flow.directions(frame(spark, np.random.default_rng(2).integers(0, 9, (6, 6)), "gray"), "gray")
    streams = flow.stream_mask(flow.accumulation(d8), 1)
    assert flow.flow_edges(t, d8, streams, replace(CFG, snap_method="none")).collect() == []


def test_floods_route_every_pit_to_the_border():
    """Without flat ground, all inner cells drain to the border, each to the neighbour that reached it first."""
    import heapq

    r = np.random.default_rng(9)
    z = r.permutation(150).reshape(10, 15).astype(float)
    out = kernels.flood(z, np.zeros((10, 15), int))
    seen, heap, came = set(), [], {}
    for y in range(10):
        for x in range(15):
            if y in (0, 9) or x in (0, 14):
                heap.append((z[y, x], y, x))
                seen.add((y, x))
    heapq.heapify(heap)
    while heap:
        v, y, x = heapq.heappop(heap)
        for dx, dy in flow.D8:
            a, b = x + dx, y + dy
            if 0 <= a < 15 and 0 <= b < 10 and (b, a) not in seen:
                seen.add((b, a))
                came[b, a] = (y, x, v)
                heapq.heappush(heap, (z[b, a], b, a))
    for (b, a), (y, x, v) in came.items():
        if z[b, a] >= v:
            assert flow.D8[out[b, a] - 1] == (x - a, y - b)
