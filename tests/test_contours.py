"""Rings, polygons and regions of bands against brute force, whatever the strips."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite.operators import contours, intensity

SIDE = 24
GRID = (10.0, 40.0, 0.5, 0.5, SIDE, SIDE)


def surface(spark, *grids):
    rows = [(n, r, c, float(g[r, c])) for n, g in enumerate(grids) for r in range(g.shape[0]) for c in range(g.shape[1])]
    return spark.createDataFrame(rows, "event_id long, row int, col int, mmi double")


def cone(top=9.0, fall=0.6, r=11.3, c=12.1):
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    return top - fall * np.hypot(y - r, x - c)


def ring_wall():
    """High along a circle, low inside and outside."""
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    return 6.5 - np.abs(np.hypot(y - 11.4, x - 11.6) - 7)


def noise(seed):
    return np.random.default_rng(seed).uniform(0, 11, (SIDE, SIDE))


def clipped(polygon, level, keep_above):
    """The part of a polygon of (x, y, m) that is at a level or above it, or below it; m is linear on each side."""
    out = []
    for (x, y, m), (u, v, n) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        a, b = (m >= level) == keep_above, (n >= level) == keep_above
        if a:
            out.append((x, y, m))
        if a != b:
            t = (level - m) / (n - m)
            out.append((x + t * (u - x), y + t * (v - y), level))
    return out


def shoelace(points):
    return sum(x * v - u * y for (x, y, *_), (u, v, *_) in zip(points, points[1:] + points[:1], strict=True)) / 2


def grid_area(g, lower):
    """Area of a band by clipping each quad's polygon, which a saddle would need more than that for."""
    total = 0.0
    for r in range(SIDE - 1):
        for c in range(SIDE - 1):
            quad = [(c, -r, g[r, c]), (c, -r - 1, g[r + 1, c]), (c + 1, -r - 1, g[r + 1, c + 1]), (c + 1, -r, g[r, c + 1])]
            part = clipped(quad, lower, True)
            part = clipped(part, lower + 1, False) if part and lower < 10 else part
            total += abs(shoelace(part)) if part else 0.0
    return total * 0.25


def inside(rings, x, y):
    """Even-odd over all rings of a band."""
    odd = False
    for xs, ys in rings:
        for x1, y1, x2, y2 in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1], strict=True):
            if (y1 > y) != (y2 > y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x:
                odd = not odd
    return odd


@pytest.mark.parametrize("strip", [1, 5, 64])
def test_band_areas_and_points(spark, strip):
    grids = [cone(), ring_wall(), noise(1), noise(2), np.full((SIDE, SIDE), 4.5)]
    found = contours.band_rings(surface(spark, *grids), GRID, strip=strip).collect()
    rng = random.Random(4)
    for n, g in enumerate(grids):
        for lower in range(2, 11):
            rings = [r for r in found if (r.event_id, r.mmi_lower) == (n, lower)]
            total = sum(r.area for r in rings)
            if n in (0, 4):
                assert math.isclose(total, grid_area(g, lower), abs_tol=1e-9)
            shapes = [(list(r.x), list(r.y)) for r in rings]
            for _ in range(40 if n in (1, 2) else 0):  # a point's band by interpolation near the centres, where all agree
                r, c = rng.randrange(1, SIDE - 1), rng.randrange(1, SIDE - 1)
                if abs(g[r, c] - round(g[r, c])) > 0.2:
                    x, y = 10 + (c + 0.5) * 0.5 + 1e-4, 40 - (r + 0.5) * 0.5 + 1e-4
                    assert inside(shapes, x, y) == (math.floor(g[r, c]) == lower or lower == 10 and g[r, c] >= 10)
    for n in range(len(grids)):  # bands share their borders: all areas together are what is at the least level or above
        assert sum(r.area for r in found if r.event_id == n) <= (SIDE - 1) ** 2 * 0.25 + 1e-9


def test_rings_do_not_depend_on_strips(spark):
    s = surface(spark, cone(), ring_wall(), noise(3)).cache()
    shape = lambda strip: sorted((r.event_id, r.mmi_lower, r.hole, round(r.area, 9), len(r.x), min(zip(r.x, r.y, strict=True))) for r in contours.band_rings(s, GRID, strip=strip).collect())
    assert shape(3) == shape(10) == shape(64)


def test_polygons_and_their_holes(spark):
    polygons = contours.band_polygons(contours.band_rings(surface(spark, ring_wall()), GRID, strip=7))
    got = {(r.mmi_lower, r.part): r for r in polygons.collect()}
    top = [r for r in got.values() if r.mmi_lower == 6]
    assert len(top) == 1 and top[0].n_holes == 1, "the wall is a ring with one hole"
    outer, hole = top[0].geometry
    assert shoelace([tuple(p) for p in outer[:-1]]) > 0 > shoelace([tuple(p) for p in hole[:-1]]) and outer[0] == outer[-1] and hole[0] == hole[-1]
    assert sorted(r.n_holes for r in got.values() if r.mmi_lower == 5) == [1, 1], "a band on each side of the wall"
    features = [json.loads(r.feature) for r in contours.polygon_features(polygons).collect()]
    assert {f["properties"]["mmi_lower"] for f in features} == {k[0] for k in got} and all(f["geometry"]["type"] == "Polygon" for f in features)
    assert features[0]["properties"].keys() == {"mmi_lower", "mmi_upper", "color", "label"}
    exported = contours.export_polygons(polygons, (6,)).collect()
    assert [(r.mmi_low, r.mmi_high, len(r.geometry), len(r.geometry[0])) for r in exported] == [(6, 7, 1, 2)]
    big = contours.band_polygons(contours.band_rings(surface(spark, noise(5)), GRID), 1.0)
    assert 0 < big.count() == big.filter("area >= 1").count()


def test_no_band_at_or_above_the_maximum(spark):
    found = contours.band_rings(surface(spark, cone(top=6.0, r=11.0, c=12.0), np.full((SIDE, SIDE), 1.5)), GRID)
    assert {(r.event_id, r.mmi_lower) for r in found.collect()} == {(0, k) for k in range(2, 6)}
    assert contours.band_rings(surface(spark, cone()).limit(0), GRID).count() == 0


@pytest.mark.parametrize("strip", [1, 4, 64])
def test_regions_by_strips_are_a_flood_fill(spark, strip):
    rng = np.random.default_rng(8)
    cells = {(e, int(rng.integers(2, 5)), r, c) for e in range(3) for r in range(30) for c in range(30) if rng.random() < 0.9}
    b = spark.createDataFrame(sorted(cells), "event_id long, mmi_lower int, row int, col int").repartition(5)
    want = {}
    todo = set(cells)
    while todo:
        stack, found = [todo.pop()], []
        while stack:
            e, m, r, c = stack.pop()
            found.append((r, c))
            near = {(e, m, r + 1, c), (e, m, r - 1, c), (e, m, r, c + 1), (e, m, r, c - 1)} & todo
            todo -= near
            stack += near
        for cell in found:
            want[e, m, *cell] = min(found)
    runs = contours.region_runs(b, strip).withColumn("col", F.explode(F.sequence("c0", "c1"))).collect()
    assert {(r.event_id, r.mmi_lower, r.row, r.col): tuple(r.region_id) for r in runs} == want


def test_margin_holds_the_neighbours(spark):
    cells = intensity.load_cells(spark.range(60 * 60).selectExpr("CAST(id div 60 AS int) AS row", "CAST(id % 60 AS int) AS col", "180.0D + id % 900 AS raw"), 60.0, 40.0, 0.1, 0.1)
    events = spark.createDataFrame([(1, 5.5, 10.0, 63.0, 37.0), (2, 3.0, 5.0, 61.03, 38.2)], "id long, magnitude double, depth_km double, lon double, lat double")
    strong = intensity.surfaces(cells, events).select("event_id", "row", "col")
    wide = {tuple(r) for r in intensity.surfaces(cells, events, margin=0.11).select("event_id", "row", "col").collect()}
    for e, r, c in strong.collect():
        assert all((e, s, d) in wide for s in range(max(0, r - 1), min(60, r + 2)) for d in range(max(0, c - 1), min(60, c + 2)))


def test_rings_of_one_strip_are_those_of_pieces():
    """Parts by what links crossings on rows of centres, and by all sides: on any ground, cut by the raster's edge or not, with saddles, levels met exactly and holes."""
    rng, holes = np.random.default_rng(7), 0
    for k in range(300):
        h, w = (int(n) for n in rng.integers(2, 14, 2))
        ground = rng.uniform(1, 6, (h, w)) if k % 2 else rng.integers(1, 5, (h, w)) + 0.5 * rng.integers(0, 2, (h, w))
        grid, levels = (44.0, 56.0, 0.1, 0.1, w, h), (2, 3, 4, 5)
        if k % 3 == 0:
            ground = np.pad(ground, 1, constant_values=-1.0)
            grid = (*grid[:4], w + 9, h + 9)
        at = 2 if k % 3 == 0 else 0
        of = {}
        for event, lower, part, kind, _, _, area, x, y, _ in contours.pieces_of(1, 0, ground, at, at, grid, levels, 1000):
            assert kind == "ring"
            of.setdefault((0, lower, part), []).append((round(area, 9), len(x), round(x.min(), 9), round(y.max(), 9)))
        for lower, part, area, x, y in contours.rings_of(ground, at, at, grid, levels):
            of.setdefault((1, lower, part), []).append((round(area, 9), len(x), round(x.min(), 9), round(y.max(), 9)))
        old, new = (sorted((key[1], sorted(rings)) for key, rings in of.items() if key[0] == n) for n in (0, 1))
        assert old == new
        holes += sum(area < 0 for _, rings in new for area, *_ in rings)
    assert holes > 300
