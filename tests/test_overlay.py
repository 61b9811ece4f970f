"""Polygons that touch, against all pairs."""

import random

import pytest

from tremolite.operators import contours, overlay
from tremolite.plans import fixtures, queries

EDGES = "id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def ell(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h / 4), (x + w / 2, y + h / 4), (x + w / 2, y + h), (x, y + h)]


def edges_of(polygons):
    return [(n, 0, k, i, *map(float, (*r[i], *r[(i + 1) % len(r)]))) for n, rings in polygons.items() for k, r in enumerate(rings) for i in range(len(r))]


def turn(p, q, r):
    d = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (d > 0) - (d < 0)


def meet(a, b, c, d):
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return False
    return turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0


def inside(p, rings):
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True):
            if (y1 > p[1]) != (y2 > p[1]) and x1 + (p[1] - y1) / (y2 - y1) * (x2 - x1) > p[0]:
                odd = not odd
    return odd


def touch(a, b):
    sides = lambda rings: [e for r in rings for e in zip(r, r[1:] + r[:1], strict=True)]
    return any(meet(*p, *q) for p in sides(a) for q in sides(b)) or any(inside(r[0], b) for r in a) or any(inside(r[0], a) for r in b)


NAMED = {
    1: [box(0, 0, 4, 4), box(1, 1, 2, 2)[::-1]],  # with a hole
    2: [box(1.5, 1.5, 1, 1)],  # in the hole
    3: [box(0.2, 0.2, 0.3, 0.3)],  # in the polygon
    4: [box(4, 0, 1, 1)],  # shares a border
    5: [box(5, 1, 1, 1)],  # shares a corner with 4
    6: [ell(6.5, 0, 2, 4)],
    7: [box(7.75, 2, 0.5, 0.5)],  # in the bounds of 6, but outside
    8: [box(6.6, 3.9, 0.1, 0.1)],  # touches the upper border of 6 from inside
    9: [[(-3.0, -3.0), (9.0, 5.0), (9.0, 5.5), (-3.0, -2.5)]],  # long and slanted
    10: [box(-20, -20, 60, 60)],  # holds all
    11: [box(1, 1, 2, 2)],  # fills the hole: touches its border
}


@pytest.mark.parametrize("tile", [0.3, 1.0, 50.0])
def test_named_shapes(spark, tile):
    e = spark.createDataFrame(edges_of(NAMED), EDGES)
    got = {tuple(r) for r in overlay.touching(e.withColumnRenamed("id", "a"), e.withColumnRenamed("id", "b"), ["a"], ["b"], tile).collect()}
    want = {(a, b) for a in NAMED for b in NAMED if touch(NAMED[a], NAMED[b])}
    assert got == want
    assert (1, 2) not in got and (1, 3) in got and (1, 4) in got and (4, 5) in got and (6, 7) not in got and (6, 8) in got and (1, 11) in got and (2, 11) in got


def test_random_shapes(spark):
    rng = random.Random(5)
    shapes = {n: [rng.choice((box, ell))(round(rng.uniform(-5, 5), 1), round(rng.uniform(-5, 5), 1), rng.choice((0.1, 0.5, 2.0)), rng.choice((0.2, 0.5, 3.0)))] for n in range(150)}
    a = spark.createDataFrame(edges_of({n: s for n, s in shapes.items() if n % 2}), EDGES).withColumnRenamed("id", "a")
    b = spark.createDataFrame(edges_of({n: s for n, s in shapes.items() if n % 2 == 0}), EDGES).withColumnRenamed("id", "b")
    pairs = [tuple(r) for r in overlay.touching(a, b, ["a"], ["b"]).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(x, y) for x in shapes for y in shapes if x % 2 > y % 2 and touch(shapes[x], shapes[y])}
    assert overlay.touching(a.limit(0), b, ["a"], ["b"]).count() == 0


def test_worst_band_of_units_is_that_of_their_polygons(spark):
    """Bands of one event on units with an L, a hole and a unit smaller than a cell, by all pairs of polygons."""
    events = spark.createDataFrame([(1, 6.0, 10.0, 72.53, 34.02)], "id long, magnitude double, depth_km double, lon double, lat double")
    cells = queries.intensity.load_cells(fixtures.cells(spark), *queries.GRID[:4])
    rings = contours.band_rings(queries.intensity.surfaces(cells, events, margin=0.11), queries.GRID).cache()
    units = {1: [ell(72.0, 33.5, 1.0, 1.5)], 2: [box(71.0, 33.0, 3.0, 2.0), box(72.2, 33.8, 0.6, 0.5)[::-1]], 3: [box(72.531, 34.021, 0.002, 0.002)], 4: [box(60.0, 10.0, 1.0, 1.0)], 5: [box(75.0, 36.0, 0.5, 0.5)], 6: [box(50.0, 9.0, 45.0, 45.0)]}
    polygons = {}
    for r in rings.collect():
        polygons.setdefault((r.mmi_lower, r.part), []).append(list(zip(r.x, r.y, strict=True)))
    want = {u: max((k[0] for k, p in polygons.items() if touch(p, s)), default=None) for u, s in units.items()}
    edges = spark.createDataFrame(edges_of(units), EDGES).withColumnRenamed("id", "unit_id")
    got = {r.unit_id: r.mmi_max for r in overlay.worst_band(rings, edges).collect()}
    assert got == {u: m for u, m in want.items() if m is not None} and 3 in got and 4 not in got
