"""Which polygons of two tables touch: edges that meet in a tile, or one polygon inside the other; and the impact of bands by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a tile in degrees.
TILE = 0.5

EDGE = ["x1", "y1", "x2", "y2"]


def ring_edges(rings: DataFrame, *key: str) -> DataFrame:
    """(*key, ring, seq, x1, y1, x2, y2): the edges of rings (*key, x, y: corners in order, arrays); ring tells the rings of a key apart."""
    ring = F.xxhash64("x", "y").alias("ring")
    point = rings.select(*key, ring, F.posexplode(F.arrays_zip("x", "y", F.concat(F.slice("x", 2, 1 << 30), F.slice("x", 1, 1)).alias("u"), F.concat(F.slice("y", 2, 1 << 30), F.slice("y", 1, 1)).alias("v"))).alias("seq", "p"))
    return point.select(*key, "ring", "seq", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("p.u").alias("x2"), F.col("p.v").alias("y2"))


def _in_tiles(edges: DataFrame, tile: float) -> DataFrame:
    """``edges`` once for each tile (tx, ty) that they touch. A long edge is cut by the rows of tiles that it spans."""
    row = lambda y: F.floor(y / tile)
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    # a border belongs to the tiles on both sides, so that what touches there meets
    first = F.when(lo == row(lo) * tile, row(lo) - 1).otherwise(row(lo))
    e = edges.withColumn("ty", F.explode(F.sequence(first, row(hi))))
    at = lambda y: F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    flat = F.col("y1") == F.col("y2")
    a = F.when(flat, F.col("x1")).otherwise(at(F.greatest(lo, F.least(hi, F.col("ty") * tile))))
    b = F.when(flat, F.col("x2")).otherwise(at(F.greatest(lo, F.least(hi, (F.col("ty") + 1) * tile))))
    # the cut is rounded; a little more on both sides costs at most a tile
    west, east = F.least(a, b) - 1e-9, F.greatest(a, b) + 1e-9
    return e.withColumn("tx", F.explode(F.sequence(F.floor(west / tile), F.floor(east / tile))))


def _turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """1 if r lies left of the line from p to q, -1 if right, 0 if on it."""
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def _meet(a: list[Column], b: list[Column]) -> Column:
    """If two edges have a point in common, ends included."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    overlap = lambda p, q, r, s: (F.least(p, q) <= F.greatest(r, s)) & (F.least(r, s) <= F.greatest(p, q))
    apart_a = _turn(ax, ay, bx, by, cx, cy) * _turn(ax, ay, bx, by, dx, dy) > 0
    apart_b = _turn(cx, cy, dx, dy, ax, ay) * _turn(cx, cy, dx, dy, bx, by) > 0
    return overlap(ax, bx, cx, dx) & overlap(ay, by, cy, dy) & ~apart_a & ~apart_b


def _inside(points: DataFrame, edges: DataFrame, point: list[str], polygon: list[str], tile: float) -> DataFrame:
    """(*point, *polygon): points (*point, px, py) inside polygons (*polygon and ``EDGE``).

    A point meets polygons whose bounds hold it, by the tiles of the bounds; then only the edges of these that span its
    height, by bands of latitude: an odd number of crossings east of it means inside.
    """
    lo, hi = [F.min(F.least(f"{c}1", f"{c}2")).alias(f"{c}_lo") for c in "xy"], [F.max(F.greatest(f"{c}1", f"{c}2")).alias(f"{c}_hi") for c in "xy"]
    bounds = edges.groupBy(*polygon).agg(*lo, *hi)
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}_lo") / tile), F.floor(F.col(f"{c}_hi") / tile)))
    bounds = bounds.withColumn("tx", span("x")).withColumn("ty", span("y"))
    p = points.withColumns({"tx": F.floor(F.col("px") / tile), "ty": F.floor(F.col("py") / tile)})
    near = p.join(bounds.hint("merge"), ["tx", "ty"]).filter(F.col("px").between(F.col("x_lo"), F.col("x_hi")) & F.col("py").between(F.col("y_lo"), F.col("y_hi")))
    near = near.select(*point, *polygon, "px", "py", "ty")
    tall = edges.filter("y1 <> y2").select(*polygon, *EDGE, F.explode(F.sequence(F.floor(F.least("y1", "y2") / tile), F.floor(F.greatest("y1", "y2") / tile))).alias("ty"))
    hit = near.join(tall.hint("merge"), [*polygon, "ty"]).filter(((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))))
    x = F.col("x1") + (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    return hit.filter(x > F.col("px")).groupBy(*point, *polygon).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(*point, *polygon)


def touching(a: DataFrame, b: DataFrame, a_key: list[str], b_key: list[str], tile: float = TILE) -> DataFrame:
    """(*a_key, *b_key): pairs of polygons of two tables that have a point in common, borders included; each pair once.

    Polygons are edges: their key, ring, seq and ``EDGE``; holes are rings too. Edges meet by tiles and are tested there; of
    the edges of a pair that meet, each task keeps the pair once before it is shuffled. Polygons whose edges don't meet touch
    only if one holds the other, so one corner of each ring is tested. No side is broadcast: tiles multiply its rows.
    """
    left = _in_tiles(a.select(*a_key, *EDGE), tile)
    right = _in_tiles(b.select(*b_key, *EDGE), tile).withColumnsRenamed({c: f"o{c}" for c in EDGE})
    met = left.hint("merge").join(right, ["tx", "ty"])
    crossing = met.filter(_meet([F.col(c) for c in EDGE], [F.col(f"o{c}") for c in EDGE])).select(*a_key, *b_key).distinct()
    corner = lambda e, key: e.groupBy(*key, "ring").agg(F.min_by(F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")), "seq").alias("p")).select(*key, F.col("ring").alias("of"), "p.px", "p.py")
    held = _inside(corner(a, a_key), b, [*a_key, "of"], b_key, tile).select(*a_key, *b_key).unionByName(_inside(corner(b, b_key), a, [*b_key, "of"], a_key, tile).select(*a_key, *b_key))
    return crossing.unionByName(held.select(*a_key, *b_key)).distinct()


def worst_band(rings: DataFrame, unit_edges: DataFrame, tile: float = TILE) -> DataFrame:
    """(event_id, unit_id, mmi_max): the highest band of each event whose polygons touch a unit.

    ``rings`` are those of ``contours.band_rings``, ``unit_edges`` (unit_id, part, ring, seq and ``EDGE``).
    """
    polygon = ["event_id", "mmi_lower", "part"]
    units = unit_edges.select("unit_id", F.struct("part", "ring").alias("ring"), "seq", *EDGE)
    pairs = touching(ring_edges(rings, *polygon), units, polygon, ["unit_id"], tile)
    return pairs.groupBy("event_id", "unit_id").agg(F.max("mmi_lower").alias("mmi_max"))
