"""Shaking over a raster for one or many events, bands of it, regions and isolines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_VS30, MMI_BAND_LEVELS, NODATA
from ..functions import motion as M
from .contours import region_runs

#: Side of a tile in degrees, by which events and cells meet.
TILE = 1.0


def load_cells(raw: DataFrame, x0: float, y0: float, dx: float, dy: float, default_vs30: float = DEFAULT_VS30) -> DataFrame:
    """(row, col, lon, lat, vs30): cell centres; no data, zero or less becomes the default."""
    bad = F.col("raw").isNull() | (F.col("raw") == NODATA) | (F.col("raw") <= 0)
    return raw.select("row", "col", (F.lit(x0) + (F.col("col") + 0.5) * dx).alias("lon"), (F.lit(y0) - (F.col("row") + 0.5) * dy).alias("lat"), F.when(bad, default_vs30).otherwise(F.col("raw")).alias("vs30"))


#: Distances at which the bound of ``reach_km`` is taken, in km.
_STEPS = [1.15**n for n in range(56)]


def reach_km(mag: Column, depth_km: Column, vs30_min: float) -> Column:
    """Kilometres from the epicentre beyond which no site of at least ``vs30_min`` reaches intensity 2; null if none does.

    The hypocentral distance r of intensity 2 solves log10 r + 0.0027 r = c. For any k, r is below k, or log10 r is at
    least log10 k and so r at most (c - log10 k) / 0.0027. The least of these bounds is some 10 % above r. A deeper
    event than that shakes nothing.
    """
    c = (mag - 6) * 0.23 + (0.49 + math.log10(1.385 * 980) + 1.35 - 0.47 * math.log10(vs30_min) - 1 / 2.2)
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.log10(k)).alias("log")) for k in _STEPS])
    r = F.array_min(F.transform(steps, lambda s: F.greatest(s["k"], (c - s["log"]) / 0.0027)))
    return F.when(r >= depth_km, F.sqrt(r * r - depth_km * depth_km))


def _surface(pairs: DataFrame) -> DataFrame:
    """Adds pga and mmi. The acceleration is unfolded from an array: Spark would else copy its formula, which is most of the
    work, to each place in the intensity's and into any filter on it."""
    dist = M.haversine_m(F.col("epi_lon"), F.col("epi_lat"), F.col("lon"), F.col("lat"))
    pga = M.pga_gal(dist, F.col("depth_km") * 1000, F.col("magnitude"), F.col("vs30"))
    return pairs.select("event_id", "row", "col", "lon", "lat", F.explode(F.array(pga)).alias("pga")).withColumn("mmi", M.pga_to_mmi(F.col("pga")))


def _events(events: DataFrame) -> DataFrame:
    return events.select(F.col("id").alias("event_id"), "magnitude", "depth_km", F.col("lon").alias("epi_lon"), F.col("lat").alias("epi_lat"))


def surface_all(cells: DataFrame, event_id: int, magnitude: float, depth_km: float, lon: float, lat: float) -> DataFrame:
    """Every cell for one event, given by its numbers."""
    event = {"event_id": event_id, "magnitude": magnitude, "depth_km": depth_km, "epi_lon": lon, "epi_lat": lat}
    return _surface(cells.withColumns({name: F.lit(v) for name, v in event.items()}))


def within_reach(events: DataFrame, vs30_min: float = 180.0, margin: float = 0.0) -> DataFrame:
    """Events that shake any site, with the half-sides dlon and dlat of the box of degrees, wider by ``margin``, that holds what they reach."""
    e = events if "event_id" in events.columns else _events(events)
    e = e.withColumn("km", reach_km(F.col("magnitude"), F.col("depth_km"), vs30_min)).filter("km IS NOT NULL")
    dlat = F.col("km") / 110.5
    dlon = F.col("km") / (F.greatest(F.cos(F.radians(F.least(F.abs(F.col("epi_lat")) + dlat, F.lit(89.0)))), F.lit(0.02)) * 110.5)
    return e.withColumns({"dlat": F.least(dlat + margin, F.lit(90.0)), "dlon": F.least(dlon + margin, F.lit(180.0))})


def surfaces(cells: DataFrame, events: DataFrame, vs30_min: float = 180.0, margin: float | None = None) -> DataFrame:
    """The cells of intensity 2 or more for each event; with ``margin`` also lower ones, all that lie within so many degrees
    of such a cell at least. Events and cells meet by tile: an event stands in the tiles
    that its reach touches, so neither side is multiplied by the other; the exact test comes last. An event's box of
    degrees is tested before the distance. Spark doesn't see how many rows tiles make of an event, so the join isn't left to its estimate."""
    e = within_reach(events, vs30_min, margin or 0.0)
    span = lambda v, d: F.sequence(F.floor((v - d) / TILE), F.floor((v + d) / TILE))
    e = e.withColumn("tx", F.explode(span(F.col("epi_lon"), F.col("dlon")))).withColumn("ty", F.explode(span(F.col("epi_lat"), F.col("dlat"))))
    c = cells.withColumns({"tx": F.floor(F.col("lon") / TILE), "ty": F.floor(F.col("lat") / TILE)})
    near = c.hint("merge").join(e, ["tx", "ty"]).filter((F.abs(F.col("lon") - F.col("epi_lon")) <= F.col("dlon")) & (F.abs(F.col("lat") - F.col("epi_lat")) <= F.col("dlat")))
    return _surface(near).filter("mmi >= 2") if margin is None else _surface(near)


def intensity_at(pairs: DataFrame) -> DataFrame:
    """Adds mmi to rows that hold a site (lon, lat, vs30) and an event (epi_lon, epi_lat, depth_km, magnitude)."""
    dist = M.haversine_m(F.col("epi_lon"), F.col("epi_lat"), F.col("lon"), F.col("lat"))
    return pairs.withColumn("mmi", M.pga_to_mmi(M.pga_gal(dist, F.col("depth_km") * 1000, F.col("magnitude"), F.col("vs30"))))


def banded(surface: DataFrame) -> DataFrame:
    """Adds mmi_lower, mmi_upper, color, label; cells in no band go. A level not below its event's maximum is skipped."""
    top = F.max("mmi").over(Window.partitionBy("event_id"))  # a join would make the surface twice
    b = surface.withColumn("top", top).withColumn("mmi_lower", M.band_of(F.col("mmi"), F.col("top"))).filter("mmi_lower IS NOT NULL").drop("top")
    low = F.col("mmi_lower")
    return b.withColumns({"mmi_upper": M.band_upper(low), "color": M.band_color(low), "label": M.mmi_class_label(low)})


def levels_present(bands: DataFrame) -> DataFrame:
    """(event_id, mmi_lower, color, label): the levels that an event's bands have, with what a legend shows."""
    return bands.select("event_id", "mmi_lower", "color", "label").distinct()


def export_bands(bands: DataFrame, levels: tuple[int, ...] | None = None) -> DataFrame:
    """(event_id, mmi_low, mmi_high, color, row, col0, col1, w, e, y): bands to export, of the given levels or all, one row
    for each run of a band's cells in a raster row: from the centre of its first cell (w, y) to that of its last (e, y)."""
    chosen = bands.filter(F.col("mmi_lower").isin(*levels)) if levels is not None else bands
    key = ["event_id", "mmi_lower", "mmi_upper", "color", "row"]
    w = Window.partitionBy(*key).orderBy("col")
    g = chosen.withColumn("g", F.col("col") - F.row_number().over(w)).groupBy(*key, "g")
    boxes = g.agg(F.min("col").alias("col0"), F.max("col").alias("col1"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.first("lat").alias("y"))
    return boxes.select("event_id", F.col("mmi_lower").alias("mmi_low"), F.col("mmi_upper").alias("mmi_high"), "color", "row", "col0", "col1", "w", "e", "y")


def write_bands(bands: DataFrame, path: str, levels: tuple[int, ...] | None = None) -> None:
    """The bands to export as Parquet; nothing to export is an error."""
    out = export_bands(bands, levels)
    if out.isEmpty():
        raise ValueError("no band to export")
    out.write.mode("errorifexists").parquet(path)


def band_features(bands: DataFrame, half: float) -> DataFrame:
    """(event_id, mmi_lower, feature): a GeoJSON feature for each event and band, with the bounds and colour of the band as
    properties. Its geometry has a box for each run of the band's cells in a raster row; ``half`` is half a cell's side."""
    b = export_bands(bands)
    part = F.struct("row", "col0", F.array(box_ring(F.col("w"), F.col("e"), F.col("y"), half)).alias("polygon"))
    parts = b.groupBy("event_id", F.col("mmi_low").alias("mmi_lower")).agg(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["polygon"]).alias("polygons"))
    return feature_of_boxes(parts)


def box_ring(w: Column, e: Column, y: Column, half: float) -> Column:
    """The closed ring of a run of cells from centre (w, y) to centre (e, y)."""
    return F.array(*[F.array(a, b) for a, b in ((w - half, y - half), (e + half, y - half), (e + half, y + half), (w - half, y + half), (w - half, y - half))])


def feature_of_boxes(parts: DataFrame) -> DataFrame:
    """(event_id, mmi_lower, feature) from (event_id, mmi_lower, polygons)."""
    low = F.col("mmi_lower")
    props = F.struct("mmi_lower", M.band_upper(low).alias("mmi_upper"), M.band_color(low).alias("color"), M.mmi_class_label(low).alias("label"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates"))
    return parts.select("event_id", "mmi_lower", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def isolines(surface: DataFrame, levels: tuple[int, ...] = MMI_BAND_LEVELS) -> DataFrame:
    """(event_id, level, x1, y1, x2, y2): marching squares on quads of four cell centres, with linear interpolation.

    Each cell goes to the four quads that it is a corner of, so that one shuffle brings the corners together. Each level gives
    the crossings of the quad's sides in order; two crossings are one segment, four are two (a saddle, split by the mean of
    the corners).
    """
    corner = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col")) for name, dr, dc in (("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 0))]))
    each = surface.select("event_id", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("mmi").alias("m")).alias("p"), corner.alias("q"))
    q = each.groupBy("event_id", F.col("q.row").alias("row"), F.col("q.col").alias("col")).agg(*[F.max(F.when(F.col("q.name") == name, F.col("p"))).alias(name) for name in "abcd"])
    q = q.filter("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")
    lo, hi = F.least("a.m", "b.m", "c.m", "d.m"), F.greatest("a.m", "b.m", "c.m", "d.m")
    q = q.withColumn("level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda v: (v > lo) & (v <= hi))))

    def side(p: str, r: str) -> str:
        cut = f"(level - {p}.m) / ({r}.m - {p}.m)"
        return f"if(({p}.m >= level) <> ({r}.m >= level), array(named_struct('x', {p}.x + ({r}.x - {p}.x) * {cut}, 'y', {p}.y + ({r}.y - {p}.y) * {cut})), array())"

    q = q.withColumn("cuts", F.expr("concat(" + ", ".join(f"CAST({side(p, r)} AS array<struct<x:double,y:double>>)" for p, r in ("ab", "bc", "cd", "da")) + ")"))
    pairs = """CASE WHEN size(cuts) = 2 THEN array(array(0, 1))
        WHEN size(cuts) = 4 AND ((a.m >= level) = ((a.m + b.m + c.m + d.m) / 4 >= level)) THEN array(array(0, 1), array(2, 3))
        WHEN size(cuts) = 4 THEN array(array(3, 0), array(1, 2)) ELSE array() END"""
    q = q.withColumn("p", F.explode(F.expr(pairs)))
    return q.selectExpr("event_id", "level", "cuts[p[0]].x AS x1", "cuts[p[0]].y AS y1", "cuts[p[1]].x AS x2", "cuts[p[1]].y AS y2")


def compare_pairs(surface: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first_id, second_id, row, col, delta) for many pairs of events (first_id, second_id), cells of either; absent counts as 0."""
    one = lambda i, sign: surface.join(pairs.withColumn("event_id", F.col(i)), "event_id").select("first_id", "second_id", "row", "col", (F.col("mmi") * sign).alias("m"))
    return one("first_id", -1.0).unionByName(one("second_id", 1.0)).groupBy("first_id", "second_id", "row", "col").agg(F.sum("m").alias("delta"))


def regions(bands: DataFrame) -> DataFrame:
    """Adds region_id to the cells of ``bands``, as ``region_runs`` finds them."""
    cells = region_runs(bands).select("event_id", "mmi_lower", "row", "region_id", F.explode(F.sequence("c0", "c1")).alias("col"))
    return bands.join(cells, ["event_id", "mmi_lower", "row", "col"])


def prune_regions(regions: DataFrame, dx: float, dy: float, min_area: float = 2.5e-4) -> DataFrame:
    """Without regions of less than ``min_area`` square degrees."""
    key = ["event_id", "mmi_lower", "region_id"]
    small = regions.groupBy(*key).agg((F.count("*") * dx * dy).alias("area")).filter(F.col("area") < min_area)
    return regions.join(small.select(*key), key, "left_anti")
