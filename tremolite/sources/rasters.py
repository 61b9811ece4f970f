"""Rasters as tables: cells from polygons, checks and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NODATA


def polygon_boxes(edges: DataFrame, value: DataFrame) -> DataFrame:
    """(seq, minx, miny, maxx, maxy, value): each polygon's box, for polygons as edges (unit_id, x1, y1, ...) and their
    values (unit_id, value); polygons without a value are left out. seq is the unit_id."""
    box = edges.groupBy("unit_id").agg(F.min("x1").alias("minx"), F.min("y1").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy"))
    return box.join(value.filter("value IS NOT NULL"), "unit_id").withColumnRenamed("unit_id", "seq")


def derive_grid(boxes: DataFrame) -> DataFrame:
    """One row (x0, y0, step, width, height): the raster that boxes of cells make up. The first polygon's lesser side is
    a cell's; the extent of all, in whole cells, is the raster's."""
    g = boxes.agg(F.min("minx").alias("x0"), F.max("maxy").alias("y0"), F.max("maxx").alias("x1"), F.min("miny").alias("y1"), F.min_by(F.least(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")), "seq").alias("step"))
    cells = lambda a, b: F.round((F.col(a) - F.col(b)) / F.col("step")).cast("int")
    return g.select("x0", "y0", F.when(F.col("step") > 0, F.col("step")).otherwise(F.raise_error(F.lit("the first cell has no area"))).alias("step"), cells("x1", "x0").alias("width"), cells("y0", "y1").alias("height"))


def rasterise(boxes: DataFrame, x0: float, y0: float, step: float, width: int, height: int) -> DataFrame:
    """(row, col, raw): each polygon's box (seq, minx, miny, maxx, maxy, value) burns the cell of its centre; the last one wins."""
    col, row = F.floor(((F.col("minx") + F.col("maxx")) / 2 - x0) / step), F.floor((F.lit(y0) - (F.col("miny") + F.col("maxy")) / 2) / step)
    hit = boxes.select(row.cast("int").alias("row"), col.cast("int").alias("col"), "seq", "value").filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    burnt = hit.groupBy("row", "col").agg(F.max_by("value", "seq").alias("value"))
    dense = boxes.sparkSession.range(width * height).selectExpr(f"CAST(id div {width} AS int) AS row", f"CAST(id % {width} AS int) AS col")
    return dense.join(burnt, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(NODATA)).alias("raw"))


def quality(cells: DataFrame, expected: int) -> DataFrame:
    """One row: n_valid, lo, hi and ok (0 < lo < hi < 5000 and at least 95 % of the expected cells)."""
    v = F.when(F.col("raw") != NODATA, F.col("raw"))
    q = cells.agg(F.count(v).alias("n_valid"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return q.withColumn("ok", F.coalesce((F.col("lo") > 0) & (F.col("lo") < F.col("hi")) & (F.col("hi") < 5000) & (F.col("n_valid") >= 0.95 * expected), F.lit(False)))


def overview(cells: DataFrame, factor: int) -> DataFrame:
    """(row, col, raw): the mean of the valid cells of each block; blocks without one are left out."""
    return cells.filter(F.col("raw") != NODATA).groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("raw").alias("raw"))


def overviews(cells: DataFrame, factors: tuple[int, ...] = (2, 4, 8, 16)) -> DataFrame:
    """(factor, row, col, raw): the overviews of all factors, by one scan and one shuffle. A cell counts in a block of each
    factor; tasks add up their cells' blocks before the shuffle."""
    blocks = F.array(*[F.struct(F.lit(f).alias("factor"), F.floor(F.col("row") / f).cast("int").alias("row"), F.floor(F.col("col") / f).cast("int").alias("col")) for f in factors])
    return cells.filter(F.col("raw") != NODATA).select("raw", F.inline(blocks)).groupBy("factor", "row", "col").agg(F.avg("raw").alias("raw"))


def cell_of(points: DataFrame, x0: float, y0: float, dx: float, dy: float, width: int, height: int) -> DataFrame:
    """Adds row and col of the cell that holds (lon, lat); points outside take the cell at the edge."""
    clip = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    return points.withColumns({"col": clip((F.col("lon") - x0) / dx, width), "row": clip((F.lit(y0) - F.col("lat")) / dy, height)})
