"""Earthquake tables derived from the given ``events``: a catalogue with echo reports, a site raster and admin units."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import micros

#: Site raster: cells of 0.1 degree from the north-west corner.
X0, Y0, STEP, WIDTH, HEIGHT = 44.0, 56.0, 0.1, 610, 480
#: Tiling of the region by level: columns and rows.
TILES = {"province": (6, 4), "district": (24, 16), "tehsil": (96, 64)}

LEVELS = tuple(TILES)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports before clustering: each event, and one or two echoes of every third and ninth one."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), "event_type", "value", micros(F.col("ts")).alias("us")
    )
    ev = ev.withColumn("k", F.explode(F.expr("CASE WHEN e % 9 = 0 THEN array(0, 1, 2) WHEN e % 3 = 0 THEN array(0, 1) ELSE array(0) END")))
    return ev.selectExpr(
        "CAST(e + 1 + k * 10000000 AS long) AS id",
        "CASE WHEN k = 1 THEN 'MET' WHEN k = 0 AND e % 10 = 9 THEN 'MANUAL' ELSE 'USGS' END AS source",
        "CASE WHEN NOT (k = 0 AND e % 10 = 9) THEN CAST(e + 1 + k * 10000000 AS string) END AS source_event_id",
        "us + k * ((e * 13) % 75) * 1000000 AS occurred_us",
        "CAST((20 + (e * 7919) % 60 + k) AS double) / 10 AS magnitude",
        "CAST((e * 104729) % 7000 AS double) / 10 AS depth_km",
        "CAST(4400 + ((u % 12) * 3701) % 6000 + e % 40 + k * ((e * 17) % 70) AS double) / 100 AS lon",
        "CAST(800 + ((u % 12) * 2903) % 4700 + (e div 40) % 40 AS double) / 100 AS lat",
        "CASE WHEN e % 13 <> 0 THEN concat('near ', event_type) END AS place",
        "CASE e % 4 WHEN 0 THEN 'mb' WHEN 1 THEN 'mww' WHEN 2 THEN 'ml' END AS mag_type",
        "CASE WHEN e % 101 = 0 THEN 'red' WHEN e % 101 <= 3 THEN 'orange' WHEN e % 101 <= 9 THEN 'yellow' WHEN e % 101 <= 40 THEN 'green' END AS alert",
        "CAST(CASE WHEN e % 97 = 0 THEN 1 ELSE 0 END AS int) AS tsunami",
        "CASE WHEN e % 7 <> 0 THEN CAST(floor(value) AS int) END AS sig",
        "us + k * ((e * 13) % 75) * 1000000 + 300000000 AS updated_us",
    )


def cells(spark: SparkSession, step: float = STEP) -> DataFrame:
    """Raw site raster (row, col, raw): one cell in 23 has no data. A smaller step makes a larger raster."""
    w, h = round(WIDTH * STEP / step), round(HEIGHT * STEP / step)
    return spark.range(w * h).selectExpr(f"CAST(id div {w} AS int) AS row", f"CAST(id % {w} AS int) AS col").withColumn(
        "raw", F.expr("CASE WHEN (row + col) % 23 = 0 THEN -9999.0D ELSE CAST(180 + (row * 31 + col * 17) % 900 AS double) END")
    )


def units(spark: SparkSession, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Envelopes that tile the region, by level: (unit_id, level, name, parent, minx, miny, maxx, maxy)."""
    out = None
    for n, (level, (nx, ny)) in enumerate(TILES.items()):
        if level in levels:
            up = {"district": 4, "tehsil": 4}.get(level)
            parent = f"concat('{ {'district': 'province', 'tehsil': 'district'}.get(level)}', ' ', (id % {nx}) div {up}, '-', (id div {nx}) div {up})" if up else "CAST(NULL AS string)"
            part = spark.range(nx * ny).selectExpr(
                f"{n * 100000} + id AS unit_id", f"'{level}' AS level", f"concat('{level} ', id % {nx}, '-', id div {nx}) AS name", f"{parent} AS parent",
                f"44 + (id % {nx}) * 61.0D / {nx} AS minx", f"8 + (id div {nx}) * 48.0D / {ny} AS miny", f"44 + (id % {nx} + 1) * 61.0D / {nx} AS maxx", f"8 + (id div {nx} + 1) * 48.0D / {ny} AS maxy",
            )
            out = part if out is None else out.unionByName(part)
    return out


def footprint_edges(reports: DataFrame) -> DataFrame:
    """An L-shaped polygon at each report, as edges: a box whose upper right is cut out above a quarter of its height."""
    w, h = F.col("id") % 7 * 0.1 + 0.13, F.col("id") % 5 * 0.1 + 0.17
    r = reports.select(F.col("id").alias("unit_id"), F.col("lon").alias("l"), F.col("lat").alias("b"), (F.col("lon") + w).alias("r"), (F.col("lat") + h).alias("t"), (F.col("lon") + w / 2).alias("m"), (F.col("lat") + h / 4).alias("q"))
    path = ("lb", "rb", "rq", "mq", "mt", "lt")
    sides = F.array(*[F.struct(F.lit(i).alias("seq"), F.col(p[0]).alias("x1"), F.col(p[1]).alias("y1"), F.col(n[0]).alias("x2"), F.col(n[1]).alias("y2")) for i, (p, n) in enumerate(zip(path, path[1:] + path[:1], strict=True))])
    return r.select("unit_id", F.lit(0).alias("part"), F.lit(0).alias("ring"), F.inline(sides))


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a folder that all executors share, below ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(known or tempfile.mkdtemp(prefix='tremolite-')).rstrip('/')}/tremolite-{label}-{uuid.uuid4().hex}"
