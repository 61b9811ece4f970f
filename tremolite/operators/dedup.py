"""Clustering of reports of one earthquake, and insert-if-absent."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CATALOG_COLUMNS, DEDUP_METRES, DEDUP_SECONDS, EARTH_RADIUS_M, SOURCE_PRIORITY
from ..functions.motion import haversine_m, lambert_m

#: Buckets are twice as wide as the window: what is near a report lies in two of them in each dimension, mostly.
BUCKET_US = 2 * DEDUP_SECONDS * 1_000_000
#: 50 km are less than 0.46 degrees of latitude anywhere. Longitude has a whole number of buckets around the earth.
NEAR_LAT, LON_BUCKETS = 0.46, 212
#: All in a cell are near each other: half a minute, and some 31 km from corner to corner at most.
CELL_US, CELL_DEG = DEDUP_SECONDS * 500_000, 0.2
#: What a report's cluster depends on, besides the others.
POINT = ["occurred_us", "lon", "lat"]


def priority(source: Column) -> Column:
    out = F.lit(3)
    for name, p in SOURCE_PRIORITY.items():
        out = F.when(source == name, p).otherwise(out)
    return out


def _in_buckets_near(boxes: DataFrame) -> DataFrame:
    """``boxes`` (t0, t1, lon0, lon1, lat0, lat1) once for each bucket (tb, yb, xb) that may hold what is near one, anywhere on earth."""
    width = 360 / LON_BUCKETS
    span = lambda lo, hi, d, w: F.explode(F.sequence(F.floor((F.col(lo) - d) / w), F.floor((F.col(hi) + d) / w)))
    far = F.greatest(F.abs("lat0"), F.abs("lat1"))
    half = F.lit(NEAR_LAT) / F.greatest(F.cos(F.radians(F.least(far + NEAR_LAT, F.lit(90.0)))), F.lit(NEAR_LAT / 180))
    west = F.floor((F.col("lon0") - half) / width)
    east = F.least(F.floor((F.col("lon1") + half) / width), west + (LON_BUCKETS - 1))  # once around at most
    near = boxes.withColumn("tb", span("t0", "t1", F.lit(DEDUP_SECONDS * 1_000_000), BUCKET_US)).withColumn("yb", span("lat0", "lat1", F.lit(NEAR_LAT), 2 * NEAR_LAT))
    return near.withColumn("xb", F.explode(F.sequence(west, east))).withColumn("xb", F.pmod("xb", F.lit(LON_BUCKETS)))


def _own_bucket() -> list[Column]:
    return [F.floor(F.col("occurred_us") / BUCKET_US).alias("tb"), F.floor(F.col("lat") / (2 * NEAR_LAT)).alias("yb"), F.pmod(F.floor(F.col("lon") / (360 / LON_BUCKETS)), F.lit(LON_BUCKETS)).alias("xb")]


def _feed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("source") != "MANUAL").select("id", "occurred_us", "lon", "lat")


def once(df: DataFrame) -> DataFrame:
    """``df``, computed once where the session has a checkpoint folder; else computed wherever it is read."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def near_pairs(reports: DataFrame, few: DataFrame, geodesic: str = "haversine") -> DataFrame:
    """(id, other_id): reports of feeds (id) within 60 s and 50 km of those of ``few`` (other_id), both inclusive.

    An equi-join on buckets of time, latitude and longitude: ``reports`` stand in their own bucket, ``few`` in all that
    may hold what is near them (about eight), so every pair meets exactly once; time and distance then decide.
    Neither side is ever broadcast: Spark's estimate doesn't see that buckets multiply the rows.
    """
    a = _feed(reports).select(*[F.col(c).alias(f"a_{c}") for c in ("id", "occurred_us", "lon", "lat")], *_own_bucket())
    point = {"t0": "occurred_us", "t1": "occurred_us", "lon0": "lon", "lon1": "lon", "lat0": "lat", "lat1": "lat"}
    b = _in_buckets_near(_feed(few).withColumns({k: F.col(v) for k, v in point.items()})).drop(*point)
    dist = (lambert_m if geodesic == "lambert" else haversine_m)(F.col("a_lon"), F.col("a_lat"), F.col("lon"), F.col("lat"))
    pairs = a.join(b.hint("merge"), ["tb", "yb", "xb"]).filter((F.abs(F.col("a_occurred_us") - F.col("occurred_us")) <= DEDUP_SECONDS * 1_000_000) & (dist <= DEDUP_METRES))
    return pairs.select(F.col("a_id").alias("id"), F.col("id").alias("other_id"))


def neighbour_pairs(reports: DataFrame, geodesic: str = "haversine") -> DataFrame:
    """(id, other_id): reports of feeds within 60 s and 50 km of each other, both inclusive, each with itself too."""
    return near_pairs(reports, reports, geodesic)


def _beside(reports: DataFrame, few: DataFrame) -> DataFrame:
    """(id, source, occurred_us, lon, lat) of the feed reports in buckets that may hold what is near ``few``, so some more than
    what is near. A bucket of ``few`` counts by its bounds, however many lie there, and nothing is paired."""
    bounds = [f(c).alias(f"{name}{n}") for c, name in (("occurred_us", "t"), ("lon", "lon"), ("lat", "lat")) for n, f in enumerate((F.min, F.max))]
    own, key = _own_bucket(), ["tb", "yb", "xb"]
    boxes = _feed(few).groupBy(*own).agg(*bounds).drop(*key)
    feed = reports.filter(F.col("source") != "MANUAL").select("id", "source", *POINT, *own)
    return feed.join(_in_buckets_near(boxes).select(*key).distinct().hint("merge"), key, "left_semi").drop(*key)


def cluster_ids(reports: DataFrame, geodesic: str = "haversine") -> DataFrame:
    """(id, cluster_id) of feed reports: the least id near a report. Clusters aren't transitive.

    Reports of one cell (30 s, 0.2 degrees) are all near each other, so a cell stands for its reports by its least id and
    its bounds. A report meets the cells near it: those wholly near it count by their least id, and only of those that lie
    partly near, and whose least id is below what the report has found, are the reports with lower ids tested. So reports of
    one place and minute, however many, are never paired. Reports of the very same instant and place have the same cluster,
    so the one of least id stands for them all.
    """
    every = _feed(reports)
    return every.join(_clusters_at(every, geodesic).hint("merge"), POINT).select("id", "cluster_id")


def _clusters_at(feed: DataFrame, geodesic: str) -> DataFrame:
    """(occurred_us, lon, lat, cluster_id) of each instant and place of ``feed``."""
    return _point_clusters(once(feed.dropna(subset=POINT).groupBy(*POINT).agg(F.min("id").alias("id"))), geodesic)


def _unit(lon: Column, lat: Column) -> list[Column]:
    """The place on the unit sphere. Distances between such are compared without angles."""
    x, y = F.radians(lon), F.radians(lat)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def _apart2(a: list[Column], b: list[Column]) -> Column:
    x, y, z = (p - q for p, q in zip(a, b, strict=True))
    return x * x + y * y + z * z


def _bucket(tb: Column, yb: Column, xb: Column) -> Column:
    """One key for a bucket, by which rows sort faster than by three."""
    return F.shiftleft(tb, 16).bitwiseOR(F.shiftleft((yb + 128).bitwiseAND(F.lit(255)), 8)).bitwiseOR(xb)


def _cell(us: Column, lon: Column, lat: Column) -> Column:
    part = lambda c, bits: F.floor(c / CELL_DEG).bitwiseAND(F.lit(2**bits - 1))
    return F.shiftleft(F.floor(us / CELL_US), 23).bitwiseOR(F.shiftleft(part(lat, 11), 12)).bitwiseOR(part(lon, 12))


def _point_clusters(feed: DataFrame, geodesic: str) -> DataFrame:
    """(occurred_us, lon, lat, cluster_id) of points (id, occurred_us, lon, lat), none of them twice.

    Points stay in the task of their bucket for both passes over its cells: the first finds the least id of the cells wholly
    near, the second the cells partly near that may hold a lower one. Cells are circles there, around the middle of their
    bounds, so that a pair costs no angles; the distance itself is asked for only at the edge, and of single points.
    """
    bounds = [f(c).alias(f"{name}{n}") for c, name in (("occurred_us", "t"), ("lon", "lon"), ("lat", "lat")) for n, f in enumerate((F.min, F.max))]
    t, lon, lat = (F.col(c) for c in POINT)
    at, mid = [F.col(f"a{k}") for k in "xyz"], [F.col(f"c{k}") for k in "xyz"]
    cells = feed.groupBy(_cell(t, lon, lat)).agg(F.min("id").alias("least"), F.count("*").alias("n"), *bounds)
    centre = _unit((F.col("lon0") + F.col("lon1")) / 2, (F.col("lat0") + F.col("lat1")) / 2)
    cells = _in_buckets_near(cells.withColumns({f"c{k}": c for k, c in zip("xyz", centre, strict=True)}).withColumn("r", F.sqrt(F.greatest(*[_apart2(_unit(F.col("lon1"), F.col(y)), mid) for y in ("lat0", "lat1")])) * 1.01))
    cells = cells.select(_bucket(F.col("tb"), F.col("yb"), F.col("xb")).alias("bucket"), "least", (F.col("n") > 1).alias("many"), "t0", "t1", *mid, "r", "lon0", "lat0")
    points = feed.select("id", *POINT, *[c.alias(f"a{k}") for k, c in zip("xyz", _unit(lon, lat), strict=True)], _bucket(*_own_bucket()).alias("bucket"))

    window, reach = DEDUP_SECONDS * 1_000_000, 2 * math.sin(DEDUP_METRES / EARTH_RADIUS_M / 2)
    sure, far = reach * 0.98, reach * 1.02  # the spheroid's distances differ by less
    most_t, least_t = F.greatest(F.abs(t - F.col("t0")), F.abs(t - F.col("t1"))), F.greatest(F.col("t0") - t, t - F.col("t1"))
    metres = lambert_m if geodesic == "lambert" else haversine_m
    off = _apart2(at, mid)
    single = ~F.col("many") & (off <= far * far) & (metres(lon, lat, F.col("lon0"), F.col("lat0")) <= DEDUP_METRES)
    whole = (F.col("least") <= F.col("id")) & (most_t <= window) & ((off <= F.pow(sure - F.col("r"), F.lit(2.0))) | single)
    met = points.join(cells.hint("merge"), "bucket").filter(whole)
    found = met.groupBy("bucket", "id", *POINT, *at).agg(F.min("least").alias("best"))
    partly = (F.col("least") < F.col("best")) & F.col("many") & (least_t <= window) & (off <= F.pow(F.col("r") + far, F.lit(2.0)))
    p, c = found.alias("p"), cells.alias("c")
    found = once(p.join(c.hint("merge"), (F.col("p.bucket") == F.col("c.bucket")) & partly, "left").select(*POINT, "best", _cell(F.col("t0"), F.col("lon0"), F.col("lat0")).alias("cell")))
    rest = found.filter("cell IS NOT NULL").select(F.col("occurred_us").alias("a_us"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), "best", "cell")
    tested = rest.hint("merge").join(feed.withColumn("cell", _cell(t, lon, lat)), "cell").filter((F.col("id") < F.col("best")) & (F.abs(F.col("a_us") - t) <= window) & (metres(F.col("a_lon"), F.col("a_lat"), lon, lat) <= DEDUP_METRES))
    place = {"a_us": "occurred_us", "a_lon": "lon", "a_lat": "lat"}
    every = found.select(*POINT, "best").unionByName(tested.select(*[F.col(a).alias(b) for a, b in place.items()], F.col("id").alias("best")))
    return every.groupBy(*POINT).agg(F.min("best").alias("cluster_id"))


def mark_canonical(clustered: DataFrame) -> DataFrame:
    """Adds is_canonical: of each cluster the report of the best source, then of the least id. Manual reports always are."""
    rank = F.row_number().over(Window.partitionBy("cluster_id", F.col("source") == "MANUAL").orderBy(priority(F.col("source")), "id"))
    return clustered.withColumn("is_canonical", (F.col("source") == "MANUAL") | (rank == 1))


def cluster(reports: DataFrame, geodesic: str = "haversine") -> DataFrame:
    """``reports`` with cluster_id and is_canonical; a manual report is a cluster of its own."""
    rows = reports.drop("cluster_id", "is_canonical")
    found = _clusters_at(_feed(rows), geodesic).withColumnRenamed("cluster_id", "__least").hint("merge")  # as many as reports, which Spark's estimate doesn't see
    least = F.when(F.col("source") != "MANUAL", F.col("__least"))
    return mark_canonical(rows.join(found, POINT, "left").select(*rows.columns, F.coalesce(least, "id").alias("cluster_id")))


def recluster(reports: DataFrame, touched: DataFrame, geodesic: str = "haversine") -> DataFrame:
    """``reports`` as ``cluster`` would leave them, if only what lies near ``touched`` has changed since it was clustered.

    ``touched`` (id, source, occurred_us, lon, lat): reports that are new, and the old and new places of changed or
    deleted ones, with their old cluster_id. Only reports in buckets beside them get new clusters, from those in buckets
    beside these, and only the clusters that those leave or enter, or that ``touched`` names, are ranked anew. Reports are
    never paired, so copies of one place and minute cost no more than others. The session needs a checkpoint folder.
    """
    near = _beside(reports, touched)
    of_near = cluster_ids(_beside(reports, near), geodesic).join(near.select("id").hint("merge"), "id", "left_semi").select("id", F.col("cluster_id").alias("new_cluster")).checkpoint()
    moved = reports.join(of_near, "id", "left").withColumn("old_cluster", F.col("cluster_id")).withColumn("cluster_id", F.coalesce("new_cluster", "cluster_id", "id"))
    stirred = moved.filter("new_cluster IS NOT NULL").select(F.explode(F.array("old_cluster", "new_cluster")).alias("cluster_id"))
    if "cluster_id" in touched.columns:
        stirred = stirred.unionByName(touched.select("cluster_id"))
    stirred = stirred.filter("cluster_id IS NOT NULL").distinct()
    moved = moved.select(*reports.columns)
    ranked = mark_canonical(moved.join(stirred, "cluster_id", "left_semi").select(*[c for c in reports.columns if c != "is_canonical"]))
    return moved.join(stirred, "cluster_id", "left_anti").select(*reports.columns).unionByName(ranked)


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each non-null key, the first in ``order``; rows without a key all stay."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rank", F.when(F.col(key).isNull(), 1).otherwise(rank)).filter("__rank = 1").drop("__rank")


def insert_if_absent(catalog: DataFrame, arrivals: DataFrame, order: list[str]) -> DataFrame:
    """Of ``arrivals`` those whose (source, source_event_id) is new; the first arrival wins; no id always counts as new."""
    key = F.when(F.col("source_event_id").isNotNull(), F.concat_ws("\x1f", "source", "source_event_id"))
    known = catalog.filter("source_event_id IS NOT NULL").select("source", "source_event_id").distinct()
    new = first_seen(arrivals.withColumn("__key", key), "__key", order).drop("__key")
    return new.join(known, ["source", "source_event_id"], "left_anti").select(*arrivals.columns)


def assign_ids(new: DataFrame, top: Column) -> DataFrame:
    """``new`` with ids from ``top`` + 1 on, in order of source priority, time and source_event_id.

    Rows are numbered within their minute, minutes within their day, days one after the other: no window holds more than
    the rows of a minute, the minutes of a day, or the days.
    """
    key = ["__p", "__day", "__minute"]
    rows = new.withColumns({"__p": priority(F.col("source")), "__day": F.floor(F.col("occurred_us") / 86_400_000_000), "__minute": F.floor(F.col("occurred_us") / 60_000_000)})
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    minutes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    days = minutes.groupBy("__p", "__day").agg(F.sum("n").alias("n")).select("__p", "__day", before(Window.orderBy("__p", "__day"), "n").alias("__d"))
    minutes = minutes.select(*key, before(Window.partitionBy("__p", "__day").orderBy("__minute"), "n").alias("__m")).join(days, ["__p", "__day"])
    place = F.row_number().over(Window.partitionBy(*key).orderBy("occurred_us", "source", "source_event_id", "magnitude", "lon", "lat"))
    numbered = rows.withColumn("__r", place).join(minutes, key)
    return numbered.withColumn("id", (top + F.col("__d") + F.col("__m") + F.col("__r")).cast("long")).select("id", *[c for c in new.columns if c != "id"])


def inserted(fresh: DataFrame, now_us: int, top: int) -> DataFrame:
    """``fresh`` reports as rows of a catalogue whose largest id is ``top``; checkpointed, as ids have to stay."""
    return conform(assign_ids(fresh.withColumn("created_us", F.lit(now_us)).drop("id"), F.lit(top))).checkpoint()


def add_reports(catalog: DataFrame, arrivals: DataFrame, now_us: int, known: DataFrame | None = None, top: int | None = None, geodesic: str = "haversine") -> tuple[DataFrame, DataFrame]:
    """(catalogue, inserted): ``catalog`` with the arrivals that it lacks, clustered; and those alone, as they were inserted.

    Arrivals are rows of one or several feeds without ids, as the feeds' parsers make them. Ids follow ``top``, or the
    largest one. Clusters change near any arrival, new or known (``known``: what arrived before repeats were taken off), so
    that a run again after a failure ends in the same state. The session needs a checkpoint folder.
    """
    new = insert_if_absent(catalog, conform(arrivals), ["occurred_us", "magnitude", "lon", "lat"])
    if top is None:
        top = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    new = inserted(new, now_us, top)
    met = (arrivals if known is None else known).select("source", "source_event_id").filter("source_event_id IS NOT NULL").distinct()
    both = conform(catalog).unionByName(new)
    again = catalog.join(met, ["source", "source_event_id"], "left_semi")
    return recluster(both, new.select(*_PLACE).unionByName(again.select(*_PLACE)), geodesic), new


_PLACE = ["id", "source", "occurred_us", "lon", "lat"]


def conform(reports: DataFrame) -> DataFrame:
    """The columns of a catalogue in their order and types; those that ``reports`` lacks are null."""
    return reports.select(*[(F.col(c) if c in reports.columns else F.lit(None)).cast(t).alias(c) for c, t in CATALOG_COLUMNS.items()])


def ingest_counts(arrivals: DataFrame, inserted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: fetched, inserted, errors."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(arrivals, "fetched").crossJoin(n(inserted, "inserted")).crossJoin(n(rejected, "errors"))
