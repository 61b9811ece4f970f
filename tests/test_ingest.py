"""Feeds to one catalogue, in batches and streams; catalogue edits, exports and loads; on rows of our own."""

import datetime
import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite.constants import CATALOG_COLUMNS, EXPORT_COLUMNS
from tremolite.functions import motion, parse
from tremolite.operators import catalog, dedup, zonal
from tremolite.plans import queries
from tremolite.sources import feeds, rasters
from tremolite.streaming import ingest

T0 = 1_717_200_000  # 1 June 2024, 00:00 UTC


def usgs_doc(rows):
    """rows: (id, seconds after T0, lon, lat, magnitude)."""
    return {"type": "FeatureCollection", "features": [
        {"id": i, "properties": {"mag": m, "time": (T0 + t) * 1000, "updated": (T0 + t + 60) * 1000, "place": "somewhere", "magType": "mb", "status": "reviewed", "sig": 100}, "geometry": {"type": "Point", "coordinates": [x, y, 10.0]}}
        for i, t, x, y, m in rows
    ]}


def met_doc(rows):
    at = lambda t: datetime.datetime.fromtimestamp(T0 + t, datetime.UTC)
    return {"status": True, "data": [
        {"id": i, "mode": None, "region": "a region", "event_date": f"{at(t):%Y-%m-%d}", "event_time": f"{at(t):%H:%M:%S}", "magnitude": f"{m} ML", "depth": "12 km", "latitude": f"{y}N", "longitude": f"{x} E".replace(".", ",")}
        for i, t, x, y, m in rows
    ]}


BATCHES = (
    # (usgs, met): 1 and m1 are one quake, 2 and 3 are apart in time, m4 is out of the region, 5 has no magnitude
    ([("u1", 1000, 72.5, 34.0, 5.0), ("u2", 5000, 72.5, 34.0, 4.0), ("u5", 6000, 70.0, 30.0, None)], [(1, 1030, 72.55, 34.02, 5.1), (4, 1030, 140.0, 34.0, 5.0)]),
    # u1 again, with another time: it stays as it was; u3 is near u2 and before it
    ([("u1", 90000, 72.5, 34.0, 5.5), ("u3", 4950, 72.6, 34.1, 4.2)], [(1, 1030, 72.55, 34.02, 5.1), (2, 5040, 72.5, 34.05, 4.1)]),
    # around midnight, on both sides
    ([("u6", 86390, 60.0, 20.0, 3.0), ("u7", 172790, 60.0, 20.0, 3.0)], [(3, 86410, 60.1, 20.1, 3.1)]),
)


def land(folder, n, doc):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text(json.dumps(doc, indent=2))


def rows_of(df):
    return sorted((r.source, r.source_event_id, r.occurred_us, r.cluster_id, r.is_canonical, r.id) for r in df.collect())


def check_state(c):
    state = c.read()
    assert state.columns == list(CATALOG_COLUMNS)
    whole = dedup.cluster(state).select(*CATALOG_COLUMNS)
    assert rows_of(state) == rows_of(whole)
    got = {(r.source, r.source_event_id): r for r in state.collect()}
    assert len({r.id for r in got.values()}) == len(got) == state.count()
    return got


def test_streams_of_two_feeds_end_as_one_catalogue(spark, tmp_path):
    c = ingest.Catalogue(spark, str(tmp_path / "state"))
    both = [feeds.usgs(str(tmp_path / "usgs")), feeds.met(str(tmp_path / "met"))]
    for n, (u, m) in enumerate(BATCHES):
        land(tmp_path / "usgs", n, usgs_doc(u))
        land(tmp_path / "met", n, met_doc(m))
        assert ingest.tick(c, both, str(tmp_path / "cp")) == [("MET", None), ("USGS", None)]
        got = check_state(c)
    assert set(got) == {("USGS", f"u{i}") for i in (1, 2, 3, 6, 7)} | {("MET", str(i)) for i in (1, 2, 3)}
    assert got["USGS", "u1"].occurred_us == (T0 + 1000) * 1_000_000 and not got["USGS", "u1"].is_canonical and got["MET", "1"].is_canonical
    assert got["MET", "1"].id < got["USGS", "u1"].id and got["USGS", "u6"].cluster_id == got["MET", "3"].cluster_id
    before = rows_of(c.read())
    assert ingest.tick(c, both, str(tmp_path / "cp")) == [("MET", None), ("USGS", None)] and rows_of(c.read()) == before
    # all in one batch: the same reports; ids, and so the clusters named by them, go by what came first
    one = ingest.Catalogue(spark, str(tmp_path / "one"))
    assert ingest.ingest(one, both) == [("MET", None), ("USGS", None)]
    assert set(check_state(one)) == set(got)
    sync = {r.source: r for r in one.sync_state().collect()}
    assert (sync["MET"].inserted, sync["USGS"].inserted) == (3, 5)
    ingest.ingest(one, both)
    assert {r.inserted for r in one.sync_state().collect()} == {0}
    # a filter on time leaves other days' folders unread
    late = one.read(since_us=(T0 + 100_000) * 1_000_000)
    assert [r.source_event_id for r in late.collect()] == ["u7"] and "PartitionFilters: [isnotnull(day" in late._jdf.queryExecution().toString()


def test_a_feed_that_fails_does_not_stop_the_others(spark, tmp_path):
    c = ingest.Catalogue(spark, str(tmp_path / "state"))
    land(tmp_path / "usgs", 0, usgs_doc(BATCHES[0][0]))
    both = [feeds.usgs(str(tmp_path / "usgs")), feeds.met(str(tmp_path / "nowhere"))]
    for run in (lambda: ingest.ingest(c, both), lambda: ingest.tick(c, both, str(tmp_path / "cp"))):
        (met, error), (usgs, fine) = run()
        assert (met, usgs, fine) == ("MET", "USGS", None) and "nowhere" in error
    assert c.read().count() == 2 and [r.source for r in c.sync_state().collect()] == ["USGS"]


def test_fallback_only_where_a_source_cannot_be_read(spark, tmp_path):
    land(tmp_path / "usgs", 0, usgs_doc(BATCHES[0][0]))
    there, gone = feeds.usgs(str(tmp_path / "usgs")), feeds.usgs(str(tmp_path / "gone"))
    assert feeds.with_fallback(lambda: gone.fetch(spark), lambda: there.fetch(spark)).count() == 2
    assert feeds.with_fallback(lambda: there.fetch(spark, since=(T0 + 2000) * 1_000_000), lambda: gone.fetch(spark)).count() == 1
    with pytest.raises(Exception, match="no_such_column"):
        feeds.with_fallback(lambda: there.fetch(spark).select("no_such_column"), lambda: there.fetch(spark))
    assert there.fetch(spark, updated_after=(T0 + 5000) * 1_000_000).count() == 1


def test_edits_and_deletions_by_what_is_near(spark):
    r = queries.X.reports(spark, "/root/testdata/sf0.001")
    old = dedup.cluster(r).persist()
    changed = old.filter("id % 9 = 0")
    gone = old.filter("id % 10 = 3")
    moved = old.withColumns({"lon": F.when(F.col("id") % 9 == 0, F.col("lon") + 0.3).otherwise(F.col("lon")), "occurred_us": F.when(F.col("id") % 9 == 0, F.col("occurred_us") - 20_000_000).otherwise(F.col("occurred_us"))}).filter("id % 10 <> 3")
    place = ["id", "source", "occurred_us", "lon", "lat", "cluster_id"]
    touched = changed.select(*place).union(gone.select(*place)).union(moved.filter("id % 9 = 0").select(*place))
    keep = ["id", "cluster_id", "is_canonical"]
    got = sorted(map(tuple, dedup.recluster(moved, touched).select(*keep).collect()))
    assert got == sorted(map(tuple, dedup.cluster(moved).select(*keep).collect()))


@pytest.mark.parametrize("zone", ["UTC", "Asia/Karachi", "America/New_York"])
def test_the_session_zone_has_no_part_in_results(spark, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("2024-01-01", "10:20:30"), ("2024-03-10", "02:30"), ("2024-1-5", ""), ("2024-01-01", None), ("2024-13-01", "10:20:30"), ("2024-01-01", "25:00:00"), ("01/02/2024", "10:00"), (None, "10:00"), ("2024-01-01", "10:20:30.5"), ("", "")]
        got = [r[0] for r in spark.createDataFrame(rows, "d string, t string").select(parse.met_datetime(F.col("d"), F.col("t"))).collect()]
        assert got == [1704104430000000, 1710037800000000, 1704412800000000, 1704067200000000, None, None, None, None, None, None]
        first = queries.s2_met_feed(spark, "/root/testdata/sf0.001").agg(F.min("occurred_us"), F.max("occurred_us"), F.count("*")).first()
        assert tuple(first) == (1704067200000000, 1706610030000000, 1261)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_the_feed_plan_has_few_patterns(spark):
    plan = queries.s2_met_feed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") + plan.count("RLIKE") <= 20


def test_met_rows_by_every_reason(spark):
    row = lambda i, **k: {"id": i, "event_date": "2024-06-01", "event_time": "01:02:03", "magnitude": "4.1", "depth": "10", "latitude": "30.5N", "longitude": "70,25 E"} | k
    data = [row(1), row(2, latitude="607"), row(3, magnitude="317"), row(4, magnitude="M"), row(5, longitude="146.21 W"), row(6, event_date="n/a"), row(7, depth="1010"), row(8, latitude="6.99 S"), row(None), row(9, event_time=None)]
    docs = spark.createDataFrame([(json.dumps({"data": data}),)], "j string").select(F.from_json("j", feeds.MET_SCHEMA).alias("d")).select("d.*")
    assert {r.id: r.reason for r in feeds.parse_met(docs, rejected=True).collect()} == {2: "world", 3: "magnitude", 4: "missing", 5: "region", 6: "date", 8: "region", None: "missing"}
    got = {r.source_event_id: r for r in feeds.parse_met(docs).collect()}
    assert set(got) == {"1", "7", "9"} and got["7"].depth_km == 0.0 and (got["1"].lon, got["1"].lat) == (70.25, 30.5)


def test_neighbours_by_brute_force(spark):
    """Anywhere on earth: near the poles, across the 180th meridian, in one place."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        x, y = [(180.0, 0.0), (0.0, 89.9), (72.0, 55.9), (10.0, -89.99), (-179.9, 60.0), (30.0, 0.01)][k % 6]
        x, y = x + rng.normal() * 0.4 / max(0.02, math.cos(math.radians(y))), min(90.0, max(-90.0, y + rng.normal() * 0.3))
        rows.append((k, "USGS" if k % 7 else "MANUAL", int(rng.integers(0, 200)) * 1_000_000, (x + 180) % 360 - 180, y))
    got = {tuple(r) for r in dedup.neighbour_pairs(spark.createDataFrame(rows, "id long, source string, occurred_us long, lon double, lat double")).collect()}

    def near(a, b):
        p, q = math.radians(a[4]), math.radians(b[4])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return abs(a[2] - b[2]) <= 60_000_000 and 2 * 6_371_008.8 * math.asin(math.sqrt(min(1.0, h))) <= 50_000

    feed = [r for r in rows if r[1] != "MANUAL"]
    want = {(a[0], b[0]) for a in feed for b in feed if near(a, b)}
    assert got == want and len(want) > len(feed)


def test_spheroid(spark):
    one = spark.range(1)
    d = one.select(motion.lambert_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), motion.lambert_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), motion.lambert_m(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0))).first()
    assert abs(d[0] - 110_574.4) < 1 and abs(d[1] - 111_319.5) < 1 and d[2] == 0.0


def test_catalogue_filters_pages_and_edits(spark):
    rows = [(i, "USGS" if i % 2 else "MET", None, i * 1_000_000, i / 2, 10.0, 70.0, 30.0, i, i % 3 > 0, "near Kabul" if i % 4 else None) for i in range(1, 13)]
    c = spark.createDataFrame(rows, "id long, source string, source_event_id string, occurred_us long, magnitude double, depth_km double, lon double, lat double, cluster_id long, is_canonical boolean, place string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(c.filter(catalog.where())) == [1, 2, 4, 5, 7, 8, 10, 11]
    assert ids(c.filter(catalog.where(since_us=4_000_000, before_us=10_000_000, mag_min=2.5, mag_max=5, source="USGS"))) == [5, 7]
    assert ids(c.filter(catalog.where(after_us=8_000_000, search="KAB_L"))) == [10, 11]
    assert [r.id for r in catalog.page(catalog.ordered(c), 3, 2).collect()] == [10, 9, 8] and catalog.page(c, None, 5).count() == 12
    assert [r.id for r in catalog.ordered(c, "time-asc").limit(2).collect()] == [1, 2] and [r.id for r in catalog.ordered(c, "no such").limit(1).collect()] == [12]
    patch = spark.createDataFrame([(1, 9.0, None, 71.0, None, None), (2, None, 5.0, 72.0, 33.0, 7), (99, 1.0, 1.0, 1.0, 1.0, 1)], "id long, magnitude double, depth_km double, lon double, lat double, occurred_us long")
    got = {r.id: r for r in catalog.update(c, patch).collect()}
    assert (got[1].magnitude, got[1].lon) == (9.0, 70.0) and (got[2].depth_km, got[2].lon, got[2].lat, got[2].occurred_us) == (5.0, 72.0, 33.0, 7) and len(got) == 12
    assert ids(catalog.delete(c, spark.createDataFrame([(1,), (50,)], "id long"))) == list(range(2, 13))
    assert catalog.fetch_query(c, start_us=3_000_000, end_us=9_000_000, cap=2).select("id").collect() == [(9,), (8,)]


def test_exports(spark, tmp_path):
    c = dedup.conform(queries.catalog(spark, "/root/testdata/sf0.001")).filter("is_canonical")
    catalog.write_csv(c, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == list(EXPORT_COLUMNS) and back.count() == c.count() and all(r[0].endswith("Z") and r[0][10] == "T" for r in back.select("occurred_at").collect())
    catalog.write_geojson(c, str(tmp_path / "geo"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "geo")).collect()]
    assert len(lines) == c.count() and all(x["type"] == "Feature" and "felt" not in x["properties"] and x["properties"]["lon"] == x["geometry"]["coordinates"][0] for x in lines)
    bands = spark.createDataFrame([(1, 3, 4, "#fff", 0, k, 0.5 + k, 9.5) for k in (0, 1, 4)], "event_id long, mmi_lower int, mmi_upper int, color string, row int, col int, lon double, lat double")
    queries.intensity.write_bands(bands, str(tmp_path / "bands"))
    assert sorted((r.col0, r.col1, r.mmi_low, r.mmi_high) for r in spark.read.parquet(str(tmp_path / "bands")).collect()) == [(0, 1, 3, 4), (4, 4, 3, 4)]
    with pytest.raises(ValueError, match="no band"):
        queries.intensity.write_bands(bands, str(tmp_path / "none"), (9,))
    feature = json.loads(queries.intensity.band_features(bands, 0.5).first().feature)
    assert feature["geometry"]["type"] == "MultiPolygon" and feature["geometry"]["coordinates"][0] == [[[0, 9], [2, 9], [2, 10], [0, 10], [0, 9]]]


def test_rasters(spark):
    raw = spark.createDataFrame([(0, 0, 400.0), (0, 1, -9999.0), (1, 0, 0.0), (1, 1, None)], "row int, col int, raw double")
    got = {(r.row, r.col): r for r in queries.intensity.load_cells(raw, 70.0, 32.0, 1.0, 1.0).collect()}
    assert [got[k].vs30 for k in sorted(got)] == [400.0, 760.0, 760.0, 760.0] and (got[0, 1].lon, got[0, 1].lat, got[1, 0].lat) == (71.5, 31.5, 30.5)
    assert {(r.factor, r.row, r.col): r.raw for r in rasters.overviews(raw, (2, 4)).collect()} == {(2, 0, 0): 200.0, (4, 0, 0): 200.0}
    boxes = spark.createDataFrame([(2, 0.5, 0.0, 1.0, 0.5, 7.0), (1, 0.0, 0.0, 0.5, 0.5, 5.0), (3, 1.0, 1.5, 1.5, 2.0, 9.0)], "seq long, minx double, miny double, maxx double, maxy double, value double")
    assert tuple(rasters.derive_grid(boxes).first()) == (0.0, 2.0, 0.5, 3, 4)
    burnt = rasters.rasterise(boxes, 0.0, 2.0, 0.5, 3, 4)
    assert {(r.row, r.col): r.raw for r in burnt.filter("raw > 0").collect()} == {(3, 0): 5.0, (3, 1): 7.0, (0, 2): 9.0} and burnt.count() == 12
    with pytest.raises(Exception, match="no area"):
        rasters.derive_grid(boxes.withColumn("maxx", F.col("minx"))).collect()


def test_boundaries(spark, tmp_path):
    with pytest.raises(ValueError, match="city"):
        zonal.map_features(spark.createDataFrame([({"name": "a"},)], "props map<string,string>"), "city")
    units = spark.createDataFrame([(1, "province", "p", 0.0, 0.0, 2.0, 2.0), (2, "district", "d", 0.0, 0.0, 1.0, 1.0)], "unit_id long, level string, name string, minx double, miny double, maxx double, maxy double")
    edges = zonal.envelope_edges(units).drop("part")
    path = str(tmp_path / "b")
    with pytest.raises(ValueError, match="district 1 for 3"):
        zonal.load_boundaries(units, edges, path, {"province": 1, "district": 3})
    assert zonal.load_boundaries(units, edges, path, {"province": 1, "district": 1}) and not zonal.load_boundaries(units, edges, path, {"province": 1})
    assert zonal.load_boundaries(units.limit(1), edges, path, {"province": 1}, force=True) and spark.read.parquet(f"{path}/units").count() == 1
    loaded = spark.read.parquet(f"{path}/edges")
    assert loaded.count() == 8 and {r.part for r in loaded.collect()} == {0}


def test_simplification_by_brute_force(spark):
    """Rings of random vertices: the tolerance decides most of them."""
    rng = np.random.default_rng(6)
    rings = {}
    for u in range(8):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 60))
        rings[u] = np.stack([np.cos(angle), np.sin(angle)], 1) * (1 + rng.normal(0, 0.03, 60))[:, None]

    def keep(points, tolerance):
        if len(points) < 3:
            return list(points)
        a, b = points[0], points[-1]
        far, at = -1.0, 0
        for i, p in enumerate(points[1:-1], 1):
            t = min(1.0, max(0.0, float(np.dot(p - a, b - a)) / (float(np.dot(b - a, b - a)) or 1.0)))
            d = math.dist(p, a + t * (b - a))
            if d > far:
                far, at = d, i
        return keep(points[: at + 1], tolerance)[:-1] + keep(points[at:], tolerance) if far > tolerance else [a, b]

    rows = [(u, 0, 0, i, *map(float, (*r[i], *r[(i + 1) % len(r)]))) for u, r in rings.items() for i in range(len(r))]
    got = {}
    for r in zonal.simplify(spark.createDataFrame(rows, "unit_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"), 0.05).orderBy("unit_id", "seq").collect():
        got.setdefault(r.unit_id, []).append((r.x1, r.y1))
    for u, r in rings.items():
        far = max(range(len(r)), key=lambda i: float(((r[i] - r[0]) ** 2).sum()))
        want = keep(r[: far + 1], 0.05)[:-1] + keep(np.vstack([r[far:], r[:1]]), 0.05)[:-1]
        assert got[u] == [tuple(p) for p in want] and 4 < len(want) < 50


def damaged_gzip(folder):
    """A compressed document cut off in the middle."""
    folder.mkdir(exist_ok=True)
    whole = gzip.compress(json.dumps(met_doc([(k, 1000 + k, 60 + k / 100, 30.0, 4.0) for k in range(400)])).encode())
    (folder / "9.json.gz").write_bytes(whole[: len(whole) // 2])


@pytest.mark.parametrize("damaged", ["MET", "USGS"])
def test_a_damaged_file_of_one_feed_does_not_stop_the_other(spark, tmp_path, damaged):
    good = {"USGS": (feeds.usgs, usgs_doc(BATCHES[0][0]), 2), "MET": (feeds.met, met_doc(BATCHES[0][1]), 1)}
    for way in ("ingest", "tick"):
        base = tmp_path / way
        base.mkdir()
        both = []
        for name, (make, doc, _) in good.items():
            damaged_gzip(base / name) if name == damaged else land(base / name, 0, doc)
            both.append(make(str(base / name)))
        c = ingest.Catalogue(spark, str(base / "state"))
        out = dict(ingest.ingest(c, both) if way == "ingest" else ingest.tick(c, both, str(base / "cp")))
        other = "USGS" if damaged == "MET" else "MET"
        assert out[other] is None and out[damaged] and c.read().count() == good[other][2]


def test_fallback_from_a_damaged_file(spark, tmp_path):
    land(tmp_path / "first", 0, met_doc([(7, 10, 60.0, 30.0, 4.0)]))
    damaged_gzip(tmp_path / "first")
    land(tmp_path / "second", 0, met_doc(BATCHES[0][1]))
    first, second = feeds.met(str(tmp_path / "first")), feeds.met(str(tmp_path / "second"))
    assert [r.source_event_id for r in feeds.with_fallback(lambda: first.fetch(spark), lambda: second.fetch(spark)).collect()] == ["1"]
    with pytest.raises(Exception, match="(?i)division|divide"):
        feeds.with_fallback(lambda: second.fetch(spark).select(F.raise_error(F.lit("division"))), lambda: first.fetch(spark))


def files_of(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_snapshot_without_news_rewrites_nothing(spark, tmp_path):
    days = [(k, 86_400 * k + 40_000, 60.0 + k / 10, 30.0, 4.0) for k in range(60)]
    land(tmp_path / "met", 0, met_doc(days))
    met, c = feeds.met(str(tmp_path / "met")), ingest.Catalogue(spark, str(tmp_path / "state"))
    assert ingest.tick(c, [met], str(tmp_path / "cp")) == [("MET", None)] and c.read().count() == 60
    before = files_of(tmp_path / "state" / "catalog")
    land(tmp_path / "met", 1, met_doc(days))
    assert ingest.tick(c, [met], str(tmp_path / "cp")) == [("MET", None)]
    assert files_of(tmp_path / "state" / "catalog") == before
    assert [(r.fetched, r.inserted, r.errors) for r in c.sync_state().collect()] == [(60, 0, 0)]
    land(tmp_path / "met", 2, met_doc([*days, (99, 86_400 * 30 + 40_010, 63.05, 30.0, 4.2)]))
    ingest.tick(c, [met], str(tmp_path / "cp"))
    after = files_of(tmp_path / "state" / "catalog")
    changed = {p.parent.name for p in before.keys() - after.keys()}
    first = (T0 // 86_400) + 30
    assert changed == {f"day={first + n}" for n in (-1, 0, 1)} and len(check_state(c)) == 61


def test_an_unfinished_run_is_mended_by_the_next(spark, tmp_path, monkeypatch):
    land(tmp_path / "usgs", 0, usgs_doc(BATCHES[0][0]))
    land(tmp_path / "met", 0, met_doc(BATCHES[0][1]))
    usgs, met, c = feeds.usgs(str(tmp_path / "usgs")), feeds.met(str(tmp_path / "met")), ingest.Catalogue(spark, str(tmp_path / "state"))
    c.add(usgs.fetch(spark), "USGS")
    real = ingest.Catalogue._put

    def half(self, state, days, touched):  # the rows are there, but what is near them isn't clustered
        near = F.col("source_event_id").isin("1", "u1")
        real(self, dedup.conform(state.withColumns({"cluster_id": F.when(near, F.col("id")).otherwise(F.col("cluster_id")), "is_canonical": ~near & F.col("is_canonical")})), days, touched)
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest.Catalogue, "_put", half)
    with pytest.raises(RuntimeError):
        c.add(met.fetch(spark), "MET")
    monkeypatch.setattr(ingest.Catalogue, "_put", real)
    assert {r.source_event_id: r.is_canonical for r in c.read().collect()} == {"1": False, "u1": False, "u2": True}
    c.add(met.fetch(spark), "MET")
    got = check_state(c)
    assert got["MET", "1"].is_canonical and not got["USGS", "u1"].is_canonical and c._pending().count() == 0


def test_rejected_rows_are_kept_with_their_reason(spark, tmp_path):
    land(tmp_path / "usgs", 0, usgs_doc([*BATCHES[0][0], ("far", 10, 150.0, 0.0, 5.0)]))
    (tmp_path / "usgs" / "1.json").write_text('{"features": [{"id": "cut')
    land(tmp_path / "met", 0, met_doc(BATCHES[0][1]))
    both = [feeds.usgs(str(tmp_path / "usgs")), feeds.met(str(tmp_path / "met"))]
    c = ingest.Catalogue(spark, str(tmp_path / "state"))
    assert ingest.tick(c, both, str(tmp_path / "cp")) == [("MET", None), ("USGS", None)]
    got = {(r.source, r.source_event_id): r for r in c.rejected().collect()}
    assert {k: r.reason for k, r in got.items()} == {("USGS", "u5"): "missing", ("USGS", "far"): "region", ("USGS", None): "document", ("MET", "4"): "region"}
    assert json.loads(got["USGS", "far"].document)["geometry"]["coordinates"][0] == 150.0 and got["USGS", None].document.startswith('{"features"')
    assert {r.source: (r.fetched, r.inserted, r.errors) for r in c.sync_state().collect()} == {"USGS": (2, 2, 3), "MET": (1, 1, 1)}
    bad = spark.createDataFrame([("OTHER", "x", 5, 4.0, 1.0, 70.0, 30.0), ("USGS", "y", 5, None, 1.0, 70.0, 30.0), ("USGS", "z", 5, 4.0, 1.0, 70.0, 30.0)], "source string, source_event_id string, occurred_us long, magnitude double, depth_km double, lon double, lat double")
    for _ in range(2):  # a batch that runs again has its rejected rows once
        c.add(bad, "USGS", now_us=77, batch=77)
    assert sorted((r.source_event_id, r.reason) for r in c.rejected().filter("batch = 77").collect()) == [("x", "source"), ("y", "missing")]


def test_edits_of_the_stored_catalogue(spark, tmp_path):
    land(tmp_path / "usgs", 0, usgs_doc([("a", 1000, 72.5, 34.0, 5.0), ("b", 1020, 72.52, 34.0, 4.0), ("c", 1040, 72.54, 34.0, 4.0), ("d", 86_400 * 5, 60.0, 20.0, 4.0), ("e", 86_400 * 9, 60.0, 20.0, 4.0)]))
    c = ingest.Catalogue(spark, str(tmp_path / "state"))
    ingest.ingest(c, [feeds.usgs(str(tmp_path / "usgs"))])
    got = check_state(c)
    a, b, d, e = (got["USGS", k] for k in "abde")
    assert b.cluster_id == a.id and not b.is_canonical
    patch = lambda *rows: spark.createDataFrame(rows, "id long, magnitude double, depth_km double, lon double, lat double, occurred_us long")
    # the first of a cluster moves to another day: its old day keeps the others, which are clustered anew
    assert c.update(patch((a.id, 6.0, None, None, None, d.occurred_us + 30_000_000))) == 1
    got = check_state(c)
    assert got["USGS", "a"].magnitude == 6.0 and got["USGS", "b"].is_canonical and got["USGS", "c"].cluster_id == b.id
    # onto another report: they are one cluster then
    assert c.update(patch((a.id, None, None, 60.1, 20.0, None), (10**9, 1.0, None, None, None, None))) == 1
    got = check_state(c)
    assert got["USGS", "d"].cluster_id == min(a.id, d.id) == got["USGS", "a"].cluster_id
    # the only report of a day leaves it: the day's folder goes
    day = e.occurred_us // 86_400_000_000
    assert (tmp_path / "state" / "catalog" / f"day={day}").exists()
    assert c.delete(spark.createDataFrame([(e.id,), (10**9,)], "id long")) == 1 and c.delete(spark.createDataFrame([(e.id,)], "id long")) == 0
    assert not (tmp_path / "state" / "catalog" / f"day={day}").exists() and ("USGS", "e") not in check_state(c)
    assert c.delete(spark.createDataFrame([(a.id,), (d.id,)], "id long")) == 2 and set(check_state(c)) == {("USGS", "b"), ("USGS", "c")}
    event = "magnitude double, depth_km double, lon double, lat double, occurred_us long"
    assert c.add_manual(spark.createDataFrame([(5.5, 10.0, 72.5, 34.0, b.occurred_us), (4.5, 10.0, 72.5, 34.0, None)], event), now_us=(T0 + 10**6) * 10**6) == 2
    rows = {r.source_event_id or r.occurred_us: r for r in c.read().collect()}
    assert rows[b.occurred_us].is_canonical and rows[b.occurred_us].cluster_id == rows[b.occurred_us].id > d.id and rows["b"].is_canonical
    with pytest.raises(ValueError, match="region"):
        c.add_manual(spark.createDataFrame([(5.5, 10.0, 0.0, 0.0, None)], event))
    # a later batch inserts what was deleted anew, as an ingest does
    ingest.ingest(c, [feeds.usgs(str(tmp_path / "usgs"))], since=0)
    assert [r.id for r in c.find(mag_min=5.0).collect()] == [rows[b.occurred_us].id]
    late = c.find(since_us=(T0 + 86_400 * 3) * 10**6, limit=None)
    assert "PartitionFilters: [isnotnull(day" in late._jdf.queryExecution().toString()
