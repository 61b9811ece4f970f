import functools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite.functions import motion, parse
from tremolite.operators import contours, dedup, intensity, zonal
from tremolite.plans import fixtures, queries
from tremolite.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["a14_cluster_ids", "w4_canonical_pick", "a4_gutenberg_richter", "s1_usgs_feed", "s2_met_feed", "g6_points_in_units", "g13_event_impact", "g3_isolines", "g7_touched_cells", "g9_simplified_rings", "s12_boundary_features", "s6_full_snapshot", "s9_derived_grid", "s11_overviews", "s14_overlay_vertices", "h15_spheroid_distance", "p1_all_columns", "k1_csv_columns", "k5_insert_counts", "u2_two_feeds", "st5_recluster_what_is_near", "g4_band_regions", "j10_compare_events"])
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert plain(df.select(*cols).collect()) == plain(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """A folder of nine events, more than the three of the reports, most of them strong and shallow."""
    d = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet(f"{SF}/events.parquet").filter("event_id IN (9, 77, 308, 439, 568, 619, 749, 851, 904)").coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["g7_zonal_maximum", "g6_points_in_units", "j11_parent_units", "g13_event_impact", "t6_top_units"])
def test_units_of_all_levels(spark, few, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{few}/events.parquet/*.parquet'")
    df = QUERIES[f"{name}_all_levels"](spark, few)
    cols, got = sorted(df.columns), df.collect()
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[f'{name}_all_levels']})").fetchall()
    assert plain([[-1 if r[c] is None else r[c] for c in cols] for r in got]) == plain([[-1 if v is None else v for v in r] for r in want])
    assert any(r.level == "tehsil" if "level" in cols else r.unit_id >= 200000 for r in got)
    if name == "g13_event_impact":
        assert len(got) == 3 * 6552 and "mmi_repr" in cols
    if name == "j11_parent_units":
        assert all(r.parent_id is not None for r in got if r.unit_id >= 100000)


EVERY = ["g1_intensity_surfaces", "h9_pga_classes", "g2_filled_bands", "h8_band_attributes", "k4_band_levels", "g3_isolines", "a19_surface_maximum", "g7_zonal_maximum", "g13_event_impact", "t6_top_units"]


@pytest.mark.parametrize("name", [*(f"{n}_every_event" for n in EVERY), "k3_band_export", "k6_band_features", "g4_band_regions_every_event", "g2_band_polygons_every_event", "k6_polygon_features_every_event"])
def test_every_event(spark, few, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{few}/events.parquet/*.parquet'")
    df = QUERIES[name](spark, few)
    cols, got = sorted(df.columns), df.collect()
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert plain([[r[c] for c in cols] for r in got]) == plain(want) and len({r.event_id for r in got}) > 3


def test_every_event_compared_with_the_next(spark, few):
    events = [r.id for r in queries.canonical(spark, few).orderBy("occurred_us", "id").collect()]
    cells = {i: {} for i in events}
    for r in queries.intensity.surfaces(queries.sites(spark), queries.canonical(spark, few)).select("event_id", "row", "col", "mmi").collect():
        cells[r.event_id][r.row, r.col] = r.mmi
    want = {(a, b, *k): cells[b].get(k, 0.0) - cells[a].get(k, 0.0) for a, b in zip(events, events[1:], strict=False) for k in cells[a].keys() | cells[b].keys()}
    e = queries.canonical(spark, few)
    got = {(r.first_id, r.second_id, r.row, r.col): r.delta for r in intensity.compare_pairs(intensity.surfaces(queries.sites(spark), e), queries.C.next_events(e)).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_event_regions(spark, few):
    cells = {tuple(r) for r in queries._bands_of(spark, queries.canonical(spark, few)).select("event_id", "mmi_lower", "row", "col").collect()}
    want = {}
    while cells:
        todo, found = [cells.pop()], []
        while todo:
            e, m, r, c = todo.pop()
            found.append((r, c))
            near = {(e, m, r + 1, c), (e, m, r - 1, c), (e, m, r, c + 1), (e, m, r, c - 1)} & cells
            cells -= near
            todo += near
        want[e, m, min(found)] = len(found)
    got = {(r.event_id, r.mmi_lower, (r.region_row, r.region_col)): r.n_cells for r in QUERIES["g4_band_regions_fine_every_event"](spark, few).collect()}
    assert got == want and len({e for e, *_ in want}) > 3


def test_formulas(spark):
    one = spark.range(1)
    d = one.select(motion.haversine_m(F.lit(70.0), F.lit(30.0), F.lit(70.0), F.lit(31.0))).first()[0]
    assert abs(d - 111_195) < 111
    m = spark.createDataFrame([(0.0,), (65.8,), (1e9,)], "p double").select(motion.pga_to_mmi(F.col("p")).alias("m")).collect()
    assert m[0].m == 1.0 and 4.9 < m[1].m < 5.1 and m[2].m == 10.0
    dirty = spark.createDataFrame([("24.87 N",), ("30.50N",), ("73,20 E",), ("6.99 S",), ("M",), (None,)], "s string")
    assert [r[0] for r in dirty.select(parse.coordinate(F.col("s"), True)).collect()] == [24.87, 30.5, 73.2, -6.99, None, None]


def test_pruned_surface_is_whole_surface(spark):
    cells = queries.sites(spark)
    rows = [(1, 5.5, 10.0, 72.5, 34.0), (2, 7.9, 0.0, 60.0, 50.0), (3, 2.0, 120.0, 72.5, 34.0), (4, 6.5, 300.0, 100.0, 10.0), (5, 4.0, 600.0, 72.5, 34.0), (6, 0.0, 1.0, 72.5, 34.0)]
    e = spark.createDataFrame(rows, "id long, magnitude double, depth_km double, lon double, lat double")
    pruned = intensity.surfaces(cells, e).select("event_id", "row", "col")
    whole = functools.reduce(lambda a, b: a.union(b), [intensity.surface_all(cells, *r) for r in rows]).filter("mmi >= 2").select("event_id", "row", "col")
    assert pruned.exceptAll(whole).count() == 0 and whole.exceptAll(pruned).count() == 0 and pruned.count() > 0


def test_second_ingest_inserts_nothing(spark):
    r = fixtures.reports(spark, SF).filter("source_event_id IS NOT NULL")
    assert dedup.insert_if_absent(r, r, ["id"]).count() == 0


def test_regions_and_pruning(spark):
    b = spark.createDataFrame([(1, 3, 0, 0), (1, 3, 0, 1), (1, 3, 1, 1), (1, 3, 5, 5), (1, 4, 1, 2)], "event_id long, mmi_lower int, row int, col int")
    r = intensity.regions(b)
    assert sorted(x[0] for x in r.groupBy("mmi_lower", "region_id").count().select("count").collect()) == [1, 1, 3]
    assert intensity.prune_regions(r, 1.0, 1.0, 2.0).count() == 3


def test_band_regions_by_flood_fill(spark):
    least = 0.05 / fixtures.STEP**2
    cells = {(r.event_id, r.mmi_lower, r.row, r.col) for r in queries._bands(spark, SF).select("event_id", "mmi_lower", "row", "col").collect()}
    want = []
    while cells:
        todo, found = [cells.pop()], []
        while todo:
            e, m, r, c = todo.pop()
            found.append((e, m, r, c))
            near = {(e, m, r + 1, c), (e, m, r - 1, c), (e, m, r, c + 1), (e, m, r, c - 1)} & cells
            cells -= near
            todo += near
        if len(found) >= least:
            rows, cols = [f[2] for f in found], [f[3] for f in found]
            want.append((*found[0][:2], len(found), min(rows), max(rows), min(cols), max(cols)))
    got = queries.g4_band_regions(spark, SF).drop("region_row", "region_col").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_crossed_cells(spark):
    edges = spark.createDataFrame([(1, 0, 0, 0, 0.5, 2.5, 2.5, 0.5), (2, 0, 0, 0, -5.0, 1.5, 9.0, 1.5)], "unit_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r) for r in zonal.crossed_cells(edges, 0.0, 3.0, 1.0, 3, 3).collect()}
    assert {(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 1, 0), (2, 1, 1), (2, 1, 2)} <= got and not {(1, 0, 2), (1, 2, 0), (2, 0, 0), (2, 2, 2)} & got


def test_holes_and_simplification(spark):
    ring = [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)]
    hole = [(1, 1, 1, 3), (1, 3, 3, 3), (3, 3, 3, 1), (3, 1, 1, 1)]
    rows = [(7, 0, r, i, *map(float, e)) for r, es in enumerate((ring, hole)) for i, e in enumerate(es)]
    edges = spark.createDataFrame(rows, "unit_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 9.0, 1.0)], "point_id long, lon double, lat double")
    assert [tuple(r) for r in zonal.points_in_polygons(pts, edges).collect()] == [(1, 7)]
    assert zonal.areas(edges).first().area == 12.0
    assert zonal.simplify(edges, 0.01).count() == 8


@pytest.mark.parametrize("name", ["j1_space_time_pairs", "g1_intensity_surfaces_every_event", "g2_band_polygons_every_event", "g7_zonal_maximum_every_event", "g13_event_impact_every_event", "t6_top_units_every_event"])
def test_no_exploded_rows_are_broadcast(spark, few, name):
    plan = QUERIES[name](spark, few)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in plan]
    for n, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = next((k for k in range(n + 1, len(plan)) if depth[k] <= depth[n]), len(plan))
            assert not [x for x in plan[n:below] if "Generate explode(sequence(" in x], line


@pytest.mark.parametrize("name", ["g7_touched_cells", "g8_representative_points"])
def test_units_are_not_broadcast(spark, name):
    """There are as many as reports."""
    assert "BroadcastExchange" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [*(f"{n}_every_event" for n in EVERY), "k3_band_export", "k6_band_features", "j10_compare_events_every_event"])
def test_cells_of_every_event_are_not_shuffled(spark, few, name, monkeypatch):
    """A strip's task makes them and returns what is asked of them."""
    monkeypatch.setattr(intensity, "surfaces", None)
    assert QUERIES[name](spark, few).columns


def test_sums_of_pairs_in_strips(spark, few):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{few}/events.parquet/*.parquet'")
    name = "j10_compare_events_every_event"
    df = QUERIES[name](spark, few)
    cols = sorted(df.columns)
    assert plain(df.select(*cols).collect()) == plain(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


def test_a_level_at_the_maximum_is_no_band_in_strips(spark):
    """The strongest cell has intensity 10, its bound, in one strip; the other one doesn't reach it."""
    e = spark.createDataFrame([(1, 8.0, 0.0, 70.05, 49.65)], "id long, magnitude double, depth_km double, lon double, lat double")
    cells = queries.sites(spark)
    want = {(r.mmi_lower, r["count"]) for r in intensity.banded(intensity.surfaces(cells, e)).groupBy("mmi_lower").count().collect()}
    tops = intensity.surfaces(cells, e).agg(F.max("mmi")).first()[0]
    assert tops == 10.0 and 10 not in {k for k, _ in want}
    assert {(r.mmi_lower, r.n) for r in queries.strips.band_digests(cells, e).collect()} == want
    runs = queries.strips.export_bands(cells, e).groupBy("mmi_low").agg(F.sum(F.col("col1") - F.col("col0") + 1).alias("n"))
    assert {(r.mmi_low, r.n) for r in runs.collect()} == want


def test_many_rings_are_simplified_at_a_time(spark):
    """No group of pandas for each ring; corners, order and numbers as given by hand."""
    ring = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 2.0), (0.0, 2.0), (0.0, 1.0)]
    rows = [(u, 0, 0, i, *ring[i], *ring[(i + 1) % 7]) for u in (1, 2) for i in (3, 0, 6, 1, 5, 2, 4)]
    thin = zonal.simplify(spark.createDataFrame(rows, "unit_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"), 0.01)
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert sorted(map(tuple, thin.collect())) == [(u, 0, 0, i, *square[i], *square[(i + 1) % 4]) for u in (1, 2) for i in range(4)]
    assert "FlatMapGroupsInPandas" not in thin._jdf.queryExecution().executedPlan().toString()


def test_rings_at_once_keep_what_each_line_keeps():
    rng = np.random.default_rng(3)
    rings = [rng.normal(0, 1, (n, 2)).round(1) for n in (3, 5, 4, 40, 6, 5)] + [np.zeros((7, 2))]
    for tolerance in (0.0, 0.4, 1.5, 9.0):
        want = []
        for r in rings:
            keep = np.ones(len(r), bool)
            if len(r) > 4:
                far = int(((r - r[0]) ** 2).sum(1).argmax())
                k = np.concatenate([zonal._kept(r[: far + 1], tolerance)[:-1], zonal._kept(np.vstack([r[far:], r[:1]]), tolerance)[:-1]])
                keep = k if k.sum() >= 3 else keep
            want += keep.tolist()
        assert zonal._kept_of_rings(np.concatenate(rings), np.cumsum([len(r) for r in rings]), tolerance).tolist() == want


@pytest.mark.parametrize("name", ["g4_band_regions_every_event", "g4_band_regions_fine_every_event", "g2_band_polygons_every_event", "k6_polygon_features_every_event"])
def test_cells_of_regions_and_polygons_are_not_shuffled(spark, few, name, monkeypatch):
    monkeypatch.setattr(intensity, "surfaces", None)
    assert QUERIES[name](spark, few).columns


@pytest.mark.parametrize("strip", [1, 37, None])
def test_regions_do_not_depend_on_strips(spark, few, strip):
    """Events that lie in one strip and those that reach several, each once."""
    e, cells = queries.canonical(spark, few).cache(), queries.sites(spark)
    runs = contours.region_runs(intensity.banded(intensity.surfaces(cells, e)))
    key = ["event_id", "mmi_lower", F.col("region_id.row").alias("region_row"), F.col("region_id.col").alias("region_col")]
    want = runs.groupBy(*key).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n_cells"), F.min("row"), F.max("row"), F.min("c0"), F.max("c1")).collect()
    got = queries.strips.region_digests(cells, e, queries.GRID, strip).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.event_id for r in got}) > 3
    by = queries.strips.Parted(e, queries.GRID, strip=strip)
    assert (by.others.count() == 0) == (strip is None)


@pytest.mark.parametrize("strip", [37, None])
def test_polygons_do_not_depend_on_strips(spark, few, strip):
    e, cells = queries.canonical(spark, few).cache(), queries.sites(spark)
    rings = contours.band_rings(intensity.surfaces(cells, e, margin=fixtures.STEP + 0.01), queries.GRID).cache()
    shape = lambda df: sorted((r.event_id, r.mmi_lower, r.hole, round(r.area, 9)) for r in df.collect())
    assert shape(queries.strips.ring_areas(cells, e, queries.GRID, strip=strip)) == shape(rings)
    size = [F.size(F.get("geometry", F.lit(0))).alias("n"), F.transform("geometry", lambda r: F.size(r)).alias("sizes")]
    of = lambda df: sorted((r.event_id, r.mmi_lower, round(r.area, 9), r.n_holes, r.n, sorted(r.sizes)) for r in df.select("*", *size).collect())
    got, want = queries.strips.polygons(cells, e, queries.GRID, strip=strip), contours.band_polygons(rings)
    assert got.schema["geometry"].dataType == want.schema["geometry"].dataType and of(got) == of(want)


@pytest.mark.parametrize("name", ["d1_partial_update", "d2_delete"])
def test_edits_cluster_once(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2, "what clustering checkpoints is read by one clustering only"
    assert plain(df.select(*cols).collect()) == plain(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


def test_surfaces_of_events_alike_are_made_once(spark, few, monkeypatch):
    """Reports of one place, depth and magnitude at other times are events of their own, with the same bands; their surface is made once."""
    e = queries.canonical(spark, few)
    far = [e.withColumns({"id": F.col("id") + n * 1000, "cluster_id": F.col("id") + n * 1000}) for n in range(3)]
    every = far[0].unionByName(far[1]).unionByName(far[2])
    one, each = queries.strips.alike(every)
    assert one.count() == each.select("like").distinct().count() == each.count() / 3 > 3
    want = {name: sorted(map(tuple, QUERIES[name](spark, few).collect())) for name in ("g2_band_polygons_every_event", "k6_polygon_features_every_event", "k6_band_features")}
    made, real = [], queries.strips.Parted
    monkeypatch.setattr(queries.strips, "Parted", lambda events, *a, **k: made.append(events.count()) or real(events, *a, **k))
    monkeypatch.setattr(queries, "canonical", lambda spark, d: every)
    for name, rows in want.items():
        got = sorted(map(tuple, QUERIES[name](spark, few).collect()))
        assert got == sorted((r[0] + n * 1000, *r[1:]) for r in rows for n in range(3))
    assert made == [one.count()] * 3


@pytest.mark.parametrize("strip", [37, None])
def test_boxes_of_runs_do_not_depend_on_strips(spark, few, strip):
    e, cells = queries.canonical(spark, few).cache(), queries.sites(spark)
    want = intensity.band_features(intensity.banded(intensity.surfaces(cells, e)), fixtures.STEP / 2)
    got = queries.strips.band_features(cells, e, fixtures.STEP / 2, queries.GRID, strip)
    rows = lambda df: sorted((r.event_id, r.mmi_lower, r.feature) for r in df.select("event_id", "mmi_lower", "feature").collect())
    assert rows(got) == rows(want) and len({r.event_id for r in got.collect()}) > 3


def test_pairs_are_held_one_at_a_time(monkeypatch):
    """However many pairs a task gets, only the surfaces of one are there at a time."""
    import weakref

    import pyarrow as pa

    strips, alive, most = queries.strips, weakref.WeakSet(), []

    class Here:
        def __init__(self, rows):
            pass

        def boxes(self, events):
            for n in range(events.num_rows):
                box = strips.Box(0, n % 3, np.full((2, 2), 1.0))
                alive.add(box)
                most.append(len(alive))
                yield n, box
                del box

    monkeypatch.setattr(strips, "Raster", Here)
    pairs = 50
    events = pa.table({"first_id": [*range(pairs)] * 2, "second_id": [*range(1, pairs + 1)] * 2, "later": [False] * pairs + [True] * pairs})
    assert len(list(strips._differences((), events, None))) == pairs and max(most) <= 5
