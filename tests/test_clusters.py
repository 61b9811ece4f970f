"""Clusters by cell minima against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite.operators import dedup

REPORTS = "id long, source string, occurred_us long, lon double, lat double"
R = 6_371_008.8


def brute(rows):
    """The least id within 60 s and 50 km of each report of a feed."""
    ids, us, lon, lat = (np.array([r[k] for r in rows if r[1] != "MANUAL"]) for k in (0, 2, 3, 4))
    x, y = np.radians(lon), np.radians(lat)
    out = {}
    for n in range(len(ids)):
        h = np.sin((y - y[n]) / 2) ** 2 + np.cos(y) * np.cos(y[n]) * np.sin((x - x[n]) / 2) ** 2
        near = (np.abs(us - us[n]) <= 60_000_000) & (2 * R * np.arcsin(np.sqrt(np.minimum(1, h))) <= 50_000)
        out[int(ids[n])] = int(ids[near].min())
    return out


def found(spark, rows, geodesic="haversine"):
    df = spark.createDataFrame(rows, REPORTS).repartition(6)
    return {r.id: r.cluster_id for r in dedup.cluster_ids(df, geodesic).collect()}


@pytest.mark.parametrize("at", [(70.0, 30.0), (179.9, -0.05), (-179.95, 68.0), (10.0, 89.3)])
def test_dense_reports_are_compared_as_all_pairs_would(spark, at):
    rng = np.random.default_rng(2)
    n = 2500
    lon, lat = at[0] + rng.normal(0, 0.6, n), np.minimum(at[1] + rng.normal(0, 0.4, n), 90.0)
    lon = (lon + 180) % 360 - 180
    us = rng.integers(0, 300, n) * 1_000_000
    order = np.argsort(us + rng.integers(0, 200_000_000, n))  # ids follow time, roughly
    ids = np.empty(n, int)
    ids[order] = np.arange(1, n + 1)
    rows = [(int(ids[k]), ["USGS", "MET", "USGS", "MANUAL"][k % 4], int(us[k]), float(lon[k]), float(lat[k])) for k in range(n)]
    assert found(spark, rows) == brute(rows)


def test_a_swarm_of_one_minute_and_place_is_never_paired(spark):
    rng = np.random.default_rng(3)
    n = 50_000
    rows = [(int(i), "USGS", int(u), float(x), float(y)) for i, u, x, y in zip(rng.permutation(n) + 10, rng.integers(0, 29_000_000, n), rng.uniform(70.21, 70.39, n), rng.uniform(30.21, 30.39, n), strict=True)]
    rows += [(1, "MET", 10_000_000, 70.3, 30.3), (2, "USGS", 85_000_000, 70.3, 30.3), (3, "USGS", 500_000_000, 70.3, 30.3)]
    df = spark.createDataFrame(rows, REPORTS)
    got = dedup.cluster_ids(df)
    assert got.filter("id > 3 AND cluster_id = 1").count() == n
    few = {r.id: r.cluster_id for r in got.filter("id <= 3").collect()}
    late = [r[0] for r in rows if 25_000_000 <= r[2] <= 145_000_000]
    assert few == {1: 1, 2: min(late), 3: 3}
    # a swarm over many minutes, ids in order of time: each report sees those of the minute before it
    rows = [(k + 1, "USGS", k * 100_000, 70.3, 30.3) for k in range(20_000)]
    assert found(spark, rows) == {k + 1: max(0, k - 600) + 1 for k in range(20_000)}


def test_spheroid_and_manual_reports(spark):
    rows = [(5, "USGS", 0, 70.0, 30.0), (4, "USGS", 0, 70.0, 30.45), (3, "MANUAL", 0, 70.0, 30.0)]
    rows += [(k, "USGS", 0, 70.0 + k * 1e-4, 30.0) for k in range(10, 30)]
    pairs = dedup.neighbour_pairs(spark.createDataFrame(rows, REPORTS), "lambert").groupBy("id").agg(F.min("other_id").alias("c"))
    assert found(spark, rows, "lambert") == {r.id: r.c for r in pairs.collect()}
    assert found(spark, []) == {}


def test_reports_of_one_instant_and_place_stand_once(spark, monkeypatch):
    """Copies, however many, neither enlarge cells nor meet each other."""
    rng = np.random.default_rng(5)
    points = [(int(rng.integers(0, 200)) * 1_000_000, 70 + float(rng.normal(0, 0.4)), 30 + float(rng.normal(0, 0.3))) for _ in range(40)]
    ids = rng.permutation(40 * 30) + 1
    rows = [(int(ids[k]), ["USGS", "MET", "MANUAL"][k // 40 % 3], *points[k % 40]) for k in range(40 * 30)]
    near, met = dedup._in_buckets_near, []
    monkeypatch.setattr(dedup, "_in_buckets_near", lambda boxes: met.append(boxes.agg(F.sum("n")).first()[0]) or near(boxes))
    assert found(spark, rows) == brute(rows) and met == [40]


def test_reports_near_a_change_are_never_paired(spark, monkeypatch):
    """Copies at few instants and places, a share of them moved: as if clustered anew."""
    rng = np.random.default_rng(5)
    n = 6000
    at = [(int(rng.integers(0, 900)) * 1_000_000, 60 + float(rng.uniform(0, 3)), 30 + float(rng.uniform(0, 2))) for _ in range(60)]
    rows = [(k + 1, "MANUAL" if k % 10 == 9 else ["USGS", "MET"][k % 2], *at[int(rng.integers(0, 60))]) for k in range(n)]
    before = dedup.cluster(spark.createDataFrame(rows, REPORTS)).cache()
    moved = before.withColumn("occurred_us", F.when(F.col("id") % 11 == 0, F.col("occurred_us") + 130_000_000).otherwise(F.col("occurred_us"))).filter("id % 13 <> 0")
    touched = before.filter("id % 11 = 0 OR id % 13 = 0").unionByName(moved.filter("id % 11 = 0"))
    monkeypatch.setattr(dedup, "near_pairs", None)
    found = lambda df: sorted(map(tuple, df.select("id", "cluster_id", "is_canonical").collect()))
    assert found(dedup.recluster(moved, touched)) == found(dedup.cluster(moved))


def test_reports_that_share_an_id_are_not_multiplied(spark):
    """Ids of echoes meet those of events above ten million events; each report keeps the cluster of its own place."""
    rows = [(7, "USGS", 0, 70.0, 30.0), (7, "MET", 900_000_000, 80.0, 40.0), (7, "MANUAL", 0, 70.0, 30.0), (3, "USGS", 10_000_000, 70.1, 30.1), (9, "MET", 910_000_000, 80.1, 40.1), (1, "USGS", None, 70.0, 30.0)]
    got = dedup.cluster(spark.createDataFrame(rows, REPORTS)).select("id", "source", "occurred_us", "cluster_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, "USGS", 0, 3), (7, "MET", 900_000_000, 7), (7, "MANUAL", 0, 7), (3, "USGS", 10_000_000, 3), (9, "MET", 910_000_000, 7), (1, "USGS", None, 1)], key=str)


def test_distances_close_to_the_limit_and_instants_before_1970(spark):
    """Single reports around 50 km from each other, and cells of several, at places of all signs."""
    rng = np.random.default_rng(8)
    rows, ids = [], iter(rng.permutation(100_000) + 1)
    for n in range(150):
        us, lon, lat = int(rng.integers(-(10**15), 10**15)), float(rng.uniform(-180, 180)), float(rng.uniform(-85, 85))
        for _ in range(8):
            km, way = rng.choice([0.0, 49.0, 49.999, 50.001, 51.0]) + rng.choice([0.0, 0.0004]), rng.uniform(0, 2 * np.pi)
            y = lat + np.degrees(km * 1000 / R) * np.sin(way)
            x = lon + np.degrees(km * 1000 / R) * np.cos(way) / np.cos(np.radians((lat + y) / 2))
            rows.append((int(next(ids)), "USGS", us + int(rng.choice([0, 1, 30_000_000, 60_000_000, 60_000_001])), float((x + 180) % 360 - 180), float(y)))
    assert found(spark, rows) == brute(rows)
