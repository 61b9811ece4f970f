"""Catalogue queries and changes: filters, order, pages, copy-on-write edits, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ALERT_RANK, COVERAGE_BBOX, EXPORT_COLUMNS


def in_coverage(lon: Column, lat: Column) -> Column:
    x0, y0, x1, y1 = COVERAGE_BBOX
    return lon.between(x0, x1) & lat.between(y0, y1)


def where(since_us=None, mag_min=None, mag_max=None, source=None, search=None, after_us=None, before_us=None) -> Column:
    """The conjunction of the given filters and of being canonical. ``search`` may hold the wildcards % and _."""
    c = F.col("is_canonical")
    time, size = F.col("occurred_us"), F.col("magnitude")
    tests = [
        (since_us, time >= F.lit(since_us)), (after_us, time >= F.lit(after_us)), (before_us, time <= F.lit(before_us)),
        (mag_min, size >= F.lit(mag_min)), (mag_max, size <= F.lit(mag_max)), (source, F.col("source") == F.lit(source)),
    ]
    for given, test in tests:
        if given is not None:
            c = c & test
    return c & F.col("place").ilike(f"%{search}%") if search is not None else c


def ordered(df: DataFrame, by: str = "time") -> DataFrame:
    """Newest first, unless ``by`` is time-asc or magnitude; ties by id."""
    first = {"time-asc": F.asc("occurred_us"), "magnitude": F.desc("magnitude")}.get(by, F.desc("occurred_us"))
    return df.orderBy(first, "id")


def next_events(df: DataFrame) -> DataFrame:
    """(first_id, second_id): each event and the one after it in time, ties by id. The last event of a day takes the
    first one of the next day that has any, so that only days are put in order in one task."""
    at = df.select(F.floor(F.col("occurred_us") / 86_400_000_000).alias("day"), F.struct("occurred_us", "id").alias("at"))
    days = at.groupBy("day").agg(F.min("at").alias("first")).select("day", F.lead("first.id").over(Window.orderBy("day")).alias("next_day"))
    inside = at.select("day", F.col("at.id").alias("first_id"), F.lead("at.id").over(Window.partitionBy("day").orderBy("at")).alias("later"))
    return inside.join(days, "day").select("first_id", F.coalesce("later", "next_day").alias("second_id")).filter("second_id IS NOT NULL")


def page(df: DataFrame, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Rows of a page; without a limit everything, whatever the offset."""
    return df if limit is None else df.offset(offset).limit(limit)


def fetch_query(df: DataFrame, start_us=None, end_us=None, updated_after_us=None, min_magnitude=None, event_type: str | None = None, cap: int | None = None) -> DataFrame:
    """What a provider returns for a query: filters that reach the scan, newest first up to ``cap``."""
    for col, op, v in (("occurred_us", ">=", start_us), ("occurred_us", "<=", end_us), ("updated_us", ">=", updated_after_us), ("magnitude", ">=", min_magnitude)):
        if v is not None:
            df = df.filter(F.col(col) >= v if op == ">=" else F.col(col) <= v)
    if event_type is not None:
        df = df.filter(F.col("event_type") == event_type)
    df = df.filter(in_coverage(F.col("lon"), F.col("lat")))
    return df.orderBy(F.desc("occurred_us"), "id").limit(cap) if cap else df


def validate(df: DataFrame) -> DataFrame:
    """Adds reject_reason: null for a valid request row, else the first rule that it breaks."""
    rules = (
        ("magnitude", F.col("magnitude").isNull() | ~F.col("magnitude").between(0, 10)),
        ("depth", F.col("depth_km").isNull() | ~F.col("depth_km").between(0, 700)),
        ("region", F.col("lon").isNull() | F.col("lat").isNull() | ~in_coverage(F.col("lon"), F.col("lat"))),
        ("source", F.col("source").isNull() | ~F.col("source").isin("MET", "USGS", "MANUAL")),
    )
    reason = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        reason = F.when(bad, name).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def constrained(df: DataFrame) -> DataFrame:
    """Adds reject_reason to rows of a catalogue: null for a row that may be stored, else why it may not."""
    missing = F.lit(False)
    for c in ("occurred_us", "magnitude", "depth_km", "lon", "lat"):
        missing = missing | F.col(c).isNull()
    wrong = F.col("source").isNull() | ~F.col("source").isin("MET", "USGS", "MANUAL")
    return df.withColumn("reject_reason", F.when(wrong, "source").when(missing, "missing"))


def update(catalog: DataFrame, patches: DataFrame) -> DataFrame:
    """Applies patches (id, magnitude, depth_km, lon, lat, occurred_us; null: no change). lon and lat change together only."""
    p = patches.select(F.col("id").alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in ("magnitude", "depth_km", "lon", "lat", "occurred_us")])
    both = F.col("p_lon").isNotNull() & F.col("p_lat").isNotNull()
    new = {c: F.coalesce(f"p_{c}", c) for c in ("magnitude", "depth_km", "occurred_us")} | {c: F.when(both, F.col(f"p_{c}")).otherwise(F.col(c)) for c in ("lon", "lat")}
    return catalog.join(p, F.col("id") == F.col("p_id"), "left").withColumns(new).select(*catalog.columns)


def delete(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the given ids. Clusters stay as they are until the next ingest."""
    return catalog.join(ids.select("id"), "id", "left_anti")


def upsert_latest(state: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Key and value: the change if there is one, else what was there."""
    both = state.select(key, value, F.lit(0).alias("__n")).unionByName(changes.select(key, value, F.lit(1).alias("__n")))
    return both.groupBy(key).agg(F.max_by(value, F.struct("__n", value)).alias(value))


def manual_event(catalog: DataFrame, rows: DataFrame, now_us: Column) -> DataFrame:
    """Manual rows (magnitude, depth_km, lon, lat, occurred_us) as catalogue rows with ids after the largest one."""
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    n = F.row_number().over(Window.orderBy("occurred_us", "lon", "lat", "magnitude"))  # a form's few rows
    return rows.withColumn("n", n).crossJoin(top).select(
        (F.col("top") + F.col("n")).alias("id"), F.lit("MANUAL").alias("source"), F.coalesce("occurred_us", now_us).alias("occurred_us"),
        "magnitude", "depth_km", "lon", "lat", (F.col("top") + F.col("n")).alias("cluster_id"), F.lit(True).alias("is_canonical"),
    )


def geojson_points(df: DataFrame) -> DataFrame:
    """(id, feature): one GeoJSON feature a row, null properties left out, rows without a place on earth left out."""
    props = F.struct(*[c for c in df.columns if c not in ("is_canonical", "cluster_id")])
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties")))
    return df.filter("lon IS NOT NULL AND lat IS NOT NULL").select("id", feature.alias("feature"))


def export_rows(df: DataFrame) -> DataFrame:
    """The columns of ``EXPORT_COLUMNS``, newest first; occurred_at is ISO text in UTC."""
    at = F.expr("CAST(timestampadd(MICROSECOND, occurred_us, TIMESTAMP_NTZ'1970-01-01 00:00:00') AS string)")
    return ordered(df).select(*[F.concat(F.replace(at, F.lit(" "), F.lit("T")), F.lit("Z")).alias(c) if c == "occurred_at" else F.col(c) for c in EXPORT_COLUMNS])


def write_csv(df: DataFrame, path: str) -> None:
    """The export as CSV with a header in each file; files are in order of time, newest first."""
    export_rows(df).write.mode("errorifexists").option("header", True).csv(path)


def write_geojson(df: DataFrame, path: str) -> None:
    """One GeoJSON feature a line."""
    geojson_points(df).select("feature").write.mode("errorifexists").text(path)


def detail_state(df: DataFrame, detail: str = "detail") -> DataFrame:
    """Adds state: manual, no-detail (another feed), not-cached or cached."""
    s = F.when(F.col("source") == "MANUAL", "manual").when(F.col("source") != "USGS", "no-detail").when(F.col(detail).isNull(), "not-cached").otherwise("cached")
    return df.withColumn("state", s)


def detail_products(df: DataFrame, detail: str = "detail") -> DataFrame:
    """Adds has_<product>: the document's product list is there and isn't empty."""
    v = F.parse_json(F.col(detail))
    for p in ("shakemap", "moment-tensor", "dyfi", "focal-mechanism"):
        n = F.size(F.try_variant_get(v, f"$.products['{p}']", "array<variant>"))
        df = df.withColumn("has_" + p.replace("-", "_"), F.coalesce(n > 0, F.lit(False)))
    return df


def alert_rank(alert: Column) -> Column:
    out = F.lit(0)
    for name, r in ALERT_RANK.items():
        out = F.when(alert == name, r).otherwise(out)
    return out
