"""Event feeds: JSON documents in a landing folder to clean rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import coordinate, first_number, met_datetime
from ..operators.catalog import in_coverage
from ..operators.dedup import first_seen

USGS_SCHEMA = """features array<struct<id:string, properties:struct<mag:double,time:bigint,updated:bigint,place:string,magType:string,type:string,
    alert:string,tsunami:int,sig:int,status:string,felt:int,cdi:double,mmi:double,gap:double,nst:int,url:string,detail:string>, geometry:struct<type:string,coordinates:array<double>>>>"""
MET_SCHEMA = """data array<struct<id:bigint,mode:string,region:string,event_date:string,event_time:string,magnitude:string,depth:string,latitude:string,longitude:string>>"""


class Source(Protocol):
    """A feed: its name, and its rows since an instant or updated after one (microseconds)."""

    name: str

    def fetch(self, spark: SparkSession, since: int | None = None, updated_after: int | None = None) -> DataFrame: ...


def _usgs_features(docs: DataFrame) -> DataFrame:
    f = docs.select(F.explode("features").alias("f")).select("f.id", "f.properties.*", F.col("f.geometry.coordinates").alias("xyz"), F.to_json("f").alias("document"))
    return f.withColumns({"lon": F.get("xyz", F.lit(0)), "lat": F.get("xyz", F.lit(1)), "depth_km": F.get("xyz", F.lit(2))})


def usgs_reason() -> Column:
    """Why a feature of the first feed is rejected, first rule first; null: it isn't."""
    missing = (F.size("xyz") < 3) | F.col("xyz").isNull() | F.col("mag").isNull() | F.col("time").isNull() | F.col("id").isNull()
    return F.when(missing, "missing").when(~F.coalesce(in_coverage(F.col("lon"), F.col("lat")), F.lit(False)), "region")


def parse_usgs(docs: DataFrame, rejected: bool = False) -> DataFrame:
    """Rows of GeoJSON documents (column features): three coordinates, magnitude, time and id are needed, and a place in the region.
    ``rejected`` gives the others: (source_event_id, reason, document)."""
    f = _usgs_features(docs).withColumn("reason", usgs_reason())
    if rejected:
        return f.filter("reason IS NOT NULL").select(F.col("id").alias("source_event_id"), "reason", "document")
    return f.filter("reason IS NULL").select(
        F.lit("USGS").alias("source"), F.col("id").alias("source_event_id"), (F.col("time") * 1000).alias("occurred_us"), F.col("mag").alias("magnitude"), "depth_km", "lon", "lat", "place",
        F.col("magType").alias("mag_type"), F.col("type").alias("event_type"), "alert", "tsunami", "sig", F.col("status").alias("review_status"), "felt", "cdi", F.col("mmi").alias("mmi_report"),
        "gap", "nst", "url", F.col("detail").alias("detail_url"), (F.col("updated") * 1000).alias("updated_us"),
    )


def _met_fields(docs: DataFrame) -> DataFrame:
    """One row for each row of the documents' data, with lon, lat, mag, dep and at. These are made inside the array, before
    it unfolds: made afterwards, Spark would copy each expression to wherever its column is read."""
    clean = lambda d: F.struct(
        d.alias("d"), coordinate(d["longitude"], False).alias("lon"), coordinate(d["latitude"], True).alias("lat"), first_number(d["magnitude"]).alias("mag"),
        first_number(d["depth"]).alias("dep"), met_datetime(d["event_date"], d["event_time"]).alias("at"),
    )
    return docs.select(F.explode(F.transform("data", clean)).alias("r")).select("r.d.*", "r.lon", "r.lat", "r.mag", "r.dep", "r.at")


def met_reason(lon: Column, lat: Column) -> Column:
    """Why a row of the second feed is rejected, first rule first; null: it isn't."""
    missing = F.col("id").isNull() | lon.isNull() | lat.isNull() | F.col("mag").isNull()
    return (
        F.when(missing, "missing").when(~lat.between(-90, 90) | ~lon.between(-180, 180), "world").when(~F.col("mag").between(-1, 10), "magnitude")
        .when(~in_coverage(lon, lat), "region").when(F.col("at").isNull(), "date")
    )


def parse_met(docs: DataFrame, rejected: bool = False) -> DataFrame:
    """Rows of the second feed (column data), whose numbers are dirty strings. Depth missing or out of [0, 800]: 0."""
    m = _met_fields(docs).withColumn("reason", met_reason(F.col("lon"), F.col("lat")))
    if rejected:
        return m.filter("reason IS NOT NULL")
    depth = F.when(F.col("dep").between(0, 800), F.col("dep")).otherwise(0.0)
    return m.filter("reason IS NULL").select(
        F.lit("MET").alias("source"), F.col("id").cast("string").alias("source_event_id"), F.col("at").alias("occurred_us"), F.col("mag").alias("magnitude"),
        depth.alias("depth_km"), "lon", "lat", F.col("region").alias("place"),
    )


def rejected_met(docs: DataFrame) -> DataFrame:
    """(source_event_id, reason, document) of the second feed's rows that ``parse_met`` leaves out."""
    m = parse_met(docs, rejected=True)
    row = F.struct("id", "mode", "region", "event_date", "event_time", "magnitude", "depth", "latitude", "longitude")
    return m.select(F.col("id").cast("string").alias("source_event_id"), "reason", F.to_json(row).alias("document"))


#: What a reader puts a document into that isn't JSON of the feed's form.
CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Feed:
    """A source of documents that land in a folder. ``snapshot``: each document is the whole list, so that what was
    updated since can't be asked for. ``rejects`` gives what ``parse`` leaves out of documents: (source_event_id, reason, document)."""

    name: str
    schema: str
    parse: Callable[[DataFrame], DataFrame]
    landing: str
    snapshot: bool = False
    rejects: Callable[[DataFrame], DataFrame] | None = None

    def _reader(self, reader):
        return reader.schema(f"{self.schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", True)

    def documents(self, spark: SparkSession) -> DataFrame:
        """The documents that have landed."""
        return self._reader(spark.read).json(self.landing)

    def stream(self, spark: SparkSession) -> DataFrame:
        """The documents that land, as a stream."""
        return self._reader(spark.readStream).json(self.landing)

    def rows(self, documents: DataFrame, since: int | None = None, updated_after: int | None = None) -> DataFrame:
        """The rows of documents, since an instant or updated after one (microseconds)."""
        rows = self.parse(documents)
        if updated_after is not None and not self.snapshot:
            rows = rows.filter(F.col("updated_us") >= updated_after)
        return rows if since is None else rows.filter(F.col("occurred_us") >= since)

    def fetch(self, spark: SparkSession, since: int | None = None, updated_after: int | None = None) -> DataFrame:
        """The rows that have landed, since an instant or updated after one (microseconds)."""
        return self.rows(self.documents(spark), since, updated_after)

    def rejected(self, documents: DataFrame) -> DataFrame:
        """(source_event_id, reason, document) of what the rows of documents leave out; a document that can't be parsed is one."""
        body = self.schema.split()[0]
        broken = documents.filter(F.col(CORRUPT).isNotNull() & F.col(body).isNull()).select(F.lit(None).cast("string").alias("source_event_id"), F.lit("document").alias("reason"), F.col(CORRUPT).alias("document"))
        return broken.unionByName(self.rejects(documents)) if self.rejects else broken


def usgs(landing: str) -> Feed:
    return Feed("USGS", USGS_SCHEMA, parse_usgs, landing, rejects=lambda docs: parse_usgs(docs, rejected=True))


def met(landing: str) -> Feed:
    return Feed("MET", MET_SCHEMA, parse_met, landing, snapshot=True, rejects=rejected_met)


def fetch_windows(bounds: DataFrame, days: int = 1) -> DataFrame:
    """(n, start_us, end_us): consecutive windows of ``days`` from start_us to now_us, the last one cut off; one at least."""
    step = days * 86_400_000_000
    n = F.greatest(F.lit(1), F.ceil((F.col("now_us") - F.col("start_us")) / step)).cast("int")
    w = bounds.select("start_us", "now_us", F.explode(F.sequence(F.lit(0), n - 1)).alias("n"))
    return w.select("n", (F.col("start_us") + F.col("n") * step).alias("start_us"), F.least(F.col("start_us") + (F.col("n") + 1) * step, F.col("now_us")).alias("end_us"))


def merge_chunks(rows: DataFrame) -> DataFrame:
    """Rows of several windows (column chunk) without repeats: the first chunk's report of an id stays, the earliest in it."""
    return first_seen(rows, "source_event_id", ["chunk", "occurred_us", "magnitude"])


#: Conditions of errors by which a source, not the code that reads it, is at fault.
UNREADABLE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "CANNOT_LOAD_CHECKPOINT_FILE_MANAGER")


def unreadable(e: Exception) -> bool:
    """If an error says that files aren't there or can't be read. A task's error reaches Python as one of Java, with the
    reason among its causes."""
    if isinstance(e, PySparkException):
        return any(c in f"{e.getCondition()} {e}" for c in UNREADABLE)
    cause = e.java_exception if isinstance(e, Py4JJavaError) else None
    while cause is not None:
        if any(c in str(cause) for c in UNREADABLE):
            return True
        cause = cause.getCause()
    return False


def with_fallback(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """The first source's rows, or the second's if the first can't be read: no such path, or files that can't be read.

    Both are calls that return a DataFrame. Any other error is raised: it isn't the source's. All rows are read to find
    out, as any file may be the damaged one.
    """
    try:
        df = primary()
        df.write.format("noop").mode("overwrite").save()
        return df
    except (PySparkException, Py4JJavaError) as e:
        if not unreadable(e):
            raise
        return fallback()
