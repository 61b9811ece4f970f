"""One stored catalogue: ingest of landing folders by batch or as streams, and edits; parse, insert if absent, cluster what is near."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import CATALOG_COLUMNS
from ..operators import catalog as edits
from ..operators import dedup
from ..sources.feeds import Feed

DAY_US = 86_400_000_000
SYNC = "source string, last_us long, fetched long, inserted long, errors long"
REJECTED = "source_event_id string, reason string, document string, source string, batch long"
PENDING = "id long, day int"
_STORED = ", ".join(f"{c} {t}" for c, t in CATALOG_COLUMNS.items()) + ", day int"
_PLACE = ["id", "source", "occurred_us", "lon", "lat", "cluster_id"]
#: Writers of one catalogue take turns. That holds within a process: a catalogue has one writing process.
_turns: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)


def _day() -> Column:
    return F.floor(F.col("occurred_us") / DAY_US).cast("int")


class Catalogue:
    """A catalogue in a folder that the cluster shares: Parquet, one folder a day, so that filters on time and any other
    column reach the files. Beside it lie the state of each source, the rows that were rejected (by source and batch), and
    while a change is being written the ids that it touches: who finds those there clusters around them again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # storage

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        place, files = self._place(name)
        return files.exists(place)

    def _drop(self, name: str) -> None:
        place, files = self._place(name)
        files.delete(place, True)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._there(name) else self.spark.createDataFrame([], schema)

    def _whole(self) -> DataFrame:
        return self._table("catalog", _STORED)

    def _pending(self) -> DataFrame:
        """(id, day) that an unfinished change touched; read by the marker that is written last."""
        return self._table("pending", PENDING).distinct() if self._there("pending/_SUCCESS") else self.spark.createDataFrame([], PENDING)

    def _around(self, days: Iterable[int]) -> list[int]:
        return sorted({d + n for d in days for n in (-1, 0, 1)})

    def _put(self, state: DataFrame, days: list[int], touched: DataFrame) -> DataFrame:
        """Replaces the folders of ``days`` by ``state``, which is written aside first; days without a row lose their folder.
        Returns the rows as they lie aside. ``touched`` (id, day) join those that are pending, until ``_done``."""
        touched.write.mode("append").parquet(f"{self.path}/pending")
        state.withColumn("day", _day()).write.mode("overwrite").parquet(f"{self.path}/aside")
        aside = self.spark.read.schema(_STORED).parquet(f"{self.path}/aside")
        rows = aside.hint("rebalance", "day")  # a file a day, more for a day with many reports
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/catalog")
        left = {r["day"] for r in aside.select("day").distinct().collect()}  # days of a change
        for day in set(days) - left:
            self._drop(f"catalog/day={day}")
        return aside

    def _done(self) -> None:
        self._drop("pending")

    # reading

    def read(self, since_us: int | None = None, before_us: int | None = None) -> DataFrame:
        """The catalogue's rows; the bounds are on occurred_us, inclusive, and leave other days' folders unread."""
        rows = self._whole()
        if since_us is not None:
            rows = rows.filter((F.col("day") >= since_us // DAY_US) & (F.col("occurred_us") >= since_us))
        if before_us is not None:
            rows = rows.filter((F.col("day") <= before_us // DAY_US) & (F.col("occurred_us") <= before_us))
        return rows.select(*CATALOG_COLUMNS)

    def find(self, since_us: int | None = None, before_us: int | None = None, by: str = "time", limit: int | None = 100, offset: int = 0, **filters) -> DataFrame:
        """A page of the canonical events that pass ``catalog.where``'s filters, in order; other days' folders stay unread."""
        rows = self.read(since_us, before_us).filter(edits.where(since_us=since_us, before_us=before_us, **filters))
        return edits.page(edits.ordered(rows, by), limit, offset)

    def sync_state(self) -> DataFrame:
        """(source, last_us, fetched, inserted, errors) of each source's last batch."""
        return self._table("sync", SYNC).select(*(c.split()[0] for c in SYNC.split(", ")))

    def rejected(self) -> DataFrame:
        """(source, batch, source_event_id, reason, document) of the rows that were left out."""
        return self._table("rejected", REJECTED).select("source", "batch", "source_event_id", "reason", "document")

    # changes

    def replace(self, reports: DataFrame) -> None:
        """Stores reports that have ids already in place of the whole catalogue, clustered anew."""
        with _turns[self.path]:
            state = dedup.cluster(dedup.conform(reports)).select(*CATALOG_COLUMNS).withColumn("day", _day())
            state.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(f"{self.path}/catalog")
            self._done()

    def add(self, arrivals: DataFrame, source: str, now_us: int | None = None, rejected: DataFrame | None = None, batch: int | None = None) -> None:
        """Inserts arrivals and clusters what is near those that are new, then notes the source's progress.

        Arrivals that the catalogue can't hold (``catalog.constrained``) are put with the ``rejected`` (source_event_id, reason, document);
        a batch that runs again replaces its own rejected rows. Of the catalogue, all ids are read, but rows only of the days
        of what is new and the days beside them, and only these days' folders are replaced. Without anything new, only the
        progress is written. A run again after a failure gives the same rows: what an unfinished run touched is clustered again.
        """
        now_us = time.time_ns() // 1000 if now_us is None else now_us
        with _turns[self.path]:
            judged = edits.constrained(dedup.conform(arrivals)).persist()
            try:
                good = judged.filter("reject_reason IS NULL").drop("reject_reason")
                bad = judged.filter("reject_reason IS NOT NULL").select("source_event_id", F.col("reject_reason").alias("reason"), F.to_json(F.struct(*CATALOG_COLUMNS)).alias("document"))
                bad = (bad if rejected is None else bad.unionByName(rejected)).withColumns({"source": F.lit(source), "batch": F.lit(now_us if batch is None else batch)})
                errors = self._put_rejected(bad)
                n_new = self._insert(good, now_us)
                note = self.spark.createDataFrame([(source, now_us, judged.count(), n_new, errors)], SYNC)
                note.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{self.path}/sync")
                self._done()
            finally:
                judged.unpersist()

    def _put_rejected(self, bad: DataFrame) -> int:
        """Writes rejected rows in their batch's folder and returns their number."""
        bad = bad.persist()
        try:
            n = bad.count()
            if n:
                bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "batch").parquet(f"{self.path}/rejected")
            return n
        finally:
            bad.unpersist()

    def _insert(self, arrivals: DataFrame, now_us: int) -> int:
        """Inserts what is new of ``arrivals``; returns its number."""
        whole, pending = self._whole(), self._pending()
        fresh = dedup.insert_if_absent(whole, arrivals, ["occurred_us", "magnitude", "lon", "lat"]).persist()
        try:
            days = {r["day"] for r in fresh.select(_day().alias("day")).union(pending.select("day")).distinct().collect()}  # days of a batch
            if not days:
                return 0
            top = whole.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
            days = self._around(days)
            here = whole.filter(F.col("day").isin(days)).drop("day")
            again = here.join(pending.select("id"), "id", "left_semi").select(*_PLACE)
            new = dedup.inserted(fresh, now_us, top)
            state = dedup.recluster(dedup.conform(here).unionByName(new), new.select(*_PLACE).unionByName(again))
            aside = self._put(state, days, new.select("id", _day().alias("day")))
            return aside.filter(F.col("id") > top).count()
        finally:
            fresh.unpersist()

    def _change(self, ids: DataFrame, make) -> int:
        """Replaces the rows of ``ids`` by ``make`` of them, and clusters what is near their old and new places. Only the days
        of both, and those beside them, are read and replaced. Returns how many of the ids there were."""
        with _turns[self.path]:
            whole, pending = self._whole(), self._pending()
            old = whole.join(ids.select("id").distinct(), "id", "left_semi").persist()
            try:
                n = old.count()
                if not n:
                    return 0
                new = dedup.conform(make(old.drop("day"))).persist()
                days = {r["day"] for r in old.select("day").union(new.select(_day().alias("day"))).union(pending.select("day")).distinct().collect()}
                days = self._around(days)
                here = whole.filter(F.col("day").isin(days)).drop("day")
                state = dedup.conform(here.join(old.select("id"), "id", "left_anti")).unionByName(new)
                again = here.join(pending.select("id"), "id", "left_semi").select(*_PLACE)
                touched = old.select(*_PLACE).unionByName(new.select(*_PLACE)).unionByName(again)
                named = old.select("id", "day").unionByName(new.select("id", _day().alias("day")))
                self._put(dedup.recluster(state, touched), days, named)
                self._done()
                return n
            finally:
                old.unpersist()

    def update(self, patches: DataFrame) -> int:
        """Applies patches (id, magnitude, depth_km, lon, lat, occurred_us; null: no change); an event may move to another
        day. Returns how many events there were."""
        return self._change(patches, lambda old: edits.update(old, patches))

    def delete(self, ids: DataFrame) -> int:
        """Takes events (id) out; returns how many there were. What was near them is clustered anew."""
        return self._change(ids, lambda old: old.limit(0))

    def add_manual(self, rows: DataFrame, now_us: int | None = None) -> int:
        """Adds manual events (magnitude, depth_km, lon, lat, occurred_us; null time: now), each a cluster of its own; returns
        their number. A row that breaks a rule of ``catalog.validate`` is an error, and nothing is added."""
        now_us = time.time_ns() // 1000 if now_us is None else now_us
        with _turns[self.path]:
            whole, unfinished = self._whole(), self._there("pending/_SUCCESS")
            new = dedup.conform(edits.manual_event(whole, rows, F.lit(now_us))).withColumn("created_us", F.lit(now_us)).persist()
            try:
                wrong = edits.validate(new).filter("reject_reason IS NOT NULL").select("reject_reason").first()
                if wrong:
                    raise ValueError(f"manual event: {wrong[0]}")
                days = sorted({r["day"] for r in new.select(_day().alias("day")).distinct().collect()})
                here = whole.filter(F.col("day").isin(days)).drop("day")
                self._put(dedup.conform(here).unionByName(new), days, new.select("id", _day().alias("day")))
                if not unfinished:  # else the next change clusters what that one left
                    self._done()
                return new.count()
            finally:
                new.unpersist()


def ingest(catalogue: Catalogue, feeds: list[Feed], since: int | None = None) -> list[tuple[str, str | None]]:
    """One batch run of each feed into the catalogue, in order of priority. Returns (name, error or None) of each: a feed
    that can't be read doesn't stop the others. A feed that isn't a snapshot is asked for what changed since its last sync."""
    out: list[tuple[str, str | None]] = []
    state = {r["source"]: r["last_us"] for r in catalogue.sync_state().collect()}  # one row a source
    for feed in by_priority(feeds):
        try:
            docs = feed.documents(catalogue.spark)
            catalogue.add(feed.rows(docs, since, state.get(feed.name)), feed.name, rejected=feed.rejected(docs))
            out.append((feed.name, None))
        except (PySparkException, Py4JJavaError) as e:
            out.append((feed.name, str(e)))
    return out


def by_priority(feeds: list[Feed]) -> list[Feed]:
    order = {name: n for n, name in enumerate(dedup.SOURCE_PRIORITY)}
    return sorted(feeds, key=lambda f: (order.get(f.name, len(order)), f.name))


def start_ingest(catalogue: Catalogue, feed: Feed, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One streaming query for one feed, so that a feed that fails doesn't stop the others; several may write one catalogue.

    The checkpoint holds what has been taken; it moves on only when a batch has ended. ``every``: trigger interval
    ("15 minutes"), the first batch at once; without it, all that has landed is taken and the query ends.
    """
    take = lambda docs, n: catalogue.add(feed.rows(docs), feed.name, rejected=feed.rejected(docs), batch=n)
    out = feed.stream(catalogue.spark).writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{feed.name}")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def tick(catalogue: Catalogue, feeds: list[Feed], checkpoint: str) -> list[tuple[str, str | None]]:
    """Takes all that has landed, one feed after the other in order of priority. Returns (name, error or None) of each."""
    out: list[tuple[str, str | None]] = []
    for feed in by_priority(feeds):
        try:
            start_ingest(catalogue, feed, checkpoint).awaitTermination()
            out.append((feed.name, None))
        except (PySparkException, Py4JJavaError) as e:
            out.append((feed.name, str(e)))
    return out
