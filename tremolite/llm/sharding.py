"""Sharding along a Hilbert curve: documents that are alike in several dimensions share files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged

#: Bits of each of the three dimensions; the curve has 2 ** 18 cells, however many documents there are.
BITS, SHARDS, ROW_BYTES, GROUP_ROWS = 6, 40, 16, 4096


def hilbert_index(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``coords``, whose columns are dimensions of ``bits`` bits.

    Coordinates become the curve's transposed form, one bit plane at a time from the highest: a set bit inverts the
    lower bits of the first axis, a clear one swaps them with those of the first axis. A Gray decoding ends it.
    """
    x = [coords[:, d].astype(np.int64) for d in range(coords.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(n):
            up = (x[d] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            index = (index << 1) | (((x[d] ^ flip) >> b) & 1)
    return index


def _curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, size, text_crc32 and three coordinates to doc_id, size, text_crc32 and cell."""
    for batch in batches:
        coords = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)], axis=1)
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(hilbert_index(coords).astype(np.int32))], names=["doc_id", "size", "text_crc32", "cell"])


def places(df: DataFrame, column: str, n: int = 1 << BITS) -> Column:
    """The place of each value of a category among ``n``, in order of name, so that neighbours are alike in name.

    The n - 1 most frequent values have a place of their own, or share one only with rarer values that come next by name;
    null, and what comes before all of them, is at 0. The names are those few that the driver asks for.
    """
    value = F.col(column).cast("string")
    named = df.select(value.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "v").limit(n - 1)
    found = [r.v for r in named.collect()]  # n - 1 at most
    rank = F.size(F.filter(F.array(*map(F.lit, found)).cast("array<string>"), lambda x: x <= value))
    return F.coalesce(F.floor(rank * (n - 1) / max(1, len(found))), F.lit(0)).cast("int")  # few values lie far apart


def shard_by_curve(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and cell for each row: runs of the curve of near equal bytes.

    Dimensions: source and language (by ``places``: in order of name) and the logarithm of the size. Order: cell, then a
    group, then doc_id and checksum. A cell of many documents has a group for each ``GROUP_ROWS``, and rows that are equal in
    all this stand as one with their number, so no window holds more than about that. Running sums go from documents to groups
    to cells (at most 2 ** 18 rows, whatever the input), and a document falls in the shard that holds its middle byte.

    Null text: size 16, checksum 0. Null source or language: a value of its own. Rows that repeat a doc_id are
    documents of their own. An empty table gives an empty table; of few documents, shards may stay empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(t).cast("long") + ROW_BYTES
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), places(df, source).alias("a"), places(df, lang).alias("b"))
    rows = rows.withColumn("c", F.least(F.floor(F.log2("size") * 2), F.lit((1 << BITS) - 1)).cast("int"))
    curve = rows.mapInArrow(_curve, "doc_id long, size long, text_crc32 long, cell int")
    curve = staged(curve.groupBy("doc_id", "size", "text_crc32", "cell").agg(F.count("*").alias("n")), "cells")

    cells = curve.groupBy("cell").agg(F.sum(F.col("size") * F.col("n")).alias("cell_bytes"), F.sum("n").alias("cell_rows"), F.count("*").alias("different"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** 18 rows
    cells = cells.withColumns({"c_bytes": F.coalesce(F.sum("cell_bytes").over(before), F.lit(0)), "c_rows": F.coalesce(F.sum("cell_rows").over(before), F.lit(0))})
    cells = cells.withColumn("total", F.sum("cell_bytes").over(Window.partitionBy(F.lit(0))))
    cells = staged(cells.select("cell", "c_bytes", "c_rows", "total", F.ceil(F.col("different") / GROUP_ROWS).alias("groups")), "cell-sums")

    rows = curve.join(F.broadcast(cells), "cell")  # 2 ** 18 rows of 40 bytes at most
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), "groups").cast("int"))
    groups = rows.groupBy("cell", "group").agg(F.sum(F.col("size") * F.col("n")).alias("group_bytes"), F.sum("n").alias("group_rows"))
    before = Window.partitionBy("cell").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("cell", "group", F.coalesce(F.sum("group_bytes").over(before), F.lit(0)).alias("g_bytes"), F.coalesce(F.sum("group_rows").over(before), F.lit(0)).alias("g_rows"))
    before = Window.partitionBy("cell", "group").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"d_bytes": F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)), "d_rows": F.coalesce(F.sum("n").over(before), F.lit(0))}).join(groups, ["cell", "group"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    middle = F.expr(f"CAST((c_bytes + g_bytes + d_bytes + copy * size + size div 2) * {shards} div total AS int)")
    rows = staged(rows.select("doc_id", "size", "text_crc32", "cell", F.least(middle, F.lit(shards - 1)).alias("shard"), (F.col("c_rows") + F.col("g_rows") + F.col("d_rows") + F.col("copy")).alias("row")), "placed")
    discard(curve, cells)
    first = rows.groupBy("shard").agg(F.min("row").alias("first_row"))
    rows = rows.join(F.broadcast(first), "shard")  # one row a shard
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell")


def write_shards(df: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """The rows of ``df`` as Parquet, one folder a shard, in order of slot. doc_id is unique here."""
    rows = df.join(placed.select(F.col("doc_id").alias(doc_id), "shard", "slot"), doc_id)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
