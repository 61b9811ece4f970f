"""Exact top-k search by inner product: MaxScore over dimension postings of vector shards, shards merged by rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Most vectors of a shard, and most queries that meet it in one task: what bounds a task's memory.
SHARD_ROWS, QUERY_ROWS = 65_536, 65_536
#: A smaller table is cut finer, so that all cores work, but not below so many vectors.
LEAST_ROWS = 2048
#: Rows of a shard and queries that are searched at once. Thresholds rise from one piece of rows to the next; the first one,
#: which is scored in full, is small: it only has to give each query as many rows as are asked for.
FIRST_ROWS, PIECE_ROWS, QUERIES_AT_ONCE = 256, 4096, 256
#: Terms of a step, and the share of rows in the race above which a step takes them all.
STEP, DENSE = 8, 0.05
#: Components up to this size (after scaling) go into matrices of doubles; vectors with a larger one are scored as whole numbers.
PLAIN = 2.0**20
_LONG = (1 << 63) - 1

HITS = "query_id long, vec_id long, score long"


def maxscore(queries: np.ndarray, postings: np.ndarray, lo: np.ndarray, hi: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of every row that reaches its query's threshold, for a few queries at once.

    ``postings[d]`` is the posting list of term d: its weight in each row, between ``lo[d]`` and ``hi[d]``. So a
    term's contribution to a query lies in an interval. Terms are taken by the width of theirs, over all queries. The
    narrowest ones are not essential as long as all their widths together can't lift a row from the sum of least
    contributions to the threshold. The essential lists are traversed for all rows. The other terms are probed in
    steps, only while and where their bounds still let a row reach the threshold: for the rows that compete for any query
    while many pairs of row and query are left, then pair by pair.
    """
    dims = len(postings)
    high, low = np.maximum(queries * lo, queries * hi), np.minimum(queries * lo, queries * hi)
    order = np.argsort(-(high - low).sum(0), kind="stable")
    high, low, queries, postings = high[:, order], low[:, order], queries[:, order], postings[order]
    ends = np.zeros((len(queries), 1))
    rest = np.hstack([np.cumsum(high[:, ::-1], axis=1)[:, ::-1], ends])  # the most that terms from here on can add
    width = np.hstack([np.cumsum((high - low)[:, ::-1], axis=1)[:, ::-1], ends])
    enough = (width < (thresholds - low.sum(1))[:, None]).all(0)
    at = int(enough.argmax()) if enough.any() else dims
    partial = queries[:, :at] @ postings[:at]
    alive = partial + rest[:, at, None] >= thresholds[:, None]
    rows = np.arange(postings.shape[1])  # those that still compete for some query
    while at < dims and alive.mean() > DENSE:
        if (some := alive.any(0)).mean() < 0.9:
            rows, partial = rows[some], partial[:, some]
        partial = partial + queries[:, at : at + STEP] @ postings[at : at + STEP, rows]
        at = min(at + STEP, dims)
        alive = partial + rest[:, at, None] >= thresholds[:, None]
    query, row = np.nonzero(alive)
    score, row = partial[query, row], rows[row]
    while at < dims and len(row):
        score = score + np.einsum("ij,ji->i", queries[query, at : at + STEP], postings[at : at + STEP, row])
        at = min(at + STEP, dims)
        still = score + rest[query, at] >= thresholds[query]
        query, row, score = query[still], row[still], score[still]
    return query, row, score


def _vectors(column: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Vectors as rows, each component x as floor(64 * x); a shorter vector ends in zeros, a longer one is cut at ``dims``."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(np.asarray(lists.flatten(), np.float64) * 64)
    if dims is None:
        dims = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), dims))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place < dims
    out[np.repeat(np.arange(len(sizes)), sizes)[inside], place[inside]] = flat[inside]
    return out


def _whole(row: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in row], object)


class Shard:
    """A shard's vectors: pieces of plain ones as postings, with the bounds of each list, and those with large components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        plain = np.abs(vectors).max(1, initial=0) <= PLAIN
        self.large = [(i, _whole(v)) for i, v in zip(ids[~plain].tolist(), vectors[~plain], strict=True)]
        self.pieces = []
        ids, vectors = ids[plain], vectors[plain]
        bounds = [0, *range(min(FIRST_ROWS, len(ids)), len(ids), PIECE_ROWS), len(ids)] if len(ids) else [0]
        for a, b in zip(bounds, bounds[1:], strict=False):
            p = np.ascontiguousarray(vectors[a:b].T)
            self.pieces.append((ids[a:b], p, p.min(1), p.max(1)))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score): for each query the ``k`` best rows that aren't its own, ties to the smaller vec_id.

        Sums of doubles have to be exact for these queries.
        """
        query, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        thresholds = np.full(len(queries), -np.inf)
        for there, postings, lo, hi in self.pieces:
            if np.isneginf(thresholds).any():  # not yet k rows for each query: these are scored in full
                full = queries @ postings
                full[there == query_ids[:, None]] = -np.inf
                if len(there) >= k:
                    thresholds = np.maximum(thresholds, np.partition(full, len(there) - k, axis=1)[:, len(there) - k])
                q, row = np.nonzero(~np.isneginf(full) & (full >= thresholds[:, None]))
                found = full[q, row]
            else:
                q, row, found = maxscore(queries, postings, lo, hi, thresholds)
                other = there[row] != query_ids[q]
                q, row, found = q[other], row[other], found[other]
            query, ids, scores = np.concatenate([query, q]), np.concatenate([ids, there[row]]), np.concatenate([scores, found])
            order = np.lexsort((ids, -scores, query))
            query, ids, scores = query[order], ids[order], scores[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            thresholds[query[rank == k - 1]] = scores[rank == k - 1]
            query, ids, scores = query[rank < k], ids[rank < k], scores[rank < k]
        return query, ids, scores.astype(np.int64)

    def best_whole(self, query_id: int, query: np.ndarray, k: int, plain: bool) -> list[tuple[int, int]]:
        """(score, vec_id) of the ``k`` best rows by whole numbers of any size: of the large ones, and with ``plain`` of all."""
        q = _whole(query)
        hits = [(int(q @ v), i) for i, v in self.large if i != query_id]
        for there, postings, _, _ in self.pieces if plain else ():
            hits += [(int(s), i) for s, i in zip(q @ postings.astype(np.int64).astype(object), there.tolist(), strict=True) if i != query_id]
        return sorted(((max(-_LONG - 1, min(_LONG, s)), i) for s, i in hits), key=lambda h: (-h[0], h[1]))[:k]


def _search(k: int):
    """The hits of a block of queries in a shard: up to ``k`` by doubles and up to ``k`` by whole numbers for each query."""

    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0), np.int64)]
        if queries.num_rows and shard.num_rows:
            vectors = _vectors(shard.column("e"))
            here, ids, q = Shard(shard.column("id").to_numpy(), vectors), queries.column("id").to_numpy(), _vectors(queries.column("e"), vectors.shape[1])
            exact = PLAIN * np.abs(q).sum(1) < 2**53  # sums of doubles are exact
            for at in range(0, len(ids), QUERIES_AT_ONCE):
                some = np.flatnonzero(exact[at : at + QUERIES_AT_ONCE]) + at
                query, vec, score = here.best(ids[some], q[some], k)
                found.append(np.stack([ids[some][query], vec, score]))
            for i in np.flatnonzero(~exact) if not here.large else range(len(ids)):
                hits = here.best_whole(int(ids[i]), q[i], k, not exact[i])
                found.append(np.array([(ids[i], v, s) for s, v in hits], np.int64).reshape(-1, 3).T)
        return pa.table(list(np.concatenate(found, axis=1)), names=["query_id", "vec_id", "score"])

    return run


def top_k(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, query_mod: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, least_rows: int = LEAST_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of highest score for each query, ties to the smaller vec_id.

    A component x counts as floor(64 * x); the score is the inner product, exact, and held at the ends of a long.
    Queries are the vec_ids divisible by ``query_mod``; every row but those of the query's own vec_id is a candidate.
    Vectors are dealt into shards and queries into blocks, at random; a shard meets a block in one task. With N
    vectors there are N / (query_mod * ``query_rows``) copies of the vectors and N / ``shard_rows`` of the queries.

    Rows take no part whose vec_id or vector is null, or whose vector holds a null or a non-finite component. Rows that
    share a vec_id are all candidates; as a query, the vec_id counts once, with its least vector. Missing components
    of a shorter vector are 0. An empty table, or one without queries, gives no rows. Other columns aren't read,
    whatever their names.
    """
    v = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e")).filter("id IS NOT NULL AND e IS NOT NULL")
    v = staged(v.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))), "vectors")
    n = v.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // shard_rows), min(cores, n // least_rows))
    blocks = max(1, -(-n // (query_mod * query_rows)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # by place in the staged files, which stays the same if a task runs again: no id or vector can crowd a shard
    targets = v.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    queries = v.filter(F.col("id") % query_mod == 0).groupBy("id").agg(F.min("e").alias("e"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    hits = queries.groupBy("block", "shard").cogroup(targets.groupBy("block", "shard")).applyInArrow(_search(k), HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
