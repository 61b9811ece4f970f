"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then a seeded choice of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Words of a block, documents of a shard, the times a source may be repeated, and the seed of all orders.
BLOCK, SHARD_DOCS, REPEAT, SEED = 16, 512, 3, 11


def sainte_lague(parties: DataFrame, by: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: of ``seats`` (the same in all rows of a group ``by``) those that ``party`` gets.

    A party's n-th seat has the quotient votes / (2n - 1), and the highest quotients win; ties go to the lesser
    party. With V votes, P parties and N seats, rounding votes to divisor V / (N - P/2) gives at most N seats, and
    to divisor V / (N + P/2) at least N. So only the seats between these two are ranked: about P in all.
    Nulls or no votes: quota 0.
    """
    group = Window.partitionBy(*by)
    v = parties.withColumns({"__v": F.coalesce(F.sum(votes).over(group), F.lit(0)).cast("double"), "__p": F.count("*").over(group), "__n": F.coalesce(F.col(seats), F.lit(0)).cast("long")})
    share = F.when(F.col("__v") > 0, F.coalesce(F.col(votes), F.lit(0)) / F.col("__v")).otherwise(0.0)
    v = v.withColumns({"__lo": F.floor(share * F.greatest(F.col("__n") - F.col("__p") / 2.0, F.lit(0.0)) + 0.5 - 1e-6), "__hi": F.ceil(share * (F.col("__n") + F.col("__p") / 2.0) + 0.5)})
    v = v.withColumn("__lo", F.when(share > 0, F.greatest("__lo", F.lit(0))).otherwise(0).cast("long")).withColumn("__hi", F.when(share > 0, F.col("__hi")).otherwise(0).cast("long"))
    v = v.withColumn("__left", F.col("__n") - F.sum("__lo").over(group))
    seat = v.filter("__hi > __lo").select(*by, party, "__left", (F.col(votes).cast("double")).alias("__votes"), F.explode(F.expr("sequence(__lo + 1, __hi)")).alias("__k"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("__votes") / (2 * F.col("__k") - 1)), F.col(party).asc_nulls_last(), "__k")
    won = seat.withColumn("__rank", F.row_number().over(order)).filter("__rank <= __left").groupBy(*by, party).agg(F.count("*").alias("__won"))
    same = F.lit(True)
    won = won.select(*[F.col(c).alias(f"__w_{c}") for c in (*by, party)], "__won")
    for c in (*by, party):
        same = same & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    keep = [*parties.columns]
    return v.join(won, same, "left").select(*keep, (F.col("__lo") + F.coalesce("__won", F.lit(0))).alias("quota"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights 1, 2, 3, repeating, in order of source.

    Target words share the sum of all sizes by weight, none above ``REPEAT`` times its source. With sources in
    order of cap / weight, those capped come first; the level is what is left over the weight that is left. One
    row a source; the windows hold no documents.
    """
    every = Window.partitionBy(F.lit(0))
    w = sizes.withColumn("weight", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    w = w.withColumns({"cap": F.col("source_size") * REPEAT, "total": F.sum("source_size").over(every)})
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # the level if this source and all later ones aren't capped; the first source that it doesn't cap decides
    w = w.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    w = w.withColumn("final", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix_sources(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns ``carry`` for each row: the words of each document that the mix takes.

    1. Sizes are words; targets as in ``source_targets``.
    2. All blocks (total size / ``block``) go to sources by Sainte-Laguë, targets as votes; a source's blocks go to
       its shards likewise, shard sizes as votes. A shard holds about ``shard_docs`` documents, whatever its source.
    3. A shard's documents stand in a seeded order on a line of blocks. Its quota takes the whole line as often as
       it can, then a run of blocks from a seeded start, around the end. A document is taken as often as its words are.

    Null text or no words: size 0, taken 0. Null source: a source of its own, the last. Rows that repeat a doc_id
    are documents of their own, in order of size. Reruns agree. An empty table gives an empty table.
    """
    sized = staged(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), *carry), "sizes")
    known = sized.withColumn("key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))  # "n" < "s...": a null source has a key too
    sources = staged(source_targets(known.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).drop("n_docs")), "targets")
    counts = known.groupBy("key").agg(F.count("*").alias("n_docs"))
    sources = sources.withColumn("key", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).join(counts, "key").drop("source")
    sources = sources.withColumns({"all": F.lit(0), "seats": F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block).cast("long"), "n_shards": F.ceil(F.col("n_docs") / shard_docs).cast("long")})
    sources = staged(sainte_lague(sources, ["all"], "key", "target", "seats").withColumnRenamed("quota", "blocks"), "quotas")

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("doc_id", F.lit(-1))))
    docs = known.join(sources.select("key", "source_size", "target", "blocks", "n_shards"), "key")
    docs = docs.withColumn("order", order).withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    shards = docs.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    shards = sainte_lague(shards, ["key"], "shard", "shard_size", "blocks")
    line = F.ceil(F.col("shard_size") / block).cast("long")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "key", "shard")), 1, 8), 16, 10).cast("long")
    shards = shards.withColumn("line", F.greatest(line, F.lit(1))).select("key", "shard", "line", F.least(F.col("quota"), F.col("line") * REPEAT).alias("quota"), start.alias("start"))
    shards = staged(shards.selectExpr("key AS s_key", "shard AS s_shard", "quota div line AS whole", f"(start % line) * {block} AS first_at", f"(start % line + quota % line) * {block} AS last_at", f"line * {block} AS line_words"), "shards")

    at = Window.partitionBy("key", "shard").orderBy("order", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("at", F.coalesce(F.sum("size").over(at), F.lit(0)))
    docs = docs.join(shards, (F.col("key") == F.col("s_key")) & (F.col("shard") == F.col("s_shard")))
    part = lambda lo, hi: f"greatest(least(at + size, {hi}) - greatest(at, {lo}), 0)"
    taken = F.expr(f"CAST(whole * size + {part('first_at', 'last_at')} + {part('0', 'last_at - line_words')} AS long)")
    return docs.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *carry)
