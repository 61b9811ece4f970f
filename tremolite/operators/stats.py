"""The statistics of a catalogue. Windows without partitions run over bins or days, never over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import WEEKDAYS
from .catalog import alert_rank


def canonical(df: DataFrame) -> DataFrame:
    return df.filter("is_canonical")


def day(col: str = "occurred_us"):
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(col) / F.lit(86_400_000_000)).cast("int"))


def not_zero(c):
    """A value of exactly 0 counts as missing."""
    return F.when(c != 0, c)


def summary(df: DataFrame) -> DataFrame:
    m = F.col("magnitude")
    return canonical(df).agg(
        F.count("magnitude").alias("total_events"), F.round(not_zero(F.avg(m)), 3).alias("mean_magnitude"), F.round(not_zero(F.stddev_samp(m)), 3).alias("mag_std"),
        F.round(not_zero(F.max(m)), 2).alias("max_magnitude"), F.count_if(F.col("tsunami") == 1).alias("tsunami_count"),
    )


def magnitude_bins(df: DataFrame) -> DataFrame:
    return canonical(df).filter("magnitude IS NOT NULL").groupBy((F.floor(F.col("magnitude") * 2) / 2).alias("bin_low")).agg(F.count("*").alias("n"))


def gutenberg_richter(df: DataFrame) -> DataFrame:
    """(mag_low, n, cumulative): events of each bin of 0.2, and of it and all higher ones."""
    bins = canonical(df).filter("magnitude IS NOT NULL").groupBy((F.floor(F.col("magnitude") * 5) / 5).alias("mag_low")).agg(F.count("*").alias("n"))
    return bins.withColumn("cumulative", F.sum("n").over(Window.orderBy(F.desc("mag_low")).rowsBetween(Window.unboundedPreceding, 0)))


def b_value(df: DataFrame) -> DataFrame:
    """One row: the slope, sign changed, of log10(cumulative) over the first three quarters of the bins, three at least."""
    gr = gutenberg_richter(df).withColumns({"rn": F.row_number().over(Window.orderBy("mag_low")), "bins": F.count("*").over(Window.partitionBy(F.lit(0)))})
    pts = gr.filter(F.col("rn") <= F.greatest(F.lit(3), F.floor(F.col("bins") * 3 / 4)))
    slope = F.regr_slope(F.log10(F.greatest("cumulative", F.lit(1)).cast("double")), F.col("mag_low"))
    return pts.agg(F.when(F.max("bins") >= 3, -F.round(slope, 3)).alias("b_value"))


def daily(df: DataFrame) -> DataFrame:
    """(day, n, moment_proxy, cum_moment, max_mag, rate_7day); the rate is over up to seven days that have events."""
    moment = F.round(F.pow(F.lit(10.0), F.coalesce("magnitude", F.lit(0.0)) * 1.5), 2).cast("decimal(38,2)")
    d = canonical(df).groupBy(day().alias("day")).agg(F.count("*").alias("n"), F.sum(moment).alias("m"), F.max("magnitude").alias("max_mag"))
    w = Window.orderBy("day")
    run, week = F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.avg("n").over(w.rowsBetween(-6, 0))
    return d.select("day", "n", F.col("m").cast("double").alias("moment_proxy"), run.cast("double").alias("cum_moment"), not_zero(F.col("max_mag")).alias("max_mag"), F.bround(week, 1).alias("rate_7day"))


def depth_bins(df: DataFrame) -> DataFrame:
    return canonical(df).filter("depth_km IS NOT NULL").groupBy((F.floor(F.col("depth_km") / 10) * 10).cast("int").alias("depth_low")).agg(F.count("*").alias("n"))


def _dense(spark: SparkSession, size: int, key: str, counts: DataFrame) -> DataFrame:
    return spark.range(size).select(F.col("id").cast("int").alias(key)).join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hours(df: DataFrame) -> DataFrame:
    """(hour, n) for all 24 hours, UTC."""
    hour = F.expr("CAST(pmod(occurred_us, 86400000000) div 3600000000 AS int)").alias("hour")
    return _dense(df.sparkSession, 24, "hour", canonical(df).groupBy(hour).agg(F.count("*").alias("n")))


def weekdays(df: DataFrame) -> DataFrame:
    """(dow, name, n) for all seven days, Sunday 0, UTC."""
    counts = canonical(df).groupBy((F.dayofweek(day()) - 1).alias("dow")).agg(F.count("*").alias("n"))
    return _dense(df.sparkSession, 7, "dow", counts).select("dow", F.get(F.array(*[F.lit(x) for x in WEEKDAYS]), "dow").alias("name"), "n")


def distribution(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """(column, n). Null has a group of its own, shown as ``missing``, beside a literal value of that name."""
    label = F.coalesce(F.col("__k"), F.lit(missing)) if missing else F.col("__k")
    return canonical(df).groupBy(F.col(column).alias("__k")).agg(F.count("*").alias("n")).select(label.alias(column), "n")


def alert_levels(df: DataFrame) -> DataFrame:
    """(alert, n) for red, orange, yellow and green, zeros included."""
    names = df.sparkSession.createDataFrame([(a,) for a in ("red", "orange", "yellow", "green")], "alert string")
    counts = canonical(df).groupBy("alert").agg(F.count("*").alias("n"))
    return names.join(counts, "alert", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def recent_pairs(df: DataFrame, n: int = 500) -> DataFrame:
    """(id, magnitude, depth_km) of the most recent events."""
    return canonical(df).filter("magnitude IS NOT NULL AND depth_km IS NOT NULL").orderBy(F.desc("occurred_us"), "id").limit(n).select("id", "magnitude", "depth_km")


def top_significant(df: DataFrame, n: int = 10) -> DataFrame:
    return canonical(df).filter("sig IS NOT NULL").orderBy(F.desc("sig"), "id").limit(n).select("id", "magnitude", "place", "sig", "alert", "tsunami", "occurred_us")


def active_alerts(df: DataFrame) -> DataFrame:
    """Of the most significant events those with an alert above green, by severity."""
    top = top_significant(df).filter(F.col("alert").isin("red", "orange", "yellow"))
    return top.orderBy(F.desc(alert_rank(F.col("alert"))), F.desc("sig"), "id").select("id", "alert", "sig")


def timeline_extent(df: DataFrame) -> DataFrame:
    """One row: first and last instant, least and largest magnitude with a margin of 0.3, never below 0."""
    m = F.col("magnitude")
    return canonical(df).agg(F.min("occurred_us").alias("first_us"), F.max("occurred_us").alias("last_us"), F.greatest(F.round(F.min(m) - 0.3, 6), F.lit(0.0)).alias("mag_lo"), F.round(F.max(m) + 0.3, 6).alias("mag_hi"))


def bundle(df: DataFrame) -> dict[str, DataFrame]:
    """All statistics by name; cache ``df`` before taking several."""
    return {
        "summary": summary(df), "magnitude_bins": magnitude_bins(df), "gr_data": gutenberg_richter(df), "b_value": b_value(df), "daily_cumulative": daily(df),
        "depth_bins": depth_bins(df), "hour_dist": hours(df), "weekday_dist": weekdays(df), "alert_dist": distribution(df, "alert", "none"),
        "source_dist": distribution(df, "source"), "depth_mag_pairs": recent_pairs(df), "top_significant": top_significant(df), "mag_type_dist": distribution(df, "mag_type", "unknown"),
    }
