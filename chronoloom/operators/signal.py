"""Behavioural signals: dense, origin-aligned tumbling buckets per session.

Buckets start at a session's earliest record, not at the epoch, so Spark's
window() doesn't apply; the bucket index is integer arithmetic on nanoseconds.
Counts are aggregated by (session, bucket) before zeros are filled in, so the
dense grid is made from one row per session and dimension, never from records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Display scales of the spectroscope, in milliseconds.
SCALES_MS = (1_000, 5_000, 15_000, 60_000, 300_000, 900_000)


def axis(ledger: DataFrame, width_ms: int) -> DataFrame:
    """One row per session: origin, span, number of buckets, and how much of the last is observed."""
    span = F.expr("latest_ns - origin_ns")
    rows = ledger.groupBy("session_id").agg(F.min("epoch_ns").alias("origin_ns"), F.max("epoch_ns").alias("latest_ns"))
    return rows.select("session_id", "origin_ns", (span.cast("bigint") / 1_000_000).cast("bigint").alias("span_ms"), (F.expr(f"(latest_ns - origin_ns) div {width_ms * 1_000_000}") + 1).alias("buckets"), F.expr(f"((latest_ns - origin_ns) div 1000000) % {width_ms}").alias("final_bucket_observed_ms"))


def _bucketed(ledger: DataFrame, width_ms: int, *columns: str) -> DataFrame:
    origin = F.min("epoch_ns").over(Window.partitionBy("session_id"))
    return ledger.withColumn("_origin", origin).select("session_id", F.expr(f"(epoch_ns - _origin) div {width_ms * 1_000_000}").alias("bucket"), *columns)


def sparse(ledger: DataFrame, width_ms: int) -> DataFrame:
    """(session_id, bucket, dimension, value) where the value isn't zero."""
    rows = _bucketed(ledger, width_ms, "version", "channel", "kind", "tool_name", "corr_id", "response_bytes")
    labels = F.array(F.lit("records"), F.concat(F.lit("channel:"), "channel"), F.concat(F.lit("kind:v"), F.col("version").cast("string"), F.lit(":"), "kind"), F.concat(F.lit("tool_name:"), "tool_name"))
    counted = rows.select("session_id", "bucket", F.explode(labels).alias("dimension")).where("dimension is not null").groupBy("session_id", "bucket", "dimension").agg(F.count("*").cast("double").alias("value"))
    rest = rows.groupBy("session_id", "bucket").agg(F.count_distinct(F.when(F.col("corr_id").isNotNull(), F.struct("version", "corr_id"))).cast("double").alias("ids"), F.sum("response_bytes").cast("double").alias("bytes"))
    rest = rest.select("session_id", "bucket", F.explode(F.array(F.struct(F.lit("distinct_correlation_ids").alias("dimension"), F.col("ids").alias("value")), F.struct(F.lit("recorded_response_json_bytes").alias("dimension"), F.col("bytes").alias("value")))).alias("x")).select("session_id", "bucket", "x.*")
    return counted.unionByName(rest.where("value > 0"))


def dense(ledger: DataFrame, width_ms: int) -> DataFrame:
    """(session_id, dimension, bucket, value) for every bucket of every dimension that the session has."""
    found = sparse(ledger, width_ms)
    grid = found.select("session_id", "dimension").distinct().join(axis(ledger, width_ms).select("session_id", "buckets"), "session_id").select("session_id", "dimension", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket"))
    return grid.join(found, ["session_id", "dimension", "bucket"], "left").fillna(0.0, ["value"])


def stats(ledger: DataFrame, width_ms: int) -> DataFrame:
    """Sum, mean, population deviation, extrema and occupancy of every dimension.

    Zeros are counted, not built: moments of the sparse values and the number of
    buckets give the same figures as the dense grid."""
    found = sparse(ledger, width_ms).groupBy("session_id", "dimension").agg(F.sum("value").alias("sum"), F.avg("value").alias("middle"), F.var_pop("value").alias("spread"), F.min("value").alias("lo"), F.max("value").alias("max"), F.count("*").alias("nonzero_buckets"))
    rows = found.join(axis(ledger, width_ms).select("session_id", "buckets"), "session_id")
    full = F.col("nonzero_buckets") == F.col("buckets")
    mean = F.col("sum") / F.col("buckets")
    constant = full & (F.col("lo") == F.col("max"))
    share = F.col("nonzero_buckets") / F.col("buckets")  # the zeros' moments merged with those of the other values
    variance = share * (F.col("spread") + F.col("middle") * F.col("middle") * (1 - share))
    return rows.select("session_id", "dimension", "sum", mean.alias("mean"), F.when(constant, 0.0).otherwise(F.sqrt(variance)).alias("stddev"), F.when(full, F.col("lo")).otherwise(0.0).alias("min"), "max", "nonzero_buckets", constant.alias("constant"))


def zscores(ledger: DataFrame, width_ms: int) -> DataFrame:
    """Dense values as deviations from their mean; a constant dimension is zero."""
    rows = dense(ledger, width_ms).join(stats(ledger, width_ms).select("session_id", "dimension", "mean", "stddev", "constant"), ["session_id", "dimension"])
    return rows.select("session_id", "dimension", "bucket", F.when(F.col("constant"), 0.0).otherwise((F.col("value") - F.col("mean")) / F.col("stddev")).alias("z"))


def scales(ledger: DataFrame, widths_ms: tuple[int, ...] = SCALES_MS) -> DataFrame:
    """Total, occupied buckets and peak of record counts at each display scale, re-bucketed from records in one pass."""
    origin = F.min("epoch_ns").over(Window.partitionBy("session_id"))
    rows = ledger.withColumn("_d", F.col("epoch_ns") - origin).select("session_id", "_d", F.explode(F.array(*map(F.lit, widths_ms))).alias("width_ms"))
    counts = rows.groupBy("session_id", "width_ms", F.expr("_d div (width_ms * 1000000L)").alias("bucket")).agg(F.count("*").alias("n"))
    return counts.groupBy("session_id", "width_ms").agg(F.sum("n").alias("total"), F.count("*").alias("occupied"), F.max("n").alias("peak"), (F.max("bucket") + 1).alias("buckets"))
