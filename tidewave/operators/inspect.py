"""What a set of recordings holds, record by record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeaxis import record_meta


def report(samples: DataFrame) -> DataFrame:
    """Per record: samples, missing values, channels, least and greatest value, rate, duration and an error
    (null if fine): no finite value, or times that fall."""
    stats = samples.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.array_sort(F.collect_set("channel")).alias("channels"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    meta = record_meta(samples).select("record_id", "rate_hz", "duration", "monotonic")
    error = F.when(F.col("n_rows") == F.col("n_missing"), "no finite value").when(~F.col("monotonic"), "times fall")
    return stats.join(meta, "record_id").select("record_id", "n_rows", "n_missing", F.array_join("channels", ",").alias("channels"), "least", "greatest", "rate_hz", "duration", error.alias("error"))


def status(items: DataFrame) -> DataFrame:
    """One row: records, errors, and ok or error."""
    return items.agg(F.count(F.lit(1)).alias("records"), F.count("error").alias("errors")).withColumn("status", F.when(F.col("errors") == 0, "ok").otherwise("error"))
