"""Long tables of samples: profiles, imputation, robust scaling, activity.

The canonical table is samples(record_id, seq, t, channel, value): value null where missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clipped, epoch_micros, finite
from ..functions.vectors import unique_texts

MAD_TO_STD = 1.4826


def samples(df: DataFrame, record: str, seq: str, ts: str, channel: str, value: str) -> DataFrame:
    """The canonical table of an event table; t counts seconds from the record's first event.

    The first times come from an aggregation, combined before its shuffle, and a join that a record with
    most of the events does not hold up.
    """
    rows = df.select(F.col(record).cast("string").alias("record_id"), F.col(seq).alias("seq"), epoch_micros(F.col(ts)).alias("us"), F.col(channel).alias("channel"), finite(F.col(value)).alias("value"))
    first = df.select(F.col(record).cast("string").alias("record_id"), epoch_micros(F.col(ts)).alias("us")).groupBy("record_id").agg(F.min("us").alias("__first"))
    timed = rows.alias("r").join(first.alias("f"), F.col("r.record_id").eqNullSafe(F.col("f.record_id")))
    return timed.select("r.record_id", "seq", ((F.col("us") - F.col("__first")) / F.lit(1e6)).alias("t"), "channel", "value")


def melted(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide numeric columns in long form, as finite doubles."""
    return df.select(*keys, *[finite(F.col(c)).alias(c) for c in columns]).unpivot(list(keys), list(columns), "channel", "value")


def column_profile(long: DataFrame) -> DataFrame:
    """Rows, finite cells and their share for each channel."""
    return long.groupBy("channel").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_finite"), (F.count("value") / F.count(F.lit(1))).alias("valid_ratio"))


def usable_columns(df: DataFrame, columns: Sequence[str], most: int = 96) -> list[str]:
    """Columns with a finite cell, in order, the first ``most``; one aggregation. Raises without any."""
    counts = df.agg(*[F.count(finite(F.col(c))).alias(c) for c in columns]).first()
    found = [c for c in columns if counts[c]][:most]
    if not found:
        raise ValueError("no column with a finite number")
    return found


def unique_names(df: DataFrame, name: str, order: str, keys: Sequence[str], first_suffix: int = 2, out: str = "unique_name") -> DataFrame:
    """Names that are taken within their table (``keys``) get ``_2``, ``_3``, ... (or from ``first_suffix``) in
    ``order``, the first that is free: ``a, a, a_2`` gives ``a, a_2, a_2_2``. A table's names are one array."""
    header = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))).alias("__h"))
    free = unique_texts(F.transform("__h", lambda h: h["n"]), first_suffix)
    named = header.select(*keys, F.explode(F.arrays_zip(F.transform("__h", lambda h: h["o"]).alias("o"), free.alias("u"))).alias("__z"))
    named = named.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__z.o").alias("__o"), F.col("__z.u").alias(out))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(order).eqNullSafe(F.col("__o"))]
    return df.join(named, on).drop("__o", *[f"__{k}" for k in keys])


def with_stats(long: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """``long`` with statistics of each row's series: an aggregation, combined before its shuffle, and a join,
    so that a series with most of the rows is split as any skewed join is."""
    found = long.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()]).select(*[F.col(k).alias(f"__k_{k}") for k in keys], *stats)
    return long.join(found, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]).drop(*[f"__k_{k}" for k in keys])


def imputed(long: DataFrame, keys: Sequence[str] = ("record_id", "channel"), value: str = "value") -> DataFrame:
    """Missing values as the median of their series, 0 where all are missing."""
    rows = with_stats(long, keys, __m=F.median(value))
    return rows.withColumn(value, F.coalesce(value, F.col("__m"), F.lit(0.0))).drop("__m")


def robust_scaled(long: DataFrame, keys: Sequence[str] = ("record_id", "channel"), value: str = "value", out: str = "z", least: float = 1e-8, std_next: bool = True, bound: float | None = None, impute: bool = False) -> DataFrame:
    """(value - median) / scale within each series. The scale is 1.4826 times the median distance from
    the median; below ``least`` the population deviation (if ``std_next``), and below that 1. With ``impute``
    missing values become the median first (0 where all are missing), which leaves the median as it is."""
    rows = with_stats(long, keys, __m=F.median(value))
    if impute:
        rows = rows.withColumn("__m", F.coalesce("__m", F.lit(0.0))).withColumn(value, F.coalesce(value, "__m"))
    rows = with_stats(rows, keys, __s=F.lit(MAD_TO_STD) * F.median(F.abs(F.col(value) - F.col("__m"))), __sd=F.stddev_pop(value))
    scale: Column = F.when(F.col("__s") >= least, F.col("__s"))
    if std_next:
        scale = F.coalesce(scale, F.when(F.col("__sd") >= least, F.col("__sd")))
    z = (F.col(value) - F.col("__m")) / F.coalesce(scale, F.lit(1.0))
    return rows.withColumn(out, z if bound is None else clipped(z, bound)).drop("__m", "__s", "__sd")


def differences(long: DataFrame, keys: Sequence[str] = ("record_id", "channel"), value: str = "z", out: str = "delta", order: str = "seq") -> DataFrame:
    """Value less the one before in its series; 0 for the first."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return long.withColumn(out, F.coalesce(F.col(value) - before, F.lit(0.0)))


def activity(long: DataFrame) -> DataFrame:
    """(record_id, seq, t, activity): root mean square over a row's channels of the scaled values' steps."""
    steps = differences(robust_scaled(long, impute=True))
    return steps.groupBy("record_id", "seq").agg(F.min("t").alias("t"), F.sqrt(F.avg(F.col("delta") * F.col("delta"))).alias("activity"))


def winsor_scaled(df: DataFrame, value: str, keys: Sequence[str], low: float = 0.01, high: float = 0.995, out: str = "scaled") -> DataFrame:
    """Clipped to two quantiles of its group and mapped onto 0 to 255; 0 where they are equal."""
    rows = with_stats(df, keys, __q=F.percentile(F.col(value), F.array(F.lit(low), F.lit(high))))
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    x = F.least(hi, F.greatest(lo, F.col(value)))
    return rows.withColumn(out, F.when(hi > lo, F.floor((x - lo) / (hi - lo) * 255)).otherwise(F.lit(0)).cast("long")).drop("__q")
