"""Time axes: which column is the clock, its unit and rate, how long a record lasts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_micros, finite

# Words in a column's name that may make it the clock, and the bounds of units and rates.
TIME_WORDS = ("time", "timestamp", "datetime", "date", "second", "sec", "frame", "时刻", "时间", "秒")
NANO_STEP, MILLI_STEP = 1e6, 1e3
LEAST_RATE, MOST_RATE = 1e-4, 1e6


def hinted(columns: Sequence[str]) -> list[str]:
    """Columns whose clean name has a time word between ends or underscores, in order."""
    words = "|".join(TIME_WORDS)
    clean = lambda c: re.sub(r"[^0-9A-Za-z_一-鿿]+", "_", c).strip("_")
    return [c for c in columns if re.search(rf"(?:^|_)(?:{words})(?:_|$)", clean(c), re.IGNORECASE)]


def step_stats(rows: DataFrame, record: str = "record_id", t: str = "t", order: str = "seq") -> DataFrame:
    """Per record: finite times, whether they never fall, the median positive step, the first and least."""
    ok = rows.where(F.col(t).isNotNull())
    d = F.col(t) - F.lag(t).over(Window.partitionBy(record).orderBy(order))
    steps = ok.select(record, order, t, d.alias("__d"))
    return steps.groupBy(record).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("__d") >= 0), F.lit(True)).alias("monotonic"),
        F.median(F.when(F.col("__d") > 0, F.col("__d"))).alias("step"), F.min_by(t, order).alias("first"), F.min(t).alias("least"),
    )


def numeric_axis(stats: DataFrame) -> DataFrame:
    """Adds scale, rate and whether the column can be a clock: three times at least that never fall, a
    positive step, and a rate within bounds once nano- or milliseconds are told by the step's size."""
    scale = F.when(F.col("step") > NANO_STEP, 1e9).when(F.col("step") > MILLI_STEP, 1e3).otherwise(F.lit(1.0))
    rate = F.lit(1.0) / F.greatest(F.col("step") / scale, F.lit(1e-9))
    usable = (F.col("n") >= 3) & F.col("monotonic") & F.col("step").isNotNull() & rate.between(LEAST_RATE, MOST_RATE)
    return stats.withColumns({"scale": scale, "rate_hz": rate, "usable": F.coalesce(usable, F.lit(False))})


def inferred(df: DataFrame, record: str, order: str, columns: Sequence[str], duration: str | None = None) -> DataFrame:
    """``df`` with t (seconds), rate_hz and time_source, decided for each record.

    The first hinted column that can be a clock holds: timestamps (or text that reads as such) count from
    their least with the median positive step as rate; numbers from their first, in the unit that their
    step tells. Without one, rows are spread evenly over ``duration``, or counted at 1 Hz.
    """
    types = dict(df.dtypes)
    out = df
    choices = []
    for i, c in enumerate(hinted(columns)):
        tried = [(True, "stamp")] if types[c].startswith(("timestamp", "date")) else [(True, "text")] if types[c] == "string" else []
        if not types[c].startswith(("timestamp", "date")):
            tried.append((False, "number"))
        for stamped, how in tried:
            if how == "stamp":
                value = epoch_micros(F.col(c)) / F.lit(1e6)
            elif how == "text":
                value = F.unix_micros(F.try_to_timestamp(c)) / F.lit(1e6)
            else:
                value = finite(F.col(c).try_cast("double") if types[c] == "string" else F.col(c))
            x, name = f"__x{i}{how}", f"__s{i}{how}"
            out = out.withColumn(x, value)
            stats = numeric_axis(step_stats(out.select(record, order, F.col(x).alias("t")), record, "t", order))
            good = (F.col("n") >= 3) & F.col("step").isNotNull() if stamped else F.col("usable")
            rate = F.lit(1.0) / F.col("step") if stamped else F.col("rate_hz")
            base = F.col("least") if stamped else F.col("first")
            unit = F.lit(1.0) if stamped else F.col("scale")
            out = out.join(stats.where(good).select(F.col(record), F.struct(rate.alias("rate"), base.alias("base"), unit.alias("unit")).alias(name)), record, "left")
            choices.append((c, x, name))
    n = F.count(F.lit(1)).over(Window.partitionBy(record))
    i = F.row_number().over(Window.partitionBy(record).orderBy(order)) - 1
    even = F.when((F.col(duration) > 0) & (n > 1), F.col(duration)) if duration else F.lit(None).cast("double")
    t = F.coalesce(i * even / n, i.cast("double"))
    rate, source = F.coalesce(n / even, F.lit(1.0)), F.when(even.isNotNull(), "duration_hint").otherwise("row_index")
    for c, x, name in reversed(choices):
        has = F.col(name).isNotNull()
        t = F.when(has, (F.col(x) - F.col(name)["base"]) / F.col(name)["unit"]).otherwise(t)
        rate = F.when(has, F.col(name)["rate"]).otherwise(rate)
        source = F.when(has, c).otherwise(source)
    return out.select(*df.columns, t.alias("t"), rate.alias("rate_hz"), source.alias("time_source"))


def record_meta(rows: DataFrame) -> DataFrame:
    """Per record: rows, monotonic, median step, rate (1 without a step) and duration: last time by order
    less the first, and one step more."""
    d = F.col("t") - F.lag("t").over(Window.partitionBy("record_id").orderBy("seq"))
    steps = rows.select("record_id", "seq", "t", d.alias("d"))
    found = steps.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("d") >= 0), F.lit(True)).alias("monotonic"), F.median(F.when(F.col("d") > 0, F.col("d"))).alias("step"), F.min_by("t", "seq").alias("first"), F.max_by("t", "seq").alias("last"))
    rate = F.coalesce(F.lit(1.0) / F.col("step"), F.lit(1.0))
    return found.select("record_id", "n", "monotonic", rate.alias("rate_hz"), (F.col("last") - F.col("first") + F.lit(1.0) / F.greatest(rate, F.lit(1e-9))).alias("duration"))
