"""Windows that hop from each record's own start, and the samples in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-6


def hopping(spans: DataFrame, length: float, stride: float, most: int | None = None) -> DataFrame:
    """spans(record_id, start, end, ...) -> a row for each window: window_id, w_start, w_end.

    A span up to ``length`` is one window; else windows start every ``stride`` while they fit, and one more
    ends with the span if over a quarter of a length is left uncovered. All of them, or the first ``most``
    where it is given, that one included. An empty span has none.
    """
    start, end = F.col("start"), F.col("end")
    n = F.floor((end - start - length + SLACK) / stride).cast("int") + 1
    n = n if most is None else F.least(F.lit(most), n)
    fits = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((start + k * stride).alias("w_start"), (start + k * stride + length).alias("w_end")))
    tail = F.array(F.struct(F.greatest(start, end - length).alias("w_start"), end.alias("w_end")))
    late = start + (n - 1) * stride + length < end - 0.25 * length
    late = late if most is None else late & (n < most)
    one = F.array(F.struct(start.alias("w_start"), end.alias("w_end")))
    windows = F.when(end <= start, None).when(end - start <= length, one).when(late, F.concat(fits, tail)).otherwise(fits)
    others = [c for c in spans.columns if c not in ("start", "end")]
    return spans.select(*others, F.posexplode(windows).alias("window_id", "__w")).select(*others, "window_id", "__w.w_start", "__w.w_end")


def cells(windows: DataFrame, width: float) -> DataFrame:
    """Windows with the numbers of the ``width``-wide cells that they touch, a row each."""
    return windows.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("w_start") / width), F.floor(F.col("w_end") / width))))


def inside(samples: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """samples joined with the windows that hold them, w_start <= t < w_end.

    An equi-join on (record, cell of ``width`` seconds): with ``width`` near the window length each window
    is in two or three cells and each sample in one, so rows grow with matches only.
    """
    s = samples.withColumn("__cell", F.floor(F.col("t") / width))
    return s.join(cells(windows, width), ["record_id", "__cell"]).where("w_start <= t AND t < w_end").drop("__cell")


def inside_or_nearest(samples: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """``inside``, and for a window without a sample the one nearest to its middle (the first of equals).

    The middles of empty windows and the samples of their records go by in order, once up and once down, each
    middle taking the last sample seen: steps in proportion to samples and windows.
    """
    found = inside(samples, windows, width)
    empty = windows.join(found.select("record_id", "window_id").distinct(), ["record_id", "window_id"], "left_anti")
    columns = [c for c in samples.columns if c != "record_id"]
    sample, window = F.struct(*columns), F.struct("window_id", "w_start", "w_end")
    points = samples.where("t IS NOT NULL").select("record_id", F.col("t").alias("x"), "seq", sample.alias("__s"), F.lit(None).cast(empty.select(window.alias("w")).schema["w"].dataType).alias("__w"))
    middles = empty.select("record_id", ((F.col("w_start") + F.col("w_end")) / 2).alias("x"), F.lit(None).cast(samples.schema["seq"].dataType).alias("seq"), F.lit(None).cast(points.schema["__s"].dataType).alias("__s"), window.alias("__w"))
    asked = F.col("__w").isNotNull()
    up = Window.partitionBy("record_id").orderBy("x", asked, F.desc("seq"))
    down = Window.partitionBy("record_id").orderBy(F.desc("x"), asked, F.desc("seq"))
    seen = (Window.unboundedPreceding, Window.currentRow)
    passed = points.unionByName(middles).withColumns({"__a": F.last("__s", True).over(up.rowsBetween(*seen)), "__b": F.last("__s", True).over(down.rowsBetween(*seen))})
    a, b = F.col("__a"), F.col("__b")
    far_a, far_b = F.col("x") - a["t"], b["t"] - F.col("x")
    first = b.isNull() | (far_a < far_b) | ((far_a == far_b) & (a["seq"] <= b["seq"]))
    near = passed.where(asked & (a.isNotNull() | b.isNotNull())).withColumn("__n", F.when(first & a.isNotNull(), a).otherwise(b))
    nearest = near.select("record_id", *[F.col("__n")[c].alias(c) for c in columns], "__w.window_id", "__w.w_start", "__w.w_end")
    return found.select(nearest.columns).withColumn("nearest", F.lit(False)).unionByName(nearest.withColumn("nearest", F.lit(True)))


def evenly_chosen(rows: DataFrame, count: int, keys: Sequence[str], order: str) -> DataFrame:
    """``count`` rows of each group, evenly from first to last (halves to even), repeated where there are
    fewer: place 0 .. count - 1 in column ``place``. A count of one takes the first."""
    numbered = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    at = lambda j: F.struct(j.alias("place"), F.rint(j * (F.col("__n") - 1) / max(1, count - 1)).cast("int").alias("__i"))
    wanted = sizes.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at)).alias("__w"))
    return wanted.select(*keys, "__w.place", "__w.__i").join(numbered, [*keys, "__i"]).drop("__i")


def coverage(n, start, end, rate):
    """Samples found over samples expected, at most 1."""
    return F.least(F.lit(1.0), n / F.greatest(F.lit(1.0), (end - start) * rate))


def overlap(shift: DataFrame) -> DataFrame:
    """(record_id, offset, left_duration, right_duration) -> the right-hand span on which both run, start
    and end; under a second it is their common beginning instead."""
    start = F.greatest(F.lit(0.0), F.col("offset"))
    end = F.least(F.col("right_duration"), F.col("left_duration") + F.col("offset"))
    short = end - start < 1.0
    return shift.withColumns({"start": F.when(short, 0.0).otherwise(start), "end": F.when(short, F.least("right_duration", "left_duration")).otherwise(end)})


def mapped(windows: DataFrame) -> DataFrame:
    """Windows of ``overlap`` with their left-hand bounds l_start, l_end; those that map to nothing go."""
    lo = F.greatest(F.lit(0.0), F.col("w_start") - F.col("offset"))
    hi = F.least(F.col("left_duration"), F.col("w_end") - F.col("offset"))
    return windows.withColumns({"l_start": lo, "l_end": hi}).where("l_end > l_start")


def first_of_each_time(rows: DataFrame) -> DataFrame:
    """One sample for each time of a series, the first by seq."""
    k = F.row_number().over(Window.partitionBy("record_id", "channel", "t").orderBy("seq"))
    return rows.withColumn("__k", k).where("__k = 1").drop("__k")


def capped(rows: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group; Spark limits each group before and after the exchange."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__k") <= most).drop("__k")


def decimated(rows: DataFrame, rate: float, wanted: float, most: int, keys: Sequence[str], order: str) -> DataFrame:
    """Every round(rate / wanted)-th row of each group (halves to even, 1 at least), the first ``most``."""
    stride = max(1, round(rate / wanted))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("idx", i).where(F.pmod("idx", F.lit(stride)) == 0).where(F.col("idx") < stride * most).withColumn("t_idx", F.col("idx") / F.lit(rate))
