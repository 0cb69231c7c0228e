"""Series on a common grid, and the lag at which two of them agree best."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolated(samples: DataFrame, grid: DataFrame, keys: Sequence[str], value: str = "value", order: str = "seq") -> DataFrame:
    """grid(keys, i, x) with the value of each series at x: on the line between the samples around it, and
    the first or last value outside. Series with under two values are 0 throughout.

    Samples and grid points are united and go by in order, once up and once down, each carrying the last
    sample seen: no range join, and steps in proportion to the points.
    """
    ok = samples.where(F.col(value).isNotNull() & F.col("t").isNotNull())
    first = F.row_number().over(Window.partitionBy(*keys, "t").orderBy(order))
    points = ok.withColumn("__k", first).where("__k = 1").select(*keys, F.col("t").alias("x"), F.lit(0).alias("__grid"), F.col(value).alias("__v"), F.lit(None).cast("long").alias("i"))
    asked = grid.select(*keys, "x", F.lit(1).alias("__grid"), F.lit(None).cast("double").alias("__v"), F.col("i").cast("long").alias("i"))
    series = Window.partitionBy(*keys)
    up, down = series.orderBy("x", "__grid"), series.orderBy(F.desc("x"), F.desc("__grid"))
    seen = (Window.unboundedPreceding, Window.currentRow)
    pair = F.when(F.col("__grid") == 0, F.struct(F.col("x").alias("t"), F.col("__v").alias("v")))
    around = points.unionByName(asked).withColumns({
        "__a": F.last(pair, True).over(up.rowsBetween(*seen)),
        "__b": F.last(pair, True).over(down.rowsBetween(*seen)),
        "__n": F.count("__v").over(series),
    })
    a, b = F.col("__a"), F.col("__b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("x") - a["t"]) / (b["t"] - a["t"])
    found = F.when(F.col("__n") < 2, 0.0).when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == F.col("x")), a["v"]).otherwise(line)
    return around.where("__grid = 1").select(*keys, "i", "x", found.alias(value))


def uniform_grid(spans: DataFrame, step: float) -> DataFrame:
    """spans(keys..., duration) -> points i = 0, 1, ... at x = i * step below the duration."""
    n = F.ceil(F.col("duration") / step).cast("long")
    others = [c for c in spans.columns if c != "duration"]
    return spans.where("duration > 0").select(*others, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i")).withColumn("x", F.col("i") * F.lit(step))


def window_grid(windows: DataFrame, steps: int, start: str = "w_start", end: str = "w_end") -> DataFrame:
    """``steps`` even points of each window, its end left out."""
    return windows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("x", F.col(start) + F.col("i") * (F.col(end) - F.col(start)) / steps)


def window_series(samples: DataFrame, windows: DataFrame, channels: DataFrame, steps: int) -> DataFrame:
    """(record_id, window_id, channel, i, value): each channel of ``channels`` at ``steps`` points of each
    window, from its whole series; a channel without two values in a record is 0.

    The points of all windows of a record and channel are found in one ordered pass over the series.
    """
    grid = window_grid(windows, steps).crossJoin(F.broadcast(channels.select("channel")))  # the chosen channels: at most 256 rows
    flat = grid.withColumn("point", F.col("window_id").cast("long") * steps + F.col("i"))
    found = interpolated(samples, flat.select("record_id", "channel", F.col("point").alias("i"), "x"), ["record_id", "channel"])
    return found.select("record_id", F.floor(F.col("i") / steps).cast("int").alias("window_id"), "channel", F.pmod("i", F.lit(steps)).cast("int").alias("i"), "value")


#: Points of the left side in a block.
BLOCK = 4096


def lagged_products(left: DataFrame, right: DataFrame, lags: int) -> DataFrame:
    """(record_id, lag, n, c): of left(record_id, i, a, n) and right(record_id, i, b), for each block of left
    points and each lag from -lags to lags, the sum of a at i times b at i + lag. Null values add nothing."""
    size = max(BLOCK, 4 * lags)
    block = lambda i: F.floor(i / size).cast("long")
    own = left.where("a IS NOT NULL").groupBy("record_id", block(F.col("i")).alias("block")).agg(F.max("n").alias("n"), F.collect_list(F.struct("i", F.col("a").alias("v"))).alias("own"))
    near = F.explode(F.sequence(block(F.col("i") - lags), block(F.col("i") + lags))).alias("block")
    others = right.where("b IS NOT NULL").select("record_id", near, "i", F.col("b").alias("v")).groupBy("record_id", "block").agg(F.collect_list(F.struct("i", "v")).alias("others"))

    def dense(points: pa.ListScalar, first: int, n: int) -> np.ndarray:
        out = np.zeros(n)
        out[points.values.field("i").to_numpy() - first] = points.values.field("v").to_numpy()
        return out

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lag = pa.array(np.arange(-lags, lags + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                first = batch.column(1)[i].as_py() * size
                c = np.correlate(dense(batch.column(4)[i], first - lags, size + 2 * lags), dense(batch.column(3)[i], first, size), "valid")
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(lag)), lag, pa.repeat(batch.column(2)[i], len(lag)), pa.array(c)], names=["record_id", "lag", "n", "c"])

    kind = left.schema["record_id"].dataType.simpleString()
    both = own.join(others, ["record_id", "block"]).select("record_id", "block", "n", "own", "others")
    return both.mapInArrow(summed, f"record_id {kind}, lag long, n long, c double")


STATUSES = ("insufficient_activity", "insufficient_duration", "flat_activity", "ok")


def alignment(left: DataFrame, right: DataFrame, max_lag: float, rate: float = 2.0, least_duration: float = 2.0) -> DataFrame:
    """(record_id, offset, score, status) from left and right (record_id, seq, t, value).

    Both go onto a grid of ``rate`` points a second up to the earlier last time, lose their line and are
    divided by their deviation. The lag in [-max_lag, max_lag] with the greatest sum of products holds (the
    smallest of equals); positive: the right one is later. Score: the sum by the points in common, within
    [-1, 1]. Under four samples, a duration up to ``least_duration`` or a flat series: offset and score 0.

    The sums go by blocks of points: a block of the left side meets the right side's points within the
    longest lag of it, in one Arrow row, and gives its part of every lag's sum.
    """
    step = 1.0 / rate
    lags = round(max_lag * rate)
    side = lambda s, p: s.groupBy("record_id").agg(F.count(F.lit(1)).alias(f"{p}n"), F.max("t").alias(f"{p}end"))
    sizes = side(left, "l").join(side(right, "r"), "record_id").withColumn("duration", F.least("lend", "rend"))
    few = (F.col("ln") < 4) | (F.col("rn") < 4)
    short = F.coalesce(F.col("duration") <= least_duration, F.lit(True))
    grid = uniform_grid(sizes.where(~few & ~short).select("record_id", "duration"), step)

    def standard(s: DataFrame, name: str) -> DataFrame:
        line = interpolated(s, grid, ["record_id"])
        w = Window.partitionBy("record_id")
        mean_i, mean_v = F.avg("i").over(w), F.avg("value").over(w)
        slope = F.covar_pop("i", "value").over(w) / F.var_pop("i").over(w)
        flat = line.withColumn("y", F.col("value") - (mean_v + F.coalesce(slope, F.lit(0.0)) * (F.col("i") - mean_i)))
        return flat.withColumns({"sd": F.stddev_pop("y").over(w), "n": F.count(F.lit(1)).over(w)}).select("record_id", "i", F.when(F.col("sd") >= 1e-8, F.col("y") / F.col("sd")).alias(name), *(["n"] if name == "a" else []))

    a, b = standard(left, "a"), standard(right, "b")
    sums = lagged_products(a, b, lags).groupBy("record_id", "lag").agg(F.max("n").alias("n"), F.sum("c").alias("c")).where(F.abs("lag") < F.col("n"))
    best = sums.groupBy("record_id").agg(F.max(F.struct(F.round("c", 9).alias("c"), (-F.col("lag")).alias("neg"), F.col("n"))).alias("top"))
    score = F.col("top.c") / F.greatest(F.lit(1), F.col("top.n") - F.abs(F.col("top.neg")))
    found = sizes.join(best, "record_id", "left")
    status = F.when(few, STATUSES[0]).when(short, STATUSES[1]).when(F.col("top.c").isNull(), STATUSES[2]).otherwise(STATUSES[3])
    good = status == STATUSES[3]
    return found.select("record_id", F.when(good, -F.col("top.neg") / F.lit(rate)).otherwise(0.0).alias("offset"), F.when(good, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))).otherwise(0.0).alias("score"), status.alias("status"))
