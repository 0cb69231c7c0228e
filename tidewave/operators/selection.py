"""Choice of channels, weights, samples and folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items whose weights are summed in a task, about.
PART = 10_000


def uniform_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``:``: the same on every engine and run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def chosen_channels(samples: DataFrame, records: int, most: int = 32, share: float = 0.5) -> DataFrame:
    """(channel, coverage, spread, rank): channels with a value in ``share`` of the records (all channels if
    none has), by coverage, then median variance, then name; the first ``most``.

    Two aggregations, per (record, channel) and per channel; the ranking sees one row a channel.
    """
    per_record = samples.where("value IS NOT NULL").groupBy("record_id", "channel").agg(F.var_pop("value").alias("v"))
    per_channel = per_record.groupBy("channel").agg(F.count(F.lit(1)).alias("coverage"), F.median("v").alias("spread"))
    need = max(1, -(-records * share // 1))
    wide = per_channel.agg(F.max("coverage").alias("top"))
    fit = per_channel.crossJoin(F.broadcast(wide)).where((F.col("coverage") >= need) | (F.col("top") < need))  # wide: one row
    ranked = fit.orderBy(F.desc("coverage"), F.desc("spread"), "channel").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("coverage"), F.desc("spread"), "channel"))  # at most ``most`` rows
    return ranked.select("channel", "coverage", "spread", rank.alias("rank"))


def padded(channels: list[str], most: int) -> list[str]:
    """The chosen names, filled up to ``most``."""
    return [*channels[:most], *(f"__padding_{i}" for i in range(len(channels), most))]


def looked_up(values: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """Values for every chosen channel of each key, 0 where there is none."""
    frame = values.select(*keys).distinct().crossJoin(F.broadcast(channels.select("channel", "rank")))  # at most 256 channels
    return frame.join(values, [*keys, "channel"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def class_counts(records: DataFrame, label: str = "label") -> DataFrame:
    return records.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def class_weights(records: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * records of the class)."""
    counts = class_counts(records, label)
    all_ = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(all_)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def label_index(records: DataFrame, label: str = "label") -> DataFrame:
    """Labels with their place in sorted order, from 0."""
    labels = records.select(label).where(F.col(label).isNotNull()).distinct()
    return labels.withColumn("label_id", F.dense_rank().over(Window.orderBy(label)) - 1)  # a row for each class


def window_refs(records: DataFrame) -> DataFrame:
    """A row for each window of records(record_id, label, windows)."""
    return records.where("windows > 0").select("record_id", "label", F.explode(F.sequence(F.lit(0), F.col("windows").cast("int") - 1)).alias("window_id"))


def sample_weights(refs: DataFrame) -> DataFrame:
    """1 / windows of the record / records of the class, for each window."""
    windows = refs.groupBy("record_id").agg(F.count(F.lit(1)).alias("__w"))
    classes = refs.select("label", "record_id").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("__r"))
    return refs.join(windows, "record_id").join(F.broadcast(classes), "label").select("record_id", "window_id", "label", (F.lit(1.0) / F.col("__w") / F.col("__r")).alias("weight"))  # a row for each class


def weighted_draws(items: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draws`` keys drawn with replacement in proportion to their weights (positive ones), with place
    ``draw``: the draw's uniform number falls into the key's share of the weights' running sum.

    Running sums go by hash parts of about PART items and then inside each part. A draw finds its part among
    the parts' sums (a number each, at most 65,536), then its item as the next running sum above it, in one
    ordered pass over the part's items and draws. Every draw gets one key: what rounding puts beyond a
    part's last sum is the part's last item. Without a positive weight there are no rows.
    """
    live = items.where(F.col(weight) > 0)
    parts = int(min(65536, max(64, live.count() // PART)))
    live = live.select(F.floor(uniform_hash(F.lit("part"), F.col(key).cast("string")) * parts).cast("int").alias("part"), F.col(key).alias("key"), F.col(weight).cast("double").alias("w"))
    running = F.sum("w").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    shares = live.select("part", "key", running.alias("hi"))
    ends = sorted((r.part, r.top) for r in shares.groupBy("part").agg(F.max("hi").alias("top")).collect())
    if not ends:
        return items.select(F.lit(0).cast("long").alias("draw"), key).limit(0)
    names, tops = [p for p, _ in ends], np.array([t for _, t in ends])
    upto = np.cumsum(tops)

    @F.pandas_udf("part int, at double")
    def placed(u: pd.Series) -> pd.DataFrame:
        at = u.to_numpy() * upto[-1]
        i = np.minimum(np.searchsorted(upto, at, "right"), len(upto) - 1)
        return pd.DataFrame({"part": np.array(names, np.int32)[i], "at": np.minimum(at - (upto[i] - tops[i]), np.nextafter(tops[i], 0))})

    u = uniform_hash(F.lit(str(seed)), F.col("id").cast("string"))
    wanted = items.sparkSession.range(draws).select("id", placed(u).alias("p")).select("p.part", F.lit(None).cast(items.schema[key].dataType).alias("key"), F.col("p.at").alias("hi"), "id")
    both = shares.withColumn("id", F.lit(None).cast("long")).unionByName(wanted)
    above = Window.partitionBy("part").orderBy(F.desc("hi"), F.col("id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("key", True).over(above)).where("id IS NOT NULL")
    return found.select(F.col("id").alias("draw"), F.col("found").alias(key))


def folds(records: DataFrame, requested: int, seed: int) -> tuple[DataFrame, str]:
    """(record_id, label, fold) and the strategy's name, by records(record_id, label).

    From four records on, with two of each class: stratified, as many folds as asked or as the smallest
    class has records; the order within a class is a seeded hash. Else each record whose class and another
    one remain without it is a fold of its own, numbered by record.

    No task holds a class: its records are numbered by hash parts, after those of the earlier parts. Single
    records are numbered along a distributed sort.
    """
    stats = records.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).first()
    if (stats["all"] or 0) >= 4 and stats["least"] >= 2:
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("record_id").cast("string")))
        place = gapless(records.select("record_id", "label", order.alias("__o")), "label", "__o", "record_id")
        return place.select("record_id", "label", F.pmod("place", F.lit(min(requested, stats["least"]))).cast("int").alias("fold")), "stratified_record_cv"
    sizes = records.groupBy("label").agg(F.count(F.lit(1)).alias("__n")).where(F.lit((stats["k"] or 0) >= 2) & (F.col("__n") >= 2))
    able = records.join(sizes, "label").select("record_id", "label").orderBy("record_id")
    schema = T.StructType([*able.schema.fields, T.StructField("fold", T.IntegerType())])
    return records.sparkSession.createDataFrame(able.rdd.zipWithIndex().map(lambda r: (*r[0], r[1])), schema), "partial_leave_one_record_out"


def gapless(rows: DataFrame, group: str, digest: str, then: str) -> DataFrame:
    """``rows`` with ``place``: 0, 1, ... within each group, by ``digest`` (hex) and ``then``. A group's rows
    are ordered by the digest's first three digits, at most 4096 parts, and inside each."""
    parted = rows.withColumn("__part", F.substring(digest, 1, 3))
    sizes = parted.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # at most 4096 rows
    starts = sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(group, "__part").orderBy(digest, then)) - 1
    found = parted.withColumn("__i", within).join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__p")))
    return found.withColumn("place", F.col("__start") + F.col("__i")).drop("__part", "__group", "__p", "__start", "__i", "__n")
