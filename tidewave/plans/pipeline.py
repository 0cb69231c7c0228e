"""From a folder of paired recordings to windows, quality, folds and metrics: one plan over all records."""

from __future__ import annotations

import functools
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import columns as C
from ..operators import inspect as INS
from ..operators import metrics as M
from ..operators import normalize as N
from ..operators import resample as R
from ..operators import selection as SEL
from ..operators import timeaxis as T
from ..operators import windows as W
from ..sources import files as FI
from ..sources import mat as MAT
from ..sources import sinks as SK
from ..sources.settings import Settings


def sequences(wide: DataFrame, record: str, order: str, duration: str | None = None, most: int = 96) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of tables as recorded, all records in one: samples(record_id, seq, t, channel, value), activity
    (record_id, seq, t, activity) and meta(record_id, rate_hz, time_source, duration, valid_ratio)."""
    columns = [c for c in wide.columns if c not in (record, order)]
    timed = T.inferred(wide, record, order, columns, duration).withColumnsRenamed({record: "record_id", order: "seq"})
    numbers = C.numeric_frame(timed.drop("rate_hz", "time_source"), ["record_id", "seq", "t"], most)
    long = N.melted(numbers, ["record_id", "seq", "t"], [c for c in numbers.columns if c not in ("record_id", "seq", "t")])
    clock = timed.groupBy("record_id").agg(F.max("rate_hz").alias("rate_hz"), F.max("time_source").alias("time_source"), (F.max_by("t", "seq") - F.min_by("t", "seq") + 1 / F.greatest(F.max("rate_hz"), F.lit(1e-9))).alias("duration"))
    valid = long.groupBy("record_id").agg(F.avg(F.col("value").isNotNull().cast("int")).alias("valid_ratio"))
    return long, N.activity(long), clock.join(valid, "record_id")


def clocks(samples: DataFrame) -> DataFrame:
    """(record_id, rate_hz, duration) of each record, by its own times."""
    rows = samples.groupBy("record_id", "seq").agg(F.min("t").alias("t"))
    return T.record_meta(rows).select("record_id", "rate_hz", "duration")


def preprocessed(left: DataFrame, right: DataFrame, settings: Settings, work: str, channels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows, series) of left samples(record_id, seq, t, channel, value) and a right timeline(record_id,
    seq, t, activity, detected), each record at its own rate.

    windows: record_id, window_id, bounds on both clocks, coverage of both sides, detected rate and alignment
    score (0 at least). series: the chosen channels of each window at even points, scaled within the window;
    ``channels`` are the chosen ones, by default those of ``left``. Tables that are used more than once are
    written below the folder ``work``, which driver and executors share.
    """
    activity = SK.stored(N.activity(left).withColumnRenamed("activity", "value"), f"{work}/activity")
    shift = R.alignment(activity, right.withColumnRenamed("activity", "value"), settings.max_alignment_lag_seconds).select("record_id", "offset", "score")
    own = clocks(left).withColumnRenamed("duration", "left_duration")
    ends = own.join(right.groupBy("record_id").agg(F.max("t").alias("right_duration"), F.count(F.lit(1)).alias("frames")), "record_id")
    spans = W.overlap(shift.join(ends, "record_id"))
    both = SK.stored(W.mapped(W.hopping(spans, settings.window_seconds, settings.window_stride_seconds, settings.max_windows_per_record)), f"{work}/spans")

    length, keys = settings.window_seconds, ["record_id", "window_id"]
    on_left = both.select(*keys, F.col("l_start").alias("w_start"), F.col("l_end").alias("w_end"))
    n_left = W.inside(activity.select("record_id", "seq", "t"), on_left, length).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    frames = SK.stored(W.inside_or_nearest(right.select("record_id", "seq", "t", "detected"), both.select(*keys, "w_start", "w_end"), length), f"{work}/frames")
    n_right = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    detected = W.evenly_chosen(frames, settings.frames_per_window, keys, "seq").groupBy(*keys).agg(F.avg(F.col("detected").cast("int")).alias("detected_rate"))

    rate_right = F.greatest(F.lit(1e-6), F.col("frames") / F.col("right_duration"))
    windows = both.join(n_left, keys, "left").join(n_right, keys).join(detected, keys)
    windows = windows.select(
        *keys, "w_start", "w_end", "l_start", "l_end", W.coverage(F.coalesce("n_left", F.lit(0)), F.col("l_start"), F.col("l_end"), F.col("rate_hz")).alias("coverage_left"),
        W.coverage(F.col("n_right"), F.col("w_start"), F.col("w_end"), rate_right).alias("coverage_right"), "detected_rate", F.greatest(F.lit(0.0), F.col("score")).alias("alignment_score"),
    )
    if channels is None:
        channels = SEL.chosen_channels(left, left.select("record_id").distinct().count(), settings.channels)
    lines = SK.stored(R.window_series(left, on_left, channels, settings.steps), f"{work}/lines")
    series = N.robust_scaled(lines, [*keys, "channel"], least=1e-6, std_next=False, bound=8.0)
    return windows, series.select(*keys, "channel", "i", "z")


def window_rows(windows: DataFrame, series: DataFrame) -> DataFrame:
    """One row for each window, with its series as a map from channel to values in order."""
    keys = ["record_id", "window_id"]
    points = F.array_sort(F.collect_list(F.struct("i", "z")))  # the steps of one window
    lines = series.groupBy(*keys, "channel").agg(F.transform(points, lambda p: p["z"]).alias("v"))
    maps = lines.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "v")))).alias("series"))
    return windows.join(maps, keys)


def keyed(records: DataFrame, settings: Settings, schema: list[str]) -> DataFrame:
    """Records with the key of their cached result: files, settings and channels."""
    print_ = lambda side: S.file_fingerprint(F.col(f"{side}_path"), F.col(f"{side}_size"), F.col(f"{side}_modified"))
    parts = [F.col("record_id"), print_("left").alias("left"), print_("right").alias("right"), F.lit(S.config_hash(settings.computed_with())).alias("settings"), F.lit(",".join(schema)).alias("schema"), F.lit(3).alias("version")]
    return records.withColumn("cache_key", S.record_key(parts))


#: Endings of recordings: Parquet and MATLAB containers.
TABLES = ("parquet", "mat")


def recorded(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All recordings of a kind in a folder as one table, with record_id and the rows' numbers in their files.
    Columns that a recording lacks are null."""
    files = FI.discovered(spark, folder, TABLES).where(F.col("kind") == kind)
    endings = {r[0] for r in files.select(F.substring_index("path", ".", -1)).distinct().collect()}  # two at most
    pattern = f"{''.join(f'[{c}{c.upper()}]' for c in kind)}_*"
    tables = []
    if "mat" in endings:
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
        found = MAT.tables(MAT.listing(spark, folder, f"{pattern}.mat").where(FI.parsed_name(stem).isNotNull()))
        tables.append(found.select(FI.parsed_name(stem)["record_id"].alias("record_id"), "seq", *[F.col(f"`{c}`") for c in found.columns[2:]]))
    if "parquet" in endings or not endings:
        found = spark.read.option("pathGlobFilter", f"{pattern}.parquet").option("mergeSchema", "true").parquet(folder)
        stem = F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.[^.]*$", "")
        tables.append(found.select(FI.parsed_name(stem)["record_id"].alias("record_id"), F.col("_metadata.row_index").alias("seq"), *[F.col(f"`{c}`") for c in found.columns]))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).where("record_id IS NOT NULL")


def evaluated(records: DataFrame, scores: DataFrame, settings: Settings) -> dict[str, Any]:
    """Window scores pooled to records and held against their labels."""
    pooled = M.pooled(scores)
    predictions = records.select("record_id", "label").join(pooled.select("record_id", "prediction", "confidence", "windows"), "record_id")
    found = M.validity(records, predictions).first().asDict()
    return {**found, **M.summary(predictions).first().asDict(), "classes": [r.asDict() for r in M.class_report(predictions).orderBy("class").collect()]}


def whole_run(spark: SparkSession, settings: Settings, folder: str, cache: str, out: str, scores: DataFrame | None = None, rebuild: bool = False) -> dict[str, Any]:
    """Everything from a folder of recordings: pairs, inspection (nothing more where it fails), windows by way
    of the cache, folds and, where window scores are given, their evaluation. Writes ``windows``, ``folds``
    and ``result`` below ``out`` and gives the result document."""
    SK.reset(spark, out)
    work = f"{out}/work"
    files = SK.stored(FI.checked_size(FI.discovered(spark, folder, TABLES)), f"{work}/files")
    pairs = FI.pair_report(files)
    bad = [r.asDict() for r in pairs.where("status <> 'ok'").select("record_id", "status").orderBy("record_id").limit(100).collect()]
    result: dict[str, Any] = {"profile": settings.profile, "environment": SK.environment(spark)}

    def ended(status: str, **more: Any) -> dict[str, Any]:
        document = {"status": status, **result, **more}
        SK.write_json(spark.createDataFrame([(status, json.dumps(document, allow_nan=False, sort_keys=True, default=str))], "status string, result string"), f"{out}/result")
        return document

    if bad or pairs.isEmpty():
        return ended("failed_data_inspection", faults=bad)
    found, _, _ = sequences(recorded(spark, folder, FI.LEFT), "record_id", "seq", most=max(96, 3 * settings.channels))
    samples = SK.stored(found, f"{work}/samples")
    timeline = recorded(spark, folder, FI.RIGHT)
    items, fault = inspected(samples)
    if fault:
        return ended("failed_data_inspection", faults=[r.asDict() for r in items.where("error IS NOT NULL").select("record_id", "error").orderBy("record_id").limit(100).collect()])

    facts = lambda kind, side: files.where(F.col("kind") == kind).select("record_id", F.col("size").alias(f"{side}_size"), F.col("modified").alias(f"{side}_modified"))
    records = FI.paired(files).join(facts(FI.LEFT, "left"), "record_id").join(facts(FI.RIGHT, "right"), "record_id")
    chosen = SEL.chosen_channels(samples, records.count(), settings.channels)
    names = [r.channel for r in chosen.orderBy("rank").collect()]  # at most settings.channels
    channels = spark.createDataFrame([(n,) for n in names], "channel string")
    keys = keyed(records, settings, SEL.padded(names, settings.channels))

    def compute(wanted: DataFrame) -> DataFrame:
        only = wanted.select("record_id")
        rows = window_rows(*preprocessed(samples.join(only, "record_id", "left_semi"), timeline.join(only, "record_id", "left_semi"), settings, work, channels))
        return rows.join(wanted.select("record_id", "cache_key"), "record_id")

    hits = keys.count() if rebuild else keys.count() - SK.missing(keys, SK.manifest(spark, cache)).count()
    windows = SK.cached_windows(spark, cache, keys, compute, rebuild)
    SK.no_nan(windows).write.mode("overwrite").parquet(f"{out}/windows")
    folds, strategy = SEL.folds(records, settings.evaluation_folds, settings.seed)
    folds.write.mode("overwrite").parquet(f"{out}/folds")
    held = SK.manifest(spark, cache).join(keys.select("record_id", "cache_key"), ["record_id", "cache_key"], "left_semi")
    result |= {
        "classes": {r.label: r.n for r in SEL.class_counts(records).collect()}, "channels": names, "folds": strategy,
        "cache": SK.manifest_totals(held.withColumn("cache_hit", F.lit(False))).first().asDict() | {"cache_hits": 0 if rebuild else hits},
    }
    return ended("complete", **({"evaluation": evaluated(records, scores, settings)} if scores is not None else {}))


def inspected(samples: DataFrame) -> tuple[DataFrame, int]:
    """The report of every record and an exit status: 0, or 2 if any has an error."""
    items = INS.report(samples)
    return items, 0 if INS.status(items).first()["status"] == "ok" else 2
