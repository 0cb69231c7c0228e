"""Results: cached windows with a manifest, JSON without NaN, fingerprints of files."""

from __future__ import annotations

import functools
import shutil
import sys
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def manifest(spark: SparkSession, cache: str) -> DataFrame | None:
    """What the cache holds (record_id, cache_key, run, windows), the latest run of each, or None before the
    first write."""
    system, there = folder_of(spark, f"{cache}/manifest")
    if not system.exists(there):
        return None
    return latest(spark.read.parquet(f"{cache}/manifest"))


def latest(lines: DataFrame) -> DataFrame:
    """The last of a manifest's lines (record_id, cache_key, at, run, windows) for each result."""
    last = lines.groupBy("record_id", "cache_key").agg(F.max(F.struct("at", "run", "windows")).alias("m"))
    return last.select("record_id", "cache_key", "m.run", "m.windows")


def missing(records: DataFrame, held: DataFrame | None) -> DataFrame:
    """The records (record_id, cache_key, ...) whose results are not in the cache."""
    return records if held is None else records.join(held.select("record_id", "cache_key"), ["record_id", "cache_key"], "left_anti")


def cached_windows(spark: SparkSession, cache: str, records: DataFrame, compute: Callable[[DataFrame], DataFrame], rebuild: bool = False) -> DataFrame:
    """Windows of ``records`` from the cache; ``compute(records)`` runs for what is missing only, or with
    ``rebuild`` for all of ``records``.

    Each call appends its rows (with record_id and cache_key) as a run of its own and then a line for every
    record to the manifest, 0 windows included; of a record computed again the latest run counts. Other
    records stay, and rows of a run that did not reach its manifest are never read.
    """
    wanted = records if rebuild else missing(records, manifest(spark, cache))
    wanted = wanted.select(*records.columns)
    made = compute(wanted)
    schema = T.StructType([*made.schema.fields, T.StructField("run", T.StringType())])
    if not wanted.isEmpty():
        at, run = time.time_ns(), uuid.uuid4().hex
        made.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{cache}/windows")
        counts = spark.read.schema(schema).parquet(f"{cache}/windows").where(F.col("run") == run).groupBy("record_id", "cache_key").agg(F.count(F.lit(1)).alias("windows"))
        line = wanted.select("record_id", "cache_key").distinct().join(counts, ["record_id", "cache_key"], "left")
        line.select("record_id", "cache_key", F.lit(at).alias("at"), F.lit(run).alias("run"), F.coalesce("windows", F.lit(0)).alias("windows")).write.mode("append").parquet(f"{cache}/manifest")
    held = manifest(spark, cache)
    if held is None:
        return made
    own = held.join(records.select("record_id", "cache_key"), ["record_id", "cache_key"], "left_semi")
    return spark.read.schema(schema).parquet(f"{cache}/windows").join(own.select("record_id", "cache_key", "run"), ["record_id", "cache_key", "run"], "left_semi").select(*made.columns)


def manifest_totals(rows: DataFrame) -> DataFrame:
    """Records, windows and cache hits of a manifest with a column ``cache_hit``."""
    return rows.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("windows"), F.lit(0)).cast("long").alias("windows"), F.count_if("cache_hit").alias("cache_hits"))


def unbounded(c: Column, kind: T.DataType) -> Column | None:
    """Whether a value holds a NaN or an infinity, at any depth; None where its type has no such numbers."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: unbounded(x, kind.elementType)), F.lit(False)) if unbounded(F.lit(None), kind.elementType) is not None else None
    if isinstance(kind, T.MapType):
        return unbounded(F.map_values(c), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        found = [x for f in kind.fields if (x := unbounded(c[f.name], f.dataType)) is not None]
        return functools.reduce(lambda a, b: a | b, found) if found else None
    return None


def no_nan(df: DataFrame) -> DataFrame:
    """Raises when a NaN or infinity would be written, in a column or inside an array, map or struct."""
    for f in df.schema.fields:
        bad = unbounded(F.col(f"`{f.name}`"), f.dataType)
        if bad is not None:
            df = df.where(F.assert_true(~bad, F.lit("NaN or infinity in a result")).isNull())
    return df


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON document."""
    return no_nan(df).select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    no_nan(df).write.mode("overwrite").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes, on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", sha256_of(F.col("content")).alias("sha256"))


def sha256_of(content: Column) -> Column:
    return F.sha2(content, 256)


def folder_of(spark: SparkSession, path: str):
    """The file system of a path, local or any that Spark knows, and the path in it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table, read back: what follows neither plans nor runs again what came before."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reset(spark: SparkSession, path: str) -> str:
    """An empty folder in place of whatever was there."""
    system, there = folder_of(spark, path)
    system.delete(there, True)
    system.mkdirs(there)
    return str(path)


def clean_cache(path: str | Path, spark: SparkSession | None = None) -> bool:
    """Removes the cache; whether there was one. With a session the path may be on any file system."""
    if spark is not None:
        system, there = folder_of(spark, str(path))
        return system.delete(there, True)
    there = Path(path).exists()
    shutil.rmtree(path, ignore_errors=True)
    return there


def environment(spark: SparkSession) -> dict[str, str]:
    return {"python": sys.version.split()[0], "spark": spark.version, "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism)}
