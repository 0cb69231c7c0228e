"""What the operators of this subpackage share on the Spark side: the cluster's shared folder,
written tables that cut lineage, and gapless numbering without a task that holds a whole group."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes that a Python worker gets at a time (one row at least).
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, so that long texts do not fill the workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "67108864b")
    if not now.removesuffix("b").isdigit() or not 0 < int(now.removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. Where it is unset, on one
    machine (tests) a folder below the temporary one is set; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: later jobs survive the loss of any
    executor without running what came before. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def in_few(df: DataFrame, rows: int, per: int = 50_000) -> DataFrame:
    """``df``, which has at most about ``rows`` rows, in no more tasks than two for each core or one for ``per`` rows: where
    there are more shuffle partitions than that, a task takes several of them, one after another. Nothing is shuffled."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // per)))


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one as a path that ``open`` and ``mmap`` take on every machine."""
    folder = shared_folder(spark)
    scheme, _, rest = folder.partition("://") if "://" in folder else ("file", "", folder.removeprefix("file:"))
    if scheme != "file":
        raise ValueError(f"memory-mapped files need spark.checkpoint.dir to be a mounted path (file://...), not {folder}")
    path = f"/{rest.lstrip('/')}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    delete_at_exit(spark, f"file://{path}")
    return path


def gapless(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, rows: int, per_bucket: int = 1000, most: int = 65536) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each ``group``, without gaps.

    The rows of a group are dealt by a hash of ``order`` into buckets of about ``per_bucket`` rows
    (``rows`` is the table's count; at most ``most`` buckets a group); a bucket's rows are numbered by
    ``order``, after the rows of the group's earlier buckets. No task holds a group, whatever its share.
    ``df`` is read twice and must give the same rows each time.
    """
    spare = "__bucket"
    buckets = max(1, min(most, rows // per_bucket))
    dealt = df.withColumn(spare, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy(spare).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*group, spare).agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*group, spare).orderBy(*order)
    numbered = dealt.withColumn("__i", F.row_number().over(within) - 1)
    joined = numbered.alias("l").join(starts.alias("r"), on=[equal(F.col(f"l.{c}"), F.col(f"r.{c}")) for c in (*group, spare)])
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r.__start") + F.col("l.__i")).cast("long").alias(name))


#: Bytes that are broadcast at most, as estimated from a count of rows.
BROADCAST_BYTES = 48 << 20
#: A key with over one in so many rows (and over LIGHT rows) is heavy: there can be no more than that.
HEAVY_KEYS, LIGHT = 100_000, 1000


def fits(size: int) -> bool:
    """Whether so many bytes may be broadcast."""
    return size <= BROADCAST_BYTES


def with_heavy(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and which says in ``weight`` how many of the at
    most ``rows`` rows of ``left`` a key has. Heavy keys, of which there are at most HEAVY_KEYS, are broadcast;
    the others are shuffled, so that no key sends more than one in HEAVY_KEYS rows (or LIGHT) to one task."""
    most = max(LIGHT, rows // HEAVY_KEYS)
    heavy, light = right.where(F.col(weight) > most), right.where(F.col(weight) <= most)
    if heavy.isEmpty():
        return left.join(right, list(keys), how)
    rest = left.join(F.broadcast(heavy.select(*keys)), list(keys), "left_anti")
    return left.join(F.broadcast(heavy), list(keys)).unionByName(rest.join(light, list(keys), how))


def own_nodes(docs: DataFrame, key: str, node: str) -> DataFrame:
    """``docs`` with a column ``node`` that no two rows share: the key, or for null keys and all but one row
    of a repeated key a number above the keys (below them, where they end too high)."""
    at = F.col(key).cast("long")
    repeated = written(docs.groupBy(at.alias("__key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR __key IS NULL").select("__key"), "repeated")
    several = repeated.count()
    if not several:
        return docs.withColumn(node, at)
    keys = F.broadcast(repeated) if fits(8 * several) else repeated
    again = written(docs.join(keys, equal(at, F.col("__key")), "left_semi").withColumn("__row", F.monotonically_increasing_id()), "again")
    first = again.where(at.isNotNull()).groupBy(at.alias("__key")).agg(F.min("__row").alias("__row")).select("__row", F.col("__key").alias(node))
    low, high, most = (x or 0 for x in docs.agg(F.min(at), F.max(at)).first()[:2] + again.agg(F.max("__row")).first()[:1])
    if high + most + 1 < 1 << 63:
        number = F.lit(high + 1) + F.col("__row")
    elif low - most - 1 >= -(1 << 63):
        number = F.lit(low - 1) - F.col("__row")
    else:
        raise ValueError(f"{key} leaves no room for the rows that repeat it")
    numbered = again.join(first, "__row", "left").withColumn(node, F.coalesce(F.col(node), number)).drop("__row")
    return docs.join(keys, equal(at, F.col("__key")), "left_anti").withColumn(node, at).unionByName(numbered)


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
