"""Recordings in folders: names, pairs, checks; tables kept as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import char_text, clean_name
from ..functions.vectors import fit_length, unique_texts

# The layout of file names, ``<kind>_<batch>_class-<label>_<time>``, with the kinds and endings in use.
NAME = r"(?i)^(ir|radar)_([^_]+)_(class-[^_]+)_(.+)$"
LEFT, RIGHT = "radar", "ir"
ENDINGS = ("mat", "mp4")


def parsed_name(stem: Column) -> Column:
    """Struct of kind, record_id, label and start_time from a file's stem; null where it does not fit."""
    part = lambda i: F.regexp_extract(stem, NAME, i)
    return F.when(
        stem.rlike(NAME),
        F.struct(F.lower(part(1)).alias("kind"), part(2).alias("record_id"), part(3).alias("label"), F.replace(part(4), F.lit("："), F.lit(":")).alias("start_time")),
    )


def discovered(spark: SparkSession, folder: str, endings: Sequence[str] = ENDINGS) -> DataFrame:
    """Files of a folder (not below it) whose names fit: path, size, modified, name and its parts.

    Only listings are read, never contents; what does not fit is left out.
    """
    files = None
    for ending in endings:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").option("recursiveFileLookup", "false").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        files = found if files is None else files.unionByName(found)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    files = files.withColumn("name", name).withColumn("parts", parsed_name(F.regexp_replace("name", r"\.[^.]*$", "")))
    return files.where("parts IS NOT NULL").select("path", "size", "modified", "name", "parts.*")


def checked_size(files: DataFrame) -> DataFrame:
    """Raises for empty files when evaluated."""
    return files.where(F.assert_true(F.col("size") > 0, F.concat(F.lit("empty file: "), "path")).isNull())


def pair_report(files: DataFrame) -> DataFrame:
    """One row for each record: paths, label, start time (of the right kind if it has one) and status,
    which is ok, left_only, right_only, duplicate or label_conflict."""
    side = lambda kind, c: F.min(F.when(F.col("kind") == kind, F.col(c)))
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    rows = files.groupBy("record_id").agg(
        n(LEFT).alias("n_left"), n(RIGHT).alias("n_right"), F.min("label").alias("label"), F.max("label").alias("other_label"),
        side(LEFT, "path").alias("left_path"), side(RIGHT, "path").alias("right_path"), F.coalesce(side(RIGHT, "start_time"), side(LEFT, "start_time")).alias("start_time"),
    )
    status = (
        F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate")
        .when(F.col("label") != F.col("other_label"), "label_conflict")
        .when(F.col("n_right") == 0, "left_only")
        .when(F.col("n_left") == 0, "right_only")
        .otherwise("ok")
    )
    return rows.select("record_id", "label", "left_path", "right_path", "start_time", status.alias("status"))


def paired(files: DataFrame) -> DataFrame:
    """Complete pairs only; anything else raises when evaluated, with the record and its fault."""
    report = pair_report(files)
    fine = F.assert_true(F.col("status") == "ok", F.concat_ws(" ", F.lit("record"), "record_id", F.lit("is"), "status"))
    return report.where(fine.isNull()).select("record_id", "label", "left_path", "right_path", "start_time")


def array_table(df: DataFrame, key: str, data: str, names: str, rows: str | None = None, row_names: str | None = None, table: str = "table") -> DataFrame:
    """A table kept as arrays in long form: key, column number, name, row number, value (and row_name).

    ``data`` is a list of variables, each a list of values or a list of lists (two dimensions). A variable of
    two dimensions whose rows number the table's becomes the columns ``name_1`` ...; one whose columns do is
    turned; another is read row by row. Columns are cut or padded to the table's rows: ``rows`` (a number or its
    text), or without a positive one the longest variable's. Names are texts or lists of characters, cleaned;
    a missing one is ``<table>_<place>``, and a name that is taken gets ``_2``, ``_3``, ..., the first that is
    free. Row names hold if there is one for each row; an empty one is the row's number.
    """
    kind = df.schema[data].dataType.elementType
    flat = not isinstance(kind.elementType, T.ArrayType)
    given = F.try_to_number(F.col(rows), F.lit("999999999999")).cast("long") if rows and isinstance(df.schema[rows].dataType, T.StringType) else F.col(rows).cast("long") if rows else F.lit(None).cast("long")
    n = F.coalesce(F.when(given > 0, given), F.array_max(F.transform(data, F.size)).cast("long")).cast("int")
    text = (lambda x: char_text(x)) if isinstance(df.schema[names].dataType.elementType, T.ArrayType) else (lambda x: x)
    sized = df.select(F.col(key), F.col(data).alias("__d"), F.transform(names, text).alias("__n"), n.alias("__rows"), *([F.col(row_names).alias("__rn")] if row_names else []))
    sized = sized.where("__rows > 0")

    def columns(v: Column, i: Column) -> Column:
        name = clean_name(F.coalesce(F.nullif(F.get("__n", i), F.lit("")), F.concat(F.lit(f"{table}_"), (i + 1).cast("string"))))
        one = lambda x: F.array(F.struct(name.alias("name"), fit_length(x, F.col("__rows")).alias("values")))
        if flat:
            return one(v)
        wide, high = F.size(F.get(v, F.lit(0))), F.size(v)
        label = lambda j, k: F.when(k == 1, name).otherwise(F.concat(name, F.lit("_"), (j + 1).cast("string"))).alias("name")
        by_rows = F.transform(F.sequence(F.lit(0), wide - 1), lambda j: F.struct(label(j, wide), F.transform(v, lambda r: F.get(r, j)).alias("values")))
        turned = F.transform(F.sequence(F.lit(0), high - 1), lambda j: F.struct(label(j, high), F.get(v, j).alias("values")))
        return F.when((high == F.col("__rows")) & (wide > 0), by_rows).when((wide == F.col("__rows")) & (high > 0), turned).otherwise(one(F.flatten(v)))

    listed = sized.withColumn("__c", F.flatten(F.transform("__d", columns)))
    free = unique_texts(F.transform("__c", lambda c: c["name"]))
    cells = listed.withColumn("__free", free).select(
        key, *(["__rn"] if row_names else []), "__rows", F.posexplode(F.arrays_zip(F.transform("__c", lambda c: c["values"]).alias("values"), F.col("__free").alias("name"))).alias("column", "__c")
    )
    cells = cells.select(key, *(["__rn", "__rows"] if row_names else []), "column", F.col("__c.name").alias("name"), F.posexplode("__c.values").alias("row", "value"))
    if not row_names:
        return cells
    named = F.coalesce(F.nullif(F.get("__rn", F.col("row")), F.lit("")), F.col("row").cast("string"))
    return cells.withColumn("row_name", F.when(F.size("__rn") == F.col("__rows"), named)).drop("__rn", "__rows")


#: Rows of a table that may be its columns.
FEW = 8


def transposed(wide: DataFrame, key: str, columns: Sequence[str], prefix: str = "signal") -> DataFrame:
    """At most eight long rows as long columns: one row for each column of ``wide``, with ``prefix_0`` ... from
    its rows in order of ``key``. More rows are an error."""
    keys = [r[0] for r in wide.select(key).orderBy(key).limit(FEW + 1).collect()]
    if len(keys) > FEW:
        raise ValueError(f"more than {FEW} rows cannot become columns")
    long = wide.unpivot([key], list(columns), "column", "value")
    at = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return long.groupBy(at[F.col("column")].alias("row")).agg(*[F.max(F.when(F.col(key) == k, F.col("value"))).alias(f"{prefix}_{i}") for i, k in enumerate(keys)])


def by_shape(wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``wide``, or ``transposed`` where it has at most eight rows and fewer of them than columns."""
    n = len(wide.select(key).limit(FEW + 1).collect())
    return transposed(wide, key, columns) if n <= FEW and n < len(columns) else wide


def largest(candidates: Sequence[tuple[str, int, int]]) -> str:
    """The name of the candidate with the most cells (rows times columns, one at least); first among equals."""
    if not candidates:
        raise ValueError("no table among the variables")
    return max(candidates, key=lambda c: c[1] * max(1, c[2]))[0]
