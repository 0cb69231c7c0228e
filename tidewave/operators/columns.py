"""Tables of any column types as finite numbers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import epoch_micros, finite, magnitude
from ..functions.vectors import summaries
from .normalize import usable_columns

#: Text that reads as a number in this share of its rows is a number.
NUMERIC_SHARE = 0.25


def clean(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_一-鿿]+", "_", name).strip("_") or "unnamed"


def is_complex(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == ["re", "im"]


def parts(field: T.StructField, share: float, length: int | None) -> list[tuple[str, Column]]:
    """The number columns that a field gives, as (name, expression); none if it holds no numbers."""
    name, kind, c = clean(field.name), field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return [(name, epoch_micros(c) / F.lit(1e6))]
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return [(name, finite(c.cast("double")))]
    if is_complex(kind):
        return [(f"{name}_abs", finite(magnitude(c["re"], c["im"]))), (f"{name}_real", finite(c["re"])), (f"{name}_imag", finite(c["im"]))]
    if isinstance(kind, T.StringType):
        return [(name, finite(c.try_cast("double")))] if share >= NUMERIC_SHARE else []
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        if length:
            return [(f"{name}_{i + 1}", F.when(F.size(c) == length, F.abs(finite(F.get(c, F.lit(i)))))) for i in range(length)]
        s = summaries(F.transform(c, lambda x: x.cast("double")))
        return [(f"{name}_{k}", s[k]) for k in ("mean", "std", "max", "energy")]
    return []


def numeric_frame(df: DataFrame, keys: Sequence[str], most: int = 96, vector_limit: int = 16) -> DataFrame:
    """``keys`` and every other column as finite doubles under clean names (equal ones get ``_1``, ``_2``, ...):
    timestamps as epoch seconds, complex structs (re, im) as size and parts, text where a quarter reads as
    numbers, vectors by element if most have one short length and else as four summaries; other types go.

    Columns without any value are left out and the first ``most`` stay. Two aggregations over the table
    decide, whatever its width; the result is a projection.
    """
    fields = [f for f in df.schema.fields if f.name not in keys]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    vectors = [f.name for f in fields if isinstance(f.dataType, T.ArrayType)]
    facts = [F.avg(F.col(f"`{c}`").try_cast("double").isNotNull().cast("int")).alias(f"share {c}") for c in text]
    facts += [F.mode(F.when(F.col(f"`{c}`").isNotNull(), F.size(f"`{c}`")), True).alias(f"length {c}") for c in vectors]
    got = df.agg(*facts).first().asDict() if facts else {}
    lengths = {c: got[f"length {c}"] for c in vectors}
    agree = [F.count_if(F.size(f"`{c}`") == F.lit(lengths[c])).alias(c) for c in vectors if lengths[c] is not None]
    held = [F.count(f"`{c}`").alias(f"all {c}") for c in vectors]
    n = df.agg(*agree, *held).first().asDict() if vectors else {}
    whole = {c: k if (k := lengths[c]) and 0 < k <= vector_limit and n[c] >= max(2, n[f"all {c}"] / 2) else None for c in vectors}
    out: dict[str, Column] = {}
    for f in fields:
        for name, column in parts(f, got.get(f"share {f.name}") or 0.0, whole.get(f.name)):
            free, i = name, 0
            while free in out or free in keys:
                i += 1
                free = f"{name}_{i}"
            out[free] = column
    wide = df.select(*[F.col(f"`{k}`") for k in keys], *[c.alias(name) for name, c in out.items()])
    return wide.select(*keys, *usable_columns(wide, list(out), most))
