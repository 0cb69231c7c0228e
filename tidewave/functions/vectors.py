"""Columns of vectors: expansion to scalars or summaries, padding, transposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import finite


def fit_length(array: Column, n: Column | int) -> Column:
    """The first ``n`` elements, with nulls behind where there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(array) >= n, F.slice(array, 1, n)).otherwise(F.concat(array, F.array_repeat(F.lit(None), n - F.size(array))))


def unique_texts(names: Column, first: int = 2) -> Column:
    """An array of names in which a name that is taken gets the first free one of ``_2``, ``_3``, ..."""

    def add(used: Column, name: Column) -> Column:
        more = F.transform(F.sequence(F.lit(first), F.size(used) + first), lambda k: F.concat(name, F.lit("_"), k.cast("string")))
        free = F.get(F.filter(more, lambda c: ~F.array_contains(used, c)), F.lit(0))
        return F.concat(used, F.array(F.when(F.array_contains(used, name), free).otherwise(name)))

    return F.aggregate(names, F.array().cast("array<string>"), add)


def summaries(vector: Column) -> Column:
    """mean, std (population), max and energy (mean of squares) of the finite magnitudes; null if none."""
    size = F.filter(F.transform(vector, lambda x: F.abs(finite(x))), lambda x: x.isNotNull())
    n = F.nullif(F.size(size), F.lit(0)).cast("double")
    total = F.aggregate(size, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(size, F.lit(0.0), lambda a, x: a + x * x)
    mean = total / n
    spread = F.aggregate(size, F.lit(0.0), lambda a, x: a + (x - total / n) * (x - total / n))
    return F.struct(mean.alias("mean"), F.sqrt(spread / n).alias("std"), F.array_max(size).alias("max"), (squares / n).alias("energy"))


def expanded(df: DataFrame, vector: str, limit: int) -> DataFrame:
    """``vector`` as columns ``vector_1`` ... of magnitudes, if the commonest length (smallest among
    equals) is 1 to ``limit`` and holds for at least half of the rows and two; else as four summaries.

    One aggregation decides; the expansion itself is a projection.
    """
    sizes = df.where(F.col(vector).isNotNull()).agg(F.mode(F.size(vector), True).alias("k"), F.count(F.lit(1)).alias("n")).first()
    common, rows = sizes["k"], sizes["n"]
    agreeing = df.where(F.size(vector) == common).count() if common is not None else 0
    if common is not None and 0 < common <= limit and agreeing >= max(2, rows / 2):
        fits = F.size(vector) == common
        return df.withColumns({f"{vector}_{i + 1}": F.when(fits, F.abs(finite(F.get(F.col(vector), F.lit(i))))) for i in range(common)}).drop(vector)
    s = summaries(F.col(vector))
    return df.withColumns({f"{vector}_{k}": s[k] for k in ("mean", "std", "max", "energy")}).drop(vector)
