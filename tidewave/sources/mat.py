"""Tables in MATLAB containers, levels 4 and 5 of the published file format, as DataFrames.

A file is one row of Spark's ``binaryFile`` source (so it fits in a task, as the format's own bound of 2 GB a
variable wants); NumPy takes it apart in a Python worker. Level 7.3, which is HDF5, is refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import FEW, largest

# The format's element types, classes of arrays and flags.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, CHAR, SPARSE, FIRST_NUMBER, LAST_NUMBER, OPAQUE = 1, 2, 3, 4, 5, 6, 15, 17
COMPLEX = 0x800
OLD_NUMBERS = ("f8", "f4", "i4", "i2", "u2", "u1")

#: Rows of an Arrow batch.
ROWS = 1 << 16

#: A table: column names and values, all of one length; numbers as doubles, else texts and None.
Table = dict[str, np.ndarray]


def elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """Type and contents of the elements that follow one another; compressed ones are opened."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # up to four bytes, beside a short tag
            kind, size = kind & 0xFFFF, kind >> 16
            begin, end = at + 4, at + 8
        else:
            begin = at + 8
            end = begin + size + (0 if kind == COMPRESSED else -size % 8)
        if begin + size > len(data):
            raise ValueError("the file ends within a variable")
        at = end
        if kind == COMPRESSED:
            yield from elements(memoryview(zlib.decompress(data[begin : begin + size])), order)
        else:
            yield kind, data[begin : begin + size]


def numbers(kind: int, data: memoryview, order: str) -> np.ndarray:
    return np.frombuffer(data, order + NUMBERS[kind])


def as_text(kind: int, data: memoryview, order: str) -> str:
    if kind in TEXTS:
        return bytes(data).decode(TEXTS[kind] + ("" if kind == 16 else "-le" if order == "<" else "-be"), "replace")
    return "".join(map(chr, numbers(kind, data, order)))


def lines(text: str, shape: tuple[int, ...]) -> np.ndarray:
    """The rows of a character array, kept column by column."""
    if len(text) != np.prod(shape) or len(shape) != 2:
        return np.array([text], object)
    return np.array([text[i :: shape[0]] for i in range(shape[0])], object)


def matrix(data: memoryview, order: str) -> tuple[str, Any]:
    """Name and value of a variable: an array of numbers, an array of objects (cells, texts), a dictionary
    (structure), a list of them, or None for what holds no table (sparse matrices, functions, classes)."""
    if not len(data):
        return "", np.zeros((0, 0))
    parts = elements(data, order)
    word = int(numbers(6, next(parts)[1], order)[0])
    kind = word & 0xFF
    if kind == OPAQUE:
        return as_text(1, next(parts)[1], order), None
    shape = tuple(int(n) for n in numbers(5, next(parts)[1], order))
    name = as_text(1, next(parts)[1], order)
    if FIRST_NUMBER <= kind <= LAST_NUMBER:
        real = numbers(*next(parts), order)
        value = real + 1j * numbers(*next(parts), order) if word & COMPLEX else real
        return name, value.reshape(shape, order="F")
    if kind == CHAR:
        return name, lines(as_text(*next(parts, (1, memoryview(b""))), order), shape)
    if kind == CELL:
        cells = np.empty(int(np.prod(shape)), object)
        for i, (_, body) in enumerate(parts):
            cells[i] = matrix(body, order)[1]
        return name, cells.reshape(shape, order="F")
    if kind in (STRUCT, OBJECT):
        if kind == OBJECT:
            next(parts)  # the class's name
        width = int(numbers(5, next(parts)[1], order)[0])
        blob = as_text(1, next(parts)[1], order)
        fields = [blob[i : i + width].rstrip("\0") for i in range(0, len(blob), width)]
        values = [matrix(body, order)[1] for _, body in parts]
        records = [dict(zip(fields, values[i : i + len(fields)], strict=True)) for i in range(0, len(values), max(1, len(fields)))]
        return name, records[0] if len(records) == 1 else records
    return name, None


def old_variables(data: memoryview) -> Iterator[tuple[str, Any]]:
    """Level 4: a header of five numbers, the name, the values. Its first number tells the byte order."""
    order = "<" if struct.unpack_from("<i", data)[0] in range(5000) else ">"
    at = 0
    while at + 20 <= len(data):
        form, n, k, imaginary, length = struct.unpack_from(f"{order}5i", data, at)
        code, use = form // 10 % 10, form % 10
        if form // 1000 not in (0, 1) or code >= len(OLD_NUMBERS) or use > 2 or min(n, k, length) < 0:
            raise ValueError("no variable where one should begin")
        name = bytes(data[at + 20 : at + 20 + length]).rstrip(b"\0").decode("latin-1")
        kind, at = np.dtype(order + OLD_NUMBERS[code]), at + 20 + length
        size = n * k * kind.itemsize
        if at + size * (1 + bool(imaginary)) > len(data):
            raise ValueError("the file ends within a variable")
        value = np.frombuffer(data[at : at + size], kind)
        at += size
        if imaginary:
            value, at = value + 1j * np.frombuffer(data[at : at + size], kind), at + size
        yield name, value.reshape((n, k), order="F") if use == 0 else lines("".join(map(chr, value.astype(int))), (n, k)) if use == 1 else None


def variables(content: bytes) -> Iterator[tuple[str, Any]]:
    """All variables of a file, in their order."""
    data = memoryview(content)
    if len(data) >= 128 and bytes(data[126:128]) in (b"IM", b"MI"):
        order = "<" if data[126] == ord("I") else ">"
        if struct.unpack_from(f"{order}H", data, 124)[0] >> 8 != 1:
            raise ValueError("level 7.3 (HDF5): save with -v7")
        yield from (matrix(body, order) for kind, body in elements(data[128:], order) if kind == MATRIX)
    elif len(data) >= 20 and 0 in data[:4]:
        yield from old_variables(data)
    else:
        raise ValueError("neither level 4 nor level 5 of the format")


def single(value: Any) -> float | str | None:
    """A cell's one number or text, else None."""
    while isinstance(value, np.ndarray) and value.size == 1:
        value = value.reshape(-1)[0]
    if isinstance(value, str):
        return value
    return float(np.abs(value) if isinstance(value, complex | np.complexfloating) else value) if isinstance(value, int | float | complex | np.generic) else None


def column(values: np.ndarray) -> np.ndarray:
    """Values as doubles (complex ones by their size), or as texts where one of them is a text."""
    if values.dtype != object:
        return (np.abs(values) if values.dtype.kind == "c" else values).astype(float)
    held = [single(v) for v in values]
    if any(isinstance(v, str) for v in held):
        return np.array([v if isinstance(v, str) else None if v is None or np.isnan(v) else repr(v) for v in held], object)
    return np.array([np.nan if v is None else v for v in held], float)


def free(name: str, taken: set[str]) -> str:
    """``name``, or where it is taken, in any case, the first free one of _2, _3, ..."""
    out, i = name, 1
    while out.lower() in taken:
        i += 1
        out = f"{name}_{i}"
    return out


def add(table: Table, name: str, values: np.ndarray) -> None:
    """Puts a column into the table, under a free name."""
    table[free(name, {x.lower() for x in table})] = column(values)


def fitted(values: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values, with missing ones behind where there are fewer."""
    flat = values.reshape(-1)[:n]
    if len(flat) == n:
        return flat
    return np.concatenate([flat.astype(object), np.full(n - len(flat), None, object)])


def map_table(fields: dict[str, Any], name: str) -> Table | None:
    """The table in a property map with ``data`` and ``varnames``, itself or under ``properties`` or
    ``property_map``, in any case; its columns as ``files.array_table`` would give them."""
    low = {k.lower(): v for k, v in fields.items()}
    if not isinstance(low.get("data"), np.ndarray) or "varnames" not in low:
        inner = next((low[k] for k in ("properties", "property_map") if isinstance(low.get(k), dict)), None)
        return map_table(inner, name) if inner is not None else None
    data = low["data"].reshape(-1) if low["data"].dtype == object else [low["data"]]
    data = [np.asarray(v) for v in data]
    names = low["varnames"].reshape(-1) if isinstance(low["varnames"], np.ndarray) else []
    given = single(low.get("nrows"))
    n = int(given) if isinstance(given, float) and given >= 1 else max((max(v.shape, default=0) if v.size == max(v.shape, default=0) else len(v) for v in data), default=0)
    count = single(low.get("nvars"))
    table: Table = {}
    for i, v in enumerate(data[: int(count)] if isinstance(count, float) and count >= 1 else data):
        label = single(names[i]) if i < len(names) else None
        label = label if isinstance(label, str) and label.strip() else f"{name}_{i + 1}"
        if n and v.ndim >= 2 and n in (v.shape[0], v.shape[-1]):
            wide = (v if v.shape[0] == n else np.moveaxis(v, -1, 0)).reshape(n, -1)
            for j in range(wide.shape[1]):
                add(table, label if wide.shape[1] == 1 else f"{label}_{j + 1}", wide[:, j])
        else:
            add(table, label, fitted(v, n))
    return table


def table_of(name: str, value: Any) -> Table | None:
    """The table that a variable is: a property map; a structure's fields of one length (single ones are
    repeated); an array of structures, a row each; a list; a matrix with columns ``name_0`` ... Single values,
    single texts and arrays of more dimensions are none."""
    table: Table = {}
    if isinstance(value, list):
        for field in value[0] if value else ():
            cells = np.empty(len(value), object)
            cells[:] = [single(r[field]) for r in value]
            add(table, field, cells)
    elif isinstance(value, dict):
        if (mapped := map_table(value, name)) is not None:
            return mapped
        flat = {k: np.squeeze(v) for k, v in value.items() if isinstance(v, np.ndarray)}
        lengths = {len(v) for v in flat.values() if v.ndim == 1}
        if len(flat) < len(value) or len(lengths) != 1 or any(v.ndim > 1 for v in flat.values()):
            return None
        n = lengths.pop()
        for k, v in flat.items():
            add(table, k, v if v.ndim else np.full(n, v[()], v.dtype))
    elif isinstance(value, np.ndarray):
        flat = np.squeeze(value)
        if flat.ndim == 1:
            add(table, name, flat)
        elif flat.ndim == 2:
            for j in range(flat.shape[1]):
                add(table, f"{name}_{j}", flat[:, j])
    return table or None


def table_in(content: bytes) -> Table:
    """The table with the most cells (first among equals) of a file; at most eight rows that are fewer than
    the columns are turned into columns ``signal_0`` ... A file without any table is an error."""
    names, found = [], {}
    for name, value in variables(content):
        names.append(name)
        table = None if name.startswith("__") else table_of(name, value)
        if table and len(next(iter(table.values()))):
            found[name] = table
    if not found:
        raise ValueError(f"no table among the variables {names}")
    rows = lambda t: len(next(iter(t.values())))
    table = found[largest([(name, rows(t), len(t)) for name, t in found.items()])]
    if rows(table) >= len(table) or rows(table) > FEW:
        return table
    turned: Table = {}
    for i in range(rows(table)):
        cells = np.empty(len(table), object)
        cells[:] = [v[i] for v in table.values()]
        add(turned, f"signal_{i}", cells)
    return turned


def opened(path: str, content: bytes) -> Table:
    try:
        return table_in(content)
    except (ValueError, KeyError, IndexError, StopIteration, struct.error, zlib.error) as e:
        raise ValueError(f"{path}: {e or 'not a readable container'}") from e


def listing(spark: SparkSession, folder: str, pattern: str = "*.mat") -> DataFrame:
    """path and content of a folder's files, not of those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder).select("path", "content")


def columns_found(files: DataFrame) -> list[tuple[str, bool]]:
    """Names of all columns of the tables in ``files`` (path, content), whatever their case, in the order of
    their places, and whether any table has texts there. Only names come to the driver."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                table = opened(path.as_py(), content.as_py())
                yield pa.RecordBatch.from_pydict({"name": list(table), "place": list(range(len(table))), "text": [v.dtype == object for v in table.values()]}, pa.schema([("name", pa.string()), ("place", pa.int32()), ("text", pa.bool_())]))

    got = files.select("path", "content").mapInArrow(named, "name string, place int, text boolean").groupBy(F.lower("name").alias("low"))
    return [(r["name"], r["text"]) for r in got.agg(F.min("name").alias("name"), F.min("place").alias("place"), F.bool_or("text").alias("text")).orderBy("place", "low").collect()]


def tables(files: DataFrame) -> DataFrame:
    """The tables of ``files`` (path, content) as one: path, seq (the row's number in its file) and every column
    that one of them has, double or, where any has texts, string; null where a table lacks it. The files are
    read twice, for their columns and for their rows; nothing is shuffled but names. NaN is kept."""
    found = columns_found(files)
    label = {name: free(name, {"path", "seq"} | {x.lower() for x, _ in found if x != name}) for name, _ in found}
    schema = pa.schema([("path", pa.string()), ("seq", pa.int64()), *((label[name], pa.string() if text else pa.float64()) for name, text in found)])

    def values(v: np.ndarray | None, text: bool, a: int, b: int) -> pa.Array:
        if v is None:
            return pa.nulls(b - a, pa.string() if text else pa.float64())
        if text and v.dtype != object:
            return pa.array([None if np.isnan(x) else repr(float(x)) for x in v[a:b]], pa.string())
        return pa.array(v[a:b], pa.string() if text else pa.float64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                table = {k.lower(): v for k, v in opened(path.as_py(), content.as_py()).items()}
                n = len(next(iter(table.values())))
                for a in range(0, n, ROWS):
                    b = min(n, a + ROWS)
                    held = [values(table.get(name.lower()), text, a, b) for name, text in found]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * (b - a), pa.string()), pa.array(np.arange(a, b)), *held], schema=schema)

    kinds = ["path string", "seq long", *(f"`{label[name].replace('`', '``')}` {'string' if text else 'double'}" for name, text in found)]
    return files.select("path", "content").mapInArrow(rows, ", ".join(kinds))
