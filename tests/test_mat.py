"""MATLAB containers, written here by the published layout."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewave.plans import pipeline
from tidewave.sources import mat

CLASSES = {"f8": (6, 9), "f4": (7, 7), "i1": (8, 1), "u1": (9, 2), "i2": (10, 3), "u2": (11, 4), "i4": (12, 5), "u4": (13, 6), "i8": (14, 12), "u8": (15, 13)}


def element(kind, data, order):
    """An element, short where four bytes suffice."""
    if 0 < len(data) <= 4:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array(name, value, order="<"):
    """A variable: arrays of numbers, str, lists as rows of cells, dict, tuples of dicts as structure arrays."""
    if isinstance(value, str):
        shape, kind, flags = (1, len(value)), 4, 0
        body = element(4, value.encode("utf-16-le" if order == "<" else "utf-16-be"), order)
    elif isinstance(value, list):
        shape, kind, flags = (1, len(value)), 1, 0
        body = b"".join(array("", v, order) for v in value)
    elif isinstance(value, dict | tuple):
        records = value if isinstance(value, tuple) else (value,)
        shape, kind, flags = (1, len(records)), 2, 0
        body = element(5, struct.pack(order + "i", 16), order) + element(1, b"".join(k.encode().ljust(16, b"\0") for k in records[0]), order)
        body += b"".join(array("", r[k], order) for r in records for k in records[0])
    else:
        value = np.atleast_2d(np.asarray(value))
        shape, flags = value.shape, 0x800 if value.dtype.kind == "c" else 0x200 if value.dtype == bool else 0
        sides = [value.real, value.imag] if flags == 0x800 else [value.view("u1") if flags else value]
        kind, form = CLASSES[sides[0].dtype.str[1:]]
        body = b"".join(element(form, s.astype(s.dtype.newbyteorder(order)).tobytes("F"), order) for s in sides)
    head = element(6, struct.pack(order + "II", kind | flags, 0), order) + element(5, struct.pack(f"{order}{len(shape)}i", *shape), order) + element(1, name.encode(), order)
    return struct.pack(order + "II", 14, len(head + body)) + head + body


def container(order="<", packed=False, **values):
    parts = [array(k, v, order) for k, v in values.items()]
    if packed:
        parts = [struct.pack(order + "II", 15, len(z)) + z for z in map(zlib.compress, parts)]
    return b"MATLAB 5.0".ljust(124) + struct.pack(order + "H", 0x100) + (b"IM" if order == "<" else b"MI") + b"".join(parts)


def plain(table):
    return {k: [None if isinstance(x, float) and np.isnan(x) else x for x in v] for k, v in table.items()}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_numbers_of_every_kind(order, packed):
    for kind in CLASSES:
        v = np.array([[1, 2], [3, 4], [5, 100]], kind)
        got = mat.table_in(container(order, packed, a=np.zeros((2, 2)), m=v, few=v[:1]))
        assert plain(got) == {"m_0": [1.0, 3.0, 5.0], "m_1": [2.0, 4.0, 100.0]}
    assert plain(mat.table_in(container(order, packed, z=np.array([3 + 4j, 1j, 0])))) == {"z": [5.0, 1.0, 0.0]}
    assert plain(mat.table_in(container(order, packed, b=np.array([True, False])))) == {"b": [1.0, 0.0]}


def test_property_map_is_a_table():
    t, wide = np.arange(5.0)[:, None], np.arange(10.0).reshape(2, 5)
    held = {"Data": [t, t + 10, wide, np.array([[7.0, 8.0]])], "varNames": ["time", "snr", "snr", ""], "nrows": np.array([[5.0]]), "rownames": np.zeros((0, 0))}
    want = {"time": [0, 1, 2, 3, 4], "snr": [10, 11, 12, 13, 14], "snr_1": [0, 1, 2, 3, 4], "snr_2": [5, 6, 7, 8, 9], "x_4": [7, 8, None, None, None]}
    assert plain(mat.table_in(container(x=held))) == want
    assert plain(mat.table_in(container(x={"other": "a", "Properties": held}))) == want
    assert plain(mat.table_in(container(x=held | {"nrows": np.zeros((0, 0))}))) == want
    assert list(mat.table_in(container(x=held | {"nvars": np.array([2.0])}))) == ["time", "snr"]
    clash = {"data": [t, t, t], "varnames": ["a", "A", "a_2"]}
    assert list(mat.table_in(container(x=clash))) == ["a", "A_2", "a_2_2"]


def test_structures_and_cells():
    fields = {"t": np.arange(3.0), "unit": np.array([9.0]), "label": ["p", "q", np.array([2.0])]}
    assert plain(mat.table_in(container(s=fields))) == {"t": [0, 1, 2], "unit": [9, 9, 9], "label": ["p", "q", "2.0"]}
    assert plain(mat.table_in(container(s=({"t": np.array([1.0]), "n": "x"}, {"t": np.zeros((0, 0)), "n": "yz"})))) == {"t": [1.0, None], "n": ["x", "yz"]}
    assert plain(mat.table_in(container(c=[np.array([1.0]), np.zeros((0, 0)), np.array([3], "i2")]))) == {"c": [1.0, None, 3.0]}


def test_few_long_rows_are_columns():
    assert plain(mat.table_in(container(m=np.arange(6.0).reshape(2, 3)))) == {"signal_0": [0, 1, 2], "signal_1": [3, 4, 5]}
    assert list(mat.table_in(container(m=np.zeros((9, 10)))))[-1] == "m_9"


def test_level_four():
    def old(name, v, form=0):
        code = ["f8", "f4", "i4", "i2", "u2", "u1"].index(v.dtype.str[1:])
        return struct.pack("<5i", code * 10 + form, *v.shape, 0, len(name) + 1) + name.encode() + b"\0" + v.tobytes("F")

    content = old("note", np.frombuffer(b"abc", "u1").reshape(1, 3), 1) + old("v", np.array([[1, 2], [3, 4], [5, 6]], "i2"))
    assert dict(mat.variables(content))["note"].tolist() == ["abc"]
    assert plain(mat.table_in(content)) == {"v_0": [1, 3, 5], "v_1": [2, 4, 6]}
    with pytest.raises(ValueError, match="ends within"):
        mat.table_in(content[:-1])


@pytest.mark.parametrize(
    "content, why",
    [
        (b"", "neither"),
        (b"x" * 200, "neither"),
        (container(note="abc", one=np.array([1.0]), none=np.zeros((0, 3))), r"no table among the variables \['note', 'one', 'none'\]"),
        (container(), "no table"),
        (container(m=np.zeros((4, 4)))[:-8], "ends within"),
        (container().replace(struct.pack("<H", 0x100) + b"IM", struct.pack("<H", 0x200) + b"IM"), "7.3"),
    ],
)
def test_what_is_no_container_is_named(content, why):
    with pytest.raises(ValueError, match=f"f.mat: .*{why}"):
        mat.opened("f.mat", content)


def test_tables_of_different_columns(spark):
    a = container(m={"seq": np.arange(3.0), "x": np.array([1.0, np.nan, 3.0])})
    b = container(m={"X": ["p", "q"], "only `b`": np.array([1.5, 2.5])})
    got = mat.tables(spark.createDataFrame([("a", a), ("b", b)], "path string, content binary")).orderBy("path", "seq")
    assert got.columns[:2] == ["path", "seq"] and dict(got.dtypes)["X"] == "string"
    rows = [(r["path"], r["seq"], r["seq_2"], r["X"], r["only `b`"]) for r in got.collect()]
    assert rows == [("a", 0, 0.0, "1.0", None), ("a", 1, 1.0, None, None), ("a", 2, 2.0, "3.0", None), ("b", 0, None, "p", 1.5), ("b", 1, None, "q", 2.5)]
    assert mat.tables(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_long_tables_come_in_batches(spark):
    n = mat.ROWS + 5
    got = mat.tables(spark.createDataFrame([("a", container(packed=True, v=np.arange(float(n))))], "path string, content binary"))
    assert got.selectExpr("count(*)", "sum(v)", "max(seq)").first()[:] == (n, n * (n - 1) / 2, n - 1)


def test_recordings_in_containers(spark, tmp_path):
    t = np.arange(40.0)[:, None]
    for i in range(2):
        held = {"data": [t / 2, np.sin(t + i)], "varnames": ["time", "snr"], "nrows": np.array([40.0])}
        (tmp_path / f"Radar_{i}_class-A_10：0{i}.mat").write_bytes(container(packed=i == 1, table={"properties": held}))
    (tmp_path / "radar_notes.mat").write_bytes(b"left out")
    wide = pipeline.recorded(spark, str(tmp_path), "radar")
    assert wide.columns == ["record_id", "seq", "time", "snr"] and wide.count() == 80
    long, _, meta = pipeline.sequences(wide, "record_id", "seq")
    assert {(r.record_id, r.rate_hz, r.time_source) for r in meta.collect()} == {("0", 2.0, "time"), ("1", 2.0, "time")}
    pq.write_table(pa.table({"time": [0.0, 0.5], "snr": [1.0, 2.0], "more": [3.0, 4.0]}), tmp_path / "radar_2_class-A_10：02.parquet")
    both = pipeline.recorded(spark, str(tmp_path), "radar")
    assert {r.record_id: (r.n, r.more) for r in both.groupBy("record_id").agg({"*": "count", "more": "sum"}).toDF("record_id", "more", "n").collect()} == {"0": (40, None), "1": (40, None), "2": (2, 7.0)}
