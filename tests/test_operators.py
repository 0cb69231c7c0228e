"""Edge cases and NumPy comparisons of single operators."""

import functools
import itertools
import math
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import scalars as S
from tidewave.functions import vectors as V
from tidewave.operators import inspect as INS
from tidewave.operators import metrics as M
from tidewave.operators import normalize as N
from tidewave.operators import resample as R
from tidewave.operators import selection as SEL
from tidewave.operators import stats as ST
from tidewave.operators import timeaxis as T
from tidewave.operators import windows as W
from tidewave.plans import catalog
from tidewave.sources import files as FI
from tidewave.sources import settings, sinks

NAN, INF = float("nan"), float("inf")
SAMPLES = "record_id string, seq long, t double, channel string, value double"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_exact_mean_in_any_order(spark):
    cents = [7.21, 94.01, 72.15, 14.72, 11.91]
    orders = list(itertools.permutations(cents))
    assert {functools.reduce(operator.add, o) / 5 > 40 for o in orders} == {False, True}  # by order
    rows = [(f"{i}", v) for i, o in enumerate(orders) for v in o] + [("null", None), ("tiny", 1e-30), ("tiny", 3e-30), ("huge", 1e300), ("huge", 1e300), ("most", 9e19), ("most", 9e19)]
    found = {r.k: r.m for r in spark.createDataFrame(rows, "k string, v double").coalesce(1).groupBy("k").agg(S.exact_mean(F.col("v")).alias("m")).collect()}
    assert (found.pop("null"), found.pop("tiny"), found.pop("huge"), found.pop("most")) == (None, 2e-30, 1e300, 9e19)
    assert set(found.values()) == {40.0}


def test_channel_means_at_the_bound(spark, tmp_path):
    """A mean of exactly 40 is not over 40, however the rows lie in files."""
    cents = [7.21, 94.01, 72.15, 14.72, 11.91]
    over = next(o for o in itertools.permutations(cents) if functools.reduce(operator.add, o) / 5 > 40)
    rows = [(i, 1, "view", v) for i, v in enumerate(over)] + [(9, 1, "click", 50.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.channel: r.value for r in catalog.channel_lookup(spark, str(tmp_path)).collect()} == {"view": 0.0, "click": 50.0}


def test_channel_means_that_end_in_half_a_unit(spark, tmp_path):
    """The mean of 32 numbers of cents may lie between two of six digits: SQL rounds it by its sum in the rows' order."""
    import duckdb

    rng, rows, record = np.random.default_rng(5), [], 0
    while record < 20:
        cents = rng.integers(5000, 9000, 32)
        total = functools.reduce(operator.add, (float(c) / 100 for c in cents)) / 32
        if cents.sum() % 2 and total < cents.sum() / 3200:  # exactly half a unit, the sum is under it
            rows += [(32 * record + i, record, "view", float(c) / 100) for i, c in enumerate(cents)]
            record += 1
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz"))
    events.coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(r, c): v for r, c, v in con.execute(catalog.oracle_sql()["channel_lookup"]).fetchall()}
    assert len(want) == 20
    assert {(r.record_id, r.channel): r.value for r in catalog.channel_lookup(spark, str(tmp_path)).collect()} == want


def test_missing_is_null(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (INF,), (-INF,), (None,)], "v double")
    assert [r.x for r in df.select(S.finite(F.col("v")).alias("x")).collect()] == [1.0, None, None, None, None]


@pytest.mark.parametrize(("name", "want"), [("a b", "a_b"), ("__x__", "x"), ("", "unnamed"), ("???", "unnamed"), ("时间 (s)", "时间_s")])
def test_clean_name(spark, name, want):
    assert one(spark, S.clean_name(F.lit(name))) == want


@pytest.mark.parametrize(("text", "want"), [("30/1", 30.0), ("1/0", 0.0), ("N/A", 0.0), ("2.5", 2.5), ("inf", 0.0), (None, 0.0)])
def test_lenient_ratio(spark, text, want):
    assert one(spark, S.lenient_ratio(F.lit(text).cast("string"))) == want


def test_derived_length(spark):
    r = one(spark, S.derived_length(F.lit(0).cast("long"), F.lit(5.0), F.lit(2.5)))
    assert (r.frames, r.duration) == (12, 2.5)  # half to even
    r = one(spark, S.derived_length(F.lit(10).cast("long"), F.lit(5.0), F.lit(0.0)))
    assert (r.frames, r.duration) == (10, 2.0)


def test_config_hash_is_canonical():
    assert S.config_hash({"b": 1, "a": {"y": 2, "x": 1}}) == S.config_hash({"a": {"x": 1, "y": 2}, "b": 1})
    assert len(S.config_hash({})) == 16


def test_vector_lengths(spark):
    mixed = spark.createDataFrame([([3.0, -4.0],), ([1.0, 2.0],), ([1.0],), (None,)], "v array<double>")
    assert V.expanded(mixed, "v", 8).columns == ["v_1", "v_2"]
    assert [tuple(r) for r in V.expanded(mixed, "v", 8).collect()][:3] == [(3.0, 4.0), (1.0, 2.0), (None, None)]
    r = V.expanded(mixed, "v", 1).first()
    assert (r.v_mean, r.v_std, r.v_max, r.v_energy) == (3.5, 0.5, 4.0, 12.5)


def test_table_of_arrays(spark):
    df = spark.createDataFrame([(1, [[0.0, 1.0, 2.0], [10.0]], ["time", "snr"], 2)], "k int, data array<array<double>>, names array<string>, n int")
    rows = FI.array_table(df, "k", "data", "names", "n").orderBy("column", "row").collect()
    assert [(r.name, r.row, r.value) for r in rows] == [("time", 0, 0.0), ("time", 1, 1.0), ("snr", 0, 10.0), ("snr", 1, None)]


def cells(df, **more):
    out = {}
    for r in FI.array_table(df, "k", "data", "names", **more).orderBy("column", "row").collect():
        out.setdefault(r.name, []).append(r.value)
    return out


def test_table_of_two_dimensional_variables(spark):
    kind = "k int, data array<array<array<double>>>, names array<array<string>>, n string, rn array<string>"
    by_rows, by_columns, odd = [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], [[7.0, 8.0]]
    df = spark.createDataFrame([(1, [by_rows, by_columns, odd], [["x", " ", "y"], ["x_y"], []], "3", ["a", "", "c"])], kind)
    want = {"x_y_1": [1.0, 3.0, 5.0], "x_y_2": [2.0, 4.0, 6.0], "x_y_1_2": [1.0, 2.0, 3.0], "x_y_2_2": [4.0, 5.0, 6.0], "table_3": [7.0, 8.0, None]}
    assert cells(df, rows="n") == want
    assert cells(df) == want  # rows inferred from the longest variable
    got = FI.array_table(df, "k", "data", "names", "n", "rn").where("column = 0").orderBy("row").collect()
    assert [r.row_name for r in got] == ["a", "1", "c"]
    two = FI.array_table(df.withColumn("rn", F.slice("rn", 1, 2)), "k", "data", "names", "n", "rn")
    assert {r.row_name for r in two.collect()} == {None}


def test_names_that_clash(spark):
    names = spark.createDataFrame([(1, ["a", "a", "a_2", "a", "a_2"])], "k int, n array<string>")
    assert names.select(V.unique_texts("n").alias("u")).first().u == ["a", "a_2", "a_2_2", "a_3", "a_2_3"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a", "a_2"])] + [(2, 0, "a"), (None, 0, "a"), (None, 1, "a")], "t int, i int, n string")
    got = [r.unique_name for r in N.unique_names(df, "n", "i", ["t"]).orderBy(F.col("t").asc_nulls_last(), "i").collect()]
    assert got == ["a", "a_2", "a_2_2", "a", "a", "a_2"]
    flat = spark.createDataFrame([(1, [[1.0], [2.0]], ["x y", "x_y"])], "k int, data array<array<double>>, names array<string>")
    assert cells(flat) == {"x_y": [1.0], "x_y_2": [2.0]}


def test_shape_decides_on_turning(spark):
    few = spark.createDataFrame([(10, 1.0, 2.0, 3.0), (20, 4.0, 5.0, 6.0)], "k int, a double, b double, c double")
    assert [tuple(r) for r in FI.by_shape(few, "k", ["a", "b", "c"]).orderBy("row").collect()] == [(0, 1.0, 4.0), (1, 2.0, 5.0), (2, 3.0, 6.0)]
    assert FI.by_shape(few, "k", ["a", "b"]).columns == few.columns
    with pytest.raises(ValueError, match="more than 8"):
        FI.transposed(spark.range(9).select(F.col("id").alias("k"), F.lit(1.0).alias("a")), "k", ["a"])


@pytest.mark.parametrize(("chars", "want"), [(["a", "b"], "ab"), (["ab", "c"], "ab"), ([], "")])
def test_char_text(spark, chars, want):
    assert spark.createDataFrame([(chars,)], "c array<string>").select(S.char_text(F.col("c")).alias("x")).first().x == want


def test_empty_files_are_refused(spark):
    files = spark.createDataFrame([("a", 3), ("b", 0)], "path string, size long")
    assert FI.checked_size(files.where("size > 0")).count() == 1
    with pytest.raises(Exception, match="empty file: b"):
        FI.checked_size(files).collect()

def test_largest_candidate():
    assert FI.largest([("a", 5, 0), ("b", 2, 3), ("c", 3, 2)]) == "b"
    with pytest.raises(ValueError):
        FI.largest([])


def test_discovery_is_not_recursive(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for p in ("ir_1_class-A_10：00.mp4", "radar_1_class-A_10：00.mat", "nested/ir_2_class-A_10：00.mp4", "other.mp4"):
        (tmp_path / p).write_bytes(b"x")
    found = FI.paired(FI.discovered(spark, str(tmp_path))).collect()
    assert [(r.record_id, r.label, r.start_time) for r in found] == [("1", "class-A", "10:00")]


@pytest.mark.parametrize(("names", "status"), [(["ir_1_class-A_1"], "right_only"), (["radar_1_class-A_1"], "left_only"), (["ir_1_class-A_1", "radar_1_class-B_1"], "label_conflict"), (["ir_1_class-A_1", "IR_1_class-A_2", "radar_1_class-A_1"], "duplicate")])
def test_pair_faults(spark, names, status):
    files = spark.createDataFrame([(n,) for n in names], "path string").withColumn("p", FI.parsed_name(F.col("path"))).select("path", "p.*")
    assert FI.pair_report(files).first().status == status
    with pytest.raises(Exception, match="record 1 is"):
        FI.paired(files).collect()


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("profile: quick\nseed: 7\ncommon: {window_seconds: 6, epochs: 3}\npaths: {cache: here}\nprofiles: {quick: {steps: 9}, own: {channels: 4}}\n")
    got = settings.load(tmp_path / "s.yaml")
    assert (got.profile, got.seed, got.window_seconds, got.cache, got.steps, got.frames_per_window) == ("quick", 7, 6.0, "here", 9, 4)
    assert settings.load(tmp_path / "s.yaml", "own").channels == 4
    assert settings.load(tmp_path / "absent.yaml").profile == "cpu"
    assert settings.load(profile="auto", workers=64).frames_per_window == 12 and settings.load(profile="auto").profile == "cpu"
    for bad in ({"window_seconds": 0}, {"frames_per_window": 1}, {"channels": 257}):
        with pytest.raises(ValueError):
            settings.Settings(**bad)
    with pytest.raises(ValueError, match="unknown profile"):
        settings.load(profile="none")


def test_cache_computes_misses_only(spark, tmp_path):
    cache, asked = str(tmp_path / "cache"), []

    def compute(records):
        if ids := sorted(r.record_id for r in records.collect()):
            asked.append(ids)
        return records.select("record_id", "cache_key", F.explode(F.array(F.lit(0), F.lit(1))).alias("window_id"))

    a = spark.createDataFrame([("1", "x"), ("2", "y")], "record_id string, cache_key string")
    b = spark.createDataFrame([("2", "y"), ("3", "z")], "record_id string, cache_key string")
    assert sinks.cached_windows(spark, cache, a, compute).count() == 4
    assert sinks.cached_windows(spark, cache, b, compute).count() == 4
    assert asked == [["1", "2"], ["3"]]
    # a rebuild of one record leaves the others, and the latest run counts
    only = a.where("record_id = '1'")
    assert sinks.cached_windows(spark, cache, only, lambda r: compute(r).where("window_id = 0"), rebuild=True).count() == 1
    assert sinks.cached_windows(spark, cache, a, compute).count() == 3 and asked[2:] == [["1"]]
    # a record without windows is a hit, too
    none = spark.createDataFrame([("9", "n")], "record_id string, cache_key string")
    for _ in range(2):
        assert sinks.cached_windows(spark, cache, none, lambda r: compute(r).where("window_id < 0")).count() == 0
    assert asked[3:] == [["9"]]
    assert {r.record_id: r.windows for r in sinks.manifest(spark, cache).collect()} == {"1": 1, "2": 2, "3": 2, "9": 0}
    assert sinks.clean_cache(cache, spark) and not sinks.clean_cache(cache)


def test_json_refuses_nan(spark):
    with pytest.raises(Exception, match="NaN"):
        sinks.json_rows(spark.createDataFrame([(NAN,)], "x double")).collect()
    nested = "m map<string,double>, s struct<a: array<double>, b: string>"
    fine = spark.createDataFrame([({"p": 0.5}, ([1.0, None], "x")), (None, None)], nested)
    assert sinks.json_rows(fine).count() == 2
    for bad in (({"p": NAN}, None), (None, ([INF], "x"))):
        with pytest.raises(Exception, match="NaN"):
            sinks.json_rows(spark.createDataFrame([bad], nested)).collect()


def test_file_hash(spark, tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(b"abc" * 1000)
    assert sinks.file_hashes(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"abc" * 1000).hexdigest()


def clock(spark, rows, column, kind):
    return spark.createDataFrame([("r", i, v) for i, v in enumerate(rows)], f"record_id string, seq long, `{column}` {kind}")


@pytest.mark.parametrize(("column", "kind", "rows", "source", "rate", "last"), [
    ("time", "double", [1.0, 1.5, 2.0], "time", 2.0, 1.0),
    ("timestamp", "double", [1e6, 1e6 + 2000, 1e6 + 4000], "timestamp", 0.5, 4.0),
    ("frame", "double", [0.0, 2e9, 4e9], "frame", 0.5, 4.0),
    ("time", "double", [3.0, 2.0, 1.0], "row_index", 1.0, 2.0),
    ("times", "double", [1.0, 1.5, 2.0], "row_index", 1.0, 2.0),
    ("date", "string", ["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:20"], "date", 0.1, 20.0),
])
def test_inferred_clock(spark, column, kind, rows, source, rate, last):
    got = T.inferred(clock(spark, rows, column, kind), "record_id", "seq", [column]).orderBy("seq").collect()
    assert got[0].time_source == source
    assert got[-1].rate_hz == pytest.approx(rate)
    assert max(r.t for r in got) == pytest.approx(last)


def test_clock_by_duration(spark):
    df = clock(spark, [1.0, 2.0, 3.0, 4.0], "x", "double").withColumn("hint", F.lit(8.0))
    got = T.inferred(df, "record_id", "seq", ["x"], "hint").orderBy("seq").collect()
    assert [r.t for r in got] == [0.0, 2.0, 4.0, 6.0]
    assert (got[0].rate_hz, got[0].time_source) == (0.5, "duration_hint")


def reference_windows(start, end, length, stride, most):
    if end <= start:
        return []
    if end - start <= length:
        return [(start, end)]
    out, k = [], 0
    while start + k * stride + length <= end + 1e-6 and k < most:
        out.append((start + k * stride, start + k * stride + length))
        k += 1
    if out[-1][1] < end - length / 4 and k < most:
        out.append((max(start, end - length), end))
    return out


@pytest.mark.parametrize("span", [(0.0, 0.0), (5.0, 3.0), (0.0, 12.0), (0.0, 7.0), (0.0, 14.9), (0.0, 15.1), (0.0, 30.0), (1.0, 100.3), (0.0, 3000.0)])
def test_hopping_windows(spark, span):
    got = W.hopping(spark.createDataFrame([("r", *span)], "record_id string, start double, end double"), 12.0, 6.0, 240).orderBy("window_id").collect()
    want = reference_windows(*span, 12.0, 6.0, 240)
    assert [x for r in got for x in (r.w_start, r.w_end)] == pytest.approx([x for w in want for x in w])


@pytest.mark.parametrize("span", [(0.0, 14.9), (1.0, 100.3), (0.0, 3000.0), (0.0, 100_003.5)])
def test_hopping_windows_without_a_limit(spark, span):
    got = W.hopping(spark.createDataFrame([("r", *span)], "record_id string, start double, end double"), 12.0, 6.0).orderBy("window_id").collect()
    want = reference_windows(*span, 12.0, 6.0, 10**9)
    assert [(r.w_start, r.w_end) for r in got] == want


def test_window_feature_rows_to_the_end_of_a_record(spark, tmp_path):
    """Twenty days give eighty windows of six hours, and one for what is left."""
    rows = [(i, 1, "view", float(i % 7)) for i in range(82)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 21300).cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.window_feature_rows(spark, str(tmp_path)).where("series = 'col__view'").collect()
    assert sorted(r.window_id for r in found) == list(range(80))


def test_even_choice_rounds_halves_to_even(spark):
    for n in (1, 2, 3, 7, 10):
        rows = spark.range(n).select(F.lit("r").alias("record_id"), F.col("id").alias("seq"))
        got = [r.seq for r in W.evenly_chosen(rows, 6, ["record_id"], "seq").orderBy("place").collect()]
        assert got == np.linspace(0, n - 1, 6).round().astype(int).tolist()


def test_even_choice_of_one(spark):
    rows = spark.range(5).select(F.lit("r").alias("record_id"), F.col("id").alias("seq"))
    assert [(r.place, r.seq) for r in W.evenly_chosen(rows, 1, ["record_id"], "seq").collect()] == [(0, 0)]


def test_nearest_takes_the_first_of_equals(spark):
    rows = [("r", 0, 1.0), ("r", 1, 5.0), ("r", 2, 5.0), ("r", 3, 9.0), ("r", 4, None), ("s", 5, 3.0)]
    s = spark.createDataFrame(rows, "record_id string, seq long, t double")
    w = spark.createDataFrame([("r", 0, 6.5, 7.5), ("r", 1, 0.0, 2.0), ("r", 2, 20.0, 21.0), ("r", 3, 6.0, 6.4), ("s", 0, 0.0, 1.0), ("t", 0, 0.0, 1.0)], "record_id string, window_id int, w_start double, w_end double")
    got = {(r.record_id, r.window_id): (r.seq, r.nearest) for r in W.inside_or_nearest(s, w, 1.0).collect()}
    assert got == {("r", 0): (1, True), ("r", 1): (0, False), ("r", 2): (3, True), ("r", 3): (1, True), ("s", 0): (5, True)}


def test_long_series_take_seconds(spark):
    """A hundred thousand samples of one key: interpolation, nearest samples and alignment."""
    import time

    began = time.perf_counter()
    s = spark.range(100_000).select(F.lit("r").alias("record_id"), F.col("id").alias("seq"), (F.col("id") / 2).alias("t"), F.sin(F.col("id") / 7 + F.sin(F.col("id") / 900)).alias("value"))
    grid = spark.range(100_000).select(F.lit("r").alias("record_id"), F.col("id").alias("i"), (F.col("id") / 2 + 0.25).alias("x"))
    r = R.interpolated(s, grid, ["record_id"]).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("m")).first()
    assert r.n == 100_000 and 0.99 < r.m <= 1
    w = spark.range(1000).select(F.lit("r").alias("record_id"), F.col("id").cast("int").alias("window_id"), (F.col("id") * 50 + 0.1).alias("w_start"), (F.col("id") * 50 + 0.2).alias("w_end"))
    assert W.inside_or_nearest(s, w, 1.0).where("nearest AND seq = window_id * 100").count() == 1000
    later = s.withColumn("t", F.col("t") + 3.0)
    got = R.alignment(s, later, 45.0).first()
    assert (got.status, got.offset) == ("ok", 3.0)
    assert time.perf_counter() - began < 120


def test_overlap_under_a_second_starts_over(spark):
    df = spark.createDataFrame([("a", 2.0, 10.0, 11.0), ("b", 9.5, 10.0, 10.0)], "record_id string, offset double, left_duration double, right_duration double")
    got = {r.record_id: (r.start, r.end) for r in W.overlap(df).collect()}
    assert got == {"a": (2.0, 11.0), "b": (0.0, 10.0)}


def series(spark, values, record="r", channel="c"):
    return spark.createDataFrame([(record, i, float(i), channel, v) for i, v in enumerate(values)], SAMPLES)


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 8.0, 3.0], [None, 5.0, None, 7.0], [3.0], [2.0] * 6])
def test_series_features(spark, values):
    x = np.array([v for v in values if v is not None])
    got = ST.series_features(series(spark, values), ["record_id", "channel"]).first()
    d = np.diff(x)
    want = [x.mean(), x.std(), x.min(), x.max(), *np.quantile(x, [0.5, 0.1, 0.9]), np.quantile(x, 0.75) - np.quantile(x, 0.25), math.sqrt((x**2).mean()), d.std() if len(d) else 0, np.abs(d).max() if len(d) else 0]
    assert [got[s] for s in ST.STATS] == pytest.approx(want)


def test_features_of_nothing_are_null(spark):
    got = ST.series_features(series(spark, [None, None]), ["record_id", "channel"]).first()
    assert [got[s] for s in ST.STATS] == [None] * 11


@pytest.mark.parametrize("value", [0.0, 2.5])
def test_constant_series_has_no_spectrum(value):
    assert ST.one_spectrum(np.full(5, value), 4.0, 8) == [0.0, 0.0, *[None] * 8]
    assert ST.one_spectrum(np.full(3, value), 4.0, 8) == [None] * 10


@pytest.mark.parametrize("n", [4, 5, 16, 33])
def test_spectra_agree(spark, n):
    x = np.sin(np.arange(n) * 1.1) + np.arange(n) * 0.1
    sql = ST.spectral_features(series(spark, x.tolist()), ["record_id"], 4.0).first()
    fft = ST.spectral_features_fft(spark.createDataFrame([("r", x.tolist())], "record_id string, v array<double>"), ["record_id"], "v", 4.0).first()
    assert [sql[c] for c in sql.asDict()][1:] == pytest.approx([fft[c] for c in fft.asDict()][1:], abs=1e-9)


@pytest.mark.parametrize("m, rate", [(6, 1.051569981014946e-05), (6, 1.030687526446555e-05), (10, 5.0075088489046214e-05), (10, 1.2432545367636119e-05)])
def test_bands_hold_what_the_sql_puts_in_them(duck, m, rate):
    x = np.cos(np.arange(m) * np.pi) + np.cos(np.arange(m))
    inside = [k for k in range(1, m // 2 + 1) if duck.execute("SELECT CAST(? AS BIGINT) * CAST(? AS DOUBLE) / CAST(? AS BIGINT) < 8 * CAST(? AS DOUBLE) / 16", [k, rate, m, rate]).fetchone()[0]]
    i = np.arange(m) - (m - 1) / 2
    x0 = x - x.mean()
    p = np.abs(np.fft.rfft(x0 - i * ((i @ x0) / (i @ i)))) ** 2 * np.r_[1, np.full(m // 2 - 1, 2), 1]
    assert sum(ST.one_spectrum(x, rate, 8)[2:]) == pytest.approx(p[inside].sum() / p[1:].sum(), abs=1e-6)


@pytest.mark.parametrize("kind", ["level", "tie"])
def test_spectra_where_rounding_errors_decide(spark, tmp_path, kind):
    """Six equal values, and five with one step, have the entropy, frequency and bands of SQL's sums."""
    import duckdb

    rng, rows = np.random.default_rng(3), []
    for record in range(60):
        a, b, c = (int(x) / 100 for x in rng.integers(1, 20_000, 3))
        cells = [("a", a)] * 6 if kind == "level" else [("b", 1.0), ("a", a), ("a", b), ("c", 1.0), ("d", 1.0), ("a", c)]  # the last is in the next window
        rows += [(10 * record + i, record, *cell, 7 * i if kind == "level" or i < 5 else 30_000) for i, cell in enumerate(cells)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    events.coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = ["record_id", "series", "spectral_entropy", "dominant_hz", *(f"band_{b}" for b in range(8))]
    want = {r[:2]: r[2:] for r in con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()['window_feature_rows']}) WHERE n > 3").fetchall()}
    found = catalog.window_feature_rows(spark, str(tmp_path)).where("n > 3").select(columns).collect()
    assert len(want) >= 60
    assert {tuple(r)[:2]: tuple(r)[2:] for r in found} == want


def test_robust_scale_ladder(spark):
    z = lambda v, **k: [r.z for r in N.robust_scaled(series(spark, v), **k).orderBy("seq").collect()]
    assert z([1.0, 2.0, 3.0]) == pytest.approx([-1 / 1.4826, 0, 1 / 1.4826])
    x = np.array([1.0, 1.0, 1.0, 5.0])
    assert z(x.tolist()) == pytest.approx(((x - 1) / x.std()).tolist())  # no MAD: deviation
    assert z([7.0, 7.0]) == [0.0, 0.0]  # no deviation: 1
    assert z([0.0, 0.0, 0.0, 100.0], std_next=False, bound=8.0) == [0.0, 0.0, 0.0, 8.0]


def test_all_missing_series_is_zero(spark):
    assert [r.value for r in N.imputed(series(spark, [None, None])).collect()] == [0.0, 0.0]


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(3)
    t, v = np.sort(rng.random(20) * 10), rng.random(20)
    s = spark.createDataFrame([("r", i, float(a), "c", float(b)) for i, (a, b) in enumerate(zip(t, v))], SAMPLES)
    x = np.concatenate([[-1, 12], t[[0, 5, 19]], rng.random(30) * 10])
    grid = spark.createDataFrame([("r", i, float(a)) for i, a in enumerate(x)], "record_id string, i long, x double")
    got = [r.value for r in R.interpolated(s, grid, ["record_id"]).orderBy("i").collect()]
    assert got == pytest.approx(np.interp(x, t, v).tolist(), abs=1e-12)


def shifted(spark, lag, n=80):
    rng = np.random.default_rng(5)
    base = np.convolve(rng.random(n + 60), np.ones(3) / 3)[30 : 30 + n + 20]
    rows = lambda a: spark.createDataFrame([("r", i, i * 0.5, float(v)) for i, v in enumerate(a)], "record_id string, seq long, t double, value double")
    return rows(base[10 : 10 + n]), rows(base[10 - lag : 10 - lag + n])


@pytest.mark.parametrize("lag", [0, 4, -6])
def test_alignment_finds_the_shift(spark, lag):
    got = R.alignment(*shifted(spark, lag), max_lag=5.0).first()
    assert (got.status, got.offset) == ("ok", lag / 2)
    assert 0.5 < got.score <= 1


def test_alignment_refuses(spark):
    rows = lambda n, step, f: spark.createDataFrame([("r", i, i * step, f(i)) for i in range(n)], "record_id string, seq long, t double, value double")
    wave = lambda i: float(i * i % 7)
    cases = {"insufficient_activity": rows(3, 1.0, wave), "insufficient_duration": rows(5, 0.5, wave), "flat_activity": rows(10, 1.0, lambda i: 2.0)}
    for status, left in cases.items():
        got = R.alignment(left, rows(20, 1.0, wave), 5.0).first()
        assert (got.status, got.offset, got.score) == (status, 0.0, 0.0)


def test_channel_choice_falls_back(spark):
    rows = [("1", 0, 0.0, "a", 1.0), ("2", 0, 0.0, "b", 1.0), ("3", 0, 0.0, "c", None)]
    s = spark.createDataFrame(rows, SAMPLES)
    assert [r.channel for r in SEL.chosen_channels(s, 3, 5).orderBy("rank").collect()] == ["a", "b"]
    assert SEL.padded(["a"], 3) == ["a", "__padding_1", "__padding_2"]


def test_folds(spark):
    few = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B")], "record_id string, label string")
    f, how = SEL.folds(few, 5, 1)
    assert how == "partial_leave_one_record_out"
    assert sorted((r.record_id, r.fold) for r in f.collect()) == [("1", 0), ("2", 1)]
    assert SEL.folds(few.where("label = 'A'"), 5, 1)[0].count() == 0
    many = spark.createDataFrame([(str(i), "AB"[i % 2]) for i in range(12)], "record_id string, label string")
    f, how = SEL.folds(many, 4, 1)
    assert how == "stratified_record_cv"
    sizes = {(r.label, r.fold): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    assert len(sizes) == 8 and set(sizes.values()) <= {1, 2}
    uneven = spark.createDataFrame([(f"{i:03d}", "A") for i in range(50)] + [("x", "B")], "record_id string, label string").repartition(7)
    f, how = SEL.folds(uneven, 5, 1)
    assert how == "partial_leave_one_record_out" and [(r.record_id, r.fold) for r in f.orderBy("fold").collect()] == [(f"{i:03d}", i) for i in range(50)]


def test_weighted_draws_follow_weights(spark):
    items = spark.createDataFrame([(i, w) for i, w in enumerate([1.0, 3.0, 0.0, 6.0])], "k long, w double")
    n = {r.k: r["count"] for r in SEL.weighted_draws(items, "k", "w", 4000, 1).groupBy("k").count().collect()}
    assert sum(n.values()) == 4000 and 2 not in n
    assert [n[k] / 4000 for k in (0, 1, 3)] == pytest.approx([0.1, 0.3, 0.6], abs=0.03)
    odd = spark.range(500).select("id", (F.rand(3) * 1e-3 + F.pow(F.lit(10.0), -(F.col("id") % 12))).alias("w"))
    drawn = SEL.weighted_draws(odd, "id", "w", 5000, 2)
    assert drawn.count() == drawn.select("draw").distinct().count() == 5000 and drawn.where("id IS NULL").count() == 0
    assert SEL.weighted_draws(items.where("w < 0"), "k", "w", 10, 1).count() == 0


def test_pooling_breaks_ties_by_class(spark):
    s = spark.createDataFrame([("r", 0, "b", 0.5), ("r", 0, "a", 0.5), ("r", 1, "a", 0.2), ("r", 1, "b", 0.2)], "record_id string, window_id int, class string, prob double")
    got = M.pooled(s).first()
    assert (got.prediction, got.confidence, got.windows, got.probabilities) == ("a", 0.5, 2, {"a": 0.5, "b": 0.5})


def test_pooling_counts_windows_that_do_not_name_a_class(spark):
    rows = [("r", 0, "a", 0.9), *[("r", i, "b", 0.4) for i in (1, 2, 3)], ("r", 1, "b", 0.4)]
    got = M.pooled(spark.createDataFrame(rows, "record_id string, window_id int, class string, prob double")).first()
    assert (got.prediction, got.windows) == ("b", 4)
    assert got.probabilities == {"a": pytest.approx(0.9 / 2.1), "b": pytest.approx(1.2 / 2.1)}


def test_metrics_without_predictions_of_a_class(spark):
    p = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "c")], "label string, prediction string")
    r = {x["class"]: x for x in M.class_report(p).collect()}
    assert (r["b"].precision, r["b"].recall, r["b"].f1, r["b"].support) == (0.0, 0.0, 0.0, 2)
    s = M.summary(p).first()
    assert (s.accuracy, s.balanced_accuracy) == pytest.approx((1 / 3, 0.5))


def test_inspection_names_faults(spark):
    bad = series(spark, [None, None], record="empty").unionByName(spark.createDataFrame([("back", 0, 5.0, "c", 1.0), ("back", 1, 1.0, "c", 1.0)], SAMPLES))
    items = INS.report(bad)
    assert {r.record_id: r.error for r in items.collect()} == {"empty": "no finite value", "back": "times fall"}
    assert INS.status(items).first().status == "error"


def test_sessions(spark):
    from tidewave.streaming.windows import sessions

    at = lambda who, *minutes: [(who, f"2024-01-01 10:{m:02d}:00") for m in minutes]
    e = spark.createDataFrame([*at("a", 0, 4, 20), *at("b", 1)], "who string, at string").withColumn("ts", F.to_timestamp("at"))
    got = sorted((r.record_id, r.s_start.minute, r.n) for r in sessions(e, "who", "ts", "10 minutes").collect())
    assert got == [("a", 0, 2), ("a", 20, 1), ("b", 1, 1)]


def test_streaming_windows(spark, tmp_path):
    from tidewave.streaming.windows import window_stats

    rows = spark.sql("SELECT cast(id % 2 as string) AS who, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, cast(id AS double) AS v FROM range(50)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = window_stats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "who", "ts", "v", "10 minutes", late="1 minute")
    q = stream.writeStream.format("memory").queryName("stats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(str, df.select("record_id", "w_start", "n", "mean").collect()))
    assert key(spark.table("stats")) == key(window_stats(rows, "who", "ts", "v", "10 minutes"))
