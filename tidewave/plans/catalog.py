"""Registered queries over the driver's tables, each with the same in SQL for another engine.

Times of ``events`` span 30 days, so windows are two days long and hop by one; rates are per hour or day.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import columns as C
from ..operators import inspect as INS
from ..operators import metrics as M
from ..operators import normalize as N
from ..operators import resample as R
from ..operators import selection as SEL
from ..operators import stats as ST
from ..operators import timeaxis as T
from ..operators import windows as W
from ..sources import files as FI
from ..sources import mat as MAT
from ..sources import sinks as SK
from ..sources.settings import Settings
from ..streaming import windows as STW
from . import oracles
from . import pipeline as P

Query = Callable[[SparkSession, str], DataFrame]
DAY = 86400.0
LENGTH, STRIDE, MOST = 2 * DAY, DAY, 240
STEPS = 16
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.samples(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_type", "value")


def spans(s: DataFrame) -> DataFrame:
    return s.groupBy("record_id").agg(F.lit(0.0).alias("start"), F.max("t").alias("end"))


def windows(s: DataFrame) -> DataFrame:
    return W.hopping(spans(s), LENGTH, STRIDE, MOST)


def rounded(df: DataFrame, digits: int = 6, fixed: Callable = S.fixed) -> DataFrame:
    return df.select(*[fixed(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# names, numbers, files


def file_table(docs: DataFrame) -> DataFrame:
    """File names as two kinds of recordings would have them, one of each kind for most documents."""
    kinds = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("IR"))).when(F.col("doc_id") % 13 == 0, F.array(F.lit("radar"))).otherwise(F.array(F.lit("ir"), F.lit("Radar")))
    rows = docs.select("doc_id", "lang", F.explode(kinds).alias("kind"))
    stem = F.concat_ws("_", "kind", F.col("doc_id").cast("string"), F.concat(F.lit("class-"), F.col("lang")), F.concat(F.lit("16："), (F.col("doc_id") % 60).cast("string")))
    return rows.select(F.concat(F.lit("/in/"), stem, F.when(F.lower("kind") == "ir", ".mp4").otherwise(".mat")).alias("path"), stem.alias("stem"))


@query
def parsed_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_table(table(spark, sf_dir, "documents"))
    return files.withColumn("p", FI.parsed_name(F.col("stem"))).where("p IS NOT NULL").select("path", "p.*")


@query
def record_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.pair_report(parsed_file_names(spark, sf_dir))


@query
def checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their sizes; an empty one would raise."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") + 1).alias("size"))
    return FI.checked_size(sizes.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), "size"))


@query
def clean_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as the column names of tables of sixteen pages, every fifth as if it had a suffix already."""
    host = S.clean_name(F.regexp_extract("url", "://([^/]*)", 1))
    pages = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 16).alias("table_id"), F.when(F.col("page_id") % 5 == 4, F.concat(host, F.lit("_2"))).otherwise(host).alias("name"))
    return N.unique_names(pages, "name", "page_id", ["table_id"])


@query
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cached results, by files, settings and channels."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("record_id"), F.col("url").alias("left_path"), F.octet_length("html").alias("left_size"), F.lit(1).alias("left_modified"), F.lit("r").alias("right_path"), F.col("page_id").alias("right_size"), F.lit(2).alias("right_modified"))
    return P.keyed(pages, Settings(), ["a", "b"]).select("record_id", "cache_key")


@query
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    mixed = F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).when(F.col("p_partkey") % 5 == 1, F.concat_ws("/", F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("string"))).when(F.col("p_partkey") % 5 == 2, F.lit("N/A")).otherwise(F.col("p_size").cast("string"))
    rows = part.select("p_partkey", mixed.alias("text"))
    return rounded(rows.select("p_partkey", S.lenient_ratio(F.col("text")).alias("ratio"), S.lenient_int(F.col("text")).alias("whole"), S.lenient_float(F.col("text")).alias("number")))


@query
def derived_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    d = S.derived_length(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).otherwise(0), F.col("l_quantity"), F.when(F.col("l_linenumber") % 3 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice")))
    return rounded(li.select("l_orderkey", "l_linenumber", d.alias("d")).groupBy("l_linenumber").agg(F.sum("d.frames").alias("frames"), F.sum(F.round("d.duration", 3)).alias("duration")), 2)


@query
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    print_ = S.file_fingerprint(F.col("url"), F.octet_length("html"), F.col("page_id"))
    return pages.select("page_id", print_.alias("fingerprint"), S.short_hash(F.concat_ws(":", "url", F.lit("3")), 20).alias("cache_key"), SK.sha256_of(F.col("html")).alias("sha256"))


@query
def array_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a variable of eight rows and columns, a part of it turned, and a list too short; names clash."""
    emb = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL")
    v = F.transform("embedding", lambda x: x.cast("double"))
    square = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(v, r * 8 + 1, 8))
    short = F.transform(F.slice(v, 1, 5), lambda x: F.array(x))
    data = F.array(square, F.slice(square, 1, 2), short)
    rows = emb.select("vec_id", data.alias("data"), F.array(F.lit("a b"), F.lit("a_b"), F.lit("a_b_1")).alias("names"), F.lit("8").alias("nrows"))
    return rounded(FI.array_table(rows, "vec_id", "data", "names", "nrows"))


def containers(emb: DataFrame) -> DataFrame:
    """A container for each vector (path, content): its first two numbers, and all as 16 rows of 4 columns."""

    def variable(name: bytes, v: np.ndarray) -> bytes:
        return struct.pack("<5i", 0, *v.shape, 0, len(name) + 1) + name + b"\0" + v.astype("<f8").tobytes("F")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, float) for v in batch.column(1).to_pylist()]
            content = [variable(b"few", v[:2].reshape(2, 1)) + variable(b"m", v.reshape(16, 4, order="F")) for v in vectors]
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "content": pa.array(content, pa.binary())})

    return emb.select(F.col("vec_id").cast("string"), "embedding").mapInArrow(packed, "path string, content binary")


@query
def container_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger variable of each container as a table."""
    emb = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL")
    return rounded(MAT.tables(containers(emb)).withColumnRenamed("path", "vec_id"))


@query
def transposed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows of six columns: the shape says that they are columns."""
    k = F.col("r_regionkey").cast("double")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), *[(k * i).alias(f"c{i}") for i in range(1, 6)], F.length("r_name").cast("double").alias("c6"))
    return FI.by_shape(region, "k", [f"c{i}" for i in range(1, 7)])


# vectors and columns


@query
def vector_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(emb.select("vec_id", V.summaries(F.col("v")).alias("s")).select("vec_id", "s.*"))


@query
def vector_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(V.expanded(emb, "v", 64))


@query
def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_gap", F.when(F.col("l_linenumber") > 2, F.col("l_tax"))).withColumn("l_none", F.lit(None).cast("double"))
    columns = ["l_quantity", "l_extendedprice", "l_gap", "l_none"]
    used = N.usable_columns(li, columns)
    return rounded(N.column_profile(N.melted(li, ["l_orderkey"], used)))


@query
def numeric_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps, complex numbers, text with and without numbers, and clashing names as numbers."""
    e = table(spark, sf_dir, "events")
    z = F.struct(F.col("value").alias("re"), (F.col("value") * 0.75).alias("im"))
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).otherwise("n/a")
    rows = e.select("event_id", "ts", z.alias("z"), mixed.alias("z abs"), "event_type", F.lit(None).cast("double").alias("nothing"), (F.col("user_id") % 2 == 0).alias("even"))
    return rounded(C.numeric_frame(rows, ["event_id"]))


@query
def winsor_scaled_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return N.winsor_scaled(li, "l_extendedprice", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "scaled")


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window features side by side, a column for each of two channels and two statistics."""
    s = samples(spark, sf_dir)
    found = ST.series_features(W.inside(s, windows(s), LENGTH), ["record_id", "window_id", "channel"])
    return rounded(ST.wide(found, ["record_id", "window_id"], ["click", "view"], ["mean", "max"]))


# time axes, normalisation


@query
def record_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.record_meta(samples(spark, sf_dir)), 4)


@query
def inferred_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds told by their step; the time source of each record."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("record_id"), F.col("event_id").alias("seq"), (S.epoch_micros(F.col("ts")) / 1000).alias("event_time"), "value")
    found = T.inferred(events, "record_id", "seq", ["value", "event_time"])
    return rounded(found.groupBy("record_id", "time_source").agg(F.max("t").alias("last"), F.max("rate_hz").alias("rate_hz")), 4)


@query
def scaled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 10 == 0, None).otherwise(F.col("value")))
    return rounded(N.robust_scaled(N.imputed(s), bound=8.0).select("record_id", "seq", "channel", "value", "z"))


@query
def row_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.activity(samples(spark, sf_dir)).select("record_id", "seq", "activity"))


@query
def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(INS.report(samples(spark, sf_dir)), 4)


# windows and features


@query
def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows(samples(spark, sf_dir)), 4)


@query
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    w = windows(s)
    found = ST.series_features(W.inside(s, w, LENGTH), ["record_id", "window_id", "channel"], carry=["w_start", "w_end"])
    coverage = W.coverage(F.col("n_rows"), F.col("w_start"), F.col("w_end"), F.lit(1 / DAY))
    return rounded(found.withColumn("coverage", coverage).drop("w_start", "w_end"))


@query
def window_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of each window, each record at its own rate; windows of six hours, many of them empty."""
    s = samples(spark, sf_dir)
    w = W.hopping(spans(s), DAY / 4, DAY / 4)
    return rounded(ST.window_feature_rows(s, w, T.record_meta(s), DAY / 4), 5)


@query
def recorded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records built from a wide table: clock, rate, duration and share of values."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), "event_id", F.col("ts").alias("event_time"), "value", F.when(F.col("event_id") % 4 != 0, F.col("value") * 2).alias("other"))
    _, moving, meta = P.sequences(e, "user", "event_id")
    top = moving.groupBy("record_id").agg(F.count(F.lit(1)).alias("rows"), F.max("activity").alias("most"))
    return rounded(meta.join(top, "record_id"), 4)


@query
def cached_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each cached result, from a manifest in which some were made again."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderstatus").alias("cache_key"), F.col("o_orderkey").alias("at"), F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("run"), (F.col("o_orderkey") % 5).alias("windows"))
    return SK.latest(o)


@query
def nearest_for_empty_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows, many of them empty."""
    s = samples(spark, sf_dir)
    w = W.hopping(spans(s), DAY / 4, DAY / 4, 200)
    found = W.inside_or_nearest(s, w, DAY / 4)
    return rounded(found.groupBy("record_id", "window_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.bool_or("nearest").alias("nearest"), F.avg("value").alias("mean")))


@query
def evenly_chosen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.evenly_chosen(samples(spark, sf_dir), 6, ["record_id"], "seq").select("record_id", "place", "seq")


@query
def decimated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.decimated(samples(spark, sf_dir), 5.0, 2.0, 12, ["record_id"], "seq").select("record_id", "idx", "seq", "t_idx"))


@query
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.capped(W.first_of_each_time(samples(spark, sf_dir)), ["record_id"], "seq", 5).select("record_id", "seq", "channel")


@query
def vector_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("seq", "value")).withColumn("value", F.col("value").cast("double"))
    return rounded(ST.spectral_features(emb, ["vec_id"], 8.0), 5)


@query
def vector_spectra_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(ST.spectral_features_fft(emb, ["vec_id"], "v", 8.0), 5)


# grids and alignment


@query
def daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    grid = R.uniform_grid(s.groupBy("record_id", "channel").agg(F.max("t").alias("duration")), DAY)
    return rounded(R.interpolated(s, grid, ["record_id", "channel"]).select("record_id", "channel", "i", "value"))


@query
def window_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen channels at even points of each window, scaled within the window."""
    s = samples(spark, sf_dir)
    channels = SEL.chosen_channels(s, s.select("record_id").distinct().count(), 3)
    found = R.window_series(s, windows(s), channels, STEPS)
    scaled = N.robust_scaled(found, ["record_id", "window_id", "channel"], least=1e-6, std_next=False, bound=8.0)
    return rounded(scaled.select("record_id", "window_id", "channel", "i", "z"), 5)


def two_sides(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda c: s.where(F.col("channel") == c).select("record_id", "seq", (F.col("t") / DAY).alias("t"), "value")
    return side("click"), side("view")


@query
def record_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = two_sides(samples(spark, sf_dir))
    return rounded(R.alignment(left, right, 5.0, 2.0), 5)


@query
def aligned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = two_sides(samples(spark, sf_dir))
    shift = R.alignment(left, right, 5.0, 2.0).select("record_id", "offset")
    ends = left.groupBy("record_id").agg(F.max("t").alias("left_duration")).join(right.groupBy("record_id").agg(F.max("t").alias("right_duration")), "record_id")
    both = W.overlap(shift.join(ends, "record_id"))
    return rounded(W.mapped(W.hopping(both, 4.0, 2.0, MOST)).select("record_id", "window_id", "w_start", "w_end", "l_start", "l_end"), 5)


# selection


@query
def channel_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return rounded(SEL.chosen_channels(s, s.select("record_id").distinct().count(), 3), 4)


@query
def channel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over 40 of the chosen channels. A mean is judged exactly; its value is of a sum in the order of the rows, as in
    SQL, so one that ends in half a unit is rounded as there."""
    s = samples(spark, sf_dir)
    whole = Window.partitionBy("record_id", "channel").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.try_divide(F.first("total"), F.count("value"))
    means = s.withColumn("total", F.sum("value").over(whole)).groupBy("record_id", "channel").agg(S.exact_mean(F.col("value")).alias("exact"), mean.alias("value")).where("exact > 40").drop("exact")
    return rounded(SEL.looked_up(means, SEL.chosen_channels(s, s.select("record_id").distinct().count(), 4), ["record_id"]).select("record_id", "channel", "value"), fixed=S.scaled_fixed)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("label"), (F.col("c_custkey") % 4).alias("windows"))


@query
def class_weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SEL.class_weights(labelled(spark, sf_dir)).join(SEL.label_index(labelled(spark, sf_dir)), "label"))


@query
def window_sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SEL.sample_weights(SEL.window_refs(labelled(spark, sf_dir))), 9)


@query
def record_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.folds(labelled(spark, sf_dir), 5, 2026)[0]


@query
def left_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("record_id"), F.when(F.col("r_regionkey") < 4, "A").otherwise("B").alias("label"))
    return SEL.folds(few, 5, 2026)[0]


@query
def weighted_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "supplier").select("s_suppkey", F.greatest(F.lit(0.0), F.floor("s_acctbal")).cast("double").alias("w"))
    return SEL.weighted_draws(items, "s_suppkey", "w", 500, 7)


# scores and metrics


def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of windows as a model would give them: event values by type and day."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("record_id"), F.dayofmonth("ts").alias("window_id"), F.col("event_type").alias("class"), (F.col("value") / 500).alias("prob"))


@query
def pooled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.pooled(window_scores(spark, sf_dir))
    return rounded(found.select("record_id", "prediction", "confidence", F.try_element_at("probabilities", F.lit("click")).alias("p_click"), "windows"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule against the labelled quality, as two classes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    name = lambda c: F.when(c, "good").otherwise("poor")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("record_id"), name(F.col("quality") == 1).alias("label"), F.when(F.col("n_chars") > 20000, "long").otherwise(name(F.col("n_chars") > 500)).alias("prediction"))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    classes = p.select(F.explode(F.array("label", "prediction")).alias("class")).distinct()
    return M.confusion(p, classes)


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.class_report(predictions(spark, sf_dir)))


@query
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.summary(predictions(spark, sf_dir)))


@query
def aligned_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes dealt to records as their labels, some of which a record has no score for."""
    s = window_scores(spark, sf_dir).groupBy("record_id", "class").agg(F.avg("prob").alias("prob"))
    classes = table(spark, sf_dir, "events").select(F.col("event_type").alias("class")).distinct()
    names = classes.agg(F.array_sort(F.collect_list("class")).alias("names"))  # one row
    records = window_scores(spark, sf_dir).select("record_id").distinct().crossJoin(F.broadcast(names))
    truth = records.select("record_id", F.get("names", F.pmod("record_id", F.size("names")).cast("int")).alias("label"))
    return rounded(M.log_loss(truth, M.aligned_probabilities(s, classes)))


@query
def evaluation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = labelled(spark, sf_dir)
    return rounded(M.validity(records, records.where("record_id % 3 <> 0")))


@query
def detection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    found = W.evenly_chosen(s, 6, ["record_id"], "seq")
    return rounded(found.groupBy("record_id").agg(F.avg((F.col("channel") == "view").cast("int")).alias("rate")))


# caches, documents, sets


@query
def cache_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SK.manifest_totals(labelled(spark, sf_dir).withColumn("cache_hit", F.col("record_id") % 7 == 0))


@query
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderstatus").alias("cache_key")).distinct()
    held = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("record_id"), F.when(F.col("c_nationkey") % 2 == 0, "O").otherwise("F").alias("cache_key"))
    return SK.missing(wanted, held)


@query
def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SK.json_rows(SEL.class_counts(labelled(spark, sf_dir)))


@query
def class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of dear parts that cheap ones do not have, and the other way round."""
    r = table(spark, sf_dir, "part").select(F.concat_ws("#", "p_brand", F.col("p_size").cast("string")).alias("label"), (F.col("p_retailprice") > 1200).alias("dear"))
    a, b = r.where("dear").select("label").distinct(), r.where("NOT dear").select("label").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


@query
def best_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the greatest values of each series."""
    s = samples(spark, sf_dir)
    best = F.max(F.struct("value", (-F.col("seq")).alias("neg"), "t")).alias("b")
    return rounded(s.groupBy("record_id", "channel").agg(best).select("record_id", "channel", F.col("b.value").alias("value"), (-F.col("b.neg")).alias("seq"), F.col("b.t").alias("t")))


@query
def epoch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming extension's windows, over the table."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = STW.window_stats(e, "user_id", "ts", "value", "6 hours")
    return rounded(found.select("record_id", (S.epoch_micros(F.col("w_start")) / 1e6).alias("w_start"), "n", "mean", "min", "max"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
