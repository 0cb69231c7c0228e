"""Window scores pooled to records, and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def aligned_probabilities(scores: DataFrame, classes: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, class, prob) over all classes: missing ones 0, each key's sum 1."""
    frame = scores.select(key).distinct().crossJoin(F.broadcast(classes.select("class")))  # a row for each class
    p = F.coalesce("prob", F.lit(0.0))
    total = F.sum(p).over(Window.partitionBy(key))
    return frame.join(scores, [key, "class"], "left").select(key, "class", (p / F.greatest(total, F.lit(1e-12))).alias("prob"))


def pooled(window_scores: DataFrame) -> DataFrame:
    """window_scores(record_id, window_id, class, prob) -> a row for each record: prediction (the first class
    among equals), confidence, probabilities as a map, and windows.

    A class's mean is over all windows of the record: where a window does not name it, it is 0 there. Rows
    that repeat a window and class count as their mean.
    """
    own = window_scores.groupBy("record_id", "window_id", "class").agg(F.avg("prob").alias("p"))
    windows = own.groupBy("record_id", "window_id").agg(F.sum("p").alias("all")).groupBy("record_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("all").alias("all"))
    sums = own.groupBy("record_id", "class").agg(F.sum("p").alias("p")).join(windows, "record_id")
    # the mean over the windows, by the sum of the classes' means
    p = F.col("p") / F.col("windows") / F.greatest(F.col("all") / F.col("windows"), F.lit(1e-12))
    rows = sums.withColumn("p", p)
    top = F.min_by(F.struct("class", "p"), F.struct(-F.round("p", 12), F.col("class")))
    probabilities = F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "p"))))  # a row for each class
    found = rows.groupBy("record_id").agg(top.alias("top"), probabilities.alias("probabilities"), F.max("windows").alias("windows"))
    return found.select("record_id", F.col("top.class").alias("prediction"), F.col("top.p").alias("confidence"), "probabilities", "windows")


def confusion(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """(label, prediction, n) over all pairs of classes."""
    a, b = classes.select(F.col("class").alias("label")), classes.select(F.col("class").alias("prediction"))
    counts = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return a.crossJoin(F.broadcast(b)).join(F.broadcast(counts), ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # classes squared


def per_class(predictions: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, support) over the classes of labels and predictions: one pass, a row a class."""
    cells = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("label") == F.col("prediction")
    parts = cells.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )))
    sums = parts.groupBy("class").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumn("support", F.col("tp") + F.col("fn"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_report(predictions: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each class, and rows ``macro avg`` and ``weighted avg``."""
    c = per_class(predictions)
    rows = c.select("class", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = rows.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = rows.agg(*[ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    return rows.unionByName(macro).unionByName(weighted)


def summary(predictions: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy (mean recall of the true classes), macro and weighted F1: one row."""
    c = per_class(predictions).withColumns({"recall": F.when(F.col("support") > 0, F.col("tp") / F.col("support")), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
    return c.agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def log_loss(truth: DataFrame, probabilities: DataFrame, key: str = "record_id") -> DataFrame:
    """Mean of -ln of the true class's probability, kept within [eps, 1 - eps]."""
    p = truth.join(probabilities, (truth[key] == probabilities[key]) & (truth["label"] == probabilities["class"]), "left").select(F.coalesce("prob", F.lit(0.0)).alias("p"))
    return p.agg((-F.avg(F.ln(F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("p")))))).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def validity(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Share of the records that were evaluated, and whether the metrics are valid: all of them, all
    classes, and two records of each class; else diagnostic_only, or insufficient_independent_records
    where nothing was evaluated."""
    done = predictions.select("record_id").distinct().withColumn("__d", F.lit(1))
    rows = records.join(done, "record_id", "left")
    by_class = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("__d").alias("d"))
    all_ = by_class.agg(F.sum("n").alias("records"), F.sum("d").alias("evaluated"), F.min("n").alias("least"), F.count_if(F.col("d") > 0).alias("seen"), F.count(F.lit(1)).alias("classes"))
    good = (F.col("evaluated") == F.col("records")) & (F.col("seen") == F.col("classes")) & (F.col("least") >= 2)
    status = F.when(F.coalesce(F.col("evaluated"), F.lit(0)) == 0, "insufficient_independent_records").when(good, "valid").otherwise("diagnostic_only")
    return all_.select("records", "evaluated", ratio(F.col("evaluated"), F.col("records")).alias("coverage"), status.alias("status"))
