"""Command line: python -m tidewave.cli all|inspect|infer|clean-cache ...

Recordings are Parquet files or MATLAB containers in a folder, in pairs by name: ``radar_...`` with any columns (a
clock is found among them) and ``ir_...`` with t, activity and detected. Window scores (record_id, window_id, class, prob) come
from whatever model made them.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .deploy import ship
from .operators import metrics as M
from .plans import pipeline
from .sources import files
from .sources import settings as conf
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewave")
    p.add_argument("--config", default="config.yaml")
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("all", help="pair, inspect, align, cut windows (cached), folds, metrics; status 2 where inspection fails")
    a.add_argument("--data", help="folder of recordings, radar_<batch>_class-<label>_<time>.parquet (or .mat) and ir_...")
    a.add_argument("--out")
    a.add_argument("--scores", help="window scores of a model, to evaluate")
    a.add_argument("--profile")
    a.add_argument("--rebuild-cache", action="store_true")
    i = verbs.add_parser("inspect", help="report each record; status 2 if any has an error")
    i.add_argument("--samples")
    i.add_argument("--data")
    i.add_argument("--profile")
    f = verbs.add_parser("infer", help="pool window scores to records")
    f.add_argument("--scores", required=True)
    f.add_argument("--output", required=True)
    c = verbs.add_parser("clean-cache")
    c.add_argument("--cache")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "clean-cache":
        sinks.clean_cache(args.cache or conf.load(args.config).cache)
        return 0
    spark = ship(SparkSession.builder.appName("tidewave").getOrCreate())
    if args.verb == "infer":
        sinks.write_json(M.pooled(spark.read.parquet(args.scores)), args.output)
        return 0
    chosen = conf.load(args.config, profile=args.profile, workers=spark.sparkContext.defaultParallelism)
    folder = args.data or chosen.data
    if args.verb == "inspect":
        samples = spark.read.parquet(args.samples) if args.samples else pipeline.sequences(pipeline.recorded(spark, folder, files.LEFT), "record_id", "seq")[0]
        items, status = pipeline.inspected(samples)
        for row in sinks.json_rows(items).toLocalIterator():
            print(row.json)
        return status
    scores = spark.read.parquet(args.scores) if args.scores else None
    result = pipeline.whole_run(spark, chosen, folder, chosen.cache, args.out or chosen.run, scores, args.rebuild_cache)
    print(json.dumps(result, default=str))
    return 0 if result["status"] == "complete" else 2


if __name__ == "__main__":
    sys.exit(main())
