"""The command line and the plan behind it."""

import json
import math
from dataclasses import replace

import pytest

from tidewave import cli
from tidewave.plans import pipeline
from tidewave.sources import settings


def test_clean_cache_without_settings(tmp_path):
    assert cli.main(["--config", str(tmp_path / "absent"), "clean-cache", "--cache", str(tmp_path / "cache")]) == 0


@pytest.fixture(scope="module")
def recordings(spark):
    wave = lambda t: math.sin(t / 2) + (5 if 20 < t < 23 else 0)
    left = [(r, i, i * 0.5, c, wave(i * 0.5) * k) for r in ("a", "b") for i in range(120) for c, k in (("x", 1.0), ("y", -2.0))]
    right = [(r, i, i * 0.5, abs(wave(i * 0.5 - 2)), i % 2 == 0) for r in ("a", "b") for i in range(124)]
    return spark.createDataFrame(left, "record_id string, seq long, t double, channel string, value double"), spark.createDataFrame(right, "record_id string, seq long, t double, activity double, detected boolean")


def test_sequences_of_recorded_tables(spark):
    rows = [("a", i, 5.0 + i * 0.5, float(i % 3), None) for i in range(6)] + [("b", 0, 1.0, 2.0, None)]
    wide = spark.createDataFrame(rows, "batch string, line long, `time (s)` double, snr double, empty double")
    long, activity, meta = pipeline.sequences(wide, "batch", "line")
    assert {r.channel for r in long.select("channel").distinct().collect()} == {"time_s", "snr"}
    found = {r.record_id: r for r in meta.collect()}
    assert (found["a"].rate_hz, found["a"].time_source, found["a"].duration, found["a"].valid_ratio) == (2.0, "time (s)", 3.0, 1.0)
    assert (found["b"].rate_hz, found["b"].time_source) == (1.0, "row_index")
    assert activity.where("record_id = 'a'").count() == 6


def test_windows_of_a_pair(recordings, tmp_path):
    chosen = replace(settings.load(profile="quick"), channels=2, steps=8, max_alignment_lag_seconds=5.0)
    windows, series = pipeline.preprocessed(*recordings, chosen, str(tmp_path))
    rows = windows.orderBy("record_id", "window_id").collect()
    assert len({r.record_id for r in rows}) == 2 and len(rows) >= 16
    for r in rows:
        assert r.w_end - r.w_start == pytest.approx(12.0) and 0 < r.coverage_left <= 1 and 0 < r.coverage_right <= 1 and 0 <= r.detected_rate <= 1
    assert series.count() == len(rows) * 2 * 8
    assert series.where("abs(z) > 8 OR z IS NULL").count() == 0


def test_each_record_has_its_own_rate(recordings, spark):
    left, _ = recordings
    mixed = left.where("record_id = 'a'").unionByName(left.where("record_id = 'b'").withColumn("t", left.t * 4))
    assert {r.record_id: r.rate_hz for r in pipeline.clocks(mixed).collect()} == {"a": 2.0, "b": 0.5}


def test_verbs(spark, recordings, tmp_path, capsys):
    left, _ = recordings
    left.write.parquet(str(tmp_path / "s"))
    assert cli.main(["inspect", "--samples", str(tmp_path / "s")]) == 0
    assert {json.loads(x)["record_id"] for x in capsys.readouterr().out.splitlines()} == {"a", "b"}
    spark.createDataFrame([("a", 0, "p", 0.7), ("a", 0, "q", 0.3)], "record_id string, window_id int, class string, prob double").write.parquet(str(tmp_path / "w"))
    assert cli.main(["infer", "--scores", str(tmp_path / "w"), "--output", str(tmp_path / "r")]) == 0
    assert spark.read.json(str(tmp_path / "r")).first().prediction == "p"


@pytest.fixture
def folder(recordings, tmp_path):
    """Four records of two classes, a pair of files each."""
    left, right = (df.toPandas() for df in recordings)
    data = tmp_path / "data"
    data.mkdir()
    for i, label in enumerate(["class-A", "class-A", "class-B", "class-B"]):
        r = "ab"[i % 2]
        wide = left[left.record_id == r].pivot(index="seq", columns="channel", values="value").reset_index(drop=True)
        wide.insert(0, "time (s)", 3 + 0.5 * wide.index)
        wide.to_parquet(data / f"radar_{i}_{label}_10：0{i}.parquet")
        right[right.record_id == r][["t", "activity", "detected"]].reset_index(drop=True).to_parquet(data / f"IR_{i}_{label}_10：0{i}.parquet")
    (tmp_path / "s.yaml").write_text(f"profile: quick\ncommon: {{channels: 2, steps: 8, max_alignment_lag_seconds: 5}}\npaths: {{cache: {tmp_path}/cache}}\n")
    return data


def test_all(spark, folder, tmp_path, capsys):
    scores = [(str(i), w, c, p if (i < 2) == (c == "class-A") else 1 - p) for i, p in enumerate([0.9, 0.8, 0.7, 0.2]) for w in range(2) for c in ("class-A", "class-B")]
    spark.createDataFrame(scores, "record_id string, window_id int, class string, prob double").write.parquet(str(tmp_path / "w"))
    verb = ["--config", str(tmp_path / "s.yaml"), "all", "--data", str(folder), "--out", str(tmp_path / "out")]

    def run(*more):
        capsys.readouterr()
        status = cli.main([*verb, *more])
        return status, json.loads(capsys.readouterr().out.splitlines()[-1])

    status, result = run("--scores", str(tmp_path / "w"))
    assert status == 0 and result["status"] == "complete" and result["classes"] == {"class-A": 2, "class-B": 2}
    assert result["folds"] == "stratified_record_cv" and result["channels"] == ["x", "y"] or set(result["channels"]) <= {"x", "y", "time_s"}
    assert result["evaluation"]["accuracy"] == 0.75 and result["evaluation"]["status"] == "valid"
    windows = spark.read.parquet(str(tmp_path / "out/windows"))
    assert windows.count() == result["cache"]["windows"] >= 32 and result["cache"]["cache_hits"] == 0
    assert all(set(r.series) == set(result["channels"]) and all(len(v) == 8 for v in r.series.values()) for r in windows.collect())
    assert spark.read.json(str(tmp_path / "out/result")).first().status == "complete"
    assert run()[1]["cache"]["cache_hits"] == 4
    assert run("--rebuild-cache")[1]["cache"] == {"records": 4, "windows": result["cache"]["windows"], "cache_hits": 0}


def test_all_stops_where_inspection_fails(folder, tmp_path, capsys):
    next(folder.glob("IR_3_*")).unlink()
    assert cli.main(["--config", str(tmp_path / "s.yaml"), "all", "--data", str(folder), "--out", str(tmp_path / "out")]) == 2
    result = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (result["status"], result["faults"]) == ("failed_data_inspection", [{"record_id": "3", "status": "left_only"}])
    assert cli.main(["inspect", "--data", str(folder)]) == 0
