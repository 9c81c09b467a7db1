"""Ledger and monitor state: only new rows are written, writers do not lose each other's rows."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from veritab.sources import ledger
from veritab.streaming import monitor


def results(spark, ids):
    return spark.createDataFrame([("r", f"f{i}", 5, 5, i / 8, "pairwise_similarity", "mean", "fake") for i in ids], "real_path string, fake_path string, real_size int, fake_size int, score double, metric string, scorer string, tag string")


def paths(spark, path):
    return sorted(r.fake_path for r in ledger.read_ledger(spark, path).collect())


def test_only_new_rows_are_written(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert paths(spark, path) == []
    ledger.save_results(spark, path, results(spark, range(50)))
    ledger.save_results(spark, path, results(spark, range(40, 53)), overwrite=True)
    parts = sorted(spark.read.parquet(p).count() for p in glob.glob(f"{path}/rows/*"))
    assert parts == [3, 50] and len(paths(spark, path)) == 53
    ledger.save_results(spark, path, results(spark, range(53)), overwrite=True)  # nothing new: no commit
    assert len(glob.glob(f"{path}/commits/[0-9]*")) == 2
    with pytest.raises(ValueError):
        ledger.save_results(spark, path, results(spark, [7]))


def test_two_writers_of_one_number(spark, tmp_path):
    path = str(tmp_path / "ledger")
    folder = ledger._Folder(spark, path)
    assert folder.publish(0, {"whole": False, "parts": []}) and not folder.publish(0, {"whole": False, "parts": ["lost"]})
    assert folder.read(0)["parts"] == [] and not os.listdir(f"{path}/drafts")


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    tables = [results(spark, range(start, start + 6)) for start in (0, 3, 6)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda rows: ledger.save_results(spark, path, rows, overwrite=True), tables))
    assert paths(spark, path) == sorted(f"f{i}" for i in range(12))


def test_compaction_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(3):
        ledger.save_results(spark, path, results(spark, [i]))
    old = ledger.read_ledger(spark, path)
    assert ledger.compact_ledger(spark, path)
    ledger.save_results(spark, path, results(spark, [3]))
    assert paths(spark, path) == ["f0", "f1", "f2", "f3"] and old.count() == 3
    assert len(ledger._Folder(spark, path).parts()[1]) == 2


def test_monitor_writes_changed_runs_only(spark, tmp_path):
    source, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "checkpoint"))
    run = lambda: {r.run: (r.total_sampled, r.total_processed) for r in monitor.generation_monitor(spark, source, "run string, ok boolean", "run", F.col("ok"), state, checkpoint).collect()}
    spark.createDataFrame([(f"r{i}", i % 2 == 0) for i in range(20)], "run string, ok boolean").write.parquet(source)
    assert run() == {f"r{i}": (1, int(i % 2 == 0)) for i in range(20)}
    spark.createDataFrame([("r3", True)], "run string, ok boolean").write.mode("append").parquet(source)
    expected = {f"r{i}": (1, int(i % 2 == 0)) for i in range(20)} | {"r3": (2, 1)}
    assert run() == expected and run() == expected  # a restart without new files changes nothing
    newest = max(glob.glob(f"{state}/version=*"))
    assert spark.read.parquet(newest).count() == 1
    monitor.compact_state(spark, state, "run")
    assert len(glob.glob(f"{state}/version=*")) == 1 and run() == expected
