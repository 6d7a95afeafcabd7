"""Stored stages: one writer publishes, ended ones leave nothing."""

import threading
import time

import pytest

from tokloom.sources import stages


def write_rows(spark, n, log, delay=0.0):
    def write(path):
        log.append(path)
        time.sleep(delay)
        spark.range(n).write.parquet(path)
    return write


def test_two_sessions_at_once_write_one_stage(spark, tmp_path):
    log, got = [], []
    path = str(tmp_path / "stage")
    other = spark.newSession()

    def run(s):
        got.append(stages.stored(s, path, write_rows(s, 5, log, 2.0)))

    threads = [threading.Thread(target=run, args=(s,)) for s in (spark, other)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(log) == 1 and got == log * 2 and spark.read.parquet(got[0]).count() == 5
    assert sorted(stages.Folder(spark, path).names()) == sorted(["PUBLISHED", got[0].rsplit("/", 1)[1]])
    assert stages.table(spark, path, write_rows(spark, 9, log)).count() == 5 and len(log) == 1


def test_the_lease_of_an_ended_writer_is_taken_over(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "stage"), []
    folder = stages.Folder(spark, path)
    assert folder.create("LEASE", "attempt-of-another") and not folder.create("LEASE", "mine")
    spark.range(3).write.parquet(f"{path}/attempt-of-another")
    monkeypatch.setattr(stages, "STALE_S", 0.5)
    monkeypatch.setattr(stages, "RENEW_S", 0.2)
    got = stages.stored(spark, path, write_rows(spark, 4, log, 1.5))
    assert spark.read.parquet(got).count() == 4 and folder.read("LEASE") is None
    assert [n for n in folder.names() if n.startswith("attempt-")] == [got.rsplit("/", 1)[1]]


def test_a_failed_writer_frees_the_stage(spark, tmp_path):
    path, log = str(tmp_path / "stage"), []

    def fail(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        stages.stored(spark, path, fail)
    assert spark.read.parquet(stages.stored(spark, path, write_rows(spark, 2, log))).count() == 2


def test_fingerprints_follow_the_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "documents.parquet"))
    a = stages.fingerprint(spark, str(tmp_path), "documents")
    assert a == stages.fingerprint(spark, str(tmp_path), "documents")
    spark.range(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert stages.fingerprint(spark, str(tmp_path), "documents") != a
    assert stages.stage_path(spark, "x", a, 1) != stages.stage_path(spark, "x", a, 2)
