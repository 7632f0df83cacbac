"""Intermediate folders."""

from pathlib import Path

from vectrail import scratch


def test_folders_are_removed_at_the_end_of_a_job(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_named", [])
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    assert scratch.written(spark.range(3), "some").count() == 3
    scratch.new_path(spark, "never-written")
    assert len(list(Path(tmp_path).iterdir())) == 1
    assert scratch.remove_scratch(spark) == 1
    assert not list(Path(tmp_path).iterdir()) and scratch.remove_scratch(spark) == 0
