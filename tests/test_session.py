"""Stage folders of applications that share a root."""

from __future__ import annotations

from pathlib import Path

from footfall import session
from footfall.session import clear_stages, stage, stage_path


def test_clearing_leaves_other_applications_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "stage_root", lambda _: str(tmp_path))
    other = tmp_path / "footfall" / "another-application" / "table"
    other.mkdir(parents=True)
    kept = stage(spark.range(3), "kept")
    assert kept.count() == 3 and stage(kept, "again") is kept
    assert spark.sparkContext.applicationId in stage_path(spark, "x")
    clear_stages(spark)
    assert other.exists() and not Path(stage_path(spark, "x")).parent.exists()
