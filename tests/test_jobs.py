"""The file-based jobs on derived posts."""

from __future__ import annotations

from footfall.plans import jobs
from footfall.sources import derived, kml, posts


def rule_rows(tables):
    return sorted(map(str, tables["rules"].collect()))


def test_mobility_job_on_files(spark, tables, tmp_path):
    data, words, regions = (str(tmp_path / name) for name in ("posts.json", "words.txt", "regions.kml"))
    frame = derived.posts(spark, tables)
    posts.write_posts_json(frame, data, wrapped=True)
    derived.terms(spark, ["trevi", "pantheon"]).write.text(words)
    found = jobs.mobility_job(spark, data, keywords_path=words)
    assert {r.poi for r in found["rois"].collect()} <= {"trevi", "pantheon"}
    assert rule_rows(found) == rule_rows(jobs.pipeline(frame, rois=found["rois"]))
    kml.write_roi_kml(derived.place_regions(spark), regions)
    given = jobs.mobility_job(spark, data, rois_path=regions)
    assert set(given) == {"rois", "itemsets", "rules", "rejected"}
    assert rule_rows(given) == rule_rows(jobs.trajectory_rules(frame, derived.place_regions(spark)))
