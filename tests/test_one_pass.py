"""Accepted and rejected lines of a tracking stream come from one pass over it."""

from trackframe.plans import scans
from trackframe.sources import files


def test_lines_are_read_once(spark, sf):
    plan = scans.tracking_files(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("MapInArrow") == 2  # one counts lines, one numbers them


def test_a_rejected_line_has_no_frame(spark, tmp_path):
    good = '{"frame":1,"timestamp":"00:00:00.00","period":1,"ball_data":null,"possession":null,"image_corners_projection":null,"player_data":[]}'
    (tmp_path / "a.txt").write_text("\n".join([good, good.replace('"period":1', '"period":"1"'), "", good.replace('"frame":1', '"frame":2')]) + "\n")
    lines = files.tracking_lines(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(x.ordinal, x.problem, x.r and x.r.frame) for x in lines] == [(0, None, 1), (1, "type", None), (2, "blank", None), (3, None, 2)]
    rows, rejects = files.read_tracking_ordered(spark, str(tmp_path))
    assert [r.frame for r in rows.orderBy("ordinal").collect()] == [1, 2] and [r.problem for r in rejects.orderBy("ordinal").collect()] == ["type", "blank"]
