"""Strict readers, sinks, archives, logs and settings."""

import json

import pytest
from pyspark.sql import functions as F

from trackframe.operators import audit, samples
from trackframe.params import Params
from trackframe.sources import files

FRAME = {
    "frame": 10, "timestamp": "00:00:01.00", "period": 1, "ball_data": {"x": 1.0, "y": 2, "z": None, "is_detected": True},
    "possession": {"player_id": None, "group": "home team"}, "image_corners_projection": [], "player_data": [{"x": 1.5, "y": 2.5, "player_id": 7, "is_detected": False}],
}


def changed(path, value):
    f = json.loads(json.dumps(FRAME))
    at = f
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return json.dumps(f)


BAD = [
    ("   ", "blank"), (json.dumps(FRAME)[:-1], "keys"), (json.dumps(FRAME)[:-1] + ', "frame": 3}', "keys"), (json.dumps(FRAME).replace('"z": null', '"z": null, "x": 3'), "json"), (changed(["ball_data", "x"], float("nan")), "keys"),
    (changed(["ball_data", "x"], float("inf")), "keys"), (changed(["more"], 1), "keys"), (changed(["frame"], "10"), "type"), (changed(["frame"], 1.5), "type"), (changed(["frame"], None), "type"),
    (changed(["period"], "1"), "type"), (changed(["timestamp"], 3), "type"), (changed(["ball_data"], [1]), "type"), (changed(["ball_data", "is_detected"], 1), "type"), (changed(["ball_data", "x"], "1"), "type"),
    (changed(["possession", "group"], 4), "type"), (changed(["possession", "other"], 4), "type"), (changed(["player_data"], {}), "type"), (changed(["player_data", 0, "player_id"], "7"), "type"),
    (changed(["player_data", 0, "is_detected"], "no"), "type"), (json.dumps({k: v for k, v in FRAME.items() if k != "period"}), "keys"), (json.dumps(FRAME) + " " * 4000, "too_long"),
]


def test_every_reason_to_reject_a_frame(spark, tmp_path):
    good = [json.dumps(FRAME), changed(["ball_data"], None), changed(["player_data"], []), changed(["period"], None), changed(["ball_data", "x"], None)]
    (tmp_path / "t.jsonl").write_text("\n".join(good + [b for b, _ in BAD]) + "\n")
    rows, rejects = files.read_tracking(spark, str(tmp_path / "t.jsonl"), max_length=2000)
    assert rows.count() == len(good) and rows.where("get(player_data, 0).x = 1.5").count() == 4
    assert sorted((r.value, r.problem) for r in rejects.collect()) == sorted(BAD)
    s = files.scan_statistics(rows).first()
    assert (s.rows, s.even_rows, s.players) == (5, 5, 4)


def test_a_file_that_changes_is_noticed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.txt").write_text("x")
    before = files.identity(spark, str(tmp_path / "a"))
    files.unchanged(spark, str(tmp_path / "a"), before)
    (tmp_path / "a" / "t.txt").write_text("xy")
    with pytest.raises(ValueError, match="changed"):
        files.unchanged(spark, str(tmp_path / "a"), before)


def test_headers_and_sizes(spark, tmp_path):
    (tmp_path / "p.csv").write_text("period,frame_start,frame_end\n1,10,20\n1,20,20\n1,x,30\n")
    rows, rejects = files.read_phases(spark, str(tmp_path / "p.csv"))
    assert [tuple(r) for r in rows.collect()] == [(1, 10, 20)] and rejects.count() == 2
    (tmp_path / "q.csv").write_text("period,frame_start,frame_start,frame_end\n1,10,10,20\n")
    with pytest.raises(ValueError, match="frame_start"):
        files.read_phases(spark, str(tmp_path / "q.csv"))
    (tmp_path / "r.csv").write_text("period,frame_start,frame_end\n1,10\n")
    with pytest.raises(Exception):
        files.read_phases(spark, str(tmp_path / "r.csv"))[0].collect()
    (tmp_path / "m.json").write_text(json.dumps({"id": 1}))
    assert files.read_metadata(spark, str(tmp_path / "m.json")).first().id == 1
    with pytest.raises(Exception, match="too large"):
        files.read_metadata(spark, str(tmp_path / "m.json"), max_bytes=3).collect()


def test_archives(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for i in range(6):
        (tmp_path / "in" / ("sub" if i % 2 else ".") / f"f{i}.bin").write_bytes(bytes([i]) * 1000 * (i + 1))
    members = files.pack(spark, str(tmp_path / "in"), str(tmp_path / "out"), part_bytes=4000)
    assert members.count() == 6 and members.select("part").distinct().count() > 1
    back = {r.path.rsplit("/", 1)[1]: (bytes(r.content), r.intact) for r in files.unpack(spark, str(tmp_path / "out")).collect()}
    assert back == {f"f{i}.bin": (bytes([i]) * 1000 * (i + 1), True) for i in range(6)}


def test_sealed_tables_logs_and_receipts(spark, tmp_path):
    rows = spark.createDataFrame([(m, i, f"row {m} {i}") for m in (1, 2) for i in range(5)], "m int, i int, t string")
    manifest = files.write_sealed(rows, ["m"], "i", "t", str(tmp_path / "s"))
    assert {r.m: r.n_rows for r in manifest.collect()} == {1: 5, 2: 5}
    assert files.seal_problems(spark, str(tmp_path / "s"), ["m"], "i", "t").count() == 0
    files.write_once(spark.read.parquet(str(tmp_path / "s")).withColumn("t", F.when((F.col("m") == 2) & (F.col("i") == 3), "new").otherwise(F.col("t"))), str(tmp_path / "u"))
    files.write_once(manifest, str(tmp_path / "u.manifest"))
    assert [(r.m, r.status) for r in files.seal_problems(spark, str(tmp_path / "u"), ["m"], "i", "t").collect()] == [(2, "different")]
    for i in range(3):
        files.append_log(spark.createDataFrame([(i,)], "i int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    digest = files.write_receipt(spark, str(tmp_path / "r"), run="a", input="b")
    assert digest == files.write_receipt(spark, str(tmp_path / "r2"), input="b", run="a")
    assert json.loads(files.report(rows.orderBy("m", "i"), 1)) == [{"m": 1, "i": 0, "t": "row 1 0"}]
    # names that are equal in normal form
    names = spark.createDataFrame([("é",), ("é",), ("e",)], "path string").select(audit.normal_form("path").alias("path"))
    assert audit.duplicates(names, ["path"]).count() == 1


def test_settings(spark):
    assert Params.of("history = 5\nball_fraction = 1\n") == Params(history=5, ball_fraction=1)
    for text in ("unknown = 1", 'history = "5"', "history = true", "history = 2.5"):
        with pytest.raises(ValueError):
            Params.of(text)


def test_a_player_without_roster_entry_fails(spark):
    s = spark.createDataFrame([(1, 1, 10, [(5, 1.0, 2.0, True)])], "match_id long, period int, source_frame long, players array<struct<player_id:long,x_m:double,y_m:double,is_detected:boolean>>")
    roster = spark.createDataFrame([(1, 6, 10, "home team")], "match_id long, player_id long, team_id long, `group` string")
    assert samples.player_rows(s, roster).first()["team_id"] is None
    with pytest.raises(Exception, match="no roster entry"):
        samples.player_rows(s, roster, strict=True).collect()
