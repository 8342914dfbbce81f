"""Event-time windows and the streamed census: stopped after each trigger and started again, they give the batch result once."""

import random

import pytest
from pyspark.sql import functions as F

from trackframe.operators import sequences, stats
from trackframe.streaming import timed


@pytest.fixture
def state_store(spark):
    key, value = timed.STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def run(spark, folder, checkpoint, build, schema, sink):
    """One start of the stream: what has come since the last one, then it stops."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    q = sink(build(s)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_windows_end_by_timers_and_restart(spark, tmp_path, state_store):
    r = random.Random(3)
    frames = [(m, f) for m in (1, 2) for f in range(0, 160, 2) if not (m == 1 and f in (40, 42, 90)) and not (m == 2 and 60 <= f < 100)]
    arrive = sorted(frames, key=lambda x: x[1] + r.randint(0, 8))  # out of order by under a second
    arrive += r.sample(arrive[-8:], 3)  # repeated ones
    cuts = [arrive[i : i + 40] for i in range(0, len(arrive), 40)] + [[(9, 100_000)], [(9, 100_002)]]  # another match drives the clock on
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, "match_id long, frame long").coalesce(1).write.mode("append").json(f"{src}")
        run(spark, str(src), f"{tmp_path}/ck", lambda s: timed.support_timed(s, 5, 3), "match_id long, frame long", lambda d: d.writeStream.format("parquet").option("path", str(out)).outputMode("append"))
    got = sorted(map(tuple, spark.read.parquet(str(out)).where("match_id < 9").collect()))
    batch = sequences.support(spark.createDataFrame(frames, "match_id long, frame long"), ["match_id"], "frame", 5, 3)
    want = sorted((x.match_id, x.frame, x.n_support, x.complete) for x in batch.collect())
    assert got == want and len(got) == len(frames)


def test_census_of_any_cut(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.choice("ab"), r.randint(1, 3), r.random() < 0.6) for _ in range(90)]
    schema, levels, counters = "role string, match_id long, ok boolean", ["role", "match_id"], {"candidates": F.count("*"), "passing": F.count_if("ok")}
    src, folder = tmp_path / "in", f"{tmp_path}/census"
    src.mkdir()
    for a, b in ((0, 7), (7, 50), (50, 90)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").json(str(src))
        sink = lambda d: d.writeStream.outputMode("update").foreachBatch(timed.fold_updates(spark, folder, levels, list(counters)))
        run(spark, str(src), f"{tmp_path}/ck", lambda s: timed.census_stream(s, levels, counters), schema, sink)
        seen = spark.createDataFrame(rows[:b], schema)
        census = timed.newest(spark, folder, levels)
        got = sorted(map(str, timed.rolled_up(census, levels, list(counters)).collect()))
        assert got == sorted(map(str, stats.census(seen, levels, counters).collect()))
        assert census.count() == seen.select(*levels).distinct().count()  # a row a key
    state = spark.read.format("statestore").load(f"{tmp_path}/ck")
    assert state.count() == len({x[:2] for x in rows})
    # a trigger that runs again changes nothing
    before = sorted(map(str, timed.newest(spark, folder, levels).collect()))
    last = spark.read.parquet(f"{folder}/updates/batch=2").drop("__batch", "batch")
    timed.fold_updates(spark, folder, levels, list(counters))(spark.createDataFrame(last.collect(), last.schema), 2)
    assert sorted(map(str, timed.newest(spark, folder, levels).collect())) == before
    # a folded table takes the place of what was before it
    timed.fold_updates(spark, folder, levels, list(counters))(spark.createDataFrame([("a", 1, 500, 400)], last.schema), 63)
    top = {(x.role, x.match_id): x.candidates for x in timed.newest(spark, folder, levels).collect()}
    assert top["a", 1] == 500 and len(top) == len(before)
    assert spark.read.parquet(f"{folder}/folded/upto=63").count() == len(before)
