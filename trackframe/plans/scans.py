"""Queries over ordered files, large documents, hash trees and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import eligibility, sequences, trees
from ..sources import documents, files, streams
from ..sources.shared import fresh
from ..streaming import timed
from .fixtures import table
from .queries import query

#: Small, so that the tables give many blocks and levels.
BLOCK, FAN_OUT = 64 << 10, 16


def tree_sql(leaves: str, levels: int = 8, fan_out: int = FAN_OUT) -> str:
    """CTEs l0 .. of a tree over ``leaves`` (ordinal, text), and nodes (level, node, digest, n) of its levels up to the root."""
    out = [f"l0 AS MATERIALIZED (SELECT ordinal AS node, sha256(text) AS digest, 1 AS n FROM {leaves})"]
    every = ["SELECT 0 AS level, * FROM l0"]
    for i in range(1, levels):
        out.append(f"l{i} AS MATERIALIZED (SELECT node // {fan_out} AS node, sha256(string_agg(digest, '' ORDER BY node)) AS digest, sum(n)::BIGINT AS n FROM l{i - 1} WHERE (SELECT count(*) FROM l{i - 1}) > 1 GROUP BY ALL)")
        every.append(f"SELECT {i}, * FROM l{i}")
    return ",\n".join(out) + ",\nnodes AS (" + " UNION ALL ".join(every) + ")"


# --- ordered lines ---

_FRAME = "'{\"frame\":' || event_id % 50 || ',\"id\":' || event_id || ',\"user\":' || user_id || ',\"type\":\"' || event_type || '\"}'"


@query(f"""WITH t AS (SELECT event_id, event_id % 50 AS frame, {_FRAME} || CASE WHEN event_id % 7 = 0 THEN chr(13) ELSE '' END AS line, row_number() OVER (ORDER BY event_id) - 1 AS ordinal FROM events)
SELECT event_id, ordinal, coalesce(sum(strlen(line) + 1) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", (strlen(line) + 1)::BIGINT AS n_bytes,
  CASE WHEN ordinal = 0 THEN 'first' WHEN frame = lag(frame) OVER (ORDER BY ordinal) THEN 'duplicate' WHEN frame < lag(frame) OVER (ORDER BY ordinal) THEN 'nonmonotonic' ELSE 'ok' END AS frame_status FROM t""")
def ordered_line_scan(spark, d):
    """Events as lines of files, some ended by a carriage return too; read back in blocks, with the order check on the ordinals of the scan."""
    end = F.when(F.col("event_id") % 7 == 0, "\r").otherwise("")
    line = F.concat(F.format_string('{"frame":%d,"id":%d,"user":%d,"type":"%s"}', F.col("event_id") % 50, "event_id", "user_id", "event_type"), end)
    path = fresh(spark, "lines")
    table(spark, d, "events").orderBy("event_id").select(line.alias("value")).write.text(path)
    rows = streams.lines(spark, streams.streams(path, together=True), BLOCK)
    r = F.from_json(F.col("value").cast("string"), "frame long, id long")
    rows = rows.select("stream", "ordinal", "offset", "n_bytes", r["frame"].alias("frame"), r["id"].alias("event_id"))
    # each run of ordinals is checked by itself, the first row of a run against the last one of the run before
    return ordered_status(rows).select("event_id", "ordinal", "offset", "n_bytes", "frame_status")


def ordered_status(rows, run: int = 1 << 16):
    """sequences.frame_order over a scan's ordinals, in runs that tasks share: a run's last row is also the row before the next run."""
    run_of = F.floor(F.col("ordinal") / run)
    both = rows.withColumns({"__run": run_of, "__real": F.lit(True)})
    over = rows.where((F.col("ordinal") + 1) % run == 0).withColumns({"__run": run_of + 1, "__real": F.lit(False)})
    return sequences.frame_order(both.unionByName(over), ["stream", "__run"], "ordinal", "frame").where("__real").drop("__run", "__real")


# --- one large document ---


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey, o_custkey, 'a"],[' || o_orderstatus || chr(92) || '}' AS label FROM orders""")
def document_elements(spark, d):
    """All orders as an array of one JSON document, read back in blocks."""
    o = table(spark, d, "orders")
    label = F.concat(F.lit('a"],['), "o_orderstatus", F.lit("\\}"))
    text = F.to_json(F.struct("o_orderkey", F.struct("o_custkey", label.alias("label")).alias("x"), F.array(F.struct("o_custkey")).alias("orders")))
    first = o.agg(F.min("o_orderkey").alias("k")).scalar()
    comma = F.when(F.col("o_orderkey") == first, "").otherwise(",")
    ends = spark.createDataFrame([(-1, 0, '{"n": [1, 2], "o": {"orders": [3]}, "orders": ['), (1, 0, '], "end": [[]]}')], "part int, key long, value string")
    path = fresh(spark, "document")
    o.select(F.lit(0).alias("part"), F.col("o_orderkey").alias("key"), F.concat(comma, text).alias("value")).unionByName(ends).orderBy("part", "key").select("value").write.text(path)
    e = documents.elements(spark, streams.streams(path, together=True), "orders", BLOCK)
    r = F.from_json("value", "o_orderkey long, x struct<o_custkey:long,label:string>")
    return e.select("ordinal", r["o_orderkey"].alias("o_orderkey"), r["x"]["o_custkey"].alias("o_custkey"), r["x"]["label"].alias("label"))


# --- hash trees ---

_ROW = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, {p})"
_ORDERS = "t AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, " + _ROW.format(p="o_orderpriority") + " AS text FROM orders)"


def _order_rows(spark, d, priority="o_orderpriority"):
    return trees.ordinals(table(spark, d, "orders"), ["o_orderkey"]).withColumn("text", F.expr(_ROW.format(p=priority)))


@query(f"WITH {_ORDERS}, {tree_sql('t')} SELECT level, node, digest, n FROM nodes")
def row_tree(spark, d):
    return trees.tree(_order_rows(spark, d), "ordinal", F.col("text"), FAN_OUT)


_OTHER = "CASE WHEN o_orderkey % 97 = 5 THEN 'changed' ELSE o_orderpriority END"


@query(f"""WITH a AS (SELECT o_orderkey, {_ROW.format(p='o_orderpriority')} AS x, {_ROW.format(p=_OTHER)} AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders)
SELECT ordinal, sha256(x) AS "left", CASE WHEN o_orderkey < (SELECT max(o_orderkey) FROM orders) THEN sha256(y) END AS "right" FROM a WHERE x <> y OR o_orderkey = (SELECT max(o_orderkey) FROM orders)""")
def tree_differences(spark, d):
    """Two artifacts of orders, one with other texts here and there and without its last row."""
    last = table(spark, d, "orders").agg(F.max("o_orderkey").alias("k")).scalar()
    left = _order_rows(spark, d)
    right = _order_rows(spark, d, _OTHER).where(F.col("o_orderkey") < last)
    a, b = (trees.tree(x, "ordinal", F.col("text"), FAN_OUT) for x in (left, right))
    return trees.differing(a, b, FAN_OUT)


# --- snapshots ---

_LINES = """u AS (SELECT 0 AS kind, c_custkey AS key, '{"c":' || c_custkey || ',"n":' || c_nationkey || '}' AS text FROM customer
UNION ALL SELECT 1, s_suppkey, '{"s":"' || s_name || '","n":' || s_nationkey || '}' FROM supplier),
t AS (SELECT *, row_number() OVER (ORDER BY kind, key) - 1 AS ordinal FROM u)"""


@query(f"""WITH {_LINES}, {tree_sql('t')}
SELECT ordinal, kind, key, coalesce(sum(strlen(text) + 1) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", (strlen(text) + 1)::BIGINT AS n_bytes, text,
  (SELECT count(*) FROM t) AS n_rows, (SELECT sum(strlen(text) + 1)::BIGINT FROM t) AS total_bytes, (SELECT digest FROM nodes ORDER BY level DESC LIMIT 1) AS digest FROM t""")
def snapshot_rows(spark, d):
    """Customers and suppliers as one ordered snapshot; each row's text is read back from the lines at the index's offset."""
    c = table(spark, d, "customer").select(F.lit(0).alias("kind"), F.col("c_custkey").alias("key"), F.format_string('{"c":%d,"n":%d}', "c_custkey", "c_nationkey").alias("t"))
    s = table(spark, d, "supplier").select(F.lit(1).alias("kind"), F.col("s_suppkey").alias("key"), F.format_string('{"s":"%s","n":%d}', "s_name", "s_nationkey").alias("t"))
    path = fresh(spark, "snapshot")
    header = trees.snapshot([c, s], ["kind", "key"], F.col("t"), path, 1 << 40, FAN_OUT)
    held = streams.lines(spark, streams.streams(path + "/lines", together=True), BLOCK).select("offset", F.col("value").cast("string").alias("text"))
    rows = spark.read.parquet(path + "/index").join(held, "offset")
    head = header.select("n_rows", F.col("n_bytes").alias("total_bytes"), "digest")
    return rows.select("ordinal", "kind", "key", "offset", "n_bytes", "text").join(F.broadcast(head))


# --- streams over files written from the tables ---


def _streamed(spark, files, schema, build, sink):
    """Runs a stream over all files of a folder to its end."""
    key, value = timed.STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        q = sink(build(spark.readStream.schema(schema).parquet(files))).option("checkpointLocation", fresh(spark, "stream")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@query("""WITH f AS (SELECT user_id % 10 AS match_id, 2 * event_id AS frame FROM events WHERE event_type <> 'error')
SELECT match_id, frame AS origin_frame, count(*) OVER w AS n_support, count(*) OVER w = 41 AS complete FROM f WINDOW w AS (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 50 PRECEDING AND 30 FOLLOWING)""")
def timed_windows(spark, d):
    """Windows of a stream, ended by timers; a last frame of no match drives the clock past all of them."""
    e = table(spark, d, "events").where("event_type <> 'error'").select((F.col("user_id") % 10).alias("match_id"), (F.col("event_id") * 2).alias("frame"))
    last = e.agg(F.lit(-1).cast("long").alias("match_id"), (F.coalesce(F.max("frame"), F.lit(0)) + 100_000).alias("frame"))
    files, out = fresh(spark, "frames"), fresh(spark, "windows")
    e.unionByName(last).write.parquet(files)
    _streamed(spark, files, e.schema, timed.support_timed, lambda r: r.writeStream.format("parquet").option("path", out).outputMode("append"))
    return spark.read.schema(timed.OUT).parquet(out).where("match_id >= 0").withColumn("n_support", F.col("n_support").cast("long"))


@query("""SELECT l_orderkey % 20 AS match_id, l_linestatus AS scene_id, count(*) AS candidates, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS passing, grouping_id(l_orderkey % 20, l_linestatus)::BIGINT AS depth
FROM lineitem GROUP BY ROLLUP (l_orderkey % 20, l_linestatus)""")
def streamed_census(spark, d):
    """A census kept by a stream in update mode, rolled up."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 20).alias("match_id"), F.col("l_linestatus").alias("scene_id"), (F.col("l_returnflag") != "R").alias("mask"))
    levels, counters = ["match_id", "scene_id"], {"candidates": F.count("*"), "passing": F.count_if("mask")}
    files, folder = fresh(spark, "points"), fresh(spark, "census")
    li.repartition(3).write.parquet(files)
    sink = lambda r: r.writeStream.outputMode("update").foreachBatch(timed.fold_updates(spark, folder, levels, list(counters)))
    _streamed(spark, files, li.schema, lambda s: timed.census_stream(s, levels, counters), sink)
    return timed.rolled_up(timed.newest(spark, folder, levels), levels, list(counters))


# --- strict readers over files written from the tables ---

_GOOD = """'{"frame":' || event_id || ',"timestamp":"00:00:0' || event_id % 10 || '.00","period":1,"ball_data":null,"possession":{"group":null,"player_id":' || user_id || '},"image_corners_projection":null,"player_data":[{"player_id":' || user_id || ',"x":1.5,"y":null,"is_detected":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}]}'"""
_LINE = f"CASE event_id % 40 WHEN 1 THEN '' WHEN 2 THEN '{{}}' WHEN 3 THEN replace({_GOOD}, '\"period\":1', '\"period\":1,\"period\":2') WHEN 4 THEN replace({_GOOD}, '\"x\":1.5', '\"x\":true') WHEN 5 THEN replace({_GOOD}, '\"frame\":', '\"frame\":1e0') WHEN 6 THEN replace({_GOOD}, '\"x\":1.5', '\"x\":NaN') WHEN 7 THEN {_GOOD} || repeat(' ', 2000) WHEN 8 THEN 'no' ELSE {_GOOD} END"


@query("""WITH t AS (SELECT event_id, user_id, user_id // 10 AS match_id, row_number() OVER (PARTITION BY user_id // 10 ORDER BY event_id) - 1 AS ordinal,
  CASE event_id % 40 WHEN 1 THEN 'blank' WHEN 2 THEN 'keys' WHEN 3 THEN 'keys' WHEN 4 THEN 'type' WHEN 5 THEN 'type' WHEN 6 THEN 'keys' WHEN 7 THEN 'too_long' WHEN 8 THEN 'keys' END AS problem FROM events)
SELECT match_id, ordinal, problem, CASE WHEN problem IS NULL THEN event_id END AS frame, CASE WHEN problem IS NULL THEN user_id END AS player_id, CASE WHEN problem IS NULL THEN event_id % 2 = 0 END AS is_detected FROM t""")
def tracking_files(spark, d):
    """Frames written as lines, some of them broken, a file a match, and read strictly with their ordinals; the files stay as they were."""
    path = fresh(spark, "tracking")
    e = table(spark, d, "events").select("event_id", F.floor(F.col("user_id") / 10).alias("match"), F.expr(_LINE).alias("value"))
    e.repartition("match").sortWithinPartitions("match", "event_id").select("value", "match").write.partitionBy("match").text(path)
    before = files.identity(spark, path)
    lines = files.tracking_lines(spark, path, max_length=1000, block=BLOCK)
    match = F.regexp_extract("file", r"match=(\d+)/", 1).cast("long").alias("match_id")
    both = lines.select(match, "ordinal", "problem", "r.frame", F.col("r.possession.player_id").alias("player_id"), F.col("r.player_data")[0]["is_detected"].alias("is_detected"))
    files.unchanged(spark, path, before)
    return both


@query("""WITH t AS (SELECT o_orderkey AS k, year(o_orderdate) AS period, o_custkey AS a, o_custkey + o_orderkey % 90 - 5 AS b FROM orders)
SELECT k AS source, period::INTEGER AS period, CASE WHEN k % 10 <> 3 THEN a END AS frame_start, b AS frame_end, k % 10 <> 3 AND b >= 0 AND a < b AS accepted FROM t""")
def phase_files(spark, d):
    """Phases written as CSV and read back strictly: whole numbers, start before end."""
    o = table(spark, d, "orders")
    start = F.when(F.col("o_orderkey") % 10 == 3, "x").otherwise(F.col("o_custkey").cast("string"))
    rows = o.select(F.col("o_orderkey").alias("source"), F.year("o_orderdate").alias("period"), start.alias("frame_start"), (F.col("o_custkey") + F.col("o_orderkey") % 90 - 5).alias("frame_end"))
    path = fresh(spark, "phases")
    rows.write.option("header", True).csv(path)
    good, bad = files.read_phases(spark, path, keep=("source",))
    number = lambda c: F.col(c).try_cast("long").alias(c)
    bad = bad.select(number("source"), F.col("period").cast("int").alias("period"), number("frame_start"), number("frame_end"), F.lit(False).alias("accepted"))
    return good.select(number("source"), "period", "frame_start", "frame_end", F.lit(True).alias("accepted")).unionByName(bad)


# --- scalar forms ---


@query("""WITH t AS (SELECT event_id, value, event_id % 5 AS k, event_type FROM events)
SELECT event_id, round(value / 100 * 52.5::DOUBLE, 6) AS x, round(value / 100 * 34.0::DOUBLE, 6) AS y, round(CASE WHEN k < 2 THEN value + k ELSE value END, 6) AS p, CASE WHEN k IN (1, 2) THEN k END::INTEGER AS period,
  CASE WHEN k = 0 THEN event_type ELSE substr(repeat(event_type, k), 1, 12) || CASE WHEN length(event_type) * k > 12 THEN '...' ELSE '' END END AS note, CASE WHEN k = 4 THEN sha256(event_type) END AS oid, CASE WHEN k = 4 THEN event_id END AS size FROM t""")
def scalar_forms(spark, d):
    """De-normalised coordinates, reconstructed predictions, period names, bounded notes, pointer texts."""
    k, v = F.col("event_id") % 5, F.col("value")
    x, y = S.physical(v / 100, v / 100)
    name = F.when(k == 0, "period_0").when(k == 3, "half_3").when(k == 4, "period_x").otherwise(F.concat(F.lit("period_"), k.cast("string")))
    note = F.when(k == 0, F.col("event_type")).otherwise(F.expr("repeat(event_type, int(event_id % 5))"))
    oid = F.sha2("event_type", 256)
    pointer = F.concat(F.when(k == 4, "version https://git-lfs.github.com/spec/v1\n").otherwise("version 2\n"), F.lit("oid sha256:"), oid, F.lit("\nsize "), F.col("event_id").cast("string"), F.lit("\n"))
    p = S.pointer_fields(pointer)
    form = F.when(k < 2, "origin_relative_displacement").otherwise("absolute")
    return table(spark, d, "events").select(
        "event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(S.reconstructed(v, k, form), 6).alias("p"), S.period_number(name).alias("period"),
        F.when(k == 0, F.col("event_type")).otherwise(S.bounded(note, 12)).alias("note"), p["oid"].alias("oid"), p["size"].alias("size"),
    )


@query("""WITH c AS (SELECT l_orderkey AS k, l_linestatus AS s, CASE WHEN l_linenumber = 1 THEN -1 ELSE l_linenumber END AS i, unnest([l_returnflag || '_CODE', CASE WHEN l_partkey % 3 = 0 THEN 'A_CODE' ELSE 'Z_CODE' END]) AS code FROM lineitem),
u AS (SELECT DISTINCT k, s, i, code FROM c)
SELECT k AS window_id, s AS side, string_agg(i || ':' || code, ' ' ORDER BY i, code) AS issues, arg_min(i || ':' || code, (i, code)) AS first_issue, arg_max(i || ':' || code, (i, code)) AS last_issue FROM u GROUP BY ALL""")
def issue_order(spark, d):
    """Issues of a window: once each, those of no sample first, then by sample and code; the first and the last one."""
    li = table(spark, d, "lineitem")
    index = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))
    codes = F.array(F.concat("l_returnflag", F.lit("_CODE")), F.when(F.col("l_partkey") % 3 == 0, "A_CODE").otherwise("Z_CODE"))
    s = li.select(F.col("l_orderkey").alias("window_id"), F.col("l_linestatus").alias("side"), index.alias("idx"), codes.alias("codes"))
    i = eligibility.issues(s, ["window_id", "side"], [F.col("codes")])
    text = F.transform("issues", lambda x: F.concat_ws(":", x["sample_index"].cast("string"), x["code"]))
    return i.select("window_id", "side", F.array_join(text, " ").alias("issues"), text[0].alias("first_issue"), F.element_at(text, -1).alias("last_issue"))
