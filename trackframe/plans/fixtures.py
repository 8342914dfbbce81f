"""Projections of the driver's tables onto the engine's relations, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: SQL of the same projections, as common table expressions.
SQL = {
    "sp": """sp AS (SELECT user_id AS player_id, user_id % 10 AS match_id, (user_id // 10) % 2 AS team, ts, event_id, event_type,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS x, (event_id % 68)::DOUBLE AS y,
      event_type <> 'view' AS is_detected FROM events)""",
    "gp": "gp AS (SELECT *, 2 * idx AS frame FROM sp WHERE event_type <> 'error')",
    "scp": """scp AS (SELECT l_orderkey AS window_id, l_orderkey % 20 AS match_id, l_linestatus AS scene_id,
      row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate) AS step,
      l_extendedprice / 1000 AS truth_x, l_quantity::DOUBLE AS truth_y, l_extendedprice / 1000 * (1 - l_discount) AS pred_x, l_quantity * (1 - l_discount) AS pred_y,
      l_returnflag <> 'R' AS mask, l_linenumber FROM lineitem)""",
    "err": """err AS (SELECT *, step = max(step) OVER (PARTITION BY window_id, scene_id) AS is_final,
      CASE WHEN mask THEN sqrt((pred_x - truth_x) ** 2 + (pred_y - truth_y) ** 2) END AS distance,
      CASE WHEN mask THEN (pred_x - truth_x) ** 2 + (pred_y - truth_y) ** 2 END AS squared FROM scp)""",
    "scene": """scene AS (SELECT match_id, window_id, scene_id, count(distance) AS n_points, count(CASE WHEN is_final THEN distance END) AS n_finals,
      CASE WHEN count(CASE WHEN is_final THEN distance END) > 0 THEN avg(distance) END AS ade,
      avg(CASE WHEN is_final THEN distance END) AS fde,
      CASE WHEN count(CASE WHEN is_final THEN distance END) > 0 THEN sqrt(sum(squared) / (2 * count(squared))) END AS rmse FROM err GROUP BY ALL)""",
    "win": "win AS (SELECT match_id, window_id, avg(ade) AS ade, avg(fde) AS fde, avg(rmse) AS rmse, count(ade) AS n_scored, count(*) AS n_members FROM scene GROUP BY ALL)",
    "mat": "mat AS (SELECT match_id, avg(ade) AS ade, avg(fde) AS fde, avg(rmse) AS rmse, count(ade) AS n_scored, count(*) AS n_members FROM win GROUP BY ALL)",
    "res": """res AS (SELECT l_returnflag AS regime, l_linestatus AS representation, l_linenumber % 3 AS seed, l_orderkey % 4 AS match_id,
      avg(l_extendedprice / 1000) AS value, count(*) AS windows FROM lineitem GROUP BY ALL)""",
    "ph": """ph AS (SELECT o_custkey AS k, o_orderkey AS id, (epoch(o_orderdate) // 86400)::BIGINT AS s, (epoch(o_orderdate) // 86400)::BIGINT + 30 AS e, year(o_orderdate) AS period FROM orders)""",
    "tg": "tg AS (SELECT vec_id, unnest(embedding)::DOUBLE AS truth, generate_subscripts(embedding, 1) AS target FROM embeddings)",
    "hist": """hist AS (SELECT o.player_id, o.match_id, o.idx AS origin, s.idx - o.idx AS slot, CASE WHEN s.event_type <> 'signup' THEN s.x END AS x, CASE WHEN s.event_type <> 'signup' THEN s.y END AS y
      FROM sp o JOIN (SELECT player_id, idx, event_type, x, y FROM sp UNION ALL SELECT player_id, -k, 'signup', NULL, NULL FROM (SELECT DISTINCT player_id FROM sp), (SELECT unnest(range(1, 6)) AS k)) s
      ON s.player_id = o.player_id AND s.idx BETWEEN o.idx - 5 AND o.idx)""",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sample_players(spark: SparkSession, d: str) -> DataFrame:
    # one shuffle serves the numbering and what is asked of a player's own samples
    e = table(spark, d, "events")
    e = e.repartition(parts(e), "user_id")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("player_id"), (F.col("user_id") % 10).alias("match_id"), (F.floor(F.col("user_id") / 10) % 2).alias("team"), "ts", "event_id", "event_type",
        idx.cast("long").alias("idx"), F.col("value").alias("x"), (F.col("event_id") % 68).cast("double").alias("y"), (F.col("event_type") != "view").alias("is_detected"),
    )


def gappy_players(spark: SparkSession, d: str) -> DataFrame:
    return sample_players(spark, d).where("event_type <> 'error'").withColumn("frame", F.col("idx") * 2)


def parts(df: DataFrame, rows: int = 500_000) -> int:
    """How many partitions hold about so many rows each, one a core at least: what a task holds doesn't grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def scene_points(spark: SparkSession, d: str) -> DataFrame:
    # one shuffle serves the numbering, the scenes and the windows: all keep the order key
    li = table(spark, d, "lineitem")
    li = li.repartition(parts(li), "l_orderkey")
    order = Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    keep = 1 - F.col("l_discount")
    return li.select(
        F.col("l_orderkey").alias("window_id"), (F.col("l_orderkey") % 20).alias("match_id"), F.col("l_linestatus").alias("scene_id"), F.row_number().over(order).alias("step"),
        (F.col("l_extendedprice") / 1000).alias("truth_x"), F.col("l_quantity").cast("double").alias("truth_y"), (F.col("l_extendedprice") / 1000 * keep).alias("pred_x"), (F.col("l_quantity") * keep).alias("pred_y"),
        (F.col("l_returnflag") != "R").alias("mask"), "l_linenumber",
    )


def scored_points(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scoring import with_errors

    last = F.max("step").over(Window.partitionBy("window_id", "scene_id"))
    return with_errors(scene_points(spark, d).withColumn("is_final", F.col("step") == last), mask="mask")


def results(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    keys = [F.col("l_returnflag").alias("regime"), F.col("l_linestatus").alias("representation"), (F.col("l_linenumber") % 3).alias("seed"), (F.col("l_orderkey") % 4).alias("match_id")]
    return li.groupBy(*keys).agg(F.avg(F.col("l_extendedprice") / 1000).alias("value"), F.count("*").alias("windows"))


def phases(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")).cast("long")
    return o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), day.alias("s"), (day + 30).alias("e"), F.year("o_orderdate").alias("period"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "truth"))
    return e.select("vec_id", (F.col("i") + 1).alias("target"), F.col("truth").cast("double"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """The six slots up to each origin: every sample of a player is one. Slots before a player's first sample are there, without a position."""
    p = sample_players(spark, d).withColumn("last", F.count("*").over(Window.partitionBy("player_id")) - 1)
    long = lambda x: F.lit(x).cast("long")
    own = F.transform(F.sequence("idx", F.least(F.col("idx") + 5, "last")), lambda o: F.struct(o.alias("origin"), (F.col("idx") - o).alias("slot"), F.lit(True).alias("real")))
    before = F.flatten(F.transform(F.sequence(long(0), F.least(long(4), F.col("last"))), lambda o: F.transform(F.sequence(long(-5), -o - 1), lambda s: F.struct(o.alias("origin"), s.alias("slot"), F.lit(False).alias("real")))))
    p = p.withColumn("s", F.explode(F.when(F.col("idx") == 0, F.concat(own, before)).otherwise(own)))
    known = F.col("s.real") & (F.col("event_type") != "signup")
    return p.select("player_id", "match_id", "s.origin", "s.slot", F.when(known, F.col("x")).alias("x"), F.when(known, F.col("y")).alias("y"))
