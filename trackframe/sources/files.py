"""Strict readers of tracking streams, metadata and phases; file inventories; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import closed_keys, document_digest
from ..operators.audit import normal_form
from ..operators.constraints import reconciled
from ..operators.digests import record_stream
from . import streams

FRAME_DDL = (
    "frame bigint, timestamp string, period int, ball_data struct<x:double,y:double,z:double,is_detected:boolean>, "
    "possession struct<group:string,player_id:bigint>, image_corners_projection string, "
    "player_data array<struct<player_id:bigint,x:double,y:double,is_detected:boolean>>"
)
METADATA_DDL = (
    "id bigint, home_team struct<id:bigint>, away_team struct<id:bigint>, pitch_length double, pitch_width double, "
    "match_periods array<struct<period:int,start_frame:bigint,end_frame:bigint>>, "
    "players array<struct<id:bigint,team_id:bigint,playing_time:struct<by_period:array<struct<name:string,start_frame:bigint,end_frame:bigint>>>>>"
)
_NUMBER, _WHOLE = r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)|VOID)", r"(BIGINT|VOID)"
#: What a frame's fields may be, as types of variants. Objects list their keys in order.
FRAME_TYPES = {
    "frame": "BIGINT",
    "timestamp": "STRING|VOID",
    "period": _WHOLE,
    "ball_data": rf"VOID|OBJECT<is_detected: (BOOLEAN|VOID), x: {_NUMBER}, y: {_NUMBER}, z: {_NUMBER}>",
    "possession": rf"VOID|OBJECT<group: (STRING|VOID), player_id: {_WHOLE}>",
    "player_data": rf"ARRAY<VOID>|ARRAY<OBJECT<is_detected: (BOOLEAN|VOID), player_id: BIGINT, x: {_NUMBER}, y: {_NUMBER}>>",
}
FRAME_KEYS = ("frame", "timestamp", "period", "ball_data", "possession", "image_corners_projection", "player_data")


def read_tracking(spark: SparkSession, path: str, max_length: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Line-delimited frames as (rows, rejects). A line is rejected that is blank, too_long, not one JSON object of exactly the
    frame's keys, without NaN and infinities (keys), has equal keys in an inner object (json), or holds a value of another type, or
    an inner object with other keys (type).

    Row order is not kept by a DataFrame: ``frame_order`` checks need read_tracking_ordered()."""
    return _split(_frames(spark.read.text(path).withColumn("file", F.col("_metadata.file_path")), max_length), ["file"])


def read_tracking_ordered(spark: SparkSession, path: str, max_length: int = 1 << 20, block: int = streams.BLOCK) -> tuple[DataFrame, DataFrame]:
    """read_tracking() with each line's place in its file: ordinal (from 0, rejects counted) and offset (of its first byte), however the file is cut
    into blocks. Order checks run on the ordinal; a line that is too long isn't held."""
    return _split(tracking_lines(spark, path, max_length, block), ["file", "ordinal", "offset"])


def tracking_lines(spark: SparkSession, path: str, max_length: int = 1 << 20, block: int = streams.BLOCK) -> DataFrame:
    """The lines of read_tracking_ordered(), those it accepts and those it rejects, where both are wanted of one pass: file, ordinal, offset, value,
    problem (null: accepted) and r, the frame of an accepted line."""
    lines = streams.lines(spark, streams.streams(path), block, max_length).withColumnRenamed("stream", "file")
    lines = lines.withColumn("__long", F.col("value").isNull())
    text = F.when(F.is_valid_utf8("value"), F.col("value").cast("string"))
    return _frames(lines.withColumn("value", F.coalesce(text, F.lit("?"))), max_length, F.col("__long")).select("file", "ordinal", "offset", "value", "problem", "r")


def _frames(lines: DataFrame, max_length: int, long=None) -> DataFrame:
    lines = lines.withColumn("v", F.try_parse_json("value"))
    typed = F.lit(True)
    for name, pattern in FRAME_TYPES.items():
        typed &= F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")).rlike(f"^({pattern})$"), F.lit(False))
    problem = (
        F.when(F.trim("value") == "", "blank")
        .when((F.length("value") > max_length) if long is None else long | (F.length("value") > max_length), "too_long")
        .when(~closed_keys("value", FRAME_KEYS), "keys")
        .when(F.col("v").isNull(), "json")
        .when(~typed, "type")
    )
    return lines.withColumn("problem", problem).withColumn("r", F.when(F.col("problem").isNull(), F.from_json("value", FRAME_DDL)))


def _split(parsed: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    return parsed.where("problem is null").select(*keep, "r.*"), parsed.where("problem is not null").select(*keep, "value", "problem")


def identity(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of files below a path, and a fingerprint of their names, sizes and times: a read whose input is unchanged has the same before and after."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    n, x = f.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return n, int(x or 0)


def unchanged(spark: SparkSession, path: str, before: tuple[int, int]) -> None:
    """Fails if the files below a path aren't those of identity() before the read."""
    if identity(spark, path) != before:
        raise ValueError(f"{path} changed while it was read")


def scan_statistics(frames: DataFrame) -> DataFrame:
    """One row: frames, even ones (the 5 Hz grid), players."""
    return frames.agg(F.count("*").alias("rows"), F.count_if(F.col("frame") % 2 == 0).alias("even_rows"), F.sum(F.size("player_data")).alias("players"))


def read_metadata(spark: SparkSession, path: str, max_bytes: int = 16 << 20) -> DataFrame:
    """Match documents, one a file; a file over max_bytes fails the read."""
    m = spark.read.schema(METADATA_DDL).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("__size", F.col("_metadata.file_size"))
    fits = F.when(F.col("__size") > max_bytes, F.raise_error(F.lit("a document is too large")).cast("boolean")).otherwise(True)
    return m.where(fits).drop("__size")


def roster(meta: DataFrame) -> DataFrame:
    """match_id, player_id, team_id, group."""
    p = meta.select(F.col("id").alias("match_id"), F.col("home_team.id").alias("home"), F.col("away_team.id").alias("away"), F.explode("players").alias("p"))
    group = F.when(F.col("p.team_id") == F.col("home"), "home team").when(F.col("p.team_id") == F.col("away"), "away team")
    return p.select("match_id", F.col("p.id").alias("player_id"), F.col("p.team_id").alias("team_id"), group.alias("group"))


def periods(meta: DataFrame) -> DataFrame:
    """match_id, period, start_frame, end_frame (half-open)."""
    return meta.select(F.col("id").alias("match_id"), F.inline("match_periods"))


def appearances(meta: DataFrame) -> DataFrame:
    """match_id, player_id, period, start_frame, end_frame (closed)."""
    p = meta.select(F.col("id").alias("match_id"), F.explode("players").alias("p"))
    p = p.select("match_id", F.col("p.id").alias("player_id"), F.explode("p.playing_time.by_period").alias("t"))
    return p.select("match_id", "player_id", F.regexp_extract("t.name", r"^period_(\d+)$", 1).try_cast("int").alias("period"), "t.start_frame", "t.end_frame")


def read_phases(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Phase intervals of a CSV file as (rows, rejects): whole numbers, start before end. A header that lacks a column or
    has one twice is an error, as is a ragged row. keep: other columns that accepted rows keep, as text."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    names = ("period", "frame_start", "frame_end")
    lost = {*names, *keep} - set(raw.columns)  # Spark renames both of two equal names
    if lost:
        raise ValueError(f"the header has no single {sorted(lost)}")
    ok = F.lit(True)
    for c in names:
        ok &= F.coalesce(F.col(c).rlike(r"^\d+$"), F.lit(False))
    typed = raw.withColumn("ok", ok & (F.col("frame_start").try_cast("long") < F.col("frame_end").try_cast("long")))
    rows = typed.where("ok").select(*keep, F.col("period").cast("int"), F.col("frame_start").cast("long"), F.col("frame_end").cast("long"))
    return rows, typed.where("not coalesce(ok, false)").drop("ok")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path (in normal form C), size and SHA-256 of every file below a folder. Spark's listing follows links, so there is no kind;
    paths that are equal in normal form are rows of one path, which audit.duplicates() finds. Spark leaves out empty files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(normal_form("path").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_once(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), form: str = "parquet") -> None:
    """Writes, and fails if the path exists."""
    w = df.write.mode("errorifexists").format(form)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A Markdown table of a small report."""
    rows = df.limit(limit).collect()
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def pack(spark: SparkSession, folder: str, path: str, part_bytes: int = 64 << 20) -> DataFrame:
    """Writes the files below a folder as an archive table of parts of about part_bytes; returns its members (part, path, size, sha256)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    total = f.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    f = f.select(F.pmod(F.xxhash64("path"), F.lit(parts)).alias("part"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    write_once(f.repartition(parts, "part"), path, ("part",))
    return spark.read.parquet(path).select("part", "path", "size", "sha256")


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """path, content, intact of an archive's members: whether size and digest are those stated."""
    a = spark.read.parquet(path)
    return a.select("path", "content", ((F.length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256"))).alias("intact"))


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log; what was written before stays."""
    df.write.mode("append").json(path)


def write_sealed(rows: DataFrame, by: list[str], order: str, text: str, path: str) -> DataFrame:
    """Writes rows with their running digest, then a manifest of each group's number of rows and last digest beside
    them (path + ".manifest"), which makes the rows count; returns the manifest."""
    spark = rows.sparkSession
    write_once(record_stream(rows, by, order, text), path)
    done = spark.read.parquet(path)
    write_once(done.groupBy(*by).agg(F.count("*").alias("n_rows"), F.max_by("chain", order).alias("digest")), path + ".manifest")
    return spark.read.parquet(path + ".manifest")


def seal_problems(spark: SparkSession, path: str, by: list[str], order: str, text: str) -> DataFrame:
    """Groups of a sealed table whose rows don't give the manifest's number and digest."""
    again = record_stream(spark.read.parquet(path).drop("chain"), by, order, text).groupBy(*by).agg(F.count("*").alias("n_rows"), F.max_by("chain", order).alias("digest"))
    return reconciled(again, spark.read.parquet(path + ".manifest"), by, ["n_rows", "digest"]).where("status <> 'equal'")


def write_receipt(spark: SparkSession, path: str, **fields: str) -> str:
    """A document of text fields with its own digest, written once as one JSON row; returns the digest."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in sorted(fields.items())])
    row = row.withColumn("receipt_sha256", document_digest(**{k: F.col(k) for k in fields}))
    write_once(row, path, form="json")
    return spark.read.json(path).first()["receipt_sha256"]


def report(df: DataFrame, limit: int = 200) -> str:
    """A small report as a JSON array."""
    return "[" + ",".join(df.limit(limit).toJSON().collect()) + "]"
