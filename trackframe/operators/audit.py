"""Integrity constraints, set comparisons, digests and structural differences."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import trees


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def partition_check(whole: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """One row: missing, unexpected and repeated keys of the parts against the whole (0, 0, 0: exact)."""
    tagged = [p.select(key, F.lit(0).alias("w"), F.lit(1).alias("p")) for p in parts] + [whole.select(key, F.lit(1).alias("w"), F.lit(0).alias("p"))]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    per = both.groupBy(key).agg(F.sum("w").alias("w"), F.sum("p").alias("p"))
    return per.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in (("missing", "w > 0 and p = 0"), ("unexpected", "w = 0 and p > 0"), ("repeated", "p > 1"))])


def inventory_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and keys twice on the actual side: key, problem."""
    e, a = expected.select(key), actual.select(key)
    missing = e.distinct().join(a, key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = a.distinct().join(e, key, "left_anti").withColumn("problem", F.lit("unexpected"))
    twice = duplicates(a, [key]).select(key, F.lit("duplicate").alias("problem"))
    return missing.unionByName(extra).unionByName(twice)


def matrix_gaps(results: DataFrame, dims: dict[str, Sequence]) -> DataFrame:
    """Cells of the full product of the dimensions (small lists) that are missing or repeated, and rows
    outside of it: dims, problem."""
    spark = results.sparkSession
    grid = None
    for name, values in dims.items():
        d = spark.createDataFrame([(v,) for v in values], results.select(name).schema)
        grid = d if grid is None else grid.join(F.broadcast(d))
    have = results.groupBy(*dims).agg(F.count("*").alias("n"))
    j = grid.withColumn("__w", F.lit(True)).join(have, list(dims), "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("__w").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return j.select(*dims, problem.alias("problem")).where("problem is not null")


def leakage(df: DataFrame, group: str, partition: str) -> DataFrame:
    """Groups that more than one partition holds."""
    return df.groupBy(group).agg(F.count_distinct(partition).alias("n_partitions")).where("n_partitions > 1")


def record_diff(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Field-level differences of two versions: key, path, category (missing_left, missing_right,
    type of difference), left_value, right_value."""
    a = left.select(*key, F.struct(*columns).alias("a"))
    b = right.select(*key, F.struct(*columns).alias("b"))
    types = dict(left.select(*columns).dtypes)
    j = a.join(b, list(key), "full")

    def differs(c):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if tolerance and types[c] in ("double", "float"):
            return F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.abs(x - y) > tolerance)
        return ~x.eqNullSafe(y)

    def row(path, category, x, y):
        return F.struct(F.lit(path).alias("path"), F.lit(category).alias("category"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"))

    none = F.lit(None)
    fields = F.filter(F.array(*[F.when(differs(c), row(c, "value", F.col(f"a.{c}"), F.col(f"b.{c}"))) for c in columns]), lambda x: x.isNotNull())
    rows = F.when(F.col("a").isNull(), F.array(row("*", "missing_left", none, none))).when(F.col("b").isNull(), F.array(row("*", "missing_right", none, none))).otherwise(fields)
    return j.select(*key, F.explode(rows).alias("x")).select(*key, "x.*")


def capped(mismatches: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """At most k rows of each category in order, with the category's whole count (a report)."""
    w = Window.partitionBy(*by).orderBy(*order)
    counts = mismatches.groupBy(*by).agg(F.count("*").alias("total"))
    return mismatches.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r").join(counts, list(by))


def code_counts(df: DataFrame, codes: str, by: Sequence[str] = ()) -> DataFrame:
    """In how many rows each issue code occurs (once a row)."""
    return df.select(*by, F.explode(F.array_distinct(codes)).alias("code")).groupBy(*by, "code").agg(F.count("*").alias("n"))


def group_digest(df: DataFrame, by: Sequence[str], order: str, row) -> DataFrame:
    """SHA-256 over the rows of small groups in order, joined by line feeds."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, row.alias("r")))), lambda x: x["r"])
    return df.groupBy(*by).agg(F.sha2(F.concat_ws("\n", rows), 256).alias("digest"), F.count("*").alias("n"))


def canonical_json(value) -> str:
    """Sorted keys, compact, UTF-8, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical_text(text: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null where one is not strict JSON (duplicate keys, NaN)."""

    def strict(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("duplicate key")
        return dict(pairs)

    def constant(name):
        raise ValueError(name)

    def one(t):
        try:
            return None if t is None else canonical_json(json.loads(t, object_pairs_hook=strict, parse_constant=constant))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(StringType())
def hex_float(x: pd.Series) -> pd.Series:
    """Bit-exact hexadecimal text of doubles."""
    return x.map(lambda v: None if v is None or v != v else float(v).hex())


@F.pandas_udf(StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def symmetric_difference(a, b):
    """Members of one of two arrays that the other lacks."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def membership_digest(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """SHA-256 over sorted ids, each after its length in 8 bytes, for each group."""
    texts = F.array_sort(F.collect_list(F.col(key).cast("string")))
    part = F.transform(texts, lambda x: F.concat(F.lpad(F.hex(F.octet_length(x).cast("long")), 16, "0"), F.hex(F.encode(x, "UTF-8"))))
    return df.groupBy(*by).agg(F.sha2(F.unhex(F.array_join(part, "")), 256).alias("digest"), F.count("*").alias("n"))


def stream_digest(df: DataFrame, order: Sequence[str], row, fan_out: int = trees.FAN_OUT) -> DataFrame:
    """digest and n of all rows in their order: the root of their hash tree, fixed by the rows, their order and the fan-out alone."""
    placed = trees.ordinals(df.withColumn("__row", row), order, "__ordinal")
    return trees.root(trees.tree(placed, "__ordinal", F.col("__row"), fan_out)).select("digest", "n")


def hash_chain(df: DataFrame, by: Sequence[str], order: str, payload: str) -> DataFrame:
    """Adds chain: sha256(previous chain + payload) along each group (receipts of one campaign: a group is one array); a null payload is the text None."""
    rest = [c for c in df.columns if c not in by]
    rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(payload).cast("string"), F.lit("None")).alias("__p"), *[c for c in rest if c != order])))

    def step(done, x):
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        return F.concat(done, F.array(F.sha2(F.concat(before, x["__p"]), 256)))

    per = df.groupBy(*by).agg(rows.alias("__x")).withColumn("__c", F.aggregate("__x", F.array().cast("array<string>"), step))
    out = per.select(*by, F.explode(F.arrays_zip("__x", "__c")).alias("__z"))
    return out.select(*by, *[F.col(f"__z.__x.{c}").alias(c) for c in rest], F.col("__z.__c").alias("chain"))


def strict_rows(df: DataFrame, reject, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Splits rows by a reject condition. In strict mode the first bad row fails the query."""
    bad = F.coalesce(reject, F.lit(True))
    if mode == "strict":
        return df.where(F.when(bad, F.raise_error(F.lit("a row breaks a rule")).cast("boolean")).otherwise(True)), df.limit(0)
    return df.where(~bad), df.where(bad)
