"""Digests of assignments, documents, files and record streams; canonical forms with other key orders."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SHA256_PATTERN = r"^[0-9a-f]{64}$"


def quoted(text) -> Column:
    """A JSON string of a text without control characters."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def role_digest(assignments: DataFrame, role: str, match: str) -> DataFrame:
    """One row: SHA-256 of the JSON object of each role's sorted matches, roles in order.

    For split protocols (a few dozen matches): one text."""
    per = assignments.groupBy(role).agg(F.array_sort(F.collect_list(match)).alias("m"))
    entry = F.concat(quoted(role), F.lit(":["), F.array_join(F.transform("m", quoted), ","), F.lit("]"))
    all_ = per.agg(F.array_sort(F.collect_list(F.struct(F.col(role).alias("r"), entry.alias("e")))).alias("x"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("x", lambda e: e["e"]), ","), F.lit("}"))
    return all_.select(F.sha2(text, 256).alias("digest"))


def fold_digest(folds: DataFrame, fold: str, match: str, held_out: str) -> DataFrame:
    """One row: SHA-256 of the JSON list of [fold, [training matches], held-out match], in order.

    folds: a row for each fold and training match."""
    per = folds.groupBy(fold, held_out).agg(F.array_sort(F.collect_list(match)).alias("m"))
    entry = F.concat(F.lit("["), quoted(fold), F.lit(",["), F.array_join(F.transform("m", quoted), ","), F.lit("],"), quoted(held_out), F.lit("]"))
    all_ = per.agg(F.array_sort(F.collect_list(F.struct(F.col(fold).alias("f"), entry.alias("e")))).alias("x"))
    return all_.select(F.sha2(F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["e"]), ","), F.lit("]")), 256).alias("digest"))


@F.pandas_udf(StringType())
def string_tree(text: pd.Series) -> pd.Series:
    """Canonical form of JSON trees whose leaves are all strings: keys in order of UTF-16 units, no spaces. Null for other texts."""

    def form(v):
        if isinstance(v, str):
            return json.dumps(v, ensure_ascii=False)
        if isinstance(v, list):
            return "[" + ",".join(form(x) for x in v) + "]"
        if isinstance(v, dict):
            return "{" + ",".join(f"{form(k)}:{form(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
        raise ValueError("a leaf is no string")

    def one(t):
        try:
            return None if t is None else form(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


def utf16_order(text) -> Column:
    """Sort key that orders texts by their UTF-16 code units."""
    return F.encode(F.col(text) if isinstance(text, str) else text, "UTF-16BE")


def locks(documents: DataFrame, key: str, fields: Sequence[str], required: Sequence[str], version: str, expected: str | None = None) -> DataFrame:
    """Lock digests of flat documents of string columns: key, lock_sha256, status.

    The payload is the JSON object of the fields that aren't null, keys in order. status: missing_field, bad_version (column
    lock_schema_version), mismatch (with the digest in column ``expected``), else ok."""
    names = sorted(fields, key=lambda f: f.encode("utf-16-be"))
    entries = [F.when(F.col(f).isNotNull(), F.concat(F.lit(json.dumps(f) + ":"), quoted(f))) for f in names]
    text = F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}"))
    missing = F.lit(False)
    for f in required:
        missing |= F.col(f).isNull()
    digest = F.sha2(text, 256)
    wrong = F.lit(False) if expected is None else ~F.col(expected).eqNullSafe(digest)
    status = F.when(missing, "missing_field").when(~F.col("lock_schema_version").eqNullSafe(F.lit(version)), "bad_version").when(wrong, "mismatch").otherwise("ok")
    return documents.select(key, digest.alias("lock_sha256"), status.alias("status"))


def tree_digest(files: DataFrame, path: str, kind: str, digest: str) -> DataFrame:
    """One row: digest, n of a file inventory, over lines "path NUL kind NUL digest" in order of path bytes.

    Lines are folded in two levels (files by leading folder, then folders), so that no group holds a whole tree with many folders."""
    folder = F.coalesce(F.nullif(F.substring_index(path, "/", 1), F.col(path)), F.lit(""))
    line = F.concat_ws("\x00", path, kind, digest)
    per = files.groupBy(folder.alias("__f")).agg(F.array_sort(F.collect_list(F.struct(F.col(path).cast("binary").alias("p"), line.alias("l")))).alias("x"), F.count("*").alias("n"))
    per = per.select("__f", "n", F.sha2(F.array_join(F.transform("x", lambda e: e["l"]), "\n"), 256).alias("d"))
    all_ = per.agg(F.array_sort(F.collect_list(F.struct(F.col("__f").cast("binary").alias("p"), F.concat_ws("\x00", "__f", "d").alias("l")))).alias("x"), F.sum("n").alias("n"))
    return all_.select(F.sha2(F.array_join(F.transform("x", lambda e: e["l"]), "\n"), 256).alias("digest"), "n")


def record_stream(rows: DataFrame, by: Sequence[str], order: str, text: str) -> DataFrame:
    """Adds chain: the running SHA-256 of each group's texts in order, sha256(chain before + text): what an appended log states after each row.

    A group is a bounded log (the receipts of a run, the windows of a match): it is folded as one array."""
    entries = F.array_sort(F.collect_list(F.struct(order, text)))
    per = rows.groupBy(*by).agg(entries.alias("__x"))
    empty = F.array().cast("array<string>")
    chain = F.aggregate("__x", empty, lambda done, e: F.concat(done, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), e[text]), 256))))
    return per.withColumn("__c", chain).select(*by, F.explode(F.arrays_zip("__x", "__c")).alias("__z")).select(*by, f"__z.__x.{order}", f"__z.__x.{text}", F.col("__z.__c").alias("chain"))


def sealed_prefix(rows: DataFrame, by: Sequence[str], order: str, text: str, sealed: str) -> DataFrame:
    """by, n_rows, n_sealed: how many leading rows of a log have the chain that their seal states; a resume goes on after them."""
    c = record_stream(rows, by, order, text)
    seals = rows.select(*by, order, sealed)
    j = c.join(seals, [*by, order])
    bad = F.min(F.when(~F.col(sealed).eqNullSafe(F.col("chain")), F.col(order)))
    firsts = j.groupBy(*by).agg(F.count("*").alias("n_rows"), bad.alias("__bad"))
    return j.join(firsts, list(by)).groupBy(*by).agg(F.first("n_rows").alias("n_rows"), F.count_if(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).alias("n_sealed"))


def length_prefixed(ids: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """by, digest, n: SHA-256 over a group's sorted ids, each after its length as 16 hex digits and a colon."""
    texts = F.array_sort(F.collect_list(F.col(key).cast("string")))
    part = F.transform(texts, lambda x: F.concat(F.lpad(F.lower(F.hex(F.octet_length(x).cast("long"))), 16, "0"), F.lit(":"), x))
    return ids.groupBy(*by).agg(F.sha2(F.array_join(part, ""), 256).alias("digest"), F.count("*").alias("n"))
