"""Array, map and string operators of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import _c, is_finite


def zip_strict(**arrays) -> Column:
    """Structs of the arrays' entries; an error if the arrays differ in length, null if one is null."""
    columns = {n: _c(a) for n, a in arrays.items()}
    first, *others = columns.values()
    same = F.lit(True)
    for other in others:
        same &= F.size(first) == F.size(other)
    whole = F.lit(True)
    for c in columns.values():
        whole &= c.isNotNull()
    failed = F.raise_error(F.lit("parallel panels differ in length")).cast("boolean")
    zipped = F.arrays_zip(*[c.alias(n) for n, c in columns.items()])
    return F.when(F.when(~whole, False).when(same, True).otherwise(failed), zipped)


def transposed(a) -> Column:
    """Array of rows to array of columns (time-major to entity-major and back); empty for no rows. Rows have one length."""
    a = _c(a)
    width = F.coalesce(F.size(F.try_element_at(a, F.lit(1))), F.lit(0))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.transform(a, lambda row: F.get(row, i)))


def padded(a, n, fill) -> Column:
    """The array with fill appended up to n entries."""
    a = _c(a)
    return F.concat(a, F.array_repeat(fill, F.greatest(_c(n) - F.size(a), F.lit(0))))


def pad_mask(a, n) -> Column:
    """Which of n entries are the array's own."""
    a = _c(a)
    return F.concat(F.array_repeat(F.lit(True), F.size(a)), F.array_repeat(F.lit(False), F.greatest(_c(n) - F.size(a), F.lit(0))))


def collated(sets: DataFrame, batch: list[str], key: list[str], order: str, value: str, fill) -> DataFrame:
    """batch, key, values, mask: each set's values in order, padded to the largest set of its batch."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])
    one = sets.groupBy(*batch, *key).agg(rows.alias("values"))
    most = one.groupBy(*batch).agg(F.max(F.size("values")).alias("__n"))
    j = one.join(most, batch) if batch else one.crossJoin(F.broadcast(most))  # one row
    return j.select(*batch, *key, padded("values", F.col("__n"), fill).alias("values"), pad_mask("values", F.col("__n")).alias("mask"))


def lookup(entries, key, value: str, wanted) -> Column:
    """The value of an id in an array of structs; null if absent. Repeated ids are an error of Spark's map."""
    m = F.map_from_entries(F.transform(_c(entries), lambda e: F.struct(e[key], e[value])))
    return F.try_element_at(m, _c(wanted))


def present_mask(a) -> Column:
    """Which entries are not null."""
    return F.transform(_c(a), lambda x: x.isNotNull())


def present(a) -> Column:
    return F.array_compact(_c(a))


def full_match(text, pattern: str) -> Column:
    """Whether the whole text matches."""
    return _c(text).rlike(rf"\A(?:{pattern})\z")


def xy_panel_ok(a, entities: int, steps: int | None = None) -> Column:
    """Whether an array of steps x entities x 2 has that shape and is finite."""
    a = _c(a)
    ok = F.forall(a, lambda row: (F.size(row) == entities) & F.forall(row, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: is_finite(v))))
    return F.coalesce(ok & (F.size(a) == steps if steps is not None else F.size(a) > 0), F.lit(False))


def origin_id(period, index) -> Column:
    return F.format_string("period_%d/sample_%d", _c(period), _c(index))


def dropped_nan(value) -> Column:
    """A number as it enters a comparison: NaN is null, -0.0 is 0.0."""
    v = _c(value)
    return F.when(~F.isnan(v), F.when(v == 0, F.lit(0.0)).otherwise(v))
