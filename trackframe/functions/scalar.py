"""Scalar expressions: validity predicates, clocks, ratios, coordinates, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCH = (52.5, 34.0)
STEP_SECONDS = 0.2


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """True for a finite number, false for NaN and infinities, null for null."""
    return ~F.isnan(_c(x)) & (F.abs(_c(x)) < float("inf"))


def is_finite(x) -> Column:
    """As finite(), with null as false."""
    return F.coalesce(finite(x), F.lit(False))


def xy_pair(x, y) -> Column:
    """struct(x, y), null if either is null."""
    return F.when(_c(x).isNotNull() & _c(y).isNotNull(), F.struct(_c(x).alias("x"), _c(y).alias("y")))


def clock_deciseconds(text) -> Column:
    """HH:MM:SS.cc as deciseconds; null unless well-formed and a whole number of deciseconds."""
    t, pattern = _c(text), r"^(\d{2}):([0-5]\d):([0-5]\d)\.(\d{2})$"
    h, m, s, cc = (F.regexp_extract(t, pattern, i).try_cast("long") for i in (1, 2, 3, 4))
    return F.when(cc % 10 == 0, ((h * 60 + m) * 60 + s) * 10 + (cc / 10).cast("long"))


def period_number(name) -> Column:
    """The number of a name period_N, else null."""
    return F.regexp_extract(_c(name), r"^period_([1-9]\d*)$", 1).try_cast("int")


def even_frame(frame) -> Column:
    return _c(frame) % 2 == 0


def sample_index(frame) -> Column:
    """Place on the 5 Hz grid of an even 10 Hz frame."""
    return F.floor(_c(frame) / 2).cast("long")


def safe_ratio(n, d) -> Column:
    """n / d, null if the denominator is null or zero."""
    return F.try_divide(_c(n).cast("double"), _c(d).cast("double"))


def clamp01(x) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(x)))


def quality_from_error(sre) -> Column:
    return clamp01(1 - _c(sre))


def piecewise_linear(x, knots: Sequence[tuple[float, float]]) -> Column:
    """Value of a clamped piecewise-linear map with strictly increasing knots at x."""
    xs = [k[0] for k in knots]
    if len(knots) < 2 or any(a >= b for a, b in zip(xs, xs[1:])):
        raise ValueError("knots must be two or more, strictly increasing in x")
    v = _c(x)
    out = F.when(v.isNull(), F.lit(None).cast("double")).when(v <= xs[0], F.lit(float(knots[0][1])))
    for (a, fa), (b, fb) in zip(knots, knots[1:]):
        out = out.when(v <= b, F.lit(float(fa)) + (v - a) * ((fb - fa) / (b - a)))
    return out.otherwise(F.lit(float(knots[-1][1])))


def speed(dx, dy, seconds: float = STEP_SECONDS) -> Column:
    return F.hypot(_c(dx), _c(dy)) / seconds


def normalized(x, y, pitch=PITCH) -> tuple[Column, Column]:
    return _c(x) / pitch[0], _c(y) / pitch[1]


def physical(x, y, pitch=PITCH) -> tuple[Column, Column]:
    return _c(x) * pitch[0], _c(y) * pitch[1]


def displacement(x, y, x0, y0, pitch=PITCH) -> tuple[Column, Column]:
    """Origin-relative displacement in pitch units."""
    return (_c(x) - _c(x0)) / pitch[0], (_c(y) - _c(y0)) / pitch[1]


def absolute(dx, dy, x0, y0, pitch=PITCH) -> tuple[Column, Column]:
    """Inverse of displacement(): physical coordinates."""
    return _c(dx) * pitch[0] + _c(x0), _c(dy) * pitch[1] + _c(y0)


def reconstructed(p, origin, representation) -> Column:
    """Physical prediction of a coordinate: displacements get the origin added."""
    return F.when(_c(representation) == "origin_relative_displacement", _c(p) + _c(origin)).otherwise(_c(p))


def in_pitch(x, y, length, width) -> Column:
    return (F.abs(_c(x)) <= _c(length) / 2) & (F.abs(_c(y)) <= _c(width) / 2)


def implausible(x, y, length, width, factor: float = 1.0) -> Column:
    """Beyond factor times the whole pitch dimension."""
    return (F.abs(_c(x)) > _c(length) * factor) | (F.abs(_c(y)) > _c(width) * factor)


def horizon_stratum(step, edges: Sequence[tuple[str, int, int]] = (("early", 0, 5), ("middle", 5, 10), ("late", 10, 15))) -> Column:
    """Name of the half-open range of 0-based steps that holds step."""
    return reduce(lambda c, e: c.when((_c(step) >= e[1]) & (_c(step) < e[2]), F.lit(e[0])), edges[1:], F.when((_c(step) >= edges[0][1]) & (_c(step) < edges[0][2]), F.lit(edges[0][0])))


def position_features(x, y) -> Column:
    """array(x, y, 1), or zeros where a coordinate is missing."""
    here = _c(x).isNotNull() & _c(y).isNotNull()
    zero = F.lit(0.0)
    return F.when(here, F.array(_c(x), _c(y), F.lit(1.0))).otherwise(F.array(zero, zero, zero))


def plain_name(name) -> Column:
    """Lower case, with - and . as _."""
    return F.lower(F.translate(_c(name), "-.", "__"))


def target_id(step, player, axis) -> Column:
    """sre_tTT_pPP_axis."""
    return F.format_string("sre_t%02d_p%02d_%s", _c(step).cast("int"), _c(player).cast("int"), _c(axis))


def blob_id(content) -> Column:
    """sha1("blob <length>\\0" + content) of a binary column."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(_c(content)).cast("string")), "UTF-8"), F.unhex(F.lit("00")), _c(content)))


def pointer_fields(text) -> Column:
    """struct(oid, size) of a large-file pointer text, null if it is none."""
    pattern = r"^version https://git-lfs\.github\.com/spec/v1\noid sha256:([0-9a-f]{64})\nsize (\d+)\n?$"
    return F.when(_c(text).rlike(pattern), F.struct(F.regexp_extract(_c(text), pattern, 1).alias("oid"), F.regexp_extract(_c(text), pattern, 2).cast("long").alias("size")))


def bounded(text, limit: int = 200) -> Column:
    return F.when(F.length(_c(text)) > limit, F.concat(F.substring(_c(text), 1, limit), F.lit("..."))).otherwise(_c(text))


def quality_stratum(any_extrapolated, any_detected, any_unknown) -> Column:
    """extrapolated if any flag is false, else unclassified if none is true or any is unknown,
    else detected_only."""
    return F.when(_c(any_extrapolated), "extrapolated").when(~_c(any_detected) | _c(any_unknown), "unclassified").otherwise("detected_only")


def closed_keys(text, expected: Sequence[str]) -> Column:
    """Whether a JSON object's top-level keys are exactly those expected, none twice."""
    keys = F.json_object_keys(_c(text))
    want = F.array(*[F.lit(k) for k in sorted(expected)])
    return F.coalesce(F.sort_array(keys) == want, F.lit(False))


def ball_state(flag, x, y) -> Column:
    """flag state / coordinate state of an optional ball: e.g. detected_finite."""
    f = F.when(_c(flag).isNull(), "unknown").when(_c(flag), "detected").otherwise("extrapolated")
    n = _c(x).isNotNull().cast("int") + _c(y).isNotNull().cast("int")
    return F.concat_ws("_", f, F.when(n == 2, F.when(finite(x) & finite(y), "finite").otherwise("nonfinite")).when(n == 1, "partial").otherwise("missing"))


def slots_features(slots, x: str = "x", y: str = "y") -> Column:
    """Flattened position features of an ordered array of nullable slots."""
    return F.flatten(F.transform(slots, lambda s: position_features(s[x], s[y])))


def period_slot_id(period, index) -> Column:
    return F.format_string("period_%d/sample_%d", _c(period), _c(index))


def document_digest(**fields) -> Column:
    """SHA-256 of the canonical JSON of string fields: keys sorted, compact, UTF-8."""
    parts = []
    for i, (k, v) in enumerate(sorted(fields.items())):
        parts += [F.lit(("," if i else "{") + f'"{k}":'), json_string(v)]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def json_string(x) -> Column:
    """A JSON string literal of a text."""
    out = F.replace(F.replace(_c(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))
