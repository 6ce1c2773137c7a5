"""Scalar rules as Column expressions. Every rule returns NULL when an input it needs is NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def samples_to_ms(n: Column | str, fs: Column | str | float = 500.0) -> Column:
    rate = F.lit(fs) if isinstance(fs, (int, float)) else col(fs)
    return F.round(col(n) * F.lit(1000.0) / rate, 3)


def interval_ms(later, earlier, fs=500.0, positive_only: bool = False) -> Column:
    """Signed distance in ms; with ``positive_only`` a non-positive distance becomes NULL."""
    d = samples_to_ms(col(later) - col(earlier), fs)
    return F.when(d > 0, d) if positive_only else d


def qtc_framingham(qt_ms: Column, rr_ms: Column) -> Column:
    return qt_ms + F.lit(0.154) * (F.lit(1000.0) - rr_ms)


def qtc_fridericia(qt_ms: Column, rr_ms: Column) -> Column:
    return F.when(rr_ms > 0, qt_ms / F.cbrt(rr_ms / F.lit(1000.0)))


def clamp(x: Column, lo: Column | None, hi: Column | None) -> Column:
    """NULL-skipping clamp: an absent limit does not limit; an absent value stays absent."""
    lifted = x if lo is None else F.greatest(x, lo)
    held = lifted if hi is None else F.least(lifted, hi)
    return F.when(x.isNotNull(), held)


def least_present(*cols: Column) -> Column:
    return F.least(*cols)


def greatest_present(*cols: Column) -> Column:
    return F.greatest(*cols)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def halve_rate(i: Column) -> Column:
    """Index at half the sampling rate, ties going up."""
    return F.floor((i + 1) / 2).cast("bigint")


def parse_number(text: Column, nulls: Sequence[str] = ("", "None")) -> Column:
    """Text to DOUBLE; every spelling of absence and anything unparsable becomes NULL."""
    trimmed = F.trim(text)
    value = F.when(~trimmed.isin(*nulls), trimmed).try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_int(text: Column, nulls: Sequence[str] = ("", "None")) -> Column:
    return parse_number(text, nulls).try_cast("bigint")


def out_of_range(x: Column, lo, hi, missing: str = "skip") -> Column:
    """True outside the inclusive range. ``missing="flag"`` also marks an absent value."""
    outside = (x < F.lit(lo)) | (x > F.lit(hi))
    return F.coalesce(outside, F.lit(missing == "flag"))


def range_marker(x: Column, lo, hi) -> Column:
    return F.when(x.isNull(), "--").when(out_of_range(x, lo, hi), "!").otherwise("")


def remap(x: Column, mapping: Mapping[str, str], default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    tail = x if default is None else F.lit(default)
    return tail if out is None else out.otherwise(tail)


def strip_suffix(x: Column, suffixes: Sequence[str]) -> Column:
    return F.regexp_replace(x, f"({'|'.join(suffixes)})$", "")


def rank_of(x: Column, ordered: Sequence, unknown: int = 99) -> Column:
    """Position in a listed order; unlisted values rank ``unknown``."""
    out = None
    for i, v in enumerate(ordered):
        out = F.when(x == F.lit(v), i) if out is None else out.when(x == F.lit(v), i)
    return out.otherwise(unknown) if out is not None else F.lit(unknown)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def non_blank(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def json_text(value: Column) -> Column:
    """JSON text with NaN written as null (struct or scalar columns holding doubles)."""
    return F.regexp_replace(F.to_json(value), r'"(NaN|Infinity|-Infinity)"', "null")
