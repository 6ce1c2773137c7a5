"""Row-local array rules, built on higher-order functions: no shuffle and no Python worker.

Positions are 0-based sample indices throughout; arrays hold one channel of one recording.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside element-wise lambdas there.

    Without it the optimizer may fold a column used once into a lambda and recompute it per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(arr: Column, i: Column) -> Column:
    """Element at a 0-based index, NULL when the index is absent or outside the array."""
    return F.when((i >= 0) & (i < F.size(arr)), F.get(arr, i.cast("int")))


def span(arr: Column, lo: Column, hi: Column) -> Column:
    """Inclusive span clipped to the array; empty when the limits cross."""
    a = F.greatest(lo, F.lit(0)).cast("int")
    b = F.least(hi, F.size(arr) - 1).cast("int")
    return F.slice(arr, a + 1, F.greatest(b - a + 1, F.lit(0)))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)


def mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, total(arr) / F.size(arr))


def median(arr: Column) -> Column:
    """Median of the present elements."""
    return quantile(arr, 0.5)


def quantile(arr: Column, q: float) -> Column:
    """Linearly interpolated quantile of the present elements."""

    def read(s: Column) -> Column:
        pos = (F.size(s) - 1) * F.lit(float(q))
        lo = F.floor(pos)
        a = F.get(s, lo.cast("int"))
        b = F.get(s, F.ceil(pos).cast("int"))
        return F.when(F.size(s) > 0, a + (b - a) * (pos - lo))

    return let(F.array_sort(F.filter(arr, lambda v: v.isNotNull())), read)


def nearest_rank(arr: Column, q: float) -> Column:
    """Quantile by nearest rank: element number round(q*n), at least the first."""

    def read(s: Column) -> Column:
        k = F.greatest(F.lit(1), F.round(F.size(s) * F.lit(float(q)))).cast("int")
        return F.when(F.size(s) > 0, F.get(s, k - 1))

    return let(F.array_sort(F.filter(arr, lambda v: v.isNotNull())), read)


def indexed(arr: Column) -> Column:
    """Array of struct(v, i)."""
    return F.transform(arr, lambda v, i: F.struct(v.alias("v"), i.alias("i")))


def arg_best(arr: Column, key: Callable[[Column], Column], offset: Column | int = 0) -> Column:
    """First index with the largest key, shifted by ``offset``; NULL for an empty array."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    ranked = F.transform(arr, lambda v, i: F.struct(key(v).alias("k"), (-i).alias("j")))
    return -F.array_max(ranked).getField("j") + off


def first_index(arr: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Smallest index whose element passes, NULL when none does."""
    hits = F.filter(F.transform(arr, lambda v, i: F.when(test(v, i), i)), lambda i: i.isNotNull())
    return F.array_min(hits)


def last_index(arr: Column, test: Callable[[Column, Column], Column]) -> Column:
    hits = F.filter(F.transform(arr, lambda v, i: F.when(test(v, i), i)), lambda i: i.isNotNull())
    return F.array_max(hits)


def box_mean(arr: Column, width: int, edge: str = "pad") -> Column:
    """Centred moving average. ``pad`` repeats the end values, ``trim`` shortens the window."""
    half = width // 2
    if edge == "trim":
        return let(arr, lambda a: F.transform(a, lambda v, i: mean(span(a, i - half, i + half))))
    taps = range(-half, half + 1)

    def padded(a: Column) -> Column:
        last = F.size(a) - 1

        def smooth(v: Column, i: Column) -> Column:
            near = [F.get(a, F.greatest(F.lit(0), F.least(last, i + k)).cast("int")) for k in taps]
            acc = near[0]
            for x in near[1:]:
                acc = acc + x
            return acc / F.lit(float(len(taps)))

        return F.transform(a, smooth)

    return let(arr, padded)


def gradient(arr: Column) -> Column:
    """Central difference, one-sided at both ends."""

    def slopes(a: Column) -> Column:
        def slope(v: Column, i: Column) -> Column:
            lo = F.greatest(i - 1, F.lit(0))
            hi = F.least(i + 1, F.size(a) - 1)
            return (F.get(a, hi) - F.get(a, lo)) / F.greatest(hi - lo, F.lit(1))

        return F.transform(a, slope)

    return let(arr, slopes)


def cross_left(m: Column, peak: Column, level: Column) -> Column:
    """Last index at or before ``peak`` whose value is not above ``level``; 0 if there is none."""
    return F.coalesce(last_index(m, lambda v, i: (i <= peak) & (v <= level)), F.lit(0))


def cross_right(m: Column, peak: Column, level: Column, stop: Column) -> Column:
    """First index from ``peak`` on whose value is not above ``level``, never beyond ``stop``."""
    end = F.least(stop, F.size(m) - 1)
    hit = first_index(m, lambda v, i: (i >= peak) & (v <= level))
    return F.greatest(F.least(F.coalesce(hit, end), end), peak)


def fold_forward(arr: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running fold that keeps every intermediate value (an array as long as ``arr``)."""
    typed = F.slice(arr, 1, 0)
    start = F.struct(typed.alias("out"), zero.alias("run"))

    def merge(acc: Column, v: Column) -> Column:
        nxt = step(acc.getField("run"), v)
        return F.struct(
            F.concat(acc.getField("out"), F.array(nxt.getField("v"))).alias("out"),
            nxt.getField("run").alias("run"),
        )

    return F.aggregate(arr, start, merge, lambda acc: acc.getField("out"))
