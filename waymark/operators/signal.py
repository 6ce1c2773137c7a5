"""Waveform operators. A row holds one channel of one recording as an array; work is row-local
unless channels of a recording are combined, which groups by recording into one array per named
channel (a group's size is fixed by the channel list, not by the data)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..schema import INDEPENDENT_LEADS, KEYS, Keys
from ..session import materialise
from .quantiles import refined_quantiles

Q_MARGIN = 11


def widen(df: DataFrame, channels: Sequence, trace: str = "trace", keys: Keys = KEYS) -> DataFrame:
    """One row per recording with ``ch``: the arrays of the named channels in order, absent ones left out."""
    picks = [F.max(F.when(F.col(keys.channel) == F.lit(c), F.col(trace))).alias(f"_{i}") for i, c in enumerate(channels)]
    wide = df.filter(F.col(keys.channel).isin(*channels)).groupBy(keys.entity).agg(*picks)
    return wide.select(keys.entity, F.array_compact(F.array(*[F.col(f"_{i}") for i in range(len(channels))])).alias("ch"))


def centred(arr: Column) -> Column:
    return A.let(F.struct(arr.alias("a"), A.median(arr).alias("m")), lambda s: F.transform(s.getField("a"), lambda v: v - s.getField("m")))


def _root_sum_squares(channels: Column) -> Column:
    zero = F.transform(F.get(channels, F.lit(0)), lambda v: F.lit(0.0))
    total = F.aggregate(channels, zero, lambda acc, a: F.zip_with(acc, a, lambda s, v: s + F.coalesce(v * v, F.lit(0.0))))
    return F.transform(total, lambda v: F.sqrt(v))


def spatial_magnitude(
    df: DataFrame, channels: Sequence = INDEPENDENT_LEADS, trace: str = "trace", smooth: int = 1, min_channels: int = 1, keys: Keys = KEYS,
) -> DataFrame:
    """Per recording ``magnitude``: root of the summed squares of the median-centred channels."""
    w = widen(df, channels, trace, keys).filter(F.size("ch") >= min_channels)
    m = _root_sum_squares(F.transform("ch", centred))
    return w.select(keys.entity, (A.box_mean(m, smooth) if smooth > 1 else m).alias("magnitude"))


def spatial_velocity(
    df: DataFrame, channels: Sequence = INDEPENDENT_LEADS, trace: str = "trace", min_channels: int = 1, keys: Keys = KEYS,
) -> DataFrame:
    """Per recording ``velocity`` from central differences, and its 10th percentile by nearest rank."""
    w = widen(df, channels, trace, keys).filter((F.size("ch") >= min_channels) & (F.size(F.get("ch", F.lit(0))) >= 3))
    v = w.select(keys.entity, _root_sum_squares(F.transform("ch", A.gradient)).alias("velocity"))
    return v.withColumn("floor", A.nearest_rank(F.col("velocity"), 0.10))


def anchors(magnitude: DataFrame, column: str = "magnitude") -> DataFrame:
    """``r_anchor`` (largest value) and ``qrs_anchor`` (steepest step; at least 8 samples)."""
    m = F.col(column)
    step = A.let(m, lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.abs(F.get(a, i + 1) - F.get(a, i))))
    return magnitude.withColumns(
        {"r_anchor": A.arg_best(m, lambda v: v), "qrs_anchor": F.when(F.size(m) >= 8, A.arg_best(step, lambda v: v))}
    )


def anchor_window(anchored: DataFrame, before: int = 211, after: int = 220, column: str = "magnitude") -> DataFrame:
    """Label-free window around the anchor: not clipped on the left, clipped on the right."""
    return anchored.withColumns(
        {"win_start": F.col("r_anchor") - before, "win_end": F.least(F.size(column) - 1, F.col("r_anchor") + after)}
    )


def normalise(
    df: DataFrame, mode: str = "robust", trace: str = "trace", lo: str | None = None, hi: str | None = None, percentile: float = 99.0,
    eps: float = 1e-6, clip: float = 20.0, min_samples: int = 32, out: str = "normalised",
) -> DataFrame:
    """Scale a trace: robust (median, IQR/1.349), zscore (population SD) or abs_percentile.

    Statistics come from the window [lo, hi] when it spans enough samples, else the whole trace.
    """
    x = F.col(trace)
    if lo and hi:
        part = A.span(x, F.col(lo), F.col(hi))
        ref = F.when(F.size(part) >= min_samples, part).otherwise(x)
    else:
        ref = x
    if mode == "robust":
        stats = lambda r: F.struct(A.median(r).alias("c"), ((A.quantile(r, 0.75) - A.quantile(r, 0.25)) / F.lit(1.349)).alias("s"))
    elif mode == "zscore":
        def stats(r: Column) -> Column:
            return A.let(A.mean(r), lambda m: F.struct(
                m.alias("c"), F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(r)).alias("s")))
    elif mode == "abs_percentile":
        if not 50.0 <= percentile <= 100.0:
            raise ValueError("percentile must lie in [50, 100]")

        def stats(r: Column) -> Column:
            return A.let(A.median(r), lambda m: F.struct(m.alias("c"), A.quantile(F.transform(r, lambda v: F.abs(v - m)), percentile / 100).alias("s")))
    else:
        raise ValueError(f"unknown mode {mode!r}")

    def scale(s: Column) -> Column:
        spread = F.greatest(s.getField("s"), F.lit(eps))
        return F.transform(x, lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), (v - s.getField("c")) / spread)))

    return df.withColumn(out, A.let(A.let(ref, stats), scale))


def amplitude_at(landmarks: DataFrame, signals: DataFrame, peak: str, onset: str, trace: str = "trace", keys: Keys = KEYS, out: str = "amplitude") -> DataFrame:
    """v[peak] minus the median of the samples up to the onset; NULL where it cannot be read."""
    j = landmarks.join(signals.select(*keys.unit, trace), keys.unit)
    base = A.median(A.span(F.col(trace), F.col(onset) - Q_MARGIN, F.col(onset)))
    value = F.when(F.col(onset).isNotNull(), A.at(F.col(trace), F.col(peak)) - base)
    return j.withColumn(out, value).drop(trace)


def plain_amplitude(landmarks: DataFrame, signals: DataFrame, peak: str, trace: str = "trace", keys: Keys = KEYS, out: str = "amplitude") -> DataFrame:
    j = landmarks.join(signals.select(*keys.unit, trace), keys.unit)
    inside = F.greatest(F.lit(0), F.least(F.size(trace) - 1, F.col(peak)))
    return j.withColumn(out, F.when(F.col(peak).isNotNull(), A.at(F.col(trace), inside))).drop(trace)


def tail_level(arr: Column, share: float = 0.85) -> Column:
    """Median of the last part of a trace."""
    return A.median(A.span(arr, F.greatest(F.lit(1), F.round(F.size(arr) * F.lit(share))) - 1, F.size(arr) - 1))


def reseat_peak(landmarks: DataFrame, signals: DataFrame, peak: str, onset: str, offset: str, trace: str = "trace", keys: Keys = KEYS) -> DataFrame:
    """A peak outside its own wave moves to the largest deviation from the tail level inside it."""
    j = landmarks.join(signals.select(*keys.unit, trace), keys.unit)
    base = tail_level(F.col(trace))
    lo = F.greatest(F.lit(0), F.col(onset))
    hi = F.least(F.size(trace) - 1, F.col(offset))
    best = A.let(F.struct(A.span(F.col(trace), lo, hi).alias("a"), base.alias("b")),
                 lambda s: A.arg_best(s.getField("a"), lambda v: F.abs(v - s.getField("b")))) + lo
    outside = (F.col(peak) < F.col(onset)) | (F.col(peak) > F.col(offset))
    moved = F.coalesce(outside, F.lit(False)) & (hi > lo)
    return j.withColumn(peak, F.when(moved, best).otherwise(F.col(peak))).drop(trace)


# ---------------------------------------------------------------- boundary rules


def boundaries_5pct(
    magnitude: DataFrame, core: tuple[str, str], last: tuple[str, str], column: str = "magnitude", frac: float = 0.05,
) -> DataFrame:
    """Core and last-wave boundaries where the magnitude falls to 5 % of each wave's height.

    ``core`` and ``last`` name columns of rough (onset, offset) hints. The baseline is the quiet
    run before the core, or the tail after the last wave where that run is too short.
    """
    m = F.col(column)
    n = F.size(m)
    q0, q1, t0, t1 = (F.col(c) for c in (*core, *last))
    pre = q0 - 5
    lo = F.when(pre >= 12, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(n - 1, t1 + 10)))
    hi = F.when(pre >= 12, F.least(n, pre)).otherwise(n)
    a, b = F.greatest(F.lit(0), q0 - 25), F.least(n, q1 + 25)
    c, d = F.greatest(F.lit(0), t0 - 30), F.least(n, t1 + 30)
    s1 = magnitude.withColumns(
        {
            "base": F.when(hi - lo >= 4, A.median(A.span(m, lo, hi - 1))).otherwise(A.quantile(m, 0.10)),
            "q_peak_mag": F.when(b > a, A.arg_best(A.span(m, a, b - 1), lambda v: v) + a).otherwise(q0),
            "t_peak_mag": F.when(d > c, A.arg_best(A.span(m, c, d - 1), lambda v: v) + c).otherwise(t0),
        }
    )
    qp, tp = F.col("q_peak_mag"), F.col("t_peak_mag")
    between = A.span(m, qp, F.greatest(qp + 2, tp) - 1)
    trough = F.when(tp > qp + 1, A.arg_best(between, lambda v: -v) + qp).otherwise(n - 1)
    level = lambda p: F.col("base") + F.lit(frac) * (A.at(m, p) - F.col("base"))
    s2 = s1.withColumns({"trough": trough, "q_level": level(qp), "t_level": level(tp)})
    bound = lambda p, lv: F.struct(p.alias("p"), F.col(lv).alias("l"), F.col("trough").alias("w"))
    return s2.withColumns(
        {
            "rule_qrs_onset": A.let(bound(qp, "q_level"), lambda s: A.cross_left(m, s.getField("p"), s.getField("l"))),
            "rule_qrs_offset": A.let(bound(qp, "q_level"), lambda s: F.least(
                A.cross_right(m, s.getField("p"), s.getField("l"), s.getField("w")), s.getField("w"))),
            "rule_t_onset": A.let(bound(tp, "t_level"), lambda s: F.greatest(A.cross_left(m, s.getField("p"), s.getField("l")), s.getField("w"))),
            "rule_t_offset": A.let(bound(tp, "t_level"), lambda s: A.cross_right(m, s.getField("p"), s.getField("l"), F.size(m) - 1)),
        }
    )


def rule_report(errors: DataFrame, by: str = "landmark") -> DataFrame:
    """Median error, MAE and p90 per boundary and pooled."""
    both = errors.select(F.explode(F.array(F.col(by), F.lit("all"))).alias(by), "err_ms")
    both = both.withColumn("_a", F.abs("err_ms"))
    s = both.groupBy(by).agg(F.count("err_ms").alias("n"), F.avg("_a").alias("mae_ms"))
    med = refined_quantiles(both, [by], "err_ms", [0.5]).select(by, F.col("err_ms").alias("median_ms"))
    p90 = refined_quantiles(both, [by], "_a", [0.9]).select(by, F.col("_a").alias("p90_ms"))
    return s.join(med, by, "left").join(p90, by, "left")


def tangent_offset(df: DataFrame, peak: str, trace: str = "trace") -> DataFrame:
    """Offset where the steepest smoothed limb after the peak, extended, meets the tail level."""
    x = F.col(trace)
    s1 = df.withColumns({"_sm": A.box_mean(x, 5), "_b": tail_level(x), "_pk": F.greatest(F.lit(0), F.least(F.size(x) - 1, F.col(peak)))})
    s2 = s1.withColumn("_d", A.gradient(F.col("_sm")))
    lo = F.least(F.size(x) - 1, F.col("_pk") + 1)
    i0 = F.when(F.size(x) - 1 > lo, A.arg_best(A.span(F.col("_d"), lo, F.size(x) - 1), lambda v: F.abs(v)) + lo)
    s3 = s2.withColumn("tangent_contact", i0)
    slope = A.at(F.col("_d"), F.col("tangent_contact"))
    cross = F.col("tangent_contact") + F.try_divide(F.col("_b") - A.at(F.col("_sm"), F.col("tangent_contact")), slope)
    ok = cross >= F.col("tangent_contact")
    return s3.withColumn("tangent_offset", F.when(ok, F.greatest(F.lit(0.0), F.least(F.size(x) - 1.0, cross)))).drop("_sm", "_b", "_pk", "_d")


def last_wave_bounds(df: DataFrame, core_offset: str, trace: str = "trace", frac: float = 0.05, shift: int = 0, clear: int = 10) -> DataFrame:
    """Peak and bounds of the last wave: the first departure and the last return, per channel."""
    x = F.col(trace)
    n = F.size(x)
    dev = A.let(F.struct(x.alias("a"), tail_level(x).alias("b")), lambda s: F.transform(s.getField("a"), lambda v: F.abs(v - s.getField("b"))))
    d1 = df.withColumns({"_d": dev, "_q": F.least(n - 1, F.greatest(F.lit(0), F.col(core_offset)))})
    lo = F.least(n - 1, F.col("_q") + clear)
    d2 = d1.withColumn("_pk", F.when(lo < n - 2, A.arg_best(A.span(F.col("_d"), lo, n - 1), lambda v: v) + lo))
    d3 = d2.withColumn("_thr", F.when(A.at(F.col("_d"), F.col("_pk")) > 0, A.at(F.col("_d"), F.col("_pk")) * F.lit(frac)))
    s = F.struct(F.col("_pk").alias("p"), F.col("_thr").alias("t"), F.col("_q").alias("q"))
    off = A.let(s, lambda z: F.least(n - 1, F.coalesce(A.last_index(F.col("_d"), lambda v, i: (i > z.getField("p")) & (v > z.getField("t"))), z.getField("p")) + 1))
    dep = A.let(s, lambda z: F.coalesce(A.first_index(F.col("_d"), lambda v, i: (i >= z.getField("q")) & (i < z.getField("p")) & (v > z.getField("t"))), z.getField("p")))
    ok = F.col("_thr").isNotNull()
    on = F.least(F.greatest(F.col("_q"), dep - 1) + shift, F.col("_pk"))
    return d3.withColumns({"wave_onset": F.when(ok, on), "wave_peak": F.when(ok, F.col("_pk")), "wave_offset": F.when(ok, off)}).drop("_d", "_q", "_pk", "_thr")


def active_window(magnitude: DataFrame, column: str = "magnitude", msps: float = 2.0) -> DataFrame:
    """First and last magnitude above floor + 2 %, padded by 10 % of the span or 40 ms; in ms."""
    m = F.col(column)
    lim = F.struct(A.nearest_rank(m, 0.10).alias("f"), F.array_max(m).alias("p"))
    ends = A.let(lim, lambda s: A.let(s.getField("f") + F.lit(0.02) * (s.getField("p") - s.getField("f")), lambda t: F.struct(
        A.first_index(m, lambda v, i: v > t).alias("a"), A.last_index(m, lambda v, i: v > t).alias("b"))))
    d = magnitude.withColumn("_e", ends)
    on, off = F.col("_e.a") * F.lit(msps), F.col("_e.b") * F.lit(msps)
    pad = F.greatest(F.lit(0.10) * (off - on), F.lit(40.0))
    end = (F.size(m) - 1) * F.lit(msps)
    return d.withColumns({"active_from_ms": F.greatest(F.lit(0.0), on - pad), "active_to_ms": F.least(end, off + pad)}).drop("_e")


def channel_identity(df: DataFrame, result: str, plus: str, minus: str, trace: str = "trace", keys: Keys = KEYS) -> DataFrame:
    """Largest |result - (plus - minus)| per recording, e.g. for III = II - I."""
    pick = lambda c: F.max(F.when(F.col(keys.channel) == F.lit(c), F.col(trace)))
    w = df.groupBy(keys.entity).agg(pick(result).alias("_r"), pick(plus).alias("_p"), pick(minus).alias("_m"))
    gap = F.zip_with("_r", F.zip_with("_p", "_m", lambda a, b: a - b), lambda r, d: F.abs(r - d))
    return w.select(keys.entity, F.array_max(gap).alias("max_gap"))


# ---------------------------------------------------------------- filters and matching


def lowpass_taps(fc: float, fs: float, order: int = 64) -> list[float]:
    """Hamming-windowed sinc, symmetric, unity gain at zero frequency."""
    order += order % 2
    ft = fc / fs
    h = []
    for k in range(order + 1):
        m = k - order / 2
        ideal = 2 * ft * (1.0 if m == 0 else math.sin(math.pi * 2 * ft * m) / (math.pi * 2 * ft * m))
        h.append(ideal * (0.54 - 0.46 * math.cos(2 * math.pi * k / order)))
    total = sum(h)
    return [v / total for v in h]


def resample_half(df: DataFrame, fc: float = 150.0, fs: float = 1000.0, order: int = 64, trace: str = "trace", out: str = "halved") -> DataFrame:
    """Zero-phase low-pass with held edges, then every second sample; only kept samples are computed."""
    taps = F.array(*[F.lit(t) for t in lowpass_taps(fc, fs, order)])
    half = (order + order % 2) // 2

    def run(a: Column) -> Column:
        clean = F.transform(a, lambda v: F.when(F.isnan(v) | v.isNull(), F.lit(0.0)).otherwise(v))
        held = A.let(clean, lambda c: F.concat(
            F.array_repeat(F.get(c, F.lit(0)), half), c, F.array_repeat(F.element_at(c, -1), half)))
        n2 = F.ceil(F.size(a) / 2).cast("int")

        def sample(p: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), n2 - 1), lambda j: F.aggregate(
                F.zip_with(F.slice(p, j * 2 + 1, 2 * half + 1), taps, lambda v, h: v * h), F.lit(0.0), lambda s, v: s + v))

        return A.let(held, sample)

    return df.withColumn(out, A.let(F.col(trace), run))


def remove_baseline(df: DataFrame, window: int, overlap: float = 0.5, trace: str = "trace", out: str = "flat") -> DataFrame:
    """Subtract window medians joined by straight lines (the ends keep the outer medians)."""
    window += 1 - window % 2
    half = (window - 1) // 2
    hop = max(1, round(window * (1 - overlap)))

    def run(a: Column) -> Column:
        k = F.greatest(F.lit(1), F.floor((F.size(a) - F.lit(window * overlap)) / F.lit(window * (1 - overlap)))).cast("int")
        med = F.transform(F.sequence(F.lit(0), k - 1), lambda i: A.median(A.span(a, i * hop, i * hop + 2 * half)))

        def level(m: Column) -> Column:
            last = F.size(m) - 1

            def line(v: Column, i: Column) -> Column:
                pos = F.greatest(F.lit(0.0), F.least(last.cast("double"), (i - half) / F.lit(float(hop))))
                lo = F.floor(pos).cast("int")
                m0 = F.get(m, lo)
                return v - (m0 + (F.get(m, F.least(last, lo + 1)) - m0) * (pos - lo))

            return F.transform(a, line)

        return A.let(med, level)

    return df.withColumn(out, A.let(F.col(trace), run))


def normalised_window(df: DataFrame, lo: str, hi: str, trace: str = "trace", min_samples: int = 30, clip: float = 20.0) -> DataFrame:
    """The trace cut to samples ``lo`` up to ``hi`` (not included), or whole if fewer than ``min_samples`` are left, then scaled robustly."""
    part = A.span(F.col(trace), F.col(lo), F.col(hi) - 1)
    cut = df.withColumn(trace, F.when(F.size(part) >= min_samples, part).otherwise(F.col(trace)))
    return normalise(cut, "robust", trace, clip=clip, out=trace)


def quantile_match_table(source: DataFrame, target: DataFrame, levels: int = 4001, channel: str | None = "lead", trace: str = "trace") -> DataFrame:
    """(channel?, level_no, level, external, training): quantiles of both corpora at equal levels, their samples pooled by channel or all together.

    Traces are taken as they are; ``normalised_window`` prepares them. The source side is made strictly increasing, so it can be inverted.
    """
    keys = [channel] if channel else []
    probs = [i / (levels - 1) for i in range(levels)]
    samples = lambda d: d.select(*keys, F.explode(trace).alias("value"))
    s = refined_quantiles(samples(source), keys, "value", probs).withColumnRenamed("value", "external")
    t = refined_quantiles(samples(target), keys, "value", probs).withColumnRenamed("value", "training")
    both = s.join(t.select(*keys, "level_no", "training"), [*keys, "level_no"])

    # As many rows per channel as there are levels.
    w = W.partitionBy(*keys).orderBy("level_no")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    top = both.withColumn("_run", F.max("external").over(upto))
    tied = top.withColumn("_tie", (F.col("_run") <= F.lag("_run").over(w)).cast("int"))
    return tied.withColumn("external", F.col("_run") + F.coalesce(F.sum("_tie").over(upto), F.lit(0)) * F.lit(1e-6)).drop("_run", "_tie")


def apply_quantile_match(df: DataFrame, table: DataFrame, channel: str | None = "lead", trace: str = "trace", out: str = "matched") -> DataFrame:
    """Map samples through the table by straight lines between levels, held at both ends.

    The table becomes one array of points per channel (its length is the number of levels), so a
    trace row meets one small row and each sample is found by bisection.
    """
    keys = [channel] if channel else []
    pts = F.array_sort(F.collect_list(F.struct("external", "training"))).alias("_pts")
    t = table.groupBy(*keys).agg(pts)
    j = df.join(t, keys) if keys else df.crossJoin(F.broadcast(t))

    def mapped(p: Column) -> Column:
        x = F.transform(p, lambda s: s.getField("external"))

        def inner(xs: Column) -> Column:
            last = F.size(xs) - 1
            steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs) + F.lit(1))).cast("int"))

            def find(v: Column) -> Column:
                """Largest index whose point is not above v (0 if none), by as many halvings as the table needs."""
                start = F.struct(F.lit(0).alias("lo"), last.alias("hi"))

                def halve(acc: Column, _: Column) -> Column:
                    mid = F.ceil((acc.getField("lo") + acc.getField("hi")) / 2).cast("int")
                    up = F.get(xs, mid) <= v
                    return F.struct(F.when(up, mid).otherwise(acc.getField("lo")).alias("lo"),
                                    F.when(up, acc.getField("hi")).otherwise(F.greatest(mid - 1, acc.getField("lo"))).alias("hi"))

                return F.aggregate(steps, start, halve, lambda acc: acc.getField("lo"))

            def value(v: Column) -> Column:
                def at_index(i: Column) -> Column:
                    a, b = F.get(p, i), F.get(p, F.least(i + 1, last))
                    rise = F.try_divide(v - a.getField("external"), b.getField("external") - a.getField("external"))
                    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(rise, F.lit(0.0))))
                    return a.getField("training") + (b.getField("training") - a.getField("training")) * held

                return A.let(find(v), at_index)

            return F.transform(F.col(trace), value)

        return A.let(x, inner)

    return j.withColumn(out, A.let(F.col("_pts"), mapped)).drop("_pts")


# ---------------------------------------------------------------- templates


def template_average(
    events: DataFrame, signals: DataFrame, anchor: str, before: int, after: int, trace: str = "trace", keys: Keys = KEYS, n_passes: int = 2,
) -> DataFrame:
    """Mean waveform around the anchor over a unit's typical events: (unit, offset, value, n).

    Typical in rhythm: the pair of intervals before and after lies near the line of equal intervals
    and near the mean, re-estimated once on the survivors; where that leaves less than a third of
    the events, those with not too short a pair of intervals and no late successor are taken.
    Typical in shape: maximum and minimum lie between their quartiles (all rhythmically typical
    events count if none does).
    """
    from .ordered import attach, with_neighbours

    u = keys.unit
    e = with_neighbours(events.filter(F.col(anchor).isNotNull()), u, keys.event, lag={"_p": anchor}, lead={"_n": anchor}, total="_all")
    e = e.withColumns({"_x": F.col(anchor) - F.col("_p"), "_y": F.col("_n") - F.col(anchor)}).filter("_x is not null and _y is not null")
    # Every pass reads its events several times, so each starts from a written table.
    e = materialise(e.withColumn("_keep", F.lit(True)).select(*keys.row, anchor, "_x", "_y", "_all", "_keep"))
    for _ in range(n_passes):
        # Without survivors the scores of the pass before stand, i.e. those around the plain mean.
        kept = lambda c: F.coalesce(F.avg(F.when(F.col("_keep"), F.col(c))), F.avg(c))
        e = attach(e.drop("_mx", "_my", "_s1", "_s2"), u, kept("_x").alias("_mx"), kept("_y").alias("_my"))
        along = ((F.col("_x") - F.col("_mx")) + (F.col("_y") - F.col("_my"))) / F.lit(math.sqrt(2))
        across = ((F.col("_y") - F.col("_my")) - (F.col("_x") - F.col("_mx"))) / F.lit(math.sqrt(2))
        # Columns in the reference order: first the along-line score, then the across-line one.
        e = e.withColumns({"_al": along, "_ac": across}).withColumns({"_d1": F.abs("_al"), "_d2": F.abs("_ac")})
        e = attach(e, u, F.stddev_samp("_d1").alias("_s1"), F.stddev_samp("_d2").alias("_s2"))
        e = e.withColumn("_keep", F.coalesce((F.col("_d1") < F.lit(2.5) * F.col("_s1")) & (F.col("_d2") < F.lit(0.7) * F.col("_s2")), F.lit(False)))
        e = materialise(e)
    e = attach(e, u, F.count_if("_keep").alias("_nk"), F.min(F.when(F.col("_keep"), F.col("_al"))).alias("_least"))
    loose = (F.col("_al") >= -F.lit(2.5) * F.col("_s1")) & (F.col("_ac") <= F.lit(0.7) * F.col("_s2"))
    some = (F.col("_al") >= F.col("_least")) & (F.col("_ac") <= 0)
    fallback = F.when(F.col("_nk") == 0, loose).otherwise(some)
    chosen = F.when(F.col("_nk") * 3 < F.col("_all"), fallback).otherwise(F.col("_keep"))
    j = e.filter(chosen).select(*keys.row, anchor).join(signals.select(*u, trace), u)
    j = j.filter((F.col(anchor) - before >= 0) & (F.col(anchor) + after < F.size(trace)))
    j = j.select(*keys.row, A.span(F.col(trace), F.col(anchor) - before, F.col(anchor) + after).alias("_w"))
    j = materialise(j.withColumns({"_mx": F.array_max("_w"), "_mn": F.array_min("_w")}))
    q = lambda c, p: F.percentile(c, p)
    j = attach(j, u, q("_mx", 0.25).alias("_a"), q("_mx", 0.75).alias("_b"), q("_mn", 0.25).alias("_c"), q("_mn", 0.75).alias("_d"))
    j = j.withColumn("_ok", F.col("_mx").between(F.col("_a"), F.col("_b")) & F.col("_mn").between(F.col("_c"), F.col("_d")))
    j = attach(j, u, F.max(F.col("_ok").cast("int")).alias("_any")).filter("_ok or _any = 0")
    cells = j.select(*u, F.posexplode("_w").alias("_i", "v"))
    return cells.groupBy(*u, (F.col("_i") - before).alias("offset")).agg(F.avg("v").alias("value"), F.count("v").alias("n"))


def normalise_by_peak(df: DataFrame, keys: Sequence[str], value: str, out: str = "scaled") -> DataFrame:
    """Divide by the largest absolute value of the recording."""
    from .ordered import attach

    return attach(df, keys, F.max(F.abs(value)).alias("_m")).withColumn(out, F.try_divide(F.col(value), F.col("_m"))).drop("_m")


# ---------------------------------------------------------------- rule-based delineation


def _forward(arr: Column, k: int, absolute: bool = True, least: bool = False) -> Column:
    """Largest (or least) |value| of every sample and the ``k`` after it."""
    def scan(a: Column) -> Column:
        return F.transform(a, lambda v, i: (F.array_min if least else F.array_max)(F.slice(a, i + 1, k + 1)))

    return A.let(F.transform(arr, lambda v: F.abs(v)) if absolute else arr, scan)


def _first_in(arr: Column, lo: Column, hi: Column, level: Column, below: bool = True) -> Column:
    pack = F.struct(lo.alias("a"), hi.alias("b"), level.alias("t"))
    hit = lambda v, i, s: (i >= s.getField("a")) & (i <= s.getField("b")) & ((v < s.getField("t")) if below else (v > s.getField("t")))
    return A.let(pack, lambda s: A.first_index(arr, lambda v, i: hit(v, i, s)))


def _mad(arr: Column) -> Column:
    return A.let(F.struct(arr.alias("a"), A.median(arr).alias("m")), lambda s: A.median(F.transform(s.getField("a"), lambda v: F.abs(v - s.getField("m")))))


def delineate_rule_based(df: DataFrame, fs: float = 500.0, trace: str = "trace", activation_ms: float = 67.0) -> DataFrame:
    """Five landmarks of a single normalised beat from noise-scaled slopes and sustained conditions.

    Every landmark has a fallback; those used are listed in ``fallbacks``. Adds qrs_onset,
    qrs_offset, t_onset, t_peak, t_offset (0-based) and ``qrs_end_flag``.
    """
    def S(ms: float) -> int:
        return max(1, int(round(ms * fs / 1000.0)))

    x = F.col(trace)
    n = F.size(x)
    last = n - 1
    width = S(3)
    end = lambda c: F.least(last, c)
    peak_of = lambda a: F.array_max(F.transform(a, lambda v: F.abs(v)))

    d = df.withColumns({"_dv": A.gradient(x), "_dx": A.gradient(F.concat(F.array_repeat(F.get(x, F.lit(0)), width), x))})
    d = d.withColumns({"_ddv": A.gradient(F.col("_dv")), "_ddx": A.gradient(F.col("_dx"))})
    # Noise of the slopes over an early and a late quiet stretch, each sample counted once.
    early, late = S(80), F.greatest(n - S(150), F.lit(1)) - 1
    stop = F.greatest(F.greatest(n - S(20), F.lit(1)), late + 1)
    quiet = lambda c: A.let(F.struct(late.alias("a"), stop.alias("b")), lambda s: F.filter(F.col(c), lambda v, i: (i < early) | ((i >= s.getField("a")) & (i < s.getField("b")))))
    tiny = 2.220446049250313e-16
    sigma = lambda c: F.greatest(F.lit(1.4826) * _mad(quiet(c)), F.lit(tiny), F.lit(0.01) * peak_of(F.col(c)) + F.lit(tiny))
    d = d.withColumns({"_sd": sigma("_dv"), "_sdd": sigma("_ddv")})

    # 1. core onset: smoothed curvature and slope above the noise, moved back to where the slope stays up
    lo, hi = F.lit(max(width + 1, S(15)) - 1), F.least(n, F.lit(S(200))) - 1
    smooth = lambda c: A.box_mean(F.transform(c, lambda v: F.abs(v)), 2 * width + 1, edge="trim")
    both = F.zip_with(smooth(F.col("_ddx")), smooth(F.col("_dx")), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    lim = F.struct(lo.alias("a"), hi.alias("b"), (F.lit(0.5) * F.col("_sdd")).alias("p"), (F.lit(0.2) * F.col("_sd")).alias("q"))
    found = A.let(lim, lambda s: A.first_index(both, lambda v, i: (i >= s.getField("a")) & (i <= s.getField("b")) & (v.getField("p") > s.getField("p")) & (v.getField("q") > s.getField("q"))))
    d = d.withColumn("_e", found)
    q0 = F.col("_e") - width
    local = peak_of(A.span(F.col("_dv"), q0 - S(30), q0 + S(20)))
    back = _first_in(_forward(F.col("_dv"), S(6), least=True), F.greatest(F.lit(0), q0 - S(30)), q0 - S(6), F.when(local > 0, F.lit(0.15) * local), below=False)
    spare = F.greatest(F.lit(0), A.arg_best(A.span(F.col("_ddv"), lo, hi), lambda v: F.abs(v)) + lo - S(20))
    d = d.withColumn("qrs_onset", F.when(F.col("_e").isNull(), spare).otherwise(F.coalesce(back, q0)))
    d = d.withColumn("_f1", F.when(F.col("_e").isNull(), "qrs_onset"))

    # 2. core offset: curvature stays inside the noise for a while
    a, b = F.greatest(F.lit(0), F.col("qrs_onset") + S(20)), end(F.col("qrs_onset") + S(160))
    calm = _first_in(_forward(F.col("_ddv"), S(8)), a, b - S(8), F.col("_sdd"))
    flat = A.arg_best(A.span(F.col("_ddv"), a, b), lambda v: -F.abs(v)) + a
    d = d.withColumn("_c", calm).withColumns({"qrs_offset": F.greatest(F.lit(0), end(F.coalesce(F.col("_c"), flat))), "_f2": F.when(F.col("_c").isNull(), "qrs_offset")})
    qe = F.col("qrs_offset")

    # 3. last peak: largest value after the core
    start = F.when(n <= qe + 1 + S(40) + 5, end(qe + S(20))).otherwise(qe + S(40))
    start = F.greatest(F.lit(0), end(start))
    d = d.withColumn("t_peak", A.arg_best(A.span(x, start, last), lambda v: F.abs(v)) + start)
    tp = F.col("t_peak")

    # 4. last offset: flat and near the base level, flat alone, or a fixed distance
    t0, t1 = end(tp + S(120)), end(tp + S(260))
    g0, g1 = end(qe + S(20)), end(qe + S(60))
    h0, h1 = end(qe + S(5)), end(qe + S(30))
    base = F.when(t1 > t0 + 10, A.median(A.span(x, t0, t1))).when(g1 > g0, A.median(A.span(x, g0, g1))).otherwise(A.median(A.span(x, h0, F.greatest(h0, h1))))
    d = d.withColumn("_base", base)
    d = d.withColumns(
        {
            "_ap": F.greatest(F.abs(A.at(x, tp) - F.col("_base")), F.lit(1e-12)), "_s7": A.gradient(A.box_mean(x, 7, edge="trim")),
            "_dev": A.let(F.col("_base"), lambda m: F.transform(x, lambda v: v - m)),
        }
    )
    hold = S(35)
    i0, i1 = end(tp + S(30)), F.least(n - hold - 2, tp + S(260))
    slope = _forward(F.col("_s7"), hold)
    near = _forward(F.col("_dev"), hold)
    tol = F.lit(0.6) * F.col("_sd")
    room = F.greatest(F.lit(0.15) * F.col("_ap"), F.lit(0.01) * peak_of(x))
    calmest = F.zip_with(slope, near, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    lim = F.struct(i0.alias("a"), i1.alias("b"), tol.alias("p"), room.alias("q"))
    settled = A.let(lim, lambda s: A.first_index(calmest, lambda v, i: (i >= s.getField("a")) & (i <= s.getField("b")) & (v.getField("p") < s.getField("p")) & (v.getField("q") < s.getField("q"))))
    d = d.withColumns({"_x1": F.when(i1 > i0, settled), "_x2": F.when(i1 > i0, _first_in(slope, i0, i1, tol))})
    d = d.withColumns({"_t": F.coalesce(F.col("_x1"), F.col("_x2"), end(tp + S(140))),
                       "_f3": F.when(F.col("_x1").isNotNull(), None).when(F.col("_x2").isNotNull(), "t_offset_slope_only").otherwise("t_offset_fixed")})
    wide = _forward(A.gradient(A.box_mean(x, 11, edge="trim")), S(25))
    loose = F.lit(1.5) * tol
    free = F.when(F.col("_t") >= n - 3, _first_in(wide, i0, F.least(n - S(25) - 2, tp + S(260)), loose))
    d = d.withColumn("_x3", free).withColumns({"_t": F.coalesce("_x3", "_t"), "_f4": F.when(F.col("_x3").isNotNull(), "t_offset_unpinned")})
    # a second bump behind the offset moves it past the bump
    p0, p1 = end(F.col("_t") + 5), end(tp + S(260))
    d = d.withColumn("_post", F.when(p1 > p0 + 10, centred(A.span(x, p0, p1))))
    bump = F.when(peak_of(F.col("_post")) > F.lit(0.12) * F.col("_ap"), A.arg_best(F.col("_post"), lambda v: F.abs(v)) + p0)
    d = d.withColumn("_bump", bump)
    after = _first_in(_forward(F.col("_s7"), S(20)), end(F.col("_bump") + 10), F.least(n - S(20) - 2, F.col("_bump") + S(180)), loose)
    d = d.withColumn("_x4", after).withColumns({"t_offset": F.greatest(F.lit(0), end(F.coalesce("_x4", "_t"))), "_f5": F.when(F.col("_x4").isNotNull(), "t_offset_bump")})

    # 5. last onset: the trace leaves the level behind the core and stays away, moving toward the peak
    s0, s1 = end(qe + S(15)), end(qe + S(60))
    level = F.when(s1 > s0, A.median(A.span(x, s0, s1))).otherwise(A.median(A.span(x, h0, F.greatest(h0, h1))))
    d = d.withColumn("_lev", level)
    rise = A.at(x, tp) - F.col("_lev")
    keep = S(12)
    away = _forward(A.let(F.col("_lev"), lambda m: F.transform(x, lambda v: v - m)), keep, least=True)
    toward = A.let(F.col("_dv"), lambda g: F.transform(g, lambda v, i: A.mean(F.slice(g, i + 1, keep + 1))))
    pair = F.zip_with(away, toward, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    k0, k1 = end(qe + S(10)), F.least(n - keep - 2, tp - S(10))
    lim = F.struct(k0.alias("a"), k1.alias("b"), (F.lit(0.16) * F.greatest(F.abs(rise), F.lit(1e-12))).alias("p"), F.when(rise < 0, -1.0).otherwise(1.0).alias("s"))
    left = A.let(lim, lambda s: A.first_index(pair, lambda v, i: (i >= s.getField("a")) & (i <= s.getField("b")) & (v.getField("p") > s.getField("p")) & (v.getField("q") * s.getField("s") > 0)))
    d = d.withColumn("_x5", F.when(k1 > k0, left)).withColumns(
        {"t_onset": F.greatest(F.lit(0), end(F.coalesce(F.col("_x5"), tp - S(80)))), "_f6": F.when(F.col("_x5").isNull(), "t_onset")})
    d = d.withColumns(
        {
            "qrs_end_flag": (F.abs(qe * F.lit(1000.0 / fs) - F.lit(activation_ms)) >= 25).cast("int"),
            "fallbacks": F.array_compact(F.array(*[F.col(f"_f{i}") for i in range(1, 7)])),
        }
    )
    return d.select(*df.columns, "qrs_onset", "qrs_offset", "t_onset", "t_peak", "t_offset", "qrs_end_flag", "fallbacks")
