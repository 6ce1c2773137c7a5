"""Augmentation of windows as a batch job. A row is one channel of one window with

    trace  array<double>     valid  array<boolean>     target  array<int>, NULL = not supervised

and landmark columns in window coordinates; every transform moves them together. Draws are pure
functions of (seed, key columns, epoch), so all channels of an event share them when the key leaves
the channel out.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.hashing import PRIME, continue_draw, key_parts, replicate_step, with_state
from ..schema import LANDMARKS_11, Landmarks
from .segment import CLASSES, runs

BG, P, T = CLASSES["background"], CLASSES["p"], CLASSES["t"]


def draws(df: DataFrame, names: Sequence[str], keys: Sequence[str], seed: int, epoch: int = 0) -> DataFrame:
    """Uniform numbers in (0, 1), one column per name."""
    d = with_state(df, "_st", seed + 7919 * epoch, key_parts(df, keys))
    for i, n in enumerate(names):
        d = continue_draw(d.withColumn(n, F.col("_st")), n, F.lit(i + 1))
        d = d.withColumn(n, (F.col(n).cast("double") + 0.5) / float(PRIME))
    return d.drop("_st")


def between(u: Column, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + u * F.lit(float(hi - lo))


def _first(target: Column, cls: int) -> Column:
    return A.first_index(target, lambda v, i: v == cls)


def _last(target: Column, cls: int) -> Column:
    return A.last_index(target, lambda v, i: v == cls)


def _remap(arr: str, fn, **bound: Column) -> Column:
    """Element-wise rewrite with values that are computed once per row."""
    pack = F.struct(*[v.alias(k) for k, v in bound.items()])
    return A.let(pack, lambda s: F.transform(F.col(arr), lambda v, i: fn(v, i, s)))


def isolate_beat(df: DataFrame, lo: Column, hi: Column, tail: Column, when: Column, supervise_tail: bool = True, pad: float = 0.0) -> DataFrame:
    """Nothing before the window, a flat tail behind it, then nothing. ``tail`` is in samples."""
    n = F.size("trace")
    a, b = F.greatest(F.lit(0), lo), F.least(n - 1, hi)
    outside = F.filter(F.transform("trace", lambda v, i: F.when(F.get("valid", i) & ~((i >= lo) & (i <= hi)), v)), lambda v: v.isNotNull())
    level = F.coalesce(A.median(outside), F.lit(0.0))
    end = F.least(n, b + 1 + F.greatest(F.lit(0), tail))
    on = when & (b >= a)
    keep = dict(a=a, b=b, e=end, on=on)
    out = {
        "trace": _remap("trace", lambda v, i, s: F.when(~s["on"], v).when((i < s["a"]) | (i >= s["e"]), F.lit(pad)).when(i > s["b"], s["lv"]).otherwise(v), lv=level, **keep),
        "valid": _remap("valid", lambda v, i, s: F.when(~s["on"], v).otherwise(v & (i >= s["a"]) & (i < s["e"])), **keep),
    }
    if supervise_tail:
        out["target"] = _remap("target", lambda v, i, s: F.when(s["on"] & (i > s["b"]) & (i < s["e"]), BG).otherwise(v), **keep)
    return df.withColumns(out)


def left_edge(df: DataFrame, lo: Column, lead_in: Column, when: Column, pad: float = 0.0) -> DataFrame:
    """The recording seems to begin ``lead_in`` samples before the window."""
    cut = F.when(when, F.greatest(F.lit(0), lo - lead_in)).otherwise(0)
    return df.withColumns(
        {
            "trace": _remap("trace", lambda v, i, s: F.when(i < s["c"], F.lit(pad)).otherwise(v), c=cut),
            "valid": _remap("valid", lambda v, i, s: v & (i >= s["c"]), c=cut),
        }
    )


def mask_wave(df: DataFrame, when: Column, blend: int = 3, donor: Column | None = None, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """Replace the first wave by a straight line and call it background; its landmarks go.

    ``donor`` (a uniform draw) adds the detrended residual of a background run of the same window,
    so the segment is not suspiciously smooth; without a long enough run the line stays plain.
    Adds ``p_masked``.
    """
    n = F.size("trace")
    lo, hi = _first(F.col("target"), P), _last(F.col("target"), P)
    d = df.withColumns({"_lo": lo, "_hi": hi})
    d = d.withColumns({"_a": F.greatest(F.lit(0), F.col("_lo") - blend), "_b": F.least(n - 1, F.col("_hi") + blend)})
    on = F.coalesce(when & (F.col("_b") > F.col("_a")), F.lit(False))
    span = F.col("_b") - F.col("_a") + 1
    off = F.lit(None).cast("int")
    if donor is not None:
        free = F.transform("target", lambda v, i: F.coalesce((v == BG) & F.get("valid", i) & ~((i >= F.col("_a") - 2) & (i <= F.col("_b") + 2)), F.lit(False)))
        fit = F.filter(runs(free), lambda r: r.getField("v") & (r.getField("end") - r.getField("start") + 1 >= span))
        # One draw picks the run and the place in it.
        pick = A.let(fit, lambda q: F.get(q, F.least(F.size(q) - 1, F.floor(donor * F.size(q))).cast("int")))
        room = lambda r: r.getField("end") - r.getField("start") + 2 - span
        off = A.let(pick, lambda r: F.when(r.isNotNull(), r.getField("start") + F.floor(F.pmod(donor * 7919, F.lit(1.0)) * room(r)))).cast("int")
    d = d.withColumns({"_on": on, "_off": off})
    x = F.col("trace")
    ends = dict(a=F.col("_a"), b=F.col("_b"), on=F.col("_on"), va=A.at(x, F.col("_a")), vb=A.at(x, F.col("_b")), o=F.col("_off"),
                d0=A.at(x, F.col("_off")), d1=A.at(x, F.col("_off") + (F.col("_b") - F.col("_a"))))

    def fill(v: Column, i: Column, s: Column) -> Column:
        t = (i - s["a"]) / (s["b"] - s["a"])
        line = s["va"] * (1 - t) + s["vb"] * t
        residual = F.get(x, (s["o"] + i - s["a"]).cast("int")) - (s["d0"] + (s["d1"] - s["d0"]) * t)
        return F.when(s["on"] & (i >= s["a"]) & (i <= s["b"]), line + F.coalesce(residual, F.lit(0.0))).otherwise(v)

    wave = next(w for w in lm.waves if w.name == "p")
    out = {
        "trace": _remap("trace", fill, **ends),
        "target": _remap("target", lambda v, i, s: F.when(s["on"] & (i >= s["l"]) & (i <= s["h"]), BG).otherwise(v), on=F.col("_on"), l=F.col("_lo"), h=F.col("_hi")),
        "p_masked": F.col("_on").cast("int"),
    }
    out |= {c: F.when(~F.col("_on"), F.col(c)) for c in (wave.onset, *wave.peaks, wave.offset)}
    return d.withColumns(out).drop("_lo", "_hi", "_a", "_b", "_on", "_off")


def jitter_last_offset(df: DataFrame, shift: Column, peak: str = "t_peak", offset: str = "t_offset") -> DataFrame:
    """Move the last wave's end label only, between its peak and the supervised end."""
    lo, hi = _first(F.col("target"), T), _last(F.col("target"), T)
    floor = F.greatest(lo, F.col(peak).cast("int") + 1)
    end = A.last_index(F.col("target"), lambda v, i: v.isNotNull())
    d = df.withColumns({"_hi": hi, "_new": F.when(shift != 0, F.least(end, F.greatest(floor, hi + shift)))})
    moved = F.col("_new").isNotNull() & (F.col("_new") != F.col("_hi"))

    def label(v: Column, i: Column, s: Column) -> Column:
        return F.when(s["m"] & (i > s["h"]) & (i <= s["n"]), T).when(s["m"] & (i > s["n"]) & (i <= s["h"]), BG).otherwise(v)

    return d.withColumns(
        {
            "target": _remap("target", label, m=F.coalesce(moved, F.lit(False)), h=F.col("_hi"), n=F.col("_new")),
            offset: F.when(F.coalesce(moved, F.lit(False)) & F.col(offset).isNotNull(), F.col("_new")).otherwise(F.col(offset)),
        }
    ).drop("_hi", "_new")


def time_warp(df: DataFrame, factor: Column, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """Uniform stretch: linear interpolation of the trace, nearest label and validity."""
    n = F.size("trace")
    src = lambda i, f: F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), i / f))

    def at(v: Column, i: Column, s: Column) -> Column:
        p = src(i, s["f"])
        lo = F.floor(p).cast("int")
        a, b = F.get("trace", lo), F.get("trace", F.least(n - 1, lo + 1))
        return a * (1 - (p - lo)) + b * (p - lo)

    near = lambda c: _remap(c, lambda v, i, s: F.get(c, F.bround(src(i, s["f"])).cast("int")), f=factor)
    out = {"trace": _remap("trace", at, f=factor), "target": near("target"), "valid": near("valid")}
    out |= {c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), F.col(c) * factor))) for c in lm.order}
    return df.withColumns(out)


def truncate_context(df: DataFrame, anchor: Column, lead_in: Column, when: Column, pad: float = 0.0, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """Cut everything before ``anchor - lead_in``: trace, validity, supervision and landmarks."""
    d = df.withColumn("_cut", F.when(F.coalesce(when, F.lit(False)), F.greatest(F.lit(0), anchor - lead_in)).otherwise(0).cast("int"))
    c = F.col("_cut")
    out = {
        "trace": _remap("trace", lambda v, i, s: F.when(i < s["c"], F.lit(pad)).otherwise(v), c=c),
        "valid": _remap("valid", lambda v, i, s: v & (i >= s["c"]), c=c),
        "target": _remap("target", lambda v, i, s: F.when(i >= s["c"], v), c=c),
    }
    out |= {x: F.when(F.bround(F.col(x)) >= c, F.col(x)) for x in lm.order}
    return d.withColumns(out).drop("_cut")


def scale_last_wave(df: DataFrame, alpha: Column, when: Column, blend: int = 4, onset: str = "t_onset", offset: str = "t_offset") -> DataFrame:
    """Compress the last wave toward the chord between its ends, easing in and out; labels stay."""
    a, b = F.bround(F.col(onset)).cast("int"), F.bround(F.col(offset)).cast("int")
    on = F.coalesce(when & (a >= 0) & (b < F.size("trace")) & (b - a >= 6), F.lit(False))
    m = F.least(F.lit(max(1, blend)), F.floor((b - a + 1) / 2))
    x = F.col("trace")

    def shrink(v: Column, i: Column, s: Column) -> Column:
        t = (i - s["a"]) / (s["b"] - s["a"])
        chord = s["va"] * (1 - t) + s["vb"] * t
        steps = F.greatest(s["m"] - 1, F.lit(1))
        ramp = F.least(F.lit(1.0), (i - s["a"]) / steps, (s["b"] - i) / steps)
        return F.when(s["on"] & (i >= s["a"]) & (i <= s["b"]), chord + (v - chord) * (1 - (1 - s["al"]) * ramp)).otherwise(v)

    return df.withColumn("trace", _remap("trace", shrink, a=a, b=b, m=m, on=on, al=alpha, va=A.at(x, a), vb=A.at(x, b)))


def stretch_last_limb(df: DataFrame, alpha: Column, when: Column, peak: str = "t_peak", offset: str = "t_offset", lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """Resample the limb after the last peak; what follows moves along, and what leaves the window is lost."""
    n = F.size("trace")
    o = F.bround(F.coalesce(F.col(offset).cast("double"), _last(F.col("target"), T).cast("double"))).cast("int")
    p = F.bround(F.coalesce(F.col(peak).cast("double"), F.floor(o / 2).cast("double"))).cast("int")
    d = df.withColumns({"_p": p, "_o": o})
    p, o = F.col("_p"), F.col("_o")
    length = o - p
    new = F.greatest(F.lit(2), F.least(F.bround(alpha * length).cast("int"), n - 2 - p))
    on = F.coalesce(when & (alpha > 0) & (p >= 0) & (p < o) & (o < n - 2) & (new != length), F.lit(False))
    d = d.withColumns({"_new": new, "_on": on})
    keep = dict(p=p, o=o, w=F.col("_new"), on=F.col("_on"), n=n)

    def source(i: Column, s: Column) -> Column:
        """Place a sample of the result is read from; NULL where nothing is left."""
        limb = (s["p"] + 1) + (i - s["p"] - 1) * ((s["o"] - s["p"] - 1) / (s["w"] - 1))
        longer = s["w"] > s["o"] - s["p"]
        after = F.when(longer, F.when(i - (s["w"] - (s["o"] - s["p"])) <= s["n"] - 1, i - (s["w"] - (s["o"] - s["p"])))).otherwise(i)
        return F.when(~s["on"] | (i <= s["p"]), i.cast("double")).when(i <= s["p"] + s["w"], limb).otherwise(after.cast("double"))

    def gap(i: Column, s: Column) -> Column:
        return s["on"] & (i > s["p"] + s["w"]) & (i <= s["o"])

    def value(v: Column, i: Column, s: Column) -> Column:
        q = source(i, s)
        lo = F.floor(q).cast("int")
        a = F.get("trace", lo)
        line = a + (F.get("trace", F.least(s["n"] - 1, lo + 1)) - a) * (q - lo)
        return F.when(gap(i, s), F.get("trace", F.least(s["o"] + 1, s["n"] - 1))).otherwise(line)

    def label(v: Column, i: Column, s: Column) -> Column:
        return F.when(gap(i, s), F.when(F.get("valid", i), BG)).otherwise(F.get("target", F.bround(source(i, s)).cast("int")))

    out = {
        "trace": _remap("trace", value, **keep), "target": _remap("target", label, **keep),
        "valid": _remap("valid", lambda v, i, s: F.when(gap(i, s), v).otherwise(F.get("valid", F.bround(source(i, s)).cast("int"))), **keep),
    }
    for c in lm.order:
        x = F.col(c)
        m = F.when(x <= p, x).when(x <= o, p + (x - p) * (F.col("_new") / length)).when(F.col("_new") > length, x + F.col("_new") - length).otherwise(x)
        out[c] = F.when(~F.col("_on"), x).when(m <= n - 1, m)
    return d.withColumns(out).drop("_p", "_o", "_new", "_on")


def signal_noise(
    df: DataFrame, keys: Sequence[str], seed: int, epoch: int = 0, scale: float = 0.0, wander: float = 0.0, wander_hz: float = 0.5, noise: float = 0.0,
    dropout: float = 0.0, protect: Column | None = None, fs: float = 500.0, channel: str = "lead",
) -> DataFrame:
    """Amplitude scale (shared), baseline wander, Gaussian noise and dropout (per channel, never the protected one)."""
    d = draws(df, ["_us"], keys, seed, epoch)
    d = draws(d, ["_up", "_ud"], [*keys, channel], seed + 1, epoch)
    d = with_state(d, "_un", seed + 2 + 7919 * epoch, key_parts(d, [*keys, channel]))
    dropped = (F.col("_ud") < dropout) & ~(protect if protect is not None else F.lit(False))

    def mixed(s: Column, i: Column, salt: int) -> Column:
        return A.let(A.let(replicate_step(s, i + salt), lambda z: F.pmod(z * z + z * F.lit(3) + F.lit(12345), F.lit(PRIME))), lambda z: (F.pmod(z * z + F.lit(777), F.lit(PRIME)).cast("double") + 0.5) / float(PRIME))

    def one(v: Column, i: Column, s: Column) -> Column:
        out = v * s["k"]
        if wander:
            out = out + F.lit(wander) * F.sin(F.lit(2 * math.pi * wander_hz / fs) * i + s["ph"])
        if noise:
            gauss = F.sqrt(F.lit(-2.0) * F.log(mixed(s["st"], i, 1))) * F.cos(F.lit(2 * math.pi) * mixed(s["st"], i, 500009))
            out = out + F.lit(noise) * gauss
        return F.when(s["off"], F.lit(0.0)).otherwise(out)

    k = F.lit(1.0) + between(F.col("_us"), -scale, scale)
    trace = _remap("trace", one, k=k, ph=F.col("_up") * F.lit(2 * math.pi), st=F.col("_un"), off=dropped)
    return d.withColumn("trace", trace).drop("_us", "_up", "_ud", "_un")


def boundary_weights(target: Column, band: int = 10, weight: float = 2.0) -> Column:
    """Weight per sample, raised within ``band`` of a change between two supervised samples."""
    def spread(t: Column) -> Column:
        edge = F.transform(t, lambda v, i: F.when((v != F.get(t, i + 1)) | ((v != F.get(t, i - 1)) & (i > 0)), True).otherwise(False))
        return A.let(edge, lambda e: F.transform(e, lambda v, i: F.when(F.exists(A.span(e, i - band, i + band), lambda x: x), F.lit(weight)).otherwise(1.0)))

    return A.let(target, spread)


def quiet_tail_panels(units: DataFrame, tails_ms: Sequence[float], lo: str, hi: str, fs: float = 500.0) -> DataFrame:
    """Every unit once per tail length, isolated with an unsupervised flat tail."""
    many = units.withColumn("tail_ms", F.explode(F.array(*[F.lit(float(t)) for t in tails_ms])))
    tail = F.bround(F.col("tail_ms") * F.lit(fs / 1000.0)).cast("int")
    return isolate_beat(many, F.col(lo), F.col(hi), tail, F.lit(True), supervise_tail=False)


def augment(
    df: DataFrame, policy: Mapping[str, object], keys: Sequence[str], seed: int, epoch: int = 0, lo: str = "win_lo", hi: str = "win_hi", fs: float = 500.0,
    lm: Landmarks = LANDMARKS_11,
) -> DataFrame:
    """Draw and apply a policy: morphology first, then what of the recording is seen, then the first wave.

    Probabilities: isolate_p, stretch_p, amplitude_p, context (none / pre_p / core_edge weights),
    mask_p. Ranges: isolate_tail_ms, stretch_alpha, amplitude_range, pre_p_ms, core_edge_ms.
    ``offset_jitter_ms`` and ``warp_pct`` are half-widths. Adds ``fired_*`` columns for the audit.
    """
    names = ["u_iso", "u_tail", "u_str", "u_al", "u_amp", "u_am", "u_ctx", "u_lead", "u_mask", "u_don", "u_jit", "u_warp"]
    d = draws(df, names, keys, seed, epoch)
    prob = lambda k: float(policy.get(k, 0.0) or 0.0)
    ms = lambda c: F.bround(c * F.lit(fs / 1000.0)).cast("int")
    rng = lambda k, default: tuple(policy.get(k, default))
    d = d.withColumns({"fired_isolate": F.col("u_iso") < prob("isolate_p"), "fired_stretch": F.col("u_str") < prob("stretch_p"), "fired_amplitude": F.col("u_amp") < prob("amplitude_p")})
    d = isolate_beat(d, F.col(lo), F.col(hi), ms(between(F.col("u_tail"), *rng("isolate_tail_ms", (300, 300)))), F.col("fired_isolate"))
    d = stretch_last_limb(d, between(F.col("u_al"), *rng("stretch_alpha", (1.0, 2.3))), F.col("fired_stretch"), lm=lm)
    d = scale_last_wave(d, between(F.col("u_am"), *rng("amplitude_range", (0.4, 1.0))), F.col("fired_amplitude"))
    ctx = dict(policy.get("context", {}))
    total = sum(ctx.values()) or 1.0
    pre, edge = ctx.get("pre_p", 0.0) / total, ctx.get("core_edge", 0.0) / total
    mode = F.when(F.col("u_ctx") < pre, "pre_p").when(F.col("u_ctx") < pre + edge, "core_edge").otherwise("none") if ctx else F.lit("none")
    d = d.withColumn("context", mode)
    core = _first(F.col("target"), CLASSES["qrs"])
    anchor = F.when(F.col("context") == "pre_p", F.coalesce(_first(F.col("target"), P), core)).otherwise(core)
    lead = F.when(F.col("context") == "pre_p", between(F.col("u_lead"), *rng("pre_p_ms", (40, 150)))).otherwise(between(F.col("u_lead"), *rng("core_edge_ms", (0, 8))))
    d = truncate_context(d, anchor, ms(lead), (F.col("context") != "none") & anchor.isNotNull(), lm=lm)
    d = mask_wave(d, F.col("u_mask") < prob("mask_p"), max(1, round(6 * fs / 1000)), F.col("u_don") if policy.get("residual", True) else None, lm)
    j = float(policy.get("offset_jitter_ms", 0.0) or 0.0)
    if j:
        d = jitter_last_offset(d, ms(between(F.col("u_jit"), -j, j)))
    w = float(policy.get("warp_pct", 0.0) or 0.0)
    if w:
        d = time_warp(d, F.lit(1.0) + between(F.col("u_warp"), -w, w) / 100.0, lm)
    return d.withColumnRenamed("p_masked", "fired_mask").drop(*names)


def fired_rates(augmented: DataFrame, configured: Mapping[str, float]) -> DataFrame:
    """Observed against configured rate per transform; ``ok`` fails below 40 % of a rate above 5 %."""
    cells = F.array(*[F.struct(F.lit(k).alias("transform"), F.lit(float(v)).alias("configured"), F.col(f"fired_{k}").cast("double").alias("x")) for k, v in configured.items()])
    r = augmented.select(F.inline(cells)).groupBy("transform", "configured").agg(F.avg("x").alias("observed"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("ok", ((F.col("configured") <= 0.05) | (F.col("observed") >= 0.4 * F.col("configured"))).cast("int"))
