"""From per-sample labels to regions and landmarks, and from landmarks to label sequences.

Everything here is row-local array work on one channel of one recording.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.scalar import half_even
from ..schema import LANDMARKS_11, Landmarks

# Class numbers of a label sequence.
CLASSES = {"background": 0, "p": 1, "qrs": 2, "t": 3}


def runs(labels: Column) -> Column:
    """Maximal runs of equal values as array of (v, start, end), ends inclusive."""

    def cut(a: Column) -> Column:
        n = F.size(a)
        heads = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))

        def close(h: Column) -> Column:
            return F.transform(h, lambda s, k: F.struct(
                F.get(a, s).alias("v"), s.alias("start"), (F.coalesce(F.get(h, k + 1), n) - 1).alias("end")))

        return F.when(n > 0, A.let(heads, close))

    return A.let(labels, cut)


def explode_runs(df: DataFrame, keys: Sequence[str], labels: str = "labels") -> DataFrame:
    """Rows (keys, v, start, end, length): a unit becomes its regions."""
    rows = df.select(*keys, F.inline_outer(runs(F.col(labels)))).filter("start is not null")
    return rows.withColumn("length", F.col("end") - F.col("start") + 1)


def mode_filter(labels: Column, kernel: int = 9, classes: Sequence[int] = (0, 1, 2, 3)) -> Column:
    """Most frequent class in a centred window with repeated edges, the smallest class on a tie."""
    if kernel <= 1:
        return labels
    half = (kernel + (kernel % 2 == 0)) // 2

    def smooth(a: Column) -> Column:
        last = F.size(a) - 1
        options = F.array(*[F.lit(c) for c in classes])

        def vote(v: Column, i: Column) -> Column:
            part = A.span(a, i - half, i + half)
            head = F.greatest(F.lit(0), F.lit(half) - i)
            tail = F.greatest(F.lit(0), i + half - last)

            def count(c: Column) -> Column:
                n = F.size(F.filter(part, lambda x: x == c))
                n = n + F.when(F.get(a, F.lit(0)) == c, head).otherwise(0) + F.when(F.get(a, last) == c, tail).otherwise(0)
                return F.struct(n.alias("n"), (-c).alias("c"))

            return -F.array_max(F.transform(options, count)).getField("c")

        return F.transform(a, vote)

    return A.let(labels, smooth)


def local_extrema(x: Column, kind: str = "max") -> Column:
    """Indices of strict local extrema; a plateau counts once, at its middle."""
    signed = x if kind == "max" else F.transform(x, lambda v: -v)

    def inner(r: Column) -> Column:
        peak = lambda k: (F.get(r, k).getField("v") > F.get(r, k - 1).getField("v")) & (F.get(r, k).getField("v") > F.get(r, k + 1).getField("v"))
        ks = F.when(F.size(r) >= 3, F.filter(F.sequence(F.lit(1), F.greatest(F.size(r) - 2, F.lit(1))), peak)).otherwise(F.array().cast("array<int>"))
        return F.transform(ks, lambda k: F.floor((F.get(r, k).getField("start") + F.get(r, k).getField("end")) / 2).cast("int"))

    return A.let(runs(signed), inner)


def pick_region(
    regions: Column, cls: int, min_samples: int = 8, largest: bool = True, window: tuple[Column, Column] | None = None,
    strict: bool = False, anchor: Column | None = None,
) -> Column:
    """The one run of a class that answers for this event, as (v, start, end), or NULL.

    Runs touching ``window`` are preferred; with ``strict`` nothing else will do. Then the run
    holding ``anchor``, then the longest (the first on a tie), or simply the first.
    """
    length = lambda r: r.getField("end") - r.getField("start") + 1
    ok = F.filter(regions, lambda r: (r.getField("v") == cls) & (length(r) >= min_samples))

    def choose(rs: Column) -> Column:
        if not largest:
            return F.get(rs, F.lit(0))
        best = lambda q: F.array_max(F.transform(q, lambda r: F.struct(length(r).alias("n"), (-r.getField("start")).alias("s"), r.alias("r")))).getField("r")
        if anchor is None:
            return best(rs)
        held = F.filter(rs, lambda r: (r.getField("start") <= anchor) & (anchor <= r.getField("end")))
        return F.when(F.size(held) > 0, best(held)).otherwise(best(rs))

    if window is None:
        return A.let(ok, choose)
    lo, hi = window
    touching = lambda q: F.filter(q, lambda r: (r.getField("start") <= hi) & (r.getField("end") >= lo))

    def narrowed(q: Column) -> Column:
        return A.let(touching(q), lambda t: choose(t) if strict else choose(F.when(F.size(t) > 0, t).otherwise(q)))

    return A.let(ok, narrowed)


def extremum_peak(trace: Column, lo: Column, hi: Column) -> Column:
    """Sample of the largest deviation from the value at ``lo`` inside the inclusive span."""
    pack = F.struct(A.span(trace, lo, hi).alias("a"), A.at(trace, lo).alias("b"))
    return F.when(hi >= lo, A.let(pack, lambda s: A.arg_best(s.getField("a"), lambda v: F.abs(v - s.getField("b")))) + lo)


def name_deflections(
    trace: Column, onset: Column, offset: Column, frac: float = 0.05, floor: float = 0.02, choose: str = "first",
) -> Column:
    """Struct (q_peak, r_peak, s_peak, pattern) of the deflections between two boundaries.

    R is the first (or, with ``choose="largest"``, the largest) maximum above the threshold, Q and
    S the deepest minima before and after it below the negative threshold. Without any maximum
    the complex is a QS: it carries a Q only.
    """
    dev = A.let(F.struct(A.span(trace, onset, offset).alias("a"), A.at(trace, onset).alias("b")), lambda s: F.transform(s.getField("a"), lambda v: v - s.getField("b")))

    def named(d: Column) -> Column:
        thr = F.greatest(F.lit(float(floor)), F.lit(float(frac)) * F.array_max(F.transform(d, lambda v: F.abs(v))))

        def with_threshold(t: Column) -> Column:
            top = A.arg_best(d, lambda v: v)
            cand = F.array_distinct(F.concat(local_extrema(d, "max"), F.array(top.cast("int"))))
            high = F.filter(cand, lambda i: F.get(d, i) > t)
            if choose == "first":
                r = F.array_min(high)
            else:
                r = -F.array_max(F.transform(high, lambda i: F.struct(F.get(d, i).alias("v"), (-i).alias("j")))).getField("j")

            def around(z: Column) -> Column:
                pos = z.getField("r")
                q = A.arg_best(F.slice(d, 1, F.greatest(pos, F.lit(0))), lambda v: -v)
                s = A.arg_best(A.span(d, pos + 1, F.size(d) - 1), lambda v: -v) + pos + 1
                nadir = A.arg_best(d, lambda v: -v)
                deep = lambda i: F.when(F.get(d, i.cast("int")) < -t, i)
                qp = F.when(pos.isNull(), deep(nadir)).otherwise(F.when(pos > 0, deep(q)))
                sp = F.when(pos < F.size(d) - 1, deep(s))
                return A.let(F.struct(qp.alias("q"), pos.alias("r"), sp.alias("s")), lambda k: F.struct(
                    (onset + k.getField("q")).cast("bigint").alias("q_peak"), (onset + k.getField("r")).cast("bigint").alias("r_peak"),
                    (onset + k.getField("s")).cast("bigint").alias("s_peak"), _pattern(d, k).alias("pattern")))

            return A.let(F.struct(r.alias("r")), around)

        return A.let(thr, with_threshold)

    none = F.struct(*[F.lit(None).cast("bigint").alias(c) for c in ("q_peak", "r_peak", "s_peak")], F.lit("").alias("pattern"))
    return F.when((offset > onset) & (offset - onset >= 2), A.let(dev, named)).otherwise(none)


def _pattern(d: Column, k: Column) -> Column:
    """Letters in time order, capital where the deflection has half the largest height; QS without R."""
    cells = F.array_compact(F.array(*[
        F.when(k.getField(c).isNotNull(), F.struct(k.getField(c).alias("i"), F.lit(c).alias("c"), F.abs(F.get(d, k.getField(c).cast("int"))).alias("h")))
        for c in ("q", "r", "s")
    ]))
    text = A.let(F.array_sort(cells), lambda e: A.let(F.array_max(F.transform(e, lambda x: x.getField("h"))), lambda top: F.array_join(
        F.transform(e, lambda x: F.when(x.getField("h") >= F.lit(0.5) * top, F.upper(x.getField("c"))).otherwise(x.getField("c"))), "")))
    return F.when(k.getField("r").isNull(), F.when(k.getField("q").isNotNull(), "QS").otherwise("")).otherwise(text)


def landmarks_from_labels(
    df: DataFrame, labels: str = "labels", trace: str = "trace", window: tuple[str, str] | None = None, readable: tuple[str, str] | None = None,
    min_samples: Mapping[str, int] | int = 8, kernel: int = 9, strict: bool = False, frac: float = 0.05, floor: float = 0.02,
    read_pad: int | None = None, valid: tuple[str, str] | None = None,
) -> DataFrame:
    """All landmarks of the event a label sequence describes, and its deflection pattern.

    Samples outside the readable span are background. The window names the event; how far its waves may be followed is ``readable``, or with
    ``read_pad`` the window and so many samples on both sides inside ``valid`` (first and last valid sample, else the whole trace; a negative pad
    reads all of it). The first wave counts only if it starts before the core, the last one only if it ends after it.
    """
    if read_pad is not None and window:
        first, last = (F.col(valid[0]), F.col(valid[1])) if valid else (F.lit(0), F.size(labels) - 1)
        span = read_window(F.col(window[0]), F.col(window[1]), first, last, read_pad)
        df, readable = df.withColumns({"_read_lo": span["lo"], "_read_hi": span["hi"]}), ("_read_lo", "_read_hi")
    least = min_samples if isinstance(min_samples, Mapping) else {w: min_samples for w in ("p", "qrs", "t")}
    scope = readable or window
    lab = F.col(labels)
    if scope:
        lab = F.transform(lab, lambda v, i: F.when((i >= F.col(scope[0])) & (i <= F.col(scope[1])), v).otherwise(CLASSES["background"]))
    win = (F.col(window[0]), F.col(window[1])) if window else None
    d = df.withColumn("_runs", runs(mode_filter(lab, kernel)))
    d = d.withColumns({f"_{w}": pick_region(F.col("_runs"), CLASSES[w], least[w], window=win, strict=strict) for w in ("p", "qrs", "t")})
    q0, q1 = F.col("_qrs.start"), F.col("_qrs.end")
    p_ok = F.col("_p").isNotNull() & (F.col("_qrs").isNull() | (F.col("_p.start") < q0))
    t_ok = F.col("_t").isNotNull() & (F.col("_qrs").isNull() | (F.col("_t.end") > q1))
    d = d.withColumns(
        {
            "p_onset": F.when(p_ok, F.col("_p.start")), "p_offset": F.when(p_ok, F.col("_p.end")), "qrs_onset": q0, "qrs_offset": q1,
            "t_onset": F.when(t_ok, F.col("_t.start")), "t_offset": F.when(t_ok, F.col("_t.end")),
        }
    )
    x = F.col(trace)
    d = d.withColumns(
        {
            "_n": name_deflections(x, q0, q1, frac, floor),
            "p_peak": extremum_peak(x, F.col("p_onset"), F.col("p_offset")), "t_peak": extremum_peak(x, F.col("t_onset"), F.col("t_offset")),
        }
    )
    named = {c: F.col(f"_n.{c}") for c in ("q_peak", "r_peak", "s_peak")}
    present = {f"{w}_present": F.col(f"{w}_onset").isNotNull().cast("int") for w in ("p", "qrs", "t")}
    d = d.withColumns(named | present | {"qrs_pattern": F.coalesce(F.col("_n.pattern"), F.lit(""))})
    return d.drop("_runs", "_p", "_qrs", "_t", "_n", "_read_lo", "_read_hi")


def order_violations(lm: Landmarks = LANDMARKS_11) -> Column:
    """Number of present landmarks that lie before the present one in front of them."""
    seq = F.filter(F.array(*[F.col(c).cast("bigint") for c in lm.order]), lambda v: v.isNotNull())

    def count(s: Column) -> Column:
        n = F.greatest(F.size(s) - 1, F.lit(0))
        return F.size(F.filter(F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: b < a), lambda x: x))

    return A.let(seq, count)


# ---------------------------------------------------------------- landmarks to label sequences


def build_target(crop_start: Column, length: int, window: tuple[Column, Column], lm: Landmarks = LANDMARKS_11) -> Column:
    """Class per sample of a crop: background in the window, waves over their spans, NULL elsewhere.

    The span ends cut the crop into a few stretches; each is labelled once and repeated.
    """
    def inside(c: Column) -> Column:
        return F.least(F.lit(length), F.greatest(F.lit(0), c - crop_start)).cast("int")

    spans = [(CLASSES["background"], *window)]
    for w in lm.waves:
        a, b = (half_even(F.col(c).cast("double")) for c in (w.onset, w.offset))
        both = a.isNotNull() & b.isNotNull()
        spans.append((CLASSES[w.name], F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))))
    cells = F.array_compact(F.array(*[
        F.when(lo.isNotNull() & hi.isNotNull(), F.struct(inside(lo).alias("a"), inside(hi + 1).alias("b"), F.lit(cls).alias("c"))) for cls, lo, hi in spans
    ]))

    def labelled(sp: Column) -> Column:
        ends = F.flatten(F.transform(sp, lambda s: F.array(s.getField("a"), s.getField("b"))))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.lit(length)), ends)))

        def fill(q: Column) -> Column:
            def stretch(x: Column, i: Column) -> Column:
                cover = F.filter(sp, lambda s: (s.getField("a") <= x) & (x < s.getField("b")))
                return F.array_repeat(F.try_element_at(cover, F.lit(-1)).getField("c"), F.coalesce(F.get(q, i + 1), x) - x)

            return F.flatten(F.transform(q, stretch))

        return A.let(cuts, fill)

    return A.let(cells, labelled)


def resolve_window(
    start: Column, end: Column, n_samples: Column, source: str = "auto", pad: int = 20, crop: int = 0, lm: Landmarks = LANDMARKS_11,
) -> Column:
    """Struct (lo, hi): the table's window or the landmarks' span with a margin.

    ``auto`` narrows to the landmarks only where the table's window exceeds the crop.
    """
    cols = [F.col(c) for c in lm.order]
    a = F.greatest(F.lit(0), F.least(*cols) - pad)
    b = F.least(n_samples - 1, F.greatest(*cols) + pad)
    usable = F.least(*cols).isNotNull() & (b >= a)
    if source == "table":
        usable = F.lit(False)
    elif source == "auto":
        usable = usable & (F.lit(crop) > 0) & (end - start + 1 > crop)
    elif source != "landmarks":
        raise ValueError(f"unknown window source {source!r}")
    return F.struct(F.when(usable, a).otherwise(start).alias("lo"), F.when(usable, b).otherwise(end).alias("hi"))


def place_crop(lo: Column, hi: Column, n_samples: Column, length: int, jitter: Column | None = None) -> Column:
    """Start of a crop centred on the window (plus jitter), inside the recording where it fits."""
    start = F.floor((lo + hi + 1 - length) / 2) + (jitter if jitter is not None else F.lit(0))
    return F.greatest(F.lit(0), F.least(start, n_samples - length)).cast("bigint")


def rebase(df: DataFrame, crop_start: str, length: int, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """Landmarks in crop coordinates; those outside become absent."""
    out = {}
    for c in lm.order:
        p = F.col(c) - F.col(crop_start)
        out[c] = F.when((p >= -0.5) & (p <= length - 0.5), p)
    return df.withColumns(out)


def read_window(lo: Column, hi: Column, first: Column, last: Column, pad: int) -> Column:
    """Readable span: the window plus a margin inside the valid samples; a negative margin means all."""
    if pad < 0:
        return F.struct(first.alias("lo"), last.alias("hi"))
    return F.struct(F.greatest(first, lo - pad).alias("lo"), F.least(last, hi + pad).alias("hi"))


def argmax_labels(posterior: Column, suppressed: Sequence[int] = ()) -> Column:
    """Best class per sample from class-major posteriors, the first on a tie; suppressed classes never win."""
    def best(p: Column) -> Column:
        rows = F.transform(p, lambda row, c: F.when(c.isin(*suppressed), F.transform(row, lambda v: F.lit(float("-inf")))).otherwise(row)) if suppressed else p
        n = F.size(F.get(p, F.lit(0)))
        return A.let(rows, lambda r: F.transform(F.sequence(F.lit(0), n - 1), lambda i: A.arg_best(F.transform(r, lambda row: F.get(row, i)), lambda v: v)))

    return A.let(posterior, best)


def softmax(scores: Column) -> Column:
    """Class probabilities per sample from class-major scores."""
    def over(rows: Column, step) -> Column:
        return F.aggregate(F.slice(rows, 2, F.size(rows)), F.get(rows, F.lit(0)), lambda acc, row: F.zip_with(acc, row, step))

    def scale(r: Column) -> Column:
        return A.let(over(r, lambda x, y: F.greatest(x, y)), lambda top: A.let(
            F.transform(r, lambda row: F.zip_with(row, top, lambda v, m: F.exp(v - m))),
            lambda e: A.let(over(e, lambda x, y: x + y), lambda t: F.transform(e, lambda row: F.zip_with(row, t, lambda v, n: v / n)))))

    return F.when(F.size(scores) > 0, A.let(scores, scale)).otherwise(scores)


def roll_back(posterior: Column, shift: Column) -> Column:
    """Class-major rows of a trace that was rolled right by ``shift`` samples, in the original alignment."""
    def back(row: Column) -> Column:
        s = F.pmod(shift, F.greatest(F.size(row), F.lit(1))).cast("int")
        return F.concat(F.slice(row, s + 1, F.size(row)), F.slice(row, F.lit(1), s))

    return F.transform(posterior, back)


def ensemble_posteriors(
    outputs: DataFrame, keys: Sequence[str], model: str, models: Sequence, posterior: str = "posterior", shift: str | None = None,
    logits: bool = False, log: bool = False, presence: str | None = None,
) -> DataFrame:
    """Mean posterior per unit over the listed models and their shifts: keys, ``n_outputs``, the class-major mean, and the mean presence.

    A row of ``outputs`` is one model's class-major array for a unit, of a trace rolled by ``shift`` samples if that is given. ``logits`` takes the
    softmax over classes first; rolled outputs are rolled back; then all are averaged element by element. ``log`` returns the logarithm of the mean,
    clamped at 1e-9. ``presence`` is a column with the logit of a second output; its sigmoids are averaged. Models that are not listed and rows
    without a posterior take no part; outputs of a unit must have one shape. A unit gathers one array per model and shift, never its samples as rows.
    """
    p = softmax(F.col(posterior)) if logits else F.col(posterior)
    if shift:
        p = roll_back(p, F.col(shift))
    seen = outputs.filter(F.col(model).isin(*models) & F.col(posterior).isNotNull())
    order = [F.col(model), *([F.col(shift)] if shift else [])]
    gathered = F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], p.alias("p"))))
    extra = [F.avg(1 / (1 + F.exp(-F.col(presence)))).alias(presence)] if presence else []
    units = seen.groupBy(*keys).agg(gathered.alias("_all"), F.count(F.lit(1)).cast("int").alias("n_outputs"), *extra)

    def mean(rows: Column) -> Column:
        first = F.get(rows, F.lit(0))["p"]
        total = F.aggregate(F.slice(rows, 2, F.size(rows)), first, lambda acc, r: F.zip_with(acc, r["p"], lambda x, y: F.zip_with(x, y, lambda u, v: u + v)))
        value = (lambda v: F.log(F.greatest(v / F.size(rows), F.lit(1e-9)))) if log else (lambda v: v / F.size(rows))
        return F.transform(total, lambda row: F.transform(row, value))

    return units.select(*keys, "n_outputs", mean(F.col("_all")).alias(posterior), *([presence] if presence else []))


def renaming_consistency(df: DataFrame, old: Mapping[str, str]) -> DataFrame:
    """Per new landmark column against its old one: renamed, withdrawn and added counts."""
    out = []
    for new, prev in old.items():
        a, b = F.col(prev), F.col(new)
        out += [F.count_if(a.isNotNull() & b.isNotNull() & (a != b)).alias(f"{new}_renamed"), F.count_if(a.isNotNull() & b.isNull()).alias(f"{new}_withdrawn"),
                F.count_if(a.isNull() & b.isNotNull()).alias(f"{new}_added")]
    return df.agg(*out)
