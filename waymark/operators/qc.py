"""Quality rules on rows, units and records, and the cross-channel consistency test."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_even, out_of_range
from ..schema import KEYS, LANDMARKS_11, Keys, Landmarks
from ..session import materialise
from .ordered import GRAIN, attach, with_frame, with_neighbours
from .quantiles import grouped_quantiles


@dataclass(frozen=True)
class QcRules:
    """Thresholds of the row rules: samples for inversions, inclusive ms ranges for intervals."""

    tolerance: int = 3
    gross: int = 20
    qrs_ms: tuple[float, float] = (40, 200)
    qt_ms: tuple[float, float] = (250, 700)
    pr_ms: tuple[float, float] = (80, 400)


def steps_back(df: DataFrame, lm: Landmarks) -> tuple[DataFrame, list[str], list[str]]:
    """How far each present landmark lies before the present one in front of it: (df with the columns, those inside the core, the others).

    The landmarks' order is fixed, so each step is a plain column: a landmark against the first present one when looking back. A step is inside
    the core if both of its landmarks are.
    """
    at = lm.core_positions()
    lo, hi = min(at), max(at)
    c = [F.col(x).cast("bigint") for x in lm.order]
    inner, outer, new = [], [], {}
    for i in range(1, len(c)):
        back = F.coalesce(*c[i - 1 :: -1]) - c[i]
        if lo < i <= hi:
            held = F.coalesce(*c[i - 1 : lo - 1 if lo else None : -1])
            new[f"_in{i}"] = held - c[i]
            inner.append(f"_in{i}")
            if not lo:
                continue
            back = F.when(held.isNull(), back)
        new[f"_out{i}"] = back
        outer.append(f"_out{i}")
    return df.withColumns(new), inner, outer


def beat_qc(
    df: DataFrame, lm: Landmarks = LANDMARKS_11, rules: QcRules = QcRules(), fs: str = "fs_hz",
    present_flag: str | None = None,
) -> DataFrame:
    """Add ``qc_flags`` (array) and ``qc_status``; one narrow projection, no shuffle.

    Absent landmarks are skipped before neighbours are compared.
    """
    core = lm.core_wave
    first, last = lm.waves[0].onset, lm.waves[-1].offset
    ms = F.lit(1000.0) / F.coalesce(F.col(fs).cast("double"), F.lit(500.0))
    d, inner, outer = steps_back(df, lm)

    def any_of(names: Sequence[str], test) -> Column:
        return functools.reduce(lambda x, y: x | y, (F.coalesce(test(F.col(n)), F.lit(False)) for n in names), F.lit(False))

    structural = any_of(inner, lambda v: v > rules.tolerance)
    gross = F.greatest(*[F.when(F.col(n) > rules.gross, F.col(n)) for n in outer], F.lit(None).cast("bigint"))
    mild = any_of(outer, lambda v: (v > rules.tolerance) & (v <= rules.gross))

    def ranged(name: str, later: str, earlier: str, limits: tuple[float, float]) -> Column:
        width = (F.col(later) - F.col(earlier)) * ms
        text = F.concat(F.lit(f"{name}="), half_even(width).cast("bigint").cast("string"), F.lit("ms"))
        return F.when(out_of_range(width, float(limits[0]), float(limits[1])), text)

    missing = F.col(lm.anchor).isNull()
    if present_flag:
        missing = missing | (F.coalesce(F.col(present_flag), F.lit(0)) != 1)
    flags = F.array_compact(
        F.array(
            F.when(structural, F.lit("QRS_structural")),
            F.concat(F.lit("gross_boundary:"), gross.cast("string"), F.lit("smp")),
            ranged("QRSdur", core.offset, core.onset, rules.qrs_ms),
            ranged("QT", last, core.onset, rules.qt_ms),
            ranged("PR", core.onset, first, rules.pr_ms),
            F.when(missing, F.lit("R_missing")),
        )
    )
    status = F.when(F.size("qc_flags") > 0, "critical").when(F.col("_mild"), "minor").otherwise("clean")
    return (
        d.withColumns({"qc_flags": flags, "_mild": mild}).withColumn("qc_status", status).drop(*inner, *outer, "_mild")
    )


def flag_reasons(df: DataFrame, flags: str = "qc_flags") -> DataFrame:
    """One row per flag with its value cut off.

    The outer form with a filter behind it keeps the optimizer from testing the array's size below
    the projection, which would compute the flags twice.
    """
    rows = df.withColumn("reason", F.explode_outer(flags)).filter("reason is not null")
    return rows.withColumn("reason", F.regexp_extract("reason", "^[^:=]*", 0))


def unit_status(df: DataFrame, keys: Keys = KEYS, extra: Sequence[str] = (), frac: float = 0.5) -> DataFrame:
    """Counts per unit, whether most of its rows are critical, and its worst status."""
    crit = F.col("qc_status") == "critical"
    out = df.groupBy(*keys.unit).agg(
        *[F.first(c).alias(c) for c in extra],
        F.count(F.lit(1)).alias("n_beats"),
        F.count_if(crit).alias("n_critical"),
        F.count_if(F.col("qc_status") == "minor").alias("n_minor"),
        F.min(F.when(crit, F.col(keys.event))).alias("example_beat"),
        F.min_by("qc_flags", F.when(crit, F.col(keys.event))).alias("example_flags"),
    )
    share = F.col("n_critical") / F.col("n_beats")
    worst = F.when(F.col("n_critical") > 0, "critical").when(F.col("n_minor") > 0, "minor").otherwise("clean")
    return out.withColumns(
        {"frac_critical": share, "persistent": share >= frac, "worst_status": worst}
    )


def unit_persistence(units: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of persistent units, and of critical rows that lie outside them."""
    inside = F.sum(F.when(F.col("persistent"), F.col("n_critical")).otherwise(0))
    return units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col("n_critical") > 0).alias("units_any"),
        F.count_if("persistent").alias("units_persistent"),
        F.round(F.avg(F.col("persistent").cast("int")), 6).alias("persistent_rate"),
        F.round(1 - F.try_divide(inside, F.sum("n_critical")), 6).alias("transient_share"),
    )


def record_qc_summary(df: DataFrame, keys: Keys = KEYS, extra: Sequence[str] = ()) -> DataFrame:
    """Totals per record and its most frequent reason (the lexicographically first on a tie)."""
    e = keys.entity
    totals = df.groupBy(e).agg(
        *[F.first(c).alias(c) for c in extra],
        F.count(F.lit(1)).alias("beats_total"),
        F.count_if(F.col("qc_status") == "critical").alias("beats_critical"),
        F.count_if(F.col("qc_status") == "minor").alias("beats_minor"),
    )
    tally = flag_reasons(df.select(e, "qc_flags")).groupBy(e, "reason").agg(F.count(F.lit(1)).alias("n"))
    top = tally.groupBy(e).agg(F.min_by("reason", F.struct(-F.col("n"), F.col("reason"))).alias("dominant_reason"))
    return (
        totals.join(top, e, "left")
        .withColumn("frac_critical", half_even(F.col("beats_critical") / F.col("beats_total"), 4))
        .withColumn("dominant_reason", F.coalesce("dominant_reason", F.lit("")))
    )


def record_status(units: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """critical if any unit is persistent, minor if any row is critical, else clean."""
    lead = F.when(F.col("persistent"), F.col(keys.channel).cast("string"))
    out = units.groupBy(keys.entity).agg(
        F.max(F.col("persistent").cast("int")).alias("genuine"),
        F.max((F.col("n_critical") > 0).cast("int")).alias("_any"),
        F.array_join(F.array_sort(F.collect_set(lead)), ";").alias("problem_leads"),
        F.count_if("persistent").alias("n_problem_leads"),
    )
    status = F.when(F.col("genuine") == 1, "critical").when(F.col("_any") == 1, "minor").otherwise("clean")
    return out.withColumn("qc_status", status).drop("_any")


def flag_rates(df: DataFrame, by: Sequence[str], flags: Sequence[str], any_name: str = "any_flag") -> DataFrame:
    """Percentage of rows with each flag and with any of them; every row is in the denominator."""
    ints = [F.col(f).cast("int") for f in flags]
    every = F.greatest(*ints) if len(ints) > 1 else ints[0]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"),
        *[F.round(F.avg(F.col(f).cast("int")) * 100, 6).alias(f"{f}_pct") for f in flags],
        F.round(F.avg(every) * 100, 6).alias(f"{any_name}_pct"),
    )


# ---------------------------------------------------------------- cross-channel consistency


def channel_deviation(
    units: DataFrame, references: Sequence, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, fs: str = "fs_hz",
) -> DataFrame:
    """Add ``dev_<landmark>``: |position after the onset anchor - mean of the reference channels|, ms."""
    base = lm.core_wave.onset
    cols = [c for c in lm.order if c != base]
    ms = F.lit(1000.0) / F.coalesce(F.col(fs).cast("double"), F.lit(500.0))
    rel = units.withColumns({f"_m_{c}": (F.col(c) - F.col(base)) * ms for c in cols})
    is_ref = F.col(keys.channel).isin(*references)
    j = attach(rel, [keys.entity], *[F.avg(F.when(is_ref, F.col(f"_m_{c}"))).alias(f"_r_{c}") for c in cols])
    dev = {f"dev_{c}": F.abs(F.col(f"_m_{c}") - F.col(f"_r_{c}")) for c in cols}
    return j.withColumns(dev).drop(*[f"_m_{c}" for c in cols], *[f"_r_{c}" for c in cols])


def deviation_summary(devs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median, p95, p98 per landmark over the whole corpus, and the rounded p98 as tolerance."""
    pairs = F.array(*[F.struct(F.lit(c).alias("landmark"), F.col(f"dev_{c}").alias("dev")) for c in cols])
    tidy = devs.select(F.inline(pairs))
    q = grouped_quantiles(tidy, ["landmark"], "dev", [0.5, 0.95, 0.98], ["median_ms", "p95_ms", "p98_ms"])
    return q.withColumn("tolerance_ms", half_even(F.col("p98_ms")))


def cross_channel_qc(
    units: DataFrame, references: Sequence, lm: Landmarks = LANDMARKS_11, keys: Keys = KEYS, fs: str = "fs_hz",
) -> DataFrame:
    """Add ``dev_*``, ``flag_*`` (strictly above the corpus tolerance) and ``any_flag``."""
    cols = [c for c in lm.order if c != lm.core_wave.onset]
    devs = channel_deviation(units, references, lm, keys, fs)
    summary = deviation_summary(devs, cols)
    # One row, one number per landmark: safe to broadcast at any scale.
    tol = summary.agg(*[F.max(F.when(F.col("landmark") == c, F.col("tolerance_ms"))).alias(f"_t_{c}") for c in cols])
    j = devs.crossJoin(F.broadcast(tol))
    flags = {f"flag_{c}": F.coalesce(F.col(f"dev_{c}") > F.col(f"_t_{c}"), F.lit(False)).cast("int") for c in cols}
    out = j.withColumns(flags).drop(*[f"_t_{c}" for c in cols])
    return out.withColumn("any_flag", F.greatest(*[F.col(f"flag_{c}") for c in cols]))


# ---------------------------------------------------------------- order rules


def in_order(chain: Sequence[str]) -> Column:
    """No present landmark lies before an earlier present one that is its nearest neighbour."""
    seq = F.filter(F.array(*[F.col(c) for c in chain]), lambda v: v.isNotNull())
    n = F.greatest(F.size(seq) - 1, F.lit(0))
    return ~F.exists(F.zip_with(F.slice(seq, 1, n), F.slice(seq, 2, n), lambda a, b: b < a), lambda x: x)


def order_flags(df: DataFrame, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """``chain_ok`` on neighbouring boundaries, ``peaks_inside_ok``, ``order_ok``; absent never violates."""
    def le(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) <= F.col(b), F.lit(True))

    chain = F.lit(True)
    for a, b in zip(lm.boundaries, lm.boundaries[1:]):
        chain = chain & le(a, b)
    inside = F.lit(True)
    for w in lm.waves:
        for p in w.peaks:
            inside = inside & le(w.onset, p) & le(p, w.offset)
    return df.withColumns(
        {"chain_ok": chain.cast("int"), "peaks_inside_ok": inside.cast("int"), "order_ok": in_order(lm.order).cast("int")}
    )


def out_of_record(columns: Sequence[str], n_samples: str = "n_samples") -> Column:
    vals = F.array(*[F.col(c).cast("bigint") for c in columns])
    return F.coalesce(F.exists(vals, lambda v: (v < 0) | (v > F.col(n_samples) - 1)), F.lit(False))


def order_disorder(df: DataFrame, chain: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per adjacent pair that sit in the wrong order (both present)."""
    aggs = [F.count_if(F.col(b) < F.col(a)).alias(f"{a}__{b}") for a, b in zip(chain, chain[1:])]
    wide = df.groupBy(*by).agg(*aggs)
    pairs = F.array(
        *[F.struct(F.lit(f"{a} > {b}").alias("pair"), F.col(f"{a}__{b}").alias("n")) for a, b in zip(chain, chain[1:])]
    )
    return wide.select(*by, F.inline(pairs))


def drop_misordered(df: DataFrame, waves: Sequence[str], keys: Keys = KEYS) -> DataFrame:
    """Drop events whose listed peaks do not increase, or end at or after the next event's first peak."""
    n = with_neighbours(df, keys.unit, keys.event, lead={"_nx": waves[0], "_ne": keys.event})
    inside = F.lit(True)
    for a, b in zip(waves, waves[1:]):
        inside = inside & F.coalesce(F.col(b) > F.col(a), F.lit(False))
    before_next = F.col("_ne").isNull() | F.coalesce(F.col(waves[-1]) < F.col("_nx"), F.lit(False))
    return n.filter(inside & before_next).drop("_nx", "_ne")


def drop_short_intervals(
    df: DataFrame, keys: Sequence[str], position: str, limit: float, tie: Sequence[str] = (), grain: int = GRAIN,
) -> DataFrame:
    """Remove one event of every interval of at most ``limit``, until none is left.

    In a pass every short interval names one of its two events: inside the series the earlier one
    if leaving it out makes the series rougher than leaving out the later one, else the later; at
    the start always the later, at the end always the earlier. Named events go together. A pass
    is written to the shared folder, so lineage stays short and a lost executor costs one pass. Every
    pass removes an event or is the last one. ``grain`` is the stretch of positions that one piece covers.
    """
    cur = df
    while True:
        seq = with_neighbours(cur, keys, position, ties=tie, ordinal="_i", total="_n", grain=grain)
        offs = {f"_x{k}": (lambda w, k=k: F.lag(position, -k).over(w)) for k in (-2, -1, 1, 2, 3)}
        s = with_frame(seq, keys, "_i", 3, 3, offs)
        x = {k: F.col(f"_x{k}") for k in (-2, -1, 1, 2, 3)} | {0: F.col(position)}

        def rough(order: list[int]) -> Column:
            d = [x[b] - x[a] for a, b in zip(order, order[1:])]
            return sum((F.abs(q - p) for p, q in zip(d[1:], d[2:])), F.abs(d[1] - d[0]))

        short = F.coalesce(F.abs(x[1] - x[0]) <= limit, F.lit(False))
        middle = (F.col("_i") >= 3) & (F.col("_i") <= F.col("_n") - 3)
        earlier = F.when(middle, rough([-2, -1, 1, 2, 3]) > rough([-2, -1, 0, 2, 3])).otherwise(F.col("_i") >= 3)
        s = s.withColumns({"_me": short & earlier, "_nx": short & ~earlier})
        w = with_frame(s, keys, "_i", 1, 0, {"_byprev": lambda w: F.lag("_nx").over(w)})
        gone = F.col("_me") | F.coalesce(F.col("_byprev"), F.lit(False))
        marked = materialise(w.withColumn("_gone", gone).select(*cur.columns, "_gone"))
        cur = marked.filter(~F.col("_gone")).drop("_gone")
        if marked.filter("_gone").limit(1).count() == 0:
            return cur
