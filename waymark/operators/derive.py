"""Quantities read off a landmark table: intervals, presence, event windows, representative rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_even, interval_ms, qtc_framingham, qtc_fridericia, samples_to_ms
from ..schema import KEYS, LANDMARKS_11, Keys, Landmarks
from .ordered import keep_first, with_neighbours
from .quantiles import ordered_median

# Interval name -> (later landmark, earlier landmark).
INTERVALS = {
    "pdur": ("p_offset", "p_onset"),
    "qrsdur": ("qrs_offset", "qrs_onset"),
    "tdur": ("t_offset", "t_onset"),
    "pq": ("qrs_onset", "p_onset"),
    "pr": ("r_peak", "p_onset"),
    "qt": ("t_offset", "qrs_onset"),
    "qtpeak": ("t_peak", "qrs_onset"),
}
BIOMARKERS = {
    "qrs_duration": ("qrs_offset", "qrs_onset"),
    "qt_interval": ("t_offset", "qrs_onset"),
    "t_duration": ("t_offset", "t_onset"),
    "t_peak_to_end": ("t_offset", "t_peak"),
}


def derive_intervals(
    df: DataFrame, fs: str | float = "fs_hz", pairs: Mapping[str, tuple[str, str]] = INTERVALS,
    positive_only: bool = False,
) -> DataFrame:
    """Add ``<name>_ms`` for every pair of landmarks; absent if either end is absent."""
    rate = F.col(fs) if isinstance(fs, str) else fs
    return df.withColumns(
        {f"{n}_ms": interval_ms(a, b, rate, positive_only) for n, (a, b) in pairs.items()}
    )


def biomarkers(df: DataFrame, fs: str | float = "fs_hz") -> DataFrame:
    return derive_intervals(df, fs, BIOMARKERS)


def with_ms(df: DataFrame, lm: Landmarks = LANDMARKS_11, fs: str = "fs_hz") -> DataFrame:
    return df.withColumns({f"{c}_ms": samples_to_ms(c, F.col(fs)) for c in lm.order})


def with_qtc(df: DataFrame, qt: str = "qt_ms", rr: str = "rr_ms") -> DataFrame:
    return df.withColumns(
        {
            "qtc_framingham_ms": F.round(qtc_framingham(F.col(qt), F.col(rr)), 3),
            "qtc_fridericia_ms": F.round(qtc_fridericia(F.col(qt), F.col(rr)), 3),
        }
    )


def presence_flags(df: DataFrame, lm: Landmarks = LANDMARKS_11) -> DataFrame:
    """``<wave>_present`` from the wave's peaks, or its boundaries for a wave without one."""
    cols = {}
    for w in lm.waves:
        probe = w.peaks or (w.onset, w.offset)
        cols[f"{w.name}_present"] = F.coalesce(*[F.col(c) for c in probe]).isNotNull().cast("int")
    return df.withColumns(cols)


def presence_agreement(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Per landmark: flagged present but absent, and absent-flagged but positioned."""
    aggs = []
    for flag, c in pairs.items():
        on = F.col(flag) == 1
        aggs.append(F.count_if(on & F.col(c).isNull()).alias(f"{c}_blank_but_flagged"))
        aggs.append(F.count_if(~on & F.col(c).isNotNull()).alias(f"{c}_placed_but_unflagged"))
    return df.agg(*aggs)


def null_placeholder(df: DataFrame, column: str, equals: str, flag: str) -> DataFrame:
    """A position that only repeats its neighbour is a placeholder: make it absent and flag it."""
    copy = F.coalesce(F.col(column) == F.col(equals), F.lit(False))
    gone = F.when(~copy, F.col(column))
    return df.withColumns({flag: gone.isNotNull().cast("int"), column: gone})


def intervals_between(
    df: DataFrame, anchor: str = "r_peak", keys: Keys = KEYS, out: str = "rr", tail: str = "null",
    skip_absent: bool = False,
) -> DataFrame:
    """Distance to the neighbouring event of the same unit, in samples.

    ``tail="null"`` looks back (the first row is NULL); ``tail="repeat"`` looks forward and gives
    the last row the previous distance. ``skip_absent`` drops rows without anchor first.
    """
    src = df.filter(F.col(anchor).isNotNull()) if skip_absent else df
    w = with_neighbours(src, keys.unit, keys.event, lag={"_prev": anchor}, lead={"_next": anchor, "_ne": keys.event})
    back = F.col(anchor) - F.col("_prev")
    if tail == "null":
        return w.withColumn(out, back).drop("_prev", "_next", "_ne")
    forward = F.col("_next") - F.col(anchor)
    return w.withColumn(out, F.when(F.col("_ne").isNull(), back).otherwise(forward)).drop("_prev", "_next", "_ne")


def event_windows(
    df: DataFrame, anchor: str = "r_peak", keys: Keys = KEYS, n_samples: str = "n_samples"
) -> DataFrame:
    """Window of each event: halfway to the neighbours, the recording's ends at the edges."""
    w = with_neighbours(
        df, keys.unit, keys.event,
        lag={"_pa": anchor, "_pe": keys.event}, lead={"_na": anchor, "_ne": keys.event},
    )
    start = F.when(F.col("_pe").isNull(), F.lit(0)).otherwise(F.floor((F.col("_pa") + F.col(anchor)) / 2))
    end = F.when(F.col("_ne").isNull(), F.col(n_samples) - 1).otherwise(
        F.floor((F.col(anchor) + F.col("_na")) / 2)
    )
    # An absent limit stays absent: greatest() alone would turn it into 0.
    start = F.when(start.isNotNull(), F.greatest(start, F.lit(0)))
    return w.withColumns(
        {"window_start": start.cast("bigint"), "window_end": end.cast("bigint")}
    ).drop("_pa", "_pe", "_na", "_ne")


def representative(
    df: DataFrame, group: Sequence[str], event: str, how: str = "nearest_median",
    median_over: DataFrame | None = None, fill_from_next: Sequence[str] = (),
) -> DataFrame:
    """One whole row per group.

    nearest_median  id closest to the median id, the lower one on a tie
    interior_place  0-based place clamp(round(n/2)-1, 1, n-2) in id order, 0 for n < 3
    interior_id     id max(2, min(n-1, round(n/2))), 1 for n < 3
    ``fill_from_next`` lists columns that take the closest row's value when absent there.
    """
    group = list(group)
    if how == "nearest_median":
        med = ordered_median(df if median_over is None else median_over, group, event, "_med")
        j = df.join(med, group)
        by = F.struct(F.abs(F.col(event) - F.col("_med")), F.col(event))
        rest = [c for c in df.columns if c not in group]
        aggs = [F.min_by(F.struct(*rest), by).alias("_row")]
        for c in fill_from_next:
            aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(f"_f_{c}"))
        out = j.groupBy(*group).agg(*aggs)
        fill = set(fill_from_next)
        return out.select(
            *[
                F.col(c) if c in group else (F.col(f"_f_{c}").alias(c) if c in fill else F.col(f"_row.{c}"))
                for c in df.columns
            ]
        )
    if how == "interior_place":
        n = F.col("_n")
        place = F.when(n < 3, 0).otherwise(
            F.greatest(F.lit(1), F.least(n - 2, half_even(n / F.lit(2.0)).cast("bigint") - 1))
        )
        ranked = with_neighbours(df, group, event, ordinal="_i", total="_n")
        return ranked.filter(F.col("_i") - 1 == place).select(*df.columns)
    if how == "interior_id":
        n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        return df.join(n, group).filter(F.col(event) == interior_id(F.col("_n"))).select(*df.columns)
    raise ValueError(f"unknown representative rule {how!r}")


def interior_id(n: Column) -> Column:
    return F.when(n < 3, 1).otherwise(
        F.greatest(F.lit(2), F.least(n - 1, half_even(n / F.lit(2.0)).cast("bigint")))
    )


def first_event(df: DataFrame, keys: Keys = KEYS) -> DataFrame:
    return keep_first(df, keys.unit, [keys.event])


def limb_leads(df: DataFrame, ra: str = "ra", la: str = "la", ll: str = "ll", chest: Sequence[str] = ()) -> DataFrame:
    """The six limb leads from three electrodes, and chest leads against their mean."""
    w = (F.col(ra) + F.col(la) + F.col(ll)) / F.lit(3.0)
    out = {
        "I": F.col(la) - F.col(ra),
        "II": F.col(ll) - F.col(ra),
        "III": F.col(ll) - F.col(la),
        "aVR": F.lit(1.5) * (F.col(ra) - w),
        "aVL": F.lit(1.5) * (F.col(la) - w),
        "aVF": F.lit(1.5) * (F.col(ll) - w),
    }
    out |= {f"V{i + 1}": F.col(c) - w for i, c in enumerate(chest)}
    return df.withColumns(out)


def slice_cycles(df: DataFrame, keys: Sequence[str], index: str = "sample", cycle: int = 400) -> DataFrame:
    """Cut a long trace into cycles of fixed length; a last partial one counts if above half."""
    cut = df.withColumns(
        {"cycle": F.floor(F.col(index) / cycle).cast("bigint"), "offset": F.col(index) % cycle}
    )
    size = cut.groupBy(*keys, "cycle").agg(F.count(F.lit(1)).alias("_m"))
    keep = size.filter(F.col("_m") > cycle / 2).select(*keys, "cycle")
    return cut.join(keep, [*keys, "cycle"], "left_semi")
