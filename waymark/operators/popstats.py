"""Population statistics, and their distance to a published reference table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import attach


def per_signal_median(df: DataFrame, keys: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """Exact median of every feature per signal, absent values skipped."""
    return df.groupBy(*keys).agg(*[F.median(f).alias(f) for f in feats])


def cohort_summary(df: DataFrame, keys: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """mean, sample SD and count of the present values."""
    aggs = []
    for f in feats:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.stddev_samp(f).alias(f"{f}_std"), F.count(f).alias(f"{f}_count")]
    return df.groupBy(*keys).agg(*aggs)


def tidy_features(df: DataFrame, keys: Sequence[str], feats: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats])
    return df.select(*keys, F.inline(cells))


def reference_comparison(signals: DataFrame, reference: DataFrame, channel: str, feats: Sequence[str]) -> DataFrame:
    """Our mean next to the reference mean per channel and feature, with the rounded difference.

    ``reference`` has (channel, feature, mean).
    """
    ours = tidy_features(signals, [channel], feats).groupBy(channel, "feature").agg(F.avg("value").alias("ours"))
    j = ours.join(reference.withColumnRenamed("mean", "reference"), [channel, "feature"])
    return j.withColumn("delta", F.round(F.col("ours") - F.col("reference"), 1))


def reference_distance(comparison: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute distance over channels per feature, then over features."""
    per = comparison.groupBy(*by, "feature").agg(F.avg(F.abs(F.col("ours") - F.col("reference"))).alias("_d"))
    return per.groupBy(*by).agg(F.avg("_d").alias("distance"), F.count(F.lit(1)).alias("n_features"))


def sign_agreement(comparison: DataFrame) -> DataFrame:
    """How many channels agree with the reference in sign, and the mean absolute difference."""
    same = (F.col("ours") >= 0) == (F.col("reference") >= 0)
    return comparison.groupBy("feature").agg(
        F.count_if(same).alias("n_agree"), F.count(F.lit(1)).alias("n_channels"),
        F.avg(F.abs(F.col("ours") - F.col("reference"))).alias("mean_abs_diff"),
    )


def class_shift(signals: DataFrame, class_col: str, channel: str, feats: Sequence[str], healthy: str) -> DataFrame:
    """Class mean minus the healthy class's mean on the same channel."""
    m = tidy_features(signals, [class_col, channel], feats).groupBy(class_col, channel, "feature").agg(F.avg("value").alias("mean"))
    base = m.filter(F.col(class_col) == healthy).select(channel, "feature", F.col("mean").alias("_h"))
    j = m.join(base, [channel, "feature"], "left")
    return j.withColumn("shift", F.col("mean") - F.col("_h")).drop("_h")


def regression_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson r and the least-squares line of y on x."""
    return df.groupBy(*by).agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.corr(x, y).alias("r"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
    )


def kde(df: DataFrame, value: str, lo: float, hi: float, points: int = 300, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density on a grid, bandwidth 1.06 * population SD * n^(-1/5) (1 if SD is 0).

    Equal values are counted first; each distinct value then adds its share to every grid point in
    a map-side sum, so what is shuffled is one row per task and grid point.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    stats = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.stddev_pop(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    h = F.when(F.col("_s") > 0, F.lit(1.06) * F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).otherwise(1.0)
    stats = stats.select(*by, "_n", h.alias("_h"))
    j = rows.join(stats, by) if by else rows.crossJoin(F.broadcast(stats))
    step = (hi - lo) / (points - 1)
    g = j.withColumn("grid_no", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    u = (F.lit(lo) + F.col("grid_no") * F.lit(step) - F.col(value)) / F.col("_h")
    w = F.col("_c") * F.exp(F.lit(-0.5) * u * u) / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    out = g.groupBy(*by, "grid_no").agg(F.sum(w).alias("density"))
    return out.withColumn("x", F.lit(lo) + F.col("grid_no") * F.lit(step))


def gaussian_curve(stats: DataFrame, mean: str, sd: str, lo: float, hi: float, points: int = 400) -> DataFrame:
    """The normal density of every (mean, sd) row on a grid."""
    step = (hi - lo) / (points - 1)
    x = F.lit(lo) + F.col("grid_no") * F.lit(step)
    g = stats.withColumn("grid_no", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    u = (F.col("x") - F.col(mean)) / F.col(sd)
    return g.withColumn("density", F.exp(F.lit(-0.5) * u * u) / (F.col(sd) * F.lit(math.sqrt(2 * math.pi))))


def isoline_offset(df: DataFrame, keys: Sequence[str], value: str, max_bins: int = 1024) -> DataFrame:
    """Centre of the fullest of min(max_bins, n) equal bins per channel (the first on a tie)."""
    keys = list(keys)
    d = attach(df.filter(F.col(value).isNotNull()), keys, F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    bins = F.least(F.lit(max_bins), F.col("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width > 0, F.least(bins - 1, F.floor((F.col(value) - F.col("_lo")) / width))).otherwise(F.lit(0))
    hist = d.withColumns({"_bin": b.cast("bigint"), "_w": width}).groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_m"), F.min("_lo").alias("_lo"), F.min("_w").alias("_w")
    )
    centre = F.col("_lo") + (F.col("_bin") + F.lit(0.5)) * F.col("_w")
    return hist.groupBy(*keys).agg(F.min_by(centre, F.struct(-F.col("_m"), F.col("_bin"))).alias("isoline"))


def primary_channel(df: DataFrame, keys: Sequence[str], channel: str, order: Sequence, value: str, ok, out: str = "primary") -> DataFrame:
    """The value on the first listed channel whose readings are plausible, else NULL."""
    picks = [F.max(F.when((F.col(channel) == c) & ok, F.col(value))) for c in order]
    return df.groupBy(*keys).agg(F.coalesce(*picks).alias(out))


def join_parameters(params: DataFrame, paths: DataFrame, features: DataFrame, on: Mapping[str, str] | None = None) -> DataFrame:
    """Parameters by file path, then features by the record the path belongs to."""
    keys = list(on or {"record_id": "record_id"})
    return params.join(paths, "path").join(features, keys)
