"""Exact, linearly interpolated quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Quantiles of few-valued columns (positions, whole ms): values are counted first.

    Only one row per distinct (key, value) is shuffled to the final aggregate, so a key with a
    third of all rows costs no more there than the number of positions a recording has.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    aggs = [F.percentile(value, float(p), F.col("_n")).alias(n) for p, n in zip(probs, names)]
    return counts.groupBy(*keys).agg(*aggs)


def running_counts(counts: DataFrame, keys: Sequence[str], value: str, count: str = "_c") -> DataFrame:
    """Distinct (keys, value, count) rows with ``_piece`` and ``_from``, the key's rows below the value.

    The order of (keys, value) is cut at sampled ranges, so a piece holds its share of the distinct values however they are spread: crowded
    values, outliers and a key with most of the rows only move the cuts. Counts run inside pieces; a piece's offset is a sum over the few pieces
    of its key.
    """
    keys = list(keys)
    cut = counts.select(*keys, value, count).repartitionByRange(*keys, value)
    # written once: the cuts are sampled, so they must not be drawn again by a later reader
    cut = materialise(cut.withColumn("_piece", F.spark_partition_id()))
    inner = W.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = cut.groupBy(*keys, "_piece").agg(F.sum(count).alias("_m"))
    offsets = pieces.select(*keys, "_piece", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_b"))
    run = cut.withColumn("_r", F.sum(count).over(inner) - F.col(count))
    return run.join(offsets, [*keys, "_piece"]).select(*keys, value, count, "_piece", "_b", (F.col("_b") + F.col("_r")).alias("_from"))


def refined_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles of continuous columns: rows (keys, level_no, level, value), exact and linearly interpolated.

    The running counts of the distinct values and the wanted ranks are two lists in one order, and they are merged: first against the pieces
    of the order, then inside each piece. Every wanted rank carries the last value that starts at or below it, so the work is the sum of both
    lists, not their product, and no task holds more than a piece of the values or one key's list of levels.
    """
    keys = list(keys)
    vals = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    run = running_counts(vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), keys, "_v")
    size = run.groupBy(*keys).agg(F.max(F.col("_from") + F.col("_c")).alias("_n"))
    levels = F.array(*[F.lit(float(p)) for p in probs])
    wanted = size.select(*keys, "_n", F.posexplode(levels).alias("_k", "level")).withColumn("_pos", (F.col("_n") - 1) * F.col("level"))
    wanted = wanted.select(*keys, "_k", "level", "_pos", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_at"))

    def carried(listed: DataFrame, asked: DataFrame, by: Sequence[str], what: str) -> DataFrame:
        """``asked`` rows with ``what`` of the last listed row of their group at or before their ``_at``."""
        both = listed.withColumn("_asks", F.lit(0)).unionByName(asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
        upto = W.partitionBy(*by).orderBy("_at", "_asks").rowsBetween(W.unboundedPreceding, W.currentRow)
        return both.withColumn(what, F.last(what, ignorenulls=True).over(upto)).filter("_asks = 1").drop("_asks")

    pieces = run.groupBy(*keys, "_piece").agg(F.min("_b").alias("_at"))
    placed = carried(pieces, wanted, keys, "_piece")
    hit = carried(run.select(*keys, "_piece", "_v", F.col("_from").alias("_at")), placed, [*keys, "_piece"], "_v")
    low, high = F.min_by("_v", "_at"), F.max_by("_v", "_at")
    frac = F.first("_pos") - F.floor(F.first("_pos"))
    return hit.groupBy(*keys, "_k", "level").agg((low + (high - low) * frac).alias(value)).select(*keys, F.col("_k").alias("level_no"), "level", value)


def ordered_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str, upper: bool = False, grain: int | None = 1 << 20, count: str | None = None,
) -> DataFrame:
    """Median of a whole-number column per key, for keys with very many distinct values.

    ``upper`` takes the upper of the two middle values instead of their mean; ``grain=None`` is for
    values with a small range, whose counts fit one window. ``count`` names a column that says how
    often a row's value occurs, where values have been counted (in parts, so a value may come again).

    Values are counted, then a running count along the value order (cut into pieces) finds the
    middle one or two; no aggregation buffer holds a key's values.
    """
    from .ordered import with_neighbours

    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull())
    if count:
        counts = counts.select(*keys, value, F.col(count).alias("_c"))
    if not count or grain is not None:
        counts = counts.groupBy(*keys, value).agg((F.sum("_c") if count else F.count(F.lit(1))).alias("_c"))
    if grain is None:
        total = F.sum("_c").over(W.partitionBy(*keys))
        run = with_neighbours(counts, keys, value, running={"_end": "_c"}, grain=None).withColumn("_n", total)
    else:
        n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n")) if count else df.groupBy(*keys).agg(F.count(value).alias("_n"))
        run = with_neighbours(counts, keys, value, running={"_end": "_c"}, grain=grain).join(n, keys)
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)

    def covers(k):
        return (F.col("_end") - F.col("_c") < k) & (k <= F.col("_end"))

    picked = run.groupBy(*keys).agg(
        F.max(F.when(covers(lo), F.col(value))).alias("_lo"), F.max(F.when(covers(hi), F.col(value))).alias("_hi")
    )
    middle = F.col("_hi") if upper else (F.col("_lo") + F.col("_hi")) / F.lit(2.0)
    return picked.select(*keys, middle.alias(name))
