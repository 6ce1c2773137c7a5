"""Queries on augmented windows: traces with their label runs as targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import replicate_sql
from ..operators import augment as X
from ..operators import segment as S
from ..schema import LANDMARKS_11 as L
from .fixtures import LABELS_SQL, labelled
from .registry import query
from .scoring import r6

POLICY = {
    "isolate_p": 0.3, "isolate_tail_ms": (10, 40), "stretch_p": 0.5, "stretch_alpha": (0.7, 1.8), "amplitude_p": 0.4, "context": {"none": 0.4, "pre_p": 0.3, "core_edge": 0.3},
    "mask_p": 0.5, "offset_jitter_ms": 9.0, "warp_pct": 3.0,
}


def windows(spark, sf):
    d = S.landmarks_from_labels(labelled(spark, sf), min_samples=2, kernel=5)
    return d.select(
        "record_id", "lead", "trace", S.mode_filter(F.col("labels"), 5).alias("target"), F.transform("trace", lambda v: F.lit(True)).alias("valid"),
        *[F.col(c).cast("double").alias(c) for c in L.order], F.lit(4).alias("win_lo"), F.lit(56).alias("win_hi"),
    )


@query("augmented_windows")
def augmented_windows(spark, sf):
    a = X.augment(windows(spark, sf), POLICY, ["record_id"], seed=5)
    a = a.select("record_id", "lead", "context", "fired_isolate", "fired_mask", F.aggregate("trace", F.lit(0.0), lambda s, v: s + v).alias("total"),
                 F.size(F.filter("target", lambda v: v.isNull())).alias("n_ignored"), "t_offset")
    return r6(a.withColumns({"fired_isolate": F.col("fired_isolate").cast("int")}), "total", "t_offset")


@query(
    "augmentation_draws",
    f"WITH {LABELS_SQL} SELECT DISTINCT record_id, round(({replicate_sql(5, ['record_id'], '1')} + 0.5::DOUBLE)/2147483647.0::DOUBLE, 8) AS u_iso, round(({replicate_sql(5, ['record_id'], '2')} + 0.5::DOUBLE)/2147483647.0::DOUBLE, 8) AS u_tail FROM labs",
)
def augmentation_draws(spark, sf):
    d = labelled(spark, sf).select("record_id").distinct()
    d = X.draws(d, ["u_iso", "u_tail"], ["record_id"], 5)
    return d.select("record_id", F.round("u_iso", 8).alias("u_iso"), F.round("u_tail", 8).alias("u_tail"))


@query("augmentation_rates")
def augmentation_rates(spark, sf):
    a = X.augment(windows(spark, sf), POLICY, ["record_id", "lead"], seed=5)
    return X.fired_rates(a, {"isolate": 0.3, "stretch": 0.5, "amplitude": 0.4})


@query(
    "boundary_weights",
    f"""WITH {LABELS_SQL}, e AS (SELECT *, (label <> lag(label) OVER w OR label <> lead(label) OVER w) AS edge FROM labs WINDOW w AS (PARTITION BY record_id, lead ORDER BY sample))
    SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, CASE WHEN bool_or(coalesce(edge, false)) OVER (PARTITION BY record_id, lead ORDER BY sample ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM e""",
)
def boundary_weights(spark, sf):
    w = labelled(spark, sf).select("record_id", "lead", X.boundary_weights(F.col("labels"), band=1).alias("w"))
    return w.select("record_id", "lead", F.posexplode("w").alias("sample", "w"))


@query(
    "left_edge_cut",
    f"WITH {LABELS_SQL} SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, round(CASE WHEN sample < 10 THEN 0 ELSE v END, 6) AS v FROM labs",
)
def left_edge_cut(spark, sf):
    d = windows(spark, sf).withColumn("win_lo", F.lit(12))
    x = X.left_edge(d, F.col("win_lo"), F.lit(2), F.lit(True))
    return r6(x.select("record_id", "lead", F.posexplode("trace").alias("sample", "v")), "v")


@query(
    "isolated_beats",
    f"""WITH {LABELS_SQL}, m AS (SELECT record_id, lead, median(v) AS lv FROM labs WHERE sample < 10 OR sample > 40 GROUP BY ALL)
    SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, round(CASE WHEN sample < 10 OR sample > 50 THEN 0 WHEN sample > 40 THEN lv ELSE v END, 6) AS v FROM labs JOIN m USING (record_id, lead)""",
)
def isolated_beats(spark, sf):
    x = X.isolate_beat(windows(spark, sf), F.lit(10), F.lit(40), F.lit(10), F.lit(True))
    return r6(x.select("record_id", "lead", F.posexplode("trace").alias("sample", "v")), "v")


@query(
    "quiet_tail_panels",
    f"""WITH {LABELS_SQL}, m AS (SELECT record_id, lead, median(v) AS lv FROM labs WHERE sample < 4 OR sample > 40 GROUP BY ALL), p AS (SELECT unnest([0.0, 20.0, 40.0])::DOUBLE AS tail_ms)
    SELECT record_id, lead, tail_ms, round(sum(CASE WHEN sample < 4 OR sample > 40 + tail_ms/2 THEN 0 WHEN sample > 40 THEN lv ELSE v END), 6) AS total FROM labs JOIN m USING (record_id, lead), p GROUP BY ALL""",
)
def quiet_tail_panels(spark, sf):
    x = X.quiet_tail_panels(windows(spark, sf).withColumn("win_hi", F.lit(40)), [0, 20, 40], "win_lo", "win_hi")
    return r6(x.select("record_id", "lead", "tail_ms", F.aggregate("trace", F.lit(0.0), lambda s, v: s + v).alias("total")), "total")


@query(
    "time_warped_labels",
    f"""WITH {LABELS_SQL} SELECT a.record_id, a.lead, CAST(a.sample AS INTEGER) AS sample, b.label FROM labs a JOIN labs b ON b.record_id = a.record_id AND b.lead = a.lead
      AND b.sample = CAST(round_even(least(63, a.sample/1.25::DOUBLE), 0) AS BIGINT)""",
)
def time_warped_labels(spark, sf):
    d = windows(spark, sf).drop("target").join(labelled(spark, sf).select("record_id", "lead", F.col("labels").alias("target")), ["record_id", "lead"])
    w = X.time_warp(d, F.lit(1.25))
    return w.select("record_id", "lead", F.posexplode("target").alias("sample", "label"))
