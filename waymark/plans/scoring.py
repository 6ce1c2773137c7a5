"""Queries on confusion, landmark errors, comparisons and population statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import poisson_one_sql, replicate_sql
from ..operators import derive, infer, popstats as P, score as Z
from ..schema import LANDMARKS_11 as L
from .correction import BOOT
from .fixtures import BEATS_SQL, CONF_SQL, CORR_SQL, EVENTS_SQL, LM, TRACE_SQL, beats, corrections, events, judged, label_of, stored_units, table, traces, units
from .registry import SQL, query


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


CM_SQL = CONF_SQL + """, cm AS (SELECT lang, truth3 AS truth, pred3 AS pred, count(*) AS n FROM conf GROUP BY ALL),
 cl AS (SELECT unnest([0,1,2]) AS class), per AS (SELECT class, coalesce(sum(n) FILTER (truth = class AND pred = class), 0) AS tp,
   coalesce(sum(n) FILTER (truth = class), 0) AS support, coalesce(sum(n) FILTER (pred = class), 0) AS predicted FROM cm, cl GROUP BY class),
 met AS (SELECT class, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted,
   tp / nullif(predicted, 0) AS precision, tp / nullif(support, 0) AS recall, tp / nullif(support + predicted - tp, 0) AS iou FROM per),
 met2 AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM met)"""


@query("confusion_counts", f"WITH {CM_SQL} SELECT * FROM cm")
def confusion_counts(spark, sf):
    return Z.confusion(judged(spark, sf), "truth3", "pred3", ["lang"])


@query(
    "confusion_metrics",
    f"WITH {CM_SQL} SELECT class, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou FROM met2",
)
def confusion_metrics(spark, sf):
    m = Z.class_metrics(Z.confusion(judged(spark, sf), "truth3", "pred3"))
    return r6(m, "precision", "recall", "f1", "iou")


@query(
    "confusion_means",
    f"""WITH {CM_SQL} SELECT round(avg(iou) FILTER (class > 0), 6) AS mean_iou_waves, round(avg(f1) FILTER (class > 0), 6) AS mean_f1_waves,
     round(avg(iou), 6) AS mean_iou_all, round(sum(tp) / sum(support), 6) AS accuracy FROM met2""",
)
def confusion_means(spark, sf):
    m = Z.mean_class_metrics(Z.class_metrics(Z.confusion(judged(spark, sf), "truth3", "pred3")), [1, 2])
    return r6(m, *m.columns)


@query(
    "sequence_confusion",
    f"""WITH {TRACE_SQL}, s AS (SELECT CASE WHEN sample < 4 THEN NULL WHEN v < -0.1 THEN 1 WHEN v < 0 THEN 0 WHEN v < 0.1 THEN 2 ELSE 3 END AS truth,
      CASE WHEN v < -0.12 THEN 1 WHEN v < 0.01 THEN 0 WHEN v < 0.1 THEN 2 ELSE 3 END AS pred FROM trace)
    SELECT truth, pred, count(*) AS n FROM s WHERE truth IS NOT NULL GROUP BY ALL""",
)
def sequence_confusion(spark, sf):
    t = traces(spark, sf)
    t = t.withColumns(
        {
            "a": F.transform("trace", lambda v, i: F.when(i >= 4, label_of(v))),
            "b": F.transform("trace", lambda v: F.when(v < -0.12, 1).when(v < 0.01, 0).when(v < 0.1, 2).otherwise(3)),
        }
    )
    return Z.confusion(t, "a", "b", arrays=True)


# ---------------------------------------------------------------- landmark errors

ERR_SQL = CORR_SQL + ", err AS (SELECT u.record_id, u.lead, u.disease_class, unnest([" + ",".join(f"'{c}'" for c in LM) + "]) AS landmark, unnest([" + ",".join(
    f"c.{c}*2.0::DOUBLE" for c in LM
) + "]) AS pred_ms, unnest([" + ",".join(f"u.{c}*2.0::DOUBLE" for c in LM) + """]) AS truth_ms FROM units u JOIN corr c ON u.record_id = c.record_id AND u.lead = c.lead),
 e AS (SELECT *, pred_ms - truth_ms AS err_ms FROM err),
 det AS (SELECT landmark, count(*) FILTER (abs(err_ms) <= 25) AS tp,
   count(*) FILTER (abs(err_ms) > 25 OR (pred_ms IS NOT NULL AND truth_ms IS NULL)) AS fp,
   count(*) FILTER (abs(err_ms) > 25 OR (pred_ms IS NULL AND truth_ms IS NOT NULL)) AS fn, count(*) FILTER (pred_ms IS NULL AND truth_ms IS NULL) AS tn,
   count(err_ms) AS n_compared, count(truth_ms) AS n_truth, count(pred_ms) AS n_pred, avg(err_ms) AS bias_ms, avg(abs(err_ms)) AS mae_ms,
   stddev_samp(err_ms) AS sd_ms, """ + ", ".join(f"avg(CASE WHEN err_ms IS NOT NULL THEN CASE WHEN abs(err_ms) <= {t} THEN 1.0 ELSE 0.0 END END) AS within_{t}ms" for t in Z.TOLERANCES_MS) + """,
   stddev_samp(CASE WHEN err_ms IS NOT NULL THEN pred_ms END) AS predicted_sd_ms, stddev_samp(CASE WHEN err_ms IS NOT NULL THEN truth_ms END) AS reference_sd_ms,
   median(abs(err_ms)) AS median_abs_ms, quantile_cont(abs(err_ms), 0.95) AS p95_abs_ms,
   regr_slope(pred_ms, truth_ms) AS response_slope, corr(pred_ms, truth_ms) AS response_r FROM e GROUP BY landmark),
 summ AS (SELECT *, tp / nullif(tp + fn, 0) AS sensitivity, tp / nullif(tp + fp, 0) AS precision, n_compared / nullif(n_truth, 0) AS coverage FROM det),
 summ2 AS (SELECT *, 2 * sensitivity * precision / nullif(sensitivity + precision, 0) AS f1 FROM summ)"""
FLOATS = ["bias_ms", "mae_ms", "sd_ms", *[f"within_{t}ms" for t in Z.TOLERANCES_MS], "predicted_sd_ms", "reference_sd_ms", "median_abs_ms", "p95_abs_ms",
          "response_slope", "response_r", "sensitivity", "precision", "coverage", "f1"]
COUNTS = ["landmark", "tp", "fp", "fn", "tn", "n_compared", "n_truth", "n_pred"]


def _errors(spark, sf):
    u = stored_units(spark, sf)
    return Z.tidy_errors(corrections(spark, sf, u), u, extra=["disease_class"])


@query("landmark_errors", f"WITH {ERR_SQL} SELECT {','.join(COUNTS)}, " + ", ".join(f"round({c}, 6) AS {c}" for c in FLOATS) + " FROM summ2")
def landmark_errors(spark, sf):
    s = Z.landmark_errors(_errors(spark, sf))
    return s.select(*COUNTS, *[F.round(c, 6).alias(c) for c in FLOATS])


BND = "(" + ",".join(f"'{c}'" for c in L.boundaries) + ")"
PK = "(" + ",".join(f"'{c}'" for c in L.peaks) + ")"


@query(
    "macro_aggregate",
    f"""WITH {ERR_SQL} SELECT round(avg(mae_ms) FILTER (landmark IN {BND}), 6) AS boundary_mae_ms, round(avg(mae_ms) FILTER (landmark IN {PK}), 6) AS peak_mae_ms,
     round(avg(mae_ms), 6) AS all_mae_ms, round(avg(mae_ms) FILTER (landmark IN ('qrs_onset','qrs_offset')), 6) AS core_mae_ms FROM summ2""",
)
def macro_aggregate(spark, sf):
    m = Z.macro(Z.landmark_errors(_errors(spark, sf)), {"boundary": L.boundaries, "peak": L.peaks, "all": L.order, "core": ["qrs_onset", "qrs_offset"]})
    return r6(m, *m.columns)


@query(
    "micro_by_class",
    f"WITH {ERR_SQL} SELECT disease_class, count(err_ms) AS n_landmarks, round(avg(err_ms), 6) AS bias_ms, round(avg(abs(err_ms)), 6) AS mae_ms FROM e WHERE landmark IN {BND} GROUP BY 1",
)
def micro_by_class(spark, sf):
    return r6(Z.by_group(_errors(spark, sf), ["disease_class"], L.boundaries), "bias_ms", "mae_ms")


@query(
    "micro_by_channel",
    f"WITH {ERR_SQL} SELECT lead, count(err_ms) AS n_landmarks, round(avg(err_ms), 6) AS bias_ms, round(avg(abs(err_ms)), 6) AS mae_ms FROM e WHERE landmark IN {BND} GROUP BY 1",
)
def micro_by_channel(spark, sf):
    return r6(Z.by_group(_errors(spark, sf), ["lead"], L.boundaries), "bias_ms", "mae_ms")


BIO_SQL = CORR_SQL + ", bio AS (SELECT u.disease_class, unnest([" + ",".join(f"'{n}'" for n in derive.BIOMARKERS) + "]) AS biomarker, unnest([" + ",".join(
    f"((c.{a}-c.{b})-(u.{a}-u.{b}))*2.0::DOUBLE" for a, b in derive.BIOMARKERS.values()
) + "]) AS err_ms FROM units u JOIN corr c ON u.record_id = c.record_id AND u.lead = c.lead)"


@query(
    "biomarker_errors",
    f"""WITH {BIO_SQL} SELECT biomarker, count(*) AS n_total, count(err_ms) AS n_comparable, round(count(err_ms)/count(*), 6) AS coverage, round(avg(err_ms), 6) AS bias_ms,
     round(avg(abs(err_ms)), 6) AS mae_ms, round(stddev_samp(err_ms), 6) AS sd_ms, round(quantile_cont(abs(err_ms), 0.95), 6) AS p95_abs_ms FROM bio GROUP BY 1""",
)
def biomarker_errors(spark, sf):
    u = stored_units(spark, sf)
    s = Z.biomarker_summary(Z.biomarker_errors(corrections(spark, sf, u), u))
    return r6(s, "coverage", "bias_ms", "mae_ms", "sd_ms", "p95_abs_ms")


@query(
    "biomarkers",
    f"WITH {BEATS_SQL} SELECT record_id, lead, beat_id, " + ", ".join(f"round(({a}-{b})*1000.0::DOUBLE/fs_hz, 3) AS {n}_ms" for n, (a, b) in derive.BIOMARKERS.items()) + " FROM beats",
)
def biomarkers(spark, sf):
    return derive.biomarkers(beats(spark, sf)).select("record_id", "lead", "beat_id", *[f"{n}_ms" for n in derive.BIOMARKERS])


@query(
    "per_unit_errors",
    f"WITH {CORR_SQL} SELECT u.record_id, u.lead, CASE WHEN u.r_peak BETWEEN c.qrs_onset AND c.qrs_offset THEN 1 WHEN u.r_peak IS NOT NULL THEN 0 END AS anchor_in_core, "
    + ", ".join(f"c.{c} AS {c}_pred, u.{c} AS {c}_true, round((c.{c}-u.{c})*2.0::DOUBLE, 3) AS {c}_err_ms" for c in LM)
    + " FROM units u JOIN corr c ON u.record_id = c.record_id AND u.lead = c.lead",
)
def per_unit_errors(spark, sf):
    u = stored_units(spark, sf)
    return Z.per_unit_errors(corrections(spark, sf, u), u, anchor="r_peak")


@query(
    "geometry_audit",
    f"""WITH {CORR_SQL}, g AS (SELECT u.qrs_onset AS a, u.t_offset AS b, c.t_offset AS p, u.qrs_onset - 100 AS cs, u.qrs_onset + 140 AS we, u.qrs_onset + 160 AS re
      FROM units u JOIN corr c ON u.record_id = c.record_id AND u.lead = c.lead), d AS (SELECT *, we - b AS slack, (a + b)/2.0::DOUBLE - cs - 150 AS off FROM g)
    SELECT count(p) AS n_pred, count(*) FILTER (p = we) AS on_window_edge, count(*) FILTER (p > we) AS past_window_edge, count(*) FILTER (p = re) AS on_read_edge,
     count(*) FILTER (p > re) AS past_read_edge, CAST(median(slack) AS DOUBLE) AS window_slack_samples, median(off) AS centre_offset_samples,
     quantile_cont(off, 0.75) - quantile_cont(off, 0.25) AS centre_offset_iqr, CASE WHEN count(*) FILTER (p = re) > 0.05 * count(p) THEN 1 ELSE 0 END AS edge_warning,
     CASE WHEN median(slack) > 150 THEN 1 ELSE 0 END AS tail_warning FROM d""",
)
def geometry_audit(spark, sf):
    u = stored_units(spark, sf)
    p = corrections(spark, sf, u).select("record_id", "lead", F.col("t_offset").alias("p"))
    d = u.join(p, ["record_id", "lead"]).withColumns(
        {"cs": F.col("qrs_onset") - 100, "we": F.col("qrs_onset") + 140, "re": F.col("qrs_onset") + 160}
    )
    return Z.geometry_audit(d, "qrs_onset", "t_offset", "p", "cs", 300, "we", "re")


@query(
    "observability_cells",
    f"""WITH {CORR_SQL}, c AS (SELECT CASE WHEN u.lead % 2 = 0 THEN CASE WHEN u.p_peak IS NOT NULL THEN 'A' ELSE 'C' END ELSE CASE WHEN u.p_peak IS NOT NULL THEN 'B' ELSE 'D' END END AS cell,
      CASE WHEN (c.p_peak IS NOT NULL) = (u.p_peak IS NOT NULL) THEN 1.0 ELSE 0.0 END AS ok, CASE WHEN c.q_peak IS NOT NULL THEN 1.0 ELSE 0.0 END AS em
     FROM units u JOIN corr c ON u.record_id = c.record_id AND u.lead = c.lead)
    SELECT cell, count(*) AS n, round(avg(ok), 6) AS share_correct, round(avg(em), 6) AS share_emitting FROM c GROUP BY cell""",
)
def observability_cells(spark, sf):
    p = corrections(spark, sf).select("record_id", "lead", F.col("p_peak").alias("pp"), F.col("q_peak").alias("pq"))
    d = units(spark, sf).join(p, ["record_id", "lead"])
    d = d.withColumn("cell", Z.observability_cell(F.col("lead") % 2 != 0, F.col("p_peak").isNotNull()))
    out = Z.cell_rates(d, "cell", F.col("pp").isNotNull() == F.col("p_peak").isNotNull(), F.col("pq").isNotNull())
    return r6(out, "share_correct", "share_emitting")


@query(
    "worst_case_score",
    f"""WITH {ERR_SQL}, s AS (SELECT lead, avg(abs(err_ms)) AS mae, count(err_ms)/count(truth_ms) AS cov, regr_slope(pred_ms, truth_ms) AS sl FROM e WHERE landmark = 't_offset' GROUP BY lead)
    SELECT round(max(mae + 150*(1-cov) + 50*abs(1-sl)), 6) AS worst_score FROM s""",
)
def worst_case_score(spark, sf):
    s = Z.landmark_errors(_errors(spark, sf).filter("landmark = 't_offset'"), by=["lead"])
    return r6(Z.worst_case_score(s), "worst_score")


@query(
    "query_spread",
    f"""WITH {ERR_SQL}, u AS (SELECT landmark, record_id, stddev_samp(pred_ms) AS sd, count(DISTINCT pred_ms) AS m FROM e GROUP BY ALL)
    SELECT landmark, round(avg(sd), 6) AS mean_sd_ms, round(avg(CASE WHEN m > 1 THEN 1.0 ELSE 0.0 END), 6) AS share_moved, round(median(sd), 6) AS median_sd_ms FROM u GROUP BY landmark""",
)
def query_spread(spark, sf):
    # The channels of a record stand for the queries put to it.
    return r6(Z.query_spread(_errors(spark, sf), ["record_id"]), "mean_sd_ms", "share_moved", "median_sd_ms")


@query(
    "matched_ratio",
    f"""WITH {ERR_SQL}, m AS (SELECT landmark, avg(abs(err_ms)) FILTER (lead = 2) AS a, avg(abs(err_ms)) FILTER (lead <> 2) AS b FROM e GROUP BY landmark)
    SELECT landmark, round(a, 6) AS matched_mae_ms, round(b, 6) AS mismatched_mae_ms, round(b/nullif(a, 0), 6) AS ratio FROM m""",
)
def matched_ratio(spark, sf):
    return r6(Z.matched_ratio(_errors(spark, sf), F.col("lead") == 2), "matched_mae_ms", "mismatched_mae_ms", "ratio")


DEG_SQL = ERR_SQL + f""", q AS (SELECT record_id, lead AS asked, record_id % 7 + 1 AS own, avg(abs(err_ms)) AS mae FROM e WHERE landmark IN {BND} GROUP BY ALL),
 dg AS (SELECT a.own, a.asked, a.mae - b.mae AS d FROM q a JOIN q b ON a.record_id = b.record_id AND b.asked = b.own WHERE a.asked <> a.own)"""


@query("degradation_matrix", f"WITH {DEG_SQL} SELECT own, " + ", ".join(f"round(avg(d) FILTER (asked = {k}), 6) AS lead_{k}" for k in range(1, 8)) + " FROM dg GROUP BY own")
def degradation_matrix(spark, sf):
    e = _errors(spark, sf).filter(F.col("landmark").isin(L.boundaries))
    q = e.groupBy("record_id", F.col("lead").alias("asked")).agg(F.avg(F.abs("err_ms")).alias("mae")).withColumn("own", F.col("record_id") % 7 + 1)
    m = Z.degradation_matrix(Z.degradation(q, ["record_id"], "own", "asked", "mae"), "own", "asked", list(range(1, 8)))
    return m.select("own", *[F.col(str(k)).alias(f"lead_{k}") for k in range(1, 8)])


@query(
    "constant_predictor",
    f"""WITH {ERR_SQL}, m AS (SELECT landmark, median(truth_ms) AS med FROM e GROUP BY landmark)
    SELECT landmark, count(truth_ms) AS n, round(avg(abs(med - truth_ms)), 6) AS const_mae_ms, round(avg(abs(err_ms)), 6) AS model_mae_ms FROM e JOIN m USING (landmark) GROUP BY landmark""",
)
def constant_predictor(spark, sf):
    c = Z.constant_predictor(_errors(spark, sf))
    out = c.groupBy("landmark").agg(F.count("truth_ms").alias("n"), F.avg(F.abs("const_err_ms")).alias("const_mae_ms"), F.avg(F.abs("err_ms")).alias("model_mae_ms"))
    return r6(out, "const_mae_ms", "model_mae_ms")


@query(
    "fold_means",
    f"WITH {ERR_SQL} SELECT record_id % 4 AS fold, disease_class, count(err_ms) AS n, round(avg(abs(err_ms)), 6) AS mae_ms FROM e GROUP BY ALL",
)
def fold_means(spark, sf):
    return r6(Z.fold_means(_errors(spark, sf).withColumn("fold", F.col("record_id") % 4), ["fold", "disease_class"]), "mae_ms")


# ---------------------------------------------------------------- the text report

_PARTS = [
    ("Classes", "confusion_metrics", ["class", "precision", "recall", "f1", "iou", "support"]),
    ("Landmarks in ms", "landmark_errors", ["landmark", "bias_ms", "mae_ms", "sd_ms", "n_compared"]),
    ("Biomarkers in ms", "biomarker_errors", ["biomarker", "bias_ms", "mae_ms", "sd_ms", "coverage"]),
]
_WHOLE = {"class", "support", "landmark", "n_compared", "biomarker"}
_WIDE = 16


def _lines_sql() -> str:
    arms = []
    for number, (title, source, columns) in enumerate(_PARTS, start=1):
        head = "".join(c.rjust(_WIDE) for c in columns)
        cells = " || ".join(f"lpad(coalesce(" + (f"CAST({c} AS VARCHAR)" if c in _WHOLE else f"printf('%.3f', round({c}, 3))") + f", '--'), {_WIDE}, ' ')" for c in columns)
        arms.append(f"SELECT {number} AS part, 0 AS place, '{title}' AS line UNION ALL SELECT {number}, 1, '{head}' UNION ALL SELECT {number}, CAST(row_number() OVER (ORDER BY {columns[0]}) + 1 AS INTEGER), {cells} FROM ({SQL[source]}) s{number}")
    return " UNION ALL ".join(arms)


@query("score_report", _lines_sql())
def score_report(spark, sf):
    tables = {"confusion_metrics": confusion_metrics, "landmark_errors": landmark_errors, "biomarker_errors": biomarker_errors}
    return Z.report_lines([(title, tables[source](spark, sf), columns) for title, source, columns in _PARTS], _WIDE)


# ---------------------------------------------------------------- comparisons with clustered intervals


def cluster_sql(name: str, src: str, by: str, value: str, n: int, seed: int, units_mode: bool = False) -> str:
    s, k = ("sum(v)", "count(*)") if units_mode else ("avg(v)", "1")
    return f"""{name}_c AS (SELECT {by}, record_id, {s} AS s0, {k} AS n0 FROM (SELECT {by}, record_id, CAST({value} AS DOUBLE) AS v FROM {src} WHERE {value} IS NOT NULL) z GROUP BY {by}, record_id),
     {name}_r AS (SELECT *, {poisson_one_sql('u')} AS w FROM (SELECT c.*, rep, {replicate_sql(seed, ['record_id', '0'], 'rep')} AS u FROM {name}_c c, (SELECT unnest(range({n})) AS rep) q) z),
     {name}_s AS (SELECT {by}, rep, sum(s0*w)/nullif(sum(n0*w), 0) AS s FROM {name}_r GROUP BY {by}, rep),
     {name}_p AS (SELECT {by}, count(*) AS n_clusters, sum(s0)/sum(n0) AS point FROM {name}_c GROUP BY {by}),
     {name} AS (SELECT * FROM {name}_p JOIN (SELECT {by}, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM {name}_s GROUP BY {by}) i USING ({by}))"""


def _cluster_query(mode):
    def run(spark, sf):
        e = _errors(spark, sf).filter(F.col("landmark").isin(L.boundaries)).withColumn("a", F.abs("err_ms"))
        b = infer.cluster_bootstrap(e, ["landmark"], "a", "record_id", mode, BOOT, 1337)
        return r6(b, "point", "ci_lo", "ci_hi")

    return run


for _mode in ("record_mean", "units"):
    query(
        f"cluster_bootstrap_{_mode}",
        f"WITH {ERR_SQL}, ab AS (SELECT *, abs(err_ms) AS a FROM e WHERE landmark IN {BND}), "
        + cluster_sql("cb", "ab", "landmark", "a", BOOT, 1337, _mode == "units")
        + " SELECT landmark, n_clusters, round(point, 6) AS point, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi FROM cb",
    )(_cluster_query(_mode))


PAIR_SQL = ERR_SQL + """, two AS (SELECT record_id, disease_class, landmark, abs(err_ms) AS b, abs(err_ms - 8) AS m, abs(err_ms - 8) - abs(err_ms) AS d FROM e), """


@query(
    "compare_systems",
    f"WITH {PAIR_SQL}" + cluster_sql("cb", "two", "landmark", "b", BOOT, 1337) + ", " + cluster_sql("cm", "two", "landmark", "m", BOOT, 1337) + ", "
    + cluster_sql("cd", "two", "landmark", "d", BOOT, 1337)
    + """ SELECT landmark, cb.n_clusters, round(cb.point, 6) AS baseline_ms, round(cb.lo, 6) AS baseline_lo, round(cb.hi, 6) AS baseline_hi, round(cm.point, 6) AS model_ms,
     round(cm.lo, 6) AS model_lo, round(cm.hi, 6) AS model_hi, round(cd.point, 6) AS diff_ms, round(cd.lo, 6) AS diff_lo, round(cd.hi, 6) AS diff_hi,
     CASE WHEN cd.hi < 0 THEN 'model is closer' WHEN cd.lo > 0 THEN 'baseline is closer' ELSE 'no clear difference' END AS verdict FROM cb JOIN cm USING (landmark) JOIN cd USING (landmark)""",
)
def compare_systems(spark, sf):
    from ..session import materialise

    e = materialise(_errors(spark, sf).withColumn("m", F.col("err_ms") - 8))
    c = Z.compare(e, ["landmark"], "err_ms", "m", "record_id", BOOT)
    return r6(c, *[f"{a}_{b}" for a in ("baseline", "model", "diff") for b in ("ms", "lo", "hi")])


# The whole report: landmarks, the boundary aggregate and biomarkers, each on three splits.
REPORT_REPS = 400
_FIVE = ["qrs_onset", "qrs_offset", "t_onset", "t_peak", "t_offset"]
_EDGES = ["qrs_onset", "qrs_offset", "t_offset"]
_BIO = {"qrs_duration": ("qrs_onset", "qrs_offset"), "qt_interval": ("qrs_onset", "t_offset"), "t_peak_to_end": ("t_peak", "t_offset")}
_MATCHED = "disease_class IN ('BUILDING', 'MACHINERY')"


def _report_sql() -> str:
    def present(of: str) -> str:
        return "list_avg(list_filter([" + ", ".join(f"abs({of}_{k} - true_{k})" for k in _EDGES) + "], lambda x: x IS NOT NULL))"

    cells = [(k, f"base_{k} - true_{k}", f"model_{k} - true_{k}") for k in _FIVE] + [("boundary", present("base"), present("model"))]
    cells += [(n, *(f"({of}_{e} - true_{e}) - ({of}_{s} - true_{s})" for of in ("base", "model"))) for n, (s, e) in _BIO.items()]
    rows = " UNION ALL ".join(f"SELECT record_id, split, '{n}' AS measure, abs({b}) AS b, abs({m}) AS m FROM sp" for n, b, m in cells)
    wide = ", ".join(f"u.{k} * 2.0::DOUBLE AS true_{k}, c.{k} * 2.0::DOUBLE AS base_{k}, c.{k} * 2.0::DOUBLE - u.record_id % 9 AS model_{k}" for k in _FIVE)
    return f"""WITH {CORR_SQL}, w AS (SELECT u.record_id, u.disease_class, {wide} FROM units u JOIN corr c ON u.record_id = c.record_id AND u.lead = c.lead),
     sp AS (SELECT *, 'all' AS split FROM w UNION ALL SELECT *, 'matched' FROM w WHERE {_MATCHED} UNION ALL SELECT *, 'other' FROM w WHERE NOT {_MATCHED}), two AS (SELECT *, m - b AS d FROM ({rows}) z), """ \
        + ", ".join(cluster_sql(f"c{v}", "two", "split, measure", v, REPORT_REPS, 1337) for v in "bmd") + """
    SELECT split, measure, cb.n_clusters, round(cb.point, 6) AS baseline_ms, round(cb.lo, 6) AS baseline_lo, round(cb.hi, 6) AS baseline_hi, round(cm.point, 6) AS model_ms, round(cm.lo, 6) AS model_lo, round(cm.hi, 6) AS model_hi,
     round(cd.point, 6) AS diff_ms, round(cd.lo, 6) AS diff_lo, round(cd.hi, 6) AS diff_hi, CASE WHEN cd.hi < 0 THEN 'model is closer' WHEN cd.lo > 0 THEN 'baseline is closer' ELSE 'no clear difference' END AS verdict
    FROM cb JOIN cm USING (split, measure) JOIN cd USING (split, measure)"""


@query("compare_report", _report_sql())
def compare_report(spark, sf):
    u = stored_units(spark, sf)
    c = corrections(spark, sf, u).select("record_id", "lead", *[F.col(k).alias(f"c_{k}") for k in _FIVE])
    j = u.join(c, ["record_id", "lead"])
    wide = j.select("record_id", "disease_class", *[e for k in _FIVE for e in (
        (F.col(k) * 2.0).alias(f"true_{k}"), (F.col(f"c_{k}") * 2.0).alias(f"base_{k}"), (F.col(f"c_{k}") * 2.0 - F.col("record_id") % 9).alias(f"model_{k}"))])
    matched = F.expr(_MATCHED)
    rows = Z.comparison_rows(wide, "true_{}", "base_{}", "model_{}", _FIVE, _EDGES, _BIO, {"all": F.lit(True), "matched": matched, "other": ~matched})
    c = Z.compare(rows, ["split", "measure"], "base_err", "model_err", "record_id", REPORT_REPS)
    return r6(c, *[f"{a}_{b}" for a in ("baseline", "model", "diff") for b in ("ms", "lo", "hi")])


LADDER = [
    ("as read", ["qrs_onset", "qrs_offset", "t_offset"], {}),
    ("offset rule allowed for", ["qrs_onset", "qrs_offset", "t_offset"], {"t_offset": 8.0}),
    ("last boundary alone", ["t_offset"], {}),
    ("last boundary, offset rule allowed for", ["t_offset"], {"t_offset": 8.0}),
]


def _ladder_sql():
    arms = []
    for label, marks, offs in LADDER:
        m = "list_avg(list_filter([" + ",".join(f"abs(em_{x} - {offs.get(x, 0.0)})" for x in marks) + "], lambda x: x IS NOT NULL))"
        b = "list_avg(list_filter([" + ",".join(f"abs(eb_{x})" for x in marks) + "], lambda x: x IS NOT NULL))"
        arms.append(f"SELECT record_id, '{label}' AS step, {m} AS m, {b} AS b FROM wide")
    return " UNION ALL ".join(arms)


_LM3 = ("qrs_onset", "qrs_offset", "t_offset")


@query(
    "adjustment_ladder",
    f"WITH {CORR_SQL}, wide AS (SELECT u.record_id, " + ", ".join(f"(c.{x}-u.{x})*2.0::DOUBLE AS em_{x}, (c.{x}-u.{x})*2.0::DOUBLE + 3 AS eb_{x}" for x in _LM3)
    + f" FROM units u JOIN corr c ON u.record_id = c.record_id AND u.lead = c.lead), st AS ({_ladder_sql()}), sd AS (SELECT *, m - b AS d FROM st WHERE m IS NOT NULL AND b IS NOT NULL), "
    + cluster_sql("ld", "sd", "step", "d", BOOT, 1337, True)
    + """ SELECT step, round(avg(m), 6) AS model_ms, round(avg(b), 6) AS baseline_ms, max(n_clusters) AS n_clusters, round(max(point), 6) AS point, round(max(lo), 6) AS ci_lo, round(max(hi), 6) AS ci_hi,
     CASE WHEN max(hi) < 0 THEN 'model is closer' WHEN max(lo) > 0 THEN 'baseline is closer' ELSE 'no clear difference' END AS verdict FROM sd JOIN ld USING (step) GROUP BY step""",
)
def adjustment_ladder(spark, sf):
    u = stored_units(spark, sf)
    p = corrections(spark, sf, u).select("record_id", "lead", *[F.col(x).alias(f"p_{x}") for x in _LM3])
    w = u.join(p, ["record_id", "lead"])
    w = w.withColumns({f"em_{x}": (F.col(f"p_{x}") - F.col(x)) * 2.0 for x in _LM3} | {f"eb_{x}": (F.col(f"p_{x}") - F.col(x)) * 2.0 + 3 for x in _LM3})
    return r6(Z.adjustment_ladder(w, LADDER, "eb_{}", "em_{}", "record_id", BOOT), "model_ms", "baseline_ms", "point", "ci_lo", "ci_hi")


@query(
    "strict_pairing_check",
    f"WITH {CORR_SQL}, a AS (SELECT record_id, lead FROM units WHERE t_peak IS NOT NULL), b AS (SELECT record_id, lead FROM corr WHERE q_peak IS NOT NULL) "
    "SELECT a.record_id IS NULL AS x, coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.lead, b.lead) AS lead, CASE WHEN a.record_id IS NULL THEN 'second' ELSE 'first' END AS only_in "
    "FROM a FULL JOIN b ON a.record_id = b.record_id AND a.lead = b.lead WHERE a.record_id IS NULL OR b.record_id IS NULL".replace("a.record_id IS NULL AS x, ", ""),
)
def strict_pairing_check(spark, sf):
    return Z.strict_pairs(units(spark, sf).filter("t_peak is not null"), corrections(spark, sf).filter("q_peak is not null"), ["record_id", "lead"])


# ---------------------------------------------------------------- population statistics

FEATS = ["pdur_ms", "qrsdur_ms", "tdur_ms", "pr_ms", "qt_ms"]
_FEAT_SQL = ", ".join(f"CASE WHEN {derive.INTERVALS[f[:-3]][0]} - {derive.INTERVALS[f[:-3]][1]} > 0 THEN ({derive.INTERVALS[f[:-3]][0]} - {derive.INTERVALS[f[:-3]][1]})*2.0::DOUBLE END AS {f}" for f in FEATS)
SIG_SQL = BEATS_SQL + f", fe AS (SELECT disease_class, record_id, lead, {_FEAT_SQL} FROM beats), sig AS (SELECT disease_class, record_id, lead, " + ", ".join(f"median({f}) AS {f}" for f in FEATS) + " FROM fe GROUP BY ALL)"


def _signals(spark, sf):
    d = derive.derive_intervals(beats(spark, sf), positive_only=True)
    return P.per_signal_median(d, ["disease_class", "record_id", "lead"], FEATS)


@query("per_signal_median", f"WITH {SIG_SQL} SELECT * FROM sig")
def per_signal_median(spark, sf):
    return _signals(spark, sf)


@query(
    "cohort_summary",
    f"WITH {SIG_SQL} SELECT disease_class, lead, " + ", ".join(f"round(avg({f}), 6) AS {f}_mean, round(stddev_samp({f}), 6) AS {f}_std, count({f}) AS {f}_count" for f in FEATS) + " FROM sig GROUP BY ALL",
)
def cohort_summary(spark, sf):
    c = P.cohort_summary(_signals(spark, sf), ["disease_class", "lead"], FEATS)
    return r6(c, *[f"{f}_{s}" for f in FEATS for s in ("mean", "std")])


TIDY_SQL = SIG_SQL + ", ty AS (SELECT disease_class, lead, unnest([" + ",".join(f"'{f}'" for f in FEATS) + "]) AS feature, unnest([" + ",".join(FEATS) + "]) AS value FROM sig)"
CMP_SQL = TIDY_SQL + """, ours AS (SELECT lead, feature, avg(value) AS ours FROM ty GROUP BY ALL), refr AS (SELECT lead, feature, avg(value) AS reference FROM ty WHERE disease_class = 'BUILDING' GROUP BY ALL),
 cmp AS (SELECT * FROM ours JOIN refr USING (lead, feature))"""


def _comparison(spark, sf):
    # One class stands for the published table, whose rows are (channel, feature, mean).
    s = _signals(spark, sf)
    ref = P.tidy_features(s.filter("disease_class = 'BUILDING'"), ["lead"], FEATS).groupBy("lead", "feature").agg(F.avg("value").alias("mean"))
    return P.reference_comparison(s, ref, "lead", FEATS)


@query("reference_comparison", f"WITH {CMP_SQL} SELECT lead, feature, round(ours, 6) AS ours, round(reference, 6) AS reference, round(ours - reference, 1) AS delta FROM cmp")
def reference_comparison(spark, sf):
    return r6(_comparison(spark, sf), "ours", "reference")


@query(
    "reference_distance",
    f"WITH {CMP_SQL} SELECT round(avg(d), 6) AS distance, count(*) AS n_features FROM (SELECT feature, avg(abs(ours - reference)) AS d FROM cmp GROUP BY 1) z",
)
def reference_distance(spark, sf):
    return r6(P.reference_distance(_comparison(spark, sf)), "distance")


@query(
    "sign_agreement",
    f"WITH {CMP_SQL} SELECT feature, count(*) FILTER ((ours - 150 >= 0) = (reference - 150 >= 0)) AS n_agree, count(*) AS n_channels, round(avg(abs(ours - reference)), 6) AS mean_abs_diff FROM cmp GROUP BY 1",
)
def sign_agreement(spark, sf):
    c = _comparison(spark, sf).withColumns({"ours": F.col("ours") - 150, "reference": F.col("reference") - 150})
    return r6(P.sign_agreement(c), "mean_abs_diff")


@query(
    "class_shift",
    f"WITH {TIDY_SQL}, m AS (SELECT disease_class, lead, feature, avg(value) AS mean FROM ty GROUP BY ALL) SELECT m.disease_class, m.lead, m.feature, round(m.mean, 6) AS mean, round(m.mean - h.mean, 6) AS shift "
    "FROM m LEFT JOIN m h ON h.disease_class = 'BUILDING' AND h.lead = m.lead AND h.feature = m.feature",
)
def class_shift(spark, sf):
    return r6(P.class_shift(_signals(spark, sf), "disease_class", "lead", FEATS, "BUILDING"), "mean", "shift")


@query(
    "regression_line",
    f"WITH {SIG_SQL} SELECT disease_class, count(*) FILTER (qrsdur_ms IS NOT NULL AND qt_ms IS NOT NULL) AS n, round(corr(qt_ms, qrsdur_ms), 6) AS r, round(regr_slope(qt_ms, qrsdur_ms), 6) AS slope, "
    "round(regr_intercept(qt_ms, qrsdur_ms), 6) AS intercept FROM sig GROUP BY 1",
)
def regression_line(spark, sf):
    return r6(P.regression_line(_signals(spark, sf), "qrsdur_ms", "qt_ms", ["disease_class"]), "r", "slope", "intercept")


@query(
    "subset_grouping_sets",
    f"""WITH {ERR_SQL} SELECT CASE WHEN grouping(disease_class) = 1 THEN '*' ELSE disease_class END AS disease_class, CASE WHEN grouping(lead) = 1 THEN -1 ELSE lead END AS lead, count(err_ms) AS n, round(avg(abs(err_ms)), 6) AS mae_ms
    FROM e GROUP BY GROUPING SETS ((), (disease_class), (lead))""",
)
def subset_grouping_sets(spark, sf):
    g = _errors(spark, sf).groupingSets([[], ["disease_class"], ["lead"]], "disease_class", "lead").agg(
        F.grouping("disease_class").alias("gc"), F.grouping("lead").alias("gl"), F.count("err_ms").alias("n"), F.avg(F.abs("err_ms")).alias("mae_ms")
    )
    out = g.select(
        F.when(F.col("gc") == 1, "*").otherwise(F.col("disease_class")).alias("disease_class"), F.when(F.col("gl") == 1, -1).otherwise(F.col("lead")).alias("lead"), "n", "mae_ms"
    )
    return r6(out, "mae_ms")


@query(
    "kde_grid",
    f"""WITH {EVENTS_SQL}, s AS (SELECT channel, CASE WHEN stddev_pop(value) > 0 THEN 1.06::DOUBLE * stddev_pop(value) * pow(count(value)::DOUBLE, -0.2::DOUBLE) ELSE 1.0 END AS h, count(value) AS n FROM ev GROUP BY channel),
    g AS (SELECT unnest(range(300)) AS grid_no)
    SELECT channel, CAST(grid_no AS INTEGER) AS grid_no, round(grid_no*100.0::DOUBLE/299, 6) AS x, round(sum(exp(-0.5::DOUBLE*pow((grid_no*100.0::DOUBLE/299 - value)/h, 2)) / (n*h*sqrt(2*pi()))), 8) AS density
    FROM ev JOIN s USING (channel), g WHERE value IS NOT NULL GROUP BY ALL""",
)
def kde_grid(spark, sf):
    k = P.kde(events(spark, sf), "value", 0.0, 100.0, 300, ["channel"])
    return k.withColumns({"x": F.round("x", 6), "density": F.round("density", 8)})


@query(
    "gaussian_curves",
    f"""WITH {EVENTS_SQL}, s AS (SELECT channel, avg(value) AS m, stddev_samp(value) AS sd FROM ev GROUP BY channel), g AS (SELECT unnest(range(400)) AS grid_no)
    SELECT channel, CAST(grid_no AS INTEGER) AS grid_no, round(exp(-0.5::DOUBLE*pow((grid_no*100.0::DOUBLE/399 - m)/sd, 2)) / (sd*sqrt(2*pi())), 8) AS density FROM s, g""",
)
def gaussian_curves(spark, sf):
    s = events(spark, sf).groupBy("channel").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return P.gaussian_curve(s, "m", "sd", 0.0, 100.0, 400).select("channel", "grid_no", F.round("density", 8).alias("density"))


@query(
    "isoline_offset",
    f"""WITH {EVENTS_SQL}, s AS (SELECT channel, min(value) AS lo, max(value) AS hi, least(1024, count(value)) AS nb FROM ev GROUP BY channel),
    b AS (SELECT channel, lo, (hi - lo)/nb AS w, least(nb - 1, CAST(floor((value - lo)/((hi - lo)/nb)) AS BIGINT)) AS bin FROM ev JOIN s USING (channel)),
    h AS (SELECT channel, bin, min(lo) AS lo, min(w) AS w, count(*) AS n FROM b GROUP BY ALL)
    SELECT channel, round(lo + (bin + 0.5::DOUBLE)*w, 6) AS isoline FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, bin) AS k FROM h) z WHERE k = 1""",
)
def isoline_offset(spark, sf):
    return r6(P.isoline_offset(events(spark, sf), ["channel"], "value"), "isoline")


@query(
    "primary_channel_choice",
    f"""WITH {BEATS_SQL} SELECT record_id, beat_id, coalesce(max(CASE WHEN lead = 5 AND (t_offset-qrs_onset)*2 BETWEEN 150 AND 750 AND (qrs_offset-qrs_onset)*2 BETWEEN 20 AND 200 THEN t_offset-qrs_onset END),
      max(CASE WHEN lead = 6 AND (t_offset-qrs_onset)*2 BETWEEN 150 AND 750 AND (qrs_offset-qrs_onset)*2 BETWEEN 20 AND 200 THEN t_offset-qrs_onset END)) AS primary_qt FROM beats GROUP BY ALL""",
)
def primary_channel_choice(spark, sf):
    b = beats(spark, sf).withColumn("w", F.col("t_offset") - F.col("qrs_onset"))
    ok = (F.col("w") * 2).between(150, 750) & ((F.col("qrs_offset") - F.col("qrs_onset")) * 2).between(20, 200)
    return P.primary_channel(b, ["record_id", "beat_id"], "lead", [5, 6], "w", ok, out="primary_qt")


@query(
    "parameter_path_join",
    f"""WITH {SIG_SQL}, par AS (SELECT 'rec/' || CAST(c_custkey AS VARCHAR) AS path, c_acctbal AS apd FROM customer), pth AS (SELECT 'rec/' || CAST(c_custkey AS VARCHAR) AS path, c_custkey AS record_id FROM customer)
    SELECT disease_class, count(*) AS n, round(corr(qt_ms, apd), 6) AS r FROM par JOIN pth USING (path) JOIN sig USING (record_id) WHERE lead = 2 GROUP BY 1""",
)
def parameter_path_join(spark, sf):
    c = table(spark, sf, "customer").withColumn("path", F.concat(F.lit("rec/"), F.col("c_custkey").cast("string")))
    j = P.join_parameters(
        c.select("path", F.col("c_acctbal").alias("apd")), c.select("path", F.col("c_custkey").alias("record_id")), _signals(spark, sf).filter("lead = 2")
    )
    return r6(j.groupBy("disease_class").agg(F.count(F.lit(1)).alias("n"), F.corr("apd", "qt_ms").alias("r")), "r")
