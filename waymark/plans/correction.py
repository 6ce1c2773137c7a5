"""Queries on residuals, offsets, samples, splits and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import draw_sql, poisson_table_sql, replicate_sql
from ..functions import scalar as S
from ..operators import consensus as C
from ..operators import corpus as K
from ..operators import debias as D
from ..operators import derive, infer, qc, review
from ..operators.ordered import keep_first
from ..schema import LANDMARKS_11 as L
from ..session import materialise, shared_folder
from ..sources import clustered
from .fixtures import BEATS_SQL, CORR_SQL, LM, UNITS_SQL, beats, correction_feed, corrections, stored_units, table, units
from .quality import QC_SQL
from .reconcile import LAST_SQL
from .registry import query

BOOT = 5000
POWERS = 13  # the SQL twins' table of Poisson thresholds covers counts of equal values below 2 ** 13


def boot_sql(name: str, src: str, by: str, value: str, ids: list[str], n: int, seed: int, stat: str = "median") -> str:
    """Common table expressions ending in ``name`` (by, n, point, lo, hi): equal values are counted, each power of two in a count draws once."""
    u = replicate_sql(seed, ["round(v * 1e6)", "b"], "rep")
    if stat == "median":
        reps = f"""SELECT {by}, rep, (min(v) FILTER (upto > (total - 1) // 2) + min(v) FILTER (upto > total // 2)) / 2 AS s FROM (SELECT {by}, rep, v,
      sum(w) OVER (PARTITION BY {by}, rep ORDER BY v) AS upto, sum(w) OVER (PARTITION BY {by}, rep) AS total FROM {name}_r) z WHERE total > 0 GROUP BY {by}, rep"""
        point = "median"
    else:
        reps = f"SELECT {by}, rep, sum(v * w) / sum(w) AS s FROM {name}_r GROUP BY {by}, rep HAVING sum(w) > 0"
        point = "avg"
    return f"""{name}_c AS (SELECT {by}, v, count(*) AS c FROM (SELECT {by}, CAST({value} AS DOUBLE) AS v FROM {src} WHERE {value} IS NOT NULL) z GROUP BY {by}, v),
     {name}_b AS (SELECT {by}, v, b FROM {name}_c, (SELECT unnest(range({POWERS})) AS b) q WHERE (c >> b) & 1 = 1),
     {name}_u AS (SELECT *, {u} AS u FROM {name}_b, (SELECT unnest(range({n})) AS rep) q),
     {name}_r AS (SELECT {by}, rep, v, sum(k) AS w FROM {name}_u d ASOF JOIN ({poisson_table_sql(POWERS)}) t ON d.b = t.b AND d.u >= t.lo GROUP BY {by}, rep, v),
     {name}_s AS ({reps}), {name}_i AS (SELECT {by}, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM {name}_s GROUP BY {by}),
     {name}_p AS (SELECT {by}, count(*) AS n, {point}(CAST({value} AS DOUBLE)) AS point FROM {src} WHERE {value} IS NOT NULL GROUP BY {by}),
     {name} AS (SELECT p.*, CASE WHEN n >= 8 THEN lo END AS lo, CASE WHEN n >= 8 THEN hi END AS hi FROM {name}_p p LEFT JOIN {name}_i USING ({by}))"""


_NAMES = "unnest([" + ",".join(f"'{c}'" for c in LM) + "]) AS fiducial"


def res_sql(ref: str = "units", rev: str = "rev", name: str = "res") -> str:
    return (
        f", {name}0 AS (SELECT u.record_id, u.lead, u.disease_class, {_NAMES}, unnest([" + ",".join(f"u.{c}*2.0::DOUBLE" for c in LM)
        + "]) AS ref_ms, unnest([" + ",".join(f"c.{c}*2.0::DOUBLE" for c in LM) + f"]) AS rev_ms FROM {ref} u JOIN {rev} c "
        f"ON u.record_id = c.record_id AND u.lead = c.lead), {name} AS (SELECT *, rev_ms - ref_ms AS residual_ms, "
        "ref_ms IS NULL AS absent_ref, rev_ms IS NULL AS absent_rev, coalesce(abs(rev_ms - ref_ms) <= 200, false) AS usable, "
        f"coalesce(abs(rev_ms - ref_ms) > 200, false) AS outlier FROM {name}0)"
    )


RES_SQL = LAST_SQL + res_sql()


def _residuals(spark, sf, u=None):
    u = stored_units(spark, sf) if u is None else u
    return D.pair_residuals(u, review.latest_corrections(correction_feed(spark, sf, u)))


@query(
    "residual_unpivot",
    f"WITH {RES_SQL} SELECT record_id, lead, fiducial, residual_ms, CASE WHEN usable THEN 1 ELSE 0 END AS usable, "
    "CASE WHEN outlier THEN 1 ELSE 0 END AS outlier FROM res",
)
def residual_unpivot(spark, sf):
    r = _residuals(spark, sf)
    return r.select(
        "record_id", "lead", "fiducial", "residual_ms", F.col("usable").cast("int").alias("usable"), F.col("outlier").cast("int").alias("outlier")
    )


@query(
    "review_coverage",
    f"""WITH {LAST_SQL} SELECT (SELECT count(*) FROM units) AS n_reference, count(*) AS n_paired, CAST(0 AS BIGINT) AS n_unknown,
     round(count(*) / (SELECT count(*) FROM units), 6) AS coverage,
     CASE WHEN round(count(*) / (SELECT count(*) FROM units), 6) < 0.95 THEN 1 ELSE 0 END AS low_coverage FROM rev JOIN units USING (record_id, lead)""",
)
def review_coverage(spark, sf):
    u = stored_units(spark, sf)
    return D.review_coverage(u, review.latest_corrections(correction_feed(spark, sf, u)))


@query(
    "fit_offsets_grouping_sets",
    f"""WITH {RES_SQL} SELECT CASE WHEN grouping(disease_class) = 1 THEN 'global' ELSE 'class' END AS scope,
     CASE WHEN grouping(disease_class) = 1 THEN 'ALL' ELSE disease_class END AS scope_class, fiducial,
     CASE WHEN fiducial LIKE '%set' THEN 1 ELSE 0 END AS is_boundary, count(*) FILTER (usable) AS n, count(*) FILTER (outlier) AS n_outlier,
     count(*) FILTER (absent_ref) AS n_absent_ref, count(*) FILTER (absent_rev) AS n_absent_rev,
     round(avg(abs(residual_ms)) FILTER (usable), 2) AS mae_before_ms
    FROM res GROUP BY GROUPING SETS ((fiducial), (fiducial, disease_class))""",
)
def fit_offsets_grouping_sets(spark, sf):
    return D.offset_table(_residuals(spark, sf))


SCOPED_SQL = """, sc AS (SELECT record_id, lead, 'global' AS scope, 'ALL' AS scope_class, fiducial, residual_ms FROM res WHERE usable
  UNION ALL SELECT record_id, lead, 'class', disease_class, fiducial, residual_ms FROM res WHERE usable)"""
FIT_SQL = RES_SQL + SCOPED_SQL + ", " + boot_sql("ob", "sc", "scope, scope_class, fiducial", "residual_ms", ["record_id", "lead"], BOOT, 20260725) + """,
 fit AS (SELECT ob.*, CASE WHEN lo > 0 OR hi < 0 THEN 1 ELSE 0 END AS nonzero FROM ob),
 aft AS (SELECT scope, scope_class, fiducial, round(avg(abs(residual_ms)), 2) AS mae_before_ms, round(avg(abs(residual_ms - point)), 2) AS mae_after_ms
  FROM sc JOIN ob USING (scope, scope_class, fiducial) GROUP BY ALL)"""


@query(
    "fit_offsets",
    f"""WITH {FIT_SQL} SELECT scope, scope_class, fiducial, n, round(point, 2) AS offset_ms, round(lo, 2) AS ci_lo_ms, round(hi, 2) AS ci_hi_ms, nonzero,
     mae_before_ms, mae_after_ms FROM fit JOIN aft USING (scope, scope_class, fiducial)""",
)
def fit_offsets(spark, sf):
    return D.fit_offsets(_residuals(spark, sf), n_boot=BOOT).select(
        "scope", "scope_class", "fiducial", "n", "offset_ms", "ci_lo_ms", "ci_hi_ms", "nonzero", "mae_before_ms", "mae_after_ms"
    )


HALF_SQL = RES_SQL + """, ents AS (SELECT DISTINCT record_id, disease_class FROM units),
 halves AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY disease_class ORDER BY record_id) - 1) % 2 = 0 THEN 'calibration' ELSE 'test' END AS split FROM ents),
 cal AS (SELECT r.* FROM res r JOIN halves h USING (record_id) WHERE split = 'calibration'),
 tst AS (SELECT r.record_id, r.lead, r.disease_class, fiducial, residual_ms FROM res r JOIN halves h USING (record_id) WHERE split = 'test' AND usable),
 og AS (SELECT fiducial, round(median(residual_ms), 2) AS og FROM cal WHERE usable GROUP BY 1),
 oc AS (SELECT fiducial, disease_class, round(median(residual_ms), 2) AS oc FROM cal WHERE usable GROUP BY 1, 2)"""


def _halves(spark, sf):
    ents = materialise(units(spark, sf).select("record_id", "disease_class").distinct())
    return K.alternate_split(ents, ["disease_class"], "record_id")


@query("calibration_test_halves", f"WITH {HALF_SQL} SELECT record_id, disease_class, split FROM halves")
def calibration_test_halves(spark, sf):
    return _halves(spark, sf)


def _offsets_of(res):
    """Medians per scope, as the validation needs them (the fit query shows their intervals)."""
    from ..operators.quantiles import grouped_quantiles

    by = ["scope", "scope_class", "fiducial"]
    q = grouped_quantiles(D.scoped(res.filter("usable")), by, "residual_ms", [0.5], ["offset_ms"])
    return q.withColumn("offset_ms", F.round("offset_ms", 2))


VALID_SQL = HALF_SQL + """, vr AS (SELECT t.*, coalesce(og, 0.0) AS og, coalesce(oc, og, 0.0) AS oc FROM tst t LEFT JOIN og USING (fiducial) LEFT JOIN oc USING (fiducial, disease_class)), """ \
    + boot_sql("vb", "vr", "fiducial", "residual_ms", ["record_id", "lead"], BOOT, 101) + ", vg AS (SELECT *, residual_ms - og AS rg FROM vr), " \
    + boot_sql("vc", "vg", "fiducial, disease_class", "rg", ["record_id", "lead"], BOOT, 202) + """,
 ln AS (SELECT fiducial, count(*) FILTER (n >= 12 AND coalesce((lo > 0 OR hi < 0) AND abs(point) >= 2, false)) AS k FROM vc GROUP BY 1),
 pl AS (SELECT fiducial, CASE WHEN NOT coalesce((lo > 0 OR hi < 0) AND abs(point) >= 2, false) THEN 'none' WHEN k >= 2 THEN 'class' ELSE 'global' END AS plan
  FROM vb JOIN ln USING (fiducial)),
 vu AS (SELECT *, abs(residual_ms - used) - abs(residual_ms) AS dd FROM (SELECT vr.*, plan, CASE plan WHEN 'class' THEN oc WHEN 'global' THEN og ELSE 0.0 END AS used
  FROM vr JOIN pl USING (fiducial)) z), """ + boot_sql("vd", "vu", "fiducial", "dd", ["record_id", "lead"], BOOT, 303, "mean") + """,
 de AS (SELECT fiducial, CASE WHEN plan <> 'none' AND coalesce(lo > 0, false) THEN 'none' ELSE plan END AS adopted,
   CASE WHEN plan <> 'none' AND coalesce(lo > 0, false) THEN 1 ELSE 0 END AS vetoed FROM pl JOIN vd USING (fiducial)),
 ou AS (SELECT fiducial, adopted, vetoed, CASE adopted WHEN 'class' THEN disease_class ELSE 'ALL' END AS scope_class, residual_ms,
   residual_ms - CASE adopted WHEN 'none' THEN 0.0 ELSE used END AS after_ms,
   CASE adopted WHEN 'class' THEN oc WHEN 'global' THEN og ELSE 0.0 END AS val FROM vu JOIN de USING (fiducial)),
 validated AS (SELECT fiducial, adopted AS scope, scope_class, vetoed, round(max(val), 2) AS offset_ms, count(*) AS n_test, round(median(residual_ms), 2) AS bias_before_ms,
   round(median(after_ms), 2) AS bias_after_ms, round(avg(abs(residual_ms)), 2) AS mae_before_ms, round(avg(abs(after_ms)), 2) AS mae_after_ms
  FROM ou GROUP BY ALL)"""


def _validated(spark, sf):
    res, halves = _residuals(spark, sf), _halves(spark, sf).select("record_id", "split")
    r = materialise(res.join(halves, "record_id"))
    return D.validate_offsets(
        r.filter("split = 'test'"), _offsets_of(r.filter("split = 'calibration'")), n_boot=BOOT
    )


@query("validate_offsets", f"WITH {VALID_SQL} SELECT * FROM validated")
def validate_offsets(spark, sf):
    return _validated(spark, sf)


def cv_sql(n: int) -> str:
    return RES_SQL + """, og AS (SELECT fiducial, round(median(residual_ms), 2) AS og FROM res WHERE usable GROUP BY 1),
 oc AS (SELECT fiducial, disease_class, round(median(residual_ms), 2) AS oc FROM res WHERE usable GROUP BY 1, 2),
 xr AS (SELECT r.record_id, r.lead, disease_class, fiducial, residual_ms, og, coalesce(oc, og) AS oc,
   (row_number() OVER (PARTITION BY fiducial, disease_class ORDER BY """ + draw_sql(1000, "record_id", "lead") + """, record_id, lead) - 1) % 5 AS fold
  FROM res r LEFT JOIN og USING (fiducial) LEFT JOIN oc USING (fiducial, disease_class) WHERE usable),
 tn AS (SELECT xr.*, kf FROM xr, (SELECT unnest(range(5)) AS kf) k WHERE fold <> kf), """ \
    + boot_sql("xb", "tn", "fiducial, kf", "residual_ms", ["record_id", "lead"], n, 1000) + """,
 xl AS (SELECT tn.*, residual_ms - point AS rg FROM tn JOIN xb USING (fiducial, kf)), """ \
    + boot_sql("xc", "xl", "fiducial, kf, disease_class", "rg", ["record_id", "lead"], n, 2000) + """,
 nl AS (SELECT fiducial, kf, count(*) FILTER (n >= 12 AND coalesce((lo > 0 OR hi < 0) AND abs(point) >= 2, false)) AS k FROM xc GROUP BY ALL),
 vo AS (SELECT fiducial, kf, point AS og_k, CASE WHEN NOT coalesce((lo > 0 OR hi < 0) AND abs(point) >= 2, false) THEN 'none' WHEN k >= 2 THEN 'class' ELSE 'global' END AS vote
  FROM xb JOIN nl USING (fiducial, kf)),
 ok AS (SELECT fiducial, kf, disease_class, median(residual_ms) AS oc_k FROM tn GROUP BY ALL),
 te AS (SELECT *, abs(residual_ms - used) - abs(residual_ms) AS dd FROM (SELECT xr.*, CASE vote WHEN 'class' THEN coalesce(oc_k, og_k) WHEN 'global' THEN og_k ELSE 0.0 END AS used
   FROM xr JOIN vo ON vo.fiducial = xr.fiducial AND vo.kf = xr.fold LEFT JOIN ok ON ok.fiducial = xr.fiducial AND ok.kf = xr.fold AND ok.disease_class = xr.disease_class) z), """ \
    + boot_sql("xd", "te", "fiducial", "dd", ["record_id", "lead"], n, 1202, "mean") + """,
 ty AS (SELECT fiducial, CASE WHEN count(*) FILTER (vote = 'class') > 2 THEN 'class' WHEN count(*) FILTER (vote = 'global') > 2 THEN 'global' ELSE 'none' END AS plan FROM vo GROUP BY 1),
 de AS (SELECT fiducial, plan <> 'none' AND (fiducial = 'q_peak' OR coalesce(lo > 0, false)) AS v, plan FROM ty JOIN xd USING (fiducial)),
 ou AS (SELECT fiducial, CASE WHEN v THEN 'none' ELSE plan END AS adopted, CASE WHEN v THEN 1 ELSE 0 END AS vetoed, disease_class, residual_ms, used, og, oc FROM te JOIN de USING (fiducial))
 SELECT fiducial, adopted AS scope, CASE adopted WHEN 'class' THEN disease_class ELSE 'ALL' END AS scope_class, vetoed,
   round(max(CASE adopted WHEN 'class' THEN oc WHEN 'global' THEN og ELSE 0.0 END), 2) AS offset_ms, count(*) AS n_test, round(median(residual_ms), 2) AS bias_before_ms,
   round(median(residual_ms - CASE adopted WHEN 'none' THEN 0.0 ELSE used END), 2) AS bias_after_ms, round(avg(abs(residual_ms)), 2) AS mae_before_ms,
   round(avg(abs(residual_ms - CASE adopted WHEN 'none' THEN 0.0 ELSE used END)), 2) AS mae_after_ms FROM ou GROUP BY ALL"""


# No SQL twin: at 5,000 replicates it lays out a thousand million rows. tests/test_bootstrap.py compares both at fewer replicates.
@query("crossvalidate_offsets")
def crossvalidate_offsets(spark, sf, n_boot=BOOT):
    r = materialise(_residuals(spark, sf))
    return D.crossvalidate_offsets(r, _offsets_of(r), n_boot=n_boot)


@query("crossvalidate_offsets_few", "WITH " + cv_sql(60))
def crossvalidate_offsets_few(spark, sf):
    """The same at few replicates, which another engine can replay."""
    return crossvalidate_offsets(spark, sf, 60)


@query(
    "fold_offset_spread",
    f"WITH {cv_sql(1).split(',' + chr(10) + ' tn AS')[0]}, m AS (SELECT fiducial, kf, median(residual_ms) AS m FROM xr, (SELECT unnest(range(5)) AS kf) k WHERE fold <> kf GROUP BY ALL) "
    "SELECT fiducial, min(m) AS lowest_ms, max(m) AS highest_ms, max(m) - min(m) AS spread_ms FROM m GROUP BY fiducial",
)
def fold_offset_spread(spark, sf):
    return D.fold_spread(_residuals(spark, sf))


# ---- applying: the offsets of the calibration half, globally for the core onset, per class for the last offset


def _plan(spark, sf, u):
    """An offset table with one global and one per-class correction, from the reviewed sample."""
    o = materialise(_offsets_of(_residuals(spark, sf, u)))
    return o.filter(
        "(fiducial = 'qrs_onset' and scope = 'global') or (fiducial = 't_offset' and scope = 'class')"
    ).withColumn("offset_ms", -F.col("offset_ms") - 7.0)


def _ranked_sql(src: str, pins: list[str]) -> str:
    """Forward and backward pass over long rows, as recursions over the landmark's place."""
    pin = [c for c in LM if c in L.peaks or c in pins]
    out, run, names = "", "NULL", LM
    cur = src
    for direction, fn, op in (("f", "greatest", "<"), ("b", "least", ">")):
        seq = names if direction == "f" else list(reversed(names))
        first = True
        for c in seq:
            nxt = f"{direction}_{c}"
            run = "CAST(NULL AS DOUBLE)" if first else "run"
            moved = c if c in pin else f"CASE WHEN {c} {op} {run} THEN {run} ELSE {c} END"
            body = f"* EXCLUDE (run) REPLACE ({moved} AS {c})" if not first else f"* REPLACE ({moved} AS {c})"
            if first and direction == "b":
                body = f"* EXCLUDE (run) REPLACE ({moved} AS {c})"
            out += f", {nxt} AS (SELECT {body}, {fn}({run}, {moved}) AS run FROM {cur})"
            cur, first = nxt, False
    return out, cur


APPLY_SQL = RES_SQL + """, vq AS (SELECT -round(median(residual_ms), 2) - 7.0 AS g FROM res WHERE usable AND fiducial = 'qrs_onset'),
 vt AS (SELECT disease_class, -round(median(residual_ms), 2) - 7.0 AS c FROM res WHERE usable AND fiducial = 't_offset' GROUP BY 1),
 sh AS (SELECT record_id, lead, """ + ", ".join(
    f"{c} AS was_{c}, " + ("qrs_onset + g/2.0 AS qrs_onset" if c == "qrs_onset" else "t_offset + coalesce(c, 0)/2.0 AS t_offset" if c == "t_offset" else f"CAST({c} AS DOUBLE) AS {c}")
    for c in LM
) + " FROM units LEFT JOIN vt USING (disease_class), vq)"
_RK, _RKN = _ranked_sql("sh", ["qrs_onset", "t_offset"])
APPLIED_SQL = APPLY_SQL + _RK + ", ap AS (SELECT record_id, lead, " + ", ".join(
    f"CAST(round_even({c}, 0) AS BIGINT) AS {c}, abs(CAST(round_even({c}, 0) AS BIGINT) - was_{c})*2.0::DOUBLE AS shift_{c}" for c in LM
) + f" FROM {_RKN})"


@query("apply_offsets", f"WITH {APPLIED_SQL} SELECT record_id, lead, " + ", ".join(f"{c}, shift_{c}" for c in LM) + " FROM ap")
def apply_offsets(spark, sf):
    u = stored_units(spark, sf)
    out = D.apply_offsets(u, _plan(spark, sf, u))
    return out.select("record_id", "lead", *[x for c in LM for x in (c, f"shift_{c}")])


@query(
    "shift_report",
    f"WITH {APPLIED_SQL}, t AS (SELECT unnest([" + ",".join(f"'{c}'" for c in L.boundaries) + "]) AS fiducial, unnest(["
    + ",".join(f"shift_{c}" for c in L.boundaries) + "]) AS s FROM ap) SELECT fiducial, count(*) FILTER (s > 0) AS n_shifted, "
    "round(count(*) FILTER (s > 0) / count(*) * 100, 6) AS reach_pct, median(CASE WHEN s > 0 THEN s END) AS median_shift_ms FROM t GROUP BY fiducial",
)
def shift_report(spark, sf):
    u = stored_units(spark, sf)
    return D.shift_report(D.apply_offsets(u, _plan(spark, sf, u)))


@query(
    "repair_diagnostics",
    f"""WITH {APPLY_SQL}{_RK}, z AS (SELECT a.record_id, a.lead, {", ".join(f"(a.{c} <> b.{c}) AS m_{c}" for c in LM)},
      {" + ".join(f"CASE WHEN a.{y} < a.{x} THEN 1 ELSE 0 END" for x, y in zip(LM, LM[1:]))} AS n_unresolved
     FROM {_RKN} a JOIN sh b USING (record_id, lead))
    SELECT {", ".join(f"count(*) FILTER (m_{c}) AS moved_{c}" for c in L.boundaries)}, CAST(sum(n_unresolved) AS BIGINT) AS n_unresolved FROM z""",
)
def repair_diagnostics(spark, sf):
    u = stored_units(spark, sf)
    out = D.apply_offsets(u, _plan(spark, sf, u)).withColumn("m", F.split("moved", ";"))
    return out.agg(
        *[F.count_if(F.array_contains("m", c)).alias(f"moved_{c}") for c in L.boundaries],
        F.sum(F.col("n_unresolved").cast("bigint")).alias("n_unresolved"),
    )


@query(
    "disorder_before_after",
    f"WITH {APPLIED_SQL} " + " UNION ALL ".join(
        f"SELECT '{a} > {b}' AS pair, (SELECT count(*) FROM units WHERE {b} < {a}) AS n_before, (SELECT count(*) FROM ap WHERE {b} < {a}) AS n_after" for a, b in zip(LM, LM[1:])
    ),
)
def disorder_before_after(spark, sf):
    u = stored_units(spark, sf)
    b = qc.order_disorder(u, LM).withColumnRenamed("n", "n_before")
    a = qc.order_disorder(D.apply_offsets(u, _plan(spark, sf, u)), LM).withColumnRenamed("n", "n_after")
    return b.join(a, "pair")


@query(
    "coincidence_split",
    f"""WITH {APPLIED_SQL}, m AS (SELECT u.*, a.p_offset <> u.p_offset AS moved, (u.qrs_onset - u.p_offset)*2 AS gap FROM units u JOIN ap a USING (record_id, lead))
    SELECT count(*) FILTER (moved AND gap <= 0) AS coincident, count(*) FILTER (moved AND gap > 0) AS squeezed,
      count(*) FILTER (NOT moved AND gap > 0) AS untouched_with_headroom FROM m""",
)
def coincidence_split(spark, sf):
    u = stored_units(spark, sf)
    a = D.apply_offsets(u, _plan(spark, sf, u)).select("record_id", "lead", F.col("p_offset").alias("_new"))
    m = u.join(a, ["record_id", "lead"]).withColumn("moved", F.col("_new") != F.col("p_offset"))
    return D.coincidence_split(m, "moved", "p_offset", "qrs_onset")


@query(
    "repeatability",
    f"""WITH {LAST_SQL}, t AS (SELECT u.record_id, u.lead, (c.t_onset-u.t_onset)*2.0::DOUBLE AS d1, (c.t_offset-u.t_offset)*2.0::DOUBLE AS d2
      FROM units u JOIN rev c ON u.record_id = c.record_id AND u.lead = c.lead WHERE u.t_onset IS NOT NULL AND u.t_offset IS NOT NULL
       AND c.t_onset IS NOT NULL AND c.t_offset IS NOT NULL AND (u.t_onset <> c.t_onset OR u.t_offset <> c.t_offset)),
    l AS (SELECT unnest(['t_onset','t_offset']) AS landmark, unnest([d1, d2]) AS d FROM t)
    SELECT landmark, count(*) AS n, max(abs(d)) AS max_ms, round(avg(d), 6) AS mean_ms, round(stddev_samp(d), 6) AS sd_ms, median(abs(d)) AS median_ms,
     list_extract(list(abs(d) ORDER BY abs(d)), CAST(round(0.25*count(*)) AS BIGINT)) AS q25_ms, list_extract(list(abs(d) ORDER BY abs(d)), CAST(round(0.75*count(*)) AS BIGINT)) AS q75_ms,
     1 AS enough FROM l GROUP BY landmark""",
)
def repeatability(spark, sf):
    u = stored_units(spark, sf)
    return D.repeatability(u, review.latest_corrections(correction_feed(spark, sf, u)), ["t_onset", "t_offset"])


@query(
    "bootstrap_median_by_class",
    f"WITH {RES_SQL}, s AS (SELECT * FROM res WHERE usable), " + boot_sql("bb", "s", "fiducial, disease_class", "residual_ms", ["record_id", "lead"], BOOT, 7)
    + " SELECT fiducial, disease_class, n, round(point, 6) AS point, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, "
    "CASE WHEN (lo > 0 OR hi < 0) AND abs(point) >= 2 THEN 1 ELSE 0 END AS biased FROM bb",
)
def bootstrap_median_by_class(spark, sf):
    r = _residuals(spark, sf).filter("usable")
    b = infer.bootstrap_ci(r, ["fiducial", "disease_class"], "residual_ms", ["record_id", "lead"], "median", BOOT, 7)
    sig = infer.is_biased(F.col("point"), F.col("ci_lo"), F.col("ci_hi")).cast("int")
    return b.withColumn("biased", sig).withColumns({c: F.round(c, 6) for c in ("point", "ci_lo", "ci_hi")})


@query(
    "paired_delta_ci",
    f"WITH {RES_SQL}, s AS (SELECT *, abs(residual_ms - 8) - abs(residual_ms) AS d FROM res WHERE usable), "
    + boot_sql("pb", "s", "fiducial", "d", ["record_id", "lead"], BOOT, 20260726, "mean")
    + " SELECT fiducial, n, round(point, 6) AS point, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi FROM pb",
)
def paired_delta_ci(spark, sf):
    r = _residuals(spark, sf).filter("usable").withColumns({"a": F.abs(F.col("residual_ms") - 8), "b": F.abs("residual_ms")})
    b = infer.paired_delta_ci(r, ["fiducial"], "a", "b", ["record_id", "lead"], BOOT)
    return b.withColumns({c: F.round(c, 6) for c in ("point", "ci_lo", "ci_hi")})


# ---------------------------------------------------------------- samples, splits, folds

ENT_SQL = UNITS_SQL + ", ents AS (SELECT DISTINCT record_id, disease_class FROM units)"


def _ents(spark, sf):
    return materialise(units(spark, sf).select("record_id", "disease_class").distinct())


@query(
    "stratified_sample",
    f"WITH {ENT_SQL} SELECT disease_class, record_id FROM (SELECT *, row_number() OVER (PARTITION BY disease_class ORDER BY {draw_sql(7, 'record_id')}, record_id) AS k FROM ents) z WHERE k <= 50",
)
def stratified_sample(spark, sf):
    return K.seeded_sample(_ents(spark, sf), ["disease_class"], ["record_id"], 50, 7).select("disease_class", "record_id")


@query(
    "stratified_folds",
    f"WITH {ENT_SQL} SELECT record_id, disease_class, (row_number() OVER (PARTITION BY disease_class ORDER BY {draw_sql(11, 'record_id')}, record_id) - 1) % 5 AS fold FROM ents",
)
def stratified_folds(spark, sf):
    return D.stratified_folds(_ents(spark, sf), ["disease_class"], ["record_id"], 5, 11)


RANK_ENT_SQL = ENT_SQL + ", rk AS (SELECT *, row_number() OVER (PARTITION BY disease_class ORDER BY record_id) AS i FROM ents)"


@query(
    "nshot_ladder",
    f"""WITH {RANK_ENT_SQL} SELECT 0 AS n, 'test' AS split, disease_class, record_id FROM rk WHERE i <= 10
    UNION ALL SELECT n, CASE WHEN i <= 12 THEN 'val' ELSE 'train' END, disease_class, record_id FROM rk, (SELECT unnest([1,2,5,8]) AS n) z WHERE i > 10 AND i <= 12 + n""",
)
def nshot_ladder(spark, sf):
    return K.nshot_ladder(_ents(spark, sf), "disease_class", "record_id")


@query(
    "first_n_split_counts",
    f"""WITH {RANK_ENT_SQL} SELECT disease_class, CASE WHEN i <= 10 THEN 'test' WHEN i <= 12 THEN 'val' ELSE 'pool' END AS role, count(*) AS n, min(record_id) AS first_id
    FROM rk GROUP BY ALL""",
)
def first_n_split_counts(spark, sf):
    r = K.first_n_split(_ents(spark, sf), ["disease_class"], "record_id")
    return r.groupBy("disease_class", "role").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"))


CVS_SQL = RANK_ENT_SQL + """, f AS (SELECT *, i - 1 AS j, CASE WHEN i - 1 >= fold*5 + 5 THEN i - 6 ELSE i - 1 END AS pool FROM rk, (SELECT unnest(range(4)) AS fold) z),
 sp AS (SELECT CAST(fold AS INTEGER) AS fold, 0 AS n, 'test' AS split, disease_class, record_id FROM f WHERE j >= fold*5 AND j < fold*5+5
  UNION ALL SELECT CAST(fold AS INTEGER), n, CASE WHEN pool < 3 THEN 'val' ELSE 'train' END, disease_class, record_id FROM f, (SELECT unnest([{ns}]) AS n) q
   WHERE NOT (j >= fold*5 AND j < fold*5+5) AND pool < 3 + {quota})"""


@query("cv_splits", f"WITH {CVS_SQL.format(ns='1,2,5,8,12', quota='n')} SELECT * FROM sp")
def cv_splits(spark, sf):
    return K.cv_splits(_ents(spark, sf), "disease_class", "record_id")


@query(
    "cv_splits_anchored",
    f"WITH {CVS_SQL.format(ns='2,4,8,12', quota=chr(40) + chr(67) + 'ASE WHEN disease_class IN (' + chr(39) + 'BUILDING' + chr(39) + ') THEN n ELSE 2 END)')} SELECT * FROM sp",
)
def cv_splits_anchored(spark, sf):
    return K.cv_splits(_ents(spark, sf), "disease_class", "record_id", ns=(2, 4, 8, 12), anchored=["BUILDING"])


@query(
    "fold_coverage",
    f"WITH {RANK_ENT_SQL} SELECT record_id, CAST(0 AS BIGINT) AS n_tested FROM rk WHERE i > 20",
)
def fold_coverage(spark, sf):
    e = _ents(spark, sf)
    return K.fold_coverage(K.cv_splits(e, "disease_class", "record_id"), e, "record_id").withColumn("n_tested", F.col("n_tested").cast("bigint"))


@query(
    "class_interleave",
    f"WITH {RANK_ENT_SQL} SELECT record_id, disease_class, i AS turn, row_number() OVER (ORDER BY i, disease_class) AS place FROM rk",
)
def class_interleave(spark, sf):
    r = K.interleave(_ents(spark, sf), "disease_class", "record_id")
    # The turn is a number, so the place in (turn, class) order is found piece by piece.
    from ..operators.ordered import with_neighbours

    return with_neighbours(r.withColumn("_all", F.lit(0)), ["_all"], "turn", ties=["disease_class"], ordinal="place").drop("_all")


TOPUP_SQL = ENT_SQL + f""", prev AS (SELECT disease_class, record_id, CASE WHEN k % 2 = 1 THEN 'calibration' ELSE 'test' END AS split FROM
   (SELECT *, row_number() OVER (PARTITION BY disease_class ORDER BY {draw_sql(3, 'record_id')}, record_id) AS k FROM ents) z WHERE k <= 30),
 kept AS (SELECT * FROM prev WHERE record_id % 4 <> 0), have AS (SELECT disease_class, split, count(*) AS n FROM kept GROUP BY ALL),
 fresh AS (SELECT *, row_number() OVER (PARTITION BY disease_class ORDER BY {draw_sql(9, 'record_id')}, record_id) AS i FROM ents WHERE record_id NOT IN (SELECT record_id FROM prev)),
 need AS (SELECT disease_class, max(CASE WHEN split = 'calibration' THEN n END) AS hc, max(CASE WHEN split = 'test' THEN n END) AS ht FROM have GROUP BY 1)"""


@query(
    "stratified_topup",
    f"""WITH {TOPUP_SQL} SELECT disease_class, split, record_id, 0 AS is_new FROM kept UNION ALL
    SELECT disease_class, CASE WHEN i <= 25 - coalesce(hc, 0) THEN 'calibration' ELSE 'test' END, record_id, 1 FROM fresh LEFT JOIN need USING (disease_class)
    WHERE i <= 50 - coalesce(hc, 0) - coalesce(ht, 0)""",
)
def stratified_topup(spark, sf):
    e = _ents(spark, sf)
    prev = K.seeded_sample(e, ["disease_class"], ["record_id"], 30, 3)
    prev = materialise(prev)
    prev = D.stratified_folds(prev, ["disease_class"], ["record_id"], 2, 3).withColumn(
        "split", F.when(F.col("fold") == 0, "calibration").otherwise("test")
    )
    # A previous pick stays only while it still qualifies; here one record in four no longer does.
    return K.stratified_topup(e, prev, 25, ["calibration", "test"], "disease_class", "record_id", 9, keep=F.col("record_id") % 4 != 0)


@query(
    "leakage_check",
    f"""WITH {CORR_SQL}, tr AS (SELECT record_id, lead FROM units WHERE lead <= 4), te AS (SELECT record_id, lead FROM corr WHERE reviewed = 1 AND lead >= 4)
    SELECT (SELECT count(*) FROM (SELECT record_id FROM tr INTERSECT SELECT record_id FROM te) a) AS shared_entities,
      (SELECT count(*) FROM (SELECT record_id, lead FROM tr INTERSECT SELECT record_id, lead FROM te) b) AS shared_units""",
)
def leakage_check(spark, sf):
    return K.leakage_check(units(spark, sf).filter("lead <= 4"), corrections(spark, sf).filter("reviewed = 1 and lead >= 4"))


@query(
    "split_straddle",
    f"WITH {BEATS_SQL}, s AS (SELECT record_id, CASE WHEN beat_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM beats) "
    "SELECT record_id, count(DISTINCT split) AS n_splits FROM s GROUP BY record_id HAVING count(DISTINCT split) > 1",
)
def split_straddle(spark, sf):
    b = beats(spark, sf).withColumn("split", F.when(F.col("beat_id") % 5 == 0, "val").otherwise("train"))
    return K.straddling(b)


@query(
    "held_out_sets",
    f"""WITH {CORR_SQL}, gold AS (SELECT record_id FROM units WHERE disease_class = 'BUILDING'), rv AS (SELECT record_id FROM corr WHERE reviewed = 1)
    SELECT 'union' AS kind, count(*) AS n FROM (SELECT record_id FROM gold UNION SELECT record_id FROM rv) a
    UNION ALL SELECT 'reviewed_not_gold', count(*) FROM (SELECT record_id FROM rv EXCEPT SELECT record_id FROM gold) b
    UNION ALL SELECT 'both', count(*) FROM (SELECT record_id FROM rv INTERSECT SELECT record_id FROM gold) c""",
)
def held_out_sets(spark, sf):
    u = stored_units(spark, sf)
    gold = u.filter("disease_class = 'BUILDING'").select("record_id")
    rv = corrections(spark, sf, u).filter("reviewed = 1").select("record_id")
    parts = {
        "union": K.held_out(gold, rv), "reviewed_not_gold": rv.subtract(gold), "both": K.shared_keys(rv, gold, ["record_id"]),
    }
    out = None
    for name, d in parts.items():
        one = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


CUT = "greatest(0, CAST(floor(least(qrs_onset - 60, {c}) - 20) AS BIGINT))", "least(n_samples - 1, CAST(ceil(greatest(qrs_onset + 120, {c}) + 20) AS BIGINT))"


@query(
    "cut_windows",
    f"""WITH {BEATS_SQL}, w AS (SELECT *, {CUT[0].format(c=','.join(LM))} AS win_start, {CUT[1].format(c=','.join(LM))} AS win_end FROM beats)
    SELECT record_id, lead, beat_id, win_start, win_end, CASE WHEN least({','.join(LM)}) < win_start OR greatest({','.join(LM)}) > win_end THEN 1 ELSE 0 END AS clipped FROM w""",
)
def cut_windows(spark, sf):
    b = beats(spark, sf).withColumns({"bs": F.col("qrs_onset") - 60, "be": F.col("qrs_onset") + 120})
    return K.cut_windows(b, "bs", "be").select("record_id", "lead", "beat_id", "win_start", "win_end", "clipped")


@query(
    "cut_corpus",
    f"""WITH {LAST_SQL}, gold AS (SELECT record_id FROM units WHERE disease_class = 'BUILDING'), held AS (SELECT record_id FROM gold UNION SELECT record_id FROM rev),
    allu AS (SELECT 'pretrain' AS part, record_id, lead, qrs_onset, {','.join(c for c in LM if c != 'qrs_onset')}, n_samples FROM units WHERE record_id NOT IN (SELECT record_id FROM held)
      UNION ALL SELECT 'finetune', record_id, lead, qrs_onset, {','.join(c for c in LM if c != 'qrs_onset')}, 5000 FROM rev),
    w AS (SELECT *, {CUT[0].format(c=','.join(LM))} AS ws, {CUT[1].format(c=','.join(LM))} AS we FROM allu)
    SELECT part, count(*) AS n_units, count(DISTINCT record_id) AS n_records, CAST(sum(we - ws) AS BIGINT) AS total_width FROM w GROUP BY part""",
)
def cut_corpus(spark, sf):
    span = {"bs": F.col("qrs_onset") - 60, "be": F.col("qrs_onset") + 120}
    u = stored_units(spark, sf).withColumns(span)
    rev = review.latest_corrections(correction_feed(spark, sf, u)).withColumns(span | {"fs_hz": F.lit(500), "n_samples": F.lit(5000)})
    out = K.cut_corpus(u, rev, u.filter("disease_class = 'BUILDING'"), "bs", "be")
    return out.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_distinct("record_id").alias("n_records"), F.sum(F.col("win_end") - F.col("win_start")).alias("total_width")
    )


@query(
    "distinct_counts",
    f"WITH {BEATS_SQL} SELECT disease_class, count(DISTINCT record_id) AS n_records, count(DISTINCT lead) AS n_leads, count(DISTINCT record_id*100 + lead) AS n_units FROM beats GROUP BY 1",
)
def distinct_counts(spark, sf):
    return beats(spark, sf).groupBy("disease_class").agg(
        F.count_distinct("record_id").alias("n_records"), F.count_distinct("lead").alias("n_leads"), F.count_distinct("record_id", "lead").alias("n_units")
    )


@query(
    "class_by_channel_crosstab",
    f"WITH {BEATS_SQL} SELECT disease_class, " + ", ".join(f"count(*) FILTER (lead = {k}) AS lead_{k}" for k in range(1, 8)) + " FROM beats GROUP BY 1",
)
def class_by_channel_crosstab(spark, sf):
    p = beats(spark, sf).groupBy("disease_class").pivot("lead", list(range(1, 8))).agg(F.count(F.lit(1)))
    return p.select("disease_class", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"lead_{k}") for k in range(1, 8)])


# ---------------------------------------------------------------- assembled tables


@query(
    "assemble_clean_units",
    f"""WITH {RES_SQL}, rated0 AS (SELECT * FROM units),
    g AS (SELECT -round(median(residual_ms), 2) - 7.0 AS g FROM res WHERE usable AND fiducial = 'qrs_onset'),
    me AS (SELECT record_id, lead, {', '.join(f'{c} + 1 AS {c}' for c in LM)} FROM units),
    a AS (SELECT m.record_id, m.lead, CASE WHEN q_peak = qrs_onset THEN NULL ELSE q_peak END AS q_peak, CASE WHEN q_peak IS NULL OR q_peak = qrs_onset THEN 0 ELSE 1 END AS q_present,
      qrs_onset + CAST(round_even(g/2.0, 0) AS BIGINT) AS qrs_onset, p_onset, p_peak, p_offset, t_offset, g AS onset_offset_ms, {', '.join(c for c in LM if c in ('r_peak','s_peak','qrs_offset','t_onset','t_peak'))} FROM me m, g),
    b AS (SELECT * REPLACE (CASE WHEN p_offset IS NOT NULL THEN least(p_offset, qrs_onset) END AS p_offset) FROM a),
    c AS (SELECT * REPLACE (CASE WHEN p_peak IS NOT NULL THEN least(p_peak, p_offset) END AS p_peak, CASE WHEN p_onset IS NOT NULL THEN least(p_onset, p_offset) END AS p_onset) FROM b)
    SELECT record_id, lead, q_present, onset_offset_ms, {','.join(LM)}, CASE WHEN least({','.join(LM)}) < 0 OR greatest({','.join(LM)}) > 4999 THEN 0 ELSE 1 END AS in_bounds FROM c""",
)
def assemble_clean_units(spark, sf):
    from ..schema import assert_coverage

    u = stored_units(spark, sf)
    measured = u.select("record_id", "lead", *[(F.col(c) + 1).alias(c) for c in LM])
    assert_coverage(u, measured, ["record_id", "lead"])
    o = _plan(spark, sf, u).filter("fiducial = 'qrs_onset'")
    out = K.assemble_clean_units(u, measured, o)
    return out.select("record_id", "lead", "q_present", "onset_offset_ms", *LM, "in_bounds")


@query(
    "assemble_reviewed_orphans",
    f"""WITH {LAST_SQL}, c AS (SELECT record_id + CASE WHEN record_id % 50 = 0 THEN 10000000 ELSE 0 END AS record_id, lead, beat_id + CASE WHEN record_id % 70 = 1 THEN 10000000 ELSE 0 END AS beat_id FROM rev),
    j AS (SELECT c.*, b.record_id AS hit, EXISTS (SELECT 1 FROM beats k WHERE k.record_id = c.record_id) AS known FROM c LEFT JOIN beats b ON b.record_id = c.record_id AND b.lead = c.lead AND b.beat_id = c.beat_id)
    SELECT CASE WHEN hit IS NOT NULL THEN 'kept' WHEN known THEN 'event_missing' ELSE 'record_gone' END AS outcome, count(*) AS n FROM j GROUP BY 1""",
)
def assemble_reviewed_orphans(spark, sf):
    b = materialise(beats(spark, sf))
    first = keep_first(b, ["record_id", "lead"], ["beat_id"])
    c = review.latest_corrections(correction_feed(spark, sf, first))
    # Damage some keys so that both kinds of orphan occur.
    c = c.withColumns(
        {
            "beat_id": F.col("beat_id") + F.when(F.col("record_id") % 70 == 1, 10_000_000).otherwise(0),
            "record_id": F.col("record_id") + F.when(F.col("record_id") % 50 == 0, 10_000_000).otherwise(0),
        }
    )
    paths = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("record_id"), F.col("c_name").alias("path_raw"), F.lit(0).alias("path_order")
    )
    good, orphan = K.assemble_reviewed(c, b.drop("edited_at", "disease_class"), paths)
    both = orphan.select(F.col("problem").alias("outcome")).unionByName(good.select(F.lit("kept").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "skip_reasons",
    f"""WITH {CORR_SQL} SELECT CASE WHEN reviewed <> 1 THEN 'not_reviewed' WHEN record_id % 101 = 0 THEN 'excluded' WHEN q_peak IS NULL THEN 'no_q' END AS skip_reason, count(*) AS n
    FROM corr GROUP BY 1""",
)
def skip_reasons(spark, sf):
    rules = [
        ("not_reviewed", F.col("reviewed") == 1), ("excluded", F.col("record_id") % 101 != 0), ("no_q", F.col("q_peak").isNotNull()),
    ]
    return K.skip_reasons(corrections(spark, sf), rules).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "table_problems",
    f"""WITH {UNITS_SQL}, per AS (SELECT record_id, count(DISTINCT lead) AS n, count(DISTINCT struct_pack(a := qrs_onset, b := qrs_offset)) AS m FROM units GROUP BY 1)
    SELECT 'short_record' AS problem, count(*) AS n FROM per WHERE n < 7 UNION ALL SELECT 'several_core_sets', count(*) FROM per WHERE m > 1
    UNION ALL SELECT 'core_too_wide', count(*) FROM units WHERE (qrs_offset-qrs_onset)*2 > 200
    UNION ALL SELECT 'out_of_order', count(*) FROM units WHERE {' OR '.join(f'coalesce({a} > {b}, false)' for a, b in zip(L.boundaries, L.boundaries[1:]))}""",
)
def table_problems(spark, sf):
    p = K.table_problems(stored_units(spark, sf), n_channels=7)
    return p.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_master",
    f"""WITH {BEATS_SQL}, m AS (SELECT record_id, CASE WHEN disease_class = 'BUILDING' THEN 'validation' WHEN disease_class = 'MACHINERY' THEN 'other' ELSE 'test' END AS split,
      CASE WHEN lead % 2 = 0 THEN 'LAD_ant' ELSE 'RCA_post' END AS mi_subclass FROM beats),
     k AS (SELECT c_custkey AS record_id, CASE WHEN c_nationkey % 3 = 0 THEN '' WHEN c_nationkey % 3 = 1 THEN 'LCX_ant' END AS s FROM customer)
    SELECT CASE split WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test' ELSE 'train' END AS split, coalesce(nullif(s, ''), mi_subclass) AS mi_subclass,
      regexp_replace(coalesce(nullif(s, ''), mi_subclass), '(_ant|_post)$', '') AS mi_group, count(*) AS n FROM m LEFT JOIN k USING (record_id) GROUP BY ALL""",
)
def split_master(spark, sf):
    b = beats(spark, sf)
    m = b.select(
        "record_id", F.when(F.col("disease_class") == "BUILDING", "validation").when(F.col("disease_class") == "MACHINERY", "other").otherwise("test").alias("split"),
        F.when(F.col("lead") % 2 == 0, "LAD_ant").otherwise("RCA_post").alias("mi_subclass"),
    )
    k = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("record_id"), F.when(F.col("c_nationkey") % 3 == 0, "").when(F.col("c_nationkey") % 3 == 1, "LCX_ant").alias("mi_subclass")
    )
    return K.split_master(m, k).groupBy("split", "mi_subclass", "mi_group").agg(F.count(F.lit(1)).alias("n"))


@query(
    "load_units",
    f"WITH {UNITS_SQL} SELECT record_id, lead, beat_id FROM units WHERE disease_class IN ('BUILDING','MACHINERY') AND lead IN (1,2,3) AND record_id NOT IN "
    "(SELECT record_id FROM units WHERE t_peak IS NULL) ORDER BY record_id, lead LIMIT 200",
)
def load_units(spark, sf):
    u = stored_units(spark, sf)
    out = K.load_units(u, classes=["BUILDING", "MACHINERY"], channels=[1, 2, 3], drop_ids=u.filter("t_peak is null"), max_units=200)
    return out.select("record_id", "lead", "beat_id")


@query(
    "keyed_lookup",
    f"WITH {BEATS_SQL} SELECT record_id, lead, beat_id, qrs_onset FROM beats WHERE record_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
)
def keyed_lookup(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("record_id"))
    return K.keyed_lookup(beats(spark, sf), wanted, ["record_id"]).select("record_id", "lead", "beat_id", "qrs_onset")


@query(
    "clustered_lookup",
    f"WITH {BEATS_SQL} SELECT record_id, lead, beat_id, qrs_onset FROM beats WHERE record_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
)
def clustered_lookup(spark, sf):
    """The same look-up in a table laid out by record."""
    path = f"{shared_folder(spark)}/beats-{uuid.uuid4().hex}"
    clustered.write_clustered(beats(spark, sf).select("record_id", "lead", "beat_id", "qrs_onset"), path)
    wanted = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("record_id"))
    return clustered.lookup(spark, path, wanted)


@query("extract_record", f"WITH {BEATS_SQL} SELECT lead, beat_id, qrs_onset FROM beats WHERE record_id = 7")
def extract_record(spark, sf):
    return K.extract_record(beats(spark, sf), 7).select("lead", "beat_id", "qrs_onset")


@query(
    "summary_text",
    f"WITH {UNITS_SQL} SELECT record_id, lead, 'P ' || coalesce(CAST((p_offset-p_onset)*2 AS VARCHAR), '--') || 'ms | QRS ' || CAST((qrs_offset-qrs_onset)*2 AS VARCHAR) "
    "|| 'ms | QT ' || coalesce(CAST((t_offset-qrs_onset)*2 AS VARCHAR), '--') || 'ms' AS summary FROM units",
)
def summary_text(spark, sf):
    return K.summary_text(derive.derive_intervals(units(spark, sf))).select("record_id", "lead", "summary")


@query(
    "one_unit_per_record",
    f"WITH {UNITS_SQL} SELECT record_id, min(lead) AS lead FROM units GROUP BY record_id",
)
def one_unit_per_record(spark, sf):
    return K.one_unit_per_entity(units(spark, sf)).select("record_id", "lead")


# The checksum's table by its rule, then a fold over the bytes of the key.
CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 keyed AS (SELECT record_id, lead, xor(list_reduce(list_concat([4294967295], list_transform(string_split('r' || record_id, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM units, crc)"""


@query(
    "spread_sample",
    f"""WITH {UNITS_SQL}, o AS (SELECT record_id, disease_class, min(lead) AS lead FROM units GROUP BY ALL), q AS (SELECT greatest(1, 100 // count(DISTINCT disease_class)) AS quota FROM o)
    SELECT record_id, disease_class, lead FROM (SELECT *, row_number() OVER (PARTITION BY disease_class ORDER BY {draw_sql(13, 'record_id')}, record_id) AS k FROM o) z, q WHERE k <= quota""",
)
def spread_sample(spark, sf):
    return K.spread_sample(units(spark, sf), "disease_class", 100, 13).select("record_id", "disease_class", "lead")


@query("hash_sharding", f"WITH {UNITS_SQL}, {CRC_SQL} SELECT record_id, lead, h % 8 AS shard FROM keyed")
def hash_sharding(spark, sf):
    key = F.concat(F.lit("r"), F.col("record_id").cast("string"))
    return units(spark, sf).select("record_id", "lead", K.shard_of(key, 8).cast("bigint").alias("shard"))
