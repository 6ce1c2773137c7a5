"""Queries on consensus, order repair, worklists and corrections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import qc, review
from ..operators.derive import INTERVALS
from ..operators.ordered import keep_first, lay_out
from ..schema import LANDMARKS_11 as L
from ..session import materialise, shared_folder
from ..sources import buckets
from .fixtures import BEATS_SQL, CORR_SQL, EVENTS_SQL, LM, beats, correction_feed, corrections, events, stored_units, units
from .quality import DEV_SQL, QC_SQL, REP_MED_SQL, RSTAT_SQL, UNIT_SQL
from .registry import query

PEAKS, ONS, OFFS = L.peaks, L.onsets, L.offsets


def cons_sql(q: float, source: str = "beats") -> str:
    on = ", ".join(f"CAST(quantile_cont({c}, {q}) AS DOUBLE) AS {c}" for c in ONS)
    off = ", ".join(f"CAST(quantile_cont({c}, {1 - q}) AS DOUBLE) AS {c}" for c in OFFS)
    pk = ", ".join(f"CAST(median({c}) AS DOUBLE) AS {c}" for c in PEAKS)
    return (
        f", c0 AS (SELECT record_id, beat_id, min(disease_class) AS disease_class, {on}, {off}, {pk}, "
        f"max(CASE WHEN lead = 2 THEN r_peak END) AS ref, count(*) AS n_recon_leads FROM {source} GROUP BY record_id, beat_id), "
        "cons AS (SELECT * EXCLUDE (ref) REPLACE (coalesce(CAST(ref AS DOUBLE), r_peak) AS r_peak), "
        "CASE WHEN ref IS NULL THEN 0 ELSE 1 END AS r_ref_used FROM c0)"
    )


CORE_FIRST_SQL = """, k1 AS (SELECT * REPLACE (least(qrs_onset, r_peak) AS qrs_onset, greatest(qrs_offset, r_peak) AS qrs_offset) FROM {src}),
 k2 AS (SELECT * REPLACE (greatest(qrs_offset, qrs_onset) AS qrs_offset) FROM k1),
 k3 AS (SELECT * REPLACE (least(p_offset, qrs_onset) AS p_offset, greatest(t_onset, qrs_offset) AS t_onset) FROM k2),
 k4 AS (SELECT * REPLACE (least(p_onset, p_offset) AS p_onset, greatest(t_offset, t_onset) AS t_offset) FROM k3),
 fixed AS (SELECT * REPLACE (least(greatest(p_peak, p_onset), p_offset) AS p_peak,
   least(greatest(q_peak, qrs_onset), qrs_offset) AS q_peak, least(greatest(s_peak, qrs_onset), qrs_offset) AS s_peak,
   least(greatest(t_peak, t_onset), t_offset) AS t_peak) FROM k4)"""


def midpoint_sql(src: str) -> str:
    out, b = "", L.boundaries
    for i, (x, y) in enumerate(zip(b, b[1:])):
        out += (
            f", m{i} AS (SELECT * REPLACE (CASE WHEN {x} > {y} THEN ({x}+{y})/2 ELSE {x} END AS {x}, "
            f"CASE WHEN {x} > {y} THEN ({x}+{y})/2 ELSE {y} END AS {y}) FROM {src})"
        )
        src = f"m{i}"
    for i, (x, y) in enumerate(zip(b, b[1:])):
        out += f", f{i} AS (SELECT * REPLACE (greatest({y}, {x}) AS {y}) FROM {src})"
        src = f"f{i}"
    return out


ROUNDED = ", ".join(f"CAST(round_even({c}, 0) AS BIGINT) AS {c}" for c in LM)


def _rated(spark, sf):
    """Rated rows, written once: the queries below read them several times."""
    return materialise(qc.beat_qc(beats(spark, sf)))


@query("consensus_quantile", f"WITH {BEATS_SQL}{cons_sql(0.25)} SELECT * EXCLUDE (disease_class) FROM cons")
def consensus_quantile(spark, sf):
    return C.consensus_positions(beats(spark, sf), 0.25, ref_channel=2)


@query(
    "consensus_minmax",
    f"WITH {BEATS_SQL} SELECT record_id, beat_id, count(*) AS n_recon_leads, "
    + ", ".join(f"CAST(min({c}) AS DOUBLE) AS {c}" for c in ONS) + ", "
    + ", ".join(f"CAST(max({c}) AS DOUBLE) AS {c}" for c in OFFS) + ", "
    + ", ".join(f"CAST(median({c}) AS DOUBLE) AS {c}" for c in PEAKS) + " FROM beats GROUP BY record_id, beat_id",
)
def consensus_minmax(spark, sf):
    return C.consensus_positions(beats(spark, sf), 0.0)


@query(
    "consensus_repaired",
    f"WITH {BEATS_SQL}{cons_sql(0.25)}{CORE_FIRST_SQL.format(src='cons')} SELECT record_id, beat_id, {ROUNDED} FROM fixed",
)
def consensus_repaired(spark, sf):
    c = C.repair_core_first(C.consensus_positions(beats(spark, sf), 0.25, ref_channel=2))
    return C.round_positions(c, LM).select("record_id", "beat_id", *LM)


@query(
    "consensus_midpoint",
    f"WITH {BEATS_SQL}{cons_sql(0.125)}{midpoint_sql('cons')}{CORE_FIRST_SQL.format(src='f4')} SELECT record_id, beat_id, {ROUNDED} FROM fixed",
)
def consensus_midpoint(spark, sf):
    c = C.consensus_positions(beats(spark, sf), 0.125, ref_channel=2)
    return C.round_positions(C.repair_core_first(C.repair_midpoint(c)), LM).select("record_id", "beat_id", *LM)


def forward_sql(src: str) -> str:
    """Running maximum over the chain, as one window per long row."""
    cells = ",".join(LM)
    return f""", fl AS (SELECT record_id, beat_id, unnest([{','.join(map(str, range(11)))}]) AS pos, unnest([{cells}]) AS v FROM {src}),
     fr AS (SELECT record_id, beat_id, pos, CASE WHEN v IS NOT NULL THEN max(v) OVER (PARTITION BY record_id, beat_id ORDER BY pos) END AS v FROM fl)"""


@query(
    "consensus_forward_repair",
    f"WITH {BEATS_SQL}{cons_sql(0.25)}, rd AS (SELECT record_id, beat_id, {ROUNDED} FROM cons){forward_sql('rd')} SELECT record_id, beat_id, "
    + ", ".join(f"CAST(max(CASE WHEN pos = {i} THEN v END) AS DOUBLE) AS {c}" for i, c in enumerate(LM))
    + " FROM fr GROUP BY record_id, beat_id",
)
def consensus_forward_repair(spark, sf):
    c = C.round_positions(C.consensus_positions(beats(spark, sf), 0.25, ref_channel=2), LM)
    return C.repair_forward(c, LM).select("record_id", "beat_id", *LM)


@query(
    "consensus_record",
    f"""WITH {RSTAT_SQL}{cons_sql(0.25)}{CORE_FIRST_SQL.format(src='cons')}{REP_MED_SQL}
    SELECT f.record_id, f.beat_id AS rep_beat_id, disease_class, 'all_leads' AS recon_source, n_recon_leads, r_ref_used, {ROUNDED},
     qc_status, genuine, problem_leads, n_problem_leads, CAST(0.25 AS DOUBLE) AS recon_quantile,
     CASE WHEN qc_status = 'critical' THEN CASE WHEN disease_class = 'BUILDING' THEN 3 ELSE 1 END ELSE 0 END + n_problem_leads AS review_priority
    FROM fixed f JOIN near ON f.record_id = near.record_id AND f.beat_id = near.beat_id JOIN rst ON f.record_id = rst.record_id""",
)
def consensus_record(spark, sf):
    return C.consensus(_rated(spark, sf), 0.25, ref_channel=2, weights={"BUILDING": 3})


CLEAN_UNITS_SQL = UNIT_SQL + ", clean AS (SELECT record_id, lead FROM ust WHERE worst_status <> 'critical')"


@query(
    "consensus_worklist_channels",
    f"""WITH {CLEAN_UNITS_SQL}, w AS (SELECT DISTINCT record_id FROM clean), kept AS (
      SELECT b.*, CASE WHEN w.record_id IS NULL THEN 'all_leads_fallback' ELSE 'worklist_clean' END AS recon_source
      FROM beats b LEFT JOIN w ON b.record_id = w.record_id LEFT JOIN clean c ON b.record_id = c.record_id AND b.lead = c.lead
      WHERE c.record_id IS NOT NULL OR w.record_id IS NULL)
    SELECT record_id, recon_source, count(*) AS n_rows, count(DISTINCT lead) AS n_leads FROM kept GROUP BY ALL""",
)
def consensus_worklist_channels(spark, sf):
    rated = _rated(spark, sf)
    clean = qc.unit_status(rated).filter("worst_status <> 'critical'")
    kept = C.restrict_channels(rated, clean, keep_fallback=True)
    return kept.groupBy("record_id", "recon_source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lead").alias("n_leads")
    )


@query(
    "consensus_fallback_records",
    f"WITH {CLEAN_UNITS_SQL} SELECT DISTINCT record_id FROM beats WHERE record_id NOT IN (SELECT record_id FROM clean)",
)
def consensus_fallback_records(spark, sf):
    rated = _rated(spark, sf)
    return C.fallback_entities(rated, qc.unit_status(rated).filter("worst_status <> 'critical'"))


SYNC = {k: INTERVALS[k] for k in ("pdur", "qrsdur", "tdur", "pq", "pr", "qt")}


def _second_sql(c: str, desc: bool) -> str:
    o = "DESC" if desc else "ASC"
    return f"list_extract(list({c} ORDER BY {c} {o}) FILTER ({c} >= 5), 2)"


@query(
    "sync_intervals",
    f"WITH {BEATS_SQL} SELECT record_id, beat_id, "
    + ", ".join(
        f"round(({_second_sql(a, True)} - {_second_sql(b, False)}) * 2.0::DOUBLE, 3) AS sync_{n}_ms" for n, (a, b) in SYNC.items()
    )
    + " FROM beats GROUP BY record_id, beat_id",
)
def sync_intervals(spark, sf):
    return C.sync_intervals(beats(spark, sf), SYNC)


DRIVER_SQL = CLEAN_UNITS_SQL + REP_MED_SQL + ", tidy AS (SELECT b.record_id, lead, unnest([" + ",".join(
    f"'{c}'" for c in L.boundaries
) + "]) AS landmark, unnest([" + ",".join(c if c in ONS else f"-{c}" for c in L.boundaries) + """]) AS s
 FROM beats b JOIN near USING (record_id, beat_id)), tv AS (SELECT * FROM tidy WHERE s IS NOT NULL),
 ranked AS (SELECT *, rank() OVER w AS rk, dense_rank() OVER w AS dr, count(*) OVER (PARTITION BY record_id, landmark) AS n,
   count(*) OVER (PARTITION BY record_id, landmark, s) AS ties FROM tv WINDOW w AS (PARTITION BY record_id, landmark ORDER BY s)),
 drv AS (SELECT a.record_id, a.lead, a.landmark, coalesce((SELECT min(b.s) FROM ranked b WHERE b.record_id = a.record_id
    AND b.landmark = a.landmark AND b.dr = 2) - a.s, 0) * 2.0::DOUBLE AS margin_ms
  FROM ranked a WHERE a.rk = 1 AND a.ties = 1 AND a.n >= 2
   AND NOT EXISTS (SELECT 1 FROM clean c WHERE c.record_id = a.record_id AND c.lead = a.lead))"""


def _drivers(spark, sf):
    rated = _rated(spark, sf)
    return C.boundary_drivers(rated, qc.unit_status(rated).filter("worst_status <> 'critical'"))


@query("boundary_driver_audit", f"WITH {DRIVER_SQL} SELECT * FROM drv")
def boundary_driver_audit(spark, sf):
    return _drivers(spark, sf)


DRIVER_UNIT_SQL = DRIVER_SQL + """, du AS (SELECT record_id, lead, count(*) AS n_boundaries_driven,
   string_agg(landmark, ';' ORDER BY landmark) AS fiducials, round(max(margin_ms), 1) AS max_margin_ms FROM drv GROUP BY ALL)"""


@query("boundary_driver_units", f"WITH {DRIVER_UNIT_SQL} SELECT * FROM du ORDER BY max_margin_ms DESC, n_boundaries_driven DESC")
def boundary_driver_units(spark, sf):
    return C.driver_units(_drivers(spark, sf)).orderBy(F.desc("max_margin_ms"), F.desc("n_boundaries_driven"))


@query(
    "boundary_driver_margins",
    f"WITH {DRIVER_UNIT_SQL} SELECT at_least_ms, count(*) FILTER (max_margin_ms >= at_least_ms) AS n_units "
    "FROM du, (SELECT unnest([0.0::DOUBLE, 4.0, 10.0, 20.0, 40.0]) AS at_least_ms) s GROUP BY at_least_ms",
)
def boundary_driver_margins(spark, sf):
    return C.margin_histogram(C.driver_units(_drivers(spark, sf)))


UNIFY_SQL = BEATS_SQL + """, near2 AS (SELECT record_id, min(beat_id) AS beat_id FROM beats GROUP BY record_id),
 u AS (SELECT b.* FROM beats b JOIN near2 USING (record_id, beat_id)),
 tally AS (SELECT record_id, qrs_onset AS o, qrs_offset AS f, count(*) AS n FROM u GROUP BY ALL),
 pick AS (SELECT record_id, o, f FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, o, f) AS k FROM tally) z WHERE k = 1),
 tmin AS (SELECT record_id, min(t_onset) AS t FROM u GROUP BY record_id),
 fb AS (SELECT record_id, qrs_onset AS fo, qrs_offset AS ff FROM u WHERE lead = 2),
 want AS (SELECT p.record_id, CASE WHEN t < f AND fo IS NOT NULL THEN fo ELSE o END AS won, CASE WHEN t < f AND ff IS NOT NULL THEN ff ELSE f END AS wof
   FROM pick p JOIN tmin USING (record_id) LEFT JOIN fb USING (record_id))"""


@query(
    "unify_record_boundary",
    f"WITH {UNIFY_SQL} SELECT record_id, lead, won AS qrs_onset, wof AS qrs_offset, CASE WHEN t_onset IS NOT NULL THEN greatest(t_onset, wof) END AS t_onset "
    "FROM u JOIN want USING (record_id)",
)
def unify_record_boundary(spark, sf):
    b = materialise(beats(spark, sf))
    first = b.groupBy("record_id").agg(F.min("beat_id").alias("beat_id"))
    u = materialise(b.join(first, ["record_id", "beat_id"], "left_semi"))
    out = C.unify_core_boundary(u, u.filter("lead = 2"))
    return out.select("record_id", "lead", "qrs_onset", "qrs_offset", "t_onset")


@query(
    "widened_windows",
    f"WITH {BEATS_SQL} SELECT record_id, CAST(sum(least(qrs_onset - 100, {','.join(LM)})) AS BIGINT) AS start_sum, "
    f"CAST(sum(greatest(qrs_onset + 100, {','.join(LM)})) AS BIGINT) AS end_sum FROM beats GROUP BY record_id",
)
def widened_windows(spark, sf):
    b = beats(spark, sf).withColumns({"ws": F.col("qrs_onset") - 100, "we": F.col("qrs_onset") + 100})
    return C.widen_window(b, "ws", "we", LM).groupBy("record_id").agg(
        F.sum("ws").alias("start_sum"), F.sum("we").alias("end_sum")
    )


# ---------------------------------------------------------------- worklists

WL_SQL = DEV_SQL.replace("WITH ", "") .replace(BEATS_SQL, QC_SQL) + UNIT_SQL[len(QC_SQL):] + """, prim AS (SELECT record_id, lead,
   greatest(flag_r_peak, flag_s_peak, flag_qrs_offset, flag_t_onset, flag_t_peak, flag_t_offset) AS crosslead_flag FROM cl),
 wl AS (SELECT u.*, coalesce(crosslead_flag, 0) AS crosslead_flag, CASE WHEN persistent THEN '1_critical' ELSE '2_crosslead' END AS priority_tier
   FROM ust u LEFT JOIN prim USING (record_id, lead) WHERE persistent OR (n_critical > 0 AND coalesce(crosslead_flag, 0) = 1))"""


def _flags(rated):
    first = materialise(keep_first(rated.drop("qc_flags", "qc_status"), ["record_id", "lead"], ["beat_id"]))
    return review.primary_flag(qc.cross_channel_qc(first, [2, 5]))


def _worklist(spark, sf):
    rated = _rated(spark, sf)
    u = qc.unit_status(rated, extra=["disease_class"])
    return review.review_worklist(u, _flags(rated))


@query(
    "review_worklist",
    f"WITH {WL_SQL} SELECT record_id, lead, disease_class, n_beats, n_critical, crosslead_flag, round_even(n_critical / n_beats, 2) AS frac_critical, "
    "priority_tier, example_beat, example_flags FROM wl ORDER BY priority_tier, frac_critical DESC",
)
def review_worklist(spark, sf):
    w = _worklist(spark, sf)
    return w.select(
        "record_id", "lead", "disease_class", "n_beats", "n_critical", "crosslead_flag",
        F.bround("frac_critical", 2).alias("frac_critical"), "priority_tier", "example_beat",
        F.array_join("example_flags", ";").alias("example_flags"),
    ).orderBy("priority_tier", F.desc("frac_critical"))


SEGMENTS = ("MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE")
SEG_RANK = "CASE disease_class " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGMENTS)) + " ELSE 99 END"


@query(
    "all_units_worklist",
    f"""WITH {WL_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY record_id, lead ORDER BY beat_id) - 1 AS i,
      count(*) OVER (PARTITION BY record_id, lead) AS n FROM qcd),
    st AS (SELECT r.record_id, r.lead, r.beat_id, r.qc_status AS rep_qc_status, u.worst_status AS unit_worst_status,
      CASE w.priority_tier WHEN '1_critical' THEN 'critical' WHEN '2_crosslead' THEN 'minor' ELSE 'clean' END AS qc_status,
      coalesce(p.crosslead_flag, 0) AS crosslead_flag
     FROM rk r JOIN ust u USING (record_id, lead) LEFT JOIN wl w USING (record_id, lead) LEFT JOIN prim p USING (record_id, lead)
     WHERE i = CASE WHEN n < 3 THEN 0 ELSE greatest(1, least(n-2, CAST(round_even(n/2, 0) AS BIGINT) - 1)) END)
    SELECT *, CASE qc_status WHEN 'critical' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END AS priority,
      CASE WHEN qc_status = 'critical' THEN 1 WHEN unit_worst_status = 'critical' AND crosslead_flag = 1 THEN 2 ELSE 3 END AS priority_crosslead
    FROM st""",
)
def all_units_worklist(spark, sf):
    rated = _rated(spark, sf)
    u = materialise(qc.unit_status(rated))
    flags = materialise(_flags(rated))
    w = review.all_units_worklist(
        rated.select("record_id", "lead", "beat_id", "qc_status", "disease_class"), u, review.review_worklist(u, flags), flags
    )
    out = w.orderBy(*review.worklist_order(classes=SEGMENTS))
    return out.select(
        "record_id", "lead", "beat_id", "rep_qc_status", "unit_worst_status", "qc_status", "crosslead_flag", "priority", "priority_crosslead"
    )


@query(
    "worst_status_by_class",
    f"""WITH {UNIT_SQL} SELECT disease_class, lead, CASE min(CASE worst_status WHEN 'critical' THEN 0 WHEN 'minor' THEN 1 ELSE 2 END)
      WHEN 0 THEN 'critical' WHEN 1 THEN 'minor' ELSE 'clean' END AS worst FROM ust GROUP BY ALL""",
)
def worst_status_by_class(spark, sf):
    u = qc.unit_status(_rated(spark, sf), extra=["disease_class"])
    return u.groupBy("disease_class", "lead").agg(review.worst_of(F.col("worst_status")).alias("worst"))


@query(
    "corrector_batches",
    f"""WITH RECURSIVE {WL_SQL}, t1 AS (SELECT *, {SEG_RANK} AS cls FROM wl WHERE priority_tier = '1_critical'),
    e0 AS (SELECT record_id, cls, count(*) AS size FROM t1 GROUP BY record_id, cls),
    ent AS (SELECT *, row_number() OVER (ORDER BY cls, record_id) AS place FROM e0),
    walk AS (SELECT place, record_id, size AS open, CAST(1 AS BIGINT) AS batch FROM ent WHERE place = 1
      UNION ALL SELECT e.place, e.record_id, CASE WHEN w.open >= 250 THEN e.size ELSE w.open + e.size END,
        w.batch + CASE WHEN w.open >= 250 THEN 1 ELSE 0 END FROM walk w JOIN ent e ON e.place = w.place + 1)
    SELECT t.record_id, t.lead, batch, row_number() OVER (ORDER BY cls, t.record_id, t.lead) AS order_index
    FROM t1 t JOIN walk USING (record_id)""",
)
def corrector_batches(spark, sf):
    p = review.corrector_plan(_worklist(spark, sf), "record_id", classes=SEGMENTS)
    return p.select("record_id", "lead", "batch", "order_index")


@query(
    "best_channel",
    f"""WITH {BEATS_SQL}{cons_sql(0.25)}, g AS (SELECT c.* FROM cons c JOIN (SELECT record_id, min(beat_id) AS beat_id FROM beats GROUP BY 1) m USING (record_id, beat_id)),
    u AS (SELECT record_id, lead, {", ".join(f"arg_min({c}, beat_id) AS {c}" for c in LM if c not in ("x",))} FROM (SELECT * FROM beats b
       QUALIFY row_number() OVER (PARTITION BY record_id, lead ORDER BY beat_id) = 1) z GROUP BY record_id, lead),
    d AS (SELECT u.record_id, u.lead, list_avg(list_filter([{", ".join(f"abs((u.{c}-u.r_peak)-(g.{c}-g.r_peak))" for c in L.boundaries)}], lambda v: v IS NOT NULL))*2 AS dev
      FROM u JOIN g USING (record_id))
    SELECT record_id, coalesce(arg_min(lead, struct_pack(a := dev, b := lead)) FILTER (dev IS NOT NULL), 2) AS best, round(min(dev), 6) AS deviation_ms FROM d GROUP BY record_id""",
)
def best_channel(spark, sf):
    b = beats(spark, sf)
    first = b.groupBy("record_id").agg(F.min("beat_id").alias("beat_id"))
    cons = C.consensus_positions(b, 0.25, ref_channel=2).join(first, ["record_id", "beat_id"], "left_semi")
    out = review.best_channel(units(spark, sf), cons, default=2)
    return out.withColumn("deviation_ms", F.round("deviation_ms", 6))


# ---------------------------------------------------------------- corrections

LAST_SQL = CORR_SQL + """, rev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, lead ORDER BY edited_at DESC) AS k
   FROM feed WHERE reviewed = 1) z WHERE k = 1)"""
LATE = ["t_onset", "t_peak", "t_offset"]


def _moved_sql(c: str) -> str:
    if c in LATE:
        return f"CAST(round_even(c.qrs_offset + (a - a0) + (c.{c} - c.qrs_offset) * sc, 0) AS BIGINT)"
    return f"(c.{c} + a - a0)"


MERGE_SQL = (
    f"""WITH {LAST_SQL}, m0 AS (SELECT *, coalesce(qrs_onset, r_peak) AS a FROM beats),
    m1 AS (SELECT *, nullif(lead(a) OVER (PARTITION BY record_id, lead ORDER BY beat_id) - a, 0) AS rr0 FROM m0),
    md AS (SELECT record_id, lead, list_extract(list(rr0 ORDER BY rr0) FILTER (rr0 IS NOT NULL),
       CAST(floor(count(rr0)/2) AS BIGINT) + 1) AS med FROM m1 GROUP BY record_id, lead),
    m2 AS (SELECT m1.*, med, coalesce(rr0, med) AS rr FROM m1 JOIN md USING (record_id, lead)),
    rp AS (SELECT m2.record_id, m2.lead, m2.beat_id AS rep, a AS a0, rr AS rr_rep FROM m2 JOIN rev c ON m2.record_id = c.record_id AND m2.lead = c.lead
      WHERE m2.beat_id = c.beat_id),
    j AS (SELECT m.*, rep, a0, least(2.0, greatest(0.5, coalesce(rr / rr_rep, 1.0))) AS sc FROM m2 m LEFT JOIN rp ON m.record_id = rp.record_id AND m.lead = rp.lead)
    SELECT j.record_id, j.lead, j.beat_id, CASE WHEN rep IS NULL THEN NULL WHEN rep = j.beat_id THEN 'corrected' ELSE 'propagated' END AS label_quality, """
    + ", ".join(f"CASE WHEN rep IS NULL THEN j.{c} WHEN {_moved_sql(c)} BETWEEN 0 AND n_samples - 1 THEN {_moved_sql(c)} END AS {c}" for c in LM)
    + " FROM j LEFT JOIN rev c ON j.record_id = c.record_id AND j.lead = c.lead"
)


@query("merge_corrections", MERGE_SQL)
def merge_corrections(spark, sf):
    b = lay_out(beats(spark, sf), ["record_id", "lead"], "beat_id")
    u = keep_first(b.drop("_piece"), ["record_id", "lead"], ["beat_id"])
    last = review.latest_corrections(correction_feed(spark, sf, u))
    out = review.merge_corrections(b.drop("edited_at"), last)
    return out.select("record_id", "lead", "beat_id", "label_quality", *LM)


@query(
    "merge_corrections_derived",
    MERGE_SQL.replace("\n    SELECT j.record_id, j.lead, j.beat_id, CASE WHEN rep IS NULL THEN NULL WHEN rep = j.beat_id THEN 'corrected' ELSE 'propagated' END AS label_quality",
                            ",\n    m9 AS (SELECT j.record_id, j.lead, j.beat_id, rep IS NOT NULL AS act, j.n_samples").replace(" FROM j LEFT JOIN rev c ON j.record_id = c.record_id AND j.lead = c.lead", ", "
    + " + ".join(f"CASE WHEN rep IS NOT NULL AND c.{c} IS NOT NULL AND {_moved_sql(c)} IS NOT NULL AND NOT {_moved_sql(c)} BETWEEN 0 AND n_samples - 1 THEN 1 ELSE 0 END" for c in LM)
    + """ AS n_outside FROM j LEFT JOIN rev c ON j.record_id = c.record_id AND j.lead = c.lead)
    SELECT record_id, lead, beat_id, CAST(n_outside AS INTEGER) AS n_outside, """ + ", ".join(f"CASE WHEN act THEN round({c}*2.0::DOUBLE, 3) ELSE -1.0::DOUBLE END AS {c}_ms" for c in LM)
    + ", CASE WHEN act THEN round((t_offset - qrs_onset)*2.0::DOUBLE, 3) ELSE -1.0::DOUBLE END AS qt_interval_ms, CASE WHEN act THEN round((t_peak - qrs_onset)*2.0::DOUBLE, 3) ELSE -1.0::DOUBLE END AS qt_peak_ms FROM m9"),
)
def merge_corrections_derived(spark, sf):
    """The master's stale derived columns (here -1) follow the corrected positions."""
    b = lay_out(beats(spark, sf), ["record_id", "lead"], "beat_id")
    u = keep_first(b.drop("_piece"), ["record_id", "lead"], ["beat_id"])
    last = review.latest_corrections(correction_feed(spark, sf, u))
    names = [*[f"{c}_ms" for c in LM], "qt_interval_ms", "qt_peak_ms"]
    stale = b.drop("edited_at").withColumns({n: F.lit(-1.0) for n in names} | {"fs_hz": F.lit(500.0)})
    out = review.merge_corrections(stale, last, n_outside="n_outside")
    return out.select("record_id", "lead", "beat_id", "n_outside", *[F.round(n, 3).alias(n) for n in names])


@query("latest_corrections", f"WITH {LAST_SQL} SELECT record_id, lead, beat_id, epoch_us(edited_at) AS edited_us, r_peak, q_peak FROM rev")
def latest_corrections(spark, sf):
    from .fixtures import micros

    c = review.latest_corrections(correction_feed(spark, sf))
    return c.select("record_id", "lead", "beat_id", micros("edited_at").alias("edited_us"), "r_peak", "q_peak")


UPSERT_SQL = CORR_SQL + """, old AS (SELECT record_id, lead, CASE WHEN record_id % 3 = 0 THEN edited_at + INTERVAL 1 DAY ELSE edited_at - INTERVAL 1 DAY END AS edited_at, qrs_onset + 1 AS qrs_onset FROM corr),
    every AS (SELECT * FROM old UNION ALL SELECT record_id, lead, edited_at, qrs_onset FROM feed)
    SELECT record_id, lead, qrs_onset FROM (SELECT *, row_number() OVER (PARTITION BY record_id, lead ORDER BY edited_at DESC) AS k FROM every) z WHERE k = 1"""


def _saved_and_fed(spark, sf):
    """All corrections as saved, a third of them later than the feed has them, and the whole feed."""
    cols = ["record_id", "lead", "edited_at", "qrs_onset"]
    u = stored_units(spark, sf)
    at = F.when(F.col("record_id") % 3 == 0, F.expr("edited_at + INTERVAL 1 DAY")).otherwise(F.expr("edited_at - INTERVAL 1 DAY"))
    old = corrections(spark, sf, u).withColumns({"edited_at": at, "qrs_onset": F.col("qrs_onset") + 1})
    return old.select(*cols), correction_feed(spark, sf, u).select(*cols)


@query("upsert_corrections", f"WITH {UPSERT_SQL}")
def upsert_corrections(spark, sf):
    old, new = _saved_and_fed(spark, sf)
    return review.upsert(old, new, ["record_id", "lead"], ["edited_at"]).select("record_id", "lead", "qrs_onset")


@query("bucketed_corrections", f"WITH {UPSERT_SQL}")
def bucketed_corrections(spark, sf):
    """The same through a table in buckets: saved once, then changed by a feed in two batches, the second of which is sent twice."""
    old, new = _saved_and_fed(spark, sf)
    root, unit = f"{shared_folder(spark)}/corrections-{uuid.uuid4().hex}", ["record_id", "lead"]
    buckets.fold_changes(old, root, unit, ["edited_at"], n_buckets=16)
    for number, part in enumerate((new.filter("lead <= 3"), new.filter("lead > 3"), new.filter("lead > 3"))):
        buckets.fold_changes(part, root, unit, ["edited_at"], feed="corrections", batch=min(number, 1))
    return buckets.read_buckets(spark, root).select("record_id", "lead", "qrs_onset")


@query(
    "apply_deletions",
    f"""WITH {CORR_SQL}, ex AS (SELECT DISTINCT record_id FROM beats WHERE record_id % 101 = 0)
    SELECT 'beats' AS table_name, count(*) FILTER (record_id NOT IN (SELECT * FROM ex)) AS kept, count(*) FILTER (record_id IN (SELECT * FROM ex)) AS removed FROM beats
    UNION ALL SELECT 'corrections', count(*) FILTER (record_id NOT IN (SELECT * FROM ex)), count(*) FILTER (record_id IN (SELECT * FROM ex)) FROM corr""",
)
def apply_deletions(spark, sf):
    b = beats(spark, sf)
    excluded = b.filter("record_id % 101 = 0").select("record_id")
    return review.exclusion_report({"beats": b, "corrections": corrections(spark, sf), "labels": spark.range(1)}, excluded)


@query(
    "apply_deletions_rows",
    f"WITH {BEATS_SQL} SELECT record_id, count(*) AS n FROM beats WHERE record_id % 101 <> 0 GROUP BY record_id",
)
def apply_deletions_rows(spark, sf):
    b = beats(spark, sf)
    kept = review.apply_exclusions({"b": b}, b.filter("record_id % 101 = 0"))["b"]
    return kept.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fill_from_sibling",
    f"""WITH {BEATS_SQL}, f AS (SELECT record_id, beat_id, arg_min(r_peak, lead) FILTER (r_peak IS NOT NULL) AS s FROM beats GROUP BY ALL)
    SELECT lead, count(r_peak) AS had, count(coalesce(r_peak, s)) AS have, CAST(sum(coalesce(r_peak, s)) AS BIGINT) AS total
    FROM beats JOIN f USING (record_id, beat_id) GROUP BY lead""",
)
def fill_from_sibling(spark, sf):
    from ..schema import Keys

    b = beats(spark, sf).withColumns({"was": F.col("r_peak"), "occ": F.struct("record_id", "beat_id")})
    out = review.fill_from_sibling(b, "r_peak", Keys(entity="occ"))
    return out.groupBy("lead").agg(F.count("was").alias("had"), F.count("r_peak").alias("have"), F.sum("r_peak").alias("total"))


# ---------------------------------------------------------------- events across channels

TOL = 3_600_000_000
CHANNELS = ["click", "error", "purchase", "signup", "view"]
CLUSTER_SQL = EVENTS_SQL + f""", g AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= {TOL} THEN 0 ELSE 1 END AS fresh FROM ev
   WINDOW w AS (PARTITION BY record_id ORDER BY pos, event_id)),
 c AS (SELECT *, sum(fresh) OVER (PARTITION BY record_id ORDER BY pos, event_id) AS k FROM g),
 agreed AS (SELECT record_id, min(pos) AS cluster, count(*) AS n_events, count(DISTINCT channel) AS n_agree,
   CAST(round(median(pos)) AS BIGINT) AS position FROM c GROUP BY record_id, k HAVING count(DISTINCT channel) >= 3)"""
DAY = 86_400_000_000


@query("event_consensus", f"WITH {CLUSTER_SQL} SELECT * FROM agreed")
def event_consensus(spark, sf):
    return C.event_consensus(events(spark, sf), ["record_id"], "channel", "pos", TOL, len(CHANNELS), tie=["event_id"], grain=DAY)


@query(
    "event_consensus_spread",
    f"""WITH {CLUSTER_SQL}, ch AS (SELECT DISTINCT channel FROM ev), cc AS (SELECT *, min(pos) OVER (PARTITION BY record_id, k) AS cluster FROM c)
    SELECT ch.channel, count(*) AS n_events, count(*) FILTER (EXISTS (SELECT 1 FROM cc WHERE cc.record_id = a.record_id AND cc.cluster = a.cluster
      AND cc.channel = ch.channel)) AS n_matched FROM agreed a, ch GROUP BY ch.channel""",
)
def event_consensus_spread(spark, sf):
    ev = events(spark, sf)
    labelled = C.event_clusters(ev, ["record_id"], "pos", TOL, ["event_id"], grain=DAY)
    agreed = C.event_consensus(ev, ["record_id"], "channel", "pos", TOL, len(CHANNELS), tie=["event_id"], grain=DAY)
    full = C.spread_consensus(labelled, agreed, ["record_id"], "channel", CHANNELS)
    return full.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.col("matched").cast("bigint")).alias("n_matched")
    )


NEAR = 6 * TOL


def _turns_sql() -> str:
    """Greedy matching with removal, one channel after the other."""
    parts = [f"{EVENTS_SQL}, l0 AS (SELECT record_id, channel, event_id, pos, CASE WHEN event_id % 13 <> 0 THEN pos - 1000000*(event_id % 97) END AS first, pos + 1000000*(event_id % 89) AS last FROM ev)"]
    for i, c in enumerate(CHANNELS):
        parts.append(f"""m{i + 1} AS (SELECT a.record_id, {i + 1} AS turn, a.event_id AS anchor, b.channel, b.event_id, b.pos, b.first, b.last FROM l{i} a JOIN l{i} b ON a.record_id = b.record_id AND abs(b.pos - a.pos) <= {NEAR}
          WHERE a.channel = '{c}' QUALIFY row_number() OVER (PARTITION BY a.record_id, a.event_id, b.channel ORDER BY abs(b.pos - a.pos), b.pos, b.event_id) = 1),
         l{i + 1} AS (SELECT * FROM l{i} ANTI JOIN m{i + 1} USING (record_id, channel, event_id))""")
    every = " UNION ALL ".join(f"SELECT * FROM m{i + 1}" for i in range(len(CHANNELS)))
    parts.append(f"""m AS ({every}), g AS (SELECT record_id, turn, anchor, CAST(round(median(pos)) AS BIGINT) AS pos, CAST(round(median(first)) AS BIGINT) AS first, CAST(round(median(last)) AS BIGINT) AS last,
      count(*) AS n_agree FROM m GROUP BY ALL HAVING count(*) >= {len(CHANNELS)} / 2.0),
     synced AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY record_id, pos ORDER BY turn, anchor) = 1)""")
    return ", ".join(parts)


TURNS_SQL = _turns_sql()


def _agreed(spark, sf):
    ev = events(spark, sf).withColumns({
        "first": F.when(F.col("event_id") % 13 != 0, F.col("pos") - 1000000 * (F.col("event_id") % 97)), "last": F.col("pos") + 1000000 * (F.col("event_id") % 89)})
    return C.matched_events(ev, ["record_id"], "channel", "pos", "event_id", ["first", "last"], CHANNELS, NEAR, grain=DAY)


@query("matched_events", f"WITH {TURNS_SQL} SELECT record_id, CAST(turn AS INTEGER) AS turn, anchor, pos, first, last, CAST(n_agree AS INTEGER) AS n_agree FROM synced")
def matched_events(spark, sf):
    return _agreed(spark, sf).drop("matches")


@query(
    "matched_events_by_channel",
    f"""WITH {TURNS_SQL}, ch AS (SELECT DISTINCT channel FROM ev) SELECT s.record_id, CAST(s.turn AS INTEGER) AS turn, s.anchor, ch.channel, m.event_id IS NOT NULL AS matched, m.event_id,
      CASE WHEN m.event_id IS NULL THEN s.pos ELSE m.pos END AS pos, CASE WHEN m.event_id IS NULL THEN s.first ELSE m.first END AS first, CASE WHEN m.event_id IS NULL THEN s.last ELSE m.last END AS last
    FROM synced s CROSS JOIN ch LEFT JOIN m ON m.record_id = s.record_id AND m.turn = s.turn AND m.anchor = s.anchor AND m.channel = ch.channel""",
)
def matched_events_by_channel(spark, sf):
    return C.spread_matches(_agreed(spark, sf), ["record_id"], ["pos", "first", "last"], CHANNELS)


@query(
    "nearest_event_match",
    f"""WITH {EVENTS_SQL}, l AS (SELECT * FROM ev WHERE channel = 'click'), r AS (SELECT * FROM ev WHERE channel = 'purchase'),
    p AS (SELECT l.event_id, r.event_id AS rid, r.pos AS rpos, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.pos - l.pos), r.pos, r.event_id) AS k
      FROM l JOIN r ON l.record_id = r.record_id AND abs(r.pos - l.pos) <= {DAY})
    SELECT l.record_id, l.event_id, p.rid AS near_event_id, p.rpos AS near_pos FROM l LEFT JOIN p ON l.event_id = p.event_id AND k = 1""",
)
def nearest_event_match(spark, sf):
    ev = events(spark, sf).select("record_id", "channel", "event_id", "pos")
    out = C.nearest_by_order(
        ev.filter("channel = 'click'"), ev.filter("channel = 'purchase'"), ["record_id"], "pos", "pos", "event_id", "event_id",
        tolerance=DAY, grain=30 * DAY,
    )
    return out.select("record_id", "event_id", "near_event_id", "near_pos")


@query(
    "nearest_event_anchor",
    f"""WITH {BEATS_SQL}, q AS (SELECT record_id, lead, 100 + 37 * (record_id % 50) AS target FROM beats GROUP BY ALL),
    p AS (SELECT q.*, b.beat_id, row_number() OVER (PARTITION BY q.record_id, q.lead ORDER BY abs(b.qrs_onset - target), b.beat_id) AS k
      FROM q JOIN beats b ON q.record_id = b.record_id AND q.lead = b.lead)
    SELECT record_id, lead, beat_id FROM p WHERE k = 1""",
)
def nearest_event_anchor(spark, sf):
    b = beats(spark, sf).select("record_id", "lead", "beat_id", "qrs_onset")
    target = F.lit(100) + F.lit(37) * (F.col("record_id") % 50)
    gap = F.struct(F.abs(F.col("qrs_onset") - target), F.col("beat_id"))
    return b.groupBy("record_id", "lead").agg(F.min_by("beat_id", gap).alias("beat_id"))
