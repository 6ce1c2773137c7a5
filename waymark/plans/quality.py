"""Queries on row rules, unit and record status, cross-channel consistency and derived intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import derive, qc
from ..operators.ordered import keep_first
from ..schema import LANDMARKS_11, require_columns
from .fixtures import BEATS_SQL, EVENTS_SQL, LM, UNITS_SQL, beats, events, stored_units, units
from .registry import query

L = LANDMARKS_11
CORE = (3, 7)

LONG_SQL = (
    "SELECT record_id, lead, beat_id, unnest([" + ",".join(str(i) for i in range(len(LM))) + "]) AS pos, unnest(["
    + ",".join(LM) + "]) AS v FROM beats"
)
QC_SQL = BEATS_SQL + f""", seq AS (SELECT * FROM ({LONG_SQL}) u WHERE v IS NOT NULL),
steps AS (SELECT *, lag(v) OVER w AS pv, lag(pos) OVER w AS pp FROM seq
  WINDOW w AS (PARTITION BY record_id, lead, beat_id ORDER BY pos)),
inv AS (SELECT record_id, lead, beat_id,
   bool_or(pv - v > 3 AND pp BETWEEN 3 AND 7 AND pos BETWEEN 3 AND 7) AS st,
   max(CASE WHEN pv - v > 20 AND NOT (pp BETWEEN 3 AND 7 AND pos BETWEEN 3 AND 7) THEN pv - v END) AS gross,
   bool_or(pv - v > 3 AND pv - v <= 20 AND NOT (pp BETWEEN 3 AND 7 AND pos BETWEEN 3 AND 7)) AS mild
  FROM steps GROUP BY ALL),
rated AS (SELECT b.*, coalesce(mild, false) AS mild,
   list_filter([CASE WHEN st THEN 'QRS_structural' END,
    'gross_boundary:' || CAST(gross AS VARCHAR) || 'smp',
    CASE WHEN (qrs_offset-qrs_onset)*2 NOT BETWEEN 40 AND 200
      THEN 'QRSdur=' || CAST((qrs_offset-qrs_onset)*2 AS VARCHAR) || 'ms' END,
    CASE WHEN (t_offset-qrs_onset)*2 NOT BETWEEN 250 AND 700
      THEN 'QT=' || CAST((t_offset-qrs_onset)*2 AS VARCHAR) || 'ms' END,
    CASE WHEN (qrs_onset-p_onset)*2 NOT BETWEEN 80 AND 400
      THEN 'PR=' || CAST((qrs_onset-p_onset)*2 AS VARCHAR) || 'ms' END,
    CASE WHEN r_peak IS NULL THEN 'R_missing' END], lambda x: x IS NOT NULL) AS fl
  FROM beats b LEFT JOIN inv USING (record_id, lead, beat_id)),
qcd AS (SELECT *, CASE WHEN len(fl) > 0 THEN 'critical' WHEN mild THEN 'minor' ELSE 'clean' END AS qc_status,
   array_to_string(fl, ';') AS qc_flags FROM rated)"""


@query("beat_qc_tiers", f"WITH {QC_SQL} SELECT disease_class, qc_status, count(*) AS n FROM qcd GROUP BY ALL")
def beat_qc_tiers(spark, sf):
    return qc.beat_qc(beats(spark, sf)).groupBy("disease_class", "qc_status").agg(F.count(F.lit(1)).alias("n"))


@query("beat_qc_rows", f"WITH {QC_SQL} SELECT record_id, lead, beat_id, qc_status, qc_flags FROM qcd")
def beat_qc_rows(spark, sf):
    out = qc.beat_qc(beats(spark, sf))
    return out.select("record_id", "lead", "beat_id", "qc_status", F.array_join("qc_flags", ";").alias("qc_flags"))


@query(
    "beat_qc_reasons",
    f"""WITH {QC_SQL} SELECT disease_class, regexp_extract(f, '^[^:=]*') AS reason, count(*) AS n
    FROM (SELECT disease_class, unnest(fl) AS f FROM qcd) u GROUP BY ALL""",
)
def beat_qc_reasons(spark, sf):
    r = qc.flag_reasons(qc.beat_qc(beats(spark, sf)))
    return r.groupBy("disease_class", "reason").agg(F.count(F.lit(1)).alias("n"))


RECORD_SQL = QC_SQL + """, tot AS (SELECT record_id, min(disease_class) AS disease_class, count(*) AS beats_total,
   count(*) FILTER (qc_status='critical') AS beats_critical, count(*) FILTER (qc_status='minor') AS beats_minor
  FROM qcd GROUP BY record_id),
tal AS (SELECT record_id, regexp_extract(f, '^[^:=]*') AS reason, count(*) AS n
  FROM (SELECT record_id, unnest(fl) AS f FROM qcd) u GROUP BY ALL),
top AS (SELECT record_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, reason) AS k
  FROM tal) u WHERE k = 1),
recs AS (SELECT tot.*, round_even(beats_critical / beats_total, 4) AS frac_critical,
  coalesce(reason, '') AS dominant_reason FROM tot LEFT JOIN top USING (record_id))"""


@query("record_qc_summary", f"WITH {RECORD_SQL} SELECT * FROM recs")
def record_qc_summary(spark, sf):
    return qc.record_qc_summary(qc.beat_qc(beats(spark, sf)), extra=["disease_class"])


@query(
    "worst_records_top5",
    f"WITH {RECORD_SQL} SELECT record_id, beats_critical, frac_critical FROM recs "
    "ORDER BY frac_critical DESC, beats_critical DESC, record_id LIMIT 5",
)
def worst_records_top5(spark, sf):
    r = qc.record_qc_summary(qc.beat_qc(beats(spark, sf)), extra=["disease_class"])
    order = [F.desc("frac_critical"), F.desc("beats_critical"), F.col("record_id")]
    return r.orderBy(*order).limit(5).select("record_id", "beats_critical", "frac_critical")


UNIT_SQL = QC_SQL + """, ust AS (SELECT record_id, lead, min(disease_class) AS disease_class, count(*) AS n_beats,
   count(*) FILTER (qc_status='critical') AS n_critical, count(*) FILTER (qc_status='minor') AS n_minor,
   min(beat_id) FILTER (qc_status='critical') AS example_beat,
   arg_min(qc_flags, beat_id) FILTER (qc_status='critical') AS example_flags,
   CASE WHEN count(*) FILTER (qc_status='critical') > 0 THEN 'critical'
        WHEN count(*) FILTER (qc_status='minor') > 0 THEN 'minor' ELSE 'clean' END AS worst_status,
   count(*) FILTER (qc_status='critical') / count(*) >= 0.5 AS persistent
  FROM qcd GROUP BY record_id, lead)"""


@query(
    "unit_persistence",
    f"""WITH {UNIT_SQL} SELECT disease_class, count(*) AS n_units, count(*) FILTER (n_critical > 0) AS units_any,
     count(*) FILTER (persistent) AS units_persistent,
     round(avg(CASE WHEN persistent THEN 1 ELSE 0 END), 6) AS persistent_rate,
     round(1 - sum(CASE WHEN persistent THEN n_critical ELSE 0 END) / sum(n_critical), 6) AS transient_share
    FROM ust GROUP BY disease_class""",
)
def unit_persistence(spark, sf):
    u = qc.unit_status(qc.beat_qc(beats(spark, sf)), extra=["disease_class"])
    return qc.unit_persistence(u, ["disease_class"])


@query(
    "unit_status",
    f"WITH {UNIT_SQL} SELECT record_id, lead, n_beats, n_critical, n_minor, example_beat, example_flags, worst_status FROM ust",
)
def unit_status(spark, sf):
    u = qc.unit_status(qc.beat_qc(beats(spark, sf)))
    return u.select(
        "record_id", "lead", "n_beats", "n_critical", "n_minor", "example_beat",
        F.array_join("example_flags", ";").alias("example_flags"), "worst_status",
    )


RSTAT_SQL = UNIT_SQL + """, rst AS (SELECT record_id, max(CASE WHEN persistent THEN 1 ELSE 0 END) AS genuine,
   count(*) FILTER (persistent) AS n_problem_leads,
   coalesce(string_agg(CAST(lead AS VARCHAR), ';' ORDER BY lead) FILTER (persistent), '') AS problem_leads,
   CASE WHEN bool_or(persistent) THEN 'critical' WHEN max(n_critical) > 0 THEN 'minor' ELSE 'clean' END AS qc_status
  FROM ust GROUP BY record_id)"""


@query("record_status", f"WITH {RSTAT_SQL} SELECT * FROM rst")
def record_status(spark, sf):
    return qc.record_status(qc.unit_status(qc.beat_qc(beats(spark, sf))))


# ---------------------------------------------------------------- cross-channel consistency

DEVC = [c for c in LM if c != "qrs_onset"]
DEV_SQL = UNITS_SQL + ", ref AS (SELECT record_id, " + ", ".join(
    f"avg(CASE WHEN lead IN (2,5) THEN ({c}-qrs_onset)*2.0 END) AS r_{c}" for c in DEVC
) + " FROM units GROUP BY record_id), dev AS (SELECT record_id, lead, disease_class, " + ", ".join(
    f"abs(CAST(({c}-qrs_onset)*2 AS DOUBLE) - r_{c}) AS dev_{c}" for c in DEVC
) + " FROM units JOIN ref USING (record_id)), tol AS (SELECT " + ", ".join(
    f"round_even(quantile_cont(dev_{c}, 0.98), 0) AS t_{c}" for c in DEVC
) + " FROM dev), flg AS (SELECT record_id, lead, disease_class, " + ", ".join(
    f"round(dev_{c}, 6) AS dev_{c}, CASE WHEN dev_{c} > t_{c} THEN 1 ELSE 0 END AS flag_{c}" for c in DEVC
) + " FROM dev, tol), cl AS (SELECT *, greatest(" + ", ".join(f"flag_{c}" for c in DEVC) + ") AS any_flag FROM flg)"


def _cl(spark, sf):
    return qc.cross_channel_qc(stored_units(spark, sf), [2, 5])


@query("crosslead_qc_flags", f"WITH {DEV_SQL} SELECT * FROM cl")
def crosslead_qc_flags(spark, sf):
    c = _cl(spark, sf)
    return c.select(
        "record_id", "lead", "disease_class",
        *[F.round(f"dev_{x}", 6).alias(f"dev_{x}") for x in DEVC], *[f"flag_{x}" for x in DEVC], "any_flag",
    )


@query(
    "crosslead_rates_by_channel",
    f"WITH {DEV_SQL} SELECT lead, count(*) AS n_units, "
    + ", ".join(f"round(avg(flag_{c})*100, 6) AS flag_{c}_pct" for c in DEVC)
    + ", round(avg(any_flag)*100, 6) AS any_flag_pct FROM cl GROUP BY lead",
)
def crosslead_rates_by_channel(spark, sf):
    return qc.flag_rates(_cl(spark, sf), ["lead"], [f"flag_{c}" for c in DEVC])


@query(
    "crosslead_rates_by_class",
    f"WITH {DEV_SQL} SELECT disease_class, count(*) AS n_units, " + ", ".join(f"round(avg(flag_{c})*100, 6) AS flag_{c}_pct" for c in DEVC)
    + ", round(avg(any_flag)*100, 6) AS any_flag_pct FROM cl GROUP BY disease_class",
)
def crosslead_rates_by_class(spark, sf):
    return qc.flag_rates(_cl(spark, sf), ["disease_class"], [f"flag_{c}" for c in DEVC])


@query(
    "crosslead_tolerances",
    f"WITH {DEV_SQL}, l AS (SELECT unnest([" + ",".join(f"'{c}'" for c in DEVC) + "]) AS landmark, unnest(["
    + ",".join(f"dev_{c}" for c in DEVC)
    + """]) AS d FROM dev) SELECT landmark, round(quantile_cont(d,0.5),6) AS median_ms, round(quantile_cont(d,0.95),6) AS p95_ms,
     round(quantile_cont(d,0.98),6) AS p98_ms, round_even(quantile_cont(d,0.98),0) AS tolerance_ms FROM l GROUP BY landmark""",
)
def crosslead_tolerances(spark, sf):
    s = qc.deviation_summary(qc.channel_deviation(units(spark, sf), [2, 5]), DEVC)
    return s.select("landmark", *[F.round(c, 6).alias(c) for c in ("median_ms", "p95_ms", "p98_ms")], "tolerance_ms")


@query(
    "crosslead_worst_channels",
    f"""WITH {DEV_SQL}, l AS (SELECT lead, unnest([""" + ",".join(f"'{c}'" for c in DEVC) + "]) AS landmark, unnest(["
    + ",".join(f"flag_{c}" for c in DEVC)
    + """]) AS f FROM cl), g AS (SELECT landmark, lead, round(avg(f)*100,6) AS rate_pct FROM l GROUP BY ALL)
    SELECT landmark, lead, rate_pct FROM (SELECT *, row_number() OVER (PARTITION BY landmark ORDER BY rate_pct DESC, lead) AS k
      FROM g) u WHERE k <= 4""",
)
def crosslead_worst_channels(spark, sf):
    c = _cl(spark, sf)
    tidy = c.select("lead", F.inline(F.array(*[F.struct(F.lit(x).alias("landmark"), F.col(f"flag_{x}").alias("f")) for x in DEVC])))
    rate = tidy.groupBy("landmark", "lead").agg(F.round(F.avg("f") * 100, 6).alias("rate_pct"))
    from pyspark.sql import Window as W

    # One row per (landmark, channel): the window holds as many rows as there are channels.
    k = F.row_number().over(W.partitionBy("landmark").orderBy(F.desc("rate_pct"), "lead"))
    return rate.withColumn("k", k).filter("k <= 4").drop("k")


# ---------------------------------------------------------------- order, range and presence rules


def _le(a, b):
    return f"coalesce({a} <= {b}, true)"


CHAIN_SQL = " AND ".join(_le(a, b) for a, b in zip(L.boundaries, L.boundaries[1:]))
INSIDE_SQL = " AND ".join(f"{_le(w.onset, p)} AND {_le(p, w.offset)}" for w in L.waves for p in w.peaks)


@query(
    "order_flags",
    f"""WITH {QC_SQL}, ooo AS (SELECT record_id, lead, beat_id, bool_or(coalesce(v < pv, false)) AS bad FROM steps GROUP BY ALL)
    SELECT disease_class, CASE WHEN {CHAIN_SQL} THEN 1 ELSE 0 END AS chain_ok, CASE WHEN {INSIDE_SQL} THEN 1 ELSE 0 END AS peaks_inside_ok,
      CASE WHEN bad THEN 0 ELSE 1 END AS order_ok, count(*) AS n
    FROM beats JOIN ooo USING (record_id, lead, beat_id) GROUP BY ALL""",
)
def order_flags(spark, sf):
    o = qc.order_flags(beats(spark, sf))
    return o.groupBy("disease_class", "chain_ok", "peaks_inside_ok", "order_ok").agg(F.count(F.lit(1)).alias("n"))


@query(
    "order_disorder",
    f"WITH {BEATS_SQL} " + " UNION ALL ".join(
        f"SELECT '{a} > {b}' AS pair, count(*) FILTER ({b} < {a}) AS n FROM beats" for a, b in zip(LM, LM[1:])
    ),
)
def order_disorder(spark, sf):
    return qc.order_disorder(beats(spark, sf), LM)


@query(
    "out_of_record",
    f"WITH {BEATS_SQL} SELECT record_id, lead, beat_id FROM beats WHERE least({','.join(LM)}) < 0 "
    f"OR greatest({','.join(LM)}) > n_samples - 1",
)
def out_of_record(spark, sf):
    return beats(spark, sf).filter(qc.out_of_record(LM)).select("record_id", "lead", "beat_id")


@query(
    "range_check_modes",
    f"""WITH {BEATS_SQL}, w AS (SELECT disease_class, (t_offset-qrs_onset)*2 AS qt FROM beats)
    SELECT disease_class, count(*) FILTER (qt IS NOT NULL AND qt NOT BETWEEN 250 AND 700) AS implausible_skip,
     count(*) FILTER (qt IS NULL OR qt NOT BETWEEN 250 AND 700) AS implausible_flag,
     count(*) FILTER (qt IS NULL) AS marked_absent FROM w GROUP BY disease_class""",
)
def range_check_modes(spark, sf):
    d = derive.derive_intervals(beats(spark, sf))
    qt = F.col("qt_ms")
    return d.groupBy("disease_class").agg(
        F.count_if(S.out_of_range(qt, 250.0, 700.0)).alias("implausible_skip"),
        F.count_if(S.out_of_range(qt, 250.0, 700.0, missing="flag")).alias("implausible_flag"),
        F.count_if(S.range_marker(qt, 250.0, 700.0) == "--").alias("marked_absent"),
    )


@query(
    "placeholder_to_absent",
    f"""WITH {BEATS_SQL}, u AS (SELECT *, CASE WHEN s_peak = qrs_offset THEN NULL ELSE s_peak END AS s2 FROM beats)
    SELECT lead, count(s2) AS n_kept, count(*) FILTER (s2 IS NULL) AS n_absent, CAST(sum(s2) AS BIGINT) AS s_sum FROM u GROUP BY lead""",
)
def placeholder_to_absent(spark, sf):
    n = derive.null_placeholder(beats(spark, sf), "s_peak", equals="qrs_offset", flag="s_present")
    return n.groupBy("lead").agg(
        F.sum(F.col("s_present").cast("bigint")).alias("n_kept"), F.count_if(F.col("s_present") == 0).alias("n_absent"),
        F.sum("s_peak").alias("s_sum"),
    )


@query(
    "presence_agreement",
    f"""WITH {BEATS_SQL} SELECT count(*) FILTER (t_peak IS NOT NULL AND q_peak IS NULL) AS q_peak_blank_but_flagged,
     count(*) FILTER (t_peak IS NULL AND q_peak IS NOT NULL) AS q_peak_placed_but_unflagged,
     count(*) FILTER (p_peak IS NOT NULL AND r_peak IS NULL) AS r_peak_blank_but_flagged,
     count(*) FILTER (p_peak IS NULL AND r_peak IS NOT NULL) AS r_peak_placed_but_unflagged FROM beats""",
)
def presence_agreement(spark, sf):
    f = derive.presence_flags(require_columns(beats(spark, sf), LM))
    return derive.presence_agreement(f, {"t_present": "q_peak", "p_present": "r_peak"})


@query(
    "misordered_events_dropped",
    f"""WITH {BEATS_SQL}, n AS (SELECT *, lead(p_peak) OVER w AS nx, lead(beat_id) OVER w AS ne FROM beats
      WINDOW w AS (PARTITION BY record_id, lead ORDER BY beat_id))
    SELECT record_id, lead, beat_id FROM n WHERE p_peak < r_peak AND r_peak < t_peak AND (ne IS NULL OR t_peak < nx)""",
)
def misordered_events_dropped(spark, sf):
    kept = qc.drop_misordered(beats(spark, sf), ["p_peak", "r_peak", "t_peak"])
    return kept.select("record_id", "lead", "beat_id")


# One pass per step of the recursion, over the whole table; a pass that removes nothing adds no rows.
_SHORT = 3_600_000_000


def _rough(order: list[str]) -> str:
    d = [f"({b} - {a})" for a, b in zip(order, order[1:])]
    return f"abs({d[1]} - {d[0]}) + " + " + ".join(f"abs({q} - {p})" for p, q in zip(d[1:], d[2:]))


SHORT_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT 0 AS pass, record_id, pos, event_id FROM ev UNION ALL SELECT pass, record_id, pos, event_id FROM (
  SELECT *, bool_or(gone) OVER () AS any_gone FROM (SELECT *, me OR coalesce(lag(nx) OVER (PARTITION BY record_id ORDER BY pos, event_id), false) AS gone FROM (
   SELECT *, short AND earlier AS me, short AND NOT earlier AS nx FROM (
    SELECT *, coalesce(abs(x1 - pos) <= {_SHORT}, false) AS short,
      CASE WHEN i >= 3 AND i <= n - 3 THEN {_rough(["xm2", "xm1", "x1", "x2", "x3"])} > {_rough(["xm2", "xm1", "pos", "x2", "x3"])} ELSE i >= 3 END AS earlier FROM (
     SELECT pass + 1 AS pass, record_id, pos, event_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY record_id) AS n, lag(pos, 2) OVER w AS xm2, lag(pos) OVER w AS xm1, lead(pos) OVER w AS x1,
      lead(pos, 2) OVER w AS x2, lead(pos, 3) OVER w AS x3 FROM r WINDOW w AS (PARTITION BY record_id ORDER BY pos, event_id)) a) b) c) d) e WHERE any_gone AND NOT gone)
SELECT record_id, count(*) AS n_kept, CAST(sum(pos) AS BIGINT) AS pos_sum FROM r WHERE pass = (SELECT max(pass) FROM r) GROUP BY record_id"""


@query("short_intervals_dropped", SHORT_SQL)
def short_intervals_dropped(spark, sf):
    ev = events(spark, sf).select("record_id", "pos", "event_id")
    kept = qc.drop_short_intervals(ev, ["record_id"], "pos", limit=_SHORT, tie=["event_id"], grain=86_400_000_000)
    return kept.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("pos").alias("pos_sum"))


# ---------------------------------------------------------------- derived quantities


@query(
    "derived_intervals",
    f"WITH {BEATS_SQL} SELECT record_id, lead, beat_id, "
    + ", ".join(f"round(({a}-{b})*1000.0::DOUBLE/fs_hz, 3) AS {n}_ms" for n, (a, b) in derive.INTERVALS.items())
    + " FROM beats",
)
def derived_intervals(spark, sf):
    d = derive.derive_intervals(beats(spark, sf))
    return d.select("record_id", "lead", "beat_id", *[f"{n}_ms" for n in derive.INTERVALS])


@query(
    "positive_intervals",
    f"WITH {BEATS_SQL} SELECT lead, "
    + ", ".join(
        f"count(*) FILTER ({a}-{b} > 0) AS n_{n}, round(avg(CASE WHEN {a}-{b} > 0 THEN ({a}-{b})*2.0::DOUBLE END), 6) AS mean_{n}"
        for n, (a, b) in derive.INTERVALS.items()
    )
    + " FROM beats GROUP BY lead",
)
def positive_intervals(spark, sf):
    d = derive.derive_intervals(beats(spark, sf), positive_only=True)
    aggs = []
    for n in derive.INTERVALS:
        aggs += [F.count(f"{n}_ms").alias(f"n_{n}"), F.round(F.avg(f"{n}_ms"), 6).alias(f"mean_{n}")]
    return d.groupBy("lead").agg(*aggs)


RR_W = "WINDOW w AS (PARTITION BY record_id, lead ORDER BY beat_id)"


@query(
    "rr_intervals",
    f"WITH {BEATS_SQL} SELECT record_id, lead, beat_id, r_peak - lag(r_peak) OVER w AS rr FROM beats {RR_W}",
)
def rr_intervals(spark, sf):
    return derive.intervals_between(beats(spark, sf)).select("record_id", "lead", "beat_id", "rr")


@query(
    "rr_intervals_repeat_tail",
    f"""WITH {BEATS_SQL}, p AS (SELECT * FROM beats WHERE r_peak IS NOT NULL)
    SELECT record_id, lead, beat_id, coalesce(lead(r_peak) OVER w - r_peak, r_peak - lag(r_peak) OVER w) AS rr FROM p {RR_W}""",
)
def rr_intervals_repeat_tail(spark, sf):
    r = derive.intervals_between(beats(spark, sf), tail="repeat", skip_absent=True)
    return r.select("record_id", "lead", "beat_id", "rr")


@query(
    "qtc_values",
    f"""WITH {BEATS_SQL}, p AS (SELECT record_id, lead, beat_id, (t_offset-qrs_onset)*2.0::DOUBLE AS qt,
       (r_peak - lag(r_peak) OVER w)*2.0::DOUBLE AS rr FROM beats {RR_W})
    SELECT record_id, lead, beat_id, round(qt + 0.154::DOUBLE*(1000.0::DOUBLE-rr), 3) AS qtc_framingham_ms FROM p""",
)
def qtc_values(spark, sf):
    r = derive.intervals_between(derive.derive_intervals(beats(spark, sf)))
    r = derive.with_qtc(r.withColumn("rr_ms", S.samples_to_ms("rr", F.col("fs_hz"))))
    return r.select("record_id", "lead", "beat_id", "qtc_framingham_ms")


@query(
    "qtc_fridericia_by_class",
    f"""WITH {BEATS_SQL}, p AS (SELECT disease_class, (t_offset-qrs_onset)*2.0::DOUBLE AS qt,
       (r_peak - lag(r_peak) OVER w)*2.0::DOUBLE AS rr FROM beats {RR_W})
    SELECT disease_class, count(CASE WHEN rr > 0 THEN qt END) AS n,
      round(avg(CASE WHEN rr > 0 THEN round(qt / cbrt(rr/1000.0::DOUBLE), 3) END), 4) AS mean_qtc FROM p GROUP BY 1""",
)
def qtc_fridericia_by_class(spark, sf):
    r = derive.intervals_between(derive.derive_intervals(beats(spark, sf)))
    r = derive.with_qtc(r.withColumn("rr_ms", S.samples_to_ms("rr", F.col("fs_hz"))))
    return r.groupBy("disease_class").agg(
        F.count("qtc_fridericia_ms").alias("n"), F.round(F.avg("qtc_fridericia_ms"), 4).alias("mean_qtc")
    )


@query(
    "event_windows",
    f"""WITH {BEATS_SQL} SELECT record_id, lead, beat_id,
     CASE WHEN lag(beat_id) OVER w IS NULL THEN 0 WHEN r_peak + lag(r_peak) OVER w IS NULL THEN NULL
       ELSE greatest(0, CAST(floor((r_peak + lag(r_peak) OVER w)/2) AS BIGINT)) END AS window_start,
     CASE WHEN lead(beat_id) OVER w IS NULL THEN n_samples - 1
       ELSE CAST(floor((r_peak + lead(r_peak) OVER w)/2) AS BIGINT) END AS window_end
    FROM beats {RR_W}""",
)
def event_windows(spark, sf):
    w = derive.event_windows(beats(spark, sf))
    return w.select("record_id", "lead", "beat_id", "window_start", "window_end")


REP_MED_SQL = """, med AS (SELECT record_id, median(beat_id) AS m FROM beats GROUP BY record_id),
 near AS (SELECT record_id, beat_id FROM (SELECT record_id, beat_id,
   row_number() OVER (PARTITION BY record_id ORDER BY abs(beat_id - m), beat_id) AS k
   FROM (SELECT DISTINCT record_id, beat_id FROM beats) b JOIN med USING (record_id)) u WHERE k = 1)"""


@query(
    "representative_event",
    f"""WITH {BEATS_SQL}{REP_MED_SQL} SELECT record_id, min(beat_id) AS beat_id, count(*) AS n_leads,
      CAST(sum(qrs_onset) AS BIGINT) AS onset_sum FROM beats JOIN near USING (record_id, beat_id) GROUP BY record_id""",
)
def representative_event(spark, sf):
    b = beats(spark, sf).select("record_id", "beat_id", "lead", "qrs_onset")
    per_beat = b.groupBy("record_id", "beat_id").agg(
        F.count(F.lit(1)).alias("n_leads"), F.sum("qrs_onset").alias("onset_sum")
    )
    return derive.representative(per_beat, ["record_id"], "beat_id", median_over=b)


@query(
    "interior_representative",
    f"""WITH {BEATS_SQL}, r AS (SELECT record_id, lead, beat_id, row_number() OVER w - 1 AS i,
       count(*) OVER (PARTITION BY record_id, lead) AS n FROM beats {RR_W})
    SELECT record_id, lead, beat_id FROM r WHERE i = CASE WHEN n < 3 THEN 0
      ELSE greatest(1, least(n-2, CAST(round_even(n/2, 0) AS BIGINT) - 1)) END""",
)
def interior_representative(spark, sf):
    r = derive.representative(beats(spark, sf), ["record_id", "lead"], "beat_id", how="interior_place")
    return r.select("record_id", "lead", "beat_id")


@query(
    "interior_representative_by_id",
    f"""WITH {BEATS_SQL}, r AS (SELECT record_id, lead, beat_id, qrs_onset, row_number() OVER w AS i,
       count(*) OVER (PARTITION BY record_id, lead) AS n FROM beats {RR_W})
    SELECT record_id, lead, i, qrs_onset FROM r WHERE i = CASE WHEN n < 3 THEN 1
      ELSE greatest(2, least(n-1, CAST(round_even(n/2, 0) AS BIGINT))) END""",
)
def interior_representative_by_id(spark, sf):
    from ..operators.ordered import with_neighbours

    numbered = with_neighbours(beats(spark, sf), ["record_id", "lead"], "beat_id", ordinal="i")
    r = derive.representative(numbered, ["record_id", "lead"], "i", how="interior_id")
    return r.select("record_id", "lead", "i", "qrs_onset")


@query(
    "first_event_per_unit",
    f"WITH {UNITS_SQL} SELECT record_id, lead, beat_id, qrs_onset FROM units",
)
def first_event_per_unit(spark, sf):
    return keep_first(
        beats(spark, sf).select("record_id", "lead", "beat_id", "qrs_onset"), ["record_id", "lead"], ["beat_id"]
    )


@query(
    "halved_rate_positions",
    f"WITH {BEATS_SQL} SELECT lead, CAST(sum(CAST(floor((qrs_onset+1)/2) AS BIGINT)) AS BIGINT) AS onset_sum, "
    "CAST(sum(CAST(floor((t_offset+1)/2) AS BIGINT)) AS BIGINT) AS toff_sum, "
    "CAST(sum(CAST(round_even((p_onset+p_offset)/2.0::DOUBLE, 0) AS BIGINT)) AS BIGINT) AS even_sum, "
    "CAST(sum(CAST(round((p_onset+p_offset)/2.0::DOUBLE) AS BIGINT)) AS BIGINT) AS away_sum FROM beats GROUP BY lead",
)
def halved_rate_positions(spark, sf):
    mid = (F.col("p_onset") + F.col("p_offset")) / F.lit(2.0)
    return beats(spark, sf).groupBy("lead").agg(
        F.sum(S.halve_rate(F.col("qrs_onset"))).alias("onset_sum"),
        F.sum(S.halve_rate(F.col("t_offset"))).alias("toff_sum"),
        F.sum(S.half_even(mid).cast("bigint")).alias("even_sum"),
        F.sum(S.half_away(mid).cast("bigint")).alias("away_sum"),
    )


@query(
    "events_short_gap_flags",
    f"""WITH {EVENTS_SQL}, g AS (SELECT channel, pos - lag(pos) OVER (PARTITION BY record_id, channel ORDER BY pos, event_id) AS gap FROM ev)
    SELECT channel, count(*) AS n, count(*) FILTER (gap <= 3600000000) AS n_short FROM g GROUP BY channel""",
)
def events_short_gap_flags(spark, sf):
    from ..operators.ordered import with_neighbours

    w = with_neighbours(
        events(spark, sf), ["record_id", "channel"], "pos", ties=["event_id"], lag={"prev": "pos"}, grain=86_400_000_000
    )
    return w.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") - F.col("prev") <= 3_600_000_000).alias("n_short")
    )
