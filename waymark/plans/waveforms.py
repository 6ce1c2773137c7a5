"""Queries on traces and label sequences (the embeddings table seen as short waveforms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import derive, segment as S, signal as G
from .fixtures import BEATS_SQL, LABELS_SQL, TRACE_SQL, beats, labelled, traces
from .registry import SQL, query
from .scoring import r6

CH = list(range(8))
CEN_SQL = TRACE_SQL + """, md AS (SELECT record_id, lead, median(v) AS m FROM trace GROUP BY ALL),
 mg0 AS (SELECT record_id, sample, sqrt(sum((v - m)*(v - m))) AS mag FROM trace JOIN md USING (record_id, lead) GROUP BY ALL)"""
MAG_SQL = CEN_SQL + """, mg AS (SELECT a.record_id, a.sample, avg(b.mag) AS mag FROM mg0 a, (SELECT unnest([-2,-1,0,1,2]) AS k) z, mg0 b
  WHERE b.record_id = a.record_id AND b.sample = greatest(0, least(63, a.sample + k)) GROUP BY ALL)"""


@query("spatial_magnitude", f"WITH {MAG_SQL} SELECT record_id, CAST(sample AS INTEGER) AS sample, round(mag, 6) AS mag FROM mg")
def spatial_magnitude(spark, sf):
    m = G.spatial_magnitude(traces(spark, sf), CH, smooth=5)
    return r6(m.select("record_id", F.posexplode("magnitude").alias("sample", "mag")), "mag")


@query(
    "anchors",
    f"""WITH {CEN_SQL}, d AS (SELECT record_id, sample - 1 AS sample, abs(mag - lag(mag) OVER (PARTITION BY record_id ORDER BY sample)) AS st FROM mg0),
     q AS (SELECT record_id, arg_max(sample, struct_pack(a := st, b := -sample)) AS qrs_anchor FROM d WHERE st IS NOT NULL GROUP BY 1)
    SELECT record_id, arg_max(sample, struct_pack(a := mag, b := -sample)) AS r_anchor, max(qrs_anchor) AS qrs_anchor, arg_max(sample, struct_pack(a := mag, b := -sample)) - 21 AS win_start,
     least(63, arg_max(sample, struct_pack(a := mag, b := -sample)) + 22) AS win_end FROM mg0 JOIN q USING (record_id) GROUP BY record_id""",
)
def anchors(spark, sf):
    a = G.anchor_window(G.anchors(G.spatial_magnitude(traces(spark, sf), CH)), 21, 22)
    return a.select("record_id", *[F.col(c).cast("bigint").alias(c) for c in ("r_anchor", "qrs_anchor", "win_start", "win_end")])


@query(
    "spatial_velocity",
    f"""WITH {TRACE_SQL}, g AS (SELECT record_id, lead, sample, CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w
       ELSE (lead(v) OVER w - lag(v) OVER w)/2 END AS d FROM trace WINDOW w AS (PARTITION BY record_id, lead ORDER BY sample)),
     s AS (SELECT record_id, sample, sqrt(sum(d*d)) AS vel FROM g GROUP BY ALL)
    SELECT record_id, round(max(vel), 6) AS top, round(list_extract(list(vel ORDER BY vel), CAST(round(0.1*count(*)) AS BIGINT)), 6) AS floor FROM s GROUP BY record_id""",
)
def spatial_velocity(spark, sf):
    v = G.spatial_velocity(traces(spark, sf), CH)
    return r6(v.select("record_id", F.array_max("velocity").alias("top"), "floor"), "top", "floor")


NORM = {
    "robust": "(v - median(v) OVER w) / greatest((quantile_cont(v, 0.75) OVER w - quantile_cont(v, 0.25) OVER w)/1.349::DOUBLE, 1e-6)",
    "zscore": "(v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-6)",
}
for _mode, _expr in NORM.items():

    def _norm(spark, sf, mode=_mode):
        n = G.normalise(traces(spark, sf), mode)
        return r6(n.select("record_id", "lead", F.posexplode("normalised").alias("sample", "z")), "z")

    query(
        f"{_mode}_normalise",
        f"WITH {TRACE_SQL} SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, round(greatest(-20, least(20, {_expr})), 6) AS z FROM trace WINDOW w AS (PARTITION BY record_id, lead)",
    )(_norm)


@query(
    "percentile_normalise_window",
    f"""WITH {TRACE_SQL}, r AS (SELECT * FROM trace WHERE sample BETWEEN 10 AND 50), c AS (SELECT record_id, lead, median(v) AS c FROM r GROUP BY ALL),
     s AS (SELECT record_id, lead, max(c) AS c, quantile_cont(abs(v - c), 0.75) AS s FROM r JOIN c USING (record_id, lead) GROUP BY ALL)
    SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, round(greatest(-20, least(20, (v - c)/greatest(s, 1e-6))), 6) AS z FROM trace JOIN s USING (record_id, lead)""",
)
def percentile_normalise_window(spark, sf):
    t = traces(spark, sf).withColumns({"lo": F.lit(10), "hi": F.lit(50)})
    n = G.normalise(t, "abs_percentile", lo="lo", hi="hi", percentile=75.0)
    return r6(n.select("record_id", "lead", F.posexplode("normalised").alias("sample", "z")), "z")


MARK_SQL = TRACE_SQL + ", mk AS (SELECT DISTINCT record_id, lead, 20 + (record_id + lead) % 30 AS pk, CASE WHEN lead = 3 THEN NULL ELSE 8 + (record_id*lead) % 20 END AS onset FROM trace)"


def _marks(t):
    return t.select(
        "record_id", "lead", (F.lit(20) + (F.col("record_id") + F.col("lead")) % 30).alias("pk"),
        F.when(F.col("lead") != 3, F.lit(8) + (F.col("record_id") * F.col("lead")) % 20).alias("onset"),
    )


@query(
    "amplitude_at",
    f"""WITH {MARK_SQL}, b AS (SELECT record_id, lead, median(v) AS base FROM mk JOIN trace USING (record_id, lead) WHERE sample BETWEEN onset - 11 AND onset GROUP BY ALL)
    SELECT mk.record_id, mk.lead, round(v - base, 6) AS amplitude FROM mk LEFT JOIN b ON mk.record_id = b.record_id AND mk.lead = b.lead JOIN trace t ON t.record_id = mk.record_id AND t.lead = mk.lead AND t.sample = pk""",
)
def amplitude_at(spark, sf):
    t = traces(spark, sf)
    return r6(G.amplitude_at(_marks(t), t, "pk", "onset").select("record_id", "lead", "amplitude"), "amplitude")


@query(
    "plain_amplitude",
    f"WITH {MARK_SQL} SELECT mk.record_id, mk.lead, round(v, 6) AS amplitude FROM mk JOIN trace t ON t.record_id = mk.record_id AND t.lead = mk.lead AND t.sample = least(63, pk*2)",
)
def plain_amplitude(spark, sf):
    t = traces(spark, sf)
    m = _marks(t).withColumn("pk", F.col("pk") * 2)
    return r6(G.plain_amplitude(m, t, "pk").select("record_id", "lead", "amplitude"), "amplitude")


@query(
    "reseat_peak",
    f"""WITH {MARK_SQL}, base AS (SELECT record_id, lead, median(v) AS b FROM trace WHERE sample >= 53 GROUP BY ALL),
     c AS (SELECT mk.record_id, mk.lead, arg_max(sample, struct_pack(a := abs(v - b), s := -sample)) AS best FROM mk JOIN base USING (record_id, lead) JOIN trace USING (record_id, lead)
       WHERE sample BETWEEN onset AND onset + 15 GROUP BY ALL)
    SELECT mk.record_id, mk.lead, CASE WHEN pk < onset OR pk > onset + 15 THEN best ELSE pk END AS pk FROM mk LEFT JOIN c USING (record_id, lead)""",
)
def reseat_peak(spark, sf):
    t = traces(spark, sf)
    m = _marks(t).withColumn("off", F.col("onset") + 15)
    return G.reseat_peak(m, t, "pk", "onset", "off").select("record_id", "lead", F.col("pk").cast("bigint").alias("pk"))


HINT_SQL = MAG_SQL + ", h AS (SELECT DISTINCT record_id, 18 + record_id % 5 AS q0, 26 + record_id % 5 AS q1, 40 + record_id % 4 AS t0, 52 + record_id % 4 AS t1 FROM mg)"


@query(
    "boundaries_5pct",
    f"""WITH {HINT_SQL}, j AS (SELECT h.*, sample, mag FROM h JOIN mg USING (record_id)),
     b AS (SELECT record_id, median(mag) FILTER (sample < q0 - 5) AS base, arg_max(sample, struct_pack(a := mag, s := -sample)) FILTER (sample >= greatest(0, q0-25) AND sample < least(64, q1+25)) AS qp,
       arg_max(sample, struct_pack(a := mag, s := -sample)) FILTER (sample >= greatest(0, t0-30) AND sample < least(64, t1+30)) AS tp FROM j GROUP BY record_id),
     l AS (SELECT b.*, base + 0.05::DOUBLE*((SELECT mag FROM mg WHERE mg.record_id = b.record_id AND sample = qp) - base) AS ql, base + 0.05::DOUBLE*((SELECT mag FROM mg WHERE mg.record_id = b.record_id AND sample = tp) - base) AS tl,
       CASE WHEN tp > qp + 1 THEN (SELECT arg_min(sample, struct_pack(a := mag, s := sample)) FROM mg WHERE mg.record_id = b.record_id AND sample >= qp AND sample < greatest(qp+2, tp)) ELSE 63 END AS tr FROM b)
    SELECT record_id, coalesce(max(sample) FILTER (sample <= qp AND mag <= ql), 0) AS rule_qrs_onset, least(tr, greatest(qp, least(63, tr, coalesce(min(sample) FILTER (sample >= qp AND mag <= ql), 63)))) AS rule_qrs_offset,
      greatest(coalesce(max(sample) FILTER (sample <= tp AND mag <= tl), 0), tr) AS rule_t_onset, greatest(tp, least(63, coalesce(min(sample) FILTER (sample >= tp AND mag <= tl), 63))) AS rule_t_offset
    FROM l JOIN mg USING (record_id) GROUP BY record_id, qp, tp, ql, tl, tr""",
)
def boundaries_5pct(spark, sf):
    m = G.spatial_magnitude(traces(spark, sf), CH, smooth=5)
    r = F.col("record_id")
    m = m.withColumns({"q0": 18 + r % 5, "q1": 26 + r % 5, "t0": 40 + r % 4, "t1": 52 + r % 4})
    out = G.boundaries_5pct(m, ("q0", "q1"), ("t0", "t1"))
    return out.select("record_id", *[F.col(f"rule_{c}").cast("bigint").alias(f"rule_{c}") for c in ("qrs_onset", "qrs_offset", "t_onset", "t_offset")])


SM_SQL = TRACE_SQL + """, sm AS (SELECT a.record_id, a.lead, a.sample, avg(b.v) AS v FROM trace a, (SELECT unnest([-2,-1,0,1,2]) AS k) z, trace b
  WHERE b.record_id = a.record_id AND b.lead = a.lead AND b.sample = greatest(0, least(63, a.sample + k)) GROUP BY ALL),
 gr AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w)/2 END AS d FROM sm
   WINDOW w AS (PARTITION BY record_id, lead ORDER BY sample)), base AS (SELECT record_id, lead, median(v) AS b FROM trace WHERE sample >= 53 GROUP BY ALL)"""


@query("smoothed_gradient", f"WITH {SM_SQL} SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, round(d, 6) AS d FROM gr")
def smoothed_gradient(spark, sf):
    t = traces(spark, sf).select("record_id", "lead", A.gradient(A.box_mean(F.col("trace"), 5)).alias("g"))
    return r6(t.select("record_id", "lead", F.posexplode("g").alias("sample", "d")), "d")


@query(
    "truncated_box_mean",
    f"WITH {TRACE_SQL} SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, round(avg(v) OVER (PARTITION BY record_id, lead ORDER BY sample ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS m FROM trace",
)
def truncated_box_mean(spark, sf):
    t = traces(spark, sf).select("record_id", "lead", A.box_mean(F.col("trace"), 7, edge="trim").alias("m"))
    return r6(t.select("record_id", "lead", F.posexplode("m").alias("sample", "m")), "m")


@query(
    "tangent_offset",
    f"""WITH {SM_SQL}, c AS (SELECT record_id, lead, arg_max(sample, struct_pack(a := round(abs(d), 12), s := -sample)) AS i0 FROM gr WHERE sample >= 30 GROUP BY ALL),
     x AS (SELECT c.record_id, c.lead, i0, i0 + (b - g.v)/nullif(g.d, 0) AS cross_at FROM c JOIN gr g ON g.record_id = c.record_id AND g.lead = c.lead AND g.sample = i0 JOIN base ON base.record_id = c.record_id AND base.lead = c.lead)
    SELECT record_id, lead, i0 AS tangent_contact, CASE WHEN cross_at >= i0 THEN round(least(63, cross_at), 6) END AS tangent_offset FROM x""",
)
def tangent_offset(spark, sf):
    t = G.tangent_offset(traces(spark, sf).withColumn("pk", F.lit(29)), "pk")
    return r6(t.select("record_id", "lead", F.col("tangent_contact").cast("bigint").alias("tangent_contact"), "tangent_offset"), "tangent_offset")


@query(
    "last_wave_bounds",
    f"""WITH {TRACE_SQL}, base AS (SELECT record_id, lead, median(v) AS b FROM trace WHERE sample >= 53 GROUP BY ALL), d AS (SELECT record_id, lead, sample, abs(v - b) AS d FROM trace JOIN base USING (record_id, lead)),
     p AS (SELECT record_id, lead, arg_max(sample, struct_pack(a := d, s := -sample)) AS pk, max(d)*0.25::DOUBLE AS thr FROM d WHERE sample >= 30 GROUP BY ALL)
    SELECT record_id, lead, pk AS wave_peak, least(pk, greatest(20, coalesce(min(sample) FILTER (sample >= 20 AND sample < pk AND d > thr), pk) - 1) + 1) AS wave_onset,
     least(63, coalesce(max(sample) FILTER (sample > pk AND d > thr), pk) + 1) AS wave_offset FROM p JOIN d USING (record_id, lead) GROUP BY record_id, lead, pk""",
)
def last_wave_bounds(spark, sf):
    w = G.last_wave_bounds(traces(spark, sf).withColumn("off", F.lit(20)), "off", frac=0.25, shift=1)
    return w.select("record_id", "lead", *[F.col(c).cast("bigint").alias(c) for c in ("wave_peak", "wave_onset", "wave_offset")])


@query(
    "active_window",
    f"""WITH {CEN_SQL}, f AS (SELECT record_id, list_extract(list(mag ORDER BY mag), CAST(round(0.1*count(*)) AS BIGINT)) AS fl, max(mag) AS pk FROM mg0 GROUP BY 1),
     e AS (SELECT record_id, min(sample)*2.0::DOUBLE AS a, max(sample)*2.0::DOUBLE AS b FROM mg0 JOIN f USING (record_id) WHERE mag > fl + 0.02::DOUBLE*(pk - fl) GROUP BY 1)
    SELECT record_id, round(greatest(0, a - greatest(0.1::DOUBLE*(b-a), 40)), 6) AS active_from_ms, round(least(126, b + greatest(0.1::DOUBLE*(b-a), 40)), 6) AS active_to_ms FROM e""",
)
def active_window(spark, sf):
    w = G.active_window(G.spatial_magnitude(traces(spark, sf), CH))
    return r6(w.select("record_id", "active_from_ms", "active_to_ms"), "active_from_ms", "active_to_ms")


@query(
    "channel_identity",
    f"""WITH {TRACE_SQL} SELECT record_id, round(max(abs(r - (p - m))), 6) AS max_gap FROM (SELECT record_id, sample, max(v) FILTER (lead = 2) AS r, max(v) FILTER (lead = 1) AS p, max(v) FILTER (lead = 0) AS m
      FROM trace GROUP BY ALL) z GROUP BY record_id""",
)
def channel_identity(spark, sf):
    return r6(G.channel_identity(traces(spark, sf), 2, 1, 0), "max_gap")


@query(
    "limb_leads",
    f"""WITH {TRACE_SQL}, w AS (SELECT record_id, sample, max(v) FILTER (lead = 0) AS ra, max(v) FILTER (lead = 1) AS la, max(v) FILTER (lead = 2) AS ll, max(v) FILTER (lead = 3) AS v1 FROM trace GROUP BY ALL)
    SELECT record_id, CAST(sample AS INTEGER) AS sample, round(la-ra, 6) AS "I", round(ll-ra, 6) AS "II", round(ll-la, 6) AS "III", round(1.5::DOUBLE*(ra-(ra+la+ll)/3), 6) AS "aVR", round(1.5::DOUBLE*(la-(ra+la+ll)/3), 6) AS "aVL",
     round(1.5::DOUBLE*(ll-(ra+la+ll)/3), 6) AS "aVF", round(v1-(ra+la+ll)/3, 6) AS "V1" FROM w""",
)
def limb_leads(spark, sf):
    pick = lambda k: F.max(F.when(F.col("lead") == k, F.col("trace")))
    leads = ("ra", "la", "ll", "v1")
    t = traces(spark, sf).groupBy("record_id").agg(*[pick(k).alias(n) for k, n in enumerate(leads)], F.max(F.size("trace")).alias("n"))
    # Zipped arrays are NULL as soon as one of them is; a record that lacks a lead keeps its samples.
    parts = [F.coalesce(n, F.array().cast("array<double>")).alias(n) for n in leads]
    t = t.select("record_id", *parts, F.array_repeat(F.lit(0), F.col("n")).alias("n"))
    t = t.select("record_id", F.posexplode(F.arrays_zip(*leads, "n")).alias("sample", "z")).select("record_id", "sample", "z.*")
    names = ["I", "II", "III", "aVR", "aVL", "aVF", "V1"]
    return r6(derive.limb_leads(t, chest=["v1"]).select("record_id", "sample", *names), *names)


@query(
    "peak_scaled_channels",
    f"WITH {TRACE_SQL} SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, round(v / max(abs(v)) OVER (PARTITION BY record_id), 6) AS scaled FROM trace",
)
def peak_scaled_channels(spark, sf):
    t = traces(spark, sf).select("record_id", "lead", F.posexplode("trace").alias("sample", "v"))
    return r6(G.normalise_by_peak(t, ["record_id"], "v").select("record_id", "lead", "sample", "scaled"), "scaled")


@query(
    "cycle_slices",
    f"""WITH {TRACE_SQL}, c AS (SELECT record_id, lead, CAST(floor(sample/24) AS BIGINT) AS cycle, sample % 24 AS o, v FROM trace), n AS (SELECT record_id, lead, cycle, count(*) AS m FROM c GROUP BY ALL)
    SELECT record_id, lead, cycle, count(*) AS n, max(o) AS last_offset, round(sum(v), 6) AS total FROM c JOIN n USING (record_id, lead, cycle) WHERE m > 12 GROUP BY ALL""",
)
def cycle_slices(spark, sf):
    t = traces(spark, sf).select("record_id", "lead", F.posexplode("trace").alias("sample", "v"))
    s = derive.slice_cycles(t, ["record_id", "lead"], cycle=24)
    return s.groupBy("record_id", "lead", "cycle").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("offset").cast("bigint")).alias("last_offset"), F.round(F.sum("v"), 6).alias("total"))


LEVELS = 4001
_LV = "[" + ",".join(repr(i / (LEVELS - 1)) for i in range(LEVELS)) + "]"
_WINDOW = {"lo": "record_id % 5", "hi": "CASE WHEN record_id % 11 = 0 THEN 25 ELSE 62 - record_id % 3 END"}
WINDOW_SQL = f"""{TRACE_SQL}, b AS (SELECT *, {_WINDOW["lo"]} AS lo, {_WINDOW["hi"]} AS hi FROM trace),
 i AS (SELECT *, count(*) FILTER (sample >= lo AND sample < hi) OVER (PARTITION BY record_id, lead) AS m FROM b),
 k AS (SELECT record_id, lead, sample, v, row_number() OVER (PARTITION BY record_id, lead ORDER BY sample) - 1 AS place FROM i WHERE m < 30 OR (sample >= lo AND sample < hi)),
 nz AS (SELECT record_id, lead, place, greatest(-20, least(20, {NORM["robust"]})) AS v FROM k WINDOW w AS (PARTITION BY record_id, lead)),
 qz AS (SELECT lead, quantile_cont(v, {_LV}) AS q FROM nz WHERE record_id % 2 = 0 GROUP BY lead), qt AS (SELECT lead, quantile_cont(v, {_LV}) AS q FROM nz WHERE record_id % 2 = 1 GROUP BY lead),
 p0 AS (SELECT lead, unnest(range({LEVELS})) AS i, unnest(qz.q) AS e, unnest(qt.q) AS t FROM qz JOIN qt USING (lead)),
 p1 AS (SELECT *, max(e) OVER (PARTITION BY lead ORDER BY i) AS run FROM p0), p2 AS (SELECT *, CASE WHEN run <= lag(run) OVER (PARTITION BY lead ORDER BY i) THEN 1 ELSE 0 END AS tie FROM p1),
 pt AS (SELECT lead, i, run + 1e-6::DOUBLE * sum(tie) OVER (PARTITION BY lead ORDER BY i) AS e, t FROM p2)"""


def _windowed(spark, sf):
    return G.normalised_window(traces(spark, sf).withColumns({c: F.expr(e) for c, e in _WINDOW.items()}), "lo", "hi")


@query("quantile_match_table", f"WITH {WINDOW_SQL} SELECT lead, CAST(i AS INTEGER) AS level_no, round(e, 6) AS external, round(t, 6) AS training FROM pt")
def quantile_match_table(spark, sf):
    t = _windowed(spark, sf)
    q = G.quantile_match_table(t.filter("record_id % 2 = 0"), t.filter("record_id % 2 = 1"), LEVELS)
    return r6(q.select("lead", "level_no", "external", "training"), "external", "training")


@query(
    "quantile_matched_traces",
    f"""WITH {WINDOW_SQL},
     pn AS (SELECT *, lead(e) OVER (PARTITION BY pt.lead ORDER BY i) AS e2, lead(t) OVER (PARTITION BY pt.lead ORDER BY i) AS t2 FROM pt), lo AS (SELECT lead, t AS t0 FROM pt WHERE i = 0)
    SELECT tr.record_id, tr.lead, CAST(tr.place AS INTEGER) AS sample, round(CASE WHEN pn.e IS NULL THEN t0 WHEN pn.e2 IS NULL THEN pn.t ELSE pn.t + (pn.t2 - pn.t)*(tr.v - pn.e)/(pn.e2 - pn.e) END, 6) AS v
    FROM nz tr ASOF LEFT JOIN pn ON tr.lead = pn.lead AND tr.v >= pn.e JOIN lo ON lo.lead = tr.lead""",
)
def quantile_matched_traces(spark, sf):
    t = _windowed(spark, sf)
    q = G.quantile_match_table(t.filter("record_id % 2 = 0"), t.filter("record_id % 2 = 1"), LEVELS)
    m = G.apply_quantile_match(t, q)
    return r6(m.select("record_id", "lead", F.posexplode("matched").alias("sample", "v")), "v")


@query(
    "resample_half",
    f"WITH {TRACE_SQL}, h AS (SELECT unnest(range(65)) AS k, unnest({G.lowpass_taps(150.0, 1000.0, 64)}) AS h) SELECT a.record_id, a.lead, CAST(a.sample/2 AS INTEGER) AS sample, round(sum(b.v*h), 6) AS v "
    "FROM trace a, h JOIN trace b ON true WHERE a.sample % 2 = 0 AND b.record_id = a.record_id AND b.lead = a.lead AND b.sample = greatest(0, least(63, a.sample + k - 32)) GROUP BY ALL",
)
def resample_half(spark, sf):
    h = G.resample_half(traces(spark, sf), order=64)
    return r6(h.select("record_id", "lead", F.posexplode("halved").alias("sample", "v")), "v")


@query("template_average")
def template_average(spark, sf):
    # Events of a unit at regular places of its trace, shifted by the record.
    t = traces(spark, sf)
    ev = t.select("record_id", "lead", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("beat_id"))
    ev = ev.withColumn("at", F.col("beat_id") * 9 + (F.col("record_id") * F.col("beat_id")) % 3)
    return r6(G.template_average(ev, t, "at", 3, 4), "value")


# ---------------------------------------------------------------- label sequences

RUN_SQL = LABELS_SQL + """, g AS (SELECT *, sample - row_number() OVER (PARTITION BY record_id, lead, label ORDER BY sample) AS isle FROM labs),
 rn AS (SELECT record_id, lead, label AS v, min(sample) AS start, max(sample) AS "end", count(*) AS length FROM g GROUP BY record_id, lead, label, isle)"""
INTS = ("start", "end", "length")


@query("runs_of_labels", f"WITH {RUN_SQL} SELECT * FROM rn")
def runs_of_labels(spark, sf):
    r = S.explode_runs(labelled(spark, sf), ["record_id", "lead"])
    return r.select("record_id", "lead", "v", *[F.col(c).cast("bigint").alias(c) for c in INTS])


MODE_SQL = LABELS_SQL + """, w AS (SELECT a.record_id, a.lead, a.sample, b.label, count(*) AS n FROM labs a, (SELECT unnest(range(-2, 3)) AS k) z, labs b
  WHERE b.record_id = a.record_id AND b.lead = a.lead AND b.sample = greatest(0, least(63, a.sample + k)) GROUP BY ALL),
 mf AS (SELECT record_id, lead, sample, label FROM (SELECT *, row_number() OVER (PARTITION BY record_id, lead, sample ORDER BY n DESC, label) AS k FROM w) z WHERE k = 1)"""


@query("mode_filter", f"WITH {MODE_SQL} SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, label FROM mf")
def mode_filter(spark, sf):
    m = labelled(spark, sf).select("record_id", "lead", S.mode_filter(F.col("labels"), 5).alias("m"))
    return m.select("record_id", "lead", F.posexplode("m").alias("sample", "label"))


@query(
    "local_extrema",
    f"""WITH {TRACE_SQL}, r AS (SELECT record_id, lead, sample, round(v, 2) AS v FROM trace), g AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS f FROM r WINDOW w AS (PARTITION BY record_id, lead ORDER BY sample)),
     i AS (SELECT *, sum(f) OVER (PARTITION BY record_id, lead ORDER BY sample) AS k FROM g), p AS (SELECT record_id, lead, k, max(v) AS v, min(sample) AS a, max(sample) AS b FROM i GROUP BY ALL),
     n AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM p WINDOW w AS (PARTITION BY record_id, lead ORDER BY k))
    SELECT record_id, lead, CAST(floor((a+b)/2) AS INTEGER) AS at, 'max' AS kind FROM n WHERE v > pv AND v > nv UNION ALL SELECT record_id, lead, CAST(floor((a+b)/2) AS INTEGER), 'min' FROM n WHERE v < pv AND v < nv""",
)
def local_extrema(spark, sf):
    t = traces(spark, sf).withColumn("t", F.transform("trace", lambda v: F.round(v, 2)))
    arms = [t.select("record_id", "lead", F.explode(S.local_extrema(F.col("t"), k)).alias("at"), F.lit(k).alias("kind")) for k in ("max", "min")]
    return arms[0].unionByName(arms[1])


@query(
    "pick_region",
    f"""WITH {RUN_SQL}, c AS (SELECT *, bool_or(start <= 40 AND "end" >= 20) OVER (PARTITION BY record_id, lead) AS any_touch, start <= 40 AND "end" >= 20 AS touch FROM rn WHERE v = 2 AND length >= 2)
    SELECT record_id, lead, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY record_id, lead ORDER BY length DESC, start) AS k FROM c WHERE touch OR NOT any_touch) z WHERE k = 1""",
)
def pick_region(spark, sf):
    d = labelled(spark, sf).withColumn("r", S.runs(F.col("labels")))
    d = d.withColumn("p", S.pick_region(F.col("r"), 2, 2, window=(F.lit(20), F.lit(40)))).filter("p is not null")
    return d.select("record_id", "lead", F.col("p.start").cast("bigint").alias("start"), F.col("p.end").cast("bigint").alias("end"))


LFL_SQL = MODE_SQL + """, g AS (SELECT *, sample - row_number() OVER (PARTITION BY record_id, lead, label ORDER BY sample) AS isle FROM mf),
 rn AS (SELECT record_id, lead, label AS v, min(sample) AS a, max(sample) AS b, count(*) AS n FROM g GROUP BY record_id, lead, label, isle),
 best AS (SELECT record_id, lead, v, a, b FROM (SELECT *, row_number() OVER (PARTITION BY record_id, lead, v ORDER BY n DESC, a) AS k FROM rn WHERE n >= 2 AND v > 0) z WHERE k = 1),
 u AS (SELECT DISTINCT record_id, lead FROM labs), ww AS (SELECT u.*, p.a AS pa, p.b AS pb, q.a AS qa, q.b AS qb, t.a AS ta, t.b AS tb FROM u LEFT JOIN best p ON p.record_id = u.record_id AND p.lead = u.lead AND p.v = 1
   LEFT JOIN best q ON q.record_id = u.record_id AND q.lead = u.lead AND q.v = 2 LEFT JOIN best t ON t.record_id = u.record_id AND t.lead = u.lead AND t.v = 3),
 x AS (SELECT record_id, lead, CASE WHEN qa IS NULL OR pa < qa THEN pa END AS p_onset, CASE WHEN qa IS NULL OR pa < qa THEN pb END AS p_offset, qa AS qrs_onset, qb AS qrs_offset,
   CASE WHEN qa IS NULL OR tb > qb THEN ta END AS t_onset, CASE WHEN qa IS NULL OR tb > qb THEN tb END AS t_offset FROM ww)"""


@query(
    "landmarks_from_labels",
    f"""WITH {LFL_SQL}, d AS (SELECT x.record_id, x.lead, sample, v - first_value(v) OVER (PARTITION BY x.record_id, x.lead ORDER BY sample) AS dv FROM x JOIN trace t ON t.record_id = x.record_id AND t.lead = x.lead
       AND sample BETWEEN qrs_onset AND qrs_offset WHERE qrs_offset - qrs_onset >= 2),
     th AS (SELECT record_id, lead, greatest(0.02::DOUBLE, 0.05::DOUBLE*max(abs(dv))) AS thr, arg_max(sample, struct_pack(a := dv, s := -sample)) AS top, max(dv) AS topv, arg_min(sample, struct_pack(a := dv, s := sample)) AS nadir, min(dv) AS nv FROM d GROUP BY ALL),
     ex AS (SELECT record_id, lead, sample FROM (SELECT *, lag(dv) OVER w AS p, lead(dv) OVER w AS n FROM d WINDOW w AS (PARTITION BY record_id, lead ORDER BY sample)) z JOIN th USING (record_id, lead) WHERE dv > p AND dv > n AND dv > thr
       UNION ALL SELECT record_id, lead, top FROM th WHERE topv > thr),
     rr AS (SELECT record_id, lead, min(sample) AS r FROM ex GROUP BY ALL),
     qs AS (SELECT th.record_id, th.lead, r, thr, arg_min(sample, struct_pack(a := dv, s := sample)) FILTER (sample < r) AS q, min(dv) FILTER (sample < r) AS qv, arg_min(sample, struct_pack(a := dv, s := sample)) FILTER (sample > r) AS s, min(dv) FILTER (sample > r) AS sv,
        any_value(nadir) AS nadir, any_value(nv) AS nv FROM th LEFT JOIN rr ON rr.record_id = th.record_id AND rr.lead = th.lead JOIN d ON d.record_id = th.record_id AND d.lead = th.lead GROUP BY th.record_id, th.lead, r, thr),
     pk AS (SELECT x.record_id, x.lead, arg_max(sample, struct_pack(a := abs(t.v - (SELECT v FROM trace z WHERE z.record_id = x.record_id AND z.lead = x.lead AND z.sample = p_onset)), s := -sample)) FILTER (sample BETWEEN p_onset AND p_offset) AS p_peak,
        arg_max(sample, struct_pack(a := abs(t.v - (SELECT v FROM trace z WHERE z.record_id = x.record_id AND z.lead = x.lead AND z.sample = t_onset)), s := -sample)) FILTER (sample BETWEEN t_onset AND t_offset) AS t_peak FROM x JOIN trace t ON t.record_id = x.record_id AND t.lead = x.lead GROUP BY x.record_id, x.lead)
    SELECT x.*, p_peak, t_peak, r AS r_peak, CASE WHEN r IS NULL THEN CASE WHEN nv < -thr THEN nadir END WHEN qv < -thr THEN q END AS q_peak, CASE WHEN sv < -thr THEN s END AS s_peak
    FROM x LEFT JOIN qs ON qs.record_id = x.record_id AND qs.lead = x.lead LEFT JOIN pk ON pk.record_id = x.record_id AND pk.lead = x.lead""",
)
def landmarks_from_labels(spark, sf):
    d = S.landmarks_from_labels(labelled(spark, sf), min_samples=2, kernel=5)
    cols = ["p_onset", "p_offset", "qrs_onset", "qrs_offset", "t_onset", "t_offset", "p_peak", "t_peak", "r_peak", "q_peak", "s_peak"]
    return d.select("record_id", "lead", *[F.col(c).cast("bigint").alias(c) for c in cols])


_SPANS = ["p_onset", "p_offset", "qrs_onset", "qrs_offset", "t_onset", "t_offset"]


def _read_sql(lo: int, hi: int) -> str:
    """Labels readable from ``lo`` to ``hi``; regions that touch the window 20 to 40 come first."""
    masked = LABELS_SQL.replace("labs AS", "labs0 AS") + f", labs AS (SELECT * REPLACE (CASE WHEN sample BETWEEN {lo} AND {hi} THEN label ELSE 0 END AS label) FROM labs0)"
    return LFL_SQL.replace(LABELS_SQL, masked).replace("ORDER BY n DESC, a)", "ORDER BY (a <= 40 AND b >= 20) DESC, n DESC, a)") + " SELECT * FROM x"


for _pad, _lo, _hi in ((8, 14, 48), (-1, 6, 60)):

    def _read(spark, sf, pad=_pad):
        d = labelled(spark, sf).withColumns({"w0": F.lit(20), "w1": F.lit(40), "v0": F.lit(6), "v1": F.lit(60)})
        if pad > 0:
            d = d.withColumn("v0", F.lit(14))
        d = S.landmarks_from_labels(d, window=("w0", "w1"), min_samples=2, kernel=5, read_pad=pad, valid=("v0", "v1"))
        return d.select("record_id", "lead", *[F.col(c).cast("bigint").alias(c) for c in _SPANS])

    query("landmarks_read_padded" if _pad > 0 else "landmarks_read_all", "WITH " + _read_sql(_lo, _hi))(_read)


_HEAD, _TAIL = SQL["landmarks_from_labels"].split("\n    SELECT x.*", 1)


@query(
    "deflection_patterns",
    f"""{_HEAD}, lm AS (SELECT x.*{_TAIL}), en AS (SELECT record_id, lead, unnest([q_peak, r_peak, s_peak]) AS pos, unnest(['q', 'r', 's']) AS c, r_peak IS NULL AS nor FROM lm),
     am AS (SELECT en.*, abs(dv) AS h FROM en JOIN d ON d.record_id = en.record_id AND d.lead = en.lead AND d.sample = en.pos), tp AS (SELECT *, max(h) OVER (PARTITION BY record_id, lead) AS topmost FROM am),
     pt AS (SELECT record_id, lead, CASE WHEN bool_or(nor) THEN 'QS' ELSE string_agg(CASE WHEN h >= 0.5::DOUBLE*topmost THEN upper(c) ELSE c END, '' ORDER BY pos) END AS p FROM tp GROUP BY ALL)
    SELECT coalesce(p, '') AS qrs_pattern, count(*) AS n FROM lm LEFT JOIN pt USING (record_id, lead) GROUP BY 1""",
)
def deflection_patterns(spark, sf):
    d = S.landmarks_from_labels(labelled(spark, sf), min_samples=2, kernel=5)
    return d.groupBy("qrs_pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_targets",
    f"""WITH {BEATS_SQL}, c AS (SELECT record_id, lead, beat_id, qrs_onset - 100 AS cs, * EXCLUDE (record_id, lead, beat_id) FROM beats), s AS (SELECT c.*, i, cs + i AS pos FROM c, (SELECT unnest(range(256)) AS i) z),
     l AS (SELECT CASE WHEN pos BETWEEN least(t_onset, t_offset) AND greatest(t_onset, t_offset) THEN 3 WHEN pos BETWEEN least(qrs_onset, qrs_offset) AND greatest(qrs_onset, qrs_offset) THEN 2
       WHEN p_onset IS NOT NULL AND pos BETWEEN least(p_onset, p_offset) AND greatest(p_onset, p_offset) THEN 1 WHEN pos BETWEEN qrs_onset - 60 AND qrs_onset + 140 THEN 0 END AS label, lead FROM s)
    SELECT lead, coalesce(label, -1) AS label, count(*) AS n FROM l GROUP BY ALL""",
)
def label_targets(spark, sf):
    # A crop and its window start from qrs_onset, so beats with equal distances from it have equal targets: each kind is labelled once and counted.
    ends = [c for w in S.LANDMARKS_11.waves for c in (w.onset, w.offset)]
    near = [(F.col(c) - F.col("qrs_onset")).alias(c) for c in dict.fromkeys(["qrs_onset", *ends])]
    kinds = beats(spark, sf).select("lead", *near).groupBy("lead", *dict.fromkeys(["qrs_onset", *ends])).agg(F.count(F.lit(1)).alias("beats"))
    on = F.col("qrs_onset")
    t = kinds.select("lead", "beats", F.explode(S.build_target(on - 100, 256, (on - 60, on + 140))).alias("label"))
    return t.groupBy("lead", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.sum("beats").alias("n"))


@query(
    "resolved_windows",
    f"""WITH {BEATS_SQL}, w AS (SELECT *, qrs_onset - 150 AS a, qrs_onset + 150 AS b, greatest(0, least({','.join(S.LANDMARKS_11.order)}) - 20) AS la, least(n_samples - 1, greatest({','.join(S.LANDMARKS_11.order)}) + 20) AS lb FROM beats)
    SELECT record_id, lead, beat_id, CASE WHEN lb >= la AND b - a + 1 > 256 THEN la ELSE a END AS lo, CASE WHEN lb >= la AND b - a + 1 > 256 THEN lb ELSE b END AS hi FROM w""",
)
def resolved_windows(spark, sf):
    on = F.col("qrs_onset")
    b = beats(spark, sf)
    w = S.resolve_window(on - 150, on + 150, F.col("n_samples"), "auto", 20, 256)
    return b.select("record_id", "lead", "beat_id", w.alias("w")).select("record_id", "lead", "beat_id", "w.lo", "w.hi")


@query(
    "rebased_landmarks",
    f"""WITH {BEATS_SQL}, c AS (SELECT *, greatest(0, least(CAST(floor((qrs_onset - 60 + qrs_onset + 140 + 1 - 256)/2) AS BIGINT), n_samples - 256)) AS cs FROM beats)
    SELECT record_id, lead, beat_id, """ + ", ".join(f"CASE WHEN {c} - cs BETWEEN 0 AND 255 THEN {c} - cs END AS {c}" for c in S.LANDMARKS_11.order) + " FROM c",
)
def rebased_landmarks(spark, sf):
    on = F.col("qrs_onset")
    b = beats(spark, sf).withColumn("cs", S.place_crop(on - 60, on + 140, F.col("n_samples"), 256))
    return S.rebase(b, "cs", 256).select("record_id", "lead", "beat_id", *S.LANDMARKS_11.order)


POST = "[v, -v, 0.05::DOUBLE, v*v]"


@query(
    "posterior_argmax",
    f"""WITH {TRACE_SQL} SELECT record_id, lead, CAST(sample AS INTEGER) AS sample, CASE WHEN v >= 0.05 AND v >= v*v THEN 0 WHEN 0.05 >= v*v THEN 2 ELSE 3 END AS label FROM trace""",
)
def posterior_argmax(spark, sf):
    x = F.col("trace")
    p = F.array(x, F.transform(x, lambda v: -v), F.transform(x, lambda v: F.lit(0.05)), F.transform(x, lambda v: v * v))
    t = traces(spark, sf).select("record_id", "lead", S.argmax_labels(p, suppressed=[1]).alias("m"))
    return t.select("record_id", "lead", F.posexplode("m").alias("sample", "label"))


# The channels of a record stand for the models of an ensemble, each read at two shifts; three classes are made of each trace.
_SCORES_SQL = f"""{TRACE_SQL}, sc AS (SELECT record_id, lead, shift, sample, (sample + 64 - shift) % 64 AS home, unnest([0, 1, 2]) AS cls, unnest([3 * v, 1 - v, v * v]) AS s FROM trace, (SELECT unnest([0, 5]) AS shift)),
 pr AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY record_id, lead, shift, sample) AS p FROM sc)"""


def _scored(spark, sf):
    x = F.col("trace")
    scores = F.array(F.transform(x, lambda v: v * 3), F.transform(x, lambda v: F.lit(1.0) - v), F.transform(x, lambda v: v * v))
    return traces(spark, sf).select("record_id", "lead", F.explode(F.array(F.lit(0), F.lit(5))).alias("shift"), scores.alias("posterior"), F.get("trace", F.lit(0)).alias("p_logit"))


def _by_sample(e):
    return e.select("record_id", "n_outputs", F.posexplode("posterior").alias("cls", "_row")).select("record_id", "n_outputs", "cls", F.posexplode("_row").alias("sample", "value"))


@query(
    "posterior_ensemble",
    f"WITH {_SCORES_SQL} SELECT record_id, CAST(cls AS INTEGER) AS cls, CAST(home AS INTEGER) AS sample, CAST(count(*) AS INTEGER) AS n_outputs, round(avg(p), 6) AS value FROM pr GROUP BY record_id, cls, home",
)
def posterior_ensemble(spark, sf):
    return r6(_by_sample(S.ensemble_posteriors(_scored(spark, sf), ["record_id"], "lead", CH, shift="shift", logits=True)), "value")


@query(
    "posterior_ensemble_log",
    f"""WITH {_SCORES_SQL} SELECT record_id, CAST(cls AS INTEGER) AS cls, CAST(home AS INTEGER) AS sample, CAST(count(*) AS INTEGER) AS n_outputs, round(ln(greatest(avg(s), 1e-9::DOUBLE)), 6) AS value
    FROM sc WHERE lead < 5 GROUP BY record_id, cls, home""",
)
def posterior_ensemble_log(spark, sf):
    return r6(_by_sample(S.ensemble_posteriors(_scored(spark, sf), ["record_id"], "lead", CH[:5], shift="shift", log=True)), "value")


@query(
    "presence_ensemble",
    f"WITH {TRACE_SQL} SELECT record_id, CAST(2 * count(*) AS INTEGER) AS n_outputs, round(avg(1 / (1 + exp(-v))), 6) AS p_logit FROM trace WHERE sample = 0 GROUP BY record_id",
)
def presence_ensemble(spark, sf):
    return r6(S.ensemble_posteriors(_scored(spark, sf), ["record_id"], "lead", CH, shift="shift", logits=True, presence="p_logit").drop("posterior"), "p_logit")


@query(
    "renaming_consistency",
    f"WITH {BEATS_SQL}, r AS (SELECT q_peak AS o, CASE WHEN s_peak % 5 = 0 THEN NULL WHEN s_peak % 5 = 1 THEN s_peak ELSE q_peak END AS n FROM beats) SELECT count(*) FILTER (o <> n) AS new_q_renamed, "
    "count(*) FILTER (o IS NOT NULL AND n IS NULL) AS new_q_withdrawn, count(*) FILTER (o IS NULL AND n IS NOT NULL) AS new_q_added FROM r",
)
def renaming_consistency(spark, sf):
    s = F.col("s_peak") % 5
    b = beats(spark, sf).withColumn("new_q", F.when(s == 1, F.col("s_peak")).when(s > 1, F.col("q_peak")))
    return S.renaming_consistency(b, {"new_q": "q_peak"})


@query(
    "order_violations",
    f"""WITH {BEATS_SQL}, q AS (SELECT record_id, lead, beat_id, unnest([{','.join(map(str, range(11)))}]) AS pos, unnest([{','.join(S.LANDMARKS_11.order)}]) AS v FROM beats),
     s AS (SELECT *, lag(v) OVER (PARTITION BY record_id, lead, beat_id ORDER BY pos) AS p FROM q WHERE v IS NOT NULL), n AS (SELECT lead, record_id, beat_id, count(*) FILTER (v < p) AS violations FROM s GROUP BY ALL)
    SELECT lead, CAST(violations AS INTEGER) AS violations, count(*) AS n FROM n GROUP BY ALL""",
)
def order_violations(spark, sf):
    b = beats(spark, sf).select("lead", S.order_violations().alias("violations"))
    return b.groupBy("lead", "violations").agg(F.count(F.lit(1)).alias("n"))


@query("rule_based_landmarks")
def rule_based_landmarks(spark, sf):
    d = G.delineate_rule_based(traces(spark, sf), fs=100.0)
    return d.select("record_id", "lead", "qrs_onset", "qrs_offset", "t_onset", "t_peak", "t_offset", "qrs_end_flag", F.array_join("fallbacks", ";").alias("fallbacks"))


RULE_SQL = SM_SQL + """, e AS (SELECT 'gradient' AS landmark, round(d, 6) AS err_ms FROM gr UNION ALL SELECT 'smoothed', round(v, 6) FROM sm),
 b AS (SELECT * FROM e UNION ALL SELECT 'all', err_ms FROM e)"""


@query(
    "boundary_rule_report",
    f"WITH {RULE_SQL} SELECT landmark, count(err_ms) AS n, round(median(err_ms), 6) AS median_ms, round(avg(abs(err_ms)), 6) AS mae_ms, round(quantile_cont(abs(err_ms), 0.9), 6) AS p90_ms FROM b GROUP BY landmark",
)
def boundary_rule_report(spark, sf):
    t = traces(spark, sf).select(A.box_mean(F.col("trace"), 5).alias("s"))
    arms = [t.select(F.lit(k).alias("landmark"), F.explode(c).alias("err_ms")) for k, c in (("gradient", A.gradient(F.col("s"))), ("smoothed", F.col("s")))]
    arms = [r6(a, "err_ms") for a in arms]
    return r6(G.rule_report(arms[0].unionByName(arms[1])), "median_ms", "mae_ms", "p90_ms")


BASE_SQL = TRACE_SQL + """, k AS (SELECT unnest(range(7)) AS k), md AS (SELECT record_id, lead, k, median(v) AS m FROM trace, k WHERE sample BETWEEN k*8 AND k*8 + 14 GROUP BY ALL),
 p AS (SELECT *, greatest(0, least(6, (sample - 7)/8.0::DOUBLE)) AS pos FROM trace)"""


@query(
    "baseline_removed",
    f"""WITH {BASE_SQL} SELECT p.record_id, p.lead, CAST(sample AS INTEGER) AS sample, round(v - (a.m + (b.m - a.m)*(pos - floor(pos))), 6) AS v
    FROM p JOIN md a ON a.record_id = p.record_id AND a.lead = p.lead AND a.k = CAST(floor(pos) AS BIGINT) JOIN md b ON b.record_id = p.record_id AND b.lead = p.lead AND b.k = least(6, CAST(floor(pos) AS BIGINT) + 1)""",
)
def baseline_removed(spark, sf):
    b = G.remove_baseline(traces(spark, sf), window=15)
    return r6(b.select("record_id", "lead", F.posexplode("flat").alias("sample", "v")), "v")
