import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import consensus as C
from waymark.operators import corpus as K
from waymark.operators import debias as D
from waymark.operators import derive, infer, qc, review
from waymark.operators import score as Z
from waymark.schema import LANDMARKS_11, Keys, align, assert_coverage, assert_unique, require_columns

LM = LANDMARKS_11.order
BASE = dict(zip(LM, (100, 120, 140, 160, 168, 175, 185, 210, 260, 300, 350)))


def table(spark, changes, **extra):
    out = []
    for i, ch in enumerate(changes):
        row = {"record_id": "r", "lead": "II", "beat_id": i + 1, "fs_hz": 500.0, "n_samples": 5000, **extra, **BASE}
        row.update(ch)
        out.append(row)
    cols = ["record_id", "lead", "beat_id", "fs_hz", "n_samples", *[c for c in extra if c not in ("record_id", "lead")], *LM]
    types = {"record_id": "string", "lead": "string", "fs_hz": "double", "disease_class": "string"}
    schema = ", ".join(f"{c} {types.get(c, 'long')}" for c in cols)
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in out], schema)


def rated(spark, **change):
    r = qc.beat_qc(table(spark, [change])).first()
    return r["qc_status"], r["qc_flags"]


def test_row_rules(spark):
    assert rated(spark) == ("clean", [])
    assert rated(spark, q_peak=178) == ("clean", [])  # core inversion of exactly 3
    assert rated(spark, q_peak=179) == ("critical", ["QRS_structural"])
    assert rated(spark, p_offset=164) == ("minor", [])
    assert rated(spark, p_offset=180) == ("minor", [])  # exactly 20
    assert rated(spark, p_offset=181) == ("critical", ["gross_boundary:21smp"])
    assert rated(spark, r_peak=None) == ("critical", ["R_missing"])


def test_absent_landmarks_are_skipped_before_comparing(spark):
    # With onset and Q absent the wave's end meets R directly.
    assert rated(spark, p_offset=200, qrs_onset=None, q_peak=None, p_onset=None)[1] == ["gross_boundary:25smp"]
    assert rated(spark, p_onset=None, p_peak=None, p_offset=None) == ("clean", [])


def test_interval_limits_are_inclusive(spark):
    assert rated(spark, qrs_offset=180, s_peak=178, q_peak=162) == ("clean", [])  # 40 ms
    assert rated(spark, qrs_offset=179, s_peak=178, q_peak=162)[1] == ["QRSdur=38ms"]
    assert rated(spark, qrs_offset=260)[0] == "clean"  # 200 ms


def test_representative_row_is_whole_and_ties_go_down(spark):
    d = table(spark, [{"t_peak": None}, {}, {"t_peak": None}, {}])  # median 2.5: beats 2 and 3 tie
    assert derive.representative(d, ["record_id"], "beat_id").first()["beat_id"] == 2
    e = table(spark, [{}, {"t_peak": None}, {"t_peak": 301}])
    r = derive.representative(e, ["record_id"], "beat_id").first()
    assert r["beat_id"] == 2 and r["t_peak"] is None
    f = derive.representative(e, ["record_id"], "beat_id", fill_from_next=["t_peak"]).first()
    assert f["beat_id"] == 2 and f["t_peak"] == 300


@pytest.mark.parametrize("n,place,ident", [(1, 1, 1), (2, 1, 1), (3, 2, 2), (6, 3, 3), (10, 5, 5), (5, 2, 2)])
def test_interior_representatives(spark, n, place, ident):
    d = table(spark, [{} for _ in range(n)])
    assert derive.representative(d, ["record_id", "lead"], "beat_id", "interior_place").first()["beat_id"] == place
    assert derive.representative(d, ["record_id", "lead"], "beat_id", "interior_id").first()["beat_id"] == ident


def test_repairs_keep_order(spark):
    d = table(spark, [{"p_offset": 190, "t_onset": 150, "r_peak": 230}])
    for rep in (C.repair_core_first(d), C.repair_core_first(C.repair_midpoint(d))):
        r = rep.first()
        b = [r[c] for c in LANDMARKS_11.boundaries]
        assert b == sorted(b) and r["qrs_onset"] <= 230 <= r["qrs_offset"]
        assert r["p_onset"] <= r["p_peak"] <= r["p_offset"]


def by_hand(vals, pinned):
    v, run = list(vals), None
    for i, x in enumerate(v):
        if x is None:
            continue
        if not pinned[i] and run is not None and x < run:
            v[i] = run
        run = v[i] if run is None else max(run, v[i])
    run = None
    for i in reversed(range(len(v))):
        if v[i] is None:
            continue
        if not pinned[i] and run is not None and v[i] > run:
            v[i] = run
        run = v[i] if run is None else min(run, v[i])
    return v


def test_ranked_repair_against_a_recursion(spark):
    rnd = random.Random(1)
    cases = [{c: (None if rnd.random() < 0.15 else BASE[c] + rnd.randrange(-60, 60)) for c in LM} for _ in range(60)]
    pins = [c in LANDMARKS_11.peaks or c == "qrs_onset" for c in LM]
    out = C.repair_ranked(table(spark, cases), ["qrs_onset"]).orderBy("beat_id").collect()
    for case, r in zip(cases, out):
        assert [r[c] for c in LM] == by_hand([case[c] for c in LM], pins)


def test_merge_moves_siblings_and_drops_outside(spark):
    beats = [{c: BASE[c] + 400 * i for c in LM} for i in range(3)]
    m = table(spark, beats).withColumn("n_samples", F.lit(1140))
    corr = table(spark, [{c: BASE[c] + 400 + 10 for c in LM}]).withColumns({"beat_id": F.lit(2), "q_peak": F.lit(None).cast("long")})
    out = {r["beat_id"]: r for r in review.merge_corrections(m, corr).collect()}
    assert out[1]["qrs_onset"] == 170 and out[2]["qrs_onset"] == 570 and out[1]["q_peak"] is None
    assert out[1]["label_quality"] == "propagated" and out[2]["label_quality"] == "corrected"
    assert out[3]["t_offset"] is None and out[3]["t_peak"] == 1110  # 1160 lies past the end
    unknown = corr.withColumn("beat_id", F.lit(99))  # falls back to the nearest anchor
    assert {r["beat_id"]: r["label_quality"] for r in review.merge_corrections(m, unknown).collect()}[2] == "corrected"
    nobody = review.merge_corrections(m, corr.withColumn("lead", F.lit("V1")))
    assert nobody.filter("label_quality is not null").count() == 0


def test_batches_against_the_greedy_loop(spark):
    rnd = random.Random(2)
    sizes = [rnd.choice([1, 2, 5, 12, 30, 300]) for _ in range(700)]
    d = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "place long, size long")
    want, n, b = {}, 0, 1
    for i, s in enumerate(sizes):
        if n >= 250:
            b, n = b + 1, 0
        n += s
        want[i + 1] = b
    got = {r["place"]: r["batch"] for r in review.pack_batches(d, "place", "size", 250, width=8).collect()}
    assert got == want


def shorten(pos, limit):
    pos = list(pos)
    while True:
        short = [i for i in range(len(pos) - 1) if abs(pos[i + 1] - pos[i]) <= limit]
        if not short:
            return pos
        gone = set()
        for i in short:
            k, n = i + 1, len(pos)

            def rough(skip):
                s = [p for j, p in enumerate(pos[k - 3:k + 3]) if j != skip]
                d = [b - a for a, b in zip(s, s[1:])]
                return sum(abs(b - a) for a, b in zip(d, d[1:]))

            if 3 <= k <= n - 3:
                gone.add(i if rough(2) > rough(3) else i + 1)
            else:
                gone.add(i + 1 if k < 3 else i)
        pos = [p for j, p in enumerate(pos) if j not in gone]


def test_short_intervals_against_the_loop(spark):
    rnd = random.Random(8)
    data, want = [], {}
    for k in range(6):
        pos, t = [], 0
        for _ in range(25):
            t += rnd.choice([5, 60, 90, 100, 110, 20])
            pos.append(t)
        data += [(k, p) for p in pos]
        want[k] = shorten(pos, 25)
    d = spark.createDataFrame(data, "k long, p long")
    got = {}
    for r in qc.drop_short_intervals(d, ["k"], "p", 25).collect():
        got.setdefault(r["k"], []).append(r["p"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_chained_events_are_one_cluster(spark):
    d = spark.createDataFrame([("r", "a", 0), ("r", "b", 90), ("r", "a", 180), ("r", "c", 270), ("r", "a", 900)], "k string, c string, p long")
    got = C.event_consensus(d, ["k"], "c", "p", 100, 6, grain=64).collect()
    assert [(r["cluster"], r["n_events"], r["n_agree"], r["position"]) for r in got] == [(0, 4, 3, 135)]


def test_far_prediction_counts_twice_and_undefined_slope(spark):
    t = table(spark, [{"record_id": f"r{i}"} for i in range(3)], disease_class="x")
    p = t.withColumns({"qrs_onset": F.when(F.col("record_id") == "r0", F.col("qrs_onset") + 50).otherwise(F.col("qrs_onset")), "q_peak": F.lit(None).cast("long")})
    s = {r["landmark"]: r for r in Z.landmark_errors(Z.tidy_errors(p, t)).collect()}
    assert (s["qrs_onset"]["tp"], s["qrs_onset"]["fp"], s["qrs_onset"]["fn"]) == (2, 1, 1)
    assert (s["q_peak"]["fn"], s["q_peak"]["n_compared"], s["q_peak"]["mae_ms"]) == (3, 0, None)
    assert s["qrs_onset"]["response_slope"] is None  # the truth does not vary
    assert s["t_peak"]["f1"] == 1.0


def test_corrections_pair_on_channel_and_outliers_stay_counted(spark):
    ref = table(spark, [{"lead": "I"}, {"lead": "II"}], disease_class="x")
    rev = table(spark, [{"lead": "I", "qrs_onset": 161}, {"lead": "II", "qrs_onset": 300}]).withColumn("reviewed", F.lit(1))
    r = {x["lead"]: x for x in D.pair_residuals(ref, rev).filter("fiducial = 'qrs_onset'").collect()}
    assert r["I"]["residual_ms"] == 2.0 and r["I"]["usable"]
    assert r["II"]["outlier"] and not r["II"]["usable"]
    o = D.offset_table(D.pair_residuals(ref, rev)).filter("fiducial = 'qrs_onset' and scope = 'global'").first()
    assert (o["n"], o["n_outlier"]) == (1, 1)


def test_offset_rounds_before_or_after_adding(spark):
    u = table(spark, [{}], disease_class="x")
    o = spark.createDataFrame([("qrs_onset", "global", "ALL", -3.0)], "fiducial string, scope string, scope_class string, offset_ms double")
    clean = K.assemble_clean_units(u, u.select("record_id", "lead", *LM), o).first()
    assert clean["qrs_onset"] == 158  # -1.5 samples round to -2 first
    applied = D.apply_offsets(u, o).first()
    assert applied["qrs_onset"] == 158  # 158.5 rounds to 158 afterwards
    o2 = o.withColumn("offset_ms", F.lit(-5.0))
    assert K.assemble_clean_units(u, u.select("record_id", "lead", *LM), o2).first()["qrs_onset"] == 158  # -2.5 -> -2
    assert D.apply_offsets(u, o2).first()["qrs_onset"] == 158  # 157.5 -> 158


@pytest.mark.parametrize("n", [0, 7, 8])
def test_small_samples_get_no_interval(spark, n):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(n)], "g string, id long, v double")
    r = infer.bootstrap_ci(d, ["g"], "v", ["id"], n=50).collect()
    assert len(r) == (1 if n else 0)
    if n:
        assert (r[0]["ci_lo"] is None) == (n < 8)


def test_bootstrap_interval_has_the_right_width(spark):
    d = spark.range(400).select(F.lit("a").alias("g"), "id", (F.col("id") % 20).cast("double").alias("v"))
    r = infer.bootstrap_ci(d, ["g"], "v", ["id"], "mean", n=800, seed=3).first()
    se = 5.766 / 20
    assert abs(r["point"] - 9.5) < 1e-9 and abs((r["ci_hi"] - r["ci_lo"]) / (2 * 1.96 * se) - 1) < 0.15
    own = infer.bootstrap_ci(d, ["g"], "v", ["id"], lambda v, w: F.max(F.when(w > 0, v)), n=50).first()
    assert own["point"] == 19.0


def test_cluster_modes_weigh_differently(spark):
    d = spark.createDataFrame([("a", 1.0)] * 9 + [("b", 0.0)], "r string, v double").withColumn("g", F.lit(1))
    assert infer.cluster_bootstrap(d, ["g"], "v", "r", "record_mean", 20).first()["point"] == 0.5
    assert infer.cluster_bootstrap(d, ["g"], "v", "r", "units", 20).first()["point"] == 0.9


def test_folds_cover_and_samples_repeat(spark):
    e = spark.createDataFrame([("AB"[i % 2], f"rec{i:03d}") for i in range(40)], "c string, record_id string")
    s = K.cv_splits(e, "c", "record_id")
    assert K.fold_coverage(s, e, "record_id").count() == 0
    both = s.filter("split = 'train'").select("fold", "record_id").intersect(s.filter("split = 'test'").select("fold", "record_id"))
    assert both.count() == 0
    a = K.seeded_sample(e, ["c"], ["record_id"], 5, 1).select("record_id")
    b = K.seeded_sample(e.repartition(7), ["c"], ["record_id"], 5, 1).select("record_id")
    assert a.count() == 10 and a.exceptAll(b).count() == 0
    ladder = K.nshot_ladder(e, "c", "record_id")
    one, five = (ladder.filter(f"split = 'train' and n = {n}").select("record_id") for n in (1, 5))
    assert one.exceptAll(five).count() == 0


def test_schema_checks(spark):
    d = table(spark, [{}, {"beat_id": 1}])
    with pytest.raises(ValueError, match="missing columns: x, y"):
        require_columns(d, ["x", "lead", "y"])
    with pytest.raises(ValueError, match="duplicate key"):
        assert_unique(d, Keys().row)
    with pytest.raises(ValueError, match="no match"):
        assert_coverage(d, d.filter("false"), ["record_id"])
    assert align(d, ["lead", "extra", "src"], constants={"src": "auto"}).first().asDict() == {"lead": "II", "extra": None, "src": "auto"}


def test_exclusions_leave_other_tables_alone(spark):
    a = spark.createDataFrame([("x",), ("y",)], "record_id string")
    b = spark.createDataFrame([(1,)], "n int")
    out = review.apply_exclusions({"a": a, "b": b}, a.filter("record_id = 'x'"))
    assert out["b"] is b and [r[0] for r in out["a"].collect()] == ["y"]


def test_upsert_never_loses_a_key(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 5, 20)], "k string, t int, v int")
    new = spark.createDataFrame([("b", 4, 99), ("c", 1, 30)], "k string, t int, v int")
    assert sorted(tuple(r) for r in review.upsert(old, new, ["k"], ["t"]).collect()) == [("a", 1, 10), ("b", 5, 20), ("c", 1, 30)]
